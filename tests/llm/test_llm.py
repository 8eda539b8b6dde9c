"""The llm operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import digest, exact, licenses, mixing, packing, passages, quality, secrets, sharding, simhash
from tessera.llm.common import components, maybe_in, ranked, without

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(("an", "the", "or", "ti", "es", "é", "wh")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    """Rows with near and exact copies, nulls, empties, one very long text, a hot group and ties."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(60)]
    texts += [texts[3]] * 30 + [texts[5] + " tail", texts[5].replace("the", "ten", 1), None, "", "", None, "   ", prose(rng, 30_000), "AKIA" + "B" * 20, "one", "one two"]
    texts += ["Licensed under CC BY-NC 4.0.\nAll rights reserved. cc by cc by", 'db_password = "hunter2hunter2"\nx = "0123456789abcdef01234567"\nauth_token = x']
    return [(i * 3, t, rng.choice(("en", "fr", None)), f"src{i % 5}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names clash with likely internal ones."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit(1), "fp": F.lit("x"), "words": F.lit(0.5), "shard": F.lit("s"), "_row": F.lit(2), "_maybe": F.lit(3), "_id": F.lit(4), "_times": F.lit(5)}).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- shared pieces


def test_ranked_is_gapless_in_each_key(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = ranked(df, ["k"], ["id"], 7).toPandas()
    for _, group in got.groupby("k"):
        assert sorted(group["rank"]) == list(range(len(group)))


def test_components_on_chains_stars_and_random_graphs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    vertices = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == vertices
    for a in vertices:
        assert (got[a] == got[0]) == (find(a) == find(0))
    classes = {}
    for v in vertices:
        classes.setdefault(find(v), set()).add(got[v])
    assert all(len(c) == 1 for c in classes.values())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_membership_filter_never_misses(spark):
    df, gone = spark.range(500).withColumnRenamed("id", "doc_id"), spark.range(0, 500, 7).withColumnRenamed("id", "v")
    assert maybe_in(df, "doc_id", gone, "v", "m").where("doc_id % 7 = 0 AND NOT m").count() == 0
    assert sorted(r.doc_id for r in without(df, "doc_id", gone, "v").collect()) == [i for i in range(500) if i % 7]


# --- 1 licences


def test_license_base_counts(docs, rows):
    import re

    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for doc, text, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        starts = [i for p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = got[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(starts), min(starts, default=None), max(starts, default=None))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_license_join_is_exact():
    rng = random.Random(5)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.encode().split()})
    frequency = {w: rng.randint(0, 50) for w in vocabulary}
    index = licenses.Index(licenses.TEMPLATES, frequency)
    for _ in range(400):
        _, template = rng.choice(licenses.TEMPLATES)
        words = [w for w in template.encode().split() if rng.random() < 0.9] + rng.sample(vocabulary, 5) + [b"zzz"]
        block = set(words)
        want = set()
        for label, text in licenses.TEMPLATES:
            t = set(text.encode().split())
            if len(t & block) >= licenses.THRESHOLD * len(t) - 1e-9:
                want.add((label, text))
        assert {licenses.TEMPLATES[t] for t in index.candidates(block)} == want


def test_license_scan_against_brute_force_over_whole_texts():
    """Every run of words of every template's longest length is compared, by a quadratic longest common subsequence."""
    rng = random.Random(32)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    index = licenses.Index(licenses.TEMPLATES, {})

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], max(before + 1 if x == y else 0, row[j], row[j + 1])
        return row[-1]

    met = 0
    for _ in range(60):
        words = rng.choices(vocabulary + ["zz"] * 40, k=rng.randint(0, 60))
        for _ in range(2):
            template = rng.choice(licenses.TEMPLATES)[1].split()
            kept = [w for w in template if rng.random() < 0.92]
            for _ in range(rng.choice((0, 0, 2, len(template) // 2, len(template)))):
                kept.insert(rng.randint(0, len(kept)), "between")
            if rng.random() < 0.2:
                rng.shuffle(kept)
            words += kept + rng.choices(vocabulary + ["zz"] * 40, k=rng.randint(0, 60))
        text = "".join(w + rng.choice((" ", " ", "\n", ", ")) for w in words)
        labels, score = set(), 0.0
        for label, template in licenses.TEMPLATES:
            every = template.split()
            distinct = list(dict.fromkeys(every))
            run = -(-3 * len(every) // 2)
            most = max((common(words[i : i + run], distinct) for i in range(len(words))), default=0)
            if most >= 0.8 * len(distinct) - 1e-9:
                labels.add(label)
                score, met = max(score, most / len(distinct)), met + 1
        got = licenses.scan(licenses.normalised(text), index)
        base = set(got[4].split(",")) - {""}
        assert set(got[5].split(",")) - {""} == labels | base and got[6] == pytest.approx(1.0 if base else score)
    assert met > 60


def test_scattered_words_are_no_notice(spark):
    index = licenses.Index(licenses.TEMPLATES, {})
    assert licenses.scan(licenses.normalised("the license is mit and the book was released yesterday under cover"), index)[5] == ""
    df = spark.createDataFrame([(1, "MIT"), (1, "MIT"), (None, None), (2, "Released under\nthe MIT license")], "doc_id long, text string").withColumn("labels", F.lit("x"))
    assert sorted(r.labels for r in licenses.scan_licenses(df).collect()) == ["", "", "", "mit"]


def test_license_labels(spark, empty):
    text = "x\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 3."
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.base_labels == "cc-by,gpl" and {"mit", "cc-by-nc", "gpl"} <= set(r.labels.split(","))
    assert licenses.scan_licenses(empty).count() == 0


def test_wrapped_notices_are_compared_whole():
    index = licenses.Index(licenses.TEMPLATES, {})
    notices = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files",
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met",
        "gpl": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public\nLicense",
    }
    for label, notice in notices.items():
        for before in (0, 31, 100):
            text = "word " * before + "\n" + notice + "\n" + "word " * 50
            assert label in licenses.scan(licenses.normalised(text), index)[5].split(",")
    r = licenses.scan(licenses.normalised(notices["mit"]), index)
    assert r[5] == "mit" and r[6] == 1.0


# --- 2 packing


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.default_tokenizer())


def test_encoder_equals_the_tokeniser(encoder):
    odd = ["", "a  b", "don't I'll\n\nx", " x y", "t <|endoftext|> u", "“q”,\n1.5, x!? a.b", "a\x1cb c", "中文 字.\nA", "x\t y\r\nz", "\n", " a", "a ", "a\0b c", "ab, cd.\nEf; gh", "I'm, we're.", "_a -b"]
    assert encoder(odd) == encoder._direct(odd)
    assert encoder(odd) == encoder._direct(odd)  # from the cache


def test_encoder_looks_each_part_up_once(encoder, monkeypatch):
    rng = random.Random(35)
    text = " ".join(rng.choice(("alpha", "beta,", "gamma.\ndelta", "x1", "naïve", "(two)", "don't")) for _ in range(500))
    want = np.asarray(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    encoder.cache.clear()
    made = []
    monkeypatch.setattr(encoder.cache, "make", lambda part: made.append(part) or encoder._part(part))
    assert encoder([text, text]) == [want, want] and len(made) == len(set(made)) == len(encoder.cache)


@pytest.mark.parametrize("cap", [packing.Capacity(tokens=64, cost=64 * 64), packing.Capacity(tokens=64, documents=3, cost=64 * 64, score="dot"), packing.Capacity(tokens=64, cost=64 * 64, weights=(0.2, 0.2, 1.0))])
def test_packing_round_trip(docs, rows, cap, encoder):
    got = packing.best_fit_pack(docs, packing.default_tokenizer(), cap, keep_ids=True).toPandas()
    for doc, text, *_ in rows:
        ids = encoder([text or ""])[0] + np.asarray([2], "<u4").tobytes()
        own = got[got.doc_id == doc].sort_values("piece")
        assert b"".join(map(bytes, own.ids)) == ids
        assert list(own.start) == list(np.cumsum([0, *own.length])[:-1])
        assert all(n == cap.tokens for n in list(own.length)[1:]) and (len(own) == 1) == (len(ids) // 4 <= cap.tokens)
        assert [zlib.crc32(bytes(x)) for x in own.ids] == list(own.ids_crc32)
    for _, bin_ in got.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert list(bin_.offset) == list(np.cumsum([0, *bin_.length])[:-1])
        assert bin_.length.sum() <= cap.tokens and len(bin_) <= cap.documents and (bin_.length**2).sum() <= cap.cost


def test_packing_is_tight_and_bounded():
    rng = random.Random(0)
    histogram = {n: rng.randint(1, 1000) for n in range(1, 1024)}
    runs, bins = packing.plan_bins(histogram, packing.Capacity())
    total = sum(n * c for n, c in histogram.items())
    assert bins <= 1.02 * total / 1024 + 1
    more, _ = packing.plan_bins({n: 1000 * c for n, c in histogram.items()}, packing.Capacity())
    assert len(more) < 3 * len(runs) + 1000  # the plan does not follow the corpus
    with pytest.raises(ValueError):
        packing.Capacity(cost=5)


def test_packing_empty(empty):
    assert packing.best_fit_pack(empty, packing.default_tokenizer()).count() == 0


# --- 3 mixing


def test_water_filling_matches_a_sequential_version(spark):
    rng = random.Random(2)
    leaves = [(f"d{i % 3}", f"l{i % 4}", f"src{i}", rng.randint(1, 2000)) for i in range(40)]
    mix = mixing.Mix(domains={"d0": 5, "d1": 1, "d2": 0}, languages={"l0": 1, "l1": 9}, sources={"src1": 0, "src2": 50}, default=3, budget_per_mille=900)
    got = {r.source: r.leaf_budget for r in mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, leaf_tokens long"), mix).collect()}

    def pour(budget, nodes):
        """nodes: (name, weight, capacity); repeated rounds among those with room."""
        if sum(w for _, w, _ in nodes) == 0:
            nodes = [(n, 1, c) for n, _, c in nodes]
        given, open_ = {}, [n for n in nodes if n[1] > 0]
        given.update({n: 0 for n, w, _ in nodes if w == 0})
        while True:
            total = sum(w for _, w, _ in open_)
            full = [n for n in open_ if n[2] * total <= budget * n[1]]
            if not full:
                given.update({n: budget * w // total for n, w, _ in open_} if total else {})
                return given
            for n in full:
                given[n[0]] = n[2]
                budget -= n[2]
                open_.remove(n)

    cap = lambda test: sum(2 * t for d, g, s, t in leaves if test(d, g, s))
    budget = sum(t for *_, t in leaves) * 900 // 1000
    top = pour(budget, [(d, mix.domains[d], cap(lambda x, y, z, d=d: x == d)) for d in mix.domains])
    want = {}
    for d in mix.domains:
        langs = sorted({g for x, g, _, _ in leaves if x == d})
        second = pour(top[d], [(g, mix.languages.get(g, 3), cap(lambda x, y, z, g=g, d=d: x == d and y == g)) for g in langs])
        for g in langs:
            want |= pour(second[g], [(s, mix.sources.get(s, 3), 2 * t) for x, y, s, t in leaves if x == d and y == g])
    assert got == want


def test_mixing_takes_prefixes_of_seeded_orders(docs, rows, empty):
    mix = mixing.Mix(budget_per_mille=1300)
    taken = mixing.take_epochs(mixing.with_leaf(docs), mix).toPandas()
    want = mixing.leaf_budgets(mixing.with_leaf(docs).groupBy(F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source")).agg(F.sum("_tokens").alias("leaf_tokens")), mix).collect()
    every = mixing.with_leaf(docs).toPandas()
    for b in want:
        own = every[(every._domain == b.domain) & (every._lang == b.lang) & (every._source == b.source)]
        whole, rest = divmod(b.leaf_budget, b.leaf_tokens)
        order = sorted(own.itertuples(), key=lambda r: (int(hashlib.md5(f"{mix.seed}:{whole}:{r.doc_id}".encode()).hexdigest()[:15], 16), r.doc_id))
        expect = {(r.doc_id, e) for r in order for e in range(whole)}
        total = 0
        for r in order:
            total += int(own[own.doc_id == r.doc_id]._tokens.iloc[0])
            if total > rest:
                break
            expect.add((r.doc_id, whole))
        mine = taken[(taken._domain == b.domain) & (taken._lang == b.lang) & (taken._source == b.source)]
        assert set(zip(mine.doc_id, mine._epoch, strict=True)) == expect
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.take_epochs(mixing.with_leaf(empty)).count() == 0


# --- 4 SimHash


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 2])
def test_simhash_components(docs, rows, crowded):
    fps = {d: brute_fingerprint(t) for d, t, *_ in rows}
    label = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if label[b] < label[a] and bin(fps[a] ^ fps[b]).count("1") <= 3:
                    label[a], changed = label[b], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs, crowded=crowded).collect()}
    assert got == {d: (f"{f:016x}", label[d]) for d, f in fps.items()}


def test_forest_finds_every_link_in_crowded_postings():
    rng = random.Random(9)
    base = rng.getrandbits(64)
    near = sorted({base ^ sum(1 << rng.randrange(24) for _ in range(2)) for _ in range(300)} | {rng.getrandbits(24) | base >> 24 << 24 for _ in range(50)})
    fps = np.asarray(near, np.uint64)
    free = simhash._flips(list(range(24)), 3)

    def classes(links):
        parent = {f: f for f in near}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(a)] = find(b)
        groups = {}
        for f in near:
            groups.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, groups.values()))

    brute = [(a, b) for i, a in enumerate(near) for b in near[i + 1 :] if bin(a ^ b).count("1") <= 3]
    for few in (10, 60, 100):
        part = fps[:few]
        assert {x for e in simhash.forest(part) for x in e} == {x for a, b in brute for x in (a, b) if a in set(part.tolist()) and b in set(part.tolist())}
    assert classes(simhash.forest(fps)) == classes(brute) == classes(simhash.forest(fps, free=free))


def test_postings_hold_the_guarantee():
    for most in range(4):
        for lost in __import__("itertools").combinations(range(8), most):
            kept = set(range(8)) - set(lost)
            assert any(set(t) <= kept for t in simhash.TRIPLES) and any(set(t) <= kept for t in simhash.FIVES)


def test_similar_texts_against_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        words = prose(rng, 120).split()
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 8, 30):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(zip(*[t.encode().lower().split()[i:] for i in range(5)], strict=False)) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    stay = {i for i in range(len(texts)) if find(i) == i}
    kept = {r.doc_id for r in simhash.keep_dissimilar(df).collect()}
    assert links > 50 and stay <= kept and len(kept - stay) <= 0.05 * (len(texts) - len(stay))


def edited(words, at):
    return [f"edit{i}" if i in at else w for i, w in enumerate(words)]


def shingles_of(words):
    return set(zip(*[words[i:] for i in range(5)], strict=False))


def jaccard(a, b):
    a, b = shingles_of(a), shingles_of(b)
    return len(a & b) / len(a | b)


def distinct_words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_chains_of_similar_texts_are_one_group(spark):
    rng = random.Random(21)
    rows, firsts = [], set()
    for _ in range(150):
        b = distinct_words(rng, 204)
        a, c = edited(b, {10, 40}), edited(b, {100, 130, 160})
        assert jaccard(a, b) >= 0.8 and jaccard(b, c) >= 0.8
        c = edited(c, {190})
        assert jaccard(b, c) >= 0.8 > jaccard(a, c)
        firsts.add(len(rows))
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate((a, b, c))]
    kept = {r.doc_id for r in simhash.keep_dissimilar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == firsts


def test_similar_pairs_in_a_family_with_shared_boilerplate(spark):
    rng = random.Random(22)
    shared = distinct_words(rng, 160)
    texts = [shared + distinct_words(rng, 50) for _ in range(300)]
    texts += [edited(t, {20, 60, 120, 190}) for t in texts[:100]]
    assert jaccard(texts[0], texts[300]) >= 0.8 > 0.7 > jaccard(texts[0], texts[1])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_dissimilar(df).collect()} == set(range(300))


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 2])
def test_indexed_pairs_connect_what_three_bits_connect(spark, crowded):
    rng = random.Random(33)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), k)) for p in prints for k in (1, 2, 3, 3, 4)] + prints[:20] + [0, 0, 7]
    rows = [(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(rng.sample(prints, len(prints)))]
    got = [(r.a, r.b) for r in simhash.indexed_pairs(spark.createDataFrame(rows, "id long, fp long"), crowded).collect()]
    bits = np.bitwise_count(np.bitwise_xor.outer(*[np.array([p for _, p in rows], np.int64).view(np.uint64)] * 2))
    want = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if bits[a, b] <= 3]

    def classes(pairs):
        root = list(range(len(rows)))
        for _ in rows:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert all(a < b for a, b in got) and len(want) > 100 and classes(got) == classes(want)


def test_similar_texts_come_through_the_index_of_fingerprints(spark, monkeypatch):
    rng = random.Random(34)
    texts = [distinct_words(rng, 400) for _ in range(20)]
    texts += [edited(t, {200}) for t in texts]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    candidates = []

    def spied(source, marks, pairs, *rest, inner=simhash.similar_pairs):
        candidates.append({(r.a, r.b) for r in pairs.collect()})
        return inner(source, marks, pairs, *rest)

    linked, inner = [], simhash.indexed_pairs
    monkeypatch.setattr(simhash, "similar_pairs", spied)
    monkeypatch.setattr(simhash, "indexed_pairs", lambda prints, *rest: linked.append({(r.a, r.b) for r in inner(prints, *rest).collect()}) or inner(prints, *rest))
    assert {r.doc_id for r in simhash.keep_dissimilar(df).collect()} == set(range(20))
    assert len(linked[0]) >= 10 and linked[0] <= candidates[0] and not linked[0] & candidates[1]


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_a_posting_compares_every_pair_that_is_not_yet_connected(block):
    rng = random.Random(23)
    rows = sorted((rng.randrange(12), rng.randrange(6), i) for i in range(300))
    columns = {"key": [k for k, _, _ in rows], "id": [i for *_, i in rows], "n": [100] * 300, "pos": [0] * 300, "root": [r for _, r, _ in rows]}
    whole = pa.RecordBatch.from_pydict(columns)
    want = {(min(i, j), max(i, j)) for k, r, i in rows for m, s, j in rows if k == m and r != s}
    for size in (7, 64, 300):
        laid = pa.Table.from_batches(list(simhash._open((whole.slice(lo, size) for lo in range(0, 300, size)), block)))
        laid = laid.sort_by([(c, "ascending") for c in ("key", "meeting", "side", "root")])
        laid = laid.append_column("mark", pa.array([bytes(64 if i % 3 else 128) for i in range(laid.num_rows)], pa.binary())).combine_chunks()
        got = simhash._crossing(iter(laid.to_batches(max_chunksize=size)), 0.8)
        assert {p for b in got for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)} == want


def test_marks_never_differ_in_more_bits_than_the_sets():
    rng = np.random.default_rng(5)
    for n, m, common in ((100, 110, 90), (600, 500, 480), (5000, 4500, 4400), (3, 0, 0)):
        both = rng.integers(0, 1 << 63, n + m - common, dtype=np.uint64)
        a, b = both[:n], both[n - common :]
        marks = np.empty(2, object)
        marks[:] = [simhash.mark(a), simhash.mark(b)]
        got = simhash.apart(marks[:1], marks[1:])[0]
        assert 0 < got <= n + m - 2 * common and got >= 0.6 * min(n + m - 2 * common, 200)


def test_similar_sets_meet_whatever_their_repeats_and_lengths(spark):
    rng = random.Random(24)
    texts = []
    for i in range(60):
        line = distinct_words(rng, 14)
        body = line + distinct_words(rng, 86)
        texts += [body + line, body + line * (6 + i % 20)]
    for n in (5, 9, 20, 60, 404):
        for _ in range(30):
            words = distinct_words(rng, n + 4)
            copy = list(words)
            while jaccard(copy[:-1] + ["edit"], words) >= 0.8 and len(copy) > 5:
                copy.pop()
            texts += [words, copy]
    assert all(jaccard(a, b) >= 0.8 for a, b in zip(texts[::2], texts[1::2], strict=True))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_dissimilar(df).collect()} == set(range(0, len(texts), 2))


# --- 5 digests


def test_edited_digests(docs, rows, empty):
    got = {r.doc_id: r for r in digest.edited_digests(docs).collect()}
    ordered = sorted(rows)
    assert set(got) == {r[0] for r in ordered}
    for (doc, text, *_), (_, after, *_) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, after, r = text or "", after or "", got[doc]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == digest.digest(text.encode()) and r.edited_fingerprint == digest.digest(edited.encode())
        assert r.near_next == digest.likeness(r.fingerprint, digest.digest(after.encode()))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert digest.edited_digests(empty).count() == 0


def test_edited_digests_over_many_ranges(docs, rows, monkeypatch):
    from functools import partial

    monkeypatch.setattr(digest, "with_next", partial(digest.with_next, per_range=4))
    got = {r.doc_id: r.edited_sha256 for r in digest.edited_digests(docs).collect()}
    ordered = sorted(rows)
    for (doc, text, *_), (_, after, *_) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        assert got[doc] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_counts_do_not_depend_on_spans(monkeypatch):
    data = random.Random(4).randbytes(5000)
    whole = digest.counts(data)
    monkeypatch.setattr(digest, "_SPAN", 700)
    assert (digest.counts(data) == whole).all()


def test_likeness_tells_edited_from_next():
    rng = random.Random(6)
    texts = [prose(rng, 300) for _ in range(30)]
    marks = [digest.digest(t.encode()) for t in texts]
    for i in range(29):
        edited = texts[i][: len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2]
        assert digest.likeness(marks[i], digest.digest(edited.encode())) > digest.likeness(marks[i], marks[i + 1])
    assert digest.likeness(marks[0], marks[0]) == 1.0


# --- 6 sharding


def test_shards_are_even_and_groups_stay_together(docs, rows, empty):
    got = sharding.shard(docs, 4).toPandas()
    sizes = {d: len((t or "").encode()) + 1 for d, t, *_ in rows}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == sizes
    counts = got.shard.value_counts()
    assert len(got) == len(rows) and counts.max() - counts.min() <= 1 and set(got.shard) <= set(range(4))
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    by_text = {}
    for d, t, *_ in rows:
        by_text.setdefault(t or "", []).append(d)
    shard = dict(zip(got.doc_id, got.shard, strict=True))
    small = [g for g in by_text.values() if 1 < len(g) <= len(rows) // 8]
    assert small and all(len({shard[d] for d in g}) == 1 for g in small)
    assert sharding.shard(empty).count() == 0


def test_sharding_without_single_documents(spark):
    df = spark.createDataFrame([(i, f"t{i // 2}") for i in range(64)], "doc_id long, text string")
    got = sharding.shard(df, 4).toPandas()
    assert set(got.shard.value_counts()) == {16}


@pytest.mark.parametrize("groups", [[10], [16], [40, 12, 9, 9], [16, 16, 8, 8, 8], [100], [5] * 20 + [3] * 10])
def test_cut_edges_are_as_few_as_can_be(spark, groups):
    """Groups that fit stay whole; a larger one is over as few shards as hold it. Quota: 16."""
    texts = [f"g{g}" for g, n in enumerate(groups) for _ in range(n)]
    texts += [f"single {i}" for i in range(256 - len(texts))]
    random.Random(33).shuffle(texts)
    got = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 16).toPandas()
    assert set(got.shard.value_counts()) == {16}
    held = {}
    for d, s in zip(got.doc_id, got.shard, strict=True):
        held.setdefault(texts[d], []).append(s)
    for g, n in enumerate(groups):
        assert len(set(held[f"g{g}"])) == -(-n // 16), (g, n)


def test_sharding_of_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None), (2, "")] * 8, "doc_id long, text string").withColumn("_part", F.lit(1))
    got = sharding.shard(df, 4).toPandas()
    assert len(got) == 40 and set(got.shard.value_counts()) == {10}
    assert all(sorted(own.slot) == list(range(10)) for _, own in got.groupby("shard"))


# --- 7 secrets


def test_secret_base_spans(docs, rows):
    import re

    got = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    for doc, text, *_ in rows:
        text, spans = text or "", []
        pattern = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
        spans += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[1]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        line = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        r = got[doc]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_constants_are_propagated():
    text = 'x = "Zk3v9QpL7wTa"\ndb_pwd = x\ncolour = "Zk3v9QpL7wTb"\n"client_secret": "q8W-e7R6t5Y4"\npassword = "changeme"'
    found = {text[a:b] for a, k, b in secrets.literal_spans(text)}
    assert found == {"Zk3v9QpL7wTa", "q8W-e7R6t5Y4"}
    assert secrets.literal_spans("") == [] and secrets.scan("")[4] == ""


def test_literals_of_any_form_and_length_are_reported():
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefXYZ0123456789") for _ in range(6000))
    cases = {
        "DB_PWD=s3cr3tPassw0rd9": "s3cr3tPassw0rd9",
        "passphrase: hunter2abcXYZ": "hunter2abcXYZ",
        "signing_key = aK39dkQ02mZ": "aK39dkQ02mZ",
        r'{"private_key": "-----BEGIN\nMIIEv9Qx7\n"}': r"-----BEGIN\nMIIEv9Qx7\n",
        f'db_pwd = "{long}"': long,
        f"db_pwd = {long}+/": long + "+/",
        "pwd_" + "n" * 100 + ' = "Zk3v9QpL7wTa"': "Zk3v9QpL7wTa",
        "x=1\npwd_" + "9" * 100 + ' = "Zk3v9QpL7wTa"': "Zk3v9QpL7wTa",
    }
    for text, literal in cases.items():
        assert [text[a:b] for a, _, b in secrets.literal_spans(text)] == [literal]
    assert secrets.literal_spans("value7abcXY = read()\ndb_pwd = value7abcXY") == []


def test_method_spans_on_a_grammar_of_assignments():
    """Texts are made from forms with a place for a name and places for literals; the spans must be exactly those of
    the secrets that sensitive names are given."""
    rng = random.Random(31)
    word = lambda n, letters="abcdefghkmnpqrstuvwxyzABCDEFGH23456789": "".join(rng.choice(letters) for _ in range(n))
    secret = lambda: "Z" + word(rng.choice((11, 15, 40))) + "7x9"
    blank = lambda: " " * rng.choice((0, 1, 1, 2, 30))
    quote = lambda s: rng.choice(('"{}"', "'{}'", "`{}`", 'r"{}"', '"""{}"""', "'''{}'''")).format(s)
    forms = [
        lambda n, s: (f"{n}{blank()}={blank()}{quote(s)}", [s]),
        lambda n, s: (f"{n}: str = {quote(s)};", [s]),
        lambda n, s: (f"{n}{blank()}:{blank()}{s}!", [s + "!"]),
        lambda n, s: (f'{{"{n}" : "{s}"}}', [s]),
        lambda n, s: (f"conf['{n}'] = {quote(s)}", [s]),
        lambda n, s: (f"{n} => '{s}',", [s]),
        lambda n, s: (f'{n} = "{s}" + "{s[::-1]}"', [s, s[::-1]]),
        lambda n, s: (f'{n} = ("{s}"\n    "{s[::-1]}")', [s, s[::-1]]),
        lambda n, s: (f'{n} = ["{s}", 12, "{s[::-1]}"]', [s, s[::-1]]),
        lambda n, s: (f'connect(host="db", {n}="{s}")', [s]),
        lambda n, s: (f'set_{n}("{s}")', [s]),
        lambda n, s: (f'os.putenv("{n}", "{s}")', [s]),
        lambda n, s: (f"<{n}>{s}</{n}>", [s]),
        lambda n, s: (f'<add key="{n}" value="{s}"/>', [s]),
        lambda n, s: (f'{n} = "a\\"{s}"', [f'a\\"{s}']),
        lambda n, s: (f'x{s[1:5]} = "{s}"\ny{s[1:5]} = x{s[1:5]}\n{n} = y{s[1:5]}', [s]),
    ]
    for _ in range(150):
        text, want = "", []
        for form in rng.sample(forms, 6):
            hot = rng.random() < 0.6
            name = rng.choice(("db_pwd", "userPassphrase", "auth_credential", "signingKey")) if hot else rng.choice(("colour", "title", "width_px", "zipcode"))
            value = secret() if rng.random() < 0.8 else "xxxxxx"
            piece, literals = form(name, value)
            at = len(text)
            for literal in literals if hot and value != "xxxxxx" else ():
                at = len(text) + piece.index(literal, at - len(text))
                want.append((at, 3, at + len(literal)))
                at += len(literal)
            text += piece + rng.choice(("\n", "\n\n", "\nsome words of prose. And: more prose\n"))
        assert secrets.literal_spans(text) == sorted(want), text


def test_secrets_on_nulls_repeated_rows_and_an_empty_table(spark, empty):
    df = spark.createDataFrame([(1, "db_pwd = 'Zk3v9QpL7wTa'"), (1, "db_pwd = 'Zk3v9QpL7wTa'"), (None, None), (2, "")], "doc_id long, text string").withColumn("spans", F.lit("x"))
    got = sorted(secrets.scan_secrets(df).collect(), key=str)
    assert [r.spans for r in got if r.doc_id == 1] == ["literal:10:22"] * 2 and len(got) == 4
    assert secrets.scan_secrets(empty).count() == 0
    assert secrets.literal_spans("a = " + "[" * 50 + "(" * 50 + "x = '" + "b" * 100) == []


# --- 8 exact


@pytest.mark.parametrize("bits", [None, 64])
def test_exact_groups(docs, rows, bits):
    by_text = {}
    for d, t, *_ in rows:
        by_text.setdefault(t or "", []).append(d)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(docs, bits=bits).collect()}
    assert got == {d: (max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in by_text.items() for d in g}
    kept = exact.exact_dedup(docs, bits=bits)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(map(max, by_text.values()))


def test_exact_repeated_rows_and_null_ids(spark, empty):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c")], "doc_id long, text string")
    got = exact.exact_groups(df).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 3
    assert exact.exact_dedup(df).count() == 3
    assert exact.exact_groups(empty).count() == exact.exact_dedup(empty).count() == 0


# --- 9 passages


def test_passages_find_planted_and_fuzzy_repeats(spark, empty):
    rng = random.Random(8)
    passage, line = prose(rng, 70).split(), prose(rng, 12)
    fuzzy = list(passage)
    fuzzy[30] = "changed"
    fuzzy.insert(50, "inserted")
    texts = [prose(rng, 100) for _ in range(12)]
    for i in range(8):
        middle = passage if i % 2 else fuzzy
        texts.append(f"{prose(rng, rng.randint(0, 80))} {' '.join(middle)} {prose(rng, rng.randint(0, 80))}")
    texts += [f"{prose(rng, 40)} {line} {prose(rng, 40)}" for _ in range(5)] + [None, "", "for " * 90, "for " * 120 + "end", passage[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = passages.repeated_passages(df).toPandas()
    found = set(got.doc_id) | set(got.partner_id)
    assert found == set(range(12, 20)) | {27, 28}
    words = [(t or "").lower().split() for t in texts]
    for r in got.itertuples():
        assert r.n_words >= 50 and r.similarity >= 0.8 and r.doc_id != r.partner_id
        if r.doc_id < 20:
            own = words[r.doc_id][r.start_word : r.start_word + r.n_words]
            assert len(set(own) & set(passage)) >= 0.9 * len(set(passage))
    assert passages.repeated_passages(empty).count() == 0


def test_passages_with_many_edits_are_found(spark):
    rng = random.Random(25)
    rows = []
    for i in range(200):
        passage = distinct_words(rng, 80)
        for copy in (passage, edited(passage, set(rng.sample(range(80), 12)))):
            rows.append((len(rows), " ".join(distinct_words(rng, rng.randint(5, 60)) + copy + distinct_words(rng, rng.randint(5, 60)))))
    got = {(r.partner_id, r.doc_id) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= {(i, i + 1) for i in range(0, 400, 2)} and len(got) >= 0.95 * 200


def test_passages_whose_parts_come_first_elsewhere_are_found(spark):
    rng = random.Random(26)
    rows, want = [], set()
    for i in range(40):
        passage = distinct_words(rng, 90)
        first = len(rows)
        for third in (passage[:30], passage[30:60], passage[60:]):
            rows.append((len(rows), " ".join(distinct_words(rng, 40) + third + distinct_words(rng, 40))))
        # equal copies, or the second with an edit of its own in each third
        other = edited(passage, {12, 44, 77}) if i % 2 else passage
        for copy in (passage, other):
            rows.append((len(rows), " ".join(distinct_words(rng, 20) + copy + distinct_words(rng, 20))))
        want.add((first + 3, first + 4))
    got = {(r.partner_id, r.doc_id) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_copies_of_edited_copies_meet(spark):
    rng = random.Random(27)
    rows, want = [], set()
    for _ in range(40):
        a = distinct_words(rng, 100)
        b = edited(a, set(range(4, 100, 9)))
        c = [f"more{i}" if i % 13 == 6 else w for i, w in enumerate(b)]
        want.add((len(rows) + 1, len(rows) + 2))
        rows += [(len(rows) + i, " ".join(distinct_words(rng, 30) + t + distinct_words(rng, 30))) for i, t in enumerate((a, b, c))]
    got = {(r.partner_id, r.doc_id) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want - got) <= 1


@pytest.mark.parametrize("parts", [(passages.LEAST_ROWS, passages.CHUNK), (1, 7)])
def test_links_reach_every_occurrence(monkeypatch, parts):
    rng = random.Random(28)
    monkeypatch.setattr(passages, "LEAST_ROWS", parts[0])
    monkeypatch.setattr(passages, "CHUNK", parts[1])
    rows = sorted((rng.randrange(6), rng.randrange(4) << 54 | rng.randrange(2) << 43 | rng.randrange(50), rng.randrange(40)) for _ in range(400))
    whole = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["h", "at", "doc"])
    none = (np.empty(0, np.int64),) * 3
    for size in (5, 64, 400):
        got = [r for b in passages._links((whole.slice(lo, size) for lo in range(0, 400, size)), none) for r in b.to_pylist()]
        for h in range(6):
            own = [r for r in rows if r[0] == h]
            parent = {d: d for *_, d in own}

            def find(x, parent=parent):
                while parent[x] != x:
                    x = parent[x]
                return x

            held = {(d, at & 0xFFFFFFFF) for _, at, d in own}
            for r in got:
                assert r["doc"] > r["partner"]
                if (r["doc"], r["pos"]) in held and (r["partner"], r["rpos"]) in held:
                    parent[find(r["doc"])] = find(r["partner"])
            assert len({find(d) for d in parent}) == 1
        assert len(got) <= 3 * len(rows) + 100


def test_seeds_of_equal_words_are_equal_and_dense():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 16, 200).astype(np.uint16)
    a = np.concatenate((rng.integers(0, 1 << 16, 37).astype(np.uint16), shared, rng.integers(0, 1 << 16, 50).astype(np.uint16)))
    places, hashes, contexts = passages.seeds(a)
    alone = passages.seeds(shared)
    inside = (places >= 37) & (places < 37 + 160)
    assert np.diff(places).max() <= passages.K - 1 and len(places) < 0.55 * len(a)
    assert [(p - 37, h, c) for p, h, c in zip(places[inside], hashes[inside], contexts[inside], strict=True)] == [x for x in zip(*alone, strict=True) if x[0] < 160]


def test_frequent_seeds_are_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(passages, "SAMPLE", 50)
    rng = random.Random(29)
    line = distinct_words(rng, 60)
    rows = [(i, " ".join(distinct_words(rng, 10) + line)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes, first, _ = passages.frequent_seeds(passages.sketches(df))
    assert len(hashes) > 10 and len(set(first)) == 1
    got = passages.repeated_passages(df).where(F.col("partner_id").eqNullSafe(F.lit(int(first[0]))) | F.col("doc_id").eqNullSafe(F.lit(int(first[0])))).collect()
    assert {r.doc_id for r in got} | {r.partner_id for r in got} == set(range(150))


@pytest.mark.parametrize("width", [12, 30])
def test_passages_of_frequent_seeds_are_found(spark, width):
    """All seeds of a passage, and with wider slices their short contexts, are in many documents; the whole is in two."""
    rng = random.Random(30)
    shared = [distinct_words(rng, 60) for _ in range(8)]
    rows = []
    for i in range(300):
        starts = [rng.randrange(5 - width, 56) for _ in shared]
        slices = [distinct_words(rng, 20) + p[max(0, s) : s + width] for p, s in zip(shared, starts, strict=True)]
        rows.append((i, " ".join(w for part in slices for w in part)))
    want = set()
    for p in shared:
        want.add((len(rows), len(rows) + 1))
        rows += [(len(rows) + i, " ".join(distinct_words(rng, 30) + p + distinct_words(rng, 30))) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    places, hashes, contexts = passages.seeds(np.asarray(passages.word_codes(" ".join(shared[0])) & np.uint32(0xFFFF), np.uint16))
    keys = passages.frequent_seeds(passages.sketches(df))[0]
    levels = [passages._known(k, keys)[0] for k in passages._levels(hashes, contexts)]
    assert levels[0].all() and levels[2].any() == (width == 30)
    got = {(r.partner_id, r.doc_id) for r in passages.repeated_passages(df).collect()}
    assert got == want


def test_counts_of_keys_in_documents():
    rng = np.random.default_rng(32)
    for n in (0, 1, 500):
        keys, docs, places = (rng.integers(0, m, n) for m in (9, 7, 50))
        got = passages._counted(keys, docs, places).to_pylist()
        held = sorted(zip(keys.tolist(), docs.tolist(), places.tolist(), strict=True))
        want = [{"h": k, "n": len({d for h, d, _ in held if h == k}), **dict(zip(("doc", "pos"), min(r[1:] for r in held if r[0] == k), strict=True))} for k in sorted({k for k, *_ in held})]
        assert got == want


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_dealt_seeds_keep_common_contexts_together(most):
    """Of frequent seeds those occurrences stay in one place that have the shortest context in common that is rare."""
    rng = np.random.default_rng(31)
    hashes, contexts, docs = np.full(2000, 77, np.int64), rng.integers(0, 1 << 32, 2000).astype(np.uint32), np.arange(2000)
    contexts = contexts.repeat(2)[:2000]
    frequent = np.unique(np.concatenate(passages._levels(hashes, contexts)[: most + 1]))
    dealt = passages._dealt(hashes, contexts, docs, frequent)
    assert len(set(dealt.tolist())) == 1 << passages.SALT_BITS and (dealt & passages._LOW == 77).all()
    assert (dealt[::2] == dealt[1::2]).all() == (most < 3)


def test_chain_matches_a_quadratic_version():
    rng = random.Random(12)
    for _ in range(50):
        places = sorted({(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(25)})
        best = []
        for p, r in places:
            before = [s - passages.GAP * (p - q + r - t) for (q, t), s in zip(places, best, strict=False) if q < p and t < r]
            best.append(passages.ANCHOR + max(0, max(before, default=0)))
        chain = passages.chains(places, least=0)[0]
        score = passages.ANCHOR * len(chain) - passages.GAP * sum(b[0] - a[0] + b[1] - a[1] for a, b in zip(chain, chain[1:], strict=False))
        assert abs(score - max(best)) < 1e-9


def test_alignment():
    words = np.arange(100, dtype=np.uint16)
    other = np.concatenate((np.arange(500, 520), words[10:40], [999], words[41:90])).astype(np.uint16)
    start, n, ostart, on, similarity = passages.align([(15, 25), (60, 70)], words, 0, other, 0)
    assert (start, n, ostart, on) == (10, 80, 20, 80) and similarity == pytest.approx(79 / 80)


# --- 10 quality


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.2
    hit = np.asarray([0.9, 0.7, 0.6])
    votes = np.where(truth[:, None], np.where(rng.random((20_000, 3)) < hit, 1, -1), np.where(rng.random((20_000, 3)) < 0.003, 1, -1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert abs(model.prior - 0.2) < 0.03 and np.abs(model.rates[1, :, 2] - hit).max() < 0.06


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows, model = quality.prepared(docs, train, sample=500)
    got = quality.scored(rows, model).join(test, "doc_id").toPandas()
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    assert clean.kept.mean() >= 0.99 and (~got[got.quality == 0].kept).mean() >= 0.95
    assert (~got[(got.toxic == 1)].kept).mean() >= 0.5


def test_classifier_edge_cases(spark, docs, rows, empty):
    stored, model = quality.prepared(docs, sample=50)
    got = quality.scored(stored, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert sorted(got) == sorted(quality.score(docs, model).collect())
    kept = quality.keep_good(stored, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert not {r.doc_id: r for r in got}[[d for d, t, *_ in rows if not t][0]].kept
    stored, model = quality.prepared(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert model is None and quality.scored(stored, model).count() == quality.keep_good(stored, model).count() == quality.score(empty, None).count() == 0


def test_repeated_rows_null_ids_and_labels(spark):
    rows = [(1, "one two three"), (1, "one two three"), (None, "x y"), (None, None), (2, "you moron and scum"), (3, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 1), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(*quality.prepared(df, labels)).collect()
    assert len(got) == 6 and len({tuple(r) for r in got if r.doc_id == 1}) == 1


def test_known_classes_give_the_rates_of_imprecise_labellers():
    """The false-bad rates are estimated, not set: 10 % and 2 % here."""
    rng = np.random.default_rng(1)
    truth = rng.random(40_000) < 0.2
    hit, wrong = np.asarray([0.9, 0.8, 0.7]), np.asarray([0.1, 0.02, 0.05])
    cast = np.where(rng.random((40_000, 3)) < np.where(truth[:, None], hit, wrong), 1, -1)
    known = np.where(rng.random(40_000) < 0.1, truth, -1)
    rows, counts = np.unique(np.column_stack((cast, known)), axis=0, return_counts=True)
    model = quality.fit_labels(rows[:, :3], counts.astype(float), rows[:, 3])
    assert abs(model.prior - 0.2) < 0.03 and np.abs(model.rates[1, :, 2] - hit).max() < 0.05 and np.abs(model.rates[0, :, 2] - wrong).max() < 0.02


def test_long_texts_vote_as_their_exact_ratios_say():
    rng = random.Random(30)
    for _ in range(20):
        text = " ".join(rng.choice((w, w.upper())) for w in prose(rng, 4000).split())
        letters = sum(map(str.isalpha, text))
        ratio = sum(map(str.isupper, text)) / letters
        assert quality.votes(text)[0][2] == (1 if ratio > 0.5 else -1 if ratio < 0.2 else 0)


def test_upper_case_is_counted_over_the_whole_text():
    rng = random.Random(10)
    record = "R" + "".join(rng.choice("abcdefgh ") for _ in range(98)) + "\n"
    assert quality.votes(record * 5000)[0][2] == -1
    for text in ("", "aBC", "ÄÖü Ω ß", prose(rng, 300) + "É" * 40 + "ABC" * 7):
        assert quality.upper_letters(text) == sum(map(str.isupper, text))

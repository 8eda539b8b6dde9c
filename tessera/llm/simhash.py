"""SimHash near-duplicates through an inverted index on byte positions with count filtering.

Exact search (``near_groups``): two 64-bit fingerprints that differ in at most three bits share at least five of
their eight positional bytes. The index posts a fingerprint under sets of positional bytes chosen so that any five
shared positions contain one set: the eight triples inside the two halves, and for crowded postings the 56 sets of
five. Within a posting the shared positional bytes of a pair are tallied, pairs that reach the guaranteed minimum are
verified by their differing bits, and only a spanning forest of the verified links leaves the task - never all pairs.
Postings of single bytes alone would hold one fingerprint in 256 each, so pairs would grow with the square of the
corpus; the sets give the same candidates that can reach the minimum, with 2^24 or 2^40 keys.

Crowded postings (over CROWDED distinct fingerprints) are posted again under sets of five; such a posting holds at
most 2^24 distinct fingerprints, since its other three bytes are free, so a task's memory is bounded by 128 MB, and
its neighbours are looked up by flipping at most three of the 24 free bits: time in proportion to its members.

Defined cases: null counts as empty; a text without words has fingerprint zero and is linked like any other; fewer
words than a shingle make one shingle. Equal fingerprints are always one component. Repeated rows stay as they are,
null ids too; a component of null ids only has a null id. An empty table gives an empty result. Similar texts take
integer ids; rows without one are kept and have no similar text.

Similar texts (``similar_groups``, for the pipeline): the same index links the fingerprints of the sets of distinct
shingles, its links are verified on the sets, and components are taken. At a Jaccard similarity of 0.8 about 15 % of a
SimHash's bits differ, so no number of shared bytes is guaranteed for all similar pairs. An exact join of the sets
therefore follows, for the pairs that the index can't reach: postings of the prefixes of a common order, rare shingles
first; sizes, places in the order and parity marks rule out only pairs that are provably below; what is left is verified
on the sets, too, and the components of all links are taken at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, maybe_in, small_batches, table, text_map, without, written

MAX_BITS = 3
#: Any five of eight positions hold three in one half: the guarantee 8 - 3 = 5.
TRIPLES = [c for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]
FIVES = list(combinations(range(8), 5))
CROWDED = 4096
_SPAN = 1 << 14


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; A-Z lower-cased, white space is ASCII."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(ws))
    if len(ws) <= words:
        return np.asarray([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(ws) - words + 1
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> bytes:
    """Big-endian bits, 64: one where over half the hashes have one. No hashes: zero."""
    n, total = len(hashes), np.zeros(64, np.int64)
    for lo in range(0, n, _SPAN):
        h = np.ascontiguousarray(hashes[lo : lo + _SPAN].astype(">u8"))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(total * 2 > n).tobytes()


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): 64-bit fingerprints as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = b"".join(fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column(1))
            values = np.frombuffer(fps, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text_map(docs.select(id_col, text_col), run, f"{id_col} {kind}, fp long")


def _byte(at: int) -> Column:
    return F.shiftright("fp", 56 - 8 * at).bitwiseAND(F.lit(255))


def _key(positions: tuple[int, ...]) -> Column:
    key = F.lit(0).cast("long")
    for at in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(at))
    return key


def postings(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(key, fp): a posting for each set of positions; the set's number leads the key."""
    width = 8 * len(sets[0])
    keys = [_key(s).bitwiseOR(F.lit(i << width)) for i, s in enumerate(sets)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _flips(bits: list[int], most: int) -> np.ndarray:
    masks = [sum(1 << b for b in c) for k in range(1, most + 1) for c in combinations(bits, k)]
    return np.asarray(masks, np.uint64)


def forest(fps: np.ndarray, most: int = MAX_BITS, guaranteed: int = 8 - MAX_BITS, free: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest over sorted distinct fingerprints at most ``most`` bits apart.

    Breadth first: each fingerprint meets those not reached yet. Every pair is tallied by its shared positional bytes,
    and those that reach the guaranteed number are verified by their bits. Where there are more fingerprints than
    ``free`` flips, only the flips that are there are tallied, so the time is in proportion to the fingerprints.
    """
    every, out = fps.astype(np.uint64), []
    flips = free if free is not None and len(every) > len(free) else None
    left = np.ones(len(every), bool) if flips is not None else np.arange(len(every))

    def met(at: int) -> np.ndarray:
        """Which of those left are linked to one; they are left no more."""
        nonlocal left
        if flips is not None:
            want = every[at] ^ flips
            there = np.minimum(np.searchsorted(every, want), len(every) - 1)
            there = there[(every[there] == want) & left[there]]
        else:
            there = left
        differ = every[there] ^ every[at]
        tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        near = tally >= guaranteed
        near[near] = np.bitwise_count(differ[near]) <= most
        if flips is not None:
            left[there[near]] = False
        else:
            left = there[~near]
        return there[near]

    for root in range(len(every)):
        if flips is not None:
            if not left[root]:
                continue
            left[root] = False
        else:
            if not len(left):
                break
            root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            near = met(queue.pop())
            out += [(int(every[x]), int(every[root])) for x in near]
            queue += near.tolist()
    return out


def _linked(batches: Iterator[pa.RecordBatch], sets: list[tuple[int, ...]]) -> Iterator[pa.RecordBatch]:
    """Links within each posting of rows sorted by (key, fp); holds one posting at a time."""
    width = 8 * len(sets[0])

    def flush(key: int, parts: list[np.ndarray]) -> list[tuple[int, int]]:
        fps = parts[0] if len(parts) == 1 else np.concatenate(parts)
        if len(fps) < 2:
            return []
        fps = np.unique(fps)
        free = None
        if len(fps) > CROWDED and len(sets[0]) == 5:
            taken = set(sets[key >> width])
            free = _flips([8 * (7 - p) + b for p in range(8) if p not in taken for b in range(8)], MAX_BITS)
        return forest(fps, free=free)

    key, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        fps = batch.column(1).to_numpy().view(np.uint64)
        if not len(keys):
            continue
        cuts = np.flatnonzero(np.diff(keys)) + 1
        edges = [0, *cuts.tolist(), len(keys)]
        links: list[tuple[int, int]] = []
        for a, b in zip(edges, edges[1:], strict=False):
            if keys[a] != key:
                if held:
                    links += flush(int(key), held)
                key, held = keys[a], []
            held.append(fps[a:b])
        if links:
            yield _pairs(links)
    if held and (links := flush(int(key), held)):
        yield _pairs(links)


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.asarray(links, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b): a spanning forest of every posting's verified links; fps holds distinct fingerprints."""
    first = written(postings(fps, TRIPLES), "postings")
    sizes = first.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(first.join(sizes, "key").select("key", "fp", "n"), "shared")

    def within(rows: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
        laid = rows.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
        return text_map(laid, lambda batches: _linked(batches, sets), "a long, b long")

    small = within(shared.where(F.col("n") <= crowded), TRIPLES)
    dense = shared.where(F.col("n") > crowded).select("fp").distinct()
    return small.unionByName(within(postings(dense, FIVES), FIVES))


def near_groups(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for each row; component_id is the smallest id reachable."""
    rows = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct")
    roots = written(components(links(distinct.select("fp"), crowded)), "roots").withColumnRenamed("v", "fp")
    labelled = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    class_of = labelled.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return rows.join(class_of, "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


#: For similar texts: words of a shingle, and the least Jaccard similarity of the sets of shingles.
SIMILAR_WORDS = 5
SIMILARITY = 0.8
#: Documents, about, that tell which shingles are frequent, and the most that are told apart. Both only choose the
#: order of the shingles; under any order the same pairs are found.
ORDER_SAMPLE = 10_000
MOST_FREQUENT = 500_000
#: Least and most bits of a mark, and rows of a posting that meet in one task.
MARK_BITS = (512, 4096)
BLOCK = 1024
#: Pairs that a task looks at together.
_PAIRS_AT_ONCE = 1 << 16


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def frequent_shingles(source: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, times) of the shingles that several documents of a sample hold; source is (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), words).view(np.int64))], ["h"])

    every = max(1, source.count() // ORDER_SAMPLE)
    some = source.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("text")
    times = text_map(some, run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    with small_batches(source.sparkSession):
        found = times.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    hashes = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.column("n").to_numpy()[order]


def prefix(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles in an order that all texts share, rare ones first: similar sets have one of them in common.

    A set without members has a place of its own, under zero.
    """
    n = len(shingles)
    if not n:
        return np.zeros(1, np.uint64)
    hashes, times = frequent
    often = np.zeros(n, np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
        often = np.where(hashes[at] == shingles, times[at], 0)
    return shingles[np.lexsort((shingles, often))][: n - math.ceil(similarity * n - 1e-9) + 1]


def mark(shingles: np.ndarray) -> bytes:
    """Parities of the members by hash: two marks differ in no more bits than the sets have members apart.

    The number of bits follows the size of the set; halves laid on each other are the mark of half the bits.
    """
    bits = MARK_BITS[0]
    while bits < min(len(shingles), MARK_BITS[1]):
        bits *= 2
    parity = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(bool)).tobytes()


def apart(marks_a: np.ndarray, marks_b: np.ndarray) -> np.ndarray:
    """Bits in which marks differ, place by place, each pair at the size of its smaller one; arrays of bytes objects."""
    out = np.zeros(len(marks_a), np.int64)
    size_a, size_b = (np.fromiter(map(len, m), np.int64, len(m)) for m in (marks_a, marks_b))
    for a in np.unique(size_a):
        for b in np.unique(size_b[size_a == a]):
            at = np.flatnonzero((size_a == a) & (size_b == b))
            x, y = (np.frombuffer(b"".join(m[at]), np.uint64).reshape(len(at), -1) for m in (marks_a, marks_b))
            out[at] = np.bitwise_count(folded(x, min(a, b) // 8) ^ folded(y, min(a, b) // 8)).sum(1, dtype=np.int64)
    return out


def folded(marks: np.ndarray, width: int) -> np.ndarray:
    """Marks (rows of 64-bit words) at the smaller size of ``width`` words."""
    while marks.shape[1] > width:
        half = marks.shape[1] // 2
        marks = marks[:, :half] ^ marks[:, half:]
    return marks


def most_apart(n: np.ndarray, similarity: float) -> np.ndarray:
    """Members that sets of n members together may have apart at the similarity."""
    return n * (1 - 2 * similarity / (1 + similarity)) + 1e-6


def prefixes(source: DataFrame, similarity: float, words: int) -> DataFrame:
    """(id, n, fp, mark, keys): the number of distinct shingles, their fingerprint, mark and prefix; source is (id, text)."""
    frequent = frequent_shingles(source, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sets = [shingle_set(t.as_py(), words) for t in part.column(1)]
                keys = [prefix(s, frequent, similarity) for s in sets]
                cuts = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32))
                keyed = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(keys).view(np.int64)))
                fps = np.frombuffer(b"".join(map(fingerprint, sets)), ">i8").astype(np.int64)
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(fps), pa.array([mark(s) for s in sets], pa.binary()), keyed]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "fp", "mark", "keys"])

    return text_map(source, run, "id long, n int, fp long, mark binary, keys array<long>")


def indexed_pairs(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b), a < b: each id with the first of its fingerprint, and the firsts of fingerprints that the index's forests
    link; prints is (id, fp). The pairs connect exactly what chains of near fingerprints connect."""
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    same = prints.join(distinct, "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    of = lambda side: distinct.select(F.col("fp").alias(side), F.col("first").alias(f"_{side}"))
    linked = links(distinct.select("fp"), crowded).distinct().join(of("a"), "a").join(of("b"), "b")
    return same.unionByName(linked.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))


def _postings(batches: Iterator[pa.RecordBatch], by: tuple[str, ...] = ("key",)) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole postings, of rows sorted by the columns ``by``."""
    held: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        last = np.all([now[c] == now[c][-1] for c in by], axis=0)
        cut = len(last) - int(last.sum())  # the last posting may go on
        if held and (cut or any(held[c][0][0] != now[c][0] for c in by)):
            yield {name: np.concatenate([*held[name], now[name][:cut]]) for name in now}
            held = {}
        elif cut:
            yield {name: now[name][:cut] for name in now}
        for name in now:
            held.setdefault(name, []).append(now[name][cut:])
    if held:
        yield {name: np.concatenate(parts) for name, parts in held.items()}


def _edges(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each row's posting, and the row behind its last."""
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    return np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)


def _possible(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sizes and the places in the order leave the pairs of rows a, b possible.

    In the posting of a pair's first common shingle, all its common shingles stand at that place or behind it.
    """
    n, rest = rows["n"].astype(np.int64), rows["n"].astype(np.int64) - rows["pos"]
    return np.minimum(rest[a], rest[b]) >= similarity / (1 + similarity) * (n[a] + n[b]) - 1e-6


def _starred(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, pos, id), without the postings of one row: each with the first of its posting, where possible.

    The first has the fewest rarer shingles, so in a family of copies it is one with few edits and mostly the same in
    all postings: the pairs find most families. They don't find all links.
    """
    for rows in _postings(batches):
        start, end = _edges(rows["key"])
        keep = end - start > 1
        if keep.any():
            at = np.arange(len(start))
            first = _possible(rows, start, at, similarity) & (rows["id"][start] != rows["id"])
            columns = [pa.array(rows[c][keep]) for c in ("key", "id", "n", "pos")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows["id"][start][keep], mask=~first[keep])], ["key", "id", "n", "pos", "first"])


def _open(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, of postings with several roots; a posting of over ``block`` rows is cut into blocks.

    A row of block i goes to the meetings (i, j) of its block with all blocks, itself too: meetings are numbered, and
    side tells i from j, 0 where a block meets itself. No task gets more than two blocks of one posting at a time.
    """
    names = ["key", "meeting", "side", "id", "n", "pos", "root"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    for rows in _postings(batches):
        start, end = _edges(rows["key"])
        sizes = end - start
        starts = np.flatnonzero(start == np.arange(len(start)))
        low, high = np.minimum.reduceat(rows["root"], starts), np.maximum.reduceat(rows["root"], starts)
        several = np.repeat(low != high, sizes[starts])
        small = np.flatnonzero(several & (sizes <= block))
        if len(small):
            zeros = np.zeros(len(small), np.int64)
            columns = [rows["key"][small], zeros, zeros.astype(np.int32), *(rows[c][small] for c in ("id", "n", "pos", "root"))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        for first in np.flatnonzero(several & (sizes > block) & (start == np.arange(len(start)))):
            blocks = int(-(-sizes[first] // block))
            for i in range(blocks):
                own = np.arange(first + i * block, min(end[first], first + (i + 1) * block))
                for j in range(blocks):
                    meeting = min(i, j) * blocks + max(i, j)
                    columns = [rows["key"][own], np.full(len(own), meeting), np.full(len(own), int(i > j) + (i != j), np.int32), *(rows[c][own] for c in ("id", "n", "pos", "root"))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _crossing(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, meeting, side, root): every pair of a meeting whose roots differ, but those ruled out by
    size, place or mark."""
    for rows in _postings(batches, ("key", "meeting")):
        change = lambda *names: np.concatenate(([True], np.any([rows[c][1:] != rows[c][:-1] for c in names], axis=0)))
        at = np.arange(len(rows["key"]))
        ends = lambda new: np.append(np.flatnonzero(new), len(at))[np.cumsum(new)]
        end, other = ends(change("key", "meeting")), ends(change("key", "meeting", "side", "root"))
        two = rows["side"] == 1
        other[two] = ends(change("key", "meeting", "side"))[two]
        other[rows["side"] == 2] = len(at)
        n, short = rows["n"].astype(np.int64), MARK_BITS[0] // 64
        marks = np.stack([folded(np.frombuffer(m, np.uint64)[None, :], short)[0] for m in rows["mark"]])
        live = other < end
        at, other = at[live], other[live]
        while len(at):
            for lo in range(0, len(at), _PAIRS_AT_ONCE):
                x, y = at[lo : lo + _PAIRS_AT_ONCE], other[lo : lo + _PAIRS_AT_ONCE]
                keep = (rows["root"][x] != rows["root"][y]) & _possible(rows, x, y, similarity)
                x, y = x[keep], y[keep]
                keep = np.bitwise_count(marks[x] ^ marks[y]).sum(1, dtype=np.int64) <= most_apart(n[x] + n[y], similarity)
                x, y = x[keep], y[keep]
                keep = apart(rows["mark"][x], rows["mark"][y]) <= most_apart(n[x] + n[y], similarity)
                if keep.any():
                    x, y = rows["id"][x[keep]], rows["id"][y[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
            other = other + 1
            live = other < end[at]
            at, other = at[live], other[live]


def similar_pairs(source: DataFrame, marks: DataFrame, pairs: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have at least the Jaccard similarity."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
                differ = apart(*(batch.column(i).to_numpy(zero_copy_only=False) for i in ("ma", "mb")))
                yield batch.select(["a", "b"]).filter(pa.array(differ <= most_apart(n, similarity)))

    of = lambda side: marks.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("mark").alias(f"m{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    likely = written(text_map(both, near, "a long, b long"), "likely")
    wanted = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
    there = maybe_in(source, "id", wanted, "id", "_maybe").where("_maybe").select("id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                packed = [shingle_set(t.as_py(), words).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["id", "shingles"])

    held = written(text_map(there, sets, "id long, shingles binary"), "shingles")
    full = likely.join(held.withColumnsRenamed({"id": "a", "shingles": "sa"}), "a").join(held.withColumnsRenamed({"id": "b", "shingles": "sb"}), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return text_map(full.select("a", "b", "sa", "sb"), verify, "a long, b long")


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, words: int = SIMILAR_WORDS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(v, root) for every id with a similar one: exactly the components of all similar pairs.

    Two rounds. The first verifies the links of the fingerprints' index, and those of each posting's first, which link
    most members of large families. The second is exact: it compares every pair of a posting that the first has not
    already connected, so no member leaves before all its links are known. It sees only postings with several roots
    left, large ones in blocks, and marks go with their rows.
    """
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marks = written(prefixes(source, similarity, words), "prefixes")
    posted = marks.select("id", "n", F.posexplode("keys").alias("pos", "key")).select("key", "id", "n", "pos")
    schema = "key long, id long, n int, pos int, first long"
    laid = posted.repartition("key").sortWithinPartitions("key", "pos", "id")
    shared = written(text_map(laid, lambda batches: _starred(batches, similarity), schema), "shared")
    stars = shared.where("first IS NOT NULL").select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b"))
    stars = written(indexed_pairs(marks.select("id", "fp")).unionByName(stars).distinct(), "pairs")
    first = written(similar_pairs(source, marks, stars, similarity, words), "links")
    roots = written(components(first), "groups").withColumnRenamed("v", "id")
    rooted = shared.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).select("key", "id", "n", "pos", "root")
    schema = "key long, meeting long, side int, id long, n int, pos int, root long"
    left = written(text_map(rooted.repartition("key").sortWithinPartitions("key"), lambda batches: _open(batches, block), schema), "open")
    marked = left.join(marks.select("id", "mark"), "id").repartition("key", "meeting").sortWithinPartitions("key", "meeting", "side", "root")
    crossing = text_map(marked.select(*left.columns, "mark"), lambda batches: _crossing(batches, similarity), "a long, b long").distinct()
    pairs = written(crossing.join(stars, ["a", "b"], "left_anti"), "pairs")
    second = written(similar_pairs(source, marks, pairs, similarity, words), "links")
    return components(first.union(second))


def keep_dissimilar(docs: DataFrame, similarity: float = SIMILARITY, words: int = SIMILAR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the smallest id of each group of similar texts; rows without a similar one do not shuffle."""
    roots = written(similar_groups(docs, similarity, words, id_col, text_col), "groups")
    stay = roots.groupBy("root").agg(F.min("v").alias("stay"))
    gone = written(roots.join(stay, "root").where("v <> stay").select("v"), "gone")
    return without(docs, id_col, gone, "v")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))

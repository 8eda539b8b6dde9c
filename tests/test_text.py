"""Cleaning, quality, sentences and headings against small sequential versions written from their semantics."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.headings import is_heading
from tessera.operators import pages


def run(spark, column, values):
    df = spark.createDataFrame(list(enumerate(values)), "i long, v string")
    return [r.o for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def noise(rng, n, alphabet):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_dehyphenate_is_the_fixed_point(spark):
    rng = random.Random(1)
    values = [noise(rng, 30, "ab-\n­ é A1") for _ in range(500)] + ["a- b- c- d", "café- mit", "well- known", ""]
    want = []
    for v in values:
        while (new := re.sub(r"(\w)[-­]\s+([a-z])", r"\1\2", v)) != v:
            v = new
        want.append(v)
    assert run(spark, T.dehyphenate, values) == want


def test_join_lines_decides_on_neighbours(spark):
    rng = random.Random(2)
    values = [noise(rng, 25, "aB1.:\n É,") for _ in range(500)] + ["  one line  ", "\n\na", "end.\nnext", "end.\nÉa", "x;\n1"]

    def fold(v):
        if "\n" not in v:
            return v
        lines = [x.strip() for x in v.split("\n")]
        out = lines[0]
        for a, b in zip(lines, lines[1:], strict=False):
            keep = not a or not b or (a[-1] in ".!?:;" and (b[0].isupper() or b[0].isdigit()))
            out += ("\n" if keep else " ") + b
        return out

    assert run(spark, T.join_lines, values) == [fold(v) for v in values]


def test_squeeze_and_clean(spark):
    assert run(spark, T.squeeze, ["a  \t b \n\n\n\n c\x07 "]) == ["a b\n\n c"]
    assert run(spark, T.clean, ["[page 3]\nlong wor-\nds wrap\nhere.\nNext\fline"]) == ["long words wrap here.\nNext line"]


def test_sentences_against_split_and_glue(spark):
    rng = random.Random(3)
    pool = ["Mr.", "Dr.", "etc.", "no.", "Ph.D.", "word", "End.", "Stop!", "Why?", '"Quote', "(In", "9th", "The", "x..", "Vol.."]
    values = [" ".join(rng.choice(pool) for _ in range(12)) for _ in range(300)] + ["", "One.\nTwo. three"]

    def glue(v):
        out = []
        for part in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])", re.sub(r"[ \t]{2,}", " ", v).strip()):
            if out and out[-1].split() and out[-1].split()[-1].lower().rstrip(".") in T.ABBREVIATIONS:
                out[-1] += " " + part
            else:
                out.append(part)
        return [p for p in out if p.strip()]

    assert run(spark, T.sentences, values) == [glue(v) for v in values]


@pytest.mark.parametrize("seed", range(2))
def test_token_estimate(spark, seed):
    rng = random.Random(seed)
    values = [noise(rng, rng.randint(0, 40), "ab \n ") for _ in range(200)]
    want = [0 if not v.strip() else max(1, int(min(len(v) / 4.0, len(v.split()) * 1.3))) for v in values]
    assert run(spark, T.token_estimate, values) == want


def test_search_tokens(spark):
    assert run(spark, T.search_tokens, ["The café's state-of-the-art I a O'Neil 42"]) == [["caf", "state-of-the-art", "o'neil", "42"]]


HEADINGS = {
    "WATER SUPPLY": True, "1. Taxation": True, "Chapter 4 Trade": True, "Rivers and the Sea": True, "Glossary": True, "Section 2.1 Scope": True, "IV. Harvest": True,
    "18 WATER SUPPLY notes": False, "3. Describe the harvest": False, "5. Who ruled there": False, "906 km wide": False, "Rates 12 and 14": False, "3. Ibid": False,
    "Is this it?": False, "The rain fell on the plain.": False, "a small line": False, "[Map] Rivers": False, "x" * 91: False, "": False, "ab 1": False, "Trade:": False, "It": False,
}


def test_headings(spark):
    assert dict(zip(HEADINGS, run(spark, is_heading, list(HEADINGS)), strict=True)) == HEADINGS


def test_split_pages(spark):
    raw = "\f[page 1]\nfirst\n\f\n\n\f[PAGE 3][page 4] third\flost"
    got = pages.split_pages(spark.createDataFrame([(1, raw), (2, None), (3, "plain")], "doc_id long, text string")).orderBy("doc_id", "page_pos").collect()
    assert [(r.doc_id, r.page_number, r.text) for r in got] == [(1, 1, "\nfirst"), (1, 3, " third"), (1, 0, "lost"), (3, 0, "plain")]


GOOD = "the rain and the wind were on the hill and the people of the town had a good day in the sun "


@pytest.mark.parametrize(
    ("text", "issues"),
    [
        ("x" * 49, ["no_text"]), ("", ["no_text"]), (None, ["no_text"]), (GOOD, []), ("zqx vbn " * 10, ["scrambled_text"]),
        (GOOD + "....,,,,;;;;::::" * 4, ["broken_encoding"]), (GOOD + " oxRord gLeam kiNdly" * 1, ["mixed_case_glyphs"]), (GOOD + "~^|", ["suspect_symbols"]),
        (GOOD * 5 + "ab-cd ef-gh ij-kl mn-op", ["surviving_hyphens"]), (GOOD * 3 + "x y z q w e r t", ["fragmented_glyphs"]), ("one ten six red " * 4, ["scrambled_text"]),
    ],
)
def test_quality(spark, text, issues):
    row = pages.assess(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [i.category for i in row.issues] == issues and row.is_usable == (not issues)


def test_summary_and_route(spark):
    df = spark.createDataFrame([(1, 0, GOOD), (1, 1, ""), (2, 0, "x"), (2, 1, "")], "doc_id long, page_pos int, text string")
    assessed = pages.assess(df)
    got = {r.doc_id: r for r in pages.document_summary(assessed).collect()}
    assert (got[1].pages, got[1].usable, got[1].coverage) == (2, 1, 0.5) and [(i.category, i.n) for i in got[2].issues] == [("no_text", 2)]
    usable, flagged = pages.route(assessed)
    assert (usable.count(), flagged.count()) == (1, 3)
    status = {r.doc_id: r.status for r in pages.document_status(assessed, usable.select("doc_id")).collect()}
    assert status == {1: "ready", 2: "failed"}

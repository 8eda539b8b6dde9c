"""Page quality signals as columns, and the verdict they make together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import strip

# fixed values
COMMON_WORDS = (
    "the of and to in a is that was for on as with by are at from this it be or an has have not but they his which she were we "
    "their there can all had been if more when will would who so no said about into than them some could time other these two may "
    "then do first any my now such like our over man me even most made after also did many before must through back years where "
    "much your way well down should because each just those people mr how too little state good very make world still own see men "
    "work long get here between both life being under never day same another know while last might us great old year off come since "
    "against go came right used take three"
).split()
SUSPECT = "~`^*|¦§¬±°·•"
MIXED_CASE = r"\b[a-z]*[A-Z][a-z]+[A-Z][a-z]*\b|\b[a-z]+[A-Z][a-z]{2,}\b"
MIN_CHARS, COMMON_FLOOR, ALNUM_FLOOR, USABLE_SCORE = 50, 0.22, 0.73, 0.45


def signals(text: Column) -> dict[str, Column]:
    """Counts and ratios of a page by name; ratios are null where the page has no characters or words."""
    page = strip(F.coalesce(text, F.lit("")))
    chars = F.length(page)
    words = F.regexp_extract_all(page, F.lit(r"[A-Za-z']+"), F.lit(0))
    n = F.size(words)
    common = F.size(F.filter(words, lambda w: F.lower(w).isin(COMMON_WORDS)))
    mixed = F.size(F.filter(F.regexp_extract_all(page, F.lit(f"(?U){MIXED_CASE}"), F.lit(0)), lambda w: F.length(w) > 4))
    return {
        "char_count": chars,
        "word_count": n,
        "common_ratio": F.when(n >= 10, F.try_divide(common.cast("double"), n)).otherwise(F.lit(0.5)),
        "alnum_ratio": F.try_divide(F.length(F.regexp_replace(page, "[^A-Za-z0-9]", "")).cast("double"), chars),
        "mixed_ratio": F.coalesce(F.try_divide(mixed.cast("double"), n), F.lit(0.0)),
        "suspect_ratio": F.try_divide((chars - F.length(F.translate(page, SUSPECT, ""))).cast("double"), chars),
        "hyphen_ratio": F.try_divide(F.regexp_count(page, F.lit(r"(?U)\b\w+-\w+\b")).cast("double"), chars),
        "single_ratio": F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: F.length(w) == 1)).cast("double"), n), F.lit(0.0)),
    }


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def rules() -> list[tuple[str, Column, Column, Column]]:
    """(category, fires, factor of the score, message) over the columns that signals() names."""
    s = F.col
    percent = lambda c: F.format_string("%.1f%%", c * 100)
    return [
        ("scrambled_text", s("common_ratio") < COMMON_FLOOR, _unit(s("common_ratio") / 0.35), F.concat(F.lit("common words: "), percent(s("common_ratio")))),
        ("broken_encoding", s("alnum_ratio") < ALNUM_FLOOR, _unit(s("alnum_ratio") / 0.80), F.concat(F.lit("letters and digits: "), percent(s("alnum_ratio")))),
        ("mixed_case_glyphs", (s("word_count") >= 10) & (s("mixed_ratio") > 0.04), F.greatest(F.lit(0.0), 1 - s("mixed_ratio") * 3), F.concat(F.lit("words of mixed case: "), percent(s("mixed_ratio")))),
        ("suspect_symbols", s("suspect_ratio") > 0.01, F.greatest(F.lit(0.0), 1 - s("suspect_ratio") * 20), F.concat(F.lit("suspect symbols: "), percent(s("suspect_ratio")))),
        ("surviving_hyphens", (s("char_count") > 400) & (s("hyphen_ratio") > 0.004), F.greatest(F.lit(0.0), 1 - s("hyphen_ratio") * 40), F.concat(F.lit("hyphens in words: "), percent(s("hyphen_ratio")))),
        ("fragmented_glyphs", (s("word_count") >= 40) & (s("single_ratio") > 0.12), F.greatest(F.lit(0.0), 1 - s("single_ratio") * 2), F.concat(F.lit("single letters: "), percent(s("single_ratio")))),
    ]


def issues() -> Column:
    """Array of (category, message); a page under the least length has the one issue no_text."""
    def record(category: str, message: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), message.alias("message"))

    few = record("no_text", F.concat(F.lit("characters: "), F.col("char_count").cast("string")))
    found = F.array(*[F.when(fires, record(name, message)) for name, fires, _, message in rules()])
    return F.when(F.col("char_count") < MIN_CHARS, F.array(few)).otherwise(F.array_compact(found))


def score() -> Column:
    """Product of the factors of the rules that fire, not rounded; 0 under the least length."""
    out = F.lit(1.0)
    for _, fires, factor, _ in rules():
        out = out * F.when(fires, factor).otherwise(F.lit(1.0))
    return F.when(F.col("char_count") < MIN_CHARS, F.lit(0.0)).otherwise(F.least(out, F.lit(1.0)))

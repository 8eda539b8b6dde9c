"""Text expressions: page markers, cleaning, token estimate, sentences, search tokens. Columns only, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_MARKER = r"(?i)\[page\s+(\d+)\]"
_KEEP = ""  # stands for a gap that must not split a sentence

# fixed values
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "prof", "st", "rev", "hon", "sgt", "capt", "vs", "etc", "no", "vol", "fig", "al", "inc", "ltd", "jr", "sr", "ph.d"]
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]
TOKEN = r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def page_marker(number: Column) -> Column:
    return F.concat(F.lit("[page "), number.cast("string"), F.lit("]"))


def page_number(block: Column) -> Column:
    """Number of the first marker; 0 where there is none."""
    return F.coalesce(F.regexp_extract(block, PAGE_MARKER, 1).try_cast("int"), F.lit(0))


def without_markers(c: Column) -> Column:
    return F.regexp_replace(c, PAGE_MARKER, "")


def dehyphenate(c: Column) -> Column:
    """Join words that a hyphen or soft hyphen and white space split before a small letter; one pass is the fixed point."""
    return F.regexp_replace(c, r"(?U)(?<=\w)[-\x{AD}]\s+(?=[a-z])", "")


def join_lines(c: Column) -> Column:
    """Unwrap lines: a break stays beside a blank line, or after . ! ? : ; before a capital or a digit."""
    trimmed = F.regexp_replace(c, r"(?Umd)^[\s&&[^\n]]+|[\s&&[^\n]]+$", "")
    soft = r"(?U)(?<=[^\n.!?:;])\n(?=[^\n])|(?<=[.!?:;])\n(?=[^\n\p{IsUppercase}\p{Nd}])"
    return F.when(F.contains(c, F.lit("\n")), F.regexp_replace(trimmed, soft, " ")).otherwise(c)


def squeeze(c: Column) -> Column:
    """No control characters, no trailing blanks, two line feeds and one blank in a row at most."""
    out = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(out, r"[ \t]{2,}", " "))


def clean(c: Column) -> Column:
    return squeeze(join_lines(dehyphenate(F.regexp_replace(without_markers(c), "\f", "\n"))))


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def token_estimate(c: Column) -> Column:
    """0 for blank text, else the smaller of length / 4 and words x 1.3, truncated, 1 at least."""
    guess = F.least(F.length(c) / F.lit(4.0), F.size(words(c)) * F.lit(1.3))
    return F.when(is_blank(c), F.lit(0)).otherwise(F.greatest(F.lit(1), guess.cast("int")))


def sentences(c: Column) -> Column:
    """Array of sentences. Gaps after an abbreviation are masked before the split, so nothing has to be glued back."""
    names = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    starts = r"""[A-Z0-9"'(]"""
    masked = F.regexp_replace(squeeze(c), rf"(?U)(?<![^\s])((?i:{names}))(\.+)\s+(?={starts})", rf"$1$2{_KEEP}")
    parts = F.split(masked, rf"(?U)(?<=[.!?])\s+(?={starts})")
    return F.filter(F.transform(parts, lambda p: strip(F.translate(p, _KEEP, " "))), lambda p: p != "")


def search_tokens(c: Column) -> Column:
    """Lower-cased ASCII tokens without stop words and single characters."""
    low = F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.lower)
    return F.filter(low, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))

"""Whether a line is a heading, as one boolean column."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import strip

# fixed values
MAX_CHARS = 90
UNITS = "sq km cm mm kg mg ml litre liter gallon mile miles ft feet inch inches acre acres hectare ha percent dozen century".split()
BRACKETS = r"[\[\]{}<>|*]"
NUMBER = r"(?<![\w.])\d[\d,.]*"
CITATION_END = r"\b(?:ibid|op\.?\s*cit|cit|ibid\.?|loc\.?\s*cit|p{1,2}\.\s*\d+|vol\.?|no\.?\s*\d+|chapter\s+\d+\s*,?\s*p)\.{0,2}$"
CITATION = r"\b(?:ibid|ibid\.|ibicl|op\.?\s*cit|loc\.?\s*cit|et\s+al)\b"
RUNNING_HEADER = r"^\d{1,4}\s+[A-Z][A-Z\s]{4,}\b"
NUMBERED = r"^(?:\d+(?:\.\d+)*\.?|[IVXLC]+\.|Chapter\s+\d+|Part\s+[IVXLC0-9]+|Section\s+\d+(?:\.\d+)*\.?)(?:\s+\S.*)?$"
UPPER = r"^[^a-z]*[A-Z][^a-z]*$"
VERBS = (
    "describe|explain|discuss|write|give|list|define|identify|outline|summari[sz]e|analy[sz]e|compare|contrast|elaborate|mention|state|"
    "what|why|how|when|where|who|which|do|does|did|is|are|was|were|can|should|would|could|will|may|might|must|ibicl|ibid|sak[a-z]*|"
    r"to\s+create|to\s+protect|to+\s*\w*"
)
VERB_FIRST = rf"^\s*(?:\d+(?:\.\d+)*\.?\s*)?(?:{VERBS})\b"
SMALL_WORDS = ["the", "a", "an", "of", "and", "in"]


def rejections(line: Column) -> list[Column]:
    """Reasons against a heading; any one is enough."""
    units = rf"(?iU)\b(?:{'|'.join(UNITS)}|per\s+cent)\b"
    return [
        (line == "") | (F.length(line) > MAX_CHARS),
        line.rlike(BRACKETS),
        line.rlike(units),
        F.regexp_count(line, F.lit(f"(?U){NUMBER}")) > 1,
        line.rlike(f"(?iU){CITATION_END}") | line.rlike(f"(?iU){CITATION}"),
        line.rlike(r"[?:,;.]$"),
        line.rlike(f"(?U){RUNNING_HEADER}"),
        F.length(F.array_join(F.regexp_extract_all(line, F.lit("[A-Za-z]{2,}"), F.lit(0)), "")) < 4,
    ]


def is_heading(raw: Column) -> Column:
    line = strip(F.coalesce(raw, F.lit("")))
    words = F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    content = F.filter(words, lambda w: ~F.lower(w).isin(SMALL_WORDS))
    capital = lambda w: w.rlike(r"^\p{Lu}")
    title = (F.size(content) >= 2) & F.forall(content, capital)
    only = F.element_at(content, 1)
    noun = (F.size(content) == 1) & only.rlike(r"^\p{Lu}\p{L}{2,}$") & only.rlike(r"\p{Ll}")
    shape = (
        F.when(line.rlike(UPPER) & (F.size(words) <= 10), F.lit(True))
        .when(line.rlike(f"(?U){NUMBERED}"), ~line.rlike(f"(?iU){VERB_FIRST}"))
        .otherwise(title | F.coalesce(noun, F.lit(False)))
    )
    return F.when(reduce(or_, rejections(line)), F.lit(False)).otherwise(shape)

"""Secret scan by assignment-aware lexing.

Three base patterns give the base spans. Beside them a lexer reads source and configuration syntax into pairs of a
name and what it is given: ``name = "literal"``, ``name: type = ...``, ``"name": 'literal'``, ``name => ...``,
``table["name"] = ...``, ``<name>literal</name>``, ``key="name" value="literal"``, ``name("literal")`` and
``call("name", "literal")``. What is given is a string (prefixes, escapes, triple quotes), a bare value, a
concatenation of parts, a list or tuple of them, or the arguments of a call. A name given to another name passes its
sensitivity on to the literals behind it (constants are propagated to a fixed point within the document), and each
literal is scored by how sensitive its target names are and how little it looks like prose or a placeholder; the parts
of a concatenation are scored as one. Literals that reach the threshold become spans of kind ``literal``, one for each
part. A bare value in the form of a name is a literal if it has a digit and nothing assigns that name.

Defined cases: null counts as empty. A document without a span has zero counts and empty strings. Offsets are code
points, end exclusive. Repeated rows are scanned each; ids are handed on as they are, null too. An empty table gives an
empty result. Names, blanks and literals may have any length. Work per document is linear in its length and its
assignments, but for lists inside lists, which are read once for each name that is given one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table, text_map

# fixed values: the contract's base patterns and least lengths
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20}

THRESHOLD = 0.5
#: A name, what may close around it, and an operator, before which a type may stand.
_ASSIGNED = re.compile(r"""([A-Za-z_][A-Za-z0-9_.\-]*+)["'\]]{0,2}[ \t]*+(?::[ \t]*+[A-Za-z_][A-Za-z0-9_.\[\]]*+[ \t]*+=(?![=>])|:=|=>|={1,3}|:)""")
_CALLED = re.compile(r"""([A-Za-z_][A-Za-z0-9_.]*+)\([ \t]*+(?=["'`])""")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:\-]*+)(?:\s[^<>]*+)?>([^<>]++)</\1>")
_ATTRIBUTES = re.compile(r"""\b(?:key|name)[ \t]*+=[ \t]*+["']([^"'<>\n]++)["']\s++value[ \t]*+=[ \t]*+["'](?=([^"'<>\n]++))""")
#: Blanks, also over the end of a line where a string or a bracket follows.
_GAP = re.compile(r"""[ \t]*+(?:\\?\n\s*+(?=["'`(\[]|[fFrRbBuU]{1,2}["']))?""")
_STRING = re.compile(
    r"""(?:[fFrRbBuU]{1,2}(?=["'])|[@$](?="))?(?:\"{3}(?P<a>(?:[^"\\]|\\.|"(?!""))*+)"{3}|'{3}(?P<b>(?:[^'\\]|\\.|'(?!''))*+)'{3}"""
    r"""|"(?P<c>[^"\n\\]*+(?:\\.[^"\n\\]*+)*+)"|'(?P<d>[^'\n\\]*+(?:\\.[^'\n\\]*+)*+)'|`(?P<e>[^`\\]*+(?:\\.[^`\\]*+)*+)`)""",
    re.DOTALL,
)
_JOIN = re.compile(r"[ \t]*+(?:\\?\n[ \t]*+)?(?:\+|\.\.?|&)[ \t]*+(?:\\?\n[ \t]*+)?")
_SPACE = re.compile(r"\s*+")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: How sensitive a part of a target name is; pairs count together.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "pass": 0.7, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "pin": 0.4, "key": 0.4, "signature": 0.5, "dsn": 0.6,
}
PAIRS = {("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9}
PLACEHOLDERS = {"changeme", "example", "password", "secret", "token", "none", "null", "true", "false", "todo", "your", "xxx", "redacted", "undefined"}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST["assign"]:
            out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


#: (value, start, end); a name that is given has end -1.
Part = tuple[str, int, int]


def _one(text: str, at: int, bare: bool) -> tuple[Part | None, int]:
    """The literal or name at a place, and where it ends; bare: whether a value without quotes may stand there."""
    if m := _STRING.match(text, at):
        kind = m.lastgroup
        return (m[kind], m.start(kind), m.end(kind)), m.end()
    if bare and (m := _BARE.match(text, at)):
        value = m[0].rstrip(".:")
        if _IDENTIFIER.match(value):
            return (value, at, -1), at + len(value)
        return ((value, at, at + len(value)), m.end()) if value else (None, at)
    return None, at


def _given(text: str, at: int, bare: bool = True) -> tuple[list[list[Part]], int]:
    """What is given at a place, and where it ends: groups of parts; the parts of a group are one value."""
    at = _GAP.match(text, at).end()
    part, end = _one(text, at, bare)
    if part is None:
        return _inside(text, at + 1) if text[at : at + 1] in ("(", "[") else ([], at)
    if part[2] < 0 and text[end : end + 1] == "(":  # a call: its arguments
        groups, end = _inside(text, end + 1)
        return groups, end
    group = [part]
    while True:
        joined = _JOIN.match(text, end)
        follows, after = _one(text, joined.end(), True) if joined else _one(text, _GAP.match(text, end).end(), False) if part[2] >= 0 else (None, end)
        if follows is None or (part[2] >= 0 and text[part[1] - 1] not in "\"'`"):  # a bare value is a whole one
            return [group], end
        part, end = follows, after
        group.append(part)


def _inside(text: str, at: int) -> tuple[list[list[Part]], int]:
    """The values inside brackets, up to the one that closes them or to what is no list of values."""
    out: list[list[Part]] = []
    while True:
        at = _SPACE.match(text, at).end()
        groups, end = _given(text, at, False) if text[at : at + 1] not in ("", ")", "]") else ([], at)
        if not groups:
            name = _BARE.match(text, at)
            if not name or text[at : at + 1] in (")", "]", "="):
                return out, at + (text[at : at + 1] in (")", "]"))
            end = name.end()  # a number or a name among the values; a name may be given a value of its own
            if "=" in name[0] or ":" in name[0]:
                return out, at
        out += groups
        at = _SPACE.match(text, end).end()
        if text[at : at + 1] == ",":
            at += 1


def pairs(text: str) -> list[tuple[str, list[Part]]]:
    """(name, parts of one value) of each assignment; no parts where nothing is read from what is given."""
    out: list[tuple[str, list[Part]]] = []
    for m in _ASSIGNED.finditer(text):
        out += [(m[1], group) for group in _given(text, m.end())[0] or [[]]]
    if "(" in text:
        for m in _CALLED.finditer(text):
            groups, _ = _inside(text, m.end())
            out += [(m[1], group) for group in groups]
            if len(groups) > 1 and len(groups[0]) == 1:
                out += [(groups[0][0][0], group) for group in groups[1:]]
    if "</" in text:
        out += [(m[1], [(m[2], m.start(2), m.end(2))]) for m in _ELEMENT.finditer(text)]
    if "value" in text:
        out += [(m[1], [(m[2], m.start(2), m.end(2))]) for m in _ATTRIBUTES.finditer(text)]
    return out


def sensitivity(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    return max(best, max((PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False)), default=0.0))


def looks_random(literal: str) -> float:
    """0 for prose and placeholders, to 1 for long mixed strings."""
    low = literal.lower()
    if len(literal) < 6 or low in PLACEHOLDERS or len(set(literal)) < 4 or literal.count(" ") > 1:
        return 0.0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit)) + (not literal.isalnum())
    return min(1.0, 0.5 * min(1.0, entropy / 3.5) + 0.15 * classes + 0.1 * (n >= 16))


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of literals whose names, with constants propagated, are sensitive enough."""
    found = pairs(text)
    if not found:
        return []
    score: dict[str, float] = defaultdict(float)
    behind: dict[str, list[str]] = defaultdict(list)
    for name, parts in found:
        score[name] = max(score[name], sensitivity(name))
        behind[name] += [value for value, _, end in parts if end < 0]
    queue = [n for n, s in score.items() if s and behind[n]]
    while queue:  # each step raises a score, of which there are few values
        name = queue.pop()
        for source in behind[name]:
            if score[source] < 0.95 * score[name] - 1e-9:
                score[source] = 0.95 * score[name]
                if behind.get(source):
                    queue.append(source)
    out, assigned = set(), {name for name, _ in found}
    for name, parts in found:
        target = score[name]
        literals = [p for p in parts if p[2] >= 0 or (any(map(str.isdigit, p[0])) and p[0] not in assigned)]
        if target and literals and target * looks_random("".join(value for value, *_ in literals)) >= THRESHOLD:
            out.update((start, 3, start + len(value)) for value, start, _ in literals if value)
    return sorted(out)


def scan(text: str) -> tuple[int, int, int, str, str]:
    """(n_assign, n_access, n_hex, base_sha256, spans)."""
    base = base_spans(text)
    every = sorted(base + literal_spans(text))
    line = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    n = [sum(k == i for _, k, _ in base) for i in range(3)]
    return n[0], n[1], n[2], hashlib.sha256(line(base).encode()).hexdigest(), line(every)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for each row."""
    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            rows = [scan(t.as_py() or "") for t in batch.column(1)]
            cols = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return text_map(docs.select(id_col, text_col), run, schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))

"""Document fingerprints: quartile bucket digests of byte triplets.

A text's UTF-8 bytes give triplets (the first byte of a short window with two later ones); each is hashed to one of
BUCKETS counters. The digest holds a code of the length, the ratios of the quartiles of the counts, and for each
bucket the quartile it falls in, two bits each; it never stores the counts. Digests are compared by a difference
score: length and ratio codes add bounded steps, buckets add the distance of their quartiles (a jump over two borders
counts double), and likeness is one minus the score over its bound, so 0 to 1, and 1 for equal digests.

Defined cases: null counts as empty. An empty or very short text has no triplets: all buckets code 0, told apart by
the length code only. Any text length is processed whole, in spans of fixed size.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_map, whole_text

BUCKETS = 256
#: Offsets of the second and third byte of each kind of triplet.
OFFSETS = ((3, 7), (5, 11))
_SPAN = 1 << 20
_MUL = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
LENGTH_STEPS = 32
#: Points for a step of the length code, of a ratio code, and for buckets one, two and three quartiles apart.
POINTS = (2, 2, (0, 1, 3, 6))


def counts(data: bytes) -> np.ndarray:
    """Triplets in each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    reach = max(b for _, b in OFFSETS)
    for lo in range(0, max(1, len(data)), _SPAN):
        b = np.frombuffer(data, np.uint8, min(len(data) - lo, _SPAN + reach), lo).astype(np.uint32)
        first, second, third = (b * m for m in _MUL)
        for kind, (i, j) in enumerate(OFFSETS):
            n = min(len(b) - j, _SPAN)
            if n > 0:
                h = first[:n] + second[i : i + n] + third[j : j + n] + np.uint32(kind * 0x27D4EB2F)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
                total += np.bincount((h >> np.uint32(24)).astype(np.intp), minlength=BUCKETS)
    return total


def _length_code(n: int) -> int:
    """Logarithmic: LENGTH_STEPS values from 0 to 2^32 bytes and over."""
    return min(LENGTH_STEPS * 4 - 1, int(np.log2(n + 1) * 4))


def digest(data: bytes) -> str:
    """Hex: length code (2 digits), two quartile ratios (1 digit each), then two bits for each bucket."""
    c = counts(data)
    q1, q2, q3 = (int(x) for x in np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    ratios = [16 * q // (q3 + 1) for q in (q1, q2)]
    codes = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    quads = codes.reshape(-1, 4)
    body = (quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]).astype(np.uint8).tobytes()
    return f"{_length_code(len(data)):02x}{ratios[0]:x}{ratios[1]:x}{body.hex()}"


_BYTE_POINTS = np.zeros((256, 256), np.int32)
for _shift in (0, 2, 4, 6):
    _c = (np.arange(256) >> _shift) & 3
    _BYTE_POINTS += np.asarray(POINTS[2], np.int32)[np.abs(_c[:, None] - _c[None, :])]
MOST = POINTS[0] * (LENGTH_STEPS * 4 - 1) + 2 * POINTS[1] * 15 + POINTS[2][3] * BUCKETS


def difference(a: str, b: str) -> int:
    """0 for equal digests, MOST at most."""
    points = POINTS[0] * abs(int(a[:2], 16) - int(b[:2], 16))
    points += POINTS[1] * (abs(int(a[2], 16) - int(b[2], 16)) + abs(int(a[3], 16) - int(b[3], 16)))
    x, y = (np.frombuffer(bytes.fromhex(s[4:]), np.uint8) for s in (a, b))
    return points + int(_BYTE_POINTS[x, y].sum())


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / MOST


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([digest(t.encode()) for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(out, [id_col, "n_chars", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text_map(docs.select(id_col, text_col), run, f"{id_col} {kind}, n_chars long, fingerprint string")


def with_next(docs: DataFrame, per_range: int = 400, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Rows of docs in ranges of ascending id, each range followed by the row that starts the next.

    The borders are approximate quantiles of the ids, a bounded list; the first row of each range is sent to the
    range before as well, so a range has all it needs and the texts shuffle once, compressed.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    rows = ids.count()
    ranges = max(1, min(20_000, rows // per_range))
    if ranges > 1:
        marks = ids.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    else:
        marks = []
    marks = sorted(set(marks))

    firsts = {r["r"]: r["m"] for r in _ranged(ids, marks).groupBy("r").agg(F.min("id").alias("m")).collect()}
    order = sorted(firsts)
    before = {firsts[b]: a for a, b in zip(order, order[1:], strict=False)}
    if order:
        before[firsts[order[0]]] = order[-1]  # after the last comes the first

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed = press.compress((text or "").encode())
                out.append((bisect_right(marks, doc), doc, False, packed))
                if doc in before:
                    out.append((before[doc], doc, True, packed))
            if out:
                cols = zip(*out, strict=True)
                types = (pa.int32(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["r", "id", "after", "packed"])

    sent = docs.select(F.col(id_col).cast("long"), whole_text(text_col).alias(text_col)).where(F.col(id_col).isNotNull())
    return text_map(sent, send, "r int, id long, after boolean, packed binary"), ranges


def _ranged(ids: DataFrame, marks: list[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).drop_null().to_numpy()
            r = np.searchsorted(np.asarray(marks, np.int64), values, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(values)], ["r", "id"])

    return ids.mapInArrow(run, "r int, id long")


def edited_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's digest beside those of its edited text and of the next document (ascending id, cyclic).

    The edited text keeps the first half; its last floor(n/2) code points become the first as many (or all) of the
    next document. Rows of equal id follow each other in a fixed order. A null id has no place in the order and no row.
    """
    sent, ranges = with_next(docs, id_col=id_col, text_col=text_col)
    schema = (
        f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        held = None  # (range, id, text, digest) that waits for its next
        for batch in batches:
            rows: list[tuple] = []
            for r, doc, after, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = unpress.decompress(packed).decode()
                mark = digest(text.encode())
                if held and held[0] == r:
                    _, last, old, own = held
                    half = len(old) // 2
                    edited = (old[: len(old) - half] + text[:half]).encode()
                    new = digest(edited)
                    rows.append((last, len(old), hashlib.sha256(edited).hexdigest(), own, new, likeness(own, new), likeness(own, mark)))
                held = None if after else (r, doc, text, mark)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    laid = sent.repartition(max(1, ranges // 4), "r").sortWithinPartitions("r", "after", "id", "packed")
    return text_map(laid, run, schema)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_digests(table(spark, sf_dir, "documents"))

"""Vector best-fit packing of tokenised documents into sequences.

A document's ids are cut into pieces of at most ``tokens`` ids, the short piece first. A piece is a vector: tokens,
one document, attention cost (its length squared). Equal lengths are equal vectors, so the histogram of lengths says
all there is to know about the pieces, and has at most ``tokens`` rows at any corpus size. The driver packs that
histogram: longest class first, each class into the open bins that score best - weighted dot product of the piece and
the bin's residual capacities, or smallest residual norm - under every capacity, whole runs of like bins at a time.
The plan is a list of runs (length, first rank, number, first bin, offset); ranks within a length are dealt to bins by
a range look-up, so the pieces themselves are never gathered and the number of runs does not follow the corpus.

Defined cases: a null text is empty; an empty document is the end id alone. Repeated rows are packed once each.
A document of exactly k x tokens ids makes k full pieces. Only documents longer than a sequence are cut.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bucket_count, ranked, table, text_map, written

#: Entries of a worker's cache of pre-token ids; a full cache is emptied.
CACHE_ENTRIES = 500_000
#: Where white space meets white space, or an end of the text, pre-tokens may reach over a space.
_LOOSE = re.compile(r"\s\s|^\s|\s$")
_DOUBLE = ("  ", "\n\n", " \n", "\n ")
_TAILS = (".", ",", "!", "?", ":", ";")


@dataclass(frozen=True)
class Capacity:
    """Per sequence: ids, documents, attention cost (sum of squared piece lengths); and the score that picks bins."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.25)
    score: str = "norm"  # or "dot"

    def __post_init__(self) -> None:
        if self.tokens < 1 or self.documents < 1 or self.cost < self.tokens**2 or self.score not in ("norm", "dot"):
            raise ValueError("a bin must hold at least one full piece, and score is norm or dot")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The byte-level pre-tokeniser always starts a pre-token at a single space or line feed between two other
    characters, so a text whose white space is single is the sum of its space-led parts; their ids are cached.
    Other texts, and texts with the name of a special token, go to the tokeniser whole. A letter run is one
    pre-token, and punctuation after it or a line feed before it are others, so a new part is cut there and its letter
    run merged by rank where the file's merges are in the order of their ids (checked), else by the tokeniser.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self._by_rank(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = _Parts(self._part)

    @staticmethod
    def _by_rank(path: str):
        """A function from a letter run to ids, or None where ranks do not say all."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
        byte_level = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space")
        in_order = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        plain = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or spec.get("normalizer"))
        if not (model.get("type", "BPE") == "BPE" and byte_level and in_order and plain):
            return None
        # byte-level alphabets name printable Latin-1 bytes by themselves and the others by code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        added = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in added}
        return tiktoken.Encoding("letters", pat_str=r" ?\p{L}+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _single(self, text: str) -> bool:
        """Whether all white space is single spaces and line feeds inside the text."""
        if text.replace("\n", "").isprintable():  # no other white space
            return text[:1] not in (" ", "\n", "") and text[-1] not in (" ", "\n") and not any(d in text for d in _DOUBLE)
        return "\0" not in text and not _LOOSE.search(text)

    def _direct(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(c.ids, dtype="<u4").tobytes() for c in coded]

    def _part(self, part: str) -> bytes:
        """Ids of a new part."""
        head, core, tail = "", part, ""
        if part[0] == "\n":
            head, core = "\n", part[1:]
        if core[-1:] in _TAILS:
            core, tail = core[:-1], core[-1]
        letters = core[1:] if core[:1] == " " else core
        if not (self.merge and letters.isalpha()):
            return np.asarray(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        if head or tail:
            return (self.cache[head] if head else b"") + self.cache[core] + (self.cache[tail] if tail else b"")
        ids = self.merge(core)
        return np.asarray(ids, "<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, ids_of = [], self.cache.__getitem__
        for t in texts:
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            if self._single(t) and not any(s in t for s in self.special):
                out.append(b"".join(map(ids_of, t.replace(" ", "\0 ").replace("\n", "\0\n").split("\0"))))
            else:
                out.append(self._direct([t])[0])
        return out


class _Parts(dict[str, bytes]):
    """Ids of parts; those of a new one are made when it is asked for."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = self.make(part)
        return ids


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, tokens: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document, the short piece first."""
    schema = f"{id_col} long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[tuple] = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % tokens or tokens, n + 1, tokens)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        cut = ids[4 * a : 4 * b]
                        rows.append((doc, k, a, b - a, zlib.crc32(cut)) + ((cut,) if keep_ids else ()))
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        encode.cache.clear()  # workers live on for other stages

    return text_map(docs.select(F.col(id_col).cast("long"), text_col), run, schema)


def plan_bins(histogram: dict[int, int], cap: Capacity) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, number, first bin, offset) and the number of bins.

    open: like bins by state (residual tokens, documents, cost), each a list of (first bin, number).
    """
    weights = np.asarray(cap.weights, float)
    full = np.asarray([cap.tokens, cap.documents, cap.cost], float)
    states: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
    runs, bins = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        need = (length, 1, length * length)
        while left:
            fit = [s for s in states if s[0] >= length and s[1] >= 1 and s[2] >= need[2]]
            if fit:
                rest = (np.asarray(fit, float) - need) / full
                if cap.score == "norm":
                    value = -(weights * rest**2).sum(1)
                else:
                    value = (weights * (np.asarray(fit, float) / full) * (np.asarray(need, float) / full)).sum(1)
                state = fit[int(np.lexsort((np.asarray([s[0] for s in fit]), -value))[0])]
                first, number = states[state].pop()
                if not states[state]:
                    del states[state]
            else:
                state, first, number = (cap.tokens, cap.documents, cap.cost), bins, left
                # new bins take as many pieces of this class as fit side by side
                each = max(1, min(cap.tokens // length, cap.documents, cap.cost // need[2]))
                number = -(-left // each)
                bins += number
            put = min(left, number)
            runs.append((length, rank, put, first, cap.tokens - state[0]))
            rank, left = rank + put, left - put
            after = tuple(s - n for s, n in zip(state, need, strict=True))
            if after[0] and after[1] and after[2]:
                states[after].append((first, put))
            if put < number:
                states[state].append((first + put, number - put))
    return runs, bins


def pack(cut: DataFrame, cap: Capacity, id_col: str = "doc_id") -> DataFrame:
    """cut (as pieces() gives it, stored) with sequence_id and offset.

    Full pieces are sequences of their own. The others are ranked within their length and dealt by the plan's runs;
    the table of runs is bounded by the number of lengths and pieces to a sequence, whatever the corpus.
    """
    spark = cut.sparkSession
    short = cut.where(F.col("length") < cap.tokens)
    histogram = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, bins = plan_bins(histogram, cap)
    rows = cut.count()
    placed = ranked(cut, ["length"], [id_col, "piece"], bucket_count(rows, 4_000), "_rank")
    by_length: dict[int, list[tuple]] = defaultdict(list)
    for length, rank, number, first, offset in runs:
        by_length[length].append((rank, number, first, offset))
    # one row for each length: arrays of run starts, first bins and offsets, in order of rank
    plan = [(length, [x[0] for x in r], [x[2] for x in r], [x[3] for x in r]) for length, r in by_length.items()]
    schema = "length long, _starts array<long>, _bins array<long>, _offsets array<int>"
    table_ = F.broadcast(spark.createDataFrame(plan, schema))
    spread = written(placed, "ranked")
    filled = spread.where(F.col("length") < cap.tokens).join(table_, "length").withColumn("_run", F.expr("size(filter(_starts, s -> s <= _rank)) - 1"))
    filled = filled.select(
        *cut.columns,
        (F.expr("_bins[_run]") + F.col("_rank") - F.expr("_starts[_run]")).alias("sequence_id"),
        F.expr("_offsets[_run]").cast("long").alias("offset"),
    )
    whole = spread.where(F.col("length") >= cap.tokens).select(
        *cut.columns, (F.col("_rank") + F.lit(bins)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return filled.unionByName(whole)


def best_fit_pack(docs: DataFrame, tokenizer: str, cap: Capacity = Capacity(), end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of every document with the sequence and the place there; with keep_ids also the ids themselves."""
    cut = written(pieces(docs, tokenizer, cap.tokens, end_id, id_col, text_col, keep_ids), "pieces")
    return pack(cut, cap, id_col)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"), default_tokenizer(), replace(Capacity(), tokens=1024))

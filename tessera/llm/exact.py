"""Exact de-duplication: two passes of a Bloom filter, so that only possibly repeated rows shuffle.

Pass one counts the rows that fall on each of the filter's bits (map-side sums of small numbers, no text) and keeps
the bits that two or more rows set. Pass two probes: a row whose bits are all kept may be repeated and is shuffled by
its hash; any other row is certainly unique and passes straight through. The filter has no false negatives, so the
result is exact at every fill level; a full filter only sends more rows through the shuffle.

Defined cases: a null text counts as empty, so nulls and empty texts are one group. Of equal texts the largest id
stays; of repeated rows with that same id, one stays. A null id counts as smaller than any other. Extra columns pass
through whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, whole_text, written

#: Bits of the filter: BITS_PER_ROW for each row, MOST_BITS at most. The broadcast table has a row for each 64 bits
#: that hold a kept bit: 2.1 million rows, about 85 MB, at the bound.
BITS_PER_ROW = 16
MOST_BITS = 1 << 27
PROBES = 2
#: Groups of over so many rows, or a LARGE-th of all, are met by broadcast: LARGE at most.
LARGE, LARGE_ROWS = 1024, 1000


def _positions(text: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(text, F.lit(i)), F.lit(bits)) for i in range(PROBES)]


def repeated_bits(docs: DataFrame, text: Column, bits: int) -> DataFrame:
    """(word, mask): the bits that at least two rows set, 64 to a word."""
    hits = docs.select(F.explode(F.array(*_positions(text, bits))).alias("bit"))
    twice = hits.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("mask")
    )


def possibly_repeated(docs: DataFrame, text: Column, flag: str = "_maybe", bits: int | None = None) -> DataFrame:
    """docs with a boolean column: false only where no other row has the same text."""
    if bits is None:
        bits = 1 << 16
        rows = docs.count()
        while bits < min(MOST_BITS, BITS_PER_ROW * rows):
            bits *= 2
    words = written(repeated_bits(docs, text, bits), "bloom")
    out, test = docs, F.lit(True)
    for i, at in enumerate(_positions(text, bits)):
        side = F.broadcast(words.select(F.col("word").alias(f"_word{i}"), F.col("mask").alias(f"_mask{i}")))
        out = out.withColumn(f"_bit{i}", at)
        out = out.join(side, F.shiftright(F.col(f"_bit{i}"), 6) == F.col(f"_word{i}"), "left")
        shifted = F.expr(f"shiftright(_mask{i}, cast(_bit{i} & 63 AS int)) & 1L")
        test = test & F.coalesce(shifted == 1, F.lit(False))
    return out.withColumn(flag, test).drop(*[f"_{k}{i}" for i in range(PROBES) for k in ("bit", "word", "mask")])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row for each row of docs: (id, keep_id, group_size, kept, text_sha256)."""
    text = whole_text(text_col)
    flagged = possibly_repeated(docs.select(id_col, text_col), text, bits=bits)
    rows = written(flagged.select(id_col, F.sha2(text, 256).alias("text_sha256"), "_maybe"), "hashes")
    maybe = rows.where("_maybe").drop("_maybe")
    groups = written(maybe.groupBy("text_sha256").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    same_row = Window.partitionBy("text_sha256", id_col).orderBy(id_col)
    numbered = maybe.withColumn("_copy", F.row_number().over(same_row))
    # one hash may hold a third of all rows: groups of that kind are few and go to their rows
    large = F.col("group_size") > max(LARGE_ROWS, rows.count() // LARGE)
    met = numbered.join(F.broadcast(groups.where(large)), "text_sha256", "left")
    others = met.where("group_size IS NULL").drop("keep_id", "group_size").join(groups.where(~large), "text_sha256")
    joined = met.where("group_size IS NOT NULL").unionByName(others)
    shuffled = joined.select(
        id_col, "keep_id", "group_size",
        (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "text_sha256",
    )
    straight = rows.where(~F.col("_maybe")).select(
        id_col, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return straight.unionByName(shuffled)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """The rows of docs that stay, with docs' own columns. Rows that the filter clears do not shuffle."""
    whole = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    flagged = possibly_repeated(whole, F.col("_text"), bits=bits)
    maybe = flagged.where("_maybe").select("_row", "_id", F.sha2("_text", 256).alias("_sha"))
    keepers = maybe.groupBy("_sha").agg(F.max("_id").alias("_keep"))
    same_row = Window.partitionBy("_sha", "_id").orderBy("_id")
    one_each = maybe.withColumn("_copy", F.row_number().over(same_row)).where("_copy = 1")
    stay = one_each.alias("r").join(
        keepers.alias("k"), (F.col("r._sha") == F.col("k._sha")) & F.col("r._id").eqNullSafe(F.col("k._keep")), "left_semi"
    )
    return flagged.where(~F.col("_maybe")).select("_row").unionByName(stay.select("_row")).select("_row.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

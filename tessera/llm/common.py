"""Shared pieces: tables in the shared scratch folder, ranks without hot partitions, connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where a local master leaves it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Bytes of an Arrow batch while a table is written or counted: bounds the memory of Python workers where texts are long.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside gets Arrow batches of BATCH_BYTES at most; the session's own setting holds before and after."""
    own = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, own)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside has its shuffle files deleted when it ends, not when the driver's collector finds them unused."""
    own = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if own is None else spark.conf.set(_CLEANUP, own)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the scratch folder: cuts lineage and survives the loss of executors.

    Arrow batches are small_batches() while it is written.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(since: int = 0, keep: int = 0) -> None:
    """Delete the scratch tables written since there were ``since``, but the last ``keep``; call it once the results that
    read them are stored. All go at exit."""
    kept = _written[len(_written) - keep :] if keep else []
    del _written[len(_written) - keep :]
    while len(_written) > since:
        spark, path = _written.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except (Py4JError, AttributeError, OSError):
            break  # the session is gone
    _written.extend(kept)


def tables_written() -> int:
    return len(_written)


atexit.register(release)


def give_back() -> None:
    """Return a worker's free memory to the system, Arrow's and the C library's: workers live on for other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def text_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema), with give_back() after each task.

    Batches are bounded by bytes (spark.sql.execution.arrow.maxBytesPerBatch).
    """

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(released, schema)


#: Rows that a table may have to be broadcast whole.
SMALL_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """A stored table as the small side of a join: broadcast where its rows are counted to be few."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def bucket_count(rows: int, per_bucket: int = 20_000, most: int = 1 << 16) -> int:
    """Buckets of about per_bucket rows, so that a ranked group of any size is many small sorts."""
    return max(1, min(most, -(-rows // per_bucket)))


def ranked(df: DataFrame, keys: list[str], order: list[str], buckets: int, name: str = "rank") -> DataFrame:
    """Adds name: the row's 0-based place within its keys, without gaps.

    A key's rows are dealt over hash buckets of the order columns, ranked in each bucket, and shifted by the
    sizes of the buckets before; no task holds a whole key. The place follows (bucket, order): fixed by the rows,
    not the plan. The table of sizes has at most (distinct keys x buckets) rows.
    """
    salted = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = salted.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = salted.withColumn("_local", F.row_number().over(inside) - 1)
    return (
        local.join(starts, [*keys, "_bucket"])
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_bucket", "_start", "_local")
    )


def _order(col: str) -> Column:
    """Pseudo-random and fixed: keeps contraction rounds logarithmic on chains of neighbouring ids."""
    return F.struct(F.xxhash64(col).alias("h"), F.col(col).alias("v"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) for every vertex of edges; vertices are connected exactly if their roots are equal.

    Contraction: each round points every vertex to the first of itself and its neighbours in a fixed random order
    and contracts along the pointers. Only aggregates with partial sums and equi-joins; the maps of all rounds stay
    in tables and are composed at the end.
    """
    spark = edges.sparkSession
    kind = edges.schema[a].dataType
    one_way = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    live = written(one_way.unionByName(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    steps: list[DataFrame] = []
    while not live.isEmpty():
        best = live.groupBy("u").agg(F.min(_order("v")).alias("m"))
        step = written(best.select("u", F.least("m", _order("u")).getField("v").alias("m")), "step")
        steps.append(step)
        moved = (
            live.join(step, "u")
            .select(F.col("m").alias("mu"), "v")
            .join(step.select(F.col("u").alias("v"), F.col("m").alias("mv")), "v")
            .where("mu <> mv")
            .select(F.col("mu").alias("u"), F.col("mv").alias("v"))
            .distinct()
        )
        live = written(moved, "edges")
    if not steps:
        return spark.createDataFrame([], one_way.schema).select(F.col("u").cast(kind).alias("v"), F.col("u").cast(kind).alias("root"))
    out = steps[0].select(F.col("u").alias("v"), F.col("m").alias("root"))
    for step in steps[1:]:
        hop = step.select(F.col("u").alias("root"), F.col("m").alias("_to"))
        out = out.join(hop, "root", "left").select("v", F.coalesce("_to", "root").alias("root"))
    return out


#: Bits of a membership filter: 16 for each member, 2^27 at most (a broadcast table of 2.1 million rows, about 85 MB).
FILTER_BITS = 1 << 27


def maybe_in(df: DataFrame, col: str, members: DataFrame, member: str, flag: str) -> DataFrame:
    """df with a boolean column, false only where col is certainly not among members; df does not shuffle."""
    n, bits = members.count(), 1 << 16
    while bits < min(FILTER_BITS, 16 * n):
        bits *= 2
    at = members.select(F.pmod(F.xxhash64(F.col(member).cast("long")), F.lit(bits)).alias("b"))
    words = at.groupBy(F.shiftright("b", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 AS int)))").alias("_mask"))
    probe = df.withColumn("_b", F.pmod(F.xxhash64(F.col(col).cast("long")), F.lit(bits)))
    probe = probe.join(F.broadcast(written(words, "filter")), F.shiftright("_b", 6) == F.col("_word"), "left")
    hit = F.coalesce(F.expr("(shiftright(_mask, cast(_b & 63 AS int)) & 1L) = 1"), F.lit(False))
    return probe.withColumn(flag, hit).drop("_b", "_word", "_mask")


def without(df: DataFrame, col: str, gone: DataFrame, member: str) -> DataFrame:
    """Rows of df whose col is not among gone; only rows that the filter can't clear shuffle."""
    whole = df.select(F.struct("*").alias("_row"), F.col(col).alias("_id"))
    flagged = maybe_in(whole, "_id", gone, member, "_maybe")
    ids = gone.select(F.col(member).alias("_gone")).distinct()
    unsure = flagged.where("_maybe").join(ids, F.col("_id") == F.col("_gone"), "left_anti")
    return flagged.where(~F.col("_maybe")).select("_row").unionByName(unsure.select("_row")).select("_row.*")

"""Sharding by balanced label propagation. DataFrame operations only.

Documents of equal text are linked. Every shard gets the same number of rows, to within one: a first deal that keeps
the few groups of many rows whole and takes all others by rank, and from then on only moves that keep the counts. In each round a linked document wants the shard that most of its
group is in. Moves from A to B and from B to A are matched in pairs; beyond that, B gives single documents (linked to
nothing, so no edge is cut) for the linked ones that it takes, and those fill the places that are left. Quotas come
from a table of shards x shards; who moves follows from ranks, never from gathering a group or a shard in one task.
A group of over a shard's quota is cut into parts of a quota by rank, and the parts propagate on their own.

Groups of over a HOT-th of all rows, HOT at most, meet their tables by broadcast, so no task gets such a group.

Defined cases: ids are integers or null. Null counts as empty, so nulls and empty texts are one group. The law is rows, so grown_shard is null.
Repeated rows are linked like other equal texts. Fewer rows than shards leave shards empty; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bucket_count, ranked, table, whole_text, written

SHARDS = 16
ROUNDS = 8
#: A group is hot that has so large a part of all rows.
HOT = 512


def _groups(rows: DataFrame, n_rows: int, shards: int, buckets: int) -> DataFrame:
    """rows (_id, _copy, _size, _crc, _g) with _part: the group, or the part of a large group, that a row belongs to;
    _linked: whether it is linked to another; _hot: whether its group is hot."""
    quota = max(1, n_rows // shards)
    sizes = written(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_members")).where("_members > 1"), "sizes")
    least = F.lit(max(1, n_rows // HOT))
    hot = sizes.where(F.col("_members") > least).select("_g", "_members")
    small = sizes.where(F.col("_members") <= least).select("_g", F.lit(1).alias("_small"))
    out = rows.join(F.broadcast(hot), "_g", "left")
    rest = out.where("_members IS NULL").join(small, "_g", "left").withColumn("_linked", F.col("_small").isNotNull()).drop("_small")
    large = out.where(F.col("_members") > quota)
    large = ranked(large, ["_g"], ["_id", "_copy"], buckets, "_rank").withColumn("_part", F.xxhash64("_g", F.floor(F.col("_rank") / quota))).drop("_rank")
    whole = out.where(F.col("_members") <= quota).withColumn("_part", F.col("_g"))
    held = whole.unionByName(large).withColumn("_linked", F.lit(True)).unionByName(rest.withColumn("_part", F.col("_g")))
    return held.select("_id", "_copy", "_size", "_crc", "_part", "_linked", F.col("_members").isNotNull().alias("_hot"))


def _targets(state: DataFrame) -> DataFrame:
    """(_part, _hot, _to): the shard that holds most of each linked part; a row for each."""
    held = state.where("_linked").groupBy("_part", "_hot", "_shard").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("_shard", F.struct("n", F.xxhash64("_part", "_shard").alias("h")))
    return held.groupBy("_part", "_hot").agg(best.alias("_to"))


def _dealt(state: DataFrame, n_rows: int, shards: int, buckets: int) -> DataFrame:
    """state with _shard, counts within one: hot parts, largest first, whole into the fullest shard that takes them, and
    all other rows by rank into the places that are left."""
    parts = state.where("_hot").groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()  # HOT groups and their parts
    places = [n_rows // shards + (s < n_rows % shards) for s in range(shards)]
    put = []
    for r in sorted(parts, key=lambda r: (-r["n"], r["_part"])):
        fits = [s for s in range(shards) if places[s] >= r["n"]]
        if fits:
            s = min(fits, key=lambda s: (places[s], s))
            places[s] -= r["n"]
            put.append((r["_part"], s))
    whole = F.broadcast(state.sparkSession.createDataFrame(put, "_part long, _shard int"))
    met = state.join(whole, "_part", "left")
    rest = ranked(met.where("_shard IS NULL").withColumn("_all", F.lit(0)), ["_all"], ["_id", "_copy"], buckets, "_rank")
    ends = F.array(*[F.lit(sum(places[: s + 1])).cast("long") for s in range(shards)])
    rest = rest.withColumn("_ends", ends).withColumn("_shard", F.expr("size(filter(_ends, e -> e <= _rank))")).drop("_all", "_rank", "_ends")
    return written(met.where("_shard IS NOT NULL").unionByName(rest), "state")


def propagate(state: DataFrame, shards: int, buckets: int) -> tuple[DataFrame, int]:
    """One round over state (_id, _copy, ..., _part, _linked, _shard); also the number of linked rows that moved."""
    spark = state.sparkSession
    targets = written(_targets(state), "targets")
    # hot parts are few: HOT groups at most, and a part more for each quota
    hot = state.where("_linked AND _hot").join(F.broadcast(targets.where("_hot").drop("_hot")), "_part")
    others = state.where("_linked AND NOT _hot").join(targets.where("NOT _hot").drop("_hot"), "_part")
    wants = written(hot.unionByName(others).where("_to <> _shard"), "wants")
    asked = {(r["_shard"], r["_to"]): r["n"] for r in wants.groupBy("_shard", "_to").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not asked:
        return state, 0
    singles = {r["_shard"]: r["n"] for r in state.where("NOT _linked").groupBy("_shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    quota, net = {}, dict.fromkeys(range(shards), 0)
    for to in range(shards):
        spare = singles.get(to, 0)
        for of in range(shards):
            n = asked.get((of, to), 0)
            paired = min(n, asked.get((to, of), 0))
            extra = min(n - paired, spare)
            spare -= extra
            if paired + extra:
                quota[of, to] = paired + extra
                net[to] += paired + extra
                net[of] -= paired + extra
    moved = sum(quota.values())
    if not moved:
        return state, 0
    # shards x shards rows at most
    allowed = F.broadcast(spark.createDataFrame([(a, b, q) for (a, b), q in quota.items()], "_shard int, _to int, _quota long"))
    accepted = ranked(wants.select("_id", "_copy", "_shard", "_to"), ["_shard", "_to"], ["_id", "_copy"], buckets, "_rank")
    accepted = accepted.join(allowed, ["_shard", "_to"]).where("_rank < _quota").select("_id", "_copy", "_to")
    giving = [(s, n) for s, n in net.items() if n > 0]
    taking = [(s, -n) for s, n in net.items() if n < 0]
    if giving:
        # a given single's place in the row of all given singles says which free place it fills
        gives, at = [], 0
        for s, n in giving:
            gives.append((s, n, at))
            at += n
        fills, at = [], 0
        for s, n in taking:
            fills.append((s, at, at + n))
            at += n
        gives_t = F.broadcast(spark.createDataFrame(gives, "_shard int, _give long, _first long"))
        out = ranked(state.where("NOT _linked").join(gives_t.select("_shard"), "_shard", "left_semi").select("_id", "_copy", "_shard"), ["_shard"], ["_id", "_copy"], buckets, "_rank")
        out = out.join(gives_t, "_shard").where("_rank < _give").withColumn("_at", F.col("_first") + F.col("_rank"))
        to = F.lit(None).cast("int")
        for s, lo, hi in fills:
            to = F.when((F.col("_at") >= lo) & (F.col("_at") < hi), F.lit(s)).otherwise(to)
        accepted = accepted.unionByName(out.select("_id", "_copy", to.alias("_to")))
    after = state.join(accepted, ["_id", "_copy"], "left").withColumn("_shard", F.coalesce("_to", "_shard")).drop("_to")
    return written(after, "state"), moved


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row."""
    text = whole_text(text_col)
    raw = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_key"),
        (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"), F.xxhash64(text, F.lit(7)).alias("_g"),
    )
    # repeated rows get a number, so that (id, number) names a row
    raw = written(raw, "sizes")
    n = raw.count()
    buckets = bucket_count(n)
    # one id, null say, may have many rows: numbered without a task that holds them all
    rows = ranked(raw, ["_key"], ["_g", "_size", "_crc"], buckets, "_copy").withColumnRenamed("_key", "_id")
    rows = written(rows, "rows")
    state = _dealt(written(_groups(rows, n, shards, buckets), "groups"), n, shards, buckets)
    for _ in range(rounds):
        state, moved = propagate(state, shards, buckets)
        if not moved:
            break
    slots = ranked(state, ["_shard"], ["_id", "_copy"], buckets, "slot")
    low = F.lit(-(1 << 63))
    return slots.select(
        F.when(F.col("_id") != low, F.col("_id")).alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))

"""Mixing sources to target weights by hierarchical budgeting. DataFrame operations only.

Leaves are (domain, language, source). The token budget flows from the root to domains, to languages, to sources in
proportion to integer weights. A node can use at most its capacity, MAX_EPOCHS times its tokens; what a node cannot
use goes to its siblings in proportion to their weights, again up to their capacities (water filling, in closed form
over the siblings ordered by capacity per weight). A node's share never exceeds the sum of its children's capacities,
so shortages are settled among siblings before an ancestor's siblings get anything. All amounts are exact integers.

A leaf takes whole epochs of its documents and then the longest prefix of one more seeded order of the leaf whose
tokens fit the rest. Orders are by a hash of seed, epoch and id. The prefix is found from the token sums of hash
ranges, so only the rows of the one range where it ends are sorted; no task holds a leaf.

Defined cases: null text counts as empty, null language or source as ''. A leaf whose weights are zero gets nothing
unless all its siblings' weights are zero, then they share equally. Equal hashes are taken in order of id; repeated
rows of one id and text are taken together. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import small, table, whole_text, written

RANGES = 4096


@dataclass(frozen=True)
class Mix:
    """Target weights by level (anything not named weighs default), budget as a share of all tokens in per mille."""

    domains: dict[str, int] = field(default_factory=lambda: {"d0": 30, "d1": 25, "d2": 25, "d3": 20})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 60, "fr": 14, "de": 14, "es": 12})
    sources: dict[str, int] = field(default_factory=lambda: {"src0": 15})
    default: int = 10
    budget_per_mille: int = 1000
    max_epochs: int = 2
    seed: int = 17


def domain_of(source: Column) -> Column:
    """The source's number, modulo four, names its domain; sources without a number are in d0."""
    digits = F.regexp_extract(source, r"(\d{1,9})$", 1)
    return F.concat(F.lit("d"), F.coalesce(digits.try_cast("int"), F.lit(0)) % 4)


def tokens_of(text: Column) -> Column:
    """Token estimate: a token for each started four characters, and one for the end."""
    return (F.floor((F.length(text) + 3) / 4) + 1).cast("long")


def _weight(name: str, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for key, value in weights.items():
        out = F.when(F.col(name) == key, F.lit(value)).otherwise(out)
    return out.cast("decimal(20,0)")


def fill(children: DataFrame, parent: list[str], budget: str, weight: str, capacity: str, name: str) -> DataFrame:
    """children with their share of the parent's budget: floor(level x weight), or the capacity where that is less.

    Siblings in order of capacity per weight: one is full exactly if the capacities up to it, and its ratio times the
    weights behind it, do not exceed the budget.
    """
    by_ratio = Window.partitionBy(*parent).orderBy("_ratio", *[k for k in ("domain", "lang", "source") if k in children.columns])
    every = Window.partitionBy(*parent)
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(weight).over(every)
    w = F.when(total == 0, F.lit(1)).otherwise(F.col(weight)).cast("decimal(20,0)")
    out = children.withColumn("_w", w)
    scaled = F.expr(f"CASE WHEN _w = 0 THEN {(1 << 63) - 1} ELSE (cast({capacity} AS decimal(38,0)) * 1000) DIV _w END")
    out = out.withColumn("_ratio", scaled)
    out = out.withColumn("_caps", F.sum(F.col(capacity)).over(upto)).withColumn("_wupto", F.sum("_w").over(upto))
    out = out.withColumn("_wall", F.sum("_w").over(every))
    full = F.expr(
        f"_w > 0 AND cast({capacity} AS decimal(38,0)) * (_wall - _wupto) <= (cast({budget} AS decimal(38,0)) - _caps) * _w"
    )
    out = out.withColumn("_full", full)
    out = out.withColumn("_fullcap", F.sum(F.when(F.col("_full"), F.col(capacity)).otherwise(F.lit(0))).over(every))
    out = out.withColumn("_openw", F.sum(F.when(F.col("_full"), F.lit(0)).otherwise(F.col("_w"))).over(every))
    share = F.expr(
        f"CASE WHEN _full THEN {capacity} WHEN _openw = 0 OR _w = 0 THEN 0 "
        f"ELSE least({capacity}, cast(((cast({budget} AS decimal(38,0)) - _fullcap) * _w) DIV _openw AS bigint)) END"
    )
    return out.withColumn(name, share.cast("long")).drop("_w", "_ratio", "_caps", "_wupto", "_wall", "_full", "_fullcap", "_openw")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (domain, lang, source, leaf_tokens) with leaf_budget. Small: a row for each leaf."""
    cap = leaves.withColumn("_cap", F.col("leaf_tokens") * mix.max_epochs)
    domains = cap.groupBy("domain").agg(F.sum("_cap").alias("_cap"), F.sum("leaf_tokens").alias("_tokens")).withColumn("_one", F.lit(1))
    tokens = F.sum("_tokens").over(Window.partitionBy("_one")).cast("decimal(38,0)")
    domains = domains.withColumn("_all", tokens).withColumn("_budget", F.expr(f"(_all * {mix.budget_per_mille}) DIV 1000"))
    domains = fill(domains.withColumn("_weight", _weight("domain", mix.domains, mix.default)), ["_one"], "_budget", "_weight", "_cap", "_share")
    langs = cap.groupBy("domain", "lang").agg(F.sum("_cap").alias("_cap")).join(domains.select("domain", F.col("_share").alias("_budget")), "domain")
    langs = fill(langs.withColumn("_weight", _weight("lang", mix.languages, mix.default)), ["domain"], "_budget", "_weight", "_cap", "_share")
    own = cap.join(langs.select("domain", "lang", F.col("_share").alias("_budget")), ["domain", "lang"])
    own = fill(own.withColumn("_weight", _weight("source", mix.sources, mix.default)), ["domain", "lang"], "_budget", "_weight", "_cap", "leaf_budget")
    return own.select("domain", "lang", "source", "leaf_tokens", "leaf_budget")


def _hash(seed: int, epoch: Column, key: Column) -> Column:
    """Bits of an MD5 of seed, epoch and id, as a number below 2^60; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string"))), 1, 15), 16, 10).cast("long")


LEAF = ["_domain", "_lang", "_source"]


def with_leaf(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns of its leaf and its token estimate."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return docs.select(
        "*", domain_of(source).alias("_domain"), F.coalesce("lang", F.lit("")).alias("_lang"), source.alias("_source"),
        tokens_of(whole_text(text_col)).alias("_tokens"),
    )


def take_epochs(rows: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id") -> DataFrame:
    """rows (as with_leaf() gives them) with _epoch: each row once for each epoch that takes it.

    Only token sums, tables of leaves and the rows of the one range in which a leaf's prefix ends are shuffled.
    """
    leaves = rows.groupBy(*[F.col(k).alias(k[1:]) for k in LEAF]).agg(F.sum("_tokens").alias("leaf_tokens"))
    budgets = leaf_budgets(leaves, mix).select(
        *[F.col(k[1:]).alias(k) for k in LEAF],
        F.expr("cast(leaf_budget DIV leaf_tokens AS int)").alias("_whole"),
        F.expr("leaf_budget % leaf_tokens").alias("_rest"),
    )
    # a row for each leaf; where sources are as many as hosts, a join by shuffle is left to the optimiser
    budgets = written(budgets, "budgets")
    hashed = rows.join(small(budgets), LEAF).withColumn("_h", _hash(mix.seed, F.col("_whole"), F.col(id_col)))
    hashed = hashed.withColumn("_range", F.shiftright("_h", 60 - RANGES.bit_length() + 1).cast("int"))
    sums = hashed.groupBy(*LEAF, "_range").agg(F.sum("_tokens").alias("_sum"))
    before = Window.partitionBy(*LEAF).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    cut = sums.join(small(budgets.select(*LEAF, "_rest")), LEAF).where("_start <= _rest AND _start + _sum > _rest")
    cut = written(cut.select(*LEAF, F.col("_range").alias("_cut"), F.col("_start")), "cuts")
    marked = hashed.join(small(cut), LEAF, "left")
    order = Window.partitionBy(*LEAF).orderBy("_h", id_col)  # the default frame takes ties together
    ends = marked.where("_range = _cut").withColumn("_more", (F.col("_start") + F.sum("_tokens").over(order) <= F.col("_rest")).cast("int"))
    others = marked.where("_range <> _cut").withColumn("_more", (F.col("_range") < F.col("_cut")).cast("int"))
    times = others.unionByName(ends).withColumn("_times", F.col("_whole") + F.col("_more")).where("_times > 0")
    taken = times.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    return taken.select(*rows.columns, "_epoch")


def mix_documents(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' own columns, a row for each epoch that takes the document."""
    whole = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("text"), "lang", "source")
    rows = with_leaf(whole).select("_row", "_id", *LEAF, "_tokens")
    return take_epochs(rows, mix, "_id").select("_row.*")


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, tokens): each taken document, once for each epoch."""
    rows = with_leaf(table(spark, sf_dir, "documents")).select("doc_id", *LEAF, "_tokens")
    taken = take_epochs(written(rows, "tokens"))
    return taken.select("doc_id", *[F.col(k).alias(k[1:]) for k in LEAF], F.col("_epoch").alias("epoch"), F.col("_tokens").alias("tokens"))


def _sql_weight(name: str, weights: dict[str, int], default: int) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {default} END"


def _sql_fill(source: str, parent: str, order: str) -> str:
    """SQL of fill(): source has columns budget, weight, cap beside the level's names; adds share."""
    return f"""
    SELECT *, (CASE WHEN full_ THEN cap WHEN openw = 0 OR w = 0 THEN 0
               ELSE least(cap::HUGEINT, ((budget::HUGEINT - fullcap) * w) // openw) END)::BIGINT AS share
    FROM (SELECT *, coalesce(sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY {parent}), 0)::HUGEINT AS fullcap,
                 sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (PARTITION BY {parent})::HUGEINT AS openw
    FROM (SELECT *, w > 0 AND cap::HUGEINT * (wall - wupto) <= (budget::HUGEINT - caps) * w AS full_
    FROM (SELECT *, sum(cap) OVER upto::HUGEINT AS caps, sum(w) OVER upto::HUGEINT AS wupto,
                 sum(w) OVER (PARTITION BY {parent})::HUGEINT AS wall
          FROM (SELECT *, CASE WHEN w = 0 THEN 9223372036854775807 ELSE (cap::HUGEINT * 1000) // w END AS ratio
                FROM (SELECT *, CASE WHEN sum(weight) OVER (PARTITION BY {parent}) = 0 THEN 1 ELSE weight END::HUGEINT AS w FROM ({source})))
          WINDOW upto AS (PARTITION BY {parent} ORDER BY ratio, {order} ROWS UNBOUNDED PRECEDING))))"""


def oracle(mix: Mix = Mix()) -> str:
    text = "coalesce(text, '')"
    domains = _sql_fill(
        f"""SELECT 1 AS one, domain, sum(leaf_tokens) * {mix.max_epochs} AS cap, {_sql_weight("domain", mix.domains, mix.default)} AS weight,
                   (sum(sum(leaf_tokens)) OVER ())::HUGEINT * {mix.budget_per_mille} // 1000 AS budget FROM leaves GROUP BY domain""",
        "one", "domain",
    )
    langs = _sql_fill(
        f"""SELECT l.domain, lang, sum(leaf_tokens) * {mix.max_epochs} AS cap, {_sql_weight("lang", mix.languages, mix.default)} AS weight,
                   any_value(d.share) AS budget FROM leaves l JOIN by_domain d USING (domain) GROUP BY l.domain, lang""",
        "domain", "domain, lang",
    )
    own = _sql_fill(
        f"""SELECT domain, lang, source, leaf_tokens, leaf_tokens * {mix.max_epochs} AS cap,
                   {_sql_weight("source", mix.sources, mix.default)} AS weight, g.share AS budget
            FROM leaves JOIN by_lang g USING (domain, lang)""",
        "domain, lang", "domain, lang, source",
    )
    return f"""
    WITH rows AS (
      SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT), 0) % 4) AS domain,
             coalesce(lang, '') AS lang, coalesce(source, '') AS source, (length({text}) + 3) // 4 + 1 AS tokens FROM documents),
    leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS leaf_tokens FROM rows GROUP BY ALL),
    by_domain AS ({domains}), by_lang AS ({langs}),
    budgets AS (SELECT domain, lang, source, share // leaf_tokens AS whole, share % leaf_tokens AS rest FROM ({own})),
    hashed AS (
      SELECT *, ('0x' || substr(md5('{mix.seed}:' || whole || ':' || doc_id), 1, 15))::BIGINT AS h FROM rows JOIN budgets USING (domain, lang, source)),
    run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id) AS upto FROM hashed),
    epochs AS (SELECT unnest(range({mix.max_epochs + 1})) AS e)
    SELECT doc_id, domain, lang, source, e::INT AS epoch, tokens::BIGINT AS tokens FROM run JOIN epochs ON e < whole
    UNION ALL SELECT doc_id, domain, lang, source, whole::INT, tokens::BIGINT FROM run WHERE upto <= rest
    """

"""Operator 3: mixing sources to target weights by hash-threshold histograms.

Each document gets a fixed 48-bit hash of its id. A budget of a source turns into a threshold:
the documents whose hash lies below it are taken. The threshold comes from histograms of sizes by
hash digit. One aggregation finds the 4096-wide bucket in which the running sum crosses the
budget; only the documents of that boundary bucket are summed again, by the next 12 bits, four
times in all. Nothing is sorted and no document leaves its place: the decision is a filter
`hash < threshold`. Thresholds of larger budgets hold those of smaller ones (the samples nest). The plan, a row a
source, is broadcast up to BROADCAST_ROWS sources; beyond, documents of a source are dealt over several keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_name, looked_up, named, read_table, written

#: Hash bits, and bits that each histogram resolves.
BITS, STEP = 48, 12
WEIGHTS, SHARE, REPEATS = (5.0, 2.0, 1.0), 1.5, 2.0


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def id_hash(key: Column) -> Column:
    """48 uniform bits of the id as text (null: of the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, weigh `weights` in turn. They share `share` times all
    sizes by weight; a target stops at `repeats` times its source's size and the excess is shared
    again among the others. This water level has a closed form: with sources in order of
    repeats * size / weight, the first k are full, where k is the first rank at which the
    level left for the others lies below their own ratio. The table has one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    full = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(repeats))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    full = full.withColumn("_level", level).withColumn("_open", F.col("_level") <= F.col("_ratio"))
    first = F.min(F.when(F.col("_open"), F.struct("_ratio", "_level"))).over(every)
    water = F.coalesce(first["_level"], F.lit(float("inf")))
    return full.select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * water).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hash thresholds of budgets: (source, budget) to (source, threshold).

    sized: (source, size, h). The documents of a source with h < threshold have at most `budget`
    words, and one more hash value would exceed it; the nearer of the two is chosen. A budget of
    0 or less gives 0. Sources are joined by null-safe equality. budgets: a written table.
    """
    path = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for shift in range(BITS - STEP, -1, -STEP):
        inside = looked_up(sized, path, "source", F.col("d.source").eqNullSafe(F.col("p.source")) & (F.shiftright("d.h", shift + STEP) == F.col("p.prefix")), F.col("h"), most=most)
        histogram = inside.groupBy(F.col("d.source").alias("source"), F.col("p.budget").alias("budget"), F.shiftright("d.h", shift).alias("prefix")).agg(F.sum("d.size").alias("n"), F.first("p.below").alias("base"))
        running = Window.partitionBy("source").orderBy("prefix")
        summed = histogram.withColumn("upto", F.col("base") + F.sum("n").over(running))
        crossing = F.min(F.when(F.col("upto") > F.col("budget"), F.struct("prefix", (F.col("upto") - F.col("n")).alias("below"), "upto")))
        path = written(
            summed.groupBy("source").agg(F.first("budget").alias("budget"), crossing.alias("c")).where(F.col("c").isNotNull())
            .select("source", "budget", F.col("c.prefix").alias("prefix"), F.col("c.below").alias("below"), F.col("c.upto").alias("upto")),
            "mix-level",
        )
    nearer = (F.col("upto") - F.col("budget")) < (F.col("budget") - F.col("below"))
    return path.select("source", (F.col("prefix") + nearer.cast("long")).alias("threshold"))


def mixing_plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, most: int = BROADCAST_ROWS) -> DataFrame:
    """(source, source_size, target, whole, threshold) from (source, size, h): one row a source.

    A source with target T and size S is taken floor(T / S) times whole and once more below the
    threshold of the rest.
    """
    plan = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    cut = thresholds(sized, plan.select("source", "budget"), most)
    plan = plan.alias("p").join(cut.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")), "left").select("p.*", F.coalesce("t.threshold", F.lit(0)).alias("threshold"))
    return written(plan.drop("budget"), "mix-plan")


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, h) of every row, in the shared folder: texts are read once."""
    return written(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), id_hash(F.col(key)).alias("h")), "mix-sizes")


def copies(h: Column) -> Column:
    """How often a document with this hash is taken, beside its source's row of the plan."""
    return F.col("p.whole") + (h < F.col("p.threshold")).cast("long")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, most: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs.

    Null texts have size 0; a null source is a source of its own; a source of size 0 has target 0;
    rows repeated under one id share its hash and fare alike; very long texts are counted whole;
    other columns, whatever their names, are not read. An empty table gives an empty result. Reruns agree: the hash is of the id.
    """
    sized = sizes(docs, key, text, source)
    plan = mixing_plan(sized, weights, share, repeats, most)
    taken = F.col("d.size") * copies(F.col("d.h"))
    return looked_up(sized, plan, "source", F.col("d.source").eqNullSafe(F.col("p.source")), F.col("h"), most=most).select("d.doc_id", "d.size", "p.source_size", "p.target", taken.alias("taken"))


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; the columns of docs, whatever their names. Texts are shuffled only where over `most` sources make the plan too large to broadcast.

    Null and empty texts have size 0 and stand as often as others of their source and hash; a null
    source is a source of its own; rows repeated under one id fare alike; an empty table gives none.
    """
    plan = mixing_plan(sizes(docs, key, text, source), weights, share, repeats, most)
    number = free_name(docs, "_number")
    taken = looked_up(docs, plan, "source", F.col(f"d.`{source}`").eqNullSafe(F.col("p.source")), id_hash(F.col(f"`{key}`")), most=most)
    taken = taken.select("d.*", F.explode(F.array_repeat(F.lit(0), copies(id_hash(F.col(f"d.`{key}`"))).cast("int"))).alias(number))
    return taken.select(*map(named, docs.columns))


def op3_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS w,
         source_size * 2.0::DOUBLE AS cap
  FROM s
), l AS (
  SELECT *, cap / w AS ratio,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r
), t AS (
  SELECT source, source_size, least(cap, w * coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source IS NULL, source LIMIT 1), 'inf'::DOUBLE)) AS target FROM l
), g AS (
  SELECT d.source, d.h, sum(d.size) AS n FROM d GROUP BY ALL
), c AS (
  SELECT g.source, g.h, t.target - floor(t.target / t.source_size) * t.source_size AS budget,
         sum(g.n) OVER (PARTITION BY g.source ORDER BY g.h) AS upto, g.n
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source WHERE t.source_size > 0
), k AS (
  SELECT source, min(h + CASE WHEN upto - budget < budget - (upto - n) THEN 1 ELSE 0 END) AS threshold FROM c WHERE upto > budget GROUP BY source
)
SELECT d.doc_id, d.size, t.source_size, t.target,
       CAST(d.size * (CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END + CASE WHEN d.h < coalesce(k.threshold, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""

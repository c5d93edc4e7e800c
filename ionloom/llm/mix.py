"""Mixing sources to target weights: hash-random order, a range sort within each source, distributed prefix sums, an exact cut.

A source's target is its share of all words by weight, but never over ``cap`` times what the source holds; what a capped
source can't use goes to the others by weight. A source whose target exceeds its size is repeated: whole epochs first,
then the first documents of the hash-random order until the budget is met to the word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix-1:"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> also target. One row per source: small, so a window over all of it is cheap.

    Weights go to the sources in code-point order, null last, and repeat. Ordered by the ratio of cap to weight, the capped
    sources are a prefix: source j is capped when cap_j <= w_j * (total - caps before it) / (weights from it on).
    """
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = reduce(lambda c, i: c.when(F.col("rank") % len(weights) == i, weights[i]), range(1, len(weights)), F.when(F.col("rank") % len(weights) == 0, weights[0]))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = ranked.withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(onward))
    filled = filled.withColumn("capped", F.col("most") * F.col("weights") <= F.col("left") * F.col("weight"))
    first_level = F.first(F.when(~F.col("capped"), F.col("left") / F.col("weights")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = filled.withColumn("level", first_level)
    return filled.select("source", "source_size", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), source.

    Null text has size 0; a null source is a source of its own; repeated rows count each for itself; rows alike in all of
    key, id and size are interchangeable, so ties don't change the result. An empty table gives no rows. Other columns of
    docs are ignored. The range sort deals a hot source over as many tasks as its rows need.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    keyed = keyed.withColumn("key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size")]
    ranged = written(keyed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix")
    parts = ranged.groupBy("source", "part").agg(F.sum("size").alias("words"))
    sizes = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    offsets = parts.withColumn("offset", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = offsets.alias("o").join(source_targets(sizes, weights, cap).alias("t"), F.expr("o.source <=> t.source")).select("o.source", "part", "offset", "source_size", "target")
    plan = plan.withColumn("budget", F.floor("target").cast("long"))
    plan = plan.withColumn("epochs", F.coalesce(F.expr("try_divide(budget - budget % nullif(source_size, 0), source_size)"), F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    joined = ranged.alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source AND r.part = p.part")).select("r.*", "offset", "source_size", "target", "epochs", "rest")
    inside = Window.partitionBy("part", "source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"), "source")


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH keyed AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS BIGINT) AS most FROM keyed GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sizes),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM named),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest_words,
         CAST(sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights
  FROM weighed),
marked AS (SELECT *, most * weights <= rest_words * weight AS capped FROM filled),
levels AS (SELECT max(CASE WHEN NOT capped THEN rest_words / weights END) FILTER (WHERE NOT capped) AS top,
                  arg_min(rest_words / weights, most / weight) FILTER (WHERE NOT capped) AS level FROM marked),
targets AS (SELECT source, source_size, CASE WHEN capped THEN CAST(most AS DOUBLE) ELSE weight * level END AS target FROM marked, levels),
budgets AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget FROM targets),
epochs AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END AS epochs FROM budgets),
ordered AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed)
SELECT o.doc_id, o.size, e.source_size, e.target,
       CAST(e.epochs * o.size + greatest(0, least(o.size, e.budget - e.epochs * e.source_size - o.before)) AS BIGINT) AS taken, o.source
FROM ordered o JOIN epochs e ON o.source IS NOT DISTINCT FROM e.source
"""

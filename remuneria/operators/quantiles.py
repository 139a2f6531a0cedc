"""Exact quantiles per group without one task holding a whole group.

Spark's ``percentile`` aggregate keeps a value -> count map per group and
merges all partial maps of a group in one task. Here instead:

1. count rows per (group, value) -- a partial/final aggregation, so a hot
   group is combined map-side;
2. range-partition the (group, value, count) table on (group, value) and
   compute the running count of every value with per-partition sums plus
   partition offsets (a hot group spans many partitions);
3. per group, find the values at the two positions around p*(n-1) and
   interpolate linearly (same rule as ``percentile`` / pandas / DuckDB
   ``quantile_cont``). The group's start and size are joined on (group,
   range partition), so a hot group stays spread here too.

No step sorts a whole group in one task; the ranked table is written to the
shared folder so partition ids and offsets agree (and survive an executor
loss). NULL and NaN values are missing; a NULL key is a group like any other.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch


def ranked(df: DataFrame, order: Sequence[str], weight: str, partitions: int | None = None) -> DataFrame:
    """Adds ``_cum``, the inclusive running sum of ``weight`` over a TOTAL
    order of ``df``, and ``_pid``, the range partition of the row."""
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) for c in order]
    ranged = df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols).withColumn("_pid", F.spark_partition_id())
    ranged = Scratch(spark, "ranked").save(ranged)
    local = ranged.withColumn("_local", F.sum(weight).over(
        Window.partitionBy("_pid").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)))
    totals = ranged.groupBy("_pid").agg(F.sum(weight).alias("_tot"))
    # one row per partition: the only unpartitioned window is over partition ids
    offsets = totals.select("_pid", F.coalesce(F.sum("_tot").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn("_cum", F.col("_off") + F.col("_local")).drop("_off", "_local"))


def weighted_prefix(df: DataFrame, order: Sequence[str], weight: str, out: str = "_cum",
                    partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``weight`` over a TOTAL order of ``df``."""
    return ranked(df, order, weight, partitions).drop("_pid").withColumnRenamed("_cum", out)


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b["_k_" + k])
    return cond


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles ``{name: p}`` of ``value`` per
    group; one row per group that has a value. Without keys: one row."""
    keys = list(keys)
    v = F.col(value)
    counts = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    r = ranked(counts, [*keys, value], "_w")
    groups = r.groupBy(*keys).agg(F.min(F.col("_cum") - F.col("_w")).alias("_start"), F.sum("_w").alias("_n"),
                                  F.min("_pid").alias("_lo"), F.max("_pid").alias("_hi"))
    groups = groups.select(*[F.col(k).alias("_k_" + k) for k in keys], "_start", "_n",
                           F.explode(F.sequence("_lo", "_hi")).alias("_p"))
    r = r.join(groups, (r["_pid"] == groups["_p"]) & _same(r, groups, keys))
    first = F.col("_cum") - F.col("_w") - F.col("_start")      # 0-based position of the first copy
    past = F.col("_cum") - F.col("_start")                       # one past the last copy
    aggs, finals = [], []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [F.max(F.when((first <= lo) & (lo < past), v)).alias(f"_{name}_lo"),
                 F.max(F.when((first <= hi) & (hi < past), v)).alias(f"_{name}_hi"),
                 F.max(pos).alias(f"_{name}_pos")]
        p_, l_, h_ = F.col(f"_{name}_pos"), F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        finals.append(F.when(F.floor(p_) == F.ceil(p_), l_)
                      .otherwise((F.ceil(p_) - p_) * l_ + (p_ - F.floor(p_)) * h_).alias(name))
    return r.groupBy(*keys).agg(*aggs).select(*keys, *finals)

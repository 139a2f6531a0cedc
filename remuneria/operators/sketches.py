"""Mergeable summaries as stored tables: the explicit, non-exact mode of the
quantile tables (A21, A26, A39, M2, M3) and of distinct entities (A30, A36).

A summary has one row per finest group (month, group). Any coarser group-by
merges rows of that table instead of reading the facts again, and new months
are appended. The exact operators stay the default; a caller asks for these.

* Quantiles: KLL sketches. With parameter ``k`` the rank of a quantile told
  for p lies within ``rank_error(k)`` of p (99 % of the time; a group of up to
  ``k`` values is told exactly), whatever the number of values or merges.
* Distinct counts: theta sketches. Union, intersection and difference of
  stored sketches give entities of a year, entities that stay from month to
  month and those that leave. Up to 2^lg_k entities are counted exactly; above,
  the relative standard error of a union is ``distinct_error(lg_k)``, and an
  intersection has that of its union.

Null and NaN values are no values; a null group is a group; a group without
values has null quantiles; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KLL_K = 400
LG_K = 14


def rank_error(k: int = KLL_K) -> float:
    """Bound of the rank error of one quantile at 99 % confidence, as published for KLL sketches."""
    return 2.296 / k ** 0.9021


def distinct_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a union of theta sketches, as published."""
    return 1 / (2 ** lg_k - 1) ** 0.5


def _number(value: Column | str) -> Column:
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(v), v)


def pay_summary(df: DataFrame, keys: Sequence[str], value: str, k: int = KLL_K) -> DataFrame:
    """keys, n (rows), n_values, total, low, high, sketch: one row per group, to be stored."""
    v = _number(value)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("n_values"), F.sum(v).alias("total"), F.min(v).alias("low"),
        F.max(v).alias("high"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merged_pay(summary: DataFrame, keys: Sequence[str], probs: Mapping[str, float], k: int = KLL_K) -> DataFrame:
    """keys, n, n_values, mean, min, max and one column for each of ``probs``
    {name: p}, from the rows of a ``pay_summary`` whatever its finer keys."""
    some = summary.withColumn("sketch", F.when(F.col("n_values") > 0, F.col("sketch")))
    out = some.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"), F.min("low").alias("min"),
        F.max("high").alias("max"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    told = {name: F.when(F.col("n_values") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p))) for name, p in probs.items()}
    return out.select(*keys, "n", "n_values", F.try_divide("total", "n_values").alias("mean"), "min", "max",
                      *[c.alias(n) for n, c in told.items()])


def merged_five_number(summary: DataFrame, key: str, min_rows: int = 1, k: int = KLL_K) -> DataFrame:
    """The quartile table (A21) of the key's groups with ``min_rows`` rows, by median, from a summary."""
    out = merged_pay(summary, [key], {"q1": 0.25, "median": 0.5, "q3": 0.75}, k)
    return (out.filter((F.col("n") >= min_rows) & F.col(key).isNotNull())
            .select(key, "n", "min", "q1", "median", "q3", "max", "mean").orderBy(F.col("median").asc_nulls_last(), key))


def rank_deviation(df: DataFrame, told: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """keys, name, n_values, deviation: how far p lies outside the exact ranks
    that the values of ``df`` give to the told quantile (0 if inside)."""
    v = _number(value)
    cols = {n: f"__t_{i}" for i, n in enumerate(probs)}
    tk = [F.col(x).alias(f"__k_{i}") for i, x in enumerate(keys)]
    t = told.select(*tk, *[F.col(n).alias(c) for n, c in cols.items()])
    same = F.lit(True)
    for i, x in enumerate(keys):
        same = same & df[x].eqNullSafe(F.col(f"__k_{i}"))
    both = df.join(t, same) if keys else df.withColumns({c: t.select(c).scalar() for c in cols.values()})
    below = both.groupBy(*keys).agg(F.count(v).alias("n_values"), *[
        x for n, c in cols.items() for x in (F.count_if(v < F.col(c)).alias(f"__lt_{n}"), F.count_if(v <= F.col(c)).alias(f"__le_{n}"))])
    one = lambda n, p: F.struct(F.lit(n).alias("name"), F.greatest(
        F.lit(0.0), F.col(f"__lt_{n}") / F.col("n_values") - p, p - F.col(f"__le_{n}") / F.col("n_values")).alias("deviation"))
    return below.filter("n_values > 0").select(*keys, "n_values", F.explode(F.array(*[one(n, p) for n, p in probs.items()])).alias("d")).select(
        *keys, "d.name", "n_values", "d.deviation")


def entity_summary(df: DataFrame, keys: Sequence[str], entity: str, lg_k: int = LG_K) -> DataFrame:
    """keys, sketch: the distinct entities of each group, to be stored."""
    return df.filter(F.col(entity).isNotNull()).groupBy(*keys).agg(
        F.theta_sketch_agg(F.col(entity).cast("string"), F.lit(lg_k)).alias("sketch"))


def merged_entities(summary: DataFrame, keys: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """keys, n_entities: distinct entities of coarser groups."""
    return summary.groupBy(*keys).agg(F.theta_sketch_estimate(F.theta_union_agg("sketch", F.lit(lg_k))).alias("n_entities"))


def month_to_month(summary: DataFrame, month: str, keys: Sequence[str] = (), lg_k: int = LG_K) -> DataFrame:
    """keys, month, n_entities, n_stayed, n_new, n_left, n_both_months: each
    month against the calendar month before (nulls where that isn't there).
    ``month`` is a date, the first of its month."""
    before = summary.select(*[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)],
                            F.add_months(month, 1).alias("__next"), F.col("sketch").alias("__before"))
    same = F.col(month) == F.col("__next")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    now, was = F.col("sketch"), F.col("__before")
    told = lambda e: F.when(was.isNotNull(), F.theta_sketch_estimate(e))
    return summary.join(before, same, "left").select(
        *keys, month, F.theta_sketch_estimate(now).alias("n_entities"), told(F.theta_intersection(now, was)).alias("n_stayed"),
        told(F.theta_difference(now, was)).alias("n_new"), told(F.theta_difference(was, now)).alias("n_left"),
        told(F.theta_union(now, was, F.lit(lg_k))).alias("n_both_months"))

"""Mergeable summaries against exact results."""

import random

from pyspark.sql import functions as F

from remuneria.operators import sketches as K
from remuneria.operators import stats as S

PROBS = {"p01": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}


def test_merged_quantiles_stay_within_the_rank_error(spark):
    # 400,000 values in 400 sketches, one group holds a third of all
    df = spark.range(400_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        (F.col("id") % 50).alias("m"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
    k = 200
    stored = K.pay_summary(df, ["g", "m"], "v", k)
    for keys in (["g"], []):
        told = K.merged_pay(stored, keys, PROBS, k)
        off = K.rank_deviation(df, told, keys, "v", PROBS).collect()
        assert len(off) == len(PROBS) * (8 if keys else 1)
        assert max(r.deviation for r in off) <= K.rank_error(k)
        assert max(r.deviation for r in off) > 0          # it is an approximation


def test_small_groups_are_exact(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(5), rng.choice([None, float("nan"), rng.randrange(100) * 1.0])) for _ in range(300)]
    df = spark.createDataFrame(rows + [("empty", 0, None)], "g string, m int, v double")
    stored = K.pay_summary(df, ["g", "m"], "v")
    told = {r.g: r for r in K.merged_pay(stored, ["g"], {"median": 0.5}).collect()}
    for g in ("a", "b", None):
        v = sorted(x for k, _, x in rows if k == g and x is not None and x == x)
        r = told[g]
        assert (r.n, r.n_values, r.min, r.max) == (sum(k == g for k, _, _ in rows), len(v), v[0], v[-1])
        assert abs(r.mean - sum(v) / len(v)) < 1e-9
        below, upto = sum(x < r["median"] for x in v) / len(v), sum(x <= r["median"] for x in v) / len(v)
        assert below <= 0.5 <= upto
    assert (told["empty"].n, told["empty"].n_values, told["empty"]["median"], told["empty"]["mean"]) == (1, 0, None, None)
    assert K.merged_pay(K.pay_summary(df.filter("false"), ["g", "m"], "v"), ["g"], {"q": 0.5}).collect() == []


def test_five_number_from_a_summary(spark):
    df = spark.range(300).select((F.col("id") % 2).cast("string").alias("g"), (F.col("id") % 9).alias("m"), F.col("id").cast("double").alias("v"))
    got = K.merged_five_number(K.pay_summary(df, ["g", "m"], "v"), "g", min_rows=2).collect()
    exact = S.five_number(df, "g", "v", 2).collect()
    assert [(r.g, r.n, r.min, r["max"], r["mean"]) for r in got] == [(r.g, r.n, r.min, r["max"], r["mean"]) for r in exact]
    for r, e in zip(got, exact):
        assert all(abs(r[c] - e[c]) <= 300 * K.rank_error() + 2 for c in ("q1", "median", "q3"))


def months(spark, n):
    """Entity i is there in month m if (i + m) % 4 != 0."""
    df = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("m")).filter((F.col("id") + F.col("m")) % 4 != 0)
    return df.select(F.add_months(F.lit("2024-11-01").cast("date"), F.col("m")).alias("month"), F.col("id").alias("e"))


def test_entities_exact_below_k_and_bounded_above(spark):
    for n, lg_k in ((1000, 12), (200_000, 10)):
        t = K.entity_summary(months(spark, n), ["month"], "e", lg_k)
        rows = sorted(K.month_to_month(t, "month", lg_k=lg_k).collect())
        total = K.merged_entities(t, [], lg_k).first()[0]
        tolerance = 0 if n < 2 ** lg_k else 4 * K.distinct_error(lg_k)
        assert abs(total - n) <= tolerance * n and len(rows) == 4
        for i, r in enumerate(rows):
            assert abs(r.n_entities - 0.75 * n) <= tolerance * n
            if i == 0:
                assert (r.n_stayed, r.n_new, r.n_left, r.n_both_months) == (None,) * 4
            else:
                for got, want in ((r.n_stayed, 0.5 * n), (r.n_new, 0.25 * n), (r.n_left, 0.25 * n), (r.n_both_months, n)):
                    assert abs(got - want) <= tolerance * n


def test_month_gap_null_entities_and_groups(spark):
    rows = [("2024-01-01", "a", None), ("2024-01-01", "a", "x"), ("2024-02-01", "a", "x"), ("2024-04-01", "a", "x"), ("2024-02-01", None, "z"),
            ("2024-03-01", None, "z"), ("2024-03-01", None, "y")]
    df = spark.createDataFrame(rows, "month string, g string, e string").withColumn("month", F.col("month").cast("date"))
    got = {(r.g, str(r.month)): (r.n_entities, r.n_stayed) for r in K.month_to_month(K.entity_summary(df, ["g", "month"], "e"), "month", ["g"]).collect()}
    assert got == {("a", "2024-01-01"): (1, None), ("a", "2024-02-01"): (1, 1), ("a", "2024-04-01"): (1, None),
                   (None, "2024-02-01"): (1, None), (None, "2024-03-01"): (2, 1)}
    assert K.month_to_month(K.entity_summary(df.filter("false"), ["month"], "e"), "month").collect() == []

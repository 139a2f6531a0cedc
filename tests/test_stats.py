"""Aggregations, ranks and statistics against pandas / numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from remuneria.operators import rank as K
from remuneria.operators import stats as S


def test_average_rank_fixture(spark):
    vals = [5, 7, 7, 1, None, 9, 5]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(vals)], "k int, v double")
    got = dict((r.k, r.rank) for r in K.average_rank(df, "v", "k").collect())
    expected = pd.Series(vals, dtype="float").rank(ascending=False).tolist()
    for i, e in enumerate(expected):
        assert (got[i] is None and np.isnan(e)) or got[i] == e


def test_global_row_number_is_a_permutation(spark):
    rng = np.random.default_rng(1)
    data = [(int(i), float(v)) for i, v in enumerate(rng.integers(0, 20, 3000))]  # many ties
    df = spark.createDataFrame(data, "id long, v double")
    got = K.global_row_number(df, [F.col("v").desc(), F.col("id").asc()], "rn", partitions=7).toPandas()
    ref = pd.DataFrame(data, columns=["id", "v"]).sort_values(["v", "id"], ascending=[False, True])
    ref["rn"] = np.arange(1, len(ref) + 1)
    m = got.merge(ref, on="id", suffixes=("", "_ref"))
    assert (m["rn"] == m["rn_ref"]).all()


def test_five_number_against_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(list("abc"), 500), "v": rng.normal(5000, 900, 500).round(2)})
    pdf.loc[::37, "v"] = np.nan
    pdf.loc[len(pdf)] = ["d", 10.0]          # one-row group, dropped by min_rows=2
    df = spark.createDataFrame(pdf)
    got = S.five_number(df.withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v"))), "g", "v", 2).toPandas()
    assert set(got["g"]) == {"a", "b", "c"}
    for _, r in got.iterrows():
        s = pdf[pdf.g == r.g].v
        assert r.n == len(s)                      # rows, NULLs included
        assert abs(r.q1 - s.quantile(0.25)) < 1e-6
        assert abs(r["median"] - s.median()) < 1e-6
        assert abs(r.q3 - s.quantile(0.75)) < 1e-6
        assert abs(r["mean"] - s.mean()) < 1e-6
    assert list(got["median"]) == sorted(got["median"])


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(3000, 700, 101)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = S.histogram(df, "v", 30).orderBy("bin").toPandas()
    counts, _ = np.histogram(v, bins=30)
    assert list(got["n"]) == list(counts)
    assert got["n"].sum() == 101


def test_std_single_row_is_null_and_mode_tie(spark):
    df = spark.createDataFrame([("x", 3.0)], "k string, v double")
    assert df.agg(F.stddev_samp("v")).first()[0] is None
    t = spark.createDataFrame([(c,) for c in "baba"], "s string")
    assert S.dominant(t, "s").first()["dominant"] == "a"


def test_share_and_scaled(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    got = {r.k: (r.n, r.pct) for r in S.share(df, "k").collect()}
    assert got == {"a": (2, 66.6667), "b": (1, 33.3333)}
    agg = spark.createDataFrame([("x", 50.0), ("y", 200.0)], "k string, m double")
    sc = {r.k: r.m_scaled for r in S.scaled_to_max(agg, ["m"]).collect()}
    assert sc == {"x": 25.0, "y": 100.0}


def test_corr_matrix_pairwise_complete(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, 4.0, None], "b": [2.0, 4.1, 6.2, 7.9, 5.0], "c": [1.0] * 5})
    df = spark.createDataFrame(pdf)
    m = {(r.var_a, r.var_b): r.r for r in S.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert abs(m[("a", "b")] - pdf[["a", "b"]].corr().loc["a", "b"]) < 1e-6
    assert m[("a", "c")] is None                      # zero variance -> NULL, not an error


def test_top_k_per_group_hot_group(spark):
    # one group holds most rows; the salted pre-selection must not change the answer
    data = [("hot", i, float(i % 97)) for i in range(5000)] + [("cold", i, float(i)) for i in range(10)]
    df = spark.createDataFrame(data, "g string, id int, v double")
    got = K.top_k_per_group(df, "g", [F.col("v").desc(), F.col("id").asc()], 3, salt_buckets=8, salt_col="id")
    res = sorted((r.g, r.rank_in_group, r.id) for r in got.collect())
    pdf = pd.DataFrame(data, columns=["g", "id", "v"]).sort_values(["g", "v", "id"], ascending=[True, False, True])
    exp = sorted((g, i + 1, int(x)) for g, grp in pdf.groupby("g") for i, x in enumerate(grp.id.head(3)))
    assert res == exp


def test_dedup_first(spark):
    df = spark.createDataFrame([("abc", "one", 2), ("abc", "two", 1), ("ab", "x", 0), ("zzz", "q", 5)],
                               "slug string, nombre string, p int")
    got = sorted(tuple(r) for r in K.dedup_first(df, "slug", ["p"], min_key_len=2).select("slug", "nombre").collect())
    assert got == [("abc", "two"), ("zzz", "q")]


def test_word_freq_top_share(spark):
    rows = [(i, "gerente general" if i < 5 else "analista junior", float(100 - i)) for i in range(25)]
    df = spark.createDataFrame(rows, "id long, t string, v double")
    got = {r.word: r.n for r in S.word_freq(df, "t", "v", "id", 0.2, 15, 4).collect()}
    assert got == {"gerente": 5, "general": 5}

"""Stored layouts: what the plans promise, and the same results."""

import pytest
from pyspark.sql import functions as F

from remuneria.plans import q_stored as Q
from remuneria.operators import payroll as P
from remuneria.sources import bindings as B
from remuneria.sources import stored as ST

SF = "/root/testdata/sf0.001"


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_periods_prune_folders(spark, tmp_path):
    rows = [(y, f"{y}{m:02d}", y * 100 + m) for y in (2023, 2024) for m in range(1, 13 if y == 2023 else 4)] + [(2024, None, 1)]
    df = spark.createDataFrame(rows, "year int, PERIODO string, v int")
    ST.store_payroll(df, str(tmp_path / "p"))
    read = lambda latest: ST.read_payroll(spark, str(tmp_path / "p"), latest, df.schema)
    assert sorted(r.v for r in read("year").collect()) == [202312, 202403]
    assert [r.v for r in read("all").collect()] == [202403]
    assert read(None).count() == len(rows)
    p = plan(read("year"))
    assert "dynamicpruning" in p.lower() and "PartitionFilters: [isnotnull" in p
    with pytest.raises(ValueError):
        read("month")
    ST.store_payroll(df.filter("false"), str(tmp_path / "none"))
    assert ST.read_payroll(spark, str(tmp_path / "none"), "year", df.schema).count() == 0


def test_stored_snapshot_equals_the_source(spark):
    got = Q.stored_payroll_timeline(spark, SF)
    want = P.payroll_kpis(P.active_snapshot(B.payroll(spark, SF), year="year"), ["year"], with_units=False, digits=0)
    assert sorted(got.collect()) == sorted(want.collect())


def test_bucketed_join_and_groups_need_no_exchange(spark):
    for build in (Q.stored_company_gaps, Q.stored_company_bubbles):
        p = plan(build(spark, SF))
        assert "Exchange" not in p and "SortMergeJoin" in p and "Bucketed: true" in p


def test_sql_functions_take_parameters(spark):
    rows = [(i, None if i == 3 else f"2024-01-{i:02d} 00:00:00") for i in range(1, 9)]
    spark.createDataFrame(rows, "k long, t string").select("k", F.col("t").cast("timestamp").alias("t")).createOrReplaceTempView("few")
    assert len(ST.register_functions(spark, "few", "k", "t")) == 4
    ids = lambda q: [r.k for r in spark.sql(q).collect()]
    assert sorted(ids("SELECT k FROM few_newest(2)")) == [7, 8] and len(ids("SELECT k FROM few_newest(99)")) == 8
    assert ids("SELECT k FROM few_newest(0)") == [] and spark.sql("SELECT few_rows() AS n").first().n == 8
    a = ids("SELECT k FROM few_sample(3, 'a')")
    assert len(a) == 3 and sorted(a) == sorted(ids("SELECT k FROM few_sample(3, 'a')"))
    assert sorted(ids("SELECT k FROM few_between(TIMESTAMP'2024-01-02', TIMESTAMP'2024-01-05')")) == [2, 4]
    assert [tuple(r) for r in ST.described(spark, "few").collect()] == [("k", "bigint", 8, 0), ("t", "timestamp", 8, 1)]
    assert [tuple(r) for r in ST.counted(spark, ["few"]).collect()] == [("few", 2, 8)]

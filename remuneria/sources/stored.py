"""Canonical tables stored once in the layout that their questions need
(J5, W5, H5: folders by period; J1, W2, A25: buckets by company; S16: SQL
functions over views).

* Payroll lies in folders by year and period, beside a table with one row per
  period that says which are the latest of their year and of all. A reader that
  wants those joins the facts with that table, so Spark prunes the folders when
  the query runs (dynamic partition pruning); the facts are never asked for
  their latest period.
* Postings lie in buckets by company, sorted, and so does the table of company
  figures; group-bys and joins on the company need no shuffle.
* ``register_functions`` gives a view parameterised SQL functions.

A null period is in no snapshot; null companies are grouped and joined as
nulls of a bucket; empty tables are stored as such.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rulesets as RS
from . import sinks


def store_payroll(payroll: DataFrame, path: str, year: str = "year", period: str = "PERIODO") -> None:
    """Folders by year and period below ``path``/facts, the periods at ``path``/periods."""
    spark = payroll.sparkSession
    # a period's rows meet in a few files instead of one per task and period
    payroll.repartition(year, period).write.partitionBy(year, period).parquet(f"{path}/facts")
    facts = spark.read.schema(payroll.schema).parquet(f"{path}/facts")
    # a row per period: the windows run on a table that doesn't grow with the facts
    periods = facts.filter(F.col(period).isNotNull()).groupBy(year, period).agg(F.count(F.lit(1)).alias("n_rows"))
    # 0 or 1: Spark takes a comparison with a number for selective, not a bare boolean
    latest = lambda *by: (F.col(period) == F.max(period).over(Window.partitionBy(*by))).cast("int")
    periods.withColumns({"of_year": latest(year), "of_all": latest()}).coalesce(1).write.parquet(f"{path}/periods")


def read_payroll(spark: SparkSession, path: str, latest: str | None = None, schema=None, year: str = "year",
                 period: str = "PERIODO") -> DataFrame:
    """The stored facts; ``latest``: only the last period of each 'year' or of 'all'."""
    facts = (spark.read.schema(schema) if schema is not None else spark.read).parquet(f"{path}/facts")
    if latest is None:
        return facts
    if latest not in ("year", "all"):
        raise ValueError(f"latest is 'year', 'all' or None, not {latest!r}")
    periods = spark.read.parquet(f"{path}/periods").filter(f"of_{latest} = 1").select(
        F.col(year).alias("__year"), F.col(period).alias("__period"))
    # one row per year at most: bounded, and a broadcast is what prunes the folders
    same = (facts[year] == F.col("__year")) & (facts[period] == F.col("__period"))
    return facts.join(F.broadcast(periods), same).drop("__year", "__period")


def active(snapshot: DataFrame, state: str = RS.ACTIVE_STATE, types: Sequence[str] = tuple(RS.ACTIVE_TYPES)) -> DataFrame:
    """R28 on a snapshot: occupied posts of the active types."""
    return snapshot.filter((F.col("ESTADO_REGISTRO") == state) & F.col("DESC_TIPO_REGISTRO").isin(list(types)))


def store_by_company(postings: DataFrame, name: str, path: str, value: str, buckets: int = 64, company: str = "empresa") -> None:
    """Tables ``name`` (the postings) and ``name``_companies (company, size,
    mean value), both in the same number of buckets by company, sorted."""
    sinks.write_table(postings, name, bucket_by=[company], buckets=buckets, sort_by=[company], path=f"{path}/postings")
    stored = postings.sparkSession.table(name)
    sizes = stored.groupBy(company).agg(F.count(F.lit(1)).alias("empresa_size"), F.avg(value).alias("empresa_mean"))
    sinks.write_table(sizes, f"{name}_companies", bucket_by=[company], buckets=buckets, sort_by=[company], path=f"{path}/companies")


def with_company(spark: SparkSession, name: str, company: str = "empresa") -> DataFrame:
    """The stored postings with their company's figures: a join of equal buckets, without a shuffle."""
    return spark.table(name).join(spark.table(f"{name}_companies").hint("merge"), company)


def register_functions(spark: SparkSession, view: str, key: str, ts: str) -> list[str]:
    """SQL functions over a view: ``<view>_rows()``, the number of rows;
    ``<view>_newest(n)``, the n newest rows (ties by key); ``<view>_sample(n,
    seed)``, n rows by the hash of seed and key; ``<view>_between(a, b)``, the
    rows of a span of time. Returns their names."""
    table = spark.table(view)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    names = ", ".join(f"`{c}`" for c in table.columns)
    ts_type = dict(table.dtypes)[ts]

    def first(order: str) -> str:
        # a row number against a constant: each task keeps its first rows only
        return f"SELECT {names} FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS __nth FROM {view}) WHERE __nth <= n"

    bodies = {
        f"{view}_rows()": ("BIGINT", f"SELECT count(*) FROM {view}"),
        f"{view}_newest(n INT)": (f"TABLE({columns})", first(f"`{ts}` DESC NULLS LAST, `{key}`")),
        f"{view}_sample(n INT, seed STRING)": (f"TABLE({columns})", first(f"md5(concat(seed, cast(`{key}` AS STRING))), `{key}`")),
        f"{view}_between(a {ts_type}, b {ts_type})": (f"TABLE({columns})", f"SELECT {names} FROM {view} WHERE `{ts}` >= a AND `{ts}` < b")}
    for head, (returns, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {returns} RETURN {body}")
    return [h.split("(")[0] for h in bodies]


def described(spark: SparkSession, view: str) -> DataFrame:
    """Column, type, n_rows and n_null of each column of a view, from one pass."""
    table = spark.table(view)
    one = table.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(table.columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"c{i}")).alias("n_null"))
            for i, (c, t) in enumerate(table.dtypes)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def counted(spark: SparkSession, views: Sequence[str]) -> DataFrame:
    """Name, n_columns, n_rows of each view."""
    out = None
    for v in views:
        t = spark.table(v)
        one = t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(v).alias("name"), F.lit(len(t.columns)).alias("n_columns"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out

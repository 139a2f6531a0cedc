"""Writers (survey K1-K8). Every sink is a distributed write from all
partitions; nothing is collected to the driver or funnelled into one task
(no ``coalesce(1)``): a "file" is a folder of part files."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import jdbc_options  # noqa: F401  (re-exported for writers)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",",
              partition_by: Sequence[str] = ()) -> None:
    """K1 / K6 (sep='\\t'): CSV with a header; optionally one folder per
    value of ``partition_by`` (e.g. payroll by year)."""
    w = df.write.mode(mode).option("header", True).option("sep", sep)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Default store (parquet), optionally partitioned (e.g. payroll by year:
    queries on one year then prune the other folders)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_table(df: DataFrame, name: str, mode: str = "overwrite", bucket_by: Sequence[str] = (),
                buckets: int = 64, sort_by: Sequence[str] = (), path: str | None = None) -> None:
    """K2: replace a catalog table. The study's secondary indexes become
    bucketing + sorting: later joins/aggregations on the bucket columns
    skip the shuffle, and sorted files give tight row-group statistics for
    filter pushdown."""
    w = df.write.mode(mode).format("parquet")
    if path:
        w = w.option("path", path)
    if bucket_by:
        w = w.bucketBy(buckets, *bucket_by)
        if sort_by:
            w = w.sortBy(*sort_by)
    w.saveAsTable(name)


def postings_for_sql(df: DataFrame) -> DataFrame:
    """K3 casts: DECIMAL(10,2) salaries, DATE dates, TIMESTAMP extraction."""
    casts = {c: F.col(c).cast("decimal(10,2)") for c in ("salario_minimo", "salario_maximo", "salario_promedio")
             if c in df.columns}
    for c in ("fecha_inicio", "fecha_fin"):
        if c in df.columns:
            casts[c] = F.col(c).cast("date")
    if "fecha_extraccion" in df.columns:
        casts["fecha_extraccion"] = F.col("fecha_extraccion").cast("timestamp")
    return df.withColumns(casts)


def write_jdbc(df: DataFrame, options: Mapping[str, str], truncate: bool = True) -> None:
    """K3: truncate + bulk insert (keeps the target DDL) over JDBC, from
    every partition in parallel."""
    opts = dict(options)
    opts["truncate"] = "true" if truncate else "false"
    postings_for_sql(df).write.mode("overwrite").format("jdbc").options(**opts).save()


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4 / K5 / K8: JSON lines."""
    df.write.mode(mode).json(path)


def write_json_datasets(frames: Mapping[str, DataFrame], base: str, mode: str = "overwrite") -> list[str]:
    """K4 / K5: one JSON dataset per aggregate (kpis, por_regimen, ...), the
    distributed form of the study's single nested file."""
    out = []
    for name, df in frames.items():
        p = f"{base.rstrip('/')}/{name}"
        df.write.mode(mode).json(p)
        out.append(p)
    return out


def write_company_list(companies: DataFrame, base: str, as_of: str, source: str = "", mode: str = "overwrite") -> None:
    """K6: the company list as JSON rows and as TSV, and its metadata (number
    of companies, extraction date, source) as a JSON dataset beside it.
    ``as_of`` is a parameter, never the clock."""
    meta = companies.agg(F.count(F.lit(1)).alias("total_empresas")).select(
        "total_empresas", F.lit(as_of).alias("fecha_extraccion"), F.lit(source).alias("fuente"))
    write_json(meta, f"{base}/metadata", mode)
    write_json(companies, f"{base}/empresas", mode)
    write_csv(companies, f"{base}/tsv", mode, sep="\t")


def read_company_list(spark, base: str) -> DataFrame:
    """The rows of ``write_company_list`` with their metadata."""
    meta = spark.read.schema("total_empresas long, fecha_extraccion string, fuente string").json(f"{base}/metadata")
    one = meta.select(F.struct(*meta.columns)).scalar()
    rows = spark.read.schema("slug string, nombre string").json(f"{base}/empresas")
    return rows.select("*", *[one[c].alias(c) for c in meta.columns])


def write_atom(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K7: Atom entries as XML (the XML writer escapes the text)."""
    (entries.write.mode(mode).format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path))

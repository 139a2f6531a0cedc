"""Readers for the canonical tables (survey S1-S7, S15, S16) and the
postings cleaning step (C1, C2).

Every reader declares its schema (no inference pass over the data), reads
text columns that may hold junk as STRING and coerces them with the guarded
``to_number`` (C1), and keeps malformed records in a ``_corrupt_record``
column instead of failing the job (the study skips a bad file and goes on;
quarantining the bad rows is the row-level version of that).
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..functions import text as X

S = T.StringType()

# The column names of the input files.

POSTINGS_RAW = T.StructType([T.StructField(c, S) for c in (
    "empresa", "puesto", "salario_minimo", "salario_maximo", "salario_promedio", "moneda",
    "universidad_principal", "url_empresa", "fecha_inicio", "fecha_fin", "fecha_extraccion")])

CALLS_RAW = T.StructType([T.StructField(c, S) for c in (
    "institucion", "puesto", "departamento", "salario", "fecha_limite", "url", "fecha_extraccion")])

HISTORY_RAW = T.StructType(list(CALLS_RAW.fields) + [
    T.StructField("primera_vez_visto", S), T.StructField("ultima_vez_visto", S), T.StructField("estado", S)])

PAYROLL_COLUMNS = (
    "PERIODO", "EJERCICIO", "MES", "NIVEL", "SECTOR", "PLIEGO", "UNIDAD_EJECUTORA", "DESC_TIPO_REGISTRO",
    "ESTADO_REGISTRO", "DESC_REGIMEN_LABORAL", "DESC_GRUPO_OCASIONAL", "DESC_CONDICION_LABORAL",
    "DESC_REGIMEN_PENSIONARIO", "CANTIDAD", "ING_IMPONIBLE_PERM_MENSUAL", "ING_NO_IMPONIBLE_PERM_MENSUAL",
    "INCENTIVO_UNICO_MENSUAL", "COSTO_TOTAL_ANUAL")
PAYROLL_NUMERIC = {"EJERCICIO": "int", "CANTIDAD": "int", "ING_IMPONIBLE_PERM_MENSUAL": "double",
                   "ING_NO_IMPONIBLE_PERM_MENSUAL": "double", "INCENTIVO_UNICO_MENSUAL": "double",
                   "COSTO_TOTAL_ANUAL": "double"}
PAYROLL_RAW = T.StructType([T.StructField(c, S) for c in PAYROLL_COLUMNS] + [T.StructField("_corrupt_record", S)])

CATALOG = T.StructType([T.StructField("slug", S), T.StructField("nombre", S), T.StructField("url_completa", S)])


def _csv(spark: SparkSession, schema: T.StructType, path: str | Sequence[str], **opts) -> DataFrame:
    """CSV with a header, columns taken by NAME: the file may hold them in any
    order and among others; a column that it lacks is NULL. Files read
    together must share one header (Spark checks it, rather than shifting
    values silently). A partition column of the folder passes through."""
    header = spark.read.option("header", True).csv(path)
    found = {c.strip().lstrip("\ufeff").upper(): c for c in header.columns}
    corrupt = opts.get("columnNameOfCorruptRecord")
    wanted = [f.name for f in schema.fields if f.name != corrupt]
    in_path = {f.name for f in header.schema.fields if f.dataType != S}  # partition values are typed
    file_schema = [T.StructField(c, S) for c in header.columns if c not in in_path]
    if corrupt:
        file_schema.append(T.StructField(corrupt, S))
    r = (spark.read.schema(T.StructType(file_schema)).option("header", True).option("mode", "PERMISSIVE")
         .option("enforceSchema", False))
    for k, v in opts.items():
        r = r.option(k, v)
    df = r.csv(path)
    cols = [F.col(f"`{found[c.upper()]}`").alias(c) if c.upper() in found else F.lit(None).cast("string").alias(c) for c in wanted]
    rest = [c for c in df.columns if c in in_path and c not in wanted] + ([corrupt] if corrupt else [])
    return df.select(*cols, *rest, "_metadata.file_name")


def clean_postings(df: DataFrame) -> DataFrame:
    """C1 + C2: salaries to numbers (junk -> NULL), company trimmed and
    title-cased, role trimmed, dates typed (bad text -> NULL). Works on any
    frame with the postings columns (S3: accept an existing DataFrame)."""
    cols = set(df.columns)
    out = df
    for c in ("salario_minimo", "salario_maximo", "salario_promedio"):
        if c in cols:
            out = out.withColumn(c, X.to_number(c))
    if "empresa" in cols:
        out = out.withColumn("empresa", X.clean_company("empresa"))
    if "puesto" in cols:
        out = out.withColumn("puesto", F.trim("puesto"))
    for c in ("fecha_inicio", "fecha_fin"):
        if c in cols:
            out = out.withColumn(c, F.to_date(F.try_to_timestamp(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")))))
    if "fecha_extraccion" in cols:
        out = out.withColumn("fecha_extraccion", F.try_to_timestamp(F.col("fecha_extraccion").cast("string")))
    return out


def read_postings(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv") -> DataFrame:
    """Postings file(s) -> cleaned postings. ``fmt='parquet'`` reads a
    stored table (the default store; S2 over JDBC is ``read_postings_jdbc``)."""
    raw = _csv(spark, POSTINGS_RAW, path).drop("file_name") if fmt == "csv" else spark.read.format(fmt).load(path)
    return clean_postings(raw)


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None,
                 partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
                 num_partitions: int | None = None, extra: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options for a parallel JDBC read/write. Credentials come from the
    caller (never from code); with a partition column the read is split
    into ``num_partitions`` range queries instead of one connection."""
    o = {"url": url, "dbtable": table}
    if user is not None:
        o["user"] = user
    if password is not None:
        o["password"] = password
    if partition_column:
        o.update({"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
                  "numPartitions": str(num_partitions or 8)})
    o.update(extra or {})
    return o


def read_postings_jdbc(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """The whole ``salarios`` table over JDBC (parallel when
    ``options`` carry a partition column), then the same cleaning."""
    return clean_postings(spark.read.format("jdbc").options(**options).load())


def _files(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a glob, in whatever store the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in (fs.globStatus(p) or []))


def read_payroll(spark: SparkSession, folder: str, pattern: str = "PERSONALSP_*.csv",
                 columns: Sequence[str] | None = None, year_from: str = "file_name",
                 malformed: bool = False) -> DataFrame:
    """S4 + S5: every yearly payroll file at once, columns by name (each file
    may have its own order). The year comes from the file name (files whose
    name has no year are skipped) or, with ``year_from='partition'``, from
    ``year=YYYY`` folders (partition discovery; a filter on year then prunes
    folders). Numbers are coerced (junk -> NULL); PERIODO/MES stay text. Only
    ``columns`` are kept. Malformed records are left out; ``malformed=True``
    returns them instead (year and ``_corrupt_record``), for quarantine."""
    bad = {"columnNameOfCorruptRecord": "_corrupt_record"}
    if year_from == "partition":
        out = _csv(spark, PAYROLL_RAW, folder, **bad)
    else:
        out = None
        for path in _files(spark, f"{folder.rstrip('/')}/{pattern}"):  # one file a year
            one = _csv(spark, PAYROLL_RAW, path, **bad)
            out = one if out is None else out.unionByName(one)
        if out is None:
            out = spark.createDataFrame([], T.StructType([*PAYROLL_RAW.fields, T.StructField("file_name", S)]))
        year = F.regexp_extract(F.col("file_name"), r"_(\d+)\.csv$", 1)
        out = out.withColumn("year", F.nullif(year, F.lit("")).try_cast("int"))
    out = out.filter(F.col("year").isNotNull())
    if malformed:
        return out.filter(F.col("_corrupt_record").isNotNull()).select("year", "file_name", "_corrupt_record", *PAYROLL_COLUMNS)
    out = out.filter(F.col("_corrupt_record").isNull())
    for c, t in PAYROLL_NUMERIC.items():
        out = out.withColumn(c, X.to_number(c).try_cast(t))
    keep = list(columns) if columns else list(PAYROLL_COLUMNS)
    return out.select(*keep, "year")


def read_calls(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Public calls with the salary coerced."""
    raw = _csv(spark, CALLS_RAW, path).drop("file_name")
    return raw.withColumn("salario", X.to_number("salario")).withColumn(
        "fecha_extraccion", F.try_to_timestamp("fecha_extraccion"))


def read_history(spark: SparkSession, path: str | Sequence[str]) -> DataFrame | None:
    """Call history with DATE columns; ``None`` when the file is absent
    (the history is optional)."""
    try:
        raw = _csv(spark, HISTORY_RAW, path).drop("file_name")
    except AnalysisException:
        return None
    d = lambda c: F.to_date(F.try_to_timestamp(F.nullif(F.trim(c), F.lit(""))))
    return (raw.withColumn("salario", X.to_number("salario"))
            .withColumn("primera_vez_visto", d(F.col("primera_vez_visto")))
            .withColumn("ultima_vez_visto", d(F.col("ultima_vez_visto"))))


def read_catalog(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A company catalogue (slug, nombre, url_completa)."""
    if fmt == "csv":
        return _csv(spark, CATALOG, path).drop("file_name")
    return spark.read.schema(CATALOG).format(fmt).load(path)


def union_catalogs(*catalogs: DataFrame) -> DataFrame:
    """Several catalogues as one (same columns by name)."""
    out = catalogs[0]
    for c in catalogs[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def catalog_by_sector(catalog: DataFrame, words: Sequence[str]) -> DataFrame:
    """Catalogue rows whose name or slug holds one of the words."""
    from ..functions.rules import matches
    return catalog.filter(matches([F.col("nombre"), F.col("slug")], words))


# ---------------------------------------------------------------- S16
def register_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> list[str]:
    """Canonical tables as temp views for ad-hoc SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return sorted(t.name for t in spark.catalog.listTables())


def describe(spark: SparkSession, view: str) -> DataFrame:
    return spark.sql(f"DESCRIBE {view}")


def newest(spark: SparkSession, view: str, ts: str = "fecha_extraccion", n: int = 5, tiebreak: str | None = None) -> DataFrame:
    """Newest n rows (a total order when ``tiebreak`` is given)."""
    order = f"{ts} DESC" + (f", {tiebreak}" if tiebreak else "")
    return spark.sql(f"SELECT * FROM {view} ORDER BY {order} LIMIT {int(n)}")

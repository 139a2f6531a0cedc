"""Driver tables -> canonical tables (survey §7.3).

The analytic operators take canonical column names (postings, calls,
calls history, observations, payroll). These bindings derive those tables
from the TPC-H-like driver tables with joins and projections only; every
query therefore reads the whole driver tables and its work grows with them.

Joins are left to the optimizer: dimension tables (part, supplier,
customer, nation, region) are broadcast by AQE only when their measured
size is under ``spark.sql.autoBroadcastJoinThreshold``; otherwise they are
sort-merge joined on their key. Only the columns each query uses reach the
parquet scan (column pruning through the projections).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private postings: one row per line item.
    empresa=s_name, puesto=p_name, sector=p_type, universidad=p_brand,
    salario_promedio=l_extendedprice (min/max from discount/tax),
    fecha_inicio=date(l_shipdate); posting_id is unique (tie-break)."""
    li = table(spark, sf_dir, "lineitem")
    pa = table(spark, sf_dir, "part")
    su = table(spark, sf_dir, "supplier")
    j = li.join(pa, li.l_partkey == pa.p_partkey).join(su, li.l_suppkey == su.s_suppkey)
    return j.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("posting_id"),
        F.col("s_name").alias("empresa"),
        F.col("p_name").alias("puesto"),
        F.col("p_type").alias("sector"),
        F.col("p_brand").alias("universidad_principal"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("salario_minimo"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("salario_maximo"),
        F.col("l_extendedprice").alias("salario_promedio"),
        F.lit("PEN").alias("moneda"),
        F.to_date("l_shipdate").alias("fecha_inicio"),
        F.col("l_shipdate").alias("fecha_extraccion"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public job calls: one row per line item.
    institucion = region + supplier name, puesto=p_name, departamento =
    supplier nation, salario = l_extendedprice / 10, url unique per line."""
    li = table(spark, sf_dir, "lineitem")
    pa = table(spark, sf_dir, "part")
    su = table(spark, sf_dir, "supplier")
    na = table(spark, sf_dir, "nation")
    re_ = table(spark, sf_dir, "region")
    j = (li.join(pa, li.l_partkey == pa.p_partkey).join(su, li.l_suppkey == su.s_suppkey)
         .join(na, su.s_nationkey == na.n_nationkey).join(re_, na.n_regionkey == re_.r_regionkey))
    return j.select(
        F.concat_ws(" ", F.col("r_name"), F.col("s_name")).alias("institucion"),
        F.col("p_name").alias("puesto"),
        F.col("n_name").alias("departamento"),
        (F.col("l_extendedprice") / 10).alias("salario"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("fecha_limite"),
        F.concat(F.lit("http://calls/"), F.col("l_orderkey").cast("string"), F.lit("/"),
                 F.col("l_linenumber").cast("string")).alias("url"),
        F.col("l_shipdate").alias("fecha_extraccion"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily call observations (Z1 input): one row per event.
    url = user + event type, seen_date = date(ts)."""
    ev = table(spark, sf_dir, "events")
    return observations_from_events(ev)


def observations_from_events(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.concat(F.lit("http://calls/u"), F.col("user_id").cast("string"), F.lit("/"),
                 F.col("event_type")).alias("url"),
        F.to_date("ts").alias("seen_date"),
        F.col("ts").alias("seen_ts"),
        F.concat(F.lit("Entidad "), F.col("user_id").cast("string")).alias("institucion"),
        F.col("event_type").alias("puesto"),
        F.lit("LIMA").alias("departamento"),
        (F.col("value") * 100).alias("salario"),
        F.date_format(F.date_add(F.to_date("ts"), 7), "dd/MM/yyyy").alias("fecha_limite"),
    )


def payroll_snapshot(spark: SparkSession, sf_dir: str, by_year: bool = False,
                     flags: tuple[str, ...] = ("R", "A")) -> DataFrame:
    """J5 + R28 on the source tables: the payroll rows of the latest month (of
    each year with ``by_year``) with active state and type. The month comes
    from the line items alone, before any join, and the month, state and type
    filters stand on the scanned columns."""
    li = table(spark, sf_dir, "lineitem")
    active = li.filter((F.col("l_linestatus") == "O") & F.col("l_returnflag").isin(*flags))
    if by_year:
        months = li.groupBy(F.year("l_shipdate").alias("_y")).agg(F.trunc(F.max("l_shipdate"), "month").alias("_m"))
        # one row per year: bounded by the number of years, safe to broadcast
        active = active.join(F.broadcast(months.select("_m")), F.trunc("l_shipdate", "month") == F.col("_m"), "left_semi")
    else:
        latest = li.agg(F.trunc(F.max("l_shipdate"), "month")).scalar()
        active = active.filter(F.col("l_shipdate") >= latest.cast("timestamp_ntz"))
    return payroll(spark, sf_dir, active)


def payroll(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Government payroll: one row per line item (of ``lines`` when given).
    PERIODO=yyyyMM of ship date, year; ESTADO from line status ('O' ->
    OCUPADO); type from return flag (R -> Activos, A -> CAS, N ->
    Pensionistas); CANTIDAD=quantity; incomes from price, discount, tax;
    regime=order priority, SECTOR=market segment, PLIEGO=nation,
    NIVEL=region, unit=supplier, group=part type."""
    li = table(spark, sf_dir, "lineitem") if lines is None else lines
    od = table(spark, sf_dir, "orders")
    cu = table(spark, sf_dir, "customer")
    na = table(spark, sf_dir, "nation")
    re_ = table(spark, sf_dir, "region")
    pa = table(spark, sf_dir, "part")
    j = (li.join(od, li.l_orderkey == od.o_orderkey).join(cu, od.o_custkey == cu.c_custkey)
         .join(na, cu.c_nationkey == na.n_nationkey).join(re_, na.n_regionkey == re_.r_regionkey)
         .join(pa, li.l_partkey == pa.p_partkey))
    price = F.col("l_extendedprice")
    return j.select(
        F.date_format("l_shipdate", "yyyyMM").alias("PERIODO"),
        F.year("l_shipdate").alias("year"),
        F.year("l_shipdate").alias("EJERCICIO"),
        F.date_format("l_shipdate", "MM").alias("MES"),
        F.col("r_name").alias("NIVEL"),
        F.col("c_mktsegment").alias("SECTOR"),
        F.col("n_name").alias("PLIEGO"),
        F.col("l_suppkey").cast("string").alias("UNIDAD_EJECUTORA"),
        F.when(F.col("l_returnflag") == "R", F.lit("Activos"))
         .when(F.col("l_returnflag") == "A", F.lit("Contrato Administrativo de Servicios"))
         .otherwise(F.lit("Pensionistas")).alias("DESC_TIPO_REGISTRO"),
        F.when(F.col("l_linestatus") == "O", F.lit("OCUPADO")).otherwise(F.lit("VACANTE")).alias("ESTADO_REGISTRO"),
        F.col("o_orderpriority").alias("DESC_REGIMEN_LABORAL"),
        F.col("p_type").alias("DESC_GRUPO_OCASIONAL"),
        F.col("l_quantity").cast("int").alias("CANTIDAD"),
        price.alias("ING_IMPONIBLE_PERM_MENSUAL"),
        (price * F.col("l_discount")).alias("ING_NO_IMPONIBLE_PERM_MENSUAL"),
        (price * F.col("l_tax")).alias("INCENTIVO_UNICO_MENSUAL"),
        (price * 12).alias("COSTO_TOTAL_ANUAL"),
    )


CANONICAL = {"postings": postings, "calls": calls, "observations": observations, "payroll": payroll}
LAYOUT = {"payroll": ["year"]}


def materialize(spark: SparkSession, sf_dir: str, out_dir: str, names=tuple(CANONICAL),
                mode: str = "overwrite") -> dict[str, str]:
    """Write the canonical tables once as parquet (payroll partitioned by
    year, so the latest-period filter prunes folders). Production runs read
    these instead of re-joining the source tables in every query."""
    paths = {}
    for name in names:
        df = CANONICAL[name](spark, sf_dir)
        w = df.write.mode(mode)
        if name in LAYOUT:
            w = w.partitionBy(*LAYOUT[name])
        path = f"{out_dir.rstrip('/')}/{name}"
        w.parquet(path)
        paths[name] = path
    return paths

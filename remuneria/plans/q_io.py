"""Round trips through the sinks and readers (survey S1 S4-S7 K1 K2 K4-K8 C1 C2).

Each query writes a canonical table derived from the driver tables to a
fresh folder under the shared checkpoint folder with a sink, reads it back
with the matching reader, and computes a figure whose oracle is computed
from the original tables. The work grows with the tables. These queries write
while they are built; only reading back is lazy.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import payroll as P
from ..operators import rank as K
from ..operators import stats as S
from ..session import Scratch
from ..sources import bindings as B
from ..sources import many_files as MF
from ..sources import readers as RD
from ..sources import sinks as SK
from .registry import query
from .q_history import FEED_SQL
from .q_payroll import _DEPT_CASE as DEPARTMENT_CASE
from .q_payroll import BIND_DEPARTMENTS
from .sql_bindings import CALLS, HEADS, HISTORY, ING_PROM, PAYROLL, POSTINGS

_TITLE_SQL = ("list_aggregate(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)'), "
              "lambda t: upper(t[1]) || lower(t[2:])), 'string_agg', '')")


def _scratch(spark, tag):
    return Scratch(spark, tag).root  # deleted when the driver ends


@query("io_postings_csv_roundtrip", "K1 S1 C1 C2", f"""WITH {POSTINGS}
SELECT {_TITLE_SQL.format(x="lower(empresa)")} AS empresa, count(*) AS n, round(sum(salario_promedio), 2) AS total,
       round(avg(salario_promedio), 4) AS mean FROM postings GROUP BY 1""")
def io_postings_csv_roundtrip(spark, sf):
    p = B.postings(spark, sf).select(
        F.lower("empresa").alias("empresa"), "puesto", F.col("salario_minimo").cast("string").alias("salario_minimo"),
        F.col("salario_maximo").cast("string").alias("salario_maximo"),
        F.col("salario_promedio").cast("string").alias("salario_promedio"), "moneda",
        "universidad_principal", F.lit(None).cast("string").alias("url_empresa"),
        F.col("fecha_inicio").cast("string").alias("fecha_inicio"), F.lit("").alias("fecha_fin"),
        F.col("fecha_extraccion").cast("string").alias("fecha_extraccion"))
    path = _scratch(spark, "postings-csv")
    SK.write_csv(p, path)
    back = RD.read_postings(spark, path)          # title-cases empresa, coerces the salaries
    return back.groupBy("empresa").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("salario_promedio"), 2).alias("total"),
                                       F.round(F.avg("salario_promedio"), 4).alias("mean"))


@query("io_payroll_partitioned_roundtrip", "K1 S4 S5 H5 J5", f"""WITH {PAYROLL}
SELECT year, {HEADS} AS total_servidores, round({ING_PROM}, 0) AS ingreso_promedio_mensual,
       round(sum(coalesce(COSTO_TOTAL_ANUAL, 0)), 0) AS costo_total_anual,
       count(DISTINCT PLIEGO) AS n_pliegos
FROM snap_year GROUP BY year""")
def io_payroll_partitioned_roundtrip(spark, sf):
    pay = B.payroll(spark, sf)
    path = _scratch(spark, "payroll-csv")
    # a wider file than needed, columns as text in another order
    names = sorted(RD.PAYROLL_COLUMNS, key=lambda c: c[::-1])
    text = pay.select(F.lit("x").alias("OTRA"), *[(F.col(c) if c in pay.columns else F.lit(None)).cast("string").alias(c)
                                                 for c in names], F.lit("y").alias("NOTA"), "year")
    SK.write_csv(text, path, partition_by=["year"])
    back = RD.read_payroll(spark, path, year_from="partition")
    return P.timeline(P.active_snapshot(back, year="year"))["kpis"]


@query("io_json_datasets_roundtrip", "K4 H5", f"""WITH {PAYROLL}
SELECT year, DESC_REGIMEN_LABORAL, {HEADS} AS cantidad, round({ING_PROM}, 0) AS ing_prom
FROM snap_year GROUP BY year, DESC_REGIMEN_LABORAL""")
def io_json_datasets_roundtrip(spark, sf):
    tl = P.timeline(B.payroll_snapshot(spark, sf, by_year=True), materialize=True)
    base = _scratch(spark, "timeline-json")
    SK.write_json_datasets(tl, base)
    back = spark.read.schema(tl["por_regimen"].schema).json(os.path.join(base, "por_regimen"))
    return back


# ------------------------------------------------------------------ every dataset of K4, K5, K8
def _read_back(spark, frames, tag):
    """Write each dataset as JSON and read it back with its schema."""
    base = _scratch(spark, tag)
    SK.write_json_datasets(frames, base)
    return {n: spark.read.schema(f.schema).json(f"{base}/{n}") for n, f in frames.items()}


def _long(frames, key_of):
    """(dataset, key, n, value) rows of several small datasets."""
    out = None
    for name, df in frames.items():
        key, n, value = key_of[name]
        one = df.select(F.lit(name).alias("dataset"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key"),
                        F.col(n).cast("bigint").alias("n"), F.col(value).cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


_GROUPS = {"por_regimen": ["DESC_REGIMEN_LABORAL"], "por_sector": ["SECTOR"], "por_grupo_ocupacional": ["DESC_GRUPO_OCASIONAL"],
           "top_pliegos": ["PLIEGO"], "por_nivel": ["NIVEL"], "por_depto": ["depto"],
           "sector_x_regimen": ["SECTOR", "DESC_REGIMEN_LABORAL"], "pliegos_burbujas": ["PLIEGO"]}
_HAVING = {"sector_x_regimen": 20, "pliegos_burbujas": 40}


def _k4_sql():
    parts = [f"""SELECT 'kpis' AS dataset, (SELECT max(PERIODO) FROM payroll) AS key, {HEADS} AS n, round({ING_PROM}, 2) AS value FROM snap"""]
    for name, keys in _GROUPS.items():
        having = f"HAVING {HEADS} >= {_HAVING[name]}" if name in _HAVING else ""
        where = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        top = "ORDER BY 3 DESC, 2 LIMIT 30" if name == "top_pliegos" else ""
        parts.append(f"(SELECT '{name}', concat_ws('|', {', '.join(keys)}), {HEADS}, round({ING_PROM}, 4) FROM d WHERE {where} GROUP BY {', '.join(keys)} {having} {top})")
    parts.append(f"""SELECT 'pliegos_search', concat_ws('|', substr(PLIEGO, 1, 120), NIVEL, SECTOR), {HEADS}, round({ING_PROM}, 0)
FROM d GROUP BY PLIEGO, NIVEL, SECTOR HAVING {HEADS} >= 5""")
    return f"WITH {PAYROLL}, d AS (SELECT *, {DEPARTMENT_CASE} AS depto FROM snap) " + " UNION ALL ".join(parts)


@query("io_payroll_snapshot_datasets", "K4 A30 A32 A33 A34 A35 A36", _k4_sql())
def io_payroll_snapshot_datasets(spark, sf):
    """The ten-part snapshot output: KPIs with the period, and nine lists."""
    snap = B.payroll_snapshot(spark, sf).withColumn("depto", P.department_of("PLIEGO", BIND_DEPARTMENTS))
    frames = P.snapshot_datasets(snap, _GROUPS, _HAVING)
    frames["top_pliegos"] = K.top_n(frames["top_pliegos"], [F.col("cantidad").desc(), F.col("PLIEGO").asc()], 30)
    keys = {n: (k, "cantidad", "ing_prom") for n, k in _GROUPS.items()}
    keys["kpis"] = (["periodo"], "total_servidores", "ingreso_promedio_mensual")
    keys["pliegos_search"] = (["n", "l", "s"], "c", "i")
    return _long(_read_back(spark, frames, "snapshot-json"), keys)


_V = "salario_promedio"


@query("io_endpoint_datasets", "K5 A1 A5 A9 T1", f"""WITH {POSTINGS}
SELECT 'stats' AS dataset, 'total' AS key, count(*) AS n, round(avg({_V}), 2) AS value FROM postings
UNION ALL (SELECT 'empresas', empresa, count(*), round(avg({_V}), 2) FROM postings GROUP BY empresa ORDER BY avg({_V}) DESC, empresa LIMIT 20)
UNION ALL SELECT 'sectores', sector, count(*), round(avg({_V}), 2) FROM postings GROUP BY sector
UNION ALL (SELECT 'puestos', puesto || '|' || empresa || '|' || posting_id, 1, {_V} FROM postings ORDER BY {_V} DESC NULLS LAST, posting_id LIMIT 50)""")
def io_endpoint_datasets(spark, sf):
    """stats, top 20 companies, all sectors, top 50 postings."""
    p = B.postings(spark, sf)
    mean = {"n": F.count(F.lit(1)), "mean": F.avg(_V)}
    cut = lambda df: df.withColumn("mean", F.round("mean", 2))
    frames = {
        "stats": cut(S.aggregate(p, [], mean)),
        "empresas": cut(S.group_stats(p, "empresa", mean, order=[F.col("mean").desc()], limit=20)),
        "sectores": cut(S.group_stats(p, "sector", mean)),
        "puestos": K.top_n(p, [F.col(_V).desc_nulls_last(), F.col("posting_id").asc()], 50).select("puesto", "empresa", "posting_id", _V)}
    back = _read_back(spark, frames, "endpoints-json")
    back["stats"] = back["stats"].withColumn("key", F.lit("total"))
    back["puestos"] = back["puestos"].withColumn("n", F.lit(1))
    return _long(back, {"stats": (["key"], "n", "mean"), "empresas": (["empresa"], "n", "mean"), "sectores": (["sector"], "n", "mean"),
                        "puestos": (["puesto", "empresa", "posting_id"], "n", _V)})


@query("io_stats_dataset", "K8 A1 R4", f"""WITH {POSTINGS}
SELECT count(DISTINCT empresa) AS total_empresas, count(DISTINCT puesto) AS total_puestos, count(*) AS total_registros,
       count(DISTINCT sector) AS total_sectores, round(avg({_V}), 2) AS salario_promedio, round(max({_V}), 2) AS salario_maximo FROM postings""")
def io_stats_dataset(spark, sf):
    """The statistics file of the front end."""
    p = B.postings(spark, sf)
    one = S.aggregate(p, [], {
        "total_empresas": S.distinct_count("empresa"), "total_puestos": S.distinct_count("puesto"), "total_registros": F.count(F.lit(1)),
        "total_sectores": S.distinct_count("sector"), "salario_promedio": F.round(F.avg(_V), 2), "salario_maximo": F.round(F.max(_V), 2)})
    return _read_back(spark, {"stats": one}, "stats-json")["stats"]


@query("io_company_list", "K6 S15 U2", f"""
WITH c AS (SELECT lower(replace(s_name, '#', '-')) AS slug, s_name AS nombre FROM supplier)
SELECT 'json' AS kind, slug, nombre, (SELECT count(*) FROM c) AS total_empresas, '2024-01-31' AS fecha_extraccion FROM c
UNION ALL SELECT 'tsv', slug, nombre, NULL, NULL FROM c""")
def io_company_list(spark, sf):
    """Company list with metadata as JSON, and as TSV; both read back."""
    su = B.table(spark, sf, "supplier")
    c = su.select(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("slug"), F.col("s_name").alias("nombre"))
    base = _scratch(spark, "companies")
    SK.write_company_list(c, base, as_of="2024-01-31")
    back = SK.read_company_list(spark, base)
    tsv = spark.read.schema("slug string, nombre string").option("header", True).option("sep", "\t").csv(f"{base}/tsv")
    return (back.select(F.lit("json").alias("kind"), "slug", "nombre", "total_empresas", "fecha_extraccion")
            .unionByName(tsv.withColumn("kind", F.lit("tsv")), allowMissingColumns=True))


@query("io_atom_feed", "K7 H2 H3", FEED_SQL)
def io_atom_feed(spark, sf):
    """The feed written as XML and read back."""
    from .q_history import AS_OF, _hist
    entries = H.feed_entries(H.recent(_hist(spark, sf), AS_OF, days=14, limit=200), AS_OF)
    path = _scratch(spark, "atom")
    SK.write_atom(entries, path)
    return spark.read.schema(entries.schema).format("xml").option("rowTag", "entry").load(path).select(*entries.columns)


@query("io_table_replaced", "K2", f"""WITH {POSTINGS}
SELECT empresa, count(*) AS n, round(sum({_V}), 2) AS total FROM postings GROUP BY empresa""")
def io_table_replaced(spark, sf):
    """A catalog table replaced twice, bucketed by company, read back by name."""
    name, path = f"postings_{uuid.uuid4().hex[:8]}", _scratch(spark, "table")
    p = B.postings(spark, sf).select("empresa", _V)
    for rows in (p.filter("empresa is null"), p):
        SK.write_table(rows, name, bucket_by=["empresa"], buckets=8, sort_by=["empresa"], path=path)
    return spark.table(name).groupBy("empresa").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(_V), 2).alias("total"))


@query("io_calls_csv_roundtrip", "S6 K1 C1", f"""WITH {CALLS}
SELECT departamento, count(*) AS n, round(sum(salario), 2) AS total, count(DISTINCT url) AS n_urls FROM calls GROUP BY departamento""")
def io_calls_csv_roundtrip(spark, sf):
    """Public calls as a wider CSV in another column order, with an accented value, read by name."""
    c = B.calls(spark, sf)
    path = _scratch(spark, "calls-csv")
    SK.write_csv(c.select(F.lit("á").alias("extra"), "url", F.col("salario").cast("string").alias("salario"), "departamento", "puesto",
                          "institucion", "fecha_limite"), path)
    back = RD.read_calls(spark, path)  # the file lacks fecha_extraccion
    return back.groupBy("departamento").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("salario"), 2).alias("total"),
                                            F.count_distinct("url").alias("n_urls"))


@query("io_history_csv_roundtrip", "S7 K1 A37", f"""WITH {HISTORY}
SELECT estado, count(*) AS n, CAST(min(primera_vez_visto) AS VARCHAR) AS first_seen, CAST(max(ultima_vez_visto) AS VARCHAR) AS last_seen,
       round(sum(salario), 2) AS total FROM hist GROUP BY estado""")
def io_history_csv_roundtrip(spark, sf):
    from .q_history import _hist
    h = _hist(spark, sf)
    path = _scratch(spark, "history-csv")
    SK.write_csv(h.select(*[F.col(c).cast("string").alias(c) for c in reversed(h.columns)]), path)
    back = RD.read_history(spark, path)
    return back.groupBy("estado").agg(F.count(F.lit(1)).alias("n"), F.min("primera_vez_visto").cast("string").alias("first_seen"),
                                      F.max("ultima_vez_visto").cast("string").alias("last_seen"), F.round(F.sum("salario"), 2).alias("total"))


@query("sql_views_newest", "S16 T5", f"""WITH {POSTINGS}
SELECT count(*) OVER () AS n_rows, posting_id, empresa, puesto
FROM postings ORDER BY fecha_extraccion DESC, posting_id LIMIT 5""")
def sql_views_newest(spark, sf):
    """The canonical table registered as a view and queried with SQL
    (count + newest rows, the study's ad-hoc checks)."""
    view = f"postings_{uuid.uuid4().hex[:8]}"
    RD.register_views(spark, {view: B.postings(spark, sf)})
    return spark.sql(f"""SELECT (SELECT count(*) FROM {view}) AS n_rows, posting_id, empresa, puesto
                         FROM {view} ORDER BY fecha_extraccion DESC, posting_id LIMIT 5""")


@query("io_payroll_files", "S5 S4", f"""WITH {PAYROLL},
f AS (SELECT year, SECTOR, CANTIDAD FROM payroll WHERE year <> 1995)
SELECT year::VARCHAR AS year, SECTOR, count(*) AS n, sum(CANTIDAD)::BIGINT AS cantidad FROM f GROUP BY ALL
UNION ALL SELECT 'columns missing: CANTIDAD', NULL, 1, NULL""")
def io_payroll_files(spark, sf):
    """Yearly files in three column orders, one year without a needed column: the rest in one scan, that year listed.
    A year is as many files as tasks write it, so that no task holds a year."""
    pay = B.payroll(spark, sf).select("year", "PERIODO", "SECTOR", F.col("CANTIDAD").cast("string").alias("CANTIDAD"), F.lit("x, y").alias("NOTA"))
    scratch = Scratch(spark, "payroll-files")
    path = f"{scratch.root}/csv"
    pay = scratch.save(pay)   # joined once for the four writes
    orders = (["PERIODO", "SECTOR", "NOTA", "CANTIDAD"], ["NOTA", "CANTIDAD", "SECTOR", "PERIODO"], ["SECTOR", "CANTIDAD", "PERIODO"])
    for i, order in enumerate(orders):
        SK.write_csv(pay.filter((F.col("year") % 3 == i) & (F.col("year") != 1995)).select("year", *order), f"{path}/o{i}", partition_by=["year"])
    SK.write_csv(pay.filter("year = 1995").select("year", "PERIODO", "SECTOR"), f"{path}/o3", partition_by=["year"])
    rows, refused = MF.read_by_name(spark, f"{path}/o*/year=*/*.csv", ["PERIODO", "SECTOR", "CANTIDAD"], "PERIODO", r"year=(\d+)/")
    n = rows.groupBy("year", "SECTOR").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("CANTIDAD").cast("bigint")).alias("cantidad"))
    years = refused.select("reason", F.regexp_extract("path", r"year=(\d+)/", 1).alias("y")).distinct()
    return n.withColumn("year", F.col("year").cast("string")).unionByName(years.groupBy(F.col("reason").alias("year")).agg(
        F.lit(None).cast("string").alias("SECTOR"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("bigint").alias("cantidad")))

"""Payroll queries (survey J5 W5 R25 R28 A11 A30-A36 H5 C11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import payroll as P
from ..operators import stats as S
from ..sources import bindings as B
from .registry import query
from .sql_bindings import HEADS, ING_PROM, PAYROLL

# Binding departments: the driver's entity names are NATION_<n>; listing
# NATION_1..NATION_9 keeps the study's first-substring semantics visible
# (NATION_1 also hits NATION_10..NATION_19, as ICA hits REPUBLICA).
BIND_DEPARTMENTS = [f"NATION_{i}" for i in range(1, 10)]


def _snap_year(spark, sf):
    return B.payroll_snapshot(spark, sf, by_year=True)


def _snap(spark, sf):
    return B.payroll_snapshot(spark, sf)


@query("payroll_income_by_regime_year", "J5 W5 R28 A31 A32 H5", f"""
WITH {PAYROLL}
SELECT year, DESC_REGIMEN_LABORAL, {HEADS} AS cantidad, round({ING_PROM}, 0) AS ing_prom
FROM snap_year GROUP BY year, DESC_REGIMEN_LABORAL""")
def payroll_income_by_regime_year(spark, sf):
    return P.timeline(_snap_year(spark, sf))["por_regimen"]


@query("payroll_timeline_kpis", "H5 A30 A31 C11", f"""
WITH {PAYROLL}
SELECT year, {HEADS} AS total_servidores, round({ING_PROM}, 0) AS ingreso_promedio_mensual,
       round(sum(coalesce(COSTO_TOTAL_ANUAL, 0)), 0) AS costo_total_anual,
       count(DISTINCT PLIEGO) AS n_pliegos
FROM snap_year GROUP BY year""")
def payroll_timeline_kpis(spark, sf):
    return P.timeline(_snap_year(spark, sf))["kpis"]


@query("payroll_timeline_top_sectors", "H5 W3", f"""
WITH {PAYROLL},
agg AS (SELECT year, SECTOR, {HEADS} AS cantidad, round({ING_PROM}, 0) AS ing_prom
        FROM snap_year GROUP BY year, SECTOR)
SELECT year, SECTOR, cantidad, ing_prom, rank_in_group FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY cantidad DESC, SECTOR) AS INTEGER) AS rank_in_group
  FROM agg) WHERE rank_in_group <= 20""")
def payroll_timeline_top_sectors(spark, sf):
    return P.timeline(_snap_year(spark, sf), top_sectors=20)["por_sector"]


@query("payroll_timeline_by_group", "H5", f"""
WITH {PAYROLL}
SELECT year, DESC_GRUPO_OCASIONAL, {HEADS} AS cantidad, round({ING_PROM}, 0) AS ing_prom
FROM snap_year GROUP BY year, DESC_GRUPO_OCASIONAL""")
def payroll_timeline_by_group(spark, sf):
    return P.timeline(_snap_year(spark, sf))["por_grupo"]


@query("payroll_kpis_latest", "J5 R28 A30 A31", f"""
WITH {PAYROLL}
SELECT {HEADS} AS total_servidores, round({ING_PROM}, 2) AS ingreso_promedio_mensual,
       round(sum(coalesce(COSTO_TOTAL_ANUAL, 0)), 2) AS costo_total_anual,
       count(DISTINCT PLIEGO) AS n_pliegos, count(DISTINCT UNIDAD_EJECUTORA) AS n_unidades_ejecutoras
FROM snap""")
def payroll_kpis_latest(spark, sf):
    return P.payroll_kpis(_snap(spark, sf))


def _by_sql(key, having=""):
    return f"""
WITH {PAYROLL}
SELECT {key}, {HEADS} AS cantidad, round({ING_PROM}, 4) AS ing_prom
FROM snap WHERE {key} IS NOT NULL GROUP BY {key} {having}"""


@query("payroll_by_regime", "A32", _by_sql("DESC_REGIMEN_LABORAL"))
def payroll_by_regime(spark, sf):
    return P.payroll_by(_snap(spark, sf), ["DESC_REGIMEN_LABORAL"])


@query("payroll_by_sector", "A32", _by_sql("SECTOR"))
def payroll_by_sector(spark, sf):
    return P.payroll_by(_snap(spark, sf), ["SECTOR"])


@query("payroll_by_group", "A32", _by_sql("DESC_GRUPO_OCASIONAL"))
def payroll_by_group(spark, sf):
    return P.payroll_by(_snap(spark, sf), ["DESC_GRUPO_OCASIONAL"])


@query("payroll_by_entity", "A32", _by_sql("PLIEGO"))
def payroll_by_entity(spark, sf):
    return P.payroll_by(_snap(spark, sf), ["PLIEGO"])


@query("payroll_by_level", "A32", _by_sql("NIVEL"))
def payroll_by_level(spark, sf):
    return P.payroll_by(_snap(spark, sf), ["NIVEL"])


_DEPT_CASE = "CASE " + " ".join(
    f"WHEN contains(upper(PLIEGO), '{d}') THEN '{d}'" for d in BIND_DEPARTMENTS) + " END"


@query("payroll_by_department", "R25 A33", f"""
WITH {PAYROLL}, d AS (SELECT *, {_DEPT_CASE} AS depto FROM snap)
SELECT depto, {HEADS} AS cantidad, round({ING_PROM}, 4) AS ing_prom
FROM d WHERE depto IS NOT NULL GROUP BY depto""")
def payroll_by_department(spark, sf):
    return P.payroll_by_department(_snap(spark, sf), "PLIEGO", BIND_DEPARTMENTS)


@query("payroll_sector_regime", "A34", f"""
WITH {PAYROLL}
SELECT SECTOR, DESC_REGIMEN_LABORAL, {HEADS} AS cantidad, round({ING_PROM}, 4) AS ing_prom
FROM snap GROUP BY SECTOR, DESC_REGIMEN_LABORAL HAVING {HEADS} >= 20""")
def payroll_sector_regime(spark, sf):
    return P.payroll_by(_snap(spark, sf), ["SECTOR", "DESC_REGIMEN_LABORAL"], min_heads=20)


@query("payroll_entity_list", "A35 C12", f"""
WITH {PAYROLL}
SELECT substr(PLIEGO, 1, 120) AS n, NIVEL AS l, SECTOR AS s, {HEADS} AS c,
       round({ING_PROM}, 0) AS i
FROM snap GROUP BY PLIEGO, NIVEL, SECTOR HAVING {HEADS} >= 5""")
def payroll_entity_list(spark, sf):
    return P.entity_list(_snap(spark, sf), min_heads=5)


@query("payroll_large_entities", "A36 T2", f"""
WITH {PAYROLL},
agg AS (SELECT PLIEGO, {HEADS} AS cantidad, round({ING_PROM}, 4) AS ing_prom
        FROM snap GROUP BY PLIEGO)
SELECT * FROM agg WHERE cantidad >= 40 ORDER BY cantidad DESC, PLIEGO LIMIT 30""")
def payroll_large_entities(spark, sf):
    agg = P.payroll_by(_snap(spark, sf), ["PLIEGO"], min_heads=40)
    return agg.orderBy(F.col("cantidad").desc(), F.col("PLIEGO").asc()).limit(30)


@query("payroll_record_types", "A11 R28", f"""
WITH {PAYROLL}, latest AS (SELECT * FROM payroll WHERE PERIODO = (SELECT max(PERIODO) FROM payroll)
                           AND ESTADO_REGISTRO = 'OCUPADO'),
c AS (SELECT DESC_TIPO_REGISTRO, count(*) AS n FROM latest GROUP BY DESC_TIPO_REGISTRO)
SELECT DESC_TIPO_REGISTRO, n, round(n * 100.0 / (SELECT sum(n) FROM c), 4) AS pct FROM c""")
def payroll_record_types(spark, sf):
    latest = B.payroll_snapshot(spark, sf, flags=("R", "A", "N"))
    return S.share(latest, "DESC_TIPO_REGISTRO")

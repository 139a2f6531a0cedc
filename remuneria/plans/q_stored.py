"""Queries on stored canonical tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import payroll as P
from ..operators import stats as S
from ..session import Scratch
from ..sources import bindings as B
from ..sources import stored as ST
from .q_postings import MEAN4
from .registry import query
from .sql_bindings import CALLS, HEADS, ING_PROM, PAYROLL, POSTINGS

V = "salario_promedio"


def stored_payroll(spark, sf, latest):
    pay = B.payroll(spark, sf).drop("EJERCICIO", "MES")
    path = Scratch(spark, "stored-payroll").root
    ST.store_payroll(pay, path)
    return ST.active(ST.read_payroll(spark, path, latest, pay.schema))


@query("stored_payroll_timeline", "J5 W5 H5 R28", f"""WITH {PAYROLL}
SELECT year, {HEADS} AS total_servidores, round({ING_PROM}, 0) AS ingreso_promedio_mensual,
       round(sum(coalesce(COSTO_TOTAL_ANUAL, 0)), 0) AS costo_total_anual, count(DISTINCT PLIEGO) AS n_pliegos
FROM snap_year GROUP BY year""")
def stored_payroll_timeline(spark, sf):
    """The yearly figures from folders by period, pruned when the query runs."""
    return P.payroll_kpis(stored_payroll(spark, sf, "year"), ["year"], with_units=False, digits=0)


@query("stored_payroll_latest", "J5 A32", f"""WITH {PAYROLL}
SELECT PERIODO, SECTOR, {HEADS} AS cantidad, round({ING_PROM}, 4) AS ing_prom FROM snap GROUP BY ALL""")
def stored_payroll_latest(spark, sf):
    return P.payroll_by(stored_payroll(spark, sf, "all"), ["PERIODO", "SECTOR"])


def stored_postings(spark, sf):
    name = f"postings_{uuid.uuid4().hex[:8]}"
    ST.store_by_company(B.postings(spark, sf).select("posting_id", "empresa", "sector", V), name, Scratch(spark, "stored-postings").root, V, buckets=8)
    return name


@query("stored_company_gaps", "J1 W2", f"""WITH {POSTINGS},
c AS (SELECT empresa, count(*) AS empresa_size, avg({V}) AS m FROM postings GROUP BY empresa)
SELECT empresa, empresa_size, count_if({V} > m) AS n_above, round(max({V} - m), 4) AS most_above FROM postings JOIN c USING (empresa) GROUP BY ALL""")
def stored_company_gaps(spark, sf):
    """Postings against their company's figures: a join and a group-by of equal buckets, no shuffle."""
    p = ST.with_company(spark, stored_postings(spark, sf))
    gap = F.col(V) - F.col("empresa_mean")
    return p.groupBy("empresa", "empresa_size").agg(F.count_if(gap > 0).alias("n_above"), F.round(F.max(gap), 4).alias("most_above"))


@query("stored_company_bubbles", "A25", f"""WITH {POSTINGS},
c AS (SELECT empresa, count(*) AS num_empleados FROM postings GROUP BY empresa)
SELECT empresa, sector, {MEAN4} AS salario_avg, num_empleados, count(*) AS num_puestos
FROM postings JOIN c USING (empresa) GROUP BY ALL""")
def stored_company_bubbles(spark, sf):
    p = ST.with_company(spark, stored_postings(spark, sf))
    return p.groupBy("empresa", "sector").agg(S.mean_of_cents(V).alias("salario_avg"), F.max("empresa_size").alias("num_empleados"),
                                              F.count(F.lit(1)).alias("num_puestos"))


def _view(spark, sf):
    view = f"postings_{uuid.uuid4().hex[:8]}"
    B.postings(spark, sf).select("posting_id", "empresa", "puesto", V, "fecha_extraccion").createOrReplaceTempView(view)
    ST.register_functions(spark, view, "posting_id", "fecha_extraccion")
    return view


@query("sql_function_newest", "S16 T5", f"""WITH {POSTINGS}
SELECT posting_id, empresa, puesto, (SELECT count(*) FROM postings) AS n_rows FROM postings ORDER BY fecha_extraccion DESC, posting_id LIMIT 5""")
def sql_function_newest(spark, sf):
    v = _view(spark, sf)
    return spark.sql(f"SELECT posting_id, empresa, puesto, {v}_rows() AS n_rows FROM {v}_newest(5)")


@query("sql_function_sample", "S16", f"""WITH {POSTINGS}
SELECT posting_id, empresa, {V} FROM postings ORDER BY md5('s' || posting_id), posting_id LIMIT 3""")
def sql_function_sample(spark, sf):
    v = _view(spark, sf)
    return spark.sql(f"SELECT posting_id, empresa, {V} FROM {v}_sample(3, 's')")


@query("sql_function_between", "S16", f"""WITH {POSTINGS}
SELECT empresa, count(*) AS n FROM postings WHERE fecha_extraccion >= '1995-01-01' AND fecha_extraccion < '1996-01-01' GROUP BY empresa""")
def sql_function_between(spark, sf):
    v = _view(spark, sf)
    kind = dict(spark.table(v).dtypes)["fecha_extraccion"].upper()
    return spark.sql(f"""SELECT empresa, count(*) AS n FROM {v}_between(CAST('1995-01-01' AS {kind}), CAST('1996-01-01' AS {kind})) GROUP BY empresa""")


@query("sql_describe", "S16", f"""WITH {POSTINGS},
c AS (SELECT count(*) AS n, count(posting_id) AS a, count(empresa) AS b, count(puesto) AS c, count({V}) AS d, count(fecha_extraccion) AS e FROM postings)
SELECT unnest(['posting_id', 'empresa', 'puesto', '{V}', 'fecha_extraccion']) AS "column",
       unnest(['bigint', 'string', 'string', 'double', 'timestamp_ntz']) AS type, n AS n_rows, unnest([n - a, n - b, n - c, n - d, n - e]) AS n_null FROM c""")
def sql_describe(spark, sf):
    return ST.described(spark, _view(spark, sf))


@query("sql_tables", "S16", f"""WITH {POSTINGS}, {CALLS}
SELECT 'canonical_calls' AS name, 7 AS n_columns, count(*) AS n_rows FROM calls UNION ALL SELECT 'canonical_postings', 11, count(*) FROM postings
UNION ALL SELECT 'canonical_observations', 8, count(*) FROM events""")
def sql_tables(spark, sf):
    """The registered canonical tables with their size."""
    names = {f"canonical_{n}": f(spark, sf) for n, f in B.CANONICAL.items() if n != "payroll"}
    for n, df in names.items():
        df.createOrReplaceTempView(n)
    return ST.counted(spark, sorted(names))

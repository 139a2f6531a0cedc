"""Private-postings queries (survey A1-A27, A39-A43, R1-R20, R26, R27, C1, C2,
C8-C10, C16, C21, J1, J2, J4, U3, U5, W1, W2, T1, T5, X1-X5, M1, M2, M4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import rnd

from ..functions import matcher as X
from ..functions import rules as R
from ..functions import rulesets as RS
from ..functions import scopes as SC
from ..functions import text as T
from ..operators import grid as G
from ..operators import rank as K
from ..operators import stats as S
from ..sources import bindings as B
from . import bind_rules as BR
from .registry import query
from .sql_bindings import POSTINGS
from .sql_rules import any_of, case, in_list, q

W = f"WITH {POSTINGS}"
V = "salario_promedio"
#: Mean of cents, half up at four digits, in whole numbers.
MEAN4 = f"((2 * sum(CAST(round({V} * 100) AS HUGEINT)) * 100 + count({V})) // (2 * count({V})) / 10000.0)"


def _p(spark, sf):
    return B.postings(spark, sf)


def r4(c):
    return rnd(c, 4)


# ------------------------------------------------------------------ KPIs
@query("kpi_summary", "A1 S3", f"""{W}
SELECT count(*) AS n_rows, count(DISTINCT empresa) AS n_empresas, count(DISTINCT puesto) AS n_puestos,
       count(DISTINCT sector) AS n_sectores, round(avg({V}), 4) AS mean, round(median({V}), 4) AS median,
       round(min({V}), 4) AS min, round(max({V}), 4) AS max, round(stddev_samp({V}), 4) AS std,
       round(sum({V}), 2) AS total FROM postings""")
def kpi_summary(spark, sf):
    k = S.kpis(_p(spark, sf), V, {"n_empresas": "empresa", "n_puestos": "puesto", "n_sectores": "sector"}, digits=4)
    return k.withColumn("total", rnd("total", 2))


@query("kpi_percentiles", "A2", f"""{W}
SELECT round(quantile_cont({V}, 0.25), 4) AS p25, round(quantile_cont({V}, 0.75), 4) AS p75,
       round(stddev_samp({V}), 4) AS std FROM postings""")
def kpi_percentiles(spark, sf):
    p = _p(spark, sf)
    return S.aggregate(p, [], {"p25": r4(S.quantile(V, 0.25)), "p75": r4(S.quantile(V, 0.75)),
                               "std": r4(F.stddev_samp(V))})


_TI = any_of("puesto", BR.TI_WORDS)
_MGR = any_of("puesto", BR.MANAGER_WORDS)
_SALES = f"({any_of('puesto', BR.SALES_WORDS)} AND NOT {_MGR})"
_TRAINEE = f"coalesce(regexp_matches(lower(puesto), {q(BR.TRAINEE_REGEX)}), false)"


def _flag_sql(name, cond):
    return (f"count_if({cond}) AS total_{name}, "
            f"round(coalesce(avg(CASE WHEN {cond} THEN {V} END), 0), 4) AS promedio_{name}")


@query("kpi_by_flags", "A24 R10 R11 R12", f"""{W}
SELECT {_flag_sql('ti', _TI)}, {_flag_sql('ventas_marketing', _SALES)},
       {_flag_sql('gerencial', _MGR)}, {_flag_sql('no_gerencial', 'NOT ' + _MGR)},
       {_flag_sql('practicantes', _TRAINEE)} FROM postings""")
def kpi_by_flags(spark, sf):
    p = _p(spark, sf)
    flags = {
        "ti": R.flag("puesto", BR.TI_WORDS),
        "ventas_marketing": R.flag("puesto", BR.SALES_WORDS, none_of=BR.MANAGER_WORDS),
        "gerencial": R.flag("puesto", BR.MANAGER_WORDS),
        "no_gerencial": ~R.flag("puesto", BR.MANAGER_WORDS),
        "practicantes": F.coalesce(F.lower("puesto").rlike(BR.TRAINEE_REGEX), F.lit(False)),
    }
    aggs = []
    for n, c in flags.items():
        aggs += [F.count_if(c).alias(f"total_{n}"),
                 r4(F.coalesce(F.avg(F.when(c, F.col(V))), F.lit(0.0))).alias(f"promedio_{n}")]
    return p.agg(*aggs)


# ------------------------------------------------------------------ companies
@query("company_ranking_mean", "A3", f"""{W}
SELECT * FROM (SELECT empresa, round(avg({V}), 2) AS salario_promedio, round(median({V}), 4) AS salario_mediano,
       count({V}) AS count_salarios, round(max({V}), 2) AS salario_maximo, count(puesto) AS total_puestos
       FROM postings WHERE empresa IS NOT NULL GROUP BY empresa) WHERE total_puestos >= 2
ORDER BY salario_promedio DESC, empresa LIMIT 15""")
def company_ranking_mean(spark, sf):
    v = F.col(V)
    return S.group_stats(_p(spark, sf), "empresa", {
        "salario_promedio": rnd(F.avg(v), 2), "salario_mediano": rnd(S.median(v), 4),
        "count_salarios": F.count(v), "salario_maximo": rnd(F.max(v), 2),
        "total_puestos": F.count("puesto")},
        having=F.col("total_puestos") >= 2, order=[F.col("salario_promedio").desc()], limit=15)


@query("company_ranking_min3", "A4", f"""{W}
SELECT * FROM (SELECT empresa, round(avg({V}), 2) AS mean, count({V}) AS n FROM postings
               WHERE empresa IS NOT NULL GROUP BY empresa) WHERE n >= 3 ORDER BY mean DESC, empresa LIMIT 10""")
def company_ranking_min3(spark, sf):
    return S.group_stats(_p(spark, sf), "empresa", {"mean": rnd(F.avg(V), 2), "n": F.count(V)},
                         having=F.col("n") >= 3, order=[F.col("mean").desc()], limit=10)


@query("company_top_n", "A5", f"""{W}
SELECT empresa, round(avg({V}), 2) AS mean FROM postings WHERE empresa IS NOT NULL GROUP BY empresa
ORDER BY mean DESC, empresa LIMIT 10""")
def company_top_n(spark, sf):
    return S.group_stats(_p(spark, sf), "empresa", {"mean": rnd(F.avg(V), 2)},
                         order=[F.col("mean").desc()], limit=10)


@query("company_ranking_median", "A6", f"""{W}
SELECT * FROM (SELECT empresa, round(median({V}), 4) AS median, count({V}) AS n FROM postings
               WHERE empresa IS NOT NULL GROUP BY empresa) WHERE n >= 5 ORDER BY median DESC, empresa LIMIT 15""")
def company_ranking_median(spark, sf):
    return S.group_stats(_p(spark, sf), "empresa", {"median": rnd(S.median(V), 4), "n": F.count(V)},
                         having=F.col("n") >= 5, order=[F.col("median").desc()], limit=15)


def _best_sql(key):
    return (f"(SELECT '{key}' AS dimension, {key} AS best, round(m, 4) AS best_mean FROM "
            f"(SELECT {key}, avg({V}) AS m FROM postings WHERE {key} IS NOT NULL GROUP BY {key}) "
            f"WHERE m IS NOT NULL ORDER BY m DESC, {key} LIMIT 1)")


@query("company_best", "A7", f"""{W}
{_best_sql('empresa')} UNION ALL {_best_sql('sector')} UNION ALL {_best_sql('universidad_principal')}""")
def company_best(spark, sf):
    p = _p(spark, sf)
    out = None
    for key in ["empresa", "sector", "universidad_principal"]:
        b = S.best_key(p, key, V).select(F.lit(key).alias("dimension"), "best", r4(F.col("best_mean")).alias("best_mean"))
        out = b if out is None else out.unionByName(b)
    return out


@query("company_dispersion_cv", "A18", f"""{W}
SELECT empresa, round(s, 4) AS std, round(m, 4) AS mean, n, round(s / m, 6) AS cv FROM
 (SELECT empresa, stddev_samp({V}) AS s, avg({V}) AS m, count({V}) AS n FROM postings
  WHERE empresa IS NOT NULL GROUP BY empresa) WHERE n >= 3""")
def company_dispersion_cv(spark, sf):
    v = F.col(V)
    g = S.group_stats(_p(spark, sf), "empresa", {"_s": F.stddev_samp(v), "_m": F.avg(v), "n": F.count(v)},
                      having=F.col("n") >= 3)
    return g.select("empresa", r4(F.col("_s")).alias("std"), r4(F.col("_m")).alias("mean"), "n",
                    rnd(F.try_divide(F.col("_s"), F.col("_m")), 6).alias("cv")).orderBy(F.col("cv").desc())


@query("company_scatter", "A42 R4", f"""{W}
SELECT empresa, n, round(med, 4) AS median, round(s, 4) AS std, {case('empresa', BR.SECTOR_FIRST)} AS sector FROM
 (SELECT empresa, count({V}) AS n, median({V}) AS med, stddev_samp({V}) AS s FROM postings
  WHERE empresa IS NOT NULL GROUP BY empresa) WHERE n >= 5""")
def company_scatter(spark, sf):
    v = F.col(V)
    g = S.group_stats(_p(spark, sf), "empresa", {"n": F.count(v), "median": r4(S.median(v)),
                                                 "std": r4(F.stddev_samp(v))}, having=F.col("n") >= 5)
    return g.withColumn("sector", R.classify("empresa", BR.SECTOR_FIRST))


@query("company_sector_bubbles", "A25 J1 W2", f"""{W},
sized AS (SELECT p.*, s.empresa_size FROM postings p JOIN
          (SELECT empresa, count(*) AS empresa_size FROM postings GROUP BY empresa) s USING (empresa))
SELECT empresa, sector, {MEAN4} AS salario_avg, max(empresa_size) AS num_empleados,
       count(puesto) AS num_puestos FROM sized WHERE empresa IS NOT NULL AND sector IS NOT NULL
GROUP BY empresa, sector""")
def company_sector_bubbles(spark, sf):
    # company and sector first; the company's size is a sum over that small table
    g = S.group_stats(_p(spark, sf), ["empresa", "sector"], {
        "salario_avg": S.mean_of_cents(V), "_n": F.count(F.lit(1)), "num_puestos": F.count("puesto")}, drop_null_keys=False)
    size = g.groupBy("empresa").agg(F.sum("_n").alias("num_empleados"))
    return g.filter("empresa is not null and sector is not null").join(size, "empresa").select(
        "empresa", "sector", "salario_avg", "num_empleados", "num_puestos")


#: The driver's companies have about 600 postings each: bins around that.
BIND_SIZE_EDGES = [0, 580, 600, 620, float("inf")]


@query("company_size_rank", "J1 J2 W1 W2 R26", f"""{W},
agg AS (SELECT empresa, count(*) AS empresa_size, avg({V}) AS m FROM postings GROUP BY empresa),
ranked AS (SELECT *, rank() OVER (ORDER BY m DESC) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS empresa_rank
           FROM agg WHERE m IS NOT NULL)
SELECT a.empresa, a.empresa_size,
       CASE WHEN a.empresa_size > 0 AND a.empresa_size <= 580 THEN 'Pequeña'
            WHEN a.empresa_size > 580 AND a.empresa_size <= 600 THEN 'Mediana'
            WHEN a.empresa_size > 600 AND a.empresa_size <= 620 THEN 'Grande'
            WHEN a.empresa_size > 620 THEN 'Corporativa' END AS size_category,
       round(a.m, 4) AS mean, r.empresa_rank
FROM agg a LEFT JOIN ranked r USING (empresa)""")
def company_size_rank(spark, sf):
    p = _p(spark, sf)
    agg = p.groupBy("empresa").agg(F.count(F.lit(1)).alias("empresa_size"), F.avg(V).alias("m"))
    ranked = K.average_rank(agg, "m", "empresa", out="empresa_rank")
    return ranked.select("empresa", "empresa_size",
                         R.bin_right_closed("empresa_size", BIND_SIZE_EDGES, RS.SIZE_LABELS).alias("size_category"),
                         r4(F.col("m")).alias("mean"), F.col("empresa_rank").cast("double").alias("empresa_rank"))


# ------------------------------------------------------------------ sectors
@query("sector_stats", "A8 A9", f"""{W}
SELECT sector, round(avg({V}), 4) AS mean, round(median({V}), 4) AS median, count({V}) AS n,
       count(DISTINCT empresa) AS n_empresas FROM postings WHERE sector IS NOT NULL GROUP BY sector""")
def sector_stats(spark, sf):
    v = F.col(V)
    return S.group_stats(_p(spark, sf), "sector", {
        "mean": r4(F.avg(v)), "median": r4(S.median(v)), "n": F.count(v),
        "n_empresas": S.distinct_count("empresa")}, order=[F.col("mean").desc()])


@query("sector_median_min5", "A10", f"""{W}
SELECT * FROM (SELECT sector, round(median({V}), 4) AS median, round(avg({V}), 4) AS mean, count({V}) AS n
 FROM postings WHERE sector IS NOT NULL GROUP BY sector) WHERE n >= 5""")
def sector_median_min5(spark, sf):
    v = F.col(V)
    return S.group_stats(_p(spark, sf), "sector", {"median": r4(S.median(v)), "mean": r4(F.avg(v)),
                                                   "n": F.count(v)},
                         having=F.col("n") >= 5, order=[F.col("median").asc()])


@query("sector_share", "A11", f"""{W},
c AS (SELECT sector, count(*) AS n FROM postings WHERE sector IS NOT NULL GROUP BY sector)
SELECT sector, n, round(n * 100.0 / (SELECT sum(n) FROM c), 4) AS pct FROM c""")
def sector_share(spark, sf):
    return S.share(_p(spark, sf), "sector")


@query("sector_dominant", "A12", f"""{W}
SELECT sector AS dominant, count(*) AS n FROM postings WHERE sector IS NOT NULL GROUP BY sector
ORDER BY n DESC, sector LIMIT 1""")
def sector_dominant(spark, sf):
    return S.dominant(_p(spark, sf), "sector")


@query("sector_profile_scaled", "A41 A14", f"""{W},
a AS (SELECT sector, median({V}) AS median, avg({V}) AS mean FROM postings WHERE sector IS NOT NULL GROUP BY sector)
SELECT sector, round(median, 4) AS median, round(mean, 4) AS mean,
       round(median / (SELECT max(median) FROM a) * 100, 4) AS median_scaled,
       round(mean / (SELECT max(mean) FROM a) * 100, 4) AS mean_scaled FROM a""")
def sector_profile_scaled(spark, sf):
    a = S.group_stats(_p(spark, sf), "sector", {"median": S.median(V), "mean": F.avg(V)})
    return S.scaled_to_max(a, ["median", "mean"]).withColumns({"median": r4(F.col("median")), "mean": r4(F.col("mean"))})


# ------------------------------------------------------------------ universities
@query("university_ranking", "A13", f"""{W}
SELECT universidad_principal, round(avg({V}), 2) AS salario_promedio, round(median({V}), 4) AS salario_mediano,
       count({V}) AS count_salarios, round(max({V}), 2) AS salario_maximo, count(DISTINCT empresa) AS empresas,
       count(puesto) AS total_puestos
FROM postings WHERE universidad_principal IS NOT NULL GROUP BY universidad_principal""")
def university_ranking(spark, sf):
    v = F.col(V)
    return S.group_stats(_p(spark, sf), "universidad_principal", {
        "salario_promedio": rnd(F.avg(v), 2), "salario_mediano": rnd(S.median(v), 4),
        "count_salarios": F.count(v), "salario_maximo": rnd(F.max(v), 2),
        "empresas": S.distinct_count("empresa"), "total_puestos": F.count("puesto")},
        order=[F.col("salario_promedio").desc()])


@query("university_profile_scaled", "A14 W2", f"""{W},
sized AS (SELECT p.*, s.empresa_size FROM postings p JOIN
          (SELECT empresa, count(*) AS empresa_size FROM postings GROUP BY empresa) s USING (empresa)),
a AS (SELECT universidad_principal, avg({V}) AS salario, avg(empresa_size) AS tamano, count(*) AS n
      FROM sized WHERE universidad_principal IS NOT NULL GROUP BY universidad_principal)
SELECT universidad_principal, round(salario, 4) AS salario, round(tamano, 4) AS tamano, n,
       round(salario / (SELECT max(salario) FROM a) * 100, 4) AS salario_scaled,
       round(tamano / (SELECT max(tamano) FROM a) * 100, 4) AS tamano_scaled,
       round(n / (SELECT max(n) FROM a) * 100, 4) AS n_scaled FROM a""")
def university_profile_scaled(spark, sf):
    # company and university first; sizes and means are weighted sums over that small table
    g = _p(spark, sf).groupBy("empresa", "universidad_principal").agg(
        F.sum(V).alias("s"), F.count(V).alias("c"), F.count(F.lit(1)).alias("n"))
    g = K.group_sum(g, "empresa", "n", "empresa_size").filter("universidad_principal is not null")
    a = g.groupBy("universidad_principal").agg(
        F.try_divide(F.sum("s"), F.sum("c")).alias("salario"),
        F.try_divide(F.sum(F.col("empresa_size") * F.col("n")), F.sum(F.when(F.col("empresa_size").isNotNull(), F.col("n")))).alias("tamano"),
        F.sum("n").alias("n"))
    return S.scaled_to_max(a, ["salario", "tamano", "n"]).withColumns(
        {"salario": r4(F.col("salario")), "tamano": r4(F.col("tamano"))})


# ------------------------------------------------------------------ seniority / roles
@query("seniority_stats", "A15 R7", f"""{W},
l AS (SELECT *, {case('puesto', BR.SENIORITY)} AS seniority_level FROM postings)
SELECT seniority_level, round(avg({V}), 2) AS mean, round(median({V}), 4) AS median, count({V}) AS n,
       round(stddev_samp({V}), 2) AS std, count(DISTINCT empresa) AS n_empresas FROM l GROUP BY seniority_level""")
def seniority_stats(spark, sf):
    p = X.label_narrow(_p(spark, sf), ["puesto", "empresa", V], {"seniority_level": (["puesto"], BR.SENIORITY)})
    v = F.col(V)
    return S.group_stats(p, "seniority_level", {
        "mean": rnd(F.avg(v), 2), "median": rnd(S.median(v), 4), "n": F.count(v),
        "std": rnd(F.stddev_samp(v), 2), "n_empresas": S.distinct_count("empresa")},
        order=[F.col("mean").desc()])


@query("seniority_premium", "A16 R6", f"""{W},
l AS (SELECT *, {case('puesto', BR.SENIORITY_SIMPLE)} AS s FROM postings)
SELECT round(avg(CASE WHEN s = 'Senior' THEN {V} END), 4) AS mean_a,
       round(avg(CASE WHEN s = 'Junior' THEN {V} END), 4) AS mean_b,
       round((avg(CASE WHEN s = 'Senior' THEN {V} END) - avg(CASE WHEN s = 'Junior' THEN {V} END))
             / avg(CASE WHEN s = 'Junior' THEN {V} END) * 100, 4) AS premium_pct FROM l""")
def seniority_premium(spark, sf):
    p = _p(spark, sf).withColumn("s", R.classify("puesto", BR.SENIORITY_SIMPLE))
    r = S.ratio(p, V, F.col("s") == "Senior", F.col("s") == "Junior", percent=True, out="premium_pct")
    return r.select(*[r4(F.col(c)).alias(c) for c in r.columns])


@query("group_pay_ratio", "A43", f"""{W}
SELECT round(avg(CASE WHEN sector = 'LARGE' THEN {V} END), 4) AS mean_a,
       round(avg(CASE WHEN sector = 'SMALL' THEN {V} END), 4) AS mean_b,
       round(avg(CASE WHEN sector = 'LARGE' THEN {V} END) / avg(CASE WHEN sector = 'SMALL' THEN {V} END), 6) AS ratio
FROM postings""")
def group_pay_ratio(spark, sf):
    r = S.ratio(_p(spark, sf), V, F.col("sector") == "LARGE", F.col("sector") == "SMALL")
    return r.select(r4(F.col("mean_a")).alias("mean_a"), r4(F.col("mean_b")).alias("mean_b"),
                    rnd("ratio", 6).alias("ratio"))


@query("role_stats", "A17", f"""{W}
SELECT * FROM (SELECT puesto, round(avg({V}), 2) AS mean, count({V}) AS n, round(max({V}), 2) AS max,
       count(DISTINCT empresa) AS n_empresas FROM postings WHERE puesto IS NOT NULL GROUP BY puesto) WHERE n >= 2""")
def role_stats(spark, sf):
    v = F.col(V)
    return S.group_stats(_p(spark, sf), "puesto", {
        "mean": rnd(F.avg(v), 2), "n": F.count(v), "max": rnd(F.max(v), 2),
        "n_empresas": S.distinct_count("empresa")}, having=F.col("n") >= 2, order=[F.col("mean").desc()])


@query("role_top_n", "T1", f"""{W}
SELECT posting_id, empresa, puesto, {V} FROM postings ORDER BY {V} DESC NULLS LAST, posting_id LIMIT 20""")
def role_top_n(spark, sf):
    p = _p(spark, sf).select("posting_id", "empresa", "puesto", V)
    return K.top_n(p, [F.col(V).desc_nulls_last(), F.col("posting_id").asc()], 20)


@query("role_family_median", "A40", f"""{W},
l AS (SELECT *, {case('puesto', BR.ROLE_FAMILY)} AS familia FROM postings)
SELECT * FROM (SELECT familia, round(median({V}), 4) AS median, round(avg({V}), 4) AS mean, count({V}) AS n
 FROM l WHERE familia IS NOT NULL GROUP BY familia) WHERE n >= 5""")
def role_family_median(spark, sf):
    p = X.label_narrow(_p(spark, sf), ["puesto", V], {"familia": (["puesto"], BR.ROLE_FAMILY)})
    v = F.col(V)
    return S.group_stats(p, "familia", {"median": r4(S.median(v)), "mean": r4(F.avg(v)), "n": F.count(v)},
                         having=F.col("n") >= 5, order=[F.col("median").desc()])


@query("role_median", "A27", f"""{W}
SELECT puesto, round(median({V}), 4) AS median FROM postings WHERE puesto IS NOT NULL GROUP BY puesto""")
def role_median(spark, sf):
    return S.group_stats(_p(spark, sf), "puesto", {"median": r4(S.median(V))}, order=[F.col("median").asc()])


@query("newest_rows", "T5", f"""{W}
SELECT posting_id, empresa, puesto, strftime(fecha_extraccion, '%Y-%m-%d %H:%M:%S') AS fecha_extraccion
FROM postings ORDER BY postings.fecha_extraccion DESC, posting_id LIMIT 5""")
def newest_rows(spark, sf):
    p = _p(spark, sf)
    top = K.top_n(p, [F.col("fecha_extraccion").desc(), F.col("posting_id").asc()], 5)
    return top.select("posting_id", "empresa", "puesto",
                      F.date_format("fecha_extraccion", "yyyy-MM-dd HH:mm:ss").alias("fecha_extraccion"))


# ------------------------------------------------------------------ multi-label areas
def _multi_sql(rs, out):
    return f"""{W},
l AS (SELECT *, unnest({case('puesto', rs)}) AS {out} FROM postings)
SELECT {out}, count(*) AS n, round(avg({V}), 4) AS mean, round(median({V}), 4) AS median,
       round(max({V}), 4) AS max, count(DISTINCT empresa) AS n_empresas FROM l GROUP BY {out}"""


def _multi(spark, sf, rs, out):
    p = X.label_narrow(_p(spark, sf), ["puesto", "empresa", V], {"_labels": (["puesto"], rs)}).withColumn(out, F.explode("_labels"))
    v = F.col(V)
    return S.group_stats(p, out, {"n": F.count(F.lit(1)), "mean": r4(F.avg(v)), "median": r4(S.median(v)),
                                  "max": r4(F.max(v)), "n_empresas": S.distinct_count("empresa")},
                         order=[F.col("mean").desc()])


@query("job_area_multilabel", "R8 A19", _multi_sql(BR.JOB_AREA, "area"))
def job_area_multilabel(spark, sf):
    return _multi(spark, sf, BR.JOB_AREA, "area")


@query("career_area_multilabel", "R9 A20", _multi_sql(BR.CAREER_AREA, "carrera"))
def career_area_multilabel(spark, sf):
    return _multi(spark, sf, BR.CAREER_AREA, "carrera")


# ------------------------------------------------------------------ quartile tables
def _five_sql(scope_sql, rs, min_rows):
    return f"""{W},
s AS (SELECT *, {case('puesto', rs)} AS categoria FROM postings WHERE {scope_sql})
SELECT * FROM (SELECT categoria, count(*) AS n, round(min({V}), 4) AS min, round(quantile_cont({V}, 0.25), 4) AS q1,
       round(median({V}), 4) AS median, round(quantile_cont({V}, 0.75), 4) AS q3, round(max({V}), 4) AS max,
       round(avg({V}), 4) AS mean FROM s WHERE categoria IS NOT NULL GROUP BY categoria) WHERE n >= {min_rows}"""


def _five(df, rs, min_rows):
    return S.five_number(X.label_narrow(df, ["puesto", V], {"categoria": (["puesto"], rs)}), "categoria", V, min_rows, digits=4)


@query("quartiles_scope_ti", "A21 R10 R13", _five_sql(_TI, BR.TI_AREA, 3))
def quartiles_scope_ti(spark, sf):
    return _five(_p(spark, sf).filter(R.flag("puesto", BR.TI_WORDS)), BR.TI_AREA, 3)


@query("quartiles_scope_sales", "A21 R11 R14", _five_sql(_SALES, BR.SALES_AREA, 2))
def quartiles_scope_sales(spark, sf):
    return _five(_p(spark, sf).filter(R.flag("puesto", BR.SALES_WORDS, none_of=BR.MANAGER_WORDS)),
                 BR.SALES_AREA, 2)


@query("quartiles_scope_consumer", "A21 R15 J6", _five_sql(
    in_list("lower(empresa)", [c.lower() for c in BR.CONSUMER_COMPANIES]), BR.CONSUMER_ROLE, 2))
def quartiles_scope_consumer(spark, sf):
    return _five(_p(spark, sf).filter(SC.in_names("empresa", BR.CONSUMER_COMPANIES)), BR.CONSUMER_ROLE, 2)


_JUNIOR_SQL = (f"coalesce(regexp_matches(lower(puesto), {q(BR.JUNIOR_REGEX)}), false) "
               f"AND NOT coalesce({in_list('puesto', BR.JUNIOR_EXCLUDED_TITLES)}, false) "
               f"AND NOT ({any_of('puesto', BR.LEADERSHIP_WORDS)} AND NOT coalesce(regexp_matches(lower(puesto), "
               f"{q(BR.CLEAR_JUNIOR_REGEX)}), false)) "
               f"AND NOT coalesce({V} > {BR.JUNIOR_SALARY_CAP}, false)")


@query("quartiles_scope_junior", "A21 R16 R17 U5", _five_sql(_JUNIOR_SQL, BR.JUNIOR_AREA, 1))
def quartiles_scope_junior(spark, sf):
    scope = SC.junior_scope("puesto", V, BR.JUNIOR_REGEX, BR.JUNIOR_EXCLUDED_TITLES, BR.LEADERSHIP_WORDS,
                            BR.CLEAR_JUNIOR_REGEX, BR.JUNIOR_SALARY_CAP)
    return _five(_p(spark, sf).filter(scope), BR.JUNIOR_AREA, 1)


_BANK_SQL = (f"({in_list('lower(empresa)', [c.lower() for c in BR.BANK_COMPANIES])} "
             f"OR coalesce(regexp_matches(sector, {q(BR.BANK_SECTOR_REGEX)}), false))")


@query("quartiles_scope_banking", "A21 R19", _five_sql(_BANK_SQL, BR.BANK_ROLE, 2))
def quartiles_scope_banking(spark, sf):
    scope = SC.any_scope("empresa", "sector", None, BR.BANK_COMPANIES, BR.BANK_SECTOR_REGEX)
    return _five(_p(spark, sf).filter(scope), BR.BANK_ROLE, 2)


_TECH_SQL = (f"({in_list('lower(empresa)', [c.lower() for c in BR.CONSUMER_COMPANIES[:3]])} "
             f"OR coalesce(regexp_matches(sector, '(?i)STANDARD'), false) "
             f"OR {any_of('puesto', ['gizmo', 'widget'], 'regex')}) AND {_TI}")


@query("quartiles_scope_tech", "A21 R18 R13", _five_sql(_TECH_SQL, BR.TI_AREA, 3))
def quartiles_scope_tech(spark, sf):
    scope = SC.any_scope("empresa", "sector", "puesto", BR.CONSUMER_COMPANIES[:3], "(?i)STANDARD",
                         ["gizmo", "widget"]) & R.flag("puesto", BR.TI_WORDS)
    return _five(_p(spark, sf).filter(scope), BR.TI_AREA, 3)


@query("management_bubbles", "A23 R12 R20", f"""{W},
s AS (SELECT *, {case('puesto', BR.MANAGEMENT_LEVEL)} AS nivel_gerencial FROM postings WHERE {_MGR})
SELECT * FROM (SELECT nivel_gerencial, round(avg({V}), 0) AS salario_promedio, count({V}) AS cantidad_registros,
       round(median({V}), 0) AS salario_mediano, round(max({V}), 0) AS salario_maximo,
       count(DISTINCT empresa) AS empresas_diferentes FROM s GROUP BY nivel_gerencial) WHERE cantidad_registros >= 2""")
def management_bubbles(spark, sf):
    p = _p(spark, sf).filter(R.flag("puesto", BR.MANAGER_WORDS))
    p = p.withColumn("nivel_gerencial", R.classify("puesto", BR.MANAGEMENT_LEVEL))
    v = F.col(V)
    return S.group_stats(p, "nivel_gerencial", {
        "salario_promedio": rnd(F.avg(v), 0), "cantidad_registros": F.count(v),
        "salario_mediano": rnd(S.median(v), 0), "salario_maximo": rnd(F.max(v), 0),
        "empresas_diferentes": S.distinct_count("empresa")}, having=F.col("cantidad_registros") >= 2)


@query("banking_roles", "A22 R19", f"""{W},
s AS (SELECT *, {case('puesto', BR.BANK_ROLE)} AS banking_role FROM postings WHERE {_BANK_SQL})
SELECT * FROM (SELECT banking_role, round(avg({V}), 0) AS promedio, count({V}) AS cantidad,
       round(median({V}), 0) AS mediana FROM s GROUP BY banking_role) WHERE cantidad >= 2""")
def banking_roles(spark, sf):
    scope = SC.any_scope("empresa", "sector", None, BR.BANK_COMPANIES, BR.BANK_SECTOR_REGEX)
    p = _p(spark, sf).filter(scope).withColumn("banking_role", R.classify("puesto", BR.BANK_ROLE))
    v = F.col(V)
    return S.group_stats(p, "banking_role", {"promedio": rnd(F.avg(v), 0), "cantidad": F.count(v),
                                             "mediana": rnd(S.median(v), 0)},
                         having=F.col("cantidad") >= 2)


@query("level_box_summary", "A26 R5 C9", f"""{W},
s AS (SELECT *, {case('puesto', BR.LEVEL)} AS categoria FROM postings WHERE {V} IS NOT NULL AND {V} > 100)
SELECT * FROM (SELECT categoria, count(*) AS n, round(min({V}), 4) AS min, round(quantile_cont({V}, 0.25), 4) AS q1,
       round(median({V}), 4) AS median, round(quantile_cont({V}, 0.75), 4) AS q3, round(max({V}), 4) AS max,
       round(avg({V}), 4) AS mean FROM s WHERE {in_list('categoria', BR.LEVEL_ORDER)} GROUP BY categoria) WHERE n >= 2""")
def level_box_summary(spark, sf):
    p = X.label_narrow(_p(spark, sf).filter(T.valid_salary(V, 100)), ["puesto", V], {"categoria": (["puesto"], BR.LEVEL)})
    return S.five_number(p.filter(F.col("categoria").isin(BR.LEVEL_ORDER)), "categoria", V, 2, digits=4)


@query("pay_by_start_year", "A39", f"""{W}
SELECT CAST(year(fecha_inicio) AS INTEGER) AS anio, round(quantile_cont({V}, 0.25), 4) AS q1, round(median({V}), 4) AS median,
       round(quantile_cont({V}, 0.75), 4) AS q3, round(avg({V}), 4) AS mean, count({V}) AS n
FROM postings WHERE fecha_inicio IS NOT NULL GROUP BY year(fecha_inicio)""")
def pay_by_start_year(spark, sf):
    p = _p(spark, sf).withColumn("anio", F.year("fecha_inicio"))
    v = F.col(V)
    return S.group_stats(p, "anio", {"q1": r4(S.quantile(v, 0.25)), "median": r4(S.median(v)),
                                     "q3": r4(S.quantile(v, 0.75)), "mean": r4(F.avg(v)), "n": F.count(v)},
                         order=[F.col("anio").asc()])


# ------------------------------------------------------------------ cleaning / bins
@query("rescale_salary", "C8", f"""{W},
s AS (SELECT *, coalesce({V} < 2000 AND NOT coalesce(regexp_matches(lower(puesto), {q(BR.RESCALE_TRAINEE)}), false)
                AND coalesce(regexp_matches(lower(puesto), {q(BR.RESCALE_PROFESSIONAL)}), false), false) AS rescaled
      FROM postings)
SELECT count_if(rescaled) AS n_rescaled, round(sum({V}), 2) AS total_before,
       round(sum(CASE WHEN rescaled THEN {V} * 10 ELSE {V} END), 2) AS total_after,
       round(sum(CASE WHEN rescaled THEN salario_minimo * 10 ELSE salario_minimo END), 2) AS total_min_after FROM s""")
def rescale_salary(spark, sf):
    p = _p(spark, sf)
    before = p.select(F.col(V).alias("_before"), "*")
    fixed = SC.rescaled(before, V, "puesto", 2000.0, BR.RESCALE_TRAINEE, BR.RESCALE_PROFESSIONAL)
    return fixed.agg(F.count_if("rescaled").alias("n_rescaled"), rnd(F.sum("_before"), 2).alias("total_before"),
                     rnd(F.sum(V), 2).alias("total_after"),
                     rnd(F.sum("salario_minimo"), 2).alias("total_min_after"))


@query("valid_salary_filter", "C1 C9 C10", f"""{W}
SELECT count(*) AS n_rows, count_if({V} IS NOT NULL AND {V} > 0) AS n_positive,
       count_if({V} IS NOT NULL AND {V} > 100) AS n_valid,
       count_if({V} IS NOT NULL AND {V} > 100 AND {V} <= 50000) AS n_display FROM postings""")
def valid_salary_filter(spark, sf):
    p = _p(spark, sf).withColumn(V, T.to_number(F.col(V)))
    return p.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(T.valid_salary(V, 0)).alias("n_positive"),
                 F.count_if(T.valid_salary(V, 100)).alias("n_valid"),
                 F.count_if(T.valid_salary(V, 100) & (F.col(V) <= 50000)).alias("n_display"))


_TITLE_SQL = ("list_aggregate(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)'), "
              "lambda t: upper(t[1]) || lower(t[2:])), 'string_agg', '')")


@query("clean_names", "C2 C16", f"""{W}
SELECT DISTINCT trim(puesto) AS puesto, {_TITLE_SQL.format(x='trim(puesto)')} AS puesto_title,
       {_TITLE_SQL.format(x='trim(empresa)')} AS empresa_title, CAST(length(trim(puesto)) AS INTEGER) AS titulo_length,
       CAST(len(list_filter(string_split_regex(trim(puesto), '\\s+'), lambda t: t <> '')) AS INTEGER) AS titulo_words,
       empresa FROM postings""")
def clean_names(spark, sf):
    # distinct first: the text functions then run once per distinct pair
    p = _p(spark, sf).select(F.trim("puesto").alias("puesto"), "empresa").distinct()
    return p.select("puesto", T.title_case("puesto").alias("puesto_title"),
                    T.clean_company("empresa").alias("empresa_title"),
                    F.length("puesto").alias("titulo_length"), T.word_count("puesto").alias("titulo_words"),
                    "empresa")


@query("income_bands", "R27", f"""{W},
b AS (SELECT CASE WHEN {V} / 10 >= 30000 THEN 'A++' WHEN {V} / 10 >= 15000 THEN 'A+'
                  WHEN {V} / 10 >= 8000 THEN 'A' WHEN {V} / 10 >= 4500 THEN 'B'
                  WHEN {V} / 10 >= 2500 THEN 'C' WHEN {V} / 10 >= 1500 THEN 'D' ELSE 'E' END AS banda
      FROM postings WHERE {V} IS NOT NULL),
c AS (SELECT banda, count(*) AS n FROM b GROUP BY banda)
SELECT banda, n, round(n * 100.0 / (SELECT sum(n) FROM c), 4) AS pct FROM c""")
def income_bands(spark, sf):
    p = _p(spark, sf).withColumn("_monthly", F.col(V) / 10)
    return S.band_share(p, "_monthly", RS.INCOME_BANDS)


@query("classify_first", "R4 R5", f"""{W},
l AS (SELECT {case('puesto', BR.LEVEL)} AS nivel, {case('empresa', BR.SECTOR_FIRST)} AS sector_emp FROM postings)
SELECT nivel, sector_emp, count(*) AS n FROM l GROUP BY nivel, sector_emp""")
def classify_first(spark, sf):
    p = _p(spark, sf).select(R.classify("puesto", BR.LEVEL).alias("nivel"),
                             R.classify("empresa", BR.SECTOR_FIRST).alias("sector_emp"))
    return p.groupBy("nivel", "sector_emp").agg(F.count(F.lit(1)).alias("n"))


@query("classify_last", "R1", f"""{W},
l AS (SELECT {case(['empresa', 'puesto'], BR.SECTOR_LAST)} AS sector_ref FROM postings)
SELECT sector_ref, count(*) AS n FROM l GROUP BY sector_ref""")
def classify_last(spark, sf):
    p = _p(spark, sf).select(R.classify(["empresa", "puesto"], BR.SECTOR_LAST).alias("sector_ref"))
    return p.groupBy("sector_ref").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ statistics
_CORR_VARS = ["salario_promedio", "titulo_length", "titulo_words", "empresa_size", "seniority_numeric"]


def _corr_input(spark, sf):
    p = K.group_size(_p(spark, sf), "empresa", "empresa_size")
    p = R.label_columns(p, {"_lvl": ("puesto", BR.SENIORITY)})
    return p.select(V, F.length("puesto").alias("titulo_length"), T.word_count("puesto").alias("titulo_words"),
                    "empresa_size", T.ordinal("_lvl", RS.SENIORITY_ORDINAL).alias("seniority_numeric"))


def _corr_sql(insights: bool = False):
    sel = ", ".join(f"corr({a}, {b}) AS c_{i}_{j}" for i, a in enumerate(_CORR_VARS)
                    for j, b in enumerate(_CORR_VARS))
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, CASE WHEN isnan(c_{i}_{j}) THEN NULL ELSE round(c_{i}_{j}, 6) END AS r FROM m"
        for i, a in enumerate(_CORR_VARS) for j, b in enumerate(_CORR_VARS))
    return f"""{W},
sized AS (SELECT p.*, s.empresa_size FROM postings p JOIN
          (SELECT empresa, count(*) AS empresa_size FROM postings GROUP BY empresa) s USING (empresa)),
x AS (SELECT {V}, CAST(length(puesto) AS DOUBLE) AS titulo_length,
             CAST(len(list_filter(string_split_regex(puesto, '\\s+'), lambda t: t <> '')) AS DOUBLE) AS titulo_words,
             CAST(empresa_size AS DOUBLE) AS empresa_size,
             CAST(CASE {case('puesto', BR.SENIORITY)} WHEN 'Junior' THEN 1 WHEN 'Entry-Level' THEN 2
                  WHEN 'Mid-Level' THEN 3 WHEN 'Senior' THEN 4 END AS DOUBLE) AS seniority_numeric FROM sized),
m AS (SELECT {sel} FROM x)
""" + (f"""\n, cm AS ({rows})
SELECT var_b AS variable, r, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM cm
WHERE var_a = '{V}' AND var_b <> '{V}' AND abs(r) > 0.002""" if insights else rows)


def _corr(spark, sf):
    m = S.corr_matrix(_corr_input(spark, sf), _CORR_VARS)
    return m.withColumn("r", F.when(F.isnan("r"), F.lit(None)).otherwise(F.col("r")))


@query("corr_matrix", "X1 C16 C21 W2", _corr_sql())
def corr_matrix(spark, sf):
    return _corr(spark, sf)


@query("corr_insights", "X2", _corr_sql(insights=True))
def corr_insights(spark, sf):
    return S.corr_flags(_corr(spark, sf), V, 0.002)  # the driver's columns hardly correlate


@query("histogram_30", "X3 C9", f"""{W},
v AS (SELECT {V} AS x FROM postings WHERE {V} IS NOT NULL AND {V} > 100),
e AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
c AS (SELECT CAST(CASE WHEN e.hi = e.lo THEN 1 ELSE least(floor((x - e.lo) * 30 / (e.hi - e.lo)) + 1, 30) END AS INTEGER) AS bin,
             count(*) AS n FROM v, e GROUP BY 1)
SELECT g.bin, round(e.lo + (g.bin - 1) * (e.hi - e.lo) / 30, 4) AS bin_lo, round(e.lo + g.bin * (e.hi - e.lo) / 30, 4) AS bin_hi,
       coalesce(c.n, 0) AS n
FROM e, (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS bin) g LEFT JOIN c ON c.bin = g.bin""")
def histogram_30(spark, sf):
    return S.histogram(_p(spark, sf).filter(T.valid_salary(V, 100)), V, 30)


@query("histogram_capped_20", "X3 C10", f"""{W},
v AS (SELECT {V} AS x FROM postings WHERE {V} IS NOT NULL AND {V} <= 50000),
e AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
c AS (SELECT CAST(CASE WHEN e.hi = e.lo THEN 1 ELSE least(floor((x - e.lo) * 20 / (e.hi - e.lo)) + 1, 20) END AS INTEGER) AS bin,
             count(*) AS n FROM v, e GROUP BY 1)
SELECT g.bin, round(e.lo + (g.bin - 1) * (e.hi - e.lo) / 20, 4) AS bin_lo, round(e.lo + g.bin * (e.hi - e.lo) / 20, 4) AS bin_hi,
       coalesce(c.n, 0) AS n
FROM e, (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS bin) g LEFT JOIN c ON c.bin = g.bin""")
def histogram_capped_20(spark, sf):
    return S.histogram(_p(spark, sf), V, 20, cap=50000)


@query("histogram_lines", "X3 A1", f"""{W}
SELECT round(avg({V}), 4) AS mean, round(median({V}), 4) AS median FROM postings""")
def histogram_lines(spark, sf):
    """The mean and median lines of the capped chart: over all salaries."""
    return S.histogram_lines(_p(spark, sf), V)


@query("top20_word_freq", "X4", f"""{W},
k AS (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) AS k FROM postings),
t AS (SELECT puesto FROM (SELECT puesto, row_number() OVER (ORDER BY {V} DESC NULLS LAST, posting_id) AS rn
      FROM postings) WHERE rn <= (SELECT k FROM k)),
w AS (SELECT unnest(string_split_regex(lower(trim(puesto)), '\\s+')) AS word FROM t),
c AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 15)
SELECT word, n FROM c WHERE length(word) >= 4""")
def top20_word_freq(spark, sf):
    return S.word_freq(_p(spark, sf), "puesto", V, "posting_id", 0.2, 15, 4)


@query("scatter_projection", "X5 J2 W1 W2", f"""{W},
size AS (SELECT empresa, count(*) AS empresa_size FROM postings GROUP BY empresa),
ranks AS (SELECT empresa, CAST(row_number() OVER (ORDER BY m DESC NULLS LAST, empresa) AS INTEGER) AS empresa_rank
          FROM (SELECT empresa, avg(salario_promedio) AS m FROM postings GROUP BY empresa))
SELECT posting_id, salario_promedio, empresa_size, empresa_rank FROM postings JOIN size USING (empresa) JOIN ranks USING (empresa)""")
def scatter_projection(spark, sf):
    """Every posting with the size and the rank (by mean salary) of its company."""
    p = _p(spark, sf)
    per = p.groupBy("empresa").agg(F.count(F.lit(1)).alias("empresa_size"), F.avg(V).alias("_m"))
    # numbered over range partitions, not in one window over all companies
    per = K.global_row_number(per, [F.col("_m").desc_nulls_last(), F.col("empresa").asc()], "empresa_rank")
    per = per.withColumn("empresa_rank", F.col("empresa_rank").cast("int")).drop("_m")
    return S.scatter_projection(p.join(per, "empresa"), ["posting_id", V, "empresa_size", "empresa_rank"])


# ------------------------------------------------------------------ grids / trees
@query("grid_role_company", "M1 J4 U3 T2", f"""{W},
tr AS (SELECT puesto FROM postings WHERE puesto IS NOT NULL GROUP BY puesto ORDER BY count(*) DESC, puesto LIMIT 15),
te AS (SELECT empresa FROM postings WHERE empresa IS NOT NULL GROUP BY empresa ORDER BY count(*) DESC, empresa LIMIT 10)
SELECT puesto, empresa, {MEAN4} AS mean, count(*) AS n FROM postings
WHERE puesto IN (SELECT puesto FROM tr) AND empresa IN (SELECT empresa FROM te) GROUP BY puesto, empresa""")
def grid_role_company(spark, sf):
    p = _p(spark, sf)
    # both axes ranked on the whole table, then both filters
    roles = K.top_keys(p, "puesto", 15).select("puesto")
    firms = K.top_keys(p, "empresa", 10).select("empresa")
    p = p.join(F.broadcast(roles), "puesto", "left_semi").join(F.broadcast(firms), "empresa", "left_semi")
    return p.groupBy("puesto", "empresa").agg(S.mean_of_cents(V).alias("mean"), F.count(F.lit(1)).alias("n"))


def _level_list_sql():
    return ", ".join(f"({q(lv)}, {i})" for i, lv in enumerate(BR.LEVEL_ORDER))


@query("grid_level_sector", "M2 R5", f"""{W},
l AS (SELECT *, {case('puesto', BR.LEVEL)} AS nivel FROM postings WHERE {V} IS NOT NULL AND {V} > 100),
ts AS (SELECT sector FROM l WHERE sector IS NOT NULL AND sector <> 'Otros' GROUP BY sector
       ORDER BY median({V}) DESC NULLS LAST, sector LIMIT 8),
ax AS (SELECT ts.sector, lv.nivel, lv.row_pos FROM ts, (VALUES {_level_list_sql()}) lv(nivel, row_pos)),
cells AS (SELECT nivel, sector, count(*) AS n, median({V}) AS med FROM l
          WHERE sector IN (SELECT sector FROM ts) GROUP BY nivel, sector)
SELECT ax.nivel, ax.sector, CAST(ax.row_pos AS INTEGER) AS row_pos, coalesce(cells.n, 0) AS n,
       CASE WHEN cells.n >= 2 THEN round(cells.med, 4) END AS median
FROM ax LEFT JOIN cells ON ax.nivel = cells.nivel AND ax.sector = cells.sector""")
def grid_level_sector(spark, sf):
    p = X.label_narrow(_p(spark, sf).filter(T.valid_salary(V, 100)), ["puesto", "sector", V], {"nivel": (["puesto"], BR.LEVEL)})
    g = G.grid_with_top_cols(p, "nivel", "sector", V, BR.LEVEL_ORDER, top_cols=8, exclude_col="Otros", min_n=2)
    return g.withColumn("median", r4(F.col("median")))


@query("tree_company", "M4 R4", f"""{W},
e AS (SELECT empresa, count(puesto) AS cnt, median({V}) AS med FROM postings
      WHERE {V} IS NOT NULL AND {V} > 100 AND empresa IS NOT NULL GROUP BY empresa),
top AS (SELECT * FROM e WHERE cnt >= 3 ORDER BY cnt DESC, empresa LIMIT 30),
leaf AS (SELECT substr(empresa, 1, 25) AS label, {case('empresa', BR.SECTOR_FIRST)} AS parent,
                CAST(cnt AS BIGINT) AS value, round(med, 4) AS color FROM top)
SELECT DISTINCT parent AS label, '' AS parent, CAST(0 AS BIGINT) AS value, 0.0 AS color FROM leaf
UNION ALL SELECT * FROM leaf""")
def tree_company(spark, sf):
    p = _p(spark, sf).filter(T.valid_salary(V, 100))
    e = S.group_stats(p, "empresa", {"cnt": F.count("puesto"), "med": r4(S.median(V))},
                      having=F.col("cnt") >= 3, order=[F.col("cnt").desc()], limit=30)
    leaves = e.select(F.substring("empresa", 1, 25).alias("label"),
                      R.classify("empresa", BR.SECTOR_FIRST).alias("parent"), "cnt", "med")
    return G.tree_rows(leaves, "label", "parent", "cnt", "med")


_DECILES = [i / 10 for i in range(11)]


def _pct_case_sql(v, bp):
    parts = [f"WHEN {v} <= {bp}[1] THEN {_DECILES[0] * 100}"]
    for i in range(10):
        lo, hi = f"{bp}[{i + 1}]", f"{bp}[{i + 2}]"
        frac = f"coalesce(CASE WHEN {hi} - {lo} = 0 THEN NULL ELSE ({v} - {lo}) / ({hi} - {lo}) END, 0.0)"
        parts.append(f"WHEN {v} <= {hi} THEN {_DECILES[i] * 100} + {frac} * {(_DECILES[i + 1] - _DECILES[i]) * 100}")
    return "CASE " + " ".join(parts) + f" ELSE {_DECILES[-1] * 100} END"


@query("income_percentile_rank", "R27 A2", f"""{W},
bp AS (SELECT quantile_cont({V}, [{', '.join(str(d) for d in _DECILES)}]) AS b FROM postings),
m AS (SELECT empresa, avg({V}) AS mean FROM postings WHERE empresa IS NOT NULL GROUP BY empresa)
SELECT empresa, round(mean, 4) AS mean, round({_pct_case_sql('mean', '(SELECT b FROM bp)')}, 4) AS national_pct FROM m""")
def income_percentile_rank(spark, sf):
    """Each company's mean pay placed on the national decile table
    (breakpoints from the data, linear interpolation inside a bracket)."""
    p = _p(spark, sf)
    deciles = S.aggregate(p, [], {f"d{i}": S.quantile(V, d) for i, d in enumerate(_DECILES)})
    bp = deciles.select(F.array(*[F.col(f"d{i}") for i in range(len(_DECILES))])).scalar()
    m = S.group_stats(p, "empresa", {"mean": F.avg(V)}).withColumn("_bp", bp)
    return m.select("empresa", r4(F.col("mean")).alias("mean"),
                    r4(S.interpolated_percentile("mean", F.col("_bp"), [d * 100 for d in _DECILES])).alias("national_pct"))

"""Public job-call queries (survey A11 A26-A29 C12 C13 C18 C20 H4 H6 J3 M3 M5
R21-R24 T2 T3 W3 X3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matcher as X
from ..functions import rules as R
from ..functions import text as T
from ..functions.text import rnd
from ..operators import grid as G
from ..operators import history as H
from ..operators import rank as K
from ..operators import stats as S
from ..session import Scratch
from ..sources import bindings as B
from . import bind_rules as BR
from .registry import query
from .sql_bindings import CALLS
from .sql_rules import case, in_list, q

W = f"WITH {CALLS}"
VALID = "salario IS NOT NULL AND salario > 100"


def _all(spark, sf):
    return R.label_columns(B.calls(spark, sf), {"tipo_inst": ("institucion", BR.INSTITUTION_TYPE)})


_LABELS = {"tipo_inst": (["institucion"], BR.INSTITUTION_TYPE), "nivel": (["puesto"], BR.PUBLIC_LEVEL),
           "rol_granular": (["puesto"], BR.ROLE_17), "rol_cat": (["puesto"], BR.ROLE_CAT)}


def _valid(spark, sf, *labels):
    """Calls with a valid salary and the named labels: written once, each distinct text judged once."""
    c = B.calls(spark, sf).filter(T.valid_salary("salario", 100))
    return X.label_narrow(c, ["institucion", "puesto", "salario"], {n: _LABELS[n] for n in labels})


_TIPO = case("institucion", BR.INSTITUTION_TYPE)
SAL = f"""{W}, a AS (SELECT *, {_TIPO} AS tipo_inst FROM calls),
v AS (SELECT *, {case('puesto', BR.PUBLIC_LEVEL)} AS nivel, {case('puesto', BR.ROLE_17)} AS rol_granular,
             {case('puesto', BR.ROLE_CAT)} AS rol_cat FROM a WHERE {VALID})"""


@query("call_roles_median", "A27 R21 C9", f"""{SAL}
SELECT rol_granular, round(median(salario), 4) AS median FROM v WHERE rol_granular IS NOT NULL GROUP BY rol_granular""")
def call_roles_median(spark, sf):
    return S.group_stats(_valid(spark, sf, "rol_granular"), "rol_granular", {"median": rnd(S.median("salario"))},
                         order=[F.col("median").asc()])


@query("call_top_institutions", "T2 A11", f"""{W}
SELECT institucion, count(*) AS n FROM calls WHERE institucion IS NOT NULL GROUP BY institucion
ORDER BY n DESC, institucion LIMIT 20""")
def call_top_institutions(spark, sf):
    return K.top_keys(B.calls(spark, sf), "institucion", 20)


@query("call_type_share", "A11 R24 C7", f"""{W}, a AS (SELECT {_TIPO} AS tipo_inst FROM calls),
c AS (SELECT tipo_inst, count(*) AS n FROM a GROUP BY tipo_inst)
SELECT tipo_inst, n, round(n * 100.0 / (SELECT sum(n) FROM c), 4) AS pct FROM c""")
def call_type_share(spark, sf):
    return S.share(_all(spark, sf), "tipo_inst")


def _axis_sql(values, alias, name, pos):
    return "(VALUES " + ", ".join(f"({q(v)}, {i})" for i, v in enumerate(values)) + f") {alias}({name}, {pos})"


@query("grid_institution_role", "M3 R22 R24", f"""{SAL},
cells AS (SELECT tipo_inst, rol_cat, count(*) AS n, median(salario) AS med FROM v
          WHERE rol_cat IS NOT NULL AND tipo_inst <> 'Otros' GROUP BY tipo_inst, rol_cat)
SELECT t.tipo_inst, r.rol_cat, CAST(t.row_pos AS INTEGER) AS row_pos, CAST(r.col_pos AS INTEGER) AS col_pos,
       coalesce(cells.n, 0) AS n, CASE WHEN cells.n >= 2 THEN round(cells.med, 4) END AS median
FROM {_axis_sql(BR.INSTITUTION_GRID_ORDER, 't', 'tipo_inst', 'row_pos')}
CROSS JOIN {_axis_sql(BR.ROLE_CAT_DISPLAY, 'r', 'rol_cat', 'col_pos')}
LEFT JOIN cells ON cells.tipo_inst = t.tipo_inst AND cells.rol_cat = r.rol_cat""")
def grid_institution_role(spark, sf):
    v = _valid(spark, sf, "rol_cat", "tipo_inst").filter(F.col("rol_cat").isNotNull() & (F.col("tipo_inst") != "Otros"))
    g = G.dense_grid(v, "tipo_inst", "rol_cat", "salario", BR.INSTITUTION_GRID_ORDER, BR.ROLE_CAT_DISPLAY, min_n=2)
    return g.withColumn("median", rnd(F.col("median")))


@query("tree_institution", "M5 J3 A12", f"""{W}, a AS (SELECT *, {_TIPO} AS tipo_inst FROM calls),
per AS (SELECT institucion, count(*) AS cnt, median(CASE WHEN {VALID} THEN salario END) AS med
        FROM a WHERE institucion IS NOT NULL GROUP BY institucion),
modal AS (SELECT institucion, tipo_inst FROM (
            SELECT institucion, tipo_inst, row_number() OVER (PARTITION BY institucion ORDER BY count(*) DESC, tipo_inst) AS r
            FROM a WHERE institucion IS NOT NULL GROUP BY institucion, tipo_inst) WHERE r = 1),
top AS (SELECT * FROM per ORDER BY cnt DESC, institucion LIMIT 50)
SELECT t AS label, '' AS parent, CAST(0 AS BIGINT) AS value, 0.0 AS color
FROM (SELECT unnest({'[' + ', '.join(q(x) for x in BR.INSTITUTION_TREE_ORDER) + ']'}) AS t)
UNION ALL
SELECT top.institucion, coalesce(modal.tipo_inst, 'Otros'), CAST(top.cnt AS BIGINT), coalesce(round(top.med, 4), 0.0)
FROM top LEFT JOIN modal USING (institucion)""")
def tree_institution(spark, sf):
    a = _all(spark, sf).filter(F.col("institucion").isNotNull())
    # one pass over ALL calls: size from every call, colour from valid salaries only
    per = S.aggregate(a, ["institucion"], {
        "cnt": F.count(F.lit(1)),
        "med": S.median(F.when(T.valid_salary("salario", 100), F.col("salario")))})
    top = K.top_n(per, [F.col("cnt").desc(), F.col("institucion").asc()], 50)
    # modal type: counts per (institution, type), then the most frequent (ties -> smallest)
    modal = (a.groupBy("institucion", "tipo_inst").agg(F.count(F.lit(1)).alias("_n"))
             .groupBy("institucion").agg(F.min_by("tipo_inst", F.struct(-F.col("_n"), F.col("tipo_inst"))).alias("tipo")))
    leaves = (top.join(modal, "institucion", "left")
              .select("institucion", F.coalesce("tipo", F.lit("Otros")).alias("tipo"), "cnt",
                      F.coalesce(rnd(F.col("med")), F.lit(0.0)).alias("med")))
    return G.tree_rows(leaves, "institucion", "tipo", "cnt", "med", extra_parents=BR.INSTITUTION_TREE_ORDER)


@query("top_institutions_by_type", "A28 W3 C20", f"""{SAL},
per AS (SELECT tipo_inst, institucion, avg(salario) AS m, count(salario) AS y FROM v
        WHERE tipo_inst IS NOT NULL AND institucion IS NOT NULL GROUP BY tipo_inst, institucion),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY tipo_inst ORDER BY y DESC, institucion) AS INTEGER) AS rank_in_group FROM per)
SELECT tipo_inst, institucion, round(m, 0) AS x, y, greatest(8, least(40, CAST(floor(y * 1.5) AS BIGINT))) AS size,
       rank_in_group FROM r WHERE rank_in_group <= 30""")
def top_institutions_by_type(spark, sf):
    per = S.group_stats(_valid(spark, sf, "tipo_inst"), ["tipo_inst", "institucion"],
                        {"m": F.avg("salario"), "y": F.count("salario")})
    top = K.top_k_per_group(per, "tipo_inst", [F.col("y").desc(), F.col("institucion").asc()], 30,
                            salt_col="institucion")
    return top.select("tipo_inst", "institucion", rnd(F.col("m"), 0).alias("x"), "y",
                      T.clamp(F.floor(F.col("y") * 1.5).cast("bigint"), 8, 40).cast("bigint").alias("size"),
                      "rank_in_group")


@query("role_comparison", "A29 W3 C12", f"""{SAL},
tr AS (SELECT rol_granular FROM v WHERE rol_granular IS NOT NULL GROUP BY rol_granular
       ORDER BY count(*) DESC, rol_granular LIMIT 10),
per AS (SELECT rol_granular, institucion, median(salario) AS mediana, count(salario) AS n FROM v
        WHERE rol_granular IN (SELECT rol_granular FROM tr) AND institucion IS NOT NULL GROUP BY rol_granular, institucion),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rol_granular ORDER BY mediana DESC, institucion) AS INTEGER) AS rank_in_group
      FROM per WHERE n >= 1)
SELECT rol_granular, substr(institucion, 1, 90) AS institucion, round(mediana, 4) AS mediana, n, rank_in_group
FROM r WHERE rank_in_group <= 15""")
def role_comparison(spark, sf):
    v = _valid(spark, sf, "rol_granular").filter(F.col("rol_granular").isNotNull()).select("rol_granular", "institucion", "salario")
    v = Scratch(spark, "roles").save(v)  # labelled and read once
    roles = K.top_keys(v, "rol_granular", 10).select("rol_granular")
    per = S.group_stats(v.join(F.broadcast(roles), "rol_granular", "left_semi"), ["rol_granular", "institucion"],
                        {"mediana": S.median("salario"), "n": F.count("salario")}, having=F.col("n") >= 1, written=True)
    top = K.top_k_per_group(per, "rol_granular", [F.col("mediana").desc(), F.col("institucion").asc()], 15,
                            salt_col="institucion")
    return top.select("rol_granular", T.cut("institucion", 90).alias("institucion"),
                      rnd(F.col("mediana")).alias("mediana"), "n", "rank_in_group")


@query("call_level_box", "A26 R23", f"""{SAL}
SELECT * FROM (SELECT nivel AS categoria, count(*) AS n, round(min(salario), 6) AS min,
       round(quantile_cont(salario, 0.25), 6) AS q1, round(median(salario), 6) AS median,
       round(quantile_cont(salario, 0.75), 6) AS q3, round(max(salario), 6) AS max, round(avg(salario), 6) AS mean
       FROM v WHERE {in_list('nivel', BR.PUBLIC_LEVEL_ORDER)} GROUP BY nivel) WHERE n >= 2""")
def call_level_box(spark, sf):
    v = _valid(spark, sf, "nivel").filter(F.col("nivel").isin(BR.PUBLIC_LEVEL_ORDER)).withColumnRenamed("nivel", "categoria")
    return S.five_number(v, "categoria", "salario", 2, digits=6)


@query("call_histogram", "X3", f"""{W},
v AS (SELECT salario AS x FROM calls WHERE {VALID}),
e AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
c AS (SELECT CAST(CASE WHEN e.hi = e.lo THEN 1 ELSE least(floor((x - e.lo) * 30 / (e.hi - e.lo)) + 1, 30) END AS INTEGER) AS bin,
             count(*) AS n FROM v, e GROUP BY 1)
SELECT g.bin, round(e.lo + (g.bin - 1) * (e.hi - e.lo) / 30, 4) AS bin_lo, round(e.lo + g.bin * (e.hi - e.lo) / 30, 4) AS bin_hi,
       coalesce(c.n, 0) AS n
FROM e, (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS bin) g LEFT JOIN c ON c.bin = g.bin""")
def call_histogram(spark, sf):
    return S.histogram(B.calls(spark, sf).filter(T.valid_salary("salario", 100)), "salario", 30)


@query("call_search_index", "H4 C12 C18 T3", f"""{W}
SELECT coalesce(substr(institucion, 1, 120), '') AS i, coalesce(substr(puesto, 1, 200), '') AS p,
       coalesce(substr(departamento, 1, 60), '') AS d,
       CASE WHEN salario > 0 THEN CAST(floor(salario) AS BIGINT) END AS s,
       coalesce(CAST(fecha_limite AS VARCHAR), '') AS f, coalesce(url, '') AS u FROM calls""")
def call_search_index(spark, sf):
    return H.search_index(B.calls(spark, sf))


@query("call_last_extraction", "H6 C13", f"""{W}
SELECT strftime(max(fecha_extraccion), '%Y-%m-%d %H:%M:%S') AS ultima_extraccion,
       lpad(CAST(day(max(fecha_extraccion)) AS VARCHAR), 2, '0') || '-' ||
       ['ene','feb','mar','abr','may','jun','jul','ago','set','oct','nov','dic'][month(max(fecha_extraccion))] || '-' ||
       CAST(year(max(fecha_extraccion)) AS VARCHAR) AS fecha FROM calls""")
def call_last_extraction(spark, sf):
    out = H.last_extraction(B.calls(spark, sf))
    return out.select(F.date_format("ultima_extraccion", "yyyy-MM-dd HH:mm:ss").alias("ultima_extraccion"), "fecha")

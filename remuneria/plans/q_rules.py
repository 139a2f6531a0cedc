"""The study's own rule lists R1-R25 on table text (survey R1-R25).

Part and supplier names of the driver tables hold none of the study's words,
so titles, companies and institutions are built from the line items: each row
takes an entry of a fixed list by its keys, followed by its part or supplier
name. The short words of some lists ('it', 'hr', 'ti', 'data') also run over
the whole texts of ``documents``. Every query counts rows by label.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matcher as X
from ..functions import rules as R
from ..functions import rulesets as RS
from ..functions import scopes as SC
from ..operators import payroll as P
from ..sources import bindings as B
from .registry import query
from .sql_rules import any_of, case, in_list, q

TITLES = [
    "Gerente General", "Subgerente de Ventas", "Director de Marketing", "CEO", "Chief Technology Officer",
    "Jefe de Operaciones", "Supervisor de Planta", "Analista de Riesgo", "Senior Data Scientist", "Developer Backend Jr.",
    "Practicante de Recursos Humanos", "Asistente Contable", "Key Account Manager", "Brand Manager", "Ingeniero de Software",
    "QA Testing Specialist", "Cloud DevOps Engineer", "Médico Especialista", "Abogado", "Psicólogo", "Enfermero",
    "Técnico de Logística", "Auxiliar de Apoyo", "Chofer", "Secretario", "Coordinador de Proyectos TI",
    "Ejecutivo Comercial", "Consultor de Negocios", "Economist Research", "Legal Counsel", "Trainee Supply Chain",
    "Junior Finance Analyst", "Community Manager", "Operador de Mina", "Profesional en Educación",
    "Control de Calidad", "Lead Architect", "Vendedor", "Inside Sales Executive", "Construction Project Manager",
    "Occupational Health Officer", "Vice President of Operations", "Presidente Ejecutivo", "Encargado de Almacén",
    "Desarrollador Frontend", "Director General", "Asesor Financiero"]
COMPANIES = [
    "Banco de Crédito BCP", "Interbank", "BBVA Perú", "Google", "Microsoft", "Deloitte", "EY Perú", "Claro", "Movistar",
    "Alicorp", "Backus", "Rimac Seguros", "Pacifico Seguros", "Coca Cola Services", "L'Oreal", "Belcorp", "Antamina",
    "Southern Peru", "Enel Distribución", "Falabella", "Yape", "Culqi", "Latam Airlines", "Colgate-Palmolive",
    "Procter & Gamble", "Universidad del Pacífico", "Ferreyros", "Talma", "Volcan", "Luz del Sur"]
INSTITUTIONS = [
    "Ministerio de Salud", "Gobierno Regional de Ica", "Municipalidad de Lima", "Hospital Nacional", "Poder Judicial",
    "UGEL 05", "SUNAT", "Reniec", "Juntos", "SIS", "IPD", "INEI", "Defensoría del Pueblo", "Dirección Regional de Salud Cusco",
    "Universidad Nacional de San Martin", "Contraloría General", "Banco de la Nación", "Ministerio de Educación",
    "Municipalidad Distrital de Puno", "Fiscalía de la Nación", "Cuna Más", "Provias Nacional", "Gobierno Regional Ancash",
    "Empresa República SA"]


def _pick(values: list[str], key: str):
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))


def _pick_sql(values: list[str], key: str) -> str:
    return f"[{', '.join(q(v) for v in values)}][1 + {key} % {len(values)}]"


TEXTS = f"""texts AS (
  SELECT {_pick_sql(TITLES, 'l_partkey')} || ' / ' || p_name AS puesto,
         {_pick_sql(COMPANIES, 'l_suppkey')} AS empresa,
         {_pick_sql(INSTITUTIONS, '(l_suppkey + l_linenumber)')} AS institucion, l_extendedprice / 10 AS salario
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def texts(spark, sf):
    li, pa = B.table(spark, sf, "lineitem"), B.table(spark, sf, "part")
    li = li.withColumn("_inst", F.col("l_suppkey") + F.col("l_linenumber"))
    return li.join(pa, li["l_partkey"] == pa["p_partkey"]).select(
        F.concat(_pick(TITLES, "l_partkey"), F.lit(" / "), F.col("p_name")).alias("puesto"),
        _pick(COMPANIES, "l_suppkey").alias("empresa"), _pick(INSTITUTIONS, "_inst").alias("institucion"),
        (F.col("l_extendedprice") / 10).alias("salario"))


NONE = "(sin etiqueta)"


def _by_label(df, columns: list[str], rs: R.RuleSet, repeated: bool = True):
    """Rows by label: equal texts are counted, then judged once; texts that don't repeat are judged as they stand."""
    if repeated:
        return X.count_labels(df, columns, rs, NONE)
    return X.summed_labels(X.label_rows(df.select(*columns), {"__label": (columns, rs)}).withColumn("__n", F.lit(1)), rs, NONE)


def _by_label_sql(source: str, columns: list[str], rs: R.RuleSet) -> str:
    label = case(columns, rs)
    label = f"unnest(CASE WHEN len({label}) > 0 THEN {label} ELSE [{q(NONE)}] END)" if rs.policy == "multi" else f"coalesce({label}, {q(NONE)})"
    return f"SELECT label, count(*) AS n FROM (SELECT {label} AS label FROM {source}) GROUP BY label"


LISTS = [
    (RS.SECTOR_FULL, ["empresa", "puesto"]), (RS.SECTOR_SHORT, ["empresa", "puesto"]), (RS.SECTOR_COMPANY, ["empresa"]),
    (RS.SECTOR_DASHBOARD, ["empresa"]), (RS.LEVEL, ["puesto"]), (RS.SENIORITY_SIMPLE, ["puesto"]), (RS.SENIORITY, ["puesto"]),
    (RS.SENIORITY_WEB, ["puesto"]), (RS.JOB_AREA, ["puesto"]), (RS.CAREER_AREA, ["puesto"]), (RS.TI_AREA, ["puesto"]),
    (RS.SALES_AREA, ["puesto"]), (RS.CONSUMER_ROLE, ["puesto"]), (RS.JUNIOR_AREA, ["puesto"]), (RS.BANK_ROLE, ["puesto"]),
    (RS.MANAGEMENT_LEVEL, ["puesto"]), (RS.ROLE_17, ["puesto"]), (RS.ROLE_CAT, ["puesto"]), (RS.PUBLIC_LEVEL, ["puesto"]),
    (RS.INSTITUTION_TYPE, ["institucion"])]

for _rs, _columns in LISTS:
    query(f"rules_{_rs.name.lower()}", _rs.name.rstrip("w"), f"WITH {TEXTS} {_by_label_sql('texts', _columns, _rs)}")(
        lambda spark, sf, rs=_rs, columns=_columns: _by_label(texts(spark, sf), columns, rs))

for _rs in (RS.JOB_AREA, RS.CAREER_AREA, RS.JUNIOR_AREA, RS.SECTOR_FULL):
    query(f"rules_{_rs.name.lower()}_documents", _rs.name, _by_label_sql("documents", ["text"], _rs))(
        lambda spark, sf, rs=_rs: _by_label(B.table(spark, sf, "documents"), ["text"], rs, repeated=False))

_DEPARTMENT = "CASE " + " ".join(f"WHEN contains(upper(institucion), {q(d)}) THEN {q(d)}" for d in RS.DEPARTMENTS) + " END"


@query("rules_r25", "R25", f"""WITH {TEXTS}
SELECT label, count(*) AS n FROM (SELECT coalesce({_DEPARTMENT}, {q(NONE)}) AS label FROM texts) GROUP BY label""")
def rules_r25(spark, sf):
    counted = texts(spark, sf).groupBy("institucion").agg(F.count(F.lit(1)).alias("n"))
    label = F.coalesce(P.department_of("institucion"), F.lit(NONE))
    return counted.groupBy(label.alias("label")).agg(F.sum("n").alias("n"))


_SCOPES = {
    "R10": any_of("puesto", RS.TI_WORDS), "R11": any_of("puesto", RS.SALES_WORDS), "R12": any_of("puesto", RS.MANAGER_WORDS),
    "R15": f"lower(empresa) IN ({', '.join(q(c.lower()) for c in RS.CONSUMER_COMPANIES)})",
    "R16": f"(regexp_matches(lower(puesto), {q(RS.JUNIOR_REGEX)}) AND NOT {in_list('puesto', RS.JUNIOR_EXCLUDED_TITLES)}"
           f" AND NOT ({any_of('puesto', RS.LEADERSHIP_WORDS)} AND NOT regexp_matches(lower(puesto), {q(RS.CLEAR_JUNIOR_REGEX)}))"
           f" AND NOT salario > {RS.JUNIOR_SALARY_CAP})",
    "R18": f"(lower(empresa) IN ({', '.join(q(c.lower()) for c in RS.TECH_COMPANIES)}) OR regexp_matches(sector, {q(RS.TECH_SECTOR_REGEX)})"
           f" OR {any_of('puesto', RS.TECH_ROLE_WORDS, 'regex')})",
    "R19": f"(lower(empresa) IN ({', '.join(q(c.lower()) for c in RS.BANK_COMPANIES)}) OR regexp_matches(sector, {q(RS.BANK_SECTOR_REGEX)}))",
}


@query("rules_scopes", "R10 R11 R12 R15 R16 R18 R19 J6", f"""WITH {TEXTS},
s AS (SELECT *, {case(['empresa', 'puesto'], RS.SECTOR_FULL)} AS sector FROM texts)
""" + " UNION ALL ".join(f"SELECT '{k}' AS scope, count_if({v}) AS n_in, count_if(NOT {v}) AS n_out FROM s" for k, v in _SCOPES.items()))
def rules_scopes(spark, sf):
    # the scopes ask of a salary only whether it is above the cap
    high = F.when(F.col("salario") > RS.JUNIOR_SALARY_CAP, RS.JUNIOR_SALARY_CAP + 1.0).otherwise(0.0).alias("salario")
    s = texts(spark, sf).groupBy("puesto", "empresa", high).agg(F.count(F.lit(1)).alias("n"))
    s = X.label_rows(s, {"sector": (["empresa", "puesto"], RS.SECTOR_FULL)})
    scopes = {
        "R10": R.flag("puesto", RS.TI_WORDS), "R11": R.flag("puesto", RS.SALES_WORDS), "R12": R.flag("puesto", RS.MANAGER_WORDS),
        "R15": SC.in_names("empresa", RS.CONSUMER_COMPANIES), "R16": SC.junior_scope("puesto", "salario"),
        "R18": SC.any_scope("empresa", "sector", "puesto", RS.TECH_COMPANIES, RS.TECH_SECTOR_REGEX, RS.TECH_ROLE_WORDS),
        "R19": SC.any_scope("empresa", "sector", None, RS.BANK_COMPANIES, RS.BANK_SECTOR_REGEX)}
    rows = s.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("scope"), c.alias("is_in")) for k, c in scopes.items()])).alias("s"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return rows.groupBy("s.scope").agg(n(F.col("s.is_in")).alias("n_in"), n(~F.col("s.is_in")).alias("n_out"))

"""Rule sets R1-R29 of the study on invented fixture rows."""

import random

from pyspark.sql import functions as F

from remuneria.functions import matcher as M
from remuneria.functions import rules as R
from remuneria.functions import rulesets as RS
from remuneria.functions import scopes as SC
from remuneria.operators.payroll import department_of


def labels(spark, texts, rs, cols=None):
    if cols is None:
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r[0] for r in df.orderBy("i").select(R.classify("t", rs)).collect()]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, a string, b string")
    return [r[0] for r in df.orderBy("i").select(R.classify(["a", "b"], rs)).collect()]


def test_last_match_wins(spark):
    # 'Banco' (Banca y Finanzas) and 'Tech' (Tecnología): the later rule wins
    assert labels(spark, [("Banco Tech", "Analista")], RS.SECTOR_FULL, cols=2) == ["Tecnología"]
    assert labels(spark, [("Minera X", "Energy analyst"), (None, None)], RS.SECTOR_FULL, cols=2) == ["Energía", "Otros"]


def test_first_match_wins(spark):
    got = labels(spark, ["Subgerente de ventas", "CEO", "Analista de datos", "Chofer", None], RS.LEVEL)
    assert got == ["Gerente", "C-Level", "Analista", "Otros", "Otros"]


def test_multi_label(spark):
    got = labels(spark, ["gerente de marketing digital", "chofer"], RS.JOB_AREA)
    assert got == [["Gerencial", "Marketing"], []]


def test_seniority_variants(spark):
    assert labels(spark, ["Senior Analyst", "Trainee", "Analista", "Chofer"], RS.SENIORITY) == \
        ["Senior", "Junior", "Mid-Level", "Entry-Level"]
    assert labels(spark, ["Analista"], RS.SENIORITY_SIMPLE) == ["Junior"]


def test_ti_area_tech_lead_is_senior(spark):
    assert labels(spark, ["Tech Lead", "Data Scientist", "QA tester", "Soporte"], RS.TI_AREA) == \
        ["Senior TI", "Data Science/Analytics", "QA/Testing", "TI General"]


def test_public_role_keeps_accents(spark):
    # 'médico' is the keyword, so the unaccented 'Medico' does not match it
    assert labels(spark, ["Médico cirujano", "Medico general", "Chofer"], RS.ROLE_17) == ["Médico", None, "Chofer"]


def test_institution_type_folded_and_exact(spark):
    got = labels(spark, ["DIRECCIÓN REGIONAL DE EDUCACIÓN", "Hospital Loayza", "SIS", "  inei ", "Congreso"],
                 RS.INSTITUTION_TYPE)
    assert got == ["Educación", "Salud / Hospitales", "Salud / Hospitales", "Sup. y Fiscalización", "Otros"]


def test_departments_substring_quirk(spark):
    df = spark.createDataFrame([("GOBIERNO REGIONAL DE PIURA",), ("CONGRESO DE LA REPUBLICA",),
                                ("MINISTERIO DE SALUD",)], "p string")
    got = [r[0] for r in df.select(department_of("p")).collect()]
    assert got == ["PIURA", "ICA", None]
    strict = [r[0] for r in df.select(department_of("p", strict=True)).collect()]
    assert strict == ["PIURA", None, None]


def test_junior_scope(spark):
    df = spark.createDataFrame([
        ("Jr Manager", 3000.0), ("Intern Manager", 3000.0), ("Practicante de ventas", None),
        ("Practicante de ventas", 9000.0), ("Jefe de comunicación interna y gestión del cambio", 1000.0),
        ("Analista", 1000.0)], "p string, s double")
    got = [r[0] for r in df.select(SC.junior_scope("p", "s")).collect()]
    assert got == [True, False, True, False, False, False]


def test_regex_keywords(spark):
    df = spark.createDataFrame([("jrx",), ("jr",), ("jr.",), ("internacional",)], "p string")
    got = [r[0] for r in df.select(F.lower("p").rlike("jr.|intern")).collect()]
    assert got == [True, False, True, True]


def test_flags(spark):
    df = spark.createDataFrame([("Key Account Manager",), ("Vendedor",), ("Developer",)], "p string")
    sales = [r[0] for r in df.select(R.flag("p", RS.SALES_WORDS, none_of=RS.MANAGER_WORDS)).collect()]
    ti = [r[0] for r in df.select(R.flag("p", RS.TI_WORDS)).collect()]
    assert sales == [False, True, False]
    assert ti == [False, False, True]


def test_size_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 5, 6, 10, 11]], "v double")
    got = [r[0] for r in df.select(R.bin_right_closed("v", RS.SIZE_EDGES, RS.SIZE_LABELS)).collect()]
    assert got == [None, "Pequeña", "Pequeña", "Mediana", "Mediana", "Grande", "Grande", "Corporativa"]


def test_income_bands(spark):
    df = spark.createDataFrame([(float(v),) for v in [40000, 30000, 8000, 1499.99, 1500]], "v double")
    got = [r[0] for r in df.select(R.bin_left_closed("v", RS.INCOME_BANDS)).collect()]
    assert got == ["A++", "A++", "A", "E", "D"]


def test_label_columns_match_direct(spark):
    df = spark.createDataFrame([("CEO",), ("CEO",), (None,), ("Analista",)], "p string")
    a = sorted((r[0] or "", r[1]) for r in R.label_columns(df, {"lvl": ("p", RS.LEVEL)}).collect())
    b = sorted((r[0] or "", r[1]) for r in df.select("p", R.classify("p", RS.LEVEL)).collect())
    assert a == b


LISTS = [v for v in vars(RS).values() if isinstance(v, R.RuleSet)]


def test_matcher_equals_the_compiled_rules(spark):
    """Every list of the study, on texts of its keywords cut, joined and changed in case."""
    rng = random.Random(4)
    words = [k for rs in LISTS for r in rs.rules for k in r.keywords] + [k for rs in LISTS for k in rs.exact]
    rows = [(None, "x"), ("", None), (None, None), ("İSTANBUL GERENTE", "ß")]
    for _ in range(400):
        parts = [rng.choice([w, w.upper(), w[1:], w.title(), "é", " ", "Ñ"]) for w in rng.sample(words, 3)]
        rows.append((rng.choice(["", " "]).join(parts), rng.choice(words)))
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "a string, b string, c0 int").repartition(3)
    specs = {f"l{i}": (["a", "b"] if i % 2 else ["a"], rs) for i, rs in enumerate(LISTS)}
    want = df.select("c0", *[R.classify([F.col(c) for c in cols], rs).alias(o) for o, (cols, rs) in specs.items()]).orderBy("c0").collect()
    assert M.label_rows(df, specs).select("c0", *specs).orderBy("c0").collect() == want
    assert M.label_distinct(df, specs).select("c0", *specs).orderBy("c0").collect() == want
    assert any(isinstance(v, list) and v for r in want for v in r) and len(LISTS) >= 19


def test_matcher_counts(spark):
    df = spark.createDataFrame([("Gerente de Ventas",)] * 5 + [("data analyst",), (None,), ("zzz",), ("zzz",)], "t string")
    for rs in (RS.CAREER_AREA, RS.LEVEL, RS.SECTOR_FULL):
        label = R.classify("t", rs)
        label = F.explode(F.when(F.size(label) > 0, label).otherwise(F.array(F.lit("-")))) if rs.policy == "multi" else F.coalesce(label, F.lit("-"))
        want = {r.label: r["count"] for r in df.select(label.alias("label")).groupBy("label").count().collect()}
        assert {r.label: r.n for r in M.count_labels(df, ["t"], rs, "-").collect()} == want
    assert M.count_labels(df.filter("false"), ["t"], RS.LEVEL, "-").collect() == []

"""C-series column functions on the FIXTURES.md edge cases."""

import math

from pyspark.sql import functions as F

from remuneria.functions import text as T


def one_col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_to_number(spark):
    got = one_col(spark, ["12", "a", "", " 7 ", "1e3", "nan", "1,2", "1d", None], T.to_number)
    assert got == [12.0, None, None, 7.0, 1000.0, None, None, None, None]


def test_title_case_matches_python(spark):
    names = ["l'oreal", "beesb2b", "Volcan Cia Minera S.A.A.", "banco DE crédito", "ñandú sac", "x"]
    got = one_col(spark, names, T.title_case)
    assert got == [n.title() for n in names]


def test_salary_text_and_parse(spark):
    texts = ["Rango salarial: S/3,600.00 - S/5,000.00. Otros", "Rango salarial: S/ 4600",
             "paga S/ 1,200.50 - S/ 2,000 al mes", "sin dato", "", None]
    got = one_col(spark, texts, T.salary_text)
    assert got == ["S/3,600", "S/ 4600", "S/ 1,200.50 - S/ 2,000", None, None, None]
    parsed = one_col(spark, ["S/ 1,200.50 - S/ 2,000", "S/ 4600", None, "nada"], T.parse_salary)
    assert tuple(parsed[0]) == (1200.5, 2000.0, 1600.25)
    assert tuple(parsed[1]) == (4600.0, 4600.0, 4600.0)
    assert tuple(parsed[2]) == (None, None, None)
    assert tuple(parsed[3]) == (None, None, None)


def test_salary_patterns_only_where_their_mark_stands(spark):
    got = one_col(spark, ["5 - 7.5", "5-", "-5", "5 7", "- 1-2", "", "x", None], lambda c: T.salary_numbers(c))
    assert [tuple(r) for r in got] == [(5.0, 7.5, 5.0), (None, None, 5.0), (None, None, 5.0), (None, None, 5.0), (1.0, 2.0, 1.0)] + [(None, None, None)] * 3
    assert one_col(spark, ["Rango salarial: nada S/5", "rango salarial: S/ 6 x", "S/", "S /7", "Rango salarial:S/8.9"], T.salary_text) == ["S/5", "S/ 6", None, None, "S/8"]
    df = spark.createDataFrame([("S/ 1",)], "v string")
    plan = df.select(T.salary_text("v"), T.salary_numbers(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    for mark, pattern in (("Rango salarial:", T.RANGE_LABEL), ("S/", T.MONEY_SPAN), ("-", T.RANGE_NUMBERS)):
        assert "regexp_extract(CASE WHEN Contains(v#" in plan and f", {mark}) THEN v#" in plan and pattern in plan


def test_fold_accents(spark):
    got = one_col(spark, ["DIRECCIÓN de Educación", "niño", "Mondelēz"], T.fold)
    assert got == ["direccion de educacion", "nino", "mondelez"]


def test_slug_to_name_keeps_suffix_order(spark):
    got = one_col(spark, ["alicorp-s-a-c-", "banco%20pichincha", "gloria-sac"], T.slug_to_name)
    # '-s-a-' is replaced before '-s-a-c-' (study order), so the C is left over
    assert got == ["Alicorp S.A.C ", "Banco Pichincha", "Gloria Sac"]


def test_word_count_and_length(spark):
    got = one_col(spark, ["a  b c", "", None], T.word_count)
    assert got == [3, 0, None]


def test_spanish_date(spark):
    got = one_col(spark, ["2026-05-28T03:39:48", "no es fecha 123", "", None], T.spanish_date)
    assert got == ["28-may-2026", "no es fech", "—", "—"]


def test_atom_date(spark):
    df = spark.createDataFrame([("2026-05-28",), ("2026-05-28 08:30:00",), ("zz",)], "d string")
    got = [r[0] for r in df.select(T.atom_date(F.col("d"), F.lit("2026-06-01 00:00:00"))).collect()]
    assert got == ["2026-05-28T12:00:00Z", "2026-05-28T08:30:00Z", "2026-06-01T12:00:00Z"]


def test_money_and_positive_int(spark):
    assert one_col(spark, [1234.0, 5.0], T.money_text, "double") == ["S/ 1,234", "S/ 5"]
    assert one_col(spark, [1234.9, 0.0, -3.0, None], T.positive_int, "double") == [1234, None, None, None]


def test_valid_salary_and_rounding(spark):
    assert one_col(spark, [float("nan"), 101.0, 100.0, None], lambda c: T.valid_salary(c, 100), "double") == [False, True, False, False]
    assert one_col(spark, [0.12344999999, -0.00005, 0.125], lambda c: T.rnd(c, 4), "double") == [0.1234, -0.0001, 0.125]


def test_fold_composed_and_decomposed(spark):
    texts = ["DIRECCIÓN", "direccio\u0301n", "Nguyễn", "Nguye\u0302\u0303n", "Ẁ ḃ ǖ", "plain", "Й", None]
    want = ["direccion", "direccion", "nguyen", "nguyen", "w b u", "plain", "и", None]
    assert one_col(spark, texts, T.fold) == want
    assert [T.fold_text(t) for t in texts[:-1]] == want[:-1]


def test_title_case_of_long_runs(spark):
    assert one_col(spark, ["a" * 5000], T.title_case) == ["A" + "a" * 4999]


def test_strict_variants(spark):
    assert one_col(spark, ["alicorp-s-a-c-"], lambda c: T.slug_to_name(c, strict=True)) == ["Alicorp S.A.C."]
    assert one_col(spark, ["Rango salarial: S/3,600.00 - S/5,000.00. Otros"],
                   lambda c: T.salary_text(c, strict=True)) == ["S/3,600.00 - S/5,000.00"]

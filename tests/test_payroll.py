"""Payroll snapshot and per-head income."""

from remuneria.operators import payroll as P

COLS = ("PERIODO string, year int, NIVEL string, SECTOR string, PLIEGO string, UNIDAD_EJECUTORA string, "
        "DESC_TIPO_REGISTRO string, ESTADO_REGISTRO string, DESC_REGIMEN_LABORAL string, "
        "DESC_GRUPO_OCASIONAL string, CANTIDAD int, ING_IMPONIBLE_PERM_MENSUAL double, "
        "ING_NO_IMPONIBLE_PERM_MENSUAL double, INCENTIVO_UNICO_MENSUAL double, COSTO_TOTAL_ANUAL double")


def base(period="20241201", state="OCUPADO", tipo="Activos", cnt=10, inc=(30000.0, None, 5000.0), pliego="M. DE SALUD"):
    return (period, int(period[:4]), "NACIONAL", "SALUD", pliego, "UE 1", tipo, state, "Asistenciales", "Medicos",
            cnt, *inc, 420000.0)


def test_snapshot_ignores_older_period_and_vacancies(spark):
    df = spark.createDataFrame([base(), base(period="20241101"), base(state="VACANTE"),
                                base(tipo="Pensionistas")], COLS)
    snap = P.active_snapshot(df)
    assert snap.count() == 1
    k = P.payroll_kpis(snap).first()
    assert k.total_servidores == 10 and k.ingreso_promedio_mensual == 3500.0
    assert k.costo_total_anual == 420000.0 and k.n_pliegos == 1


def test_income_per_head_rules(spark):
    df = spark.createDataFrame([base(cnt=2, inc=(100.0, None, 20.0)), base(cnt=0, pliego="ZERO", inc=(5.0, 5.0, 5.0))], COLS)
    got = {r.PLIEGO: (r.cantidad, r.ing_prom) for r in P.payroll_by(df, ["PLIEGO"]).collect()}
    assert got == {"M. DE SALUD": (2, 60.0), "ZERO": (0, 0.0)}


def test_timeline_per_year_latest(spark):
    rows = [base(period="20231231"), base(period="20231130", cnt=99), base(period="20241201", cnt=7)]
    t = P.timeline(P.active_snapshot(spark.createDataFrame(rows, COLS), year="year"))
    got = {r.year: r.total_servidores for r in t["kpis"].collect()}
    assert got == {2023: 10, 2024: 7}


def test_grouping_sets_equal_single_groups(spark):
    rows = [base(cnt=i % 7, inc=(1000.0 * i, None if i % 3 else 5.0, 0.1 * i), pliego=None if i % 11 == 0 else f"P{i % 5}") for i in range(200)]
    rows += [base()[:3] + (None,) + base()[4:]]
    snap = spark.createDataFrame(rows, COLS)
    sets = {"a": ["PLIEGO"], "b": ["SECTOR", "PLIEGO"], "c": ["NIVEL"], "again": ["PLIEGO"], "all": []}
    got = P.grouped_at_once(snap, sets)
    for n, keys in sets.items():
        want = sorted(map(tuple, P.payroll_by(snap, keys, digits=6).collect()))
        assert sorted(map(tuple, got[n].selectExpr(*keys, "cantidad", "round(ing_prom, 6)").collect())) == want, n
    empty = P.grouped_at_once(snap.filter("false"), sets)
    assert all(df.count() == 0 for df in empty.values())


def test_snapshot_datasets_equal_the_single_ones(spark):
    rows = [base(cnt=i % 9 + 1, pliego=f"P{i % 5}", inc=(100.0 * i, 1.0, None)) for i in range(60)]
    snap = spark.createDataFrame(rows, COLS)
    got = P.snapshot_datasets(snap, {"por_sector": ["SECTOR"], "burbujas": ["PLIEGO"]}, {"burbujas": 60})
    k = P.payroll_kpis(snap).first()
    assert got["kpis"].select(*k.asDict()).first() == k and got["kpis"].first().periodo == "20241201"
    assert sorted(got["por_sector"].collect()) == sorted(P.payroll_by(snap, ["SECTOR"]).collect())
    assert sorted(got["burbujas"].collect()) == sorted(P.payroll_by(snap, ["PLIEGO"], 60).collect())
    assert sorted(got["pliegos_search"].collect()) == sorted(P.entity_list(snap).collect())

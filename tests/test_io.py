"""Readers and writers round trip (S1-S7, S15, S16, K1-K8) in scratch folders."""

import os
import tempfile

from pyspark.sql import functions as F

from remuneria.operators import history as H
from remuneria.sources import readers as RD
from remuneria.sources import sinks as SK


def scratch():
    return tempfile.mkdtemp(prefix="remuneria-io-")


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_postings_csv_cleaning(spark):
    d = scratch()
    write(os.path.join(d, "salarios.csv"),
          "empresa,puesto,salario_minimo,salario_maximo,salario_promedio,moneda,universidad_principal,url_empresa,"
          "fecha_inicio,fecha_fin,fecha_extraccion\n"
          "  banco alfa ,Analista Senior de Datos ,4000,6000,5000,PEN,U. Uno,,2023-03-01,,2026-03-01T10:00:00\n"
          "l'oreal,Practicante,1000,1200,abc,PEN,,,,,2026-03-01T10:00:00\n")
    df = RD.read_postings(spark, os.path.join(d, "salarios.csv"))
    got = sorted((r.empresa, r.puesto, r.salario_promedio, str(r.fecha_inicio)) for r in df.collect())
    assert got == [("Banco Alfa", "Analista Senior de Datos", 5000.0, "2023-03-01"), ("L'Oreal", "Practicante", None, "None")]


def test_payroll_folder_year_from_file_name(spark):
    d = scratch()
    head = ",".join(RD.PAYROLL_COLUMNS) + "\n"
    row = "{p},{y},12,NACIONAL,SALUD,M. DE SALUD,UE 1,Activos,OCUPADO,CAS,Medicos,x,y,{c},100,,20,1200\n"
    write(os.path.join(d, "PERSONALSP_2024.csv"), head + row.format(p="20241201", y=2024, c=2) + row.format(p="20241101", y=2024, c="zz"))
    write(os.path.join(d, "PERSONALSP_2023.csv"), head + row.format(p="20231231", y=2023, c=3))
    write(os.path.join(d, "PERSONALSP_old.csv"), head + row.format(p="20001231", y=2000, c=1))
    df = RD.read_payroll(spark, d)
    got = sorted((r.year, r.PERIODO, r.CANTIDAD) for r in df.collect())
    assert got == [(2023, "20231231", 3), (2024, "20241101", None), (2024, "20241201", 2)]


def test_history_optional(spark):
    assert RD.read_history(spark, os.path.join(scratch(), "missing.csv")) is None


def test_sinks_roundtrip(spark):
    d = scratch()
    df = spark.createDataFrame([("a", 1.5), ("b", 2.25)], "k string, v double")
    SK.write_csv(df, os.path.join(d, "csv"))
    assert spark.read.option("header", True).csv(os.path.join(d, "csv")).count() == 2
    SK.write_csv(df, os.path.join(d, "tsv"), sep="\t")
    assert spark.read.option("header", True).option("sep", "\t").csv(os.path.join(d, "tsv")).count() == 2
    SK.write_json_datasets({"kpis": df.agg(F.sum("v").alias("total")), "rows": df}, os.path.join(d, "json"))
    assert spark.read.json(os.path.join(d, "json", "kpis")).first().total == 3.75
    SK.write_json(df, os.path.join(d, "doc"))
    assert spark.read.json(os.path.join(d, "doc")).count() == 2
    SK.write_parquet(df.withColumn("year", F.lit(2024)), os.path.join(d, "pq"), partition_by=["year"])
    assert os.path.isdir(os.path.join(d, "pq", "year=2024"))
    casted = SK.postings_for_sql(spark.createDataFrame([(1234.567, "2024-01-02")], "salario_promedio double, fecha_inicio string"))
    assert str(casted.schema["salario_promedio"].dataType) == "DecimalType(10,2)"


def test_atom_xml(spark):
    d = scratch()
    rows = spark.createDataFrame([("http://h/1", "Municipalidad X", "Asistente <legal>", "Lima", 2500.0, "29/05/2026",
                                   "2026-05-20", "2026-05-28", "vigente")],
                                 "url string, institucion string, puesto string, departamento string, salario double, "
                                 "fecha_limite string, primera_vez_visto string, ultima_vez_visto string, estado string")
    rows = rows.withColumn("primera_vez_visto", F.to_date("primera_vez_visto")).withColumn("ultima_vez_visto", F.to_date("ultima_vez_visto"))
    e = H.feed_entries(rows, "2026-05-28")
    first = e.first()
    assert first.title == "Asistente <legal> @ Municipalidad X — S/ 2,500"
    assert first.published == "2026-05-20T12:00:00Z"
    SK.write_atom(e, os.path.join(d, "atom"))
    text = "".join(open(os.path.join(d, "atom", f), encoding="utf-8").read()
                   for f in os.listdir(os.path.join(d, "atom")) if f.startswith("part"))
    assert "<entry>" in text and "&lt;legal" in text and "<legal>" not in text


def test_views_and_sql(spark):
    df = spark.createDataFrame([(1, "2026-01-01"), (2, "2026-02-01")], "id int, fecha_extraccion string")
    names = RD.register_views(spark, {"salarios": df})
    assert "salarios" in names
    assert RD.newest(spark, "salarios", n=1, tiebreak="id").first().id == 2
    assert RD.describe(spark, "salarios").count() == 2


def test_jdbc_options():
    o = RD.jdbc_options("jdbc:mysql://db/x", "salarios", "u", "p", "id", 1, 1000, 16)
    assert o["numPartitions"] == "16" and o["partitionColumn"] == "id" and o["dbtable"] == "salarios"


def test_bucketed_table(spark):
    d = scratch()
    df = spark.createDataFrame([(i % 7, float(i)) for i in range(100)], "empresa int, v double")
    SK.write_table(df, "postings_bucketed", bucket_by=["empresa"], buckets=4, sort_by=["empresa"],
                   path=os.path.join(d, "tbl"))
    t = spark.table("postings_bucketed")
    assert t.count() == 100
    # an aggregation on the bucket column needs no shuffle
    plan = t.groupBy("empresa").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_materialize_bindings(spark):
    from remuneria.sources import bindings as B
    from remuneria.operators import payroll as P
    from conftest import SF_SMALL
    d = scratch()
    paths = B.materialize(spark, SF_SMALL, d, names=("payroll",))
    stored = spark.read.parquet(paths["payroll"])
    assert os.path.isdir(os.path.join(paths["payroll"], "year=1995"))
    a = sorted(tuple(r) for r in P.timeline(P.active_snapshot(stored, year="year"))["kpis"].collect())
    b = sorted(tuple(r) for r in P.timeline(B.payroll_snapshot(spark, SF_SMALL, by_year=True))["kpis"].collect())
    assert a == b


def test_payroll_files_by_name(spark):
    """Own column order in each file, extra and missing columns, a malformed row."""
    d = scratch()
    with open(os.path.join(d, "PERSONALSP_2023.csv"), "w") as f:
        f.write("X,CANTIDAD,PERIODO,ESTADO_REGISTRO\nzzz,5,20231201,OCUPADO\nq,7,20231101,VACANTE\n")
    with open(os.path.join(d, "PERSONALSP_2024.csv"), "w") as f:
        f.write("PERIODO,ESTADO_REGISTRO,CANTIDAD\n20241201,OCUPADO,9\n20241201,OCUPADO,8,too,many\n")
    with open(os.path.join(d, "PERSONALSP_x.csv"), "w") as f:
        f.write("PERIODO\n1\n")
    got = sorted((r.year, r.PERIODO, r.ESTADO_REGISTRO, r.CANTIDAD, r.SECTOR) for r in RD.read_payroll(spark, d).collect())
    assert got == [(2023, "20231101", "VACANTE", 7, None), (2023, "20231201", "OCUPADO", 5, None), (2024, "20241201", "OCUPADO", 9, None)]
    assert [r._corrupt_record for r in RD.read_payroll(spark, d, malformed=True).collect()] == ["20241201,OCUPADO,8,too,many"]


def test_company_list(spark):
    d = scratch()
    SK.write_company_list(spark.createDataFrame([("a", "A"), ("b", "B")], "slug string, nombre string"), d, "2024-01-01", "site")
    got = sorted(tuple(r) for r in SK.read_company_list(spark, d).collect())
    assert got == [("a", "A", 2, "2024-01-01", "site"), ("b", "B", 2, "2024-01-01", "site")]

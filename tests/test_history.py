"""Call history: trend, feed window, merge (batch and stream)."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from remuneria.operators import history as H
from remuneria.sources import bindings as B
from remuneria.streaming import merge as M
from conftest import SF_SMALL

D = dt.date


def hist(spark, rows):
    return spark.createDataFrame(rows, "url string, primera_vez_visto date, ultima_vez_visto date")


def test_trend_fixture(spark):
    d1, d3 = D(2026, 5, 1), D(2026, 5, 3)
    t = H.trend(hist(spark, [("a", d1, d1), ("b", d1, d3), ("c", d3, d3)])).orderBy("fecha").collect()
    assert [(r.fecha, r.nuevas, r.vigentes, r.acumulado) for r in t] == [(d1, 2, 1, 2), (d3, 1, 2, 3)]


def test_recent_window(spark):
    as_of = D(2026, 5, 28)
    rows = [("u1", as_of - dt.timedelta(days=14), as_of), ("u2", as_of - dt.timedelta(days=15), as_of),
            ("", as_of, as_of)]
    got = [r.url for r in H.recent(hist(spark, rows), "2026-05-28").collect()]
    assert got == ["u1"]


def test_merge_observations_states(spark):
    obs = spark.createDataFrame([
        ("u1", D(2026, 5, 1), dt.datetime(2026, 5, 1, 8), "I", "P", "L", 100.0, "x"),
        ("u1", D(2026, 5, 3), dt.datetime(2026, 5, 3, 8), "I2", "P", "L", 200.0, "x"),
        ("u2", D(2026, 5, 1), dt.datetime(2026, 5, 1, 9), "J", "Q", "L", 50.0, "y")],
        "url string, seen_date date, seen_ts timestamp, institucion string, puesto string, departamento string, "
        "salario double, fecha_limite string")
    got = {r.url: (r.estado, r.institucion, r.primera_vez_visto, r.ultima_vez_visto)
           for r in H.merge_observations(obs).collect()}
    assert got["u1"] == ("vigente", "I2", D(2026, 5, 1), D(2026, 5, 3))
    assert got["u2"][0] == "expirada"


COLS = ["url", "institucion", "salario", "primera_vez_visto", "ultima_vez_visto", "estado"]


def same_rows(a, b):
    x, y = (sorted(tuple(r) for r in d.select(COLS).collect()) for d in (a, b))
    assert x == y and len(x) > 0


def write_days(ev, src, spans):
    """One file for each span of days, in this order."""
    for lo, hi in spans:
        ev.filter(F.dayofmonth("ts").between(lo, hi)).coalesce(1).write.mode("append").parquet(src)


def test_stream_equals_batch_over_several_micro_batches(spark):
    ev = B.table(spark, SF_SMALL, "events")
    batch = H.merge_observations(B.observations_from_events(ev))
    for compact in (1, 2, 50):
        src = tempfile.mkdtemp(prefix="z1-src-")
        # the newest days come first: most rows are late, and urls return after any gap
        write_days(ev, src, [(24, 31), (1, 8), (16, 23), (9, 15)])
        same_rows(M.run_merge_stream(spark, src, 1, tempfile.mkdtemp(prefix="z1-out-"), compact), batch)


def test_stream_reads_a_file_or_a_folder(spark):
    ev = B.table(spark, SF_SMALL, "events")
    batch = H.merge_observations(B.observations_from_events(ev))
    folder = os.path.join(tempfile.mkdtemp(prefix="z1-tab-"), "events.parquet")
    ev.repartition(3).write.parquet(folder)
    for source in (folder, f"{SF_SMALL}/events.parquet"):
        same_rows(M.run_merge_stream(spark, source, work_dir=tempfile.mkdtemp(prefix="z1-out-")), batch)


def test_stream_goes_on_where_it_stopped(spark):
    ev = B.table(spark, SF_SMALL, "events")
    src, work = tempfile.mkdtemp(prefix="z1-src-"), tempfile.mkdtemp(prefix="z1-out-")
    write_days(ev, src, [(1, 10)])
    M.run_merge_stream(spark, src, 1, work, 2)
    write_days(ev, src, [(20, 31), (11, 19)])
    log = M.ChangeLog(spark, os.path.join(work, "log"))
    M.run_merge_stream(spark, src, 1, work, 2)
    same_rows(M.read_merged(log), H.merge_observations(B.observations_from_events(ev)))
    assert len(os.listdir(os.path.join(work, "log", "history"))) == 1  # compacted, the old folders are gone


def test_recent_has_an_upper_bound(spark):
    rows = [("a", "2024-01-01"), ("b", "2024-01-09"), ("c", "2023-12-01"), (" ", "2024-01-02")]
    h = spark.createDataFrame(rows, "url string, d string").select("url", F.to_date("d").alias("primera_vez_visto"))
    assert [r.url for r in H.recent(h, "2024-01-08").collect()] == ["a"]


def test_newest_observation_has_no_random_winner(spark):
    obs = spark.createDataFrame([("u", dt.date(2024, 1, 1), dt.datetime(2024, 1, 1), f"I{i}", "p", "d", float(i), "x") for i in range(5)],
                                "url string, seen_date date, seen_ts timestamp, institucion string, puesto string, departamento string, "
                                "salario double, fecha_limite string").repartition(4)
    assert H.merge_observations(obs).first().institucion == "I4"

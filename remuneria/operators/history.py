"""Public-call history (survey H1-H4, H6, A37, U1, W4, Z1 batch).

The history table has one row per call url with ``first_seen`` /
``last_seen`` dates; it is produced from daily observations by
``merge_observations`` (an aggregation keyed by url: partial aggregation
handles a url seen on many days).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FIELDS = ("institucion", "puesto", "departamento", "salario", "fecha_limite")


def merge_observations(obs: DataFrame, url: str = "url", seen: str = "seen_date",
                       order: str = "seen_ts", fields: Sequence[str] = FIELDS) -> DataFrame:
    """Z1 (batch): one row per url: first/last seen date, the fields of the
    newest observation, and the state: 'vigente' when the url was seen in
    the latest snapshot of the whole table, else 'expirada'."""
    latest = obs.agg(F.max(seen)).scalar()
    merged = obs.groupBy(url).agg(
        F.min(seen).alias("primera_vez_visto"), F.max(seen).alias("ultima_vez_visto"),
        F.max(F.struct(order, *fields)).alias("_f"))  # the fields break ties: a total order
    return merged.select(
        url, *[F.col("_f")[c].alias(c) for c in fields], "primera_vez_visto", "ultima_vez_visto",
        F.when(F.col("ultima_vez_visto") == latest, F.lit("vigente")).otherwise(F.lit("expirada")).alias("estado"))


def trend(hist: DataFrame, first: str = "primera_vez_visto", last: str = "ultima_vez_visto") -> DataFrame:
    """H1: for each snapshot date (U1: distinct union of first and last
    seen): new calls that day, calls active in that snapshot, and calls ever
    seen up to that day. The running total (W4) is a window over the
    per-date table: one row per scrape day, bounded by the days of history."""
    # one pass: every call contributes (first_seen: +1 new) and
    # (last_seen: +1 active); the union of the two date sets falls out of
    # the grouping itself
    marks = hist.select(F.explode(F.array(
        F.struct(F.col(first).alias("fecha"), F.lit(1).alias("n"), F.lit(0).alias("a")),
        F.struct(F.col(last).alias("fecha"), F.lit(0).alias("n"), F.lit(1).alias("a")))).alias("m")).select("m.*")
    per_day = (marks.filter(F.col("fecha").isNotNull()).groupBy("fecha")
               .agg(F.sum("n").cast("bigint").alias("nuevas"), F.sum("a").cast("bigint").alias("vigentes")))
    w = Window.orderBy("fecha").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.withColumn("acumulado", F.sum("nuevas").over(w))


def recent(hist: DataFrame, as_of: str, days: int = 14, limit: int = 200,
           first: str = "primera_vez_visto", url: str = "url") -> DataFrame:
    """H2: calls first seen in the last ``days`` days up to ``as_of`` (a
    parameter, never now(); later ones aren't known yet) with a non-empty url; newest first by (first
    seen, url); at most ``limit`` entries (the feed cap is the feature)."""
    cutoff = F.date_sub(F.lit(as_of).cast("date"), days)
    known = F.col(first).between(cutoff, F.lit(as_of).cast("date"))
    keep = hist.filter(known & F.col(url).isNotNull() & (F.trim(F.col(url)) != ""))
    return keep.orderBy(F.col(first).desc(), F.col(url).desc()).limit(limit)


# The texts of a feed entry.
def feed_entries(rows: DataFrame, as_of: str) -> DataFrame:
    """H3: Atom entry fields: title, summary, published/updated (RFC 3339,
    midnight -> noon), two categories."""
    sal = F.when(F.col("salario") > 0, F.floor(F.col("salario")).cast("bigint"))
    sal_text = F.when(sal.isNotNull() & (sal != 0), T.money_text(sal)).otherwise(F.lit("(salario no reportado)"))
    inst = T.blank_to("institucion", "(sin institución)")
    role = T.blank_to("puesto", "(sin puesto)")
    dept = T.blank_to("departamento", "—")
    limit_d = T.blank_to("fecha_limite", "—")
    state = F.coalesce(F.col("estado"), F.lit("vigente"))
    fallback = F.lit(as_of).cast("timestamp")
    return rows.select(
        F.trim("url").alias("id"),
        F.concat(role, F.lit(" @ "), inst, F.lit(" — "), sal_text).alias("title"),
        F.concat(role, F.lit(" en "), inst, F.lit(". Departamento: "), dept, F.lit(". Salario: "), sal_text,
                 F.lit(". Postular hasta: "), limit_d, F.lit(". Estado: "), state, F.lit(".")).alias("summary"),
        T.atom_date(F.col("primera_vez_visto"), fallback).alias("published"),
        T.atom_date(F.coalesce(F.col("ultima_vez_visto"), F.col("primera_vez_visto")), fallback).alias("updated"),
        dept.alias("category_place"), state.alias("category_state"))


def search_index(calls: DataFrame) -> DataFrame:
    """H4: cut fields, whole positive salary, sorted by salary desc with the
    unknown salaries last (ties by url). A global sort: Spark range-
    partitions it, no single task holds all rows."""
    s = T.positive_int("salario")
    out = calls.select(
        F.coalesce(T.cut("institucion", 120), F.lit("")).alias("i"),
        F.coalesce(T.cut("puesto", 200), F.lit("")).alias("p"),
        F.coalesce(T.cut("departamento", 60), F.lit("")).alias("d"),
        s.alias("s"), F.coalesce(F.col("fecha_limite").cast("string"), F.lit("")).alias("f"),
        F.coalesce(F.col("url"), F.lit("")).alias("u"))
    return out.orderBy(F.col("s").desc_nulls_last(), F.col("u").asc())


def state_counts(hist: DataFrame, state: str = "estado") -> DataFrame:
    """A37."""
    return hist.agg(F.count_if(F.col(state) == "vigente").alias("vigentes"),
                    F.count_if(F.col(state) == "expirada").alias("expiradas"))


def last_extraction(df: DataFrame, col: str = "fecha_extraccion") -> DataFrame:
    """H6: date of the newest extraction, as 'dd-mmm-yyyy'."""
    return df.agg(F.max(col).alias("_m")).select(F.col("_m").alias("ultima_extraccion"),
                                                 T.spanish_date(F.col("_m")).alias("fecha"))

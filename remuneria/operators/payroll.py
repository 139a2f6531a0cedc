"""Government payroll (survey J5, W5, R25, R28, A30-A36, H5).

The payroll is a monthly file per year; counting every month would count a
person twelve times, so every figure is taken on a SNAPSHOT: the latest
period (per year for the timeline), record state OCUPADO, record type in
the active set.

Scale: the latest-period table has one row per year (bounded by the number
of years), so it is broadcast explicitly. ``bindings.payroll_snapshot`` takes
the month before any join and filters on the scanned columns. All figures are
one partial+final aggregation keyed by the dimension (and year).
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rnd

from ..functions import rulesets as RS
from . import rank
from .stats import aggregate, distinct_count

INCOMES = ("ING_IMPONIBLE_PERM_MENSUAL", "ING_NO_IMPONIBLE_PERM_MENSUAL", "INCENTIVO_UNICO_MENSUAL")


def active_snapshot(df: DataFrame, period: str = "PERIODO", year: str | None = None,
                    state_col: str = "ESTADO_REGISTRO", type_col: str = "DESC_TIPO_REGISTRO",
                    state: str = RS.ACTIVE_STATE, types: Sequence[str] = tuple(RS.ACTIVE_TYPES)) -> DataFrame:
    """J5 + R28: rows of the latest period (per ``year`` when given; the max is
    lexical on the period string, as the files carry yyyymmdd text), then
    active state and type only. The max is taken BEFORE the state filter."""
    keys = [year] if year else []
    # distinct (year, period) first: a hash aggregate on the keys shrinks the
    # data to one row per period before the (sort-based) max over text
    latest = df.select(*keys, period).distinct().groupBy(*keys).agg(F.max(period).alias("_latest"))
    cond = [F.col(period) == F.col("_latest")] + [df[k] == latest[k] for k in keys]
    # one row per year: bounded by the number of years, safe to broadcast
    snap = df.join(F.broadcast(latest), on=cond, how="inner").drop("_latest", *[latest[k] for k in keys])
    return snap.filter((F.col(state_col) == state) & F.col(type_col).isin(list(types)))


def income_aggs(incomes: Sequence[str] = INCOMES, heads: str = "CANTIDAD") -> dict[str, Column]:
    """Heads and income per head. Incomes are row totals (NULL -> 0);
    the divisor is the sum of heads; 0.0 when it is 0."""
    total_income = F.sum(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in incomes), F.lit(0.0)))
    total_heads = F.sum(F.coalesce(F.col(heads), F.lit(0))).cast("bigint")
    return {
        "cantidad": total_heads,
        "ing_prom": F.when(total_heads == 0, F.lit(0.0)).otherwise(total_income / total_heads),
    }


def payroll_kpis(snap: DataFrame, keys: Sequence[str] = (), with_units: bool = True,
                 digits: int = 2) -> DataFrame:
    """Heads, income per head, total yearly cost, distinct entities
    (and executing units)."""
    a = income_aggs()
    aggs = {"total_servidores": a["cantidad"],
            "ingreso_promedio_mensual": rnd(a["ing_prom"], digits),
            "costo_total_anual": rnd(F.sum(F.coalesce(F.col("COSTO_TOTAL_ANUAL"), F.lit(0.0))), digits),
            "n_pliegos": distinct_count("PLIEGO")}
    if with_units:
        aggs["n_unidades_ejecutoras"] = distinct_count("UNIDAD_EJECUTORA")
    return aggregate(snap, keys, aggs)


def payroll_by(snap: DataFrame, keys: Sequence[str], min_heads: int | None = None,
               digits: int | None = 4) -> DataFrame:
    """Heads and income per head per key set, rounded once; groups under
    ``min_heads`` dropped. NULL keys dropped (pandas groupby)."""
    src = snap
    for k in keys:
        src = src.filter(F.col(k).isNotNull())
    a = income_aggs()
    out = src.groupBy(*keys).agg(a["cantidad"].alias("cantidad"),
                                 (a["ing_prom"] if digits is None else rnd(a["ing_prom"], digits)).alias("ing_prom"))
    if min_heads is not None:
        out = out.filter(F.col("cantidad") >= min_heads)
    return out


def department_of(entity: Column | str, names: Sequence[str] = tuple(RS.DEPARTMENTS),
                  strict: bool = False) -> Column:
    """First department whose name is a substring of the upper-cased
    entity name (list order); NULL = national. Substring semantics by
    default, as the study does ('ICA' also hits 'REPUBLICA');
    ``strict=True`` matches whole words only."""
    import re
    u = F.upper(F.col(entity) if isinstance(entity, str) else entity)
    expr = None
    for d in names:
        hit = u.rlike(r"\b" + re.escape(d) + r"\b") if strict else u.contains(d)
        cond = F.coalesce(hit, F.lit(False))
        expr = F.when(cond, F.lit(d)) if expr is None else expr.when(cond, F.lit(d))
    return expr


def payroll_by_department(snap: DataFrame, entity: str = "PLIEGO",
                          names: Sequence[str] = tuple(RS.DEPARTMENTS)) -> DataFrame:
    """A33."""
    return payroll_by(snap.withColumn("depto", department_of(entity, names)), ["depto"])


def entity_list(snap: DataFrame, min_heads: int = 5, cut: int = 120) -> DataFrame:
    """Entity x level x sector, >= min_heads, names cut, income rounded
    to whole soles."""
    out = payroll_by(snap, ["PLIEGO", "NIVEL", "SECTOR"], min_heads, digits=0)
    return out.select(F.substring("PLIEGO", 1, cut).alias("n"), F.col("NIVEL").alias("l"),
                      F.col("SECTOR").alias("s"), F.col("cantidad").alias("c"),
                      F.col("ing_prom").alias("i"))


def grouped_at_once(snap: DataFrame, sets: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Heads, income and cost for each set of keys, from ONE
    ``GROUPING SETS`` aggregation of ``snap``: a scan and a shuffle of partial
    sums for all sets. The result (one row per group, no facts) is written to
    the shared folder; each returned dataset is a filter on it: its keys,
    cantidad, ing_prom (not rounded), costo. Groups with a null key are dropped
    as in ``payroll_by``; the empty set of keys gives the totals, and no row
    for an empty table. Sets that repeat are computed once."""
    from ..session import Scratch
    names = sorted({k for keys in sets.values() for k in keys})
    wanted = sorted({tuple(sorted(keys)) for keys in sets.values()})
    a = income_aggs()
    slim = snap.select(*names, *INCOMES, "CANTIDAD", "COSTO_TOTAL_ANUAL")
    rows = slim.groupingSets([list(map(F.col, w)) for w in wanted], *names).agg(
        a["cantidad"].alias("cantidad"), a["ing_prom"].alias("ing_prom"),
        F.sum(F.coalesce(F.col("COSTO_TOTAL_ANUAL"), F.lit(0.0))).alias("costo"), F.count(F.lit(1)).alias("n_rows"),
        F.grouping_id().alias("gid"))
    rows = Scratch(snap.sparkSession, "grouping-sets").save(rows.filter("n_rows > 0"))

    def one(keys: Sequence[str]) -> DataFrame:
        # a bit for each name, the first name's the highest: 1 where it isn't grouped by
        gid = sum(1 << (len(names) - 1 - i) for i, n in enumerate(names) if n not in keys)
        out = rows.filter(F.col("gid") == gid)
        for k in keys:
            out = out.filter(F.col(k).isNotNull())
        return out.select(*keys, "cantidad", "ing_prom", "costo")

    return {n: one(keys) for n, keys in sets.items()}


def snapshot_datasets(snap: DataFrame, groups: Mapping[str, Sequence[str]], having: Mapping[str, int], search_min_heads: int = 5,
                      search_cut: int = 120, digits: int = 4) -> dict[str, DataFrame]:
    """K4: the datasets of the snapshot (A30, A32-A36) from one aggregation:
    ``kpis`` with the period, one list for each of ``groups`` (those in
    ``having`` from that many heads on), ``pliegos_search`` (A35)."""
    search = ["PLIEGO", "NIVEL", "SECTOR"]
    parts = grouped_at_once(snap, {**groups, "__all": ["PERIODO"], "__pliego": ["PLIEGO"], "__unidad": ["UNIDAD_EJECUTORA"], "__search": search})
    out = {"kpis": parts["__all"].select(
        F.col("cantidad").alias("total_servidores"), rnd(F.col("ing_prom"), 2).alias("ingreso_promedio_mensual"),
        rnd(F.col("costo"), 2).alias("costo_total_anual"), parts["__pliego"].agg(F.count(F.lit(1))).scalar().alias("n_pliegos"),
        parts["__unidad"].agg(F.count(F.lit(1))).scalar().alias("n_unidades_ejecutoras"), F.col("PERIODO").alias("periodo"))}
    for name, keys in groups.items():
        one = parts[name].select(*keys, "cantidad", rnd(F.col("ing_prom"), digits).alias("ing_prom"))
        out[name] = one.filter(F.col("cantidad") >= having[name]) if name in having else one
    found = parts["__search"].filter(F.col("cantidad") >= search_min_heads)
    out["pliegos_search"] = found.select(
        F.substring("PLIEGO", 1, search_cut).alias("n"), F.col("NIVEL").alias("l"), F.col("SECTOR").alias("s"),
        F.col("cantidad").alias("c"), rnd(F.col("ing_prom"), 0).alias("i"))
    return out


def timeline(snap: DataFrame, year: str = "year", top_sectors: int = 20,
             materialize: bool = False) -> dict[str, DataFrame]:
    """H5: every year at once (no per-year loop) over the yearly snapshot
    (``active_snapshot(df, year=...)``): KPIs, by regime, top sectors, by
    occupational group; incomes rounded to whole soles. ``materialize=True``
    writes the snapshot to the shared folder once, when all four outputs are
    written."""
    if materialize:
        from ..session import Scratch
        snap = Scratch(snap.sparkSession, "payroll").save(snap)
    kp = payroll_kpis(snap, [year], with_units=False, digits=0)
    by_reg = payroll_by(snap, [year, "DESC_REGIMEN_LABORAL"], digits=0)
    by_grp = payroll_by(snap, [year, "DESC_GRUPO_OCASIONAL"], digits=0)
    by_sec = payroll_by(snap, [year, "SECTOR"], digits=0)
    # the sector aggregate is one row per (year, sector); top-k per year on it
    top_sec = rank.top_k_per_group(by_sec, year, [F.col("cantidad").desc(), F.col("SECTOR").asc()],
                                   top_sectors, salt_col="SECTOR")
    return {"kpis": kp, "por_regimen": by_reg, "por_sector": top_sec, "por_grupo": by_grp}

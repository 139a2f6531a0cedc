"""Matrices and trees (survey M1-M5, J3).

A grid is kept in long form (row_key, col_key, value). Dense grids over
FIXED axes are built by exploding the literal list of axis pairs (no join
of two tables), and the aggregate is left-joined onto it; the aggregate has
one row per cell, so the join is bounded by the number of cells.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from . import stats


def cell_stats(df: DataFrame, row: str, col: str, value: str, min_n: int = 1,
               exact: bool = True, written: bool = False) -> DataFrame:
    """Median and row count per (row, col); cells under ``min_n`` rows get a
    NULL median (the study shows an empty cell)."""
    src = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    agg = stats.aggregate(src, [row, col], {"n": F.count(F.lit(1)), "_med": stats.median(value, exact)}, written)
    return agg.select(row, col, "n", F.when(F.col("n") >= min_n, F.col("_med")).alias("median"))


def dense_grid(df: DataFrame, row: str, col: str, value: str, rows: Sequence[str],
               cols: Sequence[str], min_n: int = 2, exact: bool = True) -> DataFrame:
    """M3: every (row, col) of two fixed axes, in axis order, with the median
    when the cell has >= min_n rows, else NULL."""
    spark = df.sparkSession
    pairs = [F.struct(F.lit(r).alias(row), F.lit(c).alias(col),
                      F.lit(i).alias("row_pos"), F.lit(j).alias("col_pos"))
             for i, r in enumerate(rows) for j, c in enumerate(cols)]
    axis = spark.range(1).select(F.explode(F.array(*pairs)).alias("_p")).select("_p.*")
    cells = cell_stats(df.filter(F.col(row).isin(list(rows)) & F.col(col).isin(list(cols))),
                       row, col, value, min_n, exact)
    return (axis.join(cells, [row, col], "left")
            .select(row, col, "row_pos", "col_pos", F.coalesce("n", F.lit(0)).alias("n"),
                    "median"))


def grid_with_top_cols(df: DataFrame, row: str, col: str, value: str, rows: Sequence[str],
                       top_cols: int = 8, exclude_col: str | None = "Otros", min_n: int = 2,
                       exact: bool = True) -> DataFrame:
    """M2: fixed row axis x the ``top_cols`` columns with the highest overall
    median (excluding ``exclude_col``). The column axis has at most
    ``top_cols`` rows; the row axis is a literal list exploded onto it."""
    df = Scratch(df.sparkSession, "grid").save(df.filter(F.col(col).isNotNull()).select(row, col, value))  # read once
    med = stats.aggregate(df, [col], {"_colmed": stats.median(value, exact)}, written=True)
    if exclude_col is not None:
        med = med.filter(F.col(col) != exclude_col)
    top = med.orderBy(F.col("_colmed").desc_nulls_last(), F.col(col).asc()).limit(top_cols)
    axis = top.select(col, F.explode(F.array(*[
        F.struct(F.lit(r).alias(row), F.lit(i).alias("row_pos")) for i, r in enumerate(rows)])).alias("_r")
    ).select(col, "_r.*")
    cells = cell_stats(df.join(F.broadcast(top.select(col)), col, "left_semi")
                       .filter(F.col(row).isin(list(rows))), row, col, value, min_n, exact, written=True)
    return (axis.join(cells, [row, col], "left")
            .select(row, col, "row_pos", F.coalesce("n", F.lit(0)).alias("n"), "median"))


def tree_rows(leaves: DataFrame, label: str, parent: str, value: str, color: str,
              extra_parents: Sequence[str] | None = None) -> DataFrame:
    """M4/M5: (label, parent, value, color) rows: one per leaf, plus one root
    row (parent '', value 0, color 0) per distinct parent -- or per fixed
    parent in ``extra_parents`` when given."""
    leaf = leaves.select(F.col(label).cast("string").alias("label"),
                         F.col(parent).cast("string").alias("parent"),
                         F.col(value).cast("bigint").alias("value"),
                         F.col(color).cast("double").alias("color"))
    if extra_parents is not None:
        spark = leaves.sparkSession
        roots = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in extra_parents])).alias("label"))
    else:
        roots = leaf.select(F.col("parent").alias("label")).distinct()
    roots = roots.select("label", F.lit("").alias("parent"), F.lit(0).cast("bigint").alias("value"),
                         F.lit(0.0).alias("color"))
    return roots.unionByName(leaf)

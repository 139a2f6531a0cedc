"""Line dedup by overlapping three-line windows.

Every run of ``lines_per_window`` consecutive lines is hashed (128 bits). The
earliest occurrence of a window over the whole table, by (doc_id, text hash,
position), stays; every later occurrence is covered, and the union of the
covered positions is removed from the text.

Occurrences are counted with map-side combining, so a passage that a third of
all documents share costs one row per task; only occurrences of windows that
repeat travel further, and nothing is gathered but the positions within one
document.

Defined cases: lines end at ``\\n``; a null text stays null and has no lines;
a text of fewer lines than a window has no window and stays as it is; windows
of blank lines only are ignored; a null doc_id sorts last; of rows that repeat
doc_id and text one is the first and the others lose every line that a window
covers; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from .common import table

LINES = 3


def _windows(lines: Column, n: int) -> Column:
    """Array of the hash pair of each window, by position."""
    def at(i: Column) -> Column:
        part = F.slice(lines, i, n)
        return F.when(F.exists(part, lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
                      F.struct(F.xxhash64(part).alias("h1"), F.xxhash64(F.lit(1), part).alias("h2")))
    return F.transform(F.sequence(F.lit(1), F.size(lines) - (n - 1)), at)


def _key(text: str = "text") -> Column:
    """Order and identity of rows: the id (null last), then the text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", F.xxhash64(text).alias("h"))


def occurrences(docs: DataFrame, n: int = LINES) -> DataFrame:
    """h1, h2, k, i (0-based line) of each window of each row."""
    d = docs.select(_key().alias("k"), F.split("text", "\n", -1).alias("lines")).filter(F.size("lines") >= n)
    d = d.select("k", F.posexplode(_windows(F.col("lines"), n)).alias("i", "w")).filter("w is not null")
    return d.select("w.h1", "w.h2", "k", "i")


def covered_lines(docs: DataFrame, n: int = LINES) -> DataFrame:
    """k, gone: the sorted distinct positions to remove from each row."""
    occ = occurrences(docs, n)
    first = occ.groupBy("h1", "h2").agg(F.min(F.struct("k", "i")).alias("first"), F.max(F.struct("k", "i")).alias("last"))
    # written, so that the join with it is a plain shuffle join whose hot windows Spark can split
    repeated = Scratch(docs.sparkSession, "line-windows").save(first.filter("first != last").select("h1", "h2", "first"))
    later = occ.join(repeated, ["h1", "h2"]).filter(F.struct("k", "i") != F.col("first"))
    starts = later.groupBy("k").agg(F.collect_set("i").alias("starts"))
    return starts.select("k", F.array_sort(F.array_distinct(F.flatten(F.transform(
        "starts", lambda s: F.sequence(s, s + (n - 1)))))).alias("gone"))


def _rows(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text, k, own: the positions that all windows of the text cover,
    for the second and further rows of one doc_id and text; null for others."""
    rows = docs.select("doc_id", "text", _key().alias("k"))
    repeated = rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    scratch = Scratch(docs.sparkSession, "line-windows")
    repeated = scratch.save(repeated)
    alone = F.lit(None).cast("array<int>").alias("own")
    if repeated.isEmpty():
        return rows.select("*", alone)
    # written, so that their numbers stay what they are
    many = scratch.save(rows.join(repeated, "k", "left_semi").withColumn("r", F.monotonically_increasing_id()))
    first = many.groupBy("k").agg(F.min("r").alias("first"))
    lines = F.split("text", "\n", -1)
    starts = F.filter(F.transform(_windows(lines, n), lambda w, i: F.when(w.isNotNull(), i)), lambda i: i.isNotNull())
    own = F.when(F.size(lines) >= n, F.array_sort(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + (n - 1)))))))
    copies = many.join(first, "k").select("doc_id", "text", "k", F.when(F.col("r") != F.col("first"), own).alias("own"))
    return rows.join(repeated, "k", "left_anti").select("*", alone).unionByName(copies)


def line_dedup(docs: DataFrame, n: int = LINES) -> DataFrame:
    """doc_id, text without the later copies, n_lines, n_removed, removed (0-based positions)."""
    d = _rows(docs, n).join(covered_lines(docs, n), "k", "left").withColumn("gone", F.coalesce("own", "gone"))
    lines = F.split("text", "\n", -1)
    gone = F.coalesce(F.col("gone"), F.array().cast("array<int>"))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone),
                                    lambda i: F.get(lines, i)), "\n")
    return d.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
                    F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                    F.size(gone).cast("long").alias("n_removed"), gone.alias("removed"))


def op3_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), w AS (
  SELECT doc_id, i, ls[i + 1 : i + 3] AS win
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS i FROM l WHERE len(ls) >= 3)
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth
  FROM w WHERE regexp_matches(array_to_string(win, chr(10)), '[^\x20\x09-\x0D]')
), gone AS (
  SELECT doc_id, list_sort(list(DISTINCT p)) AS removed
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2])::INTEGER AS p FROM f WHERE nth > 1) GROUP BY doc_id
)
SELECT doc_id,
  CASE WHEN removed IS NULL THEN text ELSE coalesce(array_to_string(
    [ls[p + 1] for p in range(0, len(ls)) if NOT list_contains(removed, p::INTEGER)], chr(10)), '') END AS text,
  coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(removed), 0)::BIGINT AS n_removed,
  coalesce(removed, []) AS removed
FROM l LEFT JOIN gone USING (doc_id)
"""

QUERIES = {"op3_line_windows": op3_line_windows}
ORACLE = {"op3_line_windows": ORACLE_SQL}

"""Many CSV files of one kind in one scan (S5), each with its own column order.

A row that holds the key column's name is its file's header. A first pass over
the lines gathers the headers as a small table by file path; only lines that
hold the key's text are cut into cells. In the scan every other row finds its
values by its file's positions, and only the places up to the last that a file
needs are parsed. So a thousand files are one scan node, whatever their headers
say. A file that can't be used is listed with a reason and the rest are read:

* ``no year in the path``, ``unreadable`` (nothing could be read
  from it), ``no header``, ``more than n columns``, ``columns missing: ...``.

Defined cases: names are compared without case and surrounding blanks, a name
that stands twice counts where it stands first, other columns are ignored;
short rows have nulls at their end; empty cells are null; a file with a header
only gives no rows and isn't listed, nor is a file without a byte, which
Spark's listing leaves out; a folder without files is an error of its path.
Line feeds inside quotes aren't supported, as a split file couldn't be read.
"""

from __future__ import annotations

import functools
import operator
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch

MAX_COLUMNS = 100
#: Headers are broadcast up to this many files (a row each); beyond, they are joined by shuffle.
BROADCAST_FILES = 100_000


def _is(cell: Column, key: str) -> Column:
    return F.coalesce(F.upper(F.trim(cell)) == key.upper(), F.lit(False))


def _found(spark: SparkSession, glob: str, width: int, key: str) -> DataFrame:
    """path, n (rows), names (of the header, ``width`` + 1 places), key_at (the
    last place of the key in any header row). Only lines that hold the key's
    text are cut into cells."""
    lines = (spark.read.option("ignoreCorruptFiles", True).option("pathGlobFilter", "*").text(glob)
             .filter(F.col("value").rlike(r"[^\x00-\x20]")))   # as the CSV reader, without blank lines
    plain = not set(key) & set('"\\')
    maybe = F.upper("value").contains(key.upper()) if plain else F.lit(True)
    schema = ", ".join(f"c{i} string" for i in range(width + 1))
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.when(maybe, F.from_csv("value", schema)).alias("row"))
    rows = rows.select("path", F.when(F.col("row").isNotNull(), F.transform(
        F.array(*[F.col(f"row.c{i}") for i in range(width + 1)]), lambda c: F.upper(F.trim(c)))).alias("names"))
    at = F.array_max(F.transform("names", lambda c, i: F.when(c == key.upper(), i + 1)))
    rows = rows.select("path", "names", at.alias("at"))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("at").isNotNull(), F.col("names"))).alias("names"),
                                    F.max("at").alias("key_at"))


def read_by_name(spark: SparkSession, glob: str, columns: Sequence[str], key: str, year_pattern: str = r"_(\d+)\.csv",
                 max_columns: int = MAX_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(rows: ``columns`` as text, year, path; refused: path, reason)."""
    scratch = Scratch(spark, "many-files")
    found = _found(spark, glob, max_columns, key)
    listed = spark.read.format("binaryFile").load(glob).select("path")
    year = F.nullif(F.regexp_extract("path", year_pattern, 1), F.lit("")).try_cast("int")
    known = listed.join(found, "path", "left").withColumn("year", year)
    places = F.array(*[F.coalesce(F.array_position("names", F.lit(c.upper())), F.lit(0)).cast("int") for c in columns])
    missing = F.concat_ws(", ", *[F.when(~F.array_contains("names", c.upper()) | F.array_contains("names", c.upper()).isNull(), F.lit(c)) for c in columns])
    reason = (F.when(F.col("year").isNull(), "no year in the path")
              .when(F.col("n").isNull(), "unreadable").when(F.col("names").isNull(), "no header")
              .when(F.get("names", F.lit(max_columns)).isNotNull(), f"more than {max_columns} columns")
              .when(missing != "", F.concat(F.lit("columns missing: "), missing)))
    files = scratch.save(known.select("path", "year", places.alias("places"), "key_at", reason.alias("reason")))
    good = files.filter("reason is null").select("path", "year", "places")
    usable, width = files.filter("reason is null").agg(F.count(F.lit(1)), F.max(F.greatest(F.array_max("places"), "key_at"))).first()
    if usable <= BROADCAST_FILES:
        good = F.broadcast(good)
    # no value and no header's key stands further right: the reader parses these places only
    cells = [F.col(f"c{i}") for i in range(width or 1)]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max_columns + 1)])
    raw = (spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True)
           .option("pathGlobFilter", "*").csv(glob))
    header = functools.reduce(operator.or_, [_is(c, key) for c in cells])
    data = raw.filter(~header).select(F.col("_metadata.file_path").alias("path"), F.array(*cells).alias("cells")).join(good, "path")
    out = data.select(*[F.get("cells", F.get("places", F.lit(i)) - 1).alias(c) for i, c in enumerate(columns)], "year", "path")
    return out, files.filter("reason is not null").select("path", "reason")

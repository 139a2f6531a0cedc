"""Exact dedup by deterministic block naming.

1. A text without its ASCII white space is cut, as UTF-8, into blocks of
   ``block_bytes``. All distinct blocks are sorted inside their hash partition
   and named by an integer (partition and rank); equal blocks meet map-side
   first, so a block that a third of all rows hold costs one row per task.
2. Adjacent names of a document form pairs; distinct pairs are sorted and
   named again, until one name is left. (level, name) is the identity: two
   texts have the same one exactly if they are equal. There are
   log2(longest text / block_bytes) rounds and the rows halve in each.

Occurrences fetch their name by a 128-bit hash instead of carrying the text a
second time. That stays free of collisions: the table of names is grouped by
the text itself, so a hash that stands for two texts shows up there, and the
blocks with such a hash are joined by their text instead.

Each table of names is written before it is read, so a lost executor can't
lead to a second numbering. Built from DataFrame functions only.

Defined cases: a null text counts as empty, and empty texts are all equal; of
equal texts the row with the most code points, then the smallest doc_id stays,
a null doc_id last; ids are of any type that can be ordered; rows that share a
doc_id but not the original text are told apart; rows that repeat both count
towards group_size and share one answer; an empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from .common import table, text_of

BLOCK_BYTES = 1024


def squeeze(c: Column) -> Column:
    """Delete [\\x20\\x09-\\x0D]."""
    for ch in " \n\t\r\x0b\x0c":
        c = F.replace(c, F.lit(ch), F.lit(""))
    return c


def hash128(c: Column) -> list[Column]:
    return [F.xxhash64(c), F.xxhash64(F.lit(1), c)]


def _row_key(text: Column) -> Column:
    """Tells rows apart: the id, and the text for rows that repeat an id."""
    return F.struct("doc_id", F.xxhash64(text).alias("h"), F.length(text).alias("n"))


def _cut(docs: DataFrame, block_bytes: int) -> DataFrame:
    d = docs.select(_row_key(text_of()).alias("k"), F.encode(squeeze(text_of()), "UTF-8").alias("b"))
    last = F.greatest(F.lit(0), F.expr(f"(octet_length(b) - 1) div {block_bytes}").cast("int"))
    d = d.select("k", "b", (last + 1).alias("n"))
    return d.select("k", "n", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring("b", i * block_bytes + 1, F.lit(block_bytes)),
    )).alias("i", "block"))


def _numbered(distinct: DataFrame, order: list[str]) -> DataFrame:
    """An integer for each row: its partition and its rank there."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _first_names(docs: DataFrame, block_bytes: int, hashes, scratch: Scratch) -> DataFrame:
    """k, n, i, name for each block."""
    blocks = _cut(docs, block_bytes)
    h1, h2 = hashes(F.col("block"))
    distinct = blocks.select(h1.alias("h1"), h2.alias("h2"), "block").distinct()
    names = scratch.save(_numbered(distinct, ["block"]).select("h1", "h2", "name"))
    at = blocks.select("k", "n", "i", h1.alias("h1"), h2.alias("h2"), "block")
    shared = names.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")
    if shared.isEmpty():
        return at.drop("block").join(names, ["h1", "h2"]).select("k", "n", "i", "name")
    shared = scratch.save(shared)
    by_text = scratch.save(_numbered(distinct.join(shared, ["h1", "h2"], "left_semi"), ["block"])
                           .select("block", (-1 - F.col("name")).alias("name")))
    clear = at.drop("block").join(names.join(shared, ["h1", "h2"], "left_anti"), ["h1", "h2"])
    rest = at.join(shared, ["h1", "h2"], "left_semi").join(by_text, "block")
    return clear.select("k", "n", "i", "name").unionByName(rest.select("k", "n", "i", "name"))


def block_identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hashes=hash128,
                     scratch: Scratch | None = None) -> DataFrame:
    """k (doc_id, h, n of the row), level, name: the identity of each text."""
    scratch = scratch or Scratch(docs.sparkSession, "block-names")
    now = scratch.save(_first_names(docs, block_bytes, hashes, scratch).distinct())
    done, level = [], 0
    while True:
        done.append(now.filter("n = 1").select("k", F.lit(level).alias("level"), "name"))
        left = now.filter("n > 1")
        if left.isEmpty():
            break
        pairs = left.groupBy("k", "n", F.expr("i div 2").cast("int").alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.max(F.col("i") % 2 == 1).alias("two"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(0)).alias("b"))
        pairs = pairs.withColumn("n", F.expr("(n + 1) div 2").cast("int"))
        pairs = scratch.save(pairs)
        key = ["a", "two", "b"]
        names = scratch.save(_numbered(pairs.select(*key).distinct(), key))
        now = scratch.save(pairs.join(names, key).select("k", "n", "i", "name"))
        scratch.drop(pairs, names)
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _grouped(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(every row with its identity, one row per identity: its size and its best row)."""
    scratch = Scratch(docs.sparkSession, "block-names")
    ids = block_identities(docs, block_bytes, scratch=scratch)
    rows = docs.select(_row_key(text_of()).alias("k"), F.sha2(F.encode(squeeze(text_of()), "UTF-8"), 256).alias("text_sha256"))
    rows = rows.join(ids, "k")
    best = F.min_by("k", F.struct(-F.col("k.n"), F.col("k.doc_id").isNull(), F.col("k.doc_id"), F.col("k.h")))
    groups = rows.groupBy("level", "name").agg(F.count("*").alias("group_size"), best.alias("best"))
    # written, so that joins with it are plain shuffle joins whose hot keys Spark can split
    return rows, scratch.save(groups)


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    rows, groups = _grouped(docs, block_bytes)
    return rows.join(groups, ["level", "name"]).select(
        F.col("k.doc_id").alias("doc_id"), F.col("best.doc_id").alias("keep_id"), "group_size",
        F.col("k").eqNullSafe(F.col("best")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one for each text."""
    _, groups = _grouped(docs, block_bytes)
    d = docs.withColumn("__key", _row_key(text_of()))
    return d.join(groups, d["__key"] == groups["best"], "left_semi").dropDuplicates(["__key"]).drop("__key")


def op10_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents
), g AS (
  SELECT bare, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id NULLS LAST) AS keep_id FROM t GROUP BY bare
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(bare) AS text_sha256
FROM t JOIN g USING (bare)
"""

QUERIES = {"op10_block_names": op10_block_names}
ORACLE = {"op10_block_names": ORACLE_SQL}

"""Benchmark decontamination by winnowing.

Test side and training side are fingerprinted alike: of every ``w``
consecutive ``k``-gram hashes the smallest (the rightmost of equals) is kept.
A shared span of ``k + w - 1`` words shares a whole such window, hence the
fingerprint it keeps: with k = 5 and w = 6 every shared span of ten words is
guaranteed a common fingerprint. Fingerprints are joined, and each hit is
extended word by word (five to either side reach every ten-word window around
it); spans of ten words or more count. An item of fewer than ten words is one
window: it is fingerprinted whole, and documents then carry the hashes of all
their runs of such a length (at most nine lengths).

A fingerprint row carries the word hashes around it, so no text is shuffled.
If the test fingerprints are few enough (``PREFILTER_ROWS``, checked), the
training side drops rows that can't join before the shuffle; beyond that size
it ships them all, with the same result.

Words are compared by 64-bit hashes, at least ten in a row (or the whole item).

Defined cases: a null or empty text has no words; rows that repeat doc_id and
text each get the full answer; a null item_id counts as the empty string,
items with one id are one item; items without words never occur; empty tables
give no rows or no hits; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from . import wordarrays as wa
from .common import table, text_of

SPAN, K = 10, 5
REACH = SPAN - K
PREFILTER_ROWS = 1 << 20
CTX = K + 2 * REACH
_MARK = "fp long, at int, n int, lo int, hi int, ctx array<long>"


def _selected(g: np.ndarray, row: np.ndarray, w: int) -> np.ndarray:
    """Positions that some window of ``w`` grams inside one row keeps."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, w):
        c = g[j:n + j]
        take = c <= best
        best = np.where(take, c, best)
        at = np.where(take, np.arange(j, n + j), at)
    keep = np.zeros(len(g), bool)
    keep[at[row[:n] == row[SPAN - 1:SPAN - 1 + n]]] = True
    return np.flatnonzero(keep)


def _context(h: np.ndarray, row: np.ndarray, at: np.ndarray, n: int, reach: int):
    """Word hashes around the grams at ``at`` (n words each): the gram stands at
    REACH, up to ``reach`` words of the same row on either side."""
    first = np.searchsorted(row, row[at])
    end = np.searchsorted(row, row[at], "right")
    lo = np.minimum(at - first, reach)
    hi = np.minimum(end - at - n, reach)
    idx = at[:, None] + np.arange(-REACH, CTX - REACH)
    ctx = h[np.clip(idx, 0, len(h) - 1)]
    off = np.arange(CTX) - REACH
    ctx[(off < -lo[:, None]) | (off >= n + hi[:, None])] = 0
    return lo, hi, ctx


def _marks(h: np.ndarray, counts: np.ndarray, short: list[int], known, whole: bool):
    """(row, fp, at, n, lo, hi, ctx) blocks of a chunk. ``whole``: a row of
    fewer than SPAN words stands as one gram (the test side)."""
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.concatenate([[0], np.cumsum(counts)[:-1]])
    found = []
    g = wa.grams(h, K)
    found.append((K, REACH, g, _selected(g, row, SPAN - K + 1)))
    for n in short:
        g = wa.mix(wa.grams(h, n) ^ np.uint64(n << 32))  # apart from the winnowed grams
        inside = row[:len(g)] == row[n - 1:n - 1 + len(g)]
        if whole:
            full = np.zeros(len(g), bool)
            full[start[counts == n]] = True
            inside = inside & full
        found.append((n, 0, g, np.flatnonzero(inside)))
    for n, reach, g, at in found:
        if known is not None and len(at):
            at = at[known.get_indexer(g[at].view(np.int64)) >= 0]
        if len(at):
            lo, hi, ctx = _context(h, row, at, n, reach)
            size = np.full(len(at), n if reach == 0 else SPAN)
            yield row[at], g[at], at - start[row[at]], size, lo, hi, ctx


def _fingerprint(key_type: str, short: list[int], known: np.ndarray | None, whole: bool):
    """mapInArrow function: (key, h, text) -> a row per input row (fp null) and
    a row per fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None if known is None else pd.Index(known)
        for b in batches:
            for first, data, offsets in wa.chunks(b.column(2)):
                h, counts = wa.words(data, offsets, wa.ALNUM)
                nrows = len(counts)
                keys = b.slice(first, nrows)
                yield pa.record_batch([
                    keys.column(0), keys.column(1), pa.array(counts, pa.int64()),
                    pa.nulls(nrows, pa.int64()), *[pa.nulls(nrows, pa.int32())] * 4,
                    pa.nulls(nrows, pa.list_(pa.int64()))], NAMES)
                for row, fp, at, n, lo, hi, ctx in _marks(h, counts, short, index, whole):
                    lists = pa.ListArray.from_arrays(np.arange(0, CTX * len(fp) + 1, CTX, dtype=np.int32),
                                                     pa.array(ctx.view(np.int64).ravel()))
                    rows = pa.array(row)
                    yield pa.record_batch([
                        keys.column(0).take(rows), keys.column(1).take(rows), pa.nulls(len(fp), pa.int64()),
                        pa.array(fp.view(np.int64)), *[pa.array(x.astype(np.int32)) for x in (at, n, lo, hi)],
                        lists], NAMES)
    return run, f"id {key_type}, h long, n_words long, {_MARK}"


NAMES = ["id", "h", "n_words", "fp", "at", "n", "lo", "hi", "ctx"]


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined hits -> (id, h, item, first, last): the shared span around each
    fingerprint, where it is long enough."""
    for b in batches:
        if not b.num_rows:
            continue
        col = lambda n: b.column(b.schema.get_field_index(n))
        num = lambda n: col(n).to_numpy(zero_copy_only=False)
        ctx = lambda n: np.asarray(col(n).flatten()).reshape(-1, CTX)
        size, lo, hi = num("n"), np.minimum(num("lo"), num("t_lo")), np.minimum(num("hi"), num("t_hi"))
        core = np.where(size == SPAN, K, size)
        off = np.arange(CTX) - REACH
        off_in = (off >= -lo[:, None]) & (off < (core + hi)[:, None])
        same = (ctx("ctx") == ctx("t_ctx")) & off_in
        inner = (off >= 0) & (off < core[:, None])
        ok = (same | ~inner).all(1)
        left = np.cumprod(same[:, REACH - 1::-1], 1).sum(1)
        right = np.cumprod(same | (off < core[:, None]), 1).sum(1) - REACH - core
        ok &= core + left + right >= size
        first = num("at") - left
        out = pa.record_batch([col("id"), col("h"), col("item"), pa.array(first.astype(np.int32)),
                               pa.array((num("at") + core + right - 1).astype(np.int32))],
                              ["id", "h", "item", "first", "last"])
        yield out.filter(pa.array(ok))


def shared_spans(docs: DataFrame, items: DataFrame, scratch: Scratch,
                 prefilter_rows: int = PREFILTER_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows: id, h, n_words for each row of ``docs``; spans: id, h, item,
    first, last for each extended hit)."""
    item_text = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"),
                             F.lit(0).cast("long").alias("h"), text_of().alias("text"))
    f, schema = _fingerprint("string", list(range(1, SPAN)), None, True)
    tests = scratch.save(item_text.mapInArrow(f, schema).filter("fp is not null").select(
        F.col("id").alias("item"), "fp", F.col("n").alias("t_n"), F.col("lo").alias("t_lo"),
        F.col("hi").alias("t_hi"), F.col("ctx").alias("t_ctx")))
    short = sorted(r[0] for r in tests.filter(F.col("t_n") < SPAN).select("t_n").distinct().collect())  # at most 9
    known = None
    few = tests.select("fp").distinct().limit(prefilter_rows + 1).toPandas()
    if len(few) <= prefilter_rows:
        known = few["fp"].to_numpy(np.int64)
    f, schema = _fingerprint(dict(docs.dtypes)["doc_id"], short, known, False)
    doc_text = docs.select("doc_id", F.xxhash64("text"), text_of().alias("text"))
    marks = scratch.save(doc_text.mapInArrow(f, schema))
    hits = marks.filter("fp is not null").drop("n_words").join(tests, (marks["fp"] == tests["fp"]) & (marks["n"] == tests["t_n"]))
    spans = hits.drop("fp", "t_n", "n_words").mapInArrow(_extend, f"id {dict(docs.dtypes)['doc_id']}, h long, item string, first int, last int")
    return marks.filter("fp is null").select("id", "h", "n_words"), spans


def _judged(docs: DataFrame, items: DataFrame, prefilter_rows: int) -> DataFrame:
    """k (id, hash of the text), n_words, n_hit, items for every row."""
    scratch = Scratch(docs.sparkSession, "winnow")
    rows, spans = shared_spans(docs, items, scratch, prefilter_rows)
    spans = scratch.save(spans.distinct().select(F.struct("id", "h").alias("k"), "item", "first", "last"))
    hit = (spans.select("k", F.explode(F.sequence("first", "last")).alias("at")).distinct()
           .groupBy("k").agg(F.count("*").alias("n_hit")))
    found = spans.groupBy("k").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = rows.select(F.struct("id", "h").alias("k"), "n_words")
    out = rows.join(hit.join(found, "k"), "k", "left")
    return out.select("k", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, prefilter_rows: int = PREFILTER_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted), contaminated for every row."""
    out = _judged(docs, items, prefilter_rows)
    return out.select(F.col("k.id").alias("doc_id"), "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, prefilter_rows: int = PREFILTER_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, without a hit: decided by row, whatever ids they share."""
    clean = _judged(docs, items, prefilter_rows).filter("n_hit = 0").select("k").distinct()
    d = docs.withColumn("__key", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")))
    return d.join(clean, d["__key"] == clean["k"], "left_semi").drop("__key")


def op6_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), iw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, ws[p : p + least(len(ws), 10) - 1] AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM i WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, p, n, ws[p : p + n - 1] AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)
), hits AS (
  SELECT doc_id, item, p, dw.n FROM dw JOIN iw USING (win)
), cov AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) FROM hits) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

QUERIES = {"op6_winnow": op6_winnow}
ORACLE = {"op6_winnow": ORACLE_SQL}

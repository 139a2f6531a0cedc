"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams (n = 1, 2, 3, inside words, with
word boundaries) by falling frequency. A language's profile is made from all
its learning texts: n-grams are counted per batch and summed by Spark, and the
``PROFILE`` best ranks stay. A document's own profile is compared to each
language's by the out-of-place distance: how far each of its n-grams stands
from its rank there, ``PROFILE`` for one that is missing. The smallest
distance wins; the score is one minus its share of the largest possible one.

Whole texts are counted. Only the profiles travel to the tasks: ``PROFILE``
n-grams of each language that is learned (``MAX_LANGUAGES`` at most, checked).

Defined cases: ``und`` with score 0 for a null text, one without any letter,
or if no language was learned; equal distances go to the smaller name; equal
counts rank by n-gram code; rows are judged one by one, so repeated rows and
null ids need no care; texts without a language, or with a null one, don't
teach; an empty table gives no row; extra columns pass through ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordarrays as wa
from .common import id_bucket, table, text_of

PROFILE = 400
MAX_LANGUAGES = 5000
UNKNOWN = "und"
BLANK = 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself in lower case if it is a letter, else BLANK."""
    out = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or not chr(c).isalpha():
            continue
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    return out


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letter codes of all rows, each row between blanks and runs of others
    as one blank; row of each)."""
    head = (data & 0xC0) != 0x80
    text = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[head]
    x = _letters()[text]
    cut = np.flatnonzero(np.diff(row)) + 1
    ends = np.stack([cut, cut], 1).ravel()  # a blank after each row and one before the next
    owner = np.stack([row[cut - 1], row[cut]], 1).ravel()
    x = np.concatenate([[BLANK], np.insert(x, ends, BLANK), [BLANK]]).astype(np.uint32)
    row = np.concatenate([row[:1], np.insert(row, ends, owner), row[-1:]])
    keep = np.concatenate([[True], (x[1:] != BLANK) | (x[:-1] != BLANK) | (row[1:] != row[:-1])])
    return x[keep], row[keep]


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, gram, count) of every distinct n-gram of each row, sorted by both.
    A gram packs three code points of 21 bits, 0 for those it doesn't have."""
    if not len(data):
        return
    x, row = _code_points(data, offsets)
    letter = x != BLANK
    alphabet = np.unique(x)
    bits = max(2, int(len(alphabet) + 1).bit_length())
    local = (np.searchsorted(alphabet, x) + 1).astype(np.uint64)  # 0 stays free
    b = np.uint64(bits)
    per_pass = 1 << (64 - 3 * bits)
    for first in range(0, int(row[-1]) + 1, per_pass):
        a, z = np.searchsorted(row, [first, first + per_pass])
        if a == z:
            continue
        y, r, is_letter = local[a:z], (row[a:z] - first).astype(np.uint64) << (b * np.uint64(3)), letter[a:z]
        one = (r | y << (b + b))[is_letter]
        two = (r[:-1] | y[:-1] << (b + b) | y[1:] << b)[row[a:z - 1] == row[a + 1:z]]
        mid = is_letter[1:-1] & (row[a:z - 2] == row[a + 1:z - 1]) & (row[a + 2:z] == row[a + 1:z - 1])
        three = (r[1:-1] | y[:-2] << (b + b) | y[1:-1] << b | y[2:])[mid]
        keys = np.sort(np.concatenate([one, two, three]))
        if not len(keys):
            continue
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(start, len(keys)))
        keys = keys[start]
        wide = np.concatenate([[0], alphabet]).astype(np.uint64)
        m = np.uint64((1 << bits) - 1)
        gram = (wide[(keys >> (b + b) & m).astype(np.int64)] << np.uint64(42)
                | wide[(keys >> b & m).astype(np.int64)] << np.uint64(21) | wide[(keys & m).astype(np.int64)])
        yield (keys >> (b * np.uint64(3))).astype(np.int64) + first, gram.astype(np.int64), count


def _count(lang_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, codes = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            for first, data, offsets in wa.chunks(batch.column(1)):
                for row, gram, count in gram_counts(data, offsets):
                    d = pd.DataFrame({"l": codes[row + first], "g": gram, "c": count}).groupby(["l", "g"], sort=False)["c"].sum()
                    yield pa.record_batch([pa.array(langs[d.index.get_level_values(0)]), pa.array(d.index.get_level_values(1).to_numpy()),
                                           pa.array(d.to_numpy())], ["lang", "gram", "c"])
    return run


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> pd.DataFrame:
    """lang, gram, rank (from 0): the ``size`` most frequent n-grams of each language."""
    teach = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string"), "text")
    counts = teach.mapInArrow(_count("string"), "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "gram")) - 1)
    best = best.filter(F.col("rank") < size).select("lang", "gram", "rank")
    out = best.limit(MAX_LANGUAGES * size + 1).toPandas()
    if len(out) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are taught")
    return out.sort_values(["lang", "rank"], ignore_index=True)


def _by_rank(row: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Order by row, then falling count; equals stay in their order."""
    most, n = int(count.max()), len(row)
    b, c = n.bit_length(), most.bit_length()
    if int(row[-1]).bit_length() + b + c > 64:
        return np.lexsort((-count, row))
    key = (row.astype(np.uint64) << np.uint64(b + c)) | ((most - count).astype(np.uint64) << np.uint64(b)) | np.arange(n, dtype=np.uint64)
    return (np.sort(key) & np.uint64((1 << b) - 1)).astype(np.int64)


def out_of_place(profiles: pd.DataFrame, size: int = PROFILE):
    """Series of texts -> frame of (lang, score)."""
    names = sorted(profiles["lang"].unique())
    grams = np.unique(profiles["gram"].to_numpy(np.int64)) if len(profiles) else np.zeros(0, np.int64)
    ranks = np.full((len(grams) + 1, len(names)), 2 * size, np.int32)  # the last line: in no profile
    if names:
        ranks[np.searchsorted(grams, profiles["gram"].to_numpy(np.int64)), np.searchsorted(names, profiles["lang"].to_numpy(str))] = profiles["rank"]

    def judge(texts: pd.Series) -> pd.DataFrame:
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        index = pd.Index(grams)
        for first, data, offsets in wa.chunks(pa.array(texts, pa.large_string(), from_pandas=True)):
            for row, gram, count in gram_counts(data, offsets):
                by = _by_rank(row, count)
                row, gram = row[by], gram[by]
                start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                n = np.diff(np.append(start, len(row)))
                rank = np.arange(len(row)) - np.repeat(start, n)
                top = rank < size
                row, gram, rank = row[top], gram[top], rank[top]
                there = ranks[index.get_indexer(gram)]
                away = np.minimum(np.abs(there - rank[:, None]), size)
                away[there >= size] = size
                start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                total = np.add.reduceat(away, start, axis=0)
                if not len(names):
                    continue
                best = total.argmin(1)
                most = size * np.diff(np.append(start, len(row)))
                at = row[start] + first
                lang[at] = np.array(names, object)[best]
                score[at] = 1 - total[np.arange(len(best)), best] / most
        return pd.DataFrame({"lang": lang, "score": score})
    return judge


def identify(docs: DataFrame, profiles: pd.DataFrame, size: int = PROFILE) -> Column:
    """Column struct(lang, score) for the texts of ``docs``."""
    judge = F.pandas_udf(out_of_place(profiles, size), "lang string, score double")
    return judge(docs["text"])


def language_of(docs: DataFrame, held_out: Column, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; rows with ``held_out`` don't teach."""
    profiles = learn_profiles(docs.select("text", "lang", held_out.alias("held")).filter("not held"), size)
    d = docs.select("doc_id", held_out.alias("held_out"), text_of().alias("text"))
    d = d.select("doc_id", "held_out", identify(d, profiles, size).alias("p"))
    return d.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op4_lang_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(table(spark, sf_dir, "documents"), id_bucket(3) == 1)


QUERIES = {"op4_lang_rank": op4_lang_rank}
ORACLE: dict[str, str] = {}

"""Spelling variants by asymmetric q-chunks.

Words are near if one inserted, deleted or replaced code point makes one of
the other. Of two words the shorter (of equal lengths the lesser) contributes
two disjoint chunks, its halves; the other contributes its positional grams of
the chunks' lengths. One edit lies in one half, so the other half is
preserved: the first at its place (shift 0), the second shifted by the
difference of the lengths (0 or 1). Only grams at those two places can be the
trace of a preserved chunk; the other positional grams meet no chunk within
that shift and aren't written. Chunks and grams are joined by length, shift
and text, and what meets is verified by edit distance.

A chunk that many words hold (``GROUP_PAIRS`` candidate pairs or more) isn't
joined: with that chunk fixed, the rests of its words must be near, so the
rests contribute chunks and grams in their turn, until groups are small. A
rest of one code point ends it: such words differ in that place alone, and
there are only as many as there are letters. No pair is lost and no group is
paired as a whole.

A word's form is its near word of largest count (of equals the least in
code-point order) if that is at least ``ratio`` times the word's own; forms
are followed to the root by pointer doubling (a chain's counts grow by
``ratio``, so it is short).

Defined cases: a null text has no words; a null doc_id counts as the empty
string; rows that repeat doc_id and text count again; a word without near
words has ``n_near`` 0, no form, and is its own root; empty tables give no
rows; extra columns are ignored. ``near_words`` wants each word once; a null
word is near nothing.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from .common import CRC_TABLE, crc32_sql, table, text_of

MIN_CHARS, MIN_COUNT, RATIO, SLIP = 7, 2, 10, 31
GROUP_PAIRS = 1 << 12
_CHUNK, _GRAM = 1, 2


def slipped(doc_id: Column, run: Column) -> Column:
    """The run as it is counted: one in ``SLIP`` (by crc32 of id and run) loses a code point."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % SLIP == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the letter runs of all texts."""
    low = F.translate(text_of(), string.ascii_uppercase, string.ascii_lowercase)
    # shorter runs can't give a word: a slip only shortens
    runs = F.regexp_extract_all(low, F.lit(r"[a-zÀ-ÿ]{%d,}+" % min_chars), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("run")).select(slipped(F.col("doc_id"), F.col("run")).alias("word"))
    return words.filter(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= min_count)


def _start(words: DataFrame) -> DataFrame:
    """Each word as the one that gives chunks and the one that gives grams, for both shifts."""
    size = F.length("word")
    role = lambda d, side: F.struct(F.lit(d).alias("d"), F.lit(side).alias("side"))
    rows = words.filter("word is not null").select(
        "word", "n", size.alias("hi"), F.explode(F.array(role(0, _CHUNK | _GRAM), role(1, _CHUNK), role(1, _GRAM))).alias("r"))
    length = F.col("hi") - F.when(F.col("r.side") == _GRAM, F.col("r.d")).otherwise(0)
    return rows.select("word", "n", "r.d", "r.side", F.lit(0).alias("lo"), "hi",
                       F.concat_ws(":", length, "r.d").alias("key"))


def _split(rows: DataFrame) -> DataFrame:
    """Two rows of each: one half of ``word[lo:hi]`` joins the key, the other is the rest."""
    lo, hi, key = F.col("lo"), F.col("hi"), F.col("key")
    shift = F.when(F.col("side") == _GRAM, F.col("d")).otherwise(0)
    size = hi - lo - shift                      # of the rest that gives chunks
    half = F.floor(size / 2).cast("int")
    first = F.struct(F.concat(key, F.lit("<"), F.substr(F.col("word"), lo + 1, half)).alias("key"),
                     (lo + half).alias("lo"), hi.alias("hi"))
    last = F.struct(F.concat(key, F.lit(">"), F.substr(F.col("word"), lo + half + shift + 1, size - half)).alias("key"),
                    lo.alias("lo"), (lo + half + shift).alias("hi"))
    return rows.select("word", "n", "d", "side", F.explode(F.array(first, last)).alias("k")).select(
        "word", "n", "d", "side", "k.key", "k.lo", "k.hi")


def near_words(words: DataFrame, scratch: Scratch, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """a, a_n, b, b_n: every pair of near words once."""
    rows, found = scratch.save(_split(_start(words))), []
    while True:
        count = lambda side: F.sum((F.col("side").bitwiseAND(side) != 0).cast("long"))
        pairs = F.when(F.col("d") == 0, F.col("x") * (F.col("x") - 1) / 2).otherwise(F.col("x") * F.col("y"))
        sizes = rows.groupBy("key", "d").agg(count(_CHUNK).alias("x"), count(_GRAM).alias("y"), F.max("hi").alias("hi"),
                                             F.min(F.col("hi") - F.col("lo")).alias("rest"))
        sizes = scratch.save(sizes.select("key", "rest", pairs.cast("double").alias("pairs")).filter("pairs > 0"))
        # a rest of one code point can't be split, and its group is bounded by the letters
        is_hot = (F.col("pairs") > group_pairs) & (F.col("rest") > 1)
        cold = rows.join(sizes.filter(~is_hot).select("key"), "key")
        x = cold.filter(F.col("side").bitwiseAND(_CHUNK) != 0).select("key", "d", F.col("word").alias("a"), F.col("n").alias("a_n"))
        y = rows.filter(F.col("side").bitwiseAND(_GRAM) != 0).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
        met = x.join(y, "key").filter((F.col("d") == 1) | (F.col("a") < F.col("b")))
        found.append(scratch.save(met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")))
        hot = sizes.filter(is_hot).select("key")
        if hot.isEmpty():
            break
        before, rows = rows, scratch.save(_split(rows.join(hot, "key")))
        scratch.drop(before, sizes)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: ``forms`` (word, form) followed to the end."""
    now = scratch.save(forms.select("word", F.col("form").alias("root")))
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = scratch.save(now.join(far, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        scratch.drop(now)
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, ratio: int = RATIO, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (word, n)."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.save(words.select("word", "n"))
    links = near_words(words, scratch, group_pairs)
    both = links.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("l")).select("l.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min_by(
        F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    is_form = F.col("best.near_n") >= F.lit(ratio) * F.col("n")
    table_ = scratch.save(words.join(best, "word", "left").select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near_n")).alias("form_n")))
    ends = roots(table_.filter("form is not null"), scratch)
    return table_.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))


# near words by what one deletion leaves, independently of the chunks
ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), k AS (
  SELECT id || ':' || run AS named, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL
), h AS (
  SELECT run, c, {crc32_sql('named')} AS h FROM k, crc_table
), s AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h
), w AS (
  SELECT word, sum(c)::BIGINT AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), cut AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON w.word = cut.rest
  UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON w.word = cut.rest
), best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(a := -near_n, b := near)) AS m FROM near GROUP BY word
), f AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.a >= 10 * n THEN m.b END AS form, CASE WHEN -m.a >= 10 * n THEN -m.a END AS form_n
  FROM w LEFT JOIN best USING (word)
), r AS (
  SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r USING (word) JOIN f e ON e.word = r.root WHERE e.form IS NULL
"""

QUERIES = {"op11_spelling_chunks": op11_spelling_chunks}
ORACLE = {"op11_spelling_chunks": ORACLE_SQL}

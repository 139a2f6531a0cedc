"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model (a to z, one symbol for any other sign, one for
   the edge of a word: at most 28^3 counts) is learned from all documents.
2. Spans that look obfuscated become character lattices: a sign of leetspeak
   may stand for its letters, a gap in spaced-out letters may be nothing or
   the edge of a word, a letter said three times or more may stand once or
   twice. Viterbi decoding under the character model, with a cost for each
   change, restores the span. A span without such signs has a single path, its
   own letters, so only texts with evidence are decoded.
3. The restored text is scored by its words and word beginnings (hashed).
   Which of them tell toxic texts is counted over all learning rows; the
   ``FEATURES`` most telling ones get weights by logistic regression on a
   sample of at most ``SAMPLE_ROWS`` labelled rows, drawn by a hash of id and
   text from each kind (the documented bound of the fit). Both kinds weigh the
   same in it, so the score isn't the share of toxic texts but tells at 0.5
   which kind a text resembles. Scoring is row-wise over whole texts, without a shuffle.

Only the character model and the weights travel to the tasks; both are bounded
by the constants above.

Defined cases: a null or empty text is scored as empty (the bias alone); rows
are scored one by one, so repeated rows and null ids need no care; a doc_id
with several labels counts as toxic if any is; labels without a document, null
labels and null ids teach nothing; without learning rows of both kinds every
score is the share of toxic rows (0 without rows); an empty table gives no row;
extra columns pass through ``toxicity``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from . import wordarrays as wa
from .common import id_bucket, table, text_of

OTHER, EDGE, SYMBOLS = 26, 27, 28
FEATURE_BITS = 20
RANGES = 64
FEATURES = 4096
SAMPLE_ROWS = 16000
BEGINNINGS = range(3, 9)
#: A feature counts once for each of these numbers of occurrences that a text reaches.
STEPS = np.array([1, 2, 4, 8])

# What a sign may stand for, and the costs of the channel.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
GAPS = " .-_*"
COST_LEET, COST_KEPT, COST_EDGE, COST_REPEAT = 0.5, 1.5, 3.0, 0.5


# -- the character model ---------------------------------------------------

@lru_cache(maxsize=1)
def _symbol_of_byte() -> np.ndarray:
    """Symbol of a byte: a letter, OTHER for the first byte of a longer sign, EDGE, or -1 to skip."""
    out = np.full(256, EDGE, np.int16)
    out[97:123] = out[65:91] = np.arange(26)
    out[128:192] = -1
    out[192:] = OTHER
    return out


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS ** 3, np.int64)
    for b in batches:
        for _, data, offsets in wa.chunks(b.column(0)):
            s = _symbol_of_byte()[np.insert(data, offsets[:-1], 32)]  # a blank before each row
            s = s[s >= 0].astype(np.int64)
            s = np.concatenate([[EDGE], s[np.concatenate([[True], (s[1:] != EDGE) | (s[:-1] != EDGE)])], [EDGE]])
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS ** 3)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], ["t", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(third symbol | two before), from all texts: an array of SYMBOLS^3."""
    counts = docs.select(text_of().alias("text")).mapInArrow(_count_trigrams, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    n = np.zeros(SYMBOLS ** 3)
    got = counts.toPandas()  # at most SYMBOLS^3 rows
    n[got["t"]] = got["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = (n.sum((0, 1)) + 1) / (n.sum() + SYMBOLS)
    two = (n.sum(0) + 5 * one) / (n.sum((0, 2))[:, None] + 5)
    three = (n + 5 * two) / (n.sum(2, keepdims=True) + 5)
    return np.log(three)


# -- lattices and decoding -------------------------------------------------

_LEET = re.escape("".join(LEET))
_UNIT = rf"(?:[^\W\d_]|[{_LEET}])"
#: From the start of a word: three or more single signs with gaps, or a word in
#: which a sign of leetspeak touches a letter or a letter is said three times.
SPAN = re.compile(rf"(?<![^\W_])(?<![{_LEET}])(?:{_UNIT}(?:[{re.escape(GAPS)}]{_UNIT}(?![^\W_])){{2,}}"
                  rf"|(?:[^\W_]|[{_LEET}])*?(?:[{_LEET}](?=[^\W\d_])|(?<=[^\W\d_])[0-9@|€]|([^\W\d_])\1\1)(?:[^\W_]|[{_LEET}])*)")


def _symbol(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else EDGE if c in " " else OTHER


def _lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each step the (output, cost) of its alternatives."""
    spaced = len(span) > 2 and any(c in GAPS for c in span)
    signs = sum(c in LEET for c in span)
    kept = COST_KEPT if sum(c.isalpha() for c in span) >= max(2, signs) else 0.0  # a sign among letters
    steps, i = [], 0
    while i < len(span):
        c, j = span[i], i
        while j < len(span) and span[j] == c:
            j += 1
        if spaced and c in GAPS:
            steps.append([("", 0.0), (" ", COST_EDGE)])
            i += 1
        elif c.isalpha() and j - i >= 3:
            steps.append([(c, COST_REPEAT), (c + c, 2 * COST_REPEAT), (c * (j - i), 0.0)])
            i = j
        elif c in LEET:
            steps.append([(x, COST_LEET) for x in LEET[c]] + [(c, kept)])
            i += 1
        else:
            steps.append([(c, 0.0)])
            i += 1
    return steps


def decode(span: str, log_p: list) -> str:
    """The most likely original of a span: Viterbi over its lattice."""
    states = {(EDGE, EDGE): (0.0, "")}
    for step in _lattice(span) + [[(" ", 0.0)]]:
        new: dict = {}
        for (a, b), (score, text) in states.items():
            for out, cost in step:
                s, x, y = score - cost, a, b
                for c in out:
                    z = _symbol(c)
                    if z == EDGE and y == EDGE:
                        continue
                    s += log_p[x][y][z]
                    x, y = y, z
                if (old := new.get((x, y))) is None or s > old[0]:
                    new[x, y] = (s, text + out)
        states = new
    return max(states.values(), key=lambda v: (v[0], v[1]))[1].rstrip(" ")


_ASCII = np.array([chr(c) for c in range(128)])
_LETTER = np.char.isalpha(_ASCII)
_SIGN = np.isin(_ASCII, list(LEET))
_ALNUM = np.char.isalnum(_ASCII)
_GAP = np.isin(_ASCII, list(GAPS))


@lru_cache(maxsize=1)
def _lower_case() -> np.ndarray:
    """The lower case of each code point (its first sign; one sigma)."""
    out = np.array([c if 0xD800 <= c < 0xE000 else ord(chr(c).lower()[0]) for c in range(0x110000)], np.uint32)
    out[0x3C2] = 0x3C3
    return out


def _evidence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows in which some span may have more than one path. Signs beyond ASCII
    count as whatever would make a span, without a look at their kind."""
    start = offsets
    if (data >= 128).any():
        begin = np.flatnonzero((data & 0xC0) != 0x80)
        start = np.searchsorted(begin, offsets)
        data = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        low = _lower_case()[data]
    else:
        low = data | 0x20
    wild = data >= 128
    of = lambda table: table[np.where(wild, 0, data)]
    letter, sign, alnum, gap = of(_LETTER) | wild, of(_SIGN), of(_ALNUM), of(_GAP)
    hit = data == ord("€")
    digit = sign | (data == ord("2"))  # a 2 begins no change, but a span that may go on to one
    hit[:-1] |= digit[:-1] & letter[1:]
    hit[1:] |= digit[1:] & letter[:-1]
    if len(data) > 2:
        hit[2:] |= letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    if len(data) > 4:
        edge = np.zeros(len(data) + 1, bool)
        edge[start] = True
        unit = letter | sign
        spaced = unit[:-4] & gap[1:-3] & unit[2:-2] & gap[3:-1] & unit[4:]
        spaced[1:] &= edge[1:len(spaced)] | ~(alnum | sign)[:len(spaced) - 1]
        spaced[:-1] &= edge[5:-1] | ~alnum[5:]
        hit[:-4] |= spaced
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(start, np.flatnonzero(hit), "right") - 1] = True
    return out


class Restorer:
    """Lower-cases texts and decodes their obfuscated spans; remembers spans."""

    def __init__(self, log_p: np.ndarray):
        self.log_p, self.known = log_p.tolist(), {}

    def _span(self, m: re.Match) -> str:
        s = m[0]
        if (out := self.known.get(s)) is None:
            if len(self.known) > 200_000:  # a cache, not a result
                self.known.clear()
            out = self.known[s] = decode(s, self.log_p)
        return out

    def text(self, s: str) -> str:
        return SPAN.sub(self._span, s)

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
        look = _evidence(data, offsets)
        raw = data.tobytes()
        if not look.any():
            return pa.array([raw.decode().lower()]) if len(look) == 1 else pa.array([raw[a:z].decode().lower() for a, z in zip(offsets[:-1], offsets[1:])])
        rows = (raw[a:z].decode().lower() for a, z in zip(offsets[:-1], offsets[1:]))
        return pa.array([self.text(s) if x else s for s, x in zip(rows, look)], pa.large_string())


# -- features and weights --------------------------------------------------

_LETTERS = wa.byte_class(words="abcdefghijklmnopqrstuvwxyz")


def _per_row(data: np.ndarray, offsets: np.ndarray, chosen: pd.Index | None = None):
    """(row, feature, count) of each word and each beginning of a word, sorted,
    and the words per row; with ``chosen``, the position of its features there."""
    starts, lengths, hashes = wa.word_starts(data, offsets, _LETTERS, BEGINNINGS)
    row = np.searchsorted(offsets, starts, "right") - 1
    keys = []
    for m, h in hashes.items():
        has = lengths >= m
        feat = (wa.mix(h[has] + np.uint64(m)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
        r = row[has]
        if chosen is not None:
            feat = chosen.get_indexer(feat)
            r, feat = r[feat >= 0], feat[feat >= 0]
        keys.append(r << FEATURE_BITS | feat)
    key = np.sort(np.concatenate(keys))
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key, count = key[start], np.diff(np.append(start, len(key)))
    return key >> FEATURE_BITS, key & ((1 << FEATURE_BITS) - 1), count, np.bincount(row, minlength=len(offsets) - 1)


def design(row: np.ndarray, feat: np.ndarray, count: np.ndarray, words: np.ndarray, n_features: int):
    """Sparse rows of the regression: (row, column, value). A feature has a
    column per step of its count; the last column is the length of the text."""
    rows, cols = [np.arange(len(words))], [np.full(len(words), n_features * len(STEPS))]
    for i, least in enumerate(STEPS):
        has = count >= least
        rows.append(row[has])
        cols.append(feat[has] * len(STEPS) + i)
    value = np.ones(sum(map(len, rows)))
    value[:len(words)] = np.log1p(words) / 10
    return np.concatenate(rows), np.concatenate(cols), value


def _restored_chunks(texts: pa.Array, restorer: Restorer):
    for first, data, offsets in wa.chunks(texts):
        for at, d, o in wa.chunks(restorer.chunk(data, offsets), 1 << 40):
            yield first + at, d, o


def _count_features(log_p: np.ndarray):
    """(text, toxic) -> in how many toxic and other texts each feature occurs, by range of features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, n = Restorer(log_p), np.zeros((2, 1 << FEATURE_BITS), np.int64)
        rows = np.zeros(2, np.int64)
        for b in batches:
            toxic = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            rows += np.bincount(toxic, minlength=2)
            for first, data, offsets in _restored_chunks(b.column(0), restorer):
                row, feat, _, _ = _per_row(data, offsets)
                for t in (0, 1):
                    n[t] += np.bincount(feat[toxic[first + row] == t], minlength=1 << FEATURE_BITS)
        if rows.sum():
            size = (1 << FEATURE_BITS) // RANGES
            blob = lambda t, r: pa.compress(n[t, r * size:(r + 1) * size].tobytes(), "zstd", asbytes=True)
            yield pa.record_batch([pa.array(np.arange(RANGES)), pa.array([blob(1, r) for r in range(RANGES)]),
                                   pa.array([blob(0, r) for r in range(RANGES)]),
                                   *[pa.array([int(rows[t])] * RANGES) for t in (1, 0)]], ["r", "toxic", "other", "n1", "n0"])
    return run


def _tell(t: pa.Table) -> pa.Table:
    """One range: how far each feature tells toxic texts from others (a z value of the two shares)."""
    size = (1 << FEATURE_BITS) // RANGES
    add = lambda c: sum(np.frombuffer(pa.decompress(x, 8 * size, "zstd", asbytes=True), np.int64) for x in t[c].to_pylist())
    a, b = add("toxic"), add("other")
    n1, n0 = (sum(t[c].to_pylist()) for c in ("n1", "n0"))
    p, q, m = a / max(n1, 1), b / max(n0, 1), (a + b) / max(n1 + n0, 1)
    z = (p - q) / np.sqrt(m * (1 - m) * (1 / max(n1, 1) + 1 / max(n0, 1)) + 1e-12)
    at = np.flatnonzero((a + b >= 4) & (np.abs(z) > 3) & (m < 0.9))
    return pa.table({"f": pa.array(at + t["r"][0].as_py() * size), "z": pa.array(np.abs(z[at]))})


def _sample_rows(log_p: np.ndarray, chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, index = Restorer(log_p), pd.Index(chosen)
        for b in batches:
            for first, data, offsets in _restored_chunks(b.column(0), restorer):
                row, at, count, words = _per_row(data, offsets, index)
                edge = np.searchsorted(row, np.arange(len(offsets))).astype(np.int32)
                yield pa.record_batch([
                    b.column(1).slice(first, len(offsets) - 1),
                    pa.ListArray.from_arrays(edge, pa.array(at.astype(np.int32))),
                    pa.ListArray.from_arrays(edge, pa.array(count.astype(np.int32))),
                    pa.array(words.astype(np.int64)),
                    b.column(2).slice(first, len(offsets) - 1)], ["toxic", "f", "c", "words", "h"])
    return run


def fit_weights(row: np.ndarray, feat: np.ndarray, value: np.ndarray, y: np.ndarray, n_features: int,
                weight: np.ndarray, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse weighted rows (mean weight 1) by Adam; (weights, bias)."""
    share = (weight * y).mean()
    w, bias = np.zeros(n_features), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[feat] * value, minlength=len(y)) + bias, -30, 30)))
        e = weight * (p - y) / len(y)
        g = np.append(np.bincount(feat, e[row] * value, minlength=n_features) + l2 * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def draw(rows: DataFrame, n: dict[int, int], sample_rows: int) -> tuple[dict[int, DataFrame], dict[int, int]]:
    """({toxic: its rows up to the hash of the last one drawn}, {toxic: how many
    are drawn}) of ``rows`` (toxic, h, ...), ``n`` of them by kind: in proportion,
    but a quarter of the sample (or all there are) of each kind. More rows than
    are drawn come only where several have that last hash."""
    total = n[0] + n[1]
    if total <= sample_rows:
        return {t: rows.filter(F.col("toxic") == t) for t in (0, 1)}, n
    least = {t: min(n[t], max(1, sample_rows // 4)) for t in (0, 1)}
    toxic = min(max(round(sample_rows * n[1] / total), least[1]), max(1, sample_rows - least[0]))
    quota = {0: max(1, sample_rows - toxic), 1: toxic}
    out = {}
    for t in (0, 1):
        of = rows.filter(F.col("toxic") == t)
        last = of.select("h").orderBy("h").limit(quota[t]).agg(F.max("h")).first()[0]
        out[t] = of.filter(F.col("h") <= last)
    return out, quota


def learn(docs: DataFrame, labels: DataFrame, log_p: np.ndarray, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) from ``docs`` (doc_id, text) that have a label."""
    scratch = Scratch(docs.sparkSession, "toxic")
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = scratch.save(docs.select("doc_id", text_of().alias("text")).join(known.hint("merge"), "doc_id")
                        .select("text", "toxic", F.xxhash64(F.lit(7), "doc_id", "text").alias("h")))
    told = rows.select("text", "toxic").mapInArrow(_count_features(log_p), "r long, toxic binary, other binary, n1 long, n0 long").groupBy("r").applyInArrow(_tell, "f long, z double")
    chosen = np.sort(told.orderBy(F.desc("z"), "f").limit(FEATURES).toPandas()["f"].to_numpy(np.int64))
    n = dict(rows.groupBy("toxic").count().collect())
    total = sum(n.values())
    if len(n) < 2:
        scratch.close()
        return chosen[:0], np.zeros(1), 40.0 if 1 in n else -40.0
    sample, quota = draw(rows, n, sample_rows)
    sample = [x.mapInArrow(_sample_rows(log_p, chosen), "toxic int, f array<int>, c array<int>, words long, h long").orderBy("h").limit(quota[t])
              for t, x in sample.items()]
    got = sample[0].unionByName(sample[1]).toArrow()
    scratch.close()
    y = got["toxic"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        raise ValueError(f"{total} labelled rows of both kinds, but a sample of {len(y)} with {int(y.sum())} toxic ones")
    weight = np.where(y == 1, 1 / quota[1], 1 / quota[0])  # both kinds weigh the same: one toxic word must outweigh the bias
    size = np.array([len(x) for x in got["f"].to_pylist()])
    f, c = (np.concatenate([np.asarray(x, np.int64) for x in got[k].to_pylist()] or [np.zeros(0, np.int64)]) for k in ("f", "c"))
    row, col, value = design(np.repeat(np.arange(len(y)), size), f, c, got["words"].to_numpy(), len(chosen))
    w, bias = fit_weights(row, col, value, y, len(chosen) * len(STEPS) + 1, weight / weight.mean())
    return chosen, w, bias


def toxicity(docs: DataFrame, labels: DataFrame, teach: Column) -> Column:
    """Column with the score of each text of ``docs``; rows with ``teach`` may teach."""
    log_p = character_model(docs)
    chosen, weights, bias = learn(docs.filter(teach), labels, log_p)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer, index = Restorer(log_p), pd.Index(chosen)
        for texts in batches:
            out = np.full(len(texts), bias)
            for first, data, offsets in _restored_chunks(pa.array(texts, pa.large_string(), from_pandas=True), restorer):
                row, col, value = design(*_per_row(data, offsets, index), len(chosen))
                out[first:first + len(offsets) - 1] += np.bincount(row, weights[col] * value, minlength=len(offsets) - 1)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -40, 40))))

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")(docs["text"])


def restored(docs: DataFrame) -> DataFrame:
    """doc_id, text (lower case, restored) for every row."""
    log_p = character_model(docs)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(log_p)
        for texts in batches:
            yield texts.map(lambda s: None if s is None else restorer.text(s.lower()))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.select("doc_id", F.pandas_udf(run, "string")(docs["text"]).alias("text"))


def judge(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    d = docs.select("doc_id", "text")
    d = d.select("doc_id", held_out.alias("held_out"), toxicity(d, labels, ~held_out).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_toxic_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_bucket(5) == 0)


QUERIES = {"op7_toxic_channel": op7_toxic_channel}
ORACLE: dict[str, str] = {}

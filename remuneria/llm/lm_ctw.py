"""LM scoring by context-tree weighting over bytes, binary-decomposed.

A byte is eight binary decisions; each of the 255 decision nodes has its own
context tree over the ``DEPTH`` preceding bytes. A tree node keeps how often
its decision was 0 and 1 in the training texts, estimates by
Krichevsky-Trofimov, and weights its own estimate against the product of its
children: ``Pw = (KT + prod Pw(child)) / 2``, leaves ``Pw = KT``. The next bit
is predicted by mixing the KT estimates along the path with the weights that
follow from these probabilities. A node that training never visited has no
estimate of its own and takes its parent's, so every decision still sums to
one over its two outcomes. A text ends with the byte 0xFF, which UTF-8 never
contains; the same byte pads the context before the first one. The score of a
text is the log10 of the product over its bytes and the end.

How it is spread:

1. Texts are dealt into blocks of a few MB. A block sends its distinct
   (context, byte) grams with their training counts, in buckets by the three
   nearest context bytes. No text travels for the counts.
2. Counts are merged per bucket (salted by block, so a bucket that all blocks
   feed is split), and the tree from depth 3 down is computed there, over the
   distinct grams that share their three nearest bytes: their number depends
   on the variety of the text, not on its amount. Depths 0 to 2 are DataFrame
   aggregations over the depth-3 nodes. The number of buckets follows the
   input.
3. The log probability of each gram returns to the blocks that have it, and
   texts are scored by lookup. Traffic is the distinct grams per block, so it
   follows the input and nothing is broadcast.

The word unigram baseline takes the same way, words standing for grams (by
64-bit hashes).

Defined cases: a null text is empty and consists of its end; rows are scored
one by one, so repeated rows and null ids need no care; without training texts
every bit costs one bit and N = V = 0; an empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import Scratch
from . import wordarrays as wa
from .common import id_bucket, table, text_of

DEPTH = 6
PAD = 0xFF
BLOCK_BYTES = 8 << 20
MAX_BUCKETS = 1 << 16
BLOCKS_PER_TASK = 256
GRAM, WORD = 0, 1
NO_BLOCK = -1


# -- numbers ---------------------------------------------------------------

def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series eight steps up."""
    y = x + 8
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    steps = np.ones_like(x)
    for i in range(8):
        steps = steps * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(steps)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - np.log(np.pi) - _lgamma(a + b + 1.0)


def pack(x: np.ndarray) -> bytes:
    """Rising integers, as compressed byte planes of their steps."""
    steps = np.diff(x.astype(np.uint64), prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def pack_counts(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def pack_values(x: np.ndarray) -> bytes:
    """Single-precision numbers, as compressed byte planes."""
    return pa.compress(np.ascontiguousarray(x.astype(np.float32).view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unpack_values(b: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(b, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view(np.float32).ravel()


def _planes(b: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(b, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(np.uint64).ravel()


def unpack(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(_planes(b, n))


def unpack_counts(b: bytes, n: int) -> np.ndarray:
    return _planes(b, n).astype(np.int64)


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


# -- texts to grams --------------------------------------------------------

def byte_grams(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """One gram per byte and end of each row: the context, nearest byte first,
    then the byte. Row i has offsets[i + 1] - offsets[i] + 1 grams."""
    n = np.diff(offsets)
    rows = len(n)
    x = np.full(len(data) + rows * (depth + 1), PAD, np.uint8)
    shift = np.repeat(np.arange(rows) * (depth + 1) + depth, n)
    x[np.arange(len(data)) + shift] = data
    wide = x.astype(np.uint64)
    begin = offsets[:-1] + np.arange(rows) * (depth + 1) + depth
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(n + 1)[:-1]]), n + 1) + np.arange(len(data) + rows)
    key = wide.copy()
    for d in range(1, depth + 1):
        key[d:] |= wide[:-d] << np.uint64(8 * (depth + 1 - d))
    return key[at]


def _bucket(keys: np.ndarray, kind: int, depth: int, buckets: int) -> np.ndarray:
    top = keys >> np.uint64(8 * (depth - 2)) if kind == GRAM else keys
    return (wa.mix(top + np.uint64(kind)) % np.uint64(buckets)).astype(np.int64)


def _distinct(keys: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each stands in training rows."""
    order = np.sort(keys[~held])
    start = _runs(order)
    seen, count = order[start], np.diff(np.append(start, len(order)))
    other = np.sort(keys[held])
    other = other[_runs(other)]
    other = other[np.isin(other, seen, assume_unique=True, kind="sort")  == False]  # noqa: E712
    both = np.concatenate([seen, other])
    by = np.argsort(both)
    return both[by], np.concatenate([count, np.zeros(len(other), np.int64)])[by]


def _block_keys(docs: pa.Table, depth: int):
    """(grams, words, row of each, words per row, bytes per row) of a block, chunk by chunk."""
    for first, data, offsets in wa.chunks(docs["text"]):
        words, counts = wa.words(data, offsets)
        yield first, byte_grams(data, offsets, depth), words, np.diff(offsets), counts


_SENT = "block long, salt long, kind int, bucket long, n long, keys binary, counts binary"


def _count(depth: int, buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        held = docs["held_out"].to_numpy(zero_copy_only=False) if docs.num_rows else np.zeros(0, bool)
        parts = {GRAM: ([], []), WORD: ([], [])}
        for first, grams, words, n_bytes, n_words in _block_keys(docs, depth):
            h = held[first:first + len(n_bytes)]
            for kind, keys, n in ((GRAM, grams, n_bytes + 1), (WORD, words, n_words)):
                parts[kind][0].append(keys)
                parts[kind][1].append(np.repeat(h, n))
        block = docs["block"][0].as_py()
        rows = []
        for kind, (keys, h) in parts.items():
            k, c = _distinct(np.concatenate(keys), np.concatenate(h))
            b = _bucket(k, kind, depth, buckets)
            by = np.argsort(b, kind="stable")
            k, c, b = k[by], c[by], b[by]
            start = _runs(b)
            for a, z in zip(start, np.append(start[1:], len(b))):
                rows.append((kind, int(b[a]), int(z - a), pack(k[a:z]), pack_counts(c[a:z])))
        cols = list(zip(*rows))
        return pa.table({"block": pa.array([block] * len(rows), pa.int64()),
                         "salt": pa.array([block // BLOCKS_PER_TASK] * len(rows), pa.int64()),
                         "kind": pa.array(cols[0], pa.int32()), "bucket": pa.array(cols[1], pa.int64()),
                         "n": pa.array(cols[2], pa.int64()), "keys": pa.array(cols[3], pa.binary()),
                         "counts": pa.array(cols[4], pa.binary())})
    return run


# -- the model -------------------------------------------------------------

_MERGED = "kind int, bucket long, n long, keys binary, counts binary"


def _read(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All rows of a bucket merged: sorted distinct keys and summed counts."""
    ns = t["n"].to_pylist()
    keys = np.concatenate([unpack(k, n) for k, n in zip(t["keys"].to_pylist(), ns)])
    counts = np.concatenate([unpack_counts(c, n) for c, n in zip(t["counts"].to_pylist(), ns)])
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    start = _runs(keys)
    return keys[start], np.add.reduceat(counts, start)


def _merge(t: pa.Table) -> pa.Table:
    keys, counts = _read(t)
    return pa.table({"kind": t["kind"].slice(0, 1), "bucket": t["bucket"].slice(0, 1), "n": pa.array([len(keys)], pa.int64()),
                     "keys": pa.array([pack(keys)], pa.binary()), "counts": pa.array([pack_counts(counts)], pa.binary())})


class Tree:
    """The context trees of one bucket from depth 3 down, for one bit position.

    At depth d, ``node[d]`` is the node of each distinct (context, byte) of that
    depth, ``a`` and ``b`` its counts, ``log_w`` the log of its weighted
    probability and ``own`` the weight of its own estimate."""

    def __init__(self, levels: dict, bit: int, depth: int):
        self.node, self.kt, self.own, self.seen, self.k1 = {}, {}, {}, {}, {}
        below = None
        for d in range(depth, 2, -1):
            g, n, up = levels[d]
            first = _runs(g >> np.uint64(8 - bit))
            node = np.zeros(len(g), np.int64)
            node[first[1:]] = 1
            node = np.cumsum(node)
            one = (g >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
            a = np.bincount(node, np.where(one, 0, n))
            b = np.bincount(node, np.where(one, n, 0))
            kt = log_kt(a, b)
            if below is None:
                log_w, own = kt, np.ones(len(kt))
            else:
                first_below, log_below, up_below = below
                children = np.bincount(node[up_below[first_below]], log_below, minlength=len(kt))
                top = np.logaddexp(kt, children)
                log_w, own = top - np.log(2), np.exp(kt - top)
            self.node[d], self.own[d] = node, own
            self.seen[d], self.k1[d] = a + b > 0, (b + 0.5) / (a + b + 1)
            below = (first, log_w, up)
        self.first, self.a, self.b, self.log_w = first, a, b, log_w
        g = levels[3][0][first]
        self.id = (g >> np.uint64(8)) << np.uint64(8) | np.uint64(1 << bit) | (g & np.uint64(255)) >> np.uint64(8 - bit)


def _levels(keys: np.ndarray, counts: np.ndarray, depth: int) -> dict:
    """(distinct (context, byte), counts, index of each in the next level up) by depth."""
    out, g, n = {}, keys, counts
    for d in range(depth, 2, -1):
        if d > 3:
            shorter = g >> np.uint64(16) << np.uint64(8) | g & np.uint64(255)
            g2, up = np.unique(shorter, return_inverse=True)
            out[d] = (g, n, up)
            n = np.bincount(up, n, minlength=len(g2))
            g = g2
        else:
            out[d] = (g, n, None)
    return out


_NODES = "bucket long, id long, a double, b double, lw double"


def _nodes(depth: int):
    """One bucket -> its nodes at depth 3; id: three context bytes, then the decision node."""
    def run(t: pa.Table) -> pa.Table:
        levels = _levels(*_read(t), depth)
        trees = [Tree(levels, bit, depth) for bit in range(8)]
        cat = lambda f: np.concatenate([f(x) for x in trees])
        ids = cat(lambda x: x.id).view(np.int64)
        return pa.table({"bucket": pa.array(np.full(len(ids), t["bucket"][0].as_py())), "id": pa.array(ids),
                         "a": pa.array(cat(lambda x: x.a)), "b": pa.array(cat(lambda x: x.b)), "lw": pa.array(cat(lambda x: x.log_w))})
    return run


def _upper(nodes: DataFrame) -> DataFrame:
    """For each depth-3 node the mixture of depths 0 to 2: P(1) = base + rest * P3(1),
    and ``k``, the estimate of the deepest visited node among them."""
    kt = F.pandas_udf(lambda a, b: pd.Series(log_kt(a.to_numpy(), b.to_numpy())), "double")
    levels, below = [], nodes.select((F.col("id").bitwiseAND(255)).alias("v"), F.shiftright("id", 16).alias("c"), "a", "b", "lw")
    for d in (2, 1, 0):  # c: the context's bytes, nearest first; the farthest one goes at each step
        n = below.groupBy("c", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("s")).withColumn("kt", kt("a", "b"))
        m = F.greatest("kt", "s")
        n = n.withColumn("t", m + F.log(F.exp(F.col("kt") - m) + F.exp(F.col("s") - m)))
        levels.append(n.select("c", "v", F.exp(F.col("kt") - F.col("t")).alias(f"w{d}"),
                               F.when(F.col("a") + F.col("b") > 0, (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)).alias(f"k{d}")))
        below = n.select(F.shiftright("c", 8).alias("c") if d else "c", "v", "a", "b", (F.col("t") - float(np.log(2))).alias("lw"))
    two, one, root = levels
    x = nodes.select("bucket", "id", F.col("id").bitwiseAND(255).alias("v"), F.shiftright("id", 16).alias("c"))
    x = x.join(two, ["c", "v"]).withColumn("c", F.shiftright("c", 8)).join(one, ["c", "v"]).join(root.drop("c"), "v")
    x = x.withColumn("k0", F.coalesce("k0", F.lit(0.5))).withColumn("k1", F.coalesce("k1", "k0")).withColumn("k2", F.coalesce("k2", "k1"))
    r1 = 1 - F.col("w0")
    r2 = r1 * (1 - F.col("w1"))
    return x.select("bucket", "id", (F.col("w0") * F.col("k0") + r1 * F.col("w1") * F.col("k1") + r2 * F.col("w2") * F.col("k2")).alias("base"),
                    (r2 * (1 - F.col("w2"))).alias("rest"), F.col("k2").alias("k"))


_MODEL = "kind int, bucket long, n long, keys binary, known long, value binary"


def _gram_model(depth: int):
    """Cogroup (merged bucket, upper mixtures) -> log10 probability of each gram."""
    def run(t: pa.Table, upper: pa.Table) -> pa.Table:
        keys, counts = _read(t)
        levels = _levels(keys, counts, depth)
        ids = upper["id"].to_numpy()
        by = np.argsort(ids)
        base, rest, k = (upper[c].to_numpy()[by] for c in ("base", "rest", "k"))
        ids = ids[by]
        total = np.zeros(len(keys))
        for bit in range(8):
            t8 = Tree(levels, bit, depth)
            at = np.searchsorted(ids, t8.id.view(np.int64))
            entry, where = np.arange(len(keys)), {}
            for d in range(depth, 2, -1):
                where[d] = t8.node[d][entry]
                if d > 3:
                    entry = levels[d][2][entry]
            up = at[where[3]]
            est, own = {2: k[up]}, {}
            for d in range(3, depth + 1):
                est[d] = np.where(t8.seen[d][where[d]], t8.k1[d][where[d]], est[d - 1])
                own[d] = t8.own[d][where[d]]
            p = est[depth]
            for d in range(depth - 1, 2, -1):
                p = own[d] * est[d] + (1 - own[d]) * p
            p = base[up] + rest[up] * p
            total += np.log10(np.where((keys >> np.uint64(7 - bit) & np.uint64(1)).astype(bool), p, 1 - p))
        return pa.table({"kind": pa.array([GRAM], pa.int32()), "bucket": t["bucket"].slice(0, 1), "n": pa.array([len(keys)], pa.int64()),
                         "keys": pa.array([pack(keys)], pa.binary()), "known": pa.array([0], pa.int64()),
                         "value": pa.array([total.tobytes()], pa.binary())})
    return run


def _word_model(t: pa.Table) -> pa.Table:
    keys, counts = _read(t)
    return pa.table({"kind": pa.array([WORD], pa.int32()), "bucket": t["bucket"].slice(0, 1), "n": pa.array([len(keys)], pa.int64()),
                     "keys": pa.array([pack(keys)], pa.binary()), "known": pa.array([int((counts > 0).sum())], pa.int64()),
                     "value": pa.array([counts.astype(np.float64).tobytes()], pa.binary())})


_TOLD = "block long, kind int, bucket long, n long, known long, value binary"


def _dispatch(sent: pa.Table, model: pa.Table) -> pa.Table:
    """What each block asked of a bucket, in the order in which it asked; none
    if no block of this salt did. The model row of salt 0, which every bucket
    has, tells its known words once, to ``NO_BLOCK``."""
    n = model["n"][0].as_py()
    cols = {c: sent[c].to_pylist() if sent.num_rows else [] for c in ("block", "kind", "bucket", "n")}
    out = []
    if sent.num_rows:
        keys, value = unpack(model["keys"][0].as_py(), n), np.frombuffer(model["value"][0].as_py(), np.float64)
        out = [pack_values(value[np.searchsorted(keys, unpack(k, m))]) for k, m in zip(sent["keys"].to_pylist(), cols["n"])]
    known = [0] * len(out)
    if model["salt"][0].as_py() == 0 and model["known"][0].as_py():
        for c, x in (("block", NO_BLOCK), ("kind", model["kind"][0].as_py()), ("bucket", model["bucket"][0].as_py()), ("n", 0)):
            cols[c].append(x)
        known.append(model["known"][0].as_py())
        out.append(pack_values(np.zeros(0)))
    return pa.table({"block": pa.array(cols["block"], pa.int64()), "kind": pa.array(cols["kind"], pa.int32()),
                     "bucket": pa.array(cols["bucket"], pa.int64()), "n": pa.array(cols["n"], pa.int64()),
                     "known": pa.array(known, pa.int64()), "value": pa.array(out, pa.binary())})


def _score(depth: int, buckets: int, id_type: str):
    """Cogroup (texts, answers) -> sums of each text; of ``NO_BLOCK``, which has
    no texts, a row (n_tokens null) with the number of known words."""
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, log_c double, score double, n_bytes long, known long"
    empty = [(f.name, f.type) for f in to_arrow_schema(StructType.fromDDL(schema))]

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            known = {"known": pa.array([pa.compute.sum(told["known"]).as_py()], pa.int64())}
            return pa.table({c: known.get(c, pa.nulls(1, t)) for c, t in empty})
        held = docs["held_out"].to_numpy(zero_copy_only=False)
        chunks = list(_block_keys(docs, depth))
        lookup = {}
        for kind, i in ((GRAM, 1), (WORD, 2)):
            keys = np.sort(np.concatenate([c[i] for c in chunks]))
            keys = keys[_runs(keys)]
            b = _bucket(keys, kind, depth, buckets)
            keys = keys[np.argsort(b, kind="stable")]
            mine = told.filter(pa.compute.equal(told["kind"], kind)).sort_by("bucket")
            values = [unpack_values(v, n) for v, n in zip(mine["value"].to_pylist(), mine["n"].to_pylist())]
            lookup[kind] = (pd.Index(keys.view(np.int64)), np.concatenate(values) if values else np.zeros(0, np.float32))
        cols = {k: [] for k in ("n_tokens", "n_known", "log_c", "score", "n_bytes")}
        for _, grams, words, n_bytes, n_words in chunks:
            index, value = lookup[GRAM]
            v = value[index.get_indexer(grams.view(np.int64))].astype(np.float64)
            begin = np.concatenate([[0], np.cumsum(n_bytes + 1)[:-1]])
            cols["score"].append(np.add.reduceat(v, begin))
            index, value = lookup[WORD]
            c = value[index.get_indexer(words.view(np.int64))].astype(np.float64) if len(words) else np.zeros(0)
            edge = np.concatenate([[0], np.cumsum(n_words)])
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edge])  # noqa: B023, E731
            cols["n_known"].append(total(c > 0).astype(np.int64))
            cols["log_c"].append(total(np.log10(c + 1)))
            cols["n_tokens"].append(n_words.astype(np.int64) + 1)
            cols["n_bytes"].append(n_bytes.astype(np.int64))
        return pa.table({"doc_id": docs["doc_id"], "held_out": pa.array(held), **{k: pa.array(np.concatenate(v)) for k, v in cols.items()},
                         "known": pa.nulls(docs.num_rows, pa.int64())})
    return run, schema


def ctw_scores(docs: DataFrame, held_out: Column, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte for every row; rows with ``held_out`` don't train."""
    scratch = Scratch(docs.sparkSession, "ctw")
    text = text_of()
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    salts = -(-blocks // BLOCKS_PER_TASK)
    buckets = min(MAX_BUCKETS, max(16, blocks))
    d = docs.select(F.pmod(F.xxhash64("doc_id", text), F.lit(blocks)).alias("block"), "doc_id", held_out.alias("held_out"), text.alias("text"))
    # One job up to the sums of each text: what the blocks sent, and the texts
    # themselves, are shuffled once and read again from there.
    sent = d.groupBy("block").applyInArrow(_count(depth, buckets), _SENT)
    merged = sent.groupBy("kind", "bucket", "salt").applyInArrow(_merge, _MERGED)
    grams, words = merged.filter(F.col("kind") == GRAM), merged.filter(F.col("kind") == WORD)
    upper = _upper(grams.groupBy("bucket").applyInArrow(_nodes(depth), _NODES))
    model = (grams.groupBy("bucket").cogroup(upper.groupBy("bucket")).applyInArrow(_gram_model(depth), _MODEL)
             .unionByName(words.groupBy("bucket").applyInArrow(_word_model, _MODEL)))
    each = model.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    key = ["kind", "bucket", "salt"]
    told = sent.groupBy(*key).cogroup(each.groupBy(*key)).applyInArrow(_dispatch, _TOLD)
    f, schema = _score(depth, buckets, dict(docs.dtypes)["doc_id"])
    scored = scratch.save(d.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(f, schema))
    train = ~F.col("held_out")
    n, ends, v = scored.agg(F.sum(F.when(train, F.col("n_tokens"))), F.count_if(train), F.sum("known")).first()
    n, v = n or 0, (v or 0) + (1 if ends else 0)
    norm = float(np.log10(n + v + 1))
    return scored.filter("n_tokens is not null").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + (1 if ends else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_c") + float(np.log10(ends + 1)) - F.col("n_tokens") * norm).alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def op1_lm_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_scores(table(spark, sf_dir, "documents"), id_bucket(7) == 2)


QUERIES = {"op1_lm_ctw": op1_lm_ctw}
ORACLE: dict[str, str] = {}

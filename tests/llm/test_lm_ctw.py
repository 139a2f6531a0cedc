import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from remuneria.llm import lm_ctw as op
from remuneria.llm.common import id_bucket


def log_kt(a, b):
    return math.lgamma(a + .5) + math.lgamma(b + .5) - math.log(math.pi) - math.lgamma(a + b + 1)


class BruteTree:
    """Context-tree weighting node by node, over dictionaries."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, {}
        for t in texts:
            for ctx, y in self.steps(t):
                for d in range(depth + 1):
                    for j in range(8):
                        c = self.n.setdefault((ctx[:d], j, y >> (8 - j)), [0, 0])
                        c[y >> (7 - j) & 1] += 1
        self.lw = {}
        for d in range(depth, -1, -1):
            below = Counter()
            for (ctx, j, v), lw in self.lw.items():
                if len(ctx) == d + 1:
                    below[ctx[:-1], j, v] += lw
            for key, (a, b) in list(self.n.items()):
                if len(key[0]) == d:
                    kt = log_kt(a, b)
                    self.lw[key] = kt if d == depth else np.logaddexp(kt, below[key]) - math.log(2)

    def steps(self, t):
        x = bytes([255] * self.depth) + t.encode() + b"\xff"
        for i in range(self.depth, len(x)):
            yield tuple(x[i - self.depth:i][::-1]), x[i]

    def log10(self, t):
        total = 0.0
        for ctx, y in self.steps(t):
            for j in range(8):
                est, own, last = [], [], .5
                for d in range(self.depth + 1):
                    key = (ctx[:d], j, y >> (8 - j))
                    if key in self.n:
                        a, b = self.n[key]
                        last = (b + .5) / (a + b + 1)
                        own.append(math.exp(log_kt(a, b) - math.log(2) - self.lw[key]) if d < self.depth else 1.)
                    else:
                        own.append(.5)
                    est.append(last)
                p = est[-1]
                for d in range(self.depth - 1, -1, -1):
                    p = own[d] * est[d] + (1 - own[d]) * p
                total += math.log10(p if y >> (7 - j) & 1 else 1 - p)
        return total


def tokens(t):
    out, low = [], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [None]


@pytest.mark.parametrize("depth,block_bytes", [(6, 8 << 20), (4, 600), (3, 2000)])
def test_ctw_same_as_brute_force(spark, depth, block_bytes, monkeypatch):
    monkeypatch.setattr(op, "BLOCKS_PER_TASK", 2)
    texts = ["the cat sat on the mat", "The Cat\tsat", "", None, "ünïcode ça va", "a a a a a", "the mat sat", "zz top 99"] * 3
    texts += ["word%d on the %s" % (i, "mat" if i % 2 else "hat") for i in range(40)]
    rows = list(enumerate(texts)) + [(None, "the cat"), (3, "the dog sat"), (3, "the dog sat")]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    train = [t or "" for d, t in rows if not held(d)]
    tree, count = BruteTree(train, depth), Counter(w for t in train for w in tokens(t))
    n, v = sum(count.values()), len(count)
    df = spark.createDataFrame([(d, t, 1, False) for d, t in rows], "doc_id long, text string, block int, held_out boolean")
    got = sorted((tuple(r) for r in op.ctw_scores(df, id_bucket(7) == 2, depth, block_bytes).collect()), key=str)
    want = []
    for d, t in rows:
        w = tokens(t or "")
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        s = tree.log10(t or "")
        want.append((d, held(d), len(w), sum(count[x] > 0 for x in w), n, base, s, -s * math.log2(10) / (len((t or "").encode()) + 1)))
    assert len(got) == len(want)
    for g, x in zip(got, sorted(want, key=str)):
        assert g[:5] == x[:5]
        assert g[5:] == pytest.approx(x[5:], rel=1e-5, abs=1e-5)


@pytest.mark.parametrize("rare_in_first", [False, True])
def test_ctw_where_a_salt_asks_nothing_of_a_bucket(spark, rare_in_first, monkeypatch):
    """Each block its own salt, most contexts and words in one block only."""
    monkeypatch.setattr(op, "BLOCKS_PER_TASK", 1)
    texts = ["".join(chr(33 + (7 * i + j * j) % 90) for j in range(60)) + f" w{i}x w{i}y" for i in range(6)]
    texts = texts if rare_in_first else ["a", "a b"] + texts
    rows = [(i, t, i % 3 == 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    train = [t for _, t, h in rows if not h]
    tree, count = BruteTree(train, 4), Counter(w for t in train for w in tokens(t))
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in op.ctw_scores(df, F.col("held_out"), 4, 40).collect()}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens(t))
        assert got[d].train_tokens == n and got[d].n_known == sum(count[x] > 0 for x in tokens(t))
        assert (got[d].base_score, got[d].score) == pytest.approx((base, tree.log10(t)), rel=1e-5)


def test_ctw_no_rows_and_no_training(spark, empty_docs):
    assert op.ctw_scores(empty_docs, F.lit(False)).collect() == []
    d = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in op.ctw_scores(d, F.lit(True)).collect()}
    assert got[1].score == pytest.approx(24 * math.log10(.5)) and got[2].n_tokens == 1 and got[2].base_score == 0.0
    assert got[1].n_known == 0 and got[1].train_tokens == 0


def test_ctw_beats_unigram_on_unseen_text(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = op.ctw_scores(d, id_bucket(7) == 2).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.95 * r[1]

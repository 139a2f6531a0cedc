import hashlib
import re

import pytest
from pyspark.sql import functions as F

from remuneria.llm import block_names, line_windows, winnow


def bare(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("block_bytes,hashes", [
    (1024, block_names.hash128), (3, block_names.hash128),
    (4, lambda c: [F.octet_length(c).cast("long"), F.lit(0).cast("long")])])  # every hash stands for many blocks
def test_block_names(odd_docs, block_bytes, hashes, monkeypatch):
    monkeypatch.setattr(block_names.block_identities, "__defaults__", (block_bytes, hashes, None))
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted((tuple(r) for r in block_names.exact_dedup(odd_docs, block_bytes).collect()), key=str)
    groups = {}
    for d, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), d is None, d))
    want = []
    for d, t in rows:
        g = groups[bare(t)]
        keep = min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want.append((d, keep, len(g), d == keep, hashlib.sha256(bare(t).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_block_names_empty(empty_docs):
    assert block_names.exact_dedup(empty_docs).collect() == []


def test_line_windows(spark):
    a = "one\ntwo\nthree\nfour\nfive"
    rows = [(1, a), (2, "x\ntwo\nthree\nfour\ny"), (3, "two\nthree"), (4, None), (5, ""),
            (6, "\n".join(["r"] * 7)), (7, "\n\n\n\n"), (8, "\n\n\n\n"), (9, "two\nthree\nfour\nfive\nsix"), (1, a)]
    d = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, k int")
    rows = line_windows.line_dedup(d).collect()
    got = {r.doc_id: r for r in rows}
    # of the two rows (1, a) one is the first, the other loses all its lines
    assert sorted((r.text, r.n_removed) for r in rows if r.doc_id == 1) == [("", 5), (a, 0)]
    assert got[2].text == "x\ny" and got[2].removed == [1, 2, 3]
    assert got[3].text == "two\nthree" and got[4].text is None and got[4].n_lines == 0 and got[5].text == ""
    assert got[6].text == "r" and got[6].n_removed == 6  # the first window keeps only what no later one covers
    assert got[7].text == got[8].text == "\n\n\n\n"
    assert got[9].text == "six"
    assert len(line_windows.line_dedup(d).collect()) == 10


def test_line_windows_odd_rows(spark):
    block = "***\n---\n***"
    long_ = "\n".join(f"line {i}" for i in range(30_000))
    rows = [(1, block), (2, block + "\nx"), (None, "a\nb\nc"), (None, "a\nb\nc\nd"), (None, "a\nb\nc"), (3, long_), (4, long_), (None, None),
            (None, None), (5, " \n\t\n\n"), (6, " \n\t\n\n"), (7, "p\nq"), (7, "p\nq")]
    d = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, k int, own string")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in line_windows.line_dedup(d).collect()), key=str)
    assert len(got) == len(rows)
    assert [g[1:] for g in got if g[0] == 2] == [("x", 3)] and [g[1:] for g in got if g[0] == 1] == [(block, 0)]
    assert [g[1:] for g in got if g[0] == 3] == [(long_, 0)] and [g[1:] for g in got if g[0] == 4] == [("", 30_000)]
    # three texts without an id hold one window: it stays once
    without = sorted((g[1] or "", g[2]) for g in got if g[0] is None)
    assert sum(n for _, n in without) == 6 and sum("a\nb\nc" in t for t, _ in without) == 1
    assert [g[2] for g in got if g[0] in (5, 6, 7)] == [0] * 4


def test_block_names_string_ids_and_shared_ids(spark):
    rows = [("b", "x y"), ("a", "xy"), ("a", "x  y"), ("c", "z"), (None, "z "), (None, "z ")]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((tuple(r)[:4] for r in block_names.exact_dedup(d).collect()), key=str)
    # 'x  y' of a is the longest; its other row of the same id goes
    assert got == sorted([("b", "a", 3, False), ("a", "a", 3, False), ("a", "a", 3, True), ("c", None, 3, False),
                          (None, None, 3, True), (None, None, 3, True)], key=str)
    assert sorted(map(tuple, block_names.without_copies(d).collect()), key=str) == [("a", "x  y"), (None, "z ")]


def test_line_windows_empty(empty_docs):
    assert line_windows.line_dedup(empty_docs).collect() == []


def brute_winnow(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[p:p + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in range(1, 11):
            for p in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[p:p + n]))):
                    hit |= set(range(p, p + n))
                    found |= got
        out.append((d, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("prefilter", [1 << 20, 0])
def test_winnow(spark, odd_docs, prefilter):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    long_ = next(t for d, t in rows if d == 160)
    w = long_.split()
    items = [(1, " ".join(w[3:25])), (2, " ".join(w[5:15])), (3, " ".join(w[20:29])), (3, "nothing like it " * 5),
             (4, w[7].upper()), (5, "!!!"), (None, None), (6, " ".join(w[30:33])), (10, "zz " + " ".join(w[8:17]) + " zz"),
             (7, next(t for d, t in rows if t and len(t) > 20000)[:400])]
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in winnow.decontaminate(odd_docs, it, prefilter).collect()), key=str)
    assert got == brute_winnow(rows, items)


def test_winnow_empty(spark, empty_docs, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnow.decontaminate(empty_docs, none).collect() == []
    assert not any(r.contaminated for r in winnow.decontaminate(odd_docs, none).collect())

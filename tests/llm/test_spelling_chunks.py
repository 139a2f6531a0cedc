import random
import re
import zlib
from collections import Counter

import pytest

from remuneria.llm import spelling_chunks as sc
from remuneria.session import Scratch

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def edits(words):
    """Near words of each by listing what one deletion leaves (replaced: the same gap) and checking."""
    gaps = {}
    for w in words:
        for key in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            gaps.setdefault(key, set()).add(w)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out = {w: set() for w in words}
    for group in gaps.values():
        for a in group:
            out[a] |= {b for b in group if near(a, b)}
    return out


def expected(n):
    near = edits(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def collected(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(sc.op11_spelling_chunks(spark, SF)) == expected(counted(rows))


@pytest.mark.parametrize("group_pairs", [0, 3, 1 << 12])
def test_near_words_at_every_group_size(spark, group_pairs):
    rng = random.Random(6)
    words = set()
    for _ in range(40):
        w = "".join(rng.choice("abcéß") for _ in range(rng.randint(1, 14)))
        words.add(w)
        for _ in range(25):
            i = rng.randrange(len(w) + 1)
            words.add(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abcéß") + w[i:], w[:i] + rng.choice("abc") + w[i + 1:]]))
    # one prefix that very many words hold, one end that very many hold
    words |= {"internationalisation" + "".join(rng.choice("abcd") for _ in range(6)) for _ in range(150)}
    words |= {"".join(rng.choice("abcd") for _ in range(6)) + "wortendungenlang" for _ in range(150)}
    words = sorted(words - {""})
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    links = sc.near_words(df, Scratch(spark, "t"), group_pairs).collect()
    got = {frozenset((r.a, r.b)) for r in links}
    want = {frozenset((a, b)) for a, near in edits(words).items() for b in near}
    assert got == want and len(links) == len(want)
    assert all(r.a_n == words.index(r.a) and r.b_n == words.index(r.b) for r in links[:20])


def test_chains_and_ties(spark):
    n = {"colouring": 100_000, "coloring": 5_000, "colorin": 200, "colorln": 3, "zzzzzzza": 50, "zzzzzzzb": 50, "zzzzzzz": 5, "lonelyword": 2,
         "éééééééa": 30, "ééééééé": 3}
    df = spark.createDataFrame([*n.items(), (None, 4)], "word string, n long").filter("word is not null")
    got = collected(sc.spelling_variants(df))
    assert got == expected(n)
    assert got["colorln"][:2] == ("colorin", "colouring") and got["zzzzzzz"][0] == "zzzzzzza"


def test_odd_rows(spark, odd_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert collected(sc.spelling_variants(sc.word_counts(odd_docs))) == expected(counted(rows))
    assert sc.spelling_variants(sc.word_counts(empty_docs)).count() == 0
    latin = [(1, "ÄÖÜäöüß×÷ ÄÖÜäöüß×÷ ÀBCDEFGH àbcdefgh Àbcdefgh ĀBCDEFGHI"), (None, "Àbcdefgh " * 40 + "Àbcdeefgh " * 2 + "a" * 40_000)]
    df = spark.createDataFrame([(*r, "w", 3) for r in latin], "doc_id long, text string, word string, n int")
    assert collected(sc.spelling_variants(sc.word_counts(df))) == expected(counted(latin))

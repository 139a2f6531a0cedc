from collections import Counter

import numpy as np
import pandas as pd
import pytest

from remuneria.llm import lang_rank, toxic_channel
from remuneria.llm.common import id_bucket, table

SF = "/root/testdata/sf0.01"


def grams(t):
    out = Counter()
    for w in "".join(c.lower() if c.isalpha() else " " for c in t).split():
        out.update(w)
        p = f" {w} "
        out.update(p[i:i + 2] for i in range(len(p) - 1))
        out.update(p[i:i + 3] for i in range(len(p) - 2))
    return out


def code(g):
    return sum((1 if c == " " else ord(c)) << (42 - 21 * i) for i, c in enumerate(g))


def top(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def test_rank_order_same_as_brute_force(spark, odd_docs):
    rows = [("the cat and the hat", "en"), ("le chat et le chapeau", "fr"), ("der Hut und die Katze ü", "de"), (None, "en"), ("x", None), ("42", "zz")]
    teach = spark.createDataFrame(rows * 3, "text string, lang string")
    for size in (5, 400):
        prof = lang_rank.learn_profiles(teach, size)
        own = {}
        for t, lang in rows:
            if t and lang and grams(t):
                own[lang] = top(grams(t), size)
        got = {lang: [int(x) for x in d["gram"]] for lang, d in prof.groupby("lang")}
        assert got == {lang: [code(g) for g in gs] for lang, gs in own.items()}
        d = odd_docs.select("doc_id", "text")
        for r in d.withColumn("p", lang_rank.identify(d, prof, size)).collect():
            mine = top(grams(r.text or ""), size)
            if not mine:
                assert r.p.lang == "und" and r.p.score == 0
                continue
            dist = {lang: sum(min(abs(i - gs.index(g)), size) if g in gs else size for i, g in enumerate(mine)) for lang, gs in own.items()}
            best = min(sorted(dist), key=dist.get)
            assert r.p.lang == best and r.p.score == pytest.approx(1 - dist[best] / (size * len(mine)))


def test_many_scripts_in_one_batch():
    texts = pd.Series(["".join(chr(c) for c in range(0x4E00 + 40 * i, 0x4E00 + 40 * i + 60)) for i in range(400)] + ["the cat"])
    prof = pd.DataFrame({"lang": ["en"] * 2, "gram": [code("t"), code("th")], "rank": [0, 1]})
    got = lang_rank.out_of_place(prof, 10)(texts)
    assert got["lang"].eq("en").all() and got["score"].iloc[-1] > 0 and (got["score"].iloc[:-1] == 0).all()


def test_language_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    got = lang_rank.language_of(docs, id_bucket(3) == 1).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_empty(spark, empty_docs, odd_docs):
    assert lang_rank.language_of(empty_docs, id_bucket(3) == 1).collect() == []
    none = lang_rank.learn_profiles(empty_docs)
    assert {r.p.lang for r in odd_docs.select(lang_rank.identify(odd_docs, none).alias("p")).collect()} == {"und"}


def brute_decode(span, log_p):
    """The best path by trying all of them."""
    paths = [("", 0.0)]
    for step in toxic_channel._lattice(span):
        paths = [(t + o, s - c) for t, s in paths for o, c in step]

    def total(t, s):
        a = b = toxic_channel.EDGE
        for ch in t + " ":
            z = toxic_channel._symbol(ch)
            if z == toxic_channel.EDGE == b:
                continue
            s += log_p[a][b][z]
            a, b = b, z
        return s

    return max(total(t, s) for t, s in paths), total


def test_viterbi_same_as_all_paths(spark):
    log_p = toxic_channel.character_model(table(spark, SF, "documents")).tolist()
    for span in ("1d10t", "i d i o t", "heeello", "w0rth1e55", "p@7het!c", "a.b.c.d", "1||1", "m00000n", "x", "é3é"):
        best, total = brute_decode(span, log_p)
        text = toxic_channel.decode(span, log_p)
        costs = [c for t, c in paths_of(span) if t.rstrip(" ") == text]
        assert max(total(text, -c) for c in costs) == pytest.approx(best)


def paths_of(span):
    paths = [("", 0.0)]
    for step in toxic_channel._lattice(span):
        paths = [(t + o, s + c) for t, s in paths for o, c in step]
    return paths


def test_restores_obfuscated_words(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    more = spark.createDataFrame([(-1, "you 1d10t"), (-2, "what an i d i o t you are"), (-3, "m0r0n, l0ser"), (-4, None), (-5, "The IDIOOOOT"),
                                  (-6, "plain words stay in 2024 with b2b")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in toxic_channel.restored(docs.union(more)).filter("doc_id < 0").collect()}
    assert got == {-1: "you idiot", -2: "what an idiot you are", -3: "moron, loser", -4: None, -5: "the idiot",
                   -6: "plain words stay in 2024 with b2b"}


def test_rows_without_evidence_have_one_path():
    """chunk() is text() on every row, whatever stands beside it."""
    rng = np.random.default_rng(4)
    rows = ["blööööd", "ДУРААААК идиооооот", "Ööö ОоО", "ςςΣ", "İii x", "a b 1$", "«i d i» da", "i d i\u0301", "b21", "ünïcode ça va", "", "v2 ééé", "a b c", "xa b c", "ab c d e", "a b cd", "ö ä ü"]
    signs = np.array(list("abAB12$@ ._-öÖиИςΣİ«€\u0301\n"))
    rows += ["".join(rng.choice(signs, rng.integers(1, 9))) for _ in range(6000)]
    log_p = np.log(rng.dirichlet(np.ones(toxic_channel.SYMBOLS), (toxic_channel.SYMBOLS,) * 2))
    restorer = toxic_channel.Restorer(log_p)
    want = [restorer.text(s.lower()) for s in rows]
    for size in (1, 50, len(rows)):
        got = []
        for i in range(0, len(rows), size):
            for _, data, offsets in toxic_channel.wa.chunks(toxic_channel.pa.array(rows[i:i + size])):
                got += restorer.chunk(data, offsets).to_pylist()
        assert [(s, g) for s, g, w in zip(rows, got, want) if g != w] == []


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    text = "The thing was an onre. Ther hation {} eron and thes. Heen ined stion."
    planted = [(900000 + i, text.format(w), 0) for i, w in enumerate([
        "you 1d10t, m0r0n and l0ser", "i d i o t, c l o w n, s.c.u.m", "p@thetic 5tupid tr4sh", "scum, clown, idiot", "worthlesssss mooooron, sssscum",
        "of", "and the", "v2 in 2024 b2b"])]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string, x int").drop("x"))
    got = {r.doc_id: r for r in toxic_channel.judge(more, labels, id_bucket(5) == 0).collect()}
    assert [got[900000 + i].predicted for i in range(8)] == [1, 1, 1, 1, 1, 0, 0, 0]
    held = [(r.toxic, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([t == g.predicted for t, g in held]) > 0.95


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_one_obfuscated_word_is_toxic(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    text = "The thing was an onre. Ther hation {} eron and thes. Heen ined stion."
    planted = [(900000 + i, text.format(w)) for i, w in enumerate(["you 1d10t,", "i d i o t", "m0r0n", "you scum", "worthlesssss", "of", "and the", "v2"])]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {r.doc_id: r for r in toxic_channel.judge(more, labels, id_bucket(5) == 0).collect()}
    assert [got[900000 + i].predicted for i in range(8)] == [1, 1, 1, 1, 1, 0, 0, 0]
    assert np.mean([r.toxic == got[r.doc_id].predicted for r in labels.collect() if got[r.doc_id].held_out]) > 0.9


def test_sample_of_copies_and_of_a_rare_kind(spark):
    """A third of the rows share one text, toxic rows are rare: each kind is drawn, never more than the sample."""
    rows = [(i, "the same old text" if i % 3 == 0 else f"plain words number{i} here", 0) for i in range(3000)]
    rows += [(5000 + i, f"a nasty idiot said it{i}", 1) for i in range(6)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    log_p = toxic_channel.character_model(docs)
    hashed = docs.join(labels, "doc_id").withColumn("h", toxic_channel.F.xxhash64(toxic_channel.F.lit(7), "doc_id", "text"))
    parts, quota = toxic_channel.draw(hashed, {0: 3000, 1: 6}, 60)
    drawn = {t: [r.text for r in x.collect()] for t, x in parts.items()}
    assert quota == {0: 54, 1: 6} and {t: len(x) for t, x in drawn.items()} == quota
    assert 8 < sum(x == "the same old text" for x in drawn[0]) < 30
    chosen, weights, bias = toxic_channel.learn(docs, labels, log_p, 60)
    assert len(chosen) and bias < 0 and weights.max() > 0
    many = spark.createDataFrame([(1, 0, 5)] * 50 + [(2, 1, 6)] * 50, "doc_id long, toxic int, h long")
    assert toxic_channel.draw(many, {0: 50, 1: 50}, 10)[1] == {0: 5, 1: 5}


def test_toxicity_odd_rows(spark, odd_docs, empty_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (999999, 1), (5, 0)], "doc_id long, toxic int")
    got = toxic_channel.judge(odd_docs, labels, id_bucket(5) == 0).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxic_channel.judge(empty_docs, labels, id_bucket(5) == 0).collect() == []
    none = toxic_channel.judge(odd_docs, labels.limit(0), id_bucket(5) == 0).collect()
    assert {r.predicted for r in none} == {0}

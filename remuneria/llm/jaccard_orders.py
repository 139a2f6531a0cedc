"""N-gram Jaccard join with prefix filters under several global token orders.

A document is its set of distinct word shingles (64-bit hashes). Two sets link
when ``100 * intersection >= percent * union``. Under any global order of the
tokens, linked sets share a token among the first
``n - ceil(percent/100 * n) + 1`` of each (their prefix). Three orders are
used: A by rising document frequency, B and C by two independent hashes.

1. Sets: equal sets form a class and are represented once, in one block of
   documents (a few MB each, dealt by hash).
2. Order A: each block sends the distinct tokens of its classes, four bytes
   each, to token buckets; a bucket sends back, to every block that has them,
   the tokens that occur in two classes or more, with their frequency. A token
   that a third of all documents hold is one entry per block. Most tokens are
   unique and so come first in A: a class all of whose prefix is unique has no
   partner at all, and ``n - unique`` bounds its overlap with any other.
3. Candidates share a token of both A-prefixes, and pass the size, frequency
   and position bounds. They are not enumerated within a group of near copies:
   each token has one hub (its class with the smallest share of unique
   tokens); a class is first paired with the best of its hubs, then with those
   of its other hubs from which it is still apart; then pairs are made only
   between classes of a token that are apart even now, once per pair.
4. Candidates must also share a token of the B- and of the C-prefixes; the
   survivors are verified exactly on their tokens. In the later rounds, whose
   pairs rarely link, 16-bit marks of the tokens bound the overlap beforehand.
5. Components come from star contraction of the links. No link between
   different components is missed, as every candidate pair that isn't already
   connected is verified.

Frequencies are counted on 32 bits below the bucket's; two tokens that agree
there look more frequent than they are, which can only add candidates.

Defined cases: a null or blank text has an empty set, n_shingles 0, and is
linked with nothing; a text of fewer words than a shingle is one shingle; rows
that repeat a doc_id fall into the classes of their texts; component_id
ignores null ids where another id is there; an empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from . import wordarrays as wa
from .common import table, text_of
from .components import connected_components

BLOCK_BYTES = 8 << 20
BUCKET_TOKENS = 1 << 20
EARLIER = 64
#: Ids of 16 bytes that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1 << 17
_B, _C = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, counts = wa.words(data, offsets)
    g = wa.grams(h, k)
    out, at = [], 0
    for n in counts.tolist():
        x = np.sort(g[at:at + n - k + 1]) if n >= k else wa.grams(h[at:at + n], n) if n else g[:0]
        if len(x) > 1:
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        out.append(x)
        at += n
    return out


def set_id(x: np.ndarray) -> tuple[int, int]:
    """128-bit identity of a set, whatever its order."""
    return tuple(int(wa.mix(x ^ s).sum(dtype=np.uint64).astype(np.int64)) for s in (_B, _C))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _describe(k: int, id_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in wa.chunks(b.column(2)):
                sets = shingle_sets(data, offsets, k)
                ids = np.array([set_id(x) for x in sets], np.int64).reshape(-1, 2)
                yield pa.record_batch([
                    b.column(0).slice(first, len(sets)), b.column(1).slice(first, len(sets)),
                    pa.array([len(x) for x in sets], pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]),
                    pa.array(np.diff(offsets))], ["doc_id", "h", "n", "s1", "s2", "bytes"])
    return run, f"doc_id {id_type}, h long, n long, s1 long, s2 long, bytes long"


def _owned(docs: pa.Table, owners: pa.Table, k: int) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """(id, set) of each class that this block owns."""
    left = set(zip(owners["s1"].to_pylist(), owners["s2"].to_pylist()))
    for _, data, offsets in wa.chunks(docs["text"]):
        for x in shingle_sets(data, offsets, k):
            if len(x) and (i := set_id(x)) in left:
                left.discard(i)
                yield i, x


def _send_tokens(k: int, bits: int):
    """Cogroup (documents, owners) -> per bucket the distinct tokens of the block."""
    def run(docs: pa.Table, owners: pa.Table) -> pa.Table:
        sets = [x for _, x in _owned(docs, owners, k)]
        t = np.sort(np.concatenate(sets) >> np.uint64(32 - bits)) if sets else np.zeros(0, np.uint64)
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(t)))
        t = t[start]
        edge = np.flatnonzero(np.diff(t >> np.uint64(32))) + 1
        rows = []
        for a, z in zip(np.append(0, edge), np.append(edge, len(t))):
            if z > a:
                many = np.flatnonzero(count[a:z] > 1).astype(np.uint32)
                rows.append((int(t[a] >> np.uint64(32)), t[a:z].astype(np.uint32).tobytes(),
                             many.tobytes(), count[a:z][many].astype(np.uint32).tobytes()))
        block = (docs if docs.num_rows else owners)["block"][0].as_py()
        cols = list(zip(*rows)) if rows else [(), (), (), ()]
        return pa.table({"bucket": pa.array(cols[0], pa.int64()), "block": pa.array([block] * len(rows), pa.int64()),
                         "tokens": pa.array(cols[1], pa.binary()), "many": pa.array(cols[2], pa.binary()),
                         "counts": pa.array(cols[3], pa.binary())})
    return run, "bucket long, block long, tokens binary, many binary, counts binary"


def _frequent(t: pa.Table) -> pa.Table:
    """One bucket: the tokens of two classes or more, for each block that has them."""
    tokens, weight, block = [], [], []
    for tok, many, counts, b in zip(*(t[c].to_pylist() for c in ("tokens", "many", "counts", "block"))):
        x = np.frombuffer(tok, np.uint32)
        w = np.ones(len(x), np.int64)
        w[np.frombuffer(many, np.uint32)] = np.frombuffer(counts, np.uint32)
        tokens.append(x)
        weight.append(w)
        block.append(np.full(len(x), b))
    tokens, weight, block = map(np.concatenate, (tokens, weight, block))
    key = np.sort(tokens.astype(np.uint64) << np.uint64(32) | np.arange(len(tokens), dtype=np.uint64))
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    x = (key >> np.uint64(32)).astype(np.uint32)
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    total = np.add.reduceat(weight[at], start)
    df = np.repeat(total, np.diff(np.append(start, len(x))))
    keep = df > 1
    x, df, block = x[keep], np.minimum(df[keep], 0xFFFFFFFF).astype(np.uint32), block[at[keep]]
    order = np.argsort(block, kind="stable")
    x, df, block = x[order], df[order], block[order]
    edge = np.flatnonzero(np.diff(block)) + 1
    spans = [(a, z) for a, z in zip(np.append(0, edge), np.append(edge, len(x))) if z > a]
    bucket = t["bucket"][0].as_py()
    return pa.table({
        "block": pa.array([int(block[a]) for a, _ in spans], pa.int64()),
        "s1": pa.array([bucket] * len(spans), pa.int64()), "s2": pa.nulls(len(spans), pa.int64()),
        "tokens": pa.array([x[a:z].tobytes() for a, z in spans], pa.binary()),
        "df": pa.array([df[a:z].tobytes() for a, z in spans], pa.binary())})


_TOLD = "block long, s1 long, s2 long, tokens binary, df binary"
_CAND = "s1 long, s2 long, n long, u long, b long, c long, prefix array<long>, tokens binary, marks binary"


def _candidates(k: int, bits: int, percent: int):
    """Cogroup (documents, owners and frequent tokens) -> the classes that can
    have a partner: their size, unique tokens, A-prefix without the unique
    tokens, the last value of the B- and C-prefix, and all frequent tokens."""
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        is_owner = pa.compute.is_null(told["tokens"])
        owners, freq = told.filter(is_owner), told.filter(pa.compute.invert(is_owner))
        rows = []
        if freq.num_rows:
            parts = [(np.frombuffer(t, np.uint32).astype(np.uint64) | np.uint64(b << 32))
                     for t, b in zip(freq["tokens"].to_pylist(), freq["s1"].to_pylist())]
            df = np.concatenate([np.frombuffer(d, np.uint32) for d in freq["df"].to_pylist()])
            index = pd.Index(np.concatenate(parts).view(np.int64))
            for (s1, s2), x in _owned(docs, owners, k):
                n, p = len(x), prefix_size(len(x), percent)
                at = index.get_indexer((x >> np.uint64(32 - bits)).view(np.int64))
                known = at >= 0
                y = x[known]
                u = n - len(y)
                if u >= p:
                    continue
                first = y[np.lexsort((y, df[at[known]]))[:p - u]]
                c = wa.mix(x ^ _C)
                rows.append((s1, s2, n, u, int(x[p - 1].astype(np.int64)), int(np.partition(c, p - 1)[p - 1].astype(np.int64)),
                             first.view(np.int64), y.tobytes(), (y >> np.uint64(48)).astype(np.uint16).tobytes()))
        cols = list(zip(*rows)) if rows else [()] * 9
        types = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.table({name: pa.array(v, t) for name, v, t in zip(
            ("s1", "s2", "n", "u", "b", "c", "prefix", "tokens", "marks"), cols, types)})
    return run, _CAND


def _may_link(percent: int):
    """Rows with both classes' 16-bit marks of their tokens -> those whose marks
    agree often enough. Equal tokens have equal marks, so no link is lost."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, ok = batch.to_pydict(), []
            for n, m, x, y in zip(d["xn"], d["yn"], d["xmarks"], d["ymarks"]):
                (v, c), (w, e) = (np.unique(np.frombuffer(z, np.uint16), return_counts=True) for z in (x, y))
                _, i, j = np.intersect1d(v, w, assume_unique=True, return_indices=True)
                most = int(np.minimum(c[i], e[j]).sum())
                ok.append(100 * most >= percent * (n + m - most))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _verify(percent: int):
    """Rows with both classes -> those that share B- and C-prefix tokens and link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            ok = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(d[s + "tokens"][i], np.uint64) for s in "xy")
                common = np.intersect1d(x, y, assume_unique=True)
                lim = [min(np.uint64(d["x" + o][i] & 0xFFFFFFFFFFFFFFFF), np.uint64(d["y" + o][i] & 0xFFFFFFFFFFFFFFFF)) for o in "bc"]
                passes = len(common) and common[0] <= lim[0] and wa.mix(common ^ _C).min() <= lim[1]
                ok.append(bool(passes) and 100 * len(common) >= percent * (d["xn"][i] + d["yn"][i] - len(common)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _bound(x: str, y: str, percent: int) -> Column:
    """Can classes with these sizes, unique tokens and prefix positions link?"""
    n, m, c = f"{x}.n", f"{y}.n", f"least({x}.n - {x}.u, {y}.n - {y}.u)"
    need = f"ceil({percent} * ({n} + {m}) / {100 + percent})"
    after = f"least({n} - {x}.u - {x}.i, {m} - {y}.u - {y}.i) + least({x}.i, {y}.i)"
    return F.expr(f"{c} >= {need} and {after} >= {need}")


def link_classes(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(sets: doc_id, h (hash of id and text), n, s1, s2 of every row; roots: node (s1, s2), root)."""
    f, schema = _describe(k, dict(docs.dtypes)["doc_id"])
    key = F.xxhash64("doc_id", "text")
    sets = scratch.save(docs.select("doc_id", key.alias("h"), text_of().alias("text")).mapInArrow(f, schema))
    size = sets.agg(F.sum("bytes"), F.sum("n")).first()
    blocks = max(1, -(-(size[0] or 0) // BLOCK_BYTES))
    bits = max(0, ((size[1] or 0) // BUCKET_TOKENS).bit_length())
    block = F.pmod("h", F.lit(blocks)).alias("block")

    owners = (sets.filter("n > 0").groupBy("s1", "s2").agg(F.min(block).alias("block")).select("block", "s1", "s2"))
    dealt = docs.select(F.pmod(key, F.lit(blocks)).alias("block"), text_of().alias("text"))
    f, schema = _send_tokens(k, bits)
    sent = dealt.groupBy("block").cogroup(owners.groupBy("block")).applyInArrow(f, schema)
    frequent = sent.groupBy("bucket").applyInArrow(_frequent, _TOLD)
    told = frequent.unionByName(owners.selectExpr("block", "s1", "s2", "cast(null as binary) tokens", "cast(null as binary) df"))
    f, schema = _candidates(k, bits, percent)
    cands = scratch.save(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(f, schema)
                         .select(F.struct("s1", "s2").alias("id"), "n", "u", "b", "c", "prefix", "tokens", "marks"))

    posts = cands.select("id", "n", "u", F.posexplode("prefix").alias("i", "token"))
    hub = posts.groupBy("token").agg(F.count("*").alias("f"), F.min(F.struct(F.expr("u / n"), "id", "n", "u", "i")).alias("hub"))
    # written, like the other tables by token or root below: a join with a written
    # table is a plain shuffle join, whose hot keys Spark can split
    hub = scratch.save(hub.filter("f > 1").select("token", "hub.id", "hub.n", "hub.u", "hub.i"))
    x, y = posts.alias("x"), hub.alias("y")
    to_hubs = scratch.save(x.join(y, F.expr("x.token = y.token and x.id != y.id") & _bound("x", "y", percent)).select(
        F.col("x.id").alias("of"), F.struct(F.expr("y.u / y.n"), F.col("y.id").alias("id")).alias("hub")).distinct())
    pair = [F.least("of", "hub.id").alias("a"), F.greatest("of", "hub.id").alias("b")]
    nearest = scratch.save(to_hubs.groupBy("of").agg(F.min("hub").alias("hub")).select(*pair).distinct())
    links = scratch.save(_verified(nearest, cands, percent))
    roots = scratch.save(connected_components(links, scratch))
    others = to_hubs.select(*pair).distinct().join(nearest, ["a", "b"], "left_anti")
    for end in "ab":
        others = others.join(roots.withColumnsRenamed({"node": end, "root": "root_" + end}), end, "left")
    others = scratch.save(others.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    if not others.isEmpty():
        more = scratch.save(_verified_few(others, cands, percent, scratch))
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = scratch.save(connected_components(links, scratch))

    # tokens that lie in several components, and the classes that hold them
    slim = cands.select("id", "n", "u", "prefix").join(roots, cands["id"] == roots["node"], "left")
    slim = scratch.save(slim.select("id", "n", "u", F.coalesce("root", "id").alias("root"), F.posexplode("prefix").alias("i", "token")))
    mixed = slim.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("token")
    mixed = scratch.save(mixed)
    held = slim.join(mixed, "token").groupBy("id", "n", "u", "root").agg(F.sort_array(F.collect_list(F.struct("i", "token"))).alias("held"))
    apart = held.select("id", "n", "u", "root", "held", F.posexplode("held").alias("at", "h"))
    apart = scratch.save(apart.select("id", "n", "u", "root", "h.i", "h.token", F.when(
        F.col("at") <= EARLIER, F.transform(F.slice("held", F.lit(1), F.col("at")), lambda h: h["token"])).alias("before")))
    x, y = apart.alias("x"), apart.alias("y")
    seen_before = F.coalesce(F.arrays_overlap("x.before", "y.before"), F.lit(False))
    second = x.join(y, F.expr("x.token = y.token and x.id < y.id and x.root != y.root")
                    & _bound("x", "y", percent) & ~seen_before)
    second = second.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    second = scratch.save(second.join(nearest.unionByName(others), ["a", "b"], "left_anti"))
    more = scratch.save(_verified_few(second, cands, percent, scratch))
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more), scratch)
    return sets.select("doc_id", "h", "n", "s1", "s2"), roots


def _both_sides(pairs: DataFrame, cands: DataFrame, columns: list[str], f) -> DataFrame:
    side = lambda s, end: cands.select(F.col("id").alias(end), *[F.col(c).alias(s + c) for c in columns])
    return pairs.join(side("x", "a"), "a").join(side("y", "b"), "b").mapInArrow(f, pairs.select("a", "b").schema)


def _verified(pairs: DataFrame, cands: DataFrame, percent: int) -> DataFrame:
    return _both_sides(pairs, cands, ["n", "b", "c", "tokens"], _verify(percent))


def _verified_few(pairs: DataFrame, cands: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """As ``_verified``, for pairs that mostly don't link: their 16-bit marks
    (a quarter of the bytes) are compared first, and tokens are sent only for
    the classes that remain."""
    left = scratch.save(_both_sides(pairs, cands, ["n", "marks"], _may_link(percent)))
    ids = scratch.save(left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id"))).distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return _verified(left, scratch.save(cands.join(ids, "id", "left_semi")), percent)


def _rooted(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """doc_id, h, n, root (null without shingles) of every row."""
    sets, roots = link_classes(docs, k, percent, scratch)
    own = F.struct("s1", "s2")
    rows = sets.withColumn("id", own).join(roots, F.col("id") == F.col("node"), "left")
    return scratch.save(rows.select("doc_id", "h", "n", F.when(F.col("n") > 0, F.coalesce("root", "id")).alias("root")))


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = _rooted(docs, k, percent, scratch)
    first = rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(scratch.save(first), "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all columns: of each component the first one by
    doc_id (null last) and text, and every row without shingles. Decided by
    row, whatever ids they share; of rows that repeat id and text one stays."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = _rooted(docs, k, percent, scratch)
    key = F.struct("doc_id", "h")
    first = rows.filter("root is not null").groupBy("root").agg(
        F.min_by(key, F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("k"), F.count("*").alias("n"))
    empty = rows.filter("root is null").select(key.alias("k")).distinct()
    stays = scratch.save(first.select("k").unionByName(empty))
    d = docs.withColumn("__key", F.struct("doc_id", F.xxhash64("doc_id", "text").alias("h")))
    d = d.join(stays, d["__key"] == stays["k"], "left_semi")
    repeats = rows.filter("root is not null").groupBy("doc_id", "h").count().filter("count > 1")
    if not repeats.isEmpty():
        bare = scratch.save(empty)
        d = d.join(bare, d["__key"] == bare["k"], "left_anti").dropDuplicates(["__key"]).unionByName(
            d.join(bare, d["__key"] == bare["k"], "left_semi"))
    return d.drop("__key")


def op9_jaccard_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


# all pairs of classes that share a shingle, then everything reachable
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda p: array_to_string(ws[p : p + 3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS grams FROM d
), c AS (
  SELECT grams, min(doc_id) AS id, len(grams) AS n FROM s WHERE len(grams) > 0 GROUP BY grams
), x AS (
  SELECT id, n, unnest(grams) AS gram FROM c
), links AS (
  SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.gram = b.gram AND a.id < b.id GROUP BY a.id, a.n, b.id, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), ties AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT id, id AS other FROM c UNION SELECT reach.id, ties.b FROM reach JOIN ties ON ties.a = reach.other
), root AS (
  SELECT id, min(other) AS component_id FROM reach GROUP BY id
)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, coalesce(root.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.grams = s.grams LEFT JOIN root ON root.id = c.id
"""

QUERIES = {"op9_jaccard_orders": op9_jaccard_orders}
ORACLE = {"op9_jaccard_orders": ORACLE_SQL}

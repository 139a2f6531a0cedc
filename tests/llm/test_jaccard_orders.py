import re

from remuneria.llm import jaccard_orders as op


def brute(rows, k=4, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def test_same_as_all_pairs(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for k, percent in ((4, 85), (2, 60), (4, 100)):
        got = sorted((tuple(r) for r in op.jaccard_components(odd_docs, k, percent).collect()), key=str)
        assert got == brute(rows, k, percent)


def test_near_copy_group(spark):
    """One base text and many single edits: all links to the base, hardly any between the edits."""
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        w[i % 60] = f"edit{i}"
        if i % 3 == 0:
            w[(i * 7) % 60] = f"more{i}"
        rows.append((i, " ".join(w)))
    got = sorted((tuple(r) for r in op.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(empty_docs):
    assert op.jaccard_components(empty_docs).collect() == []

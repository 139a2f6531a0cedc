import itertools
import random

from remuneria.llm import url_rules as op


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for c in "?#":
        rest = rest.split(c)[0]
    host = rest.split("/")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[len(host):]


def given(host, path):
    best = None
    for verdict, h, p in op.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


def tokens(url, host, path):
    out = ["host:" + x for x in host.split(".") if x] + ["path:" + x for x in path.split("/") if x]
    query = url.split("?", 1)[1].split("#")[0] if url and "?" in url.split("#")[0] + ("" if "?" in url.split("#")[0] else "") else ""
    for pair in query.split("&"):
        if pair:
            out += ["query:" + pair] + (["name:" + pair.split("=")[0]] if pair.split("=")[0] else [])
    return frozenset(out)


def brute(urls, min_support, min_confidence):
    told = {u: given(*split(u)) for u in urls}
    items = {u: tokens(u, *split(u)) for u in urls if u is not None}
    known = [(items[u], told[u][1]) for u in items if told[u][0]]
    count, by = {}, {}
    for t, v in known:
        for n in range(1, len(t) + 1):
            for c in itertools.combinations(sorted(t), n):
                count[c] = count.get(c, 0) + 1
                by[c, v] = by.get((c, v), 0) + 1
    rules = {(c, v): (n / count[c], n / len(known)) for (c, v), n in by.items()
             if n / len(known) >= min_support - 1e-12 and n / count[c] >= min_confidence}
    kept = {k: s for k, s in rules.items() if not any(
        v == k[1] and s2[0] >= s[0] and set(c) < set(k[0]) for (c, v), s2 in rules.items())}
    out = {}
    for u in urls:
        if told[u][0] or u is None:
            out[u] = told[u][1] or "allow"
            continue
        hits = [(*s, v) for (c, v), s in kept.items() if set(c) <= items[u]]
        out[u] = max(hits)[2] if hits else "allow"
    return out


def make_urls(rng, n):
    out = []
    for _ in range(n):
        host = rng.choice(["a", "www.a", "b", "blog.b", "spam"]) + "." + rng.choice(["example.org", "example.com", "example.net", "org", "de"])
        out.append(f"http://{host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.choice(['1', '12', '2', '3/'])}"
                   + rng.choice(["", "?ref=x", "?utm=feed&p=2", "#top"]))
    return out


def test_rules_same_as_brute_force(spark):
    rng = random.Random(3)
    urls = make_urls(rng, 400) + [None, "", "nothing", "HTTP://A.Example.ORG/es/x", "x://a.example.org", "x://org/?a#b", "x://com:80/de/", "x://com/de/1"]
    pages = [(i, u, "html", "clash") for i, u in enumerate(urls)] + [(None, urls[0], None, ""), (7, urls[7], "", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, items string")
    for support, confidence in ((0.02, 0.9), (0.05, 0.6)):
        want = brute(set(urls), support, confidence)
        got = op.judge_urls(df, min_support=support, min_confidence=confidence, max_items=99).collect()
        assert len(got) == len(pages)
        by_id = {}
        for r in got:
            by_id.setdefault(r.page_id, []).append(r)
        for i, u, _, _ in pages:
            for r in by_id[i]:
                host, path = split(u)
                assert (r.host, r.path, r.rule) == (host, path, given(host, path)[0]), u
                assert r.verdict == want[u], (u, r.mined)


def test_long_urls_same_as_brute_force(spark):
    """Over 12 frequent tokens a url, at the production number of tokens; the
    block urls have tokens that tell more than those they share with allow urls."""
    rng = random.Random(8)
    urls = []
    for i in range(60):
        host, path = rng.choice([("a.example.org", "/es/"), ("b.org", "/"), ("c.com", "/de/"), ("d.com", "/fr/")])
        mine = [f"t{j}" for j in range(8) if rng.random() < (0.8 if host[0] in "ac" else 0.3)]
        both = [f"s{j}" for j in range(5) if rng.random() < 0.7]
        urls.append(f"http://{host}{path}{'/'.join(mine + both)}")
    urls += ["http://x.net/" + "/".join(rng.sample([f"t{j}" for j in range(8)] + [f"s{j}" for j in range(5)], rng.choice([1, 2, 3, 6]))) for _ in range(80)]
    urls = sorted(set(urls))
    assert max(len(tokens(u, *split(u))) for u in urls) > 12
    want = brute(set(urls), 0.12, 0.9)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in op.judge_urls(df, min_support=0.12, min_confidence=0.9).collect()}
    assert {u: got[i].verdict for i, u in enumerate(urls)} == want


def test_one_hot_url_and_no_labels(spark):
    hot = "http://x.example.net/" + "/".join(f"s{i}" for i in range(40)) + "?" + "&".join(f"a{i}={i}" for i in range(20))
    df = spark.createDataFrame([(i, hot) for i in range(50)], "page_id long, url string")
    assert {(r.rule, r.verdict) for r in op.judge_urls(df).collect()} == {(None, "allow")}
    hot_org = hot.replace(".net", ".org")
    df = spark.createDataFrame([(i, hot_org if i % 2 else hot) for i in range(50)], "page_id long, url string")
    assert {(r.rule, r.verdict) for r in op.judge_urls(df).collect()} == {(None, "allow"), ("org/", "allow")}


def test_empty(spark):
    assert op.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []

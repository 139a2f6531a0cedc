import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from remuneria.llm import turn_repair as tr

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")
SPACES = " \t\n\x0b\x0c\r"


def faults(rows):
    """Fault of each (turn, role, text) in order."""
    out, seen = [], set()
    for _, role, text in rows:
        if not text.strip(SPACES):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif text.strip(SPACES)[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def brute(rows):
    """Cost, audit, repaired turns: the least over all edit sequences, forwards over the text of initials."""
    fault = faults(rows)
    n = len(rows)

    @lru_cache(None)
    def go(i, said):
        """said: what decides what may follow: '', 's', 'u' or 'a'."""
        options = [] if i < n or said in ("s", "u") else [(0, "", ())]
        for role in ("user", "assistant"):
            if LEGAL.match({"": "", "s": "s", "u": "u", "a": "ua"}[said] + {"u": "ua", "a": "a"}[role[0]]):
                if said != "s" or role == "user":
                    options.append((3, "I", i, role[0], (role, "")))
        if i < n:
            _, role, text = rows[i]
            options.append((4, "D", i + 1, said, None))
            if fault[i] not in ("blank", "duplicate"):
                extra = 3 if fault[i] == "truncated" else 0
                follows = {"": "su", "s": "u", "u": "a", "a": "u"}[said]
                if role[:1] and role[0] in follows:
                    options.append((extra, "K", i + 1, role[0], (role, text)))
                for new in ("user", "assistant"):
                    if new[0] in follows:
                        options.append((3 + extra, "R", i + 1, new[0], (new, text)))
        return options

    # Dijkstra by (cost, audit); an audit and the rows decide the result
    import heapq
    heap, done = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, said, out = heapq.heappop(heap)
        if i == n and said in ("", "a"):
            best = (cost, audit, out)
            ties = [h for h in heap if h[0] == cost and h[2] == n and h[3] in ("", "a")]
            return min([best] + [(c, a, o) for c, a, _, _, o in ties])
        if (i, said) in done and done[i, said] < (cost, audit):
            continue
        done[i, said] = (cost, audit)
        for o in go(i, said):
            if len(o) == 5:
                c, edit, j, next_, turn = o
                heapq.heappush(heap, (cost + c, audit + edit, j, next_, out + ((turn,) if turn else ())))


def expected(convs, conv):
    rows = sorted(convs.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    fault = faults(rows)
    cost, audit, out = brute(tuple(rows))
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[fault.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        spoken = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{spoken[0]}:{spoken[1]}".encode()) % 20
        role, text = spoken[2:]
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


COLS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def table_of(df):
    rows = df.select("conv_id", *COLS).collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("symbols", ["", "su", "xua", "aSoU", "uuaa", "sUAxuaA"])
def test_walk_takes_the_least_audit(symbols):
    roles = {"u": "user", "a": "assistant", "s": "system", "o": "tool"}
    rows = tuple((i, roles.get(c.lower(), "user"), "" if c == "x" else f"t{i}" + ("" if c.isupper() else "."))
                 for i, c in enumerate(symbols))
    walk = tr.Walk()
    walk.to(symbols)
    cost, audit, at, new = walk.best()
    want = brute(rows)
    assert (cost, audit) == want[:2]
    assert [(n or rows[i][1], "" if i is None else rows[i][2]) for i, n in zip(at, new)] == list(want[2])


def test_walk_equals_brute_force_and_shares_ends():
    words = sorted({"".join(p) for n in range(6) for p in itertools.product("xsuAo", repeat=n)}, key=lambda w: w[::-1])
    roles = {"u": "user", "a": "assistant", "s": "system", "o": "tool", "x": "user"}
    walk = tr.Walk()
    for k, w in enumerate(words):
        walk.to(w)
        if k % 7 == 0:
            rows = tuple((i, roles[c.lower()], "" if c == "x" else f"t{i}" + ("" if c.isupper() else ".")) for i, c in enumerate(w))
            assert walk.best()[:2] == brute(rows)[:2]
    assert walk.nodes == len({w[i:] for w in words for i in range(len(w))})     # each end once


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    convs = damage(rows)
    got = table_of(tr.op13_turn_repair(spark, SF))
    assert set(got) == set(convs)
    for conv in convs:
        assert got[conv] == expected(convs, conv), conv


def test_odd_conversations(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "User", "", None, "uncle"]
    texts = ["Yes.", "no", "", None, " \n", "Why?\t", "e" * 50_000 + "!", "  x  ", "Yes."]
    rows = [(rng.choice([1, 2, 3, 4, 5, 6, None]), rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(roles), rng.choice(texts))
            for _ in range(150)]
    rows += rows[:10] + [(7, None, None, None), (8, None, None, "a."), (-3, 4, "user", None)]
    rows += [(100 + i, t, ("user", "assistant")[t % 2], "Same.") for i in range(40) for t in range(4)]
    df = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], SCHEMA + ", word string, cost int").repartition(4)
    convs = damage(rows)
    got = table_of(tr.repair_digests(tr.damaged(df)))
    assert got == {c: expected(convs, c) for c in convs}


def test_operator_gives_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Well?"), (2, None, None, None), (3, 0, "user", "cut")]
    out = {r.conv_id: r for r in tr.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (out[1].audit, out[1].cost) == ("IKKI", 6)
    assert [tuple(t) for t in out[1].repaired] == [("user", ""), ("assistant", "Hi."), ("user", "Well?"), ("assistant", "")]
    assert out[2].audit == "" and out[2].repaired == [] and out[2].illegal == 0
    assert (out[3].audit, out[3].cost, out[3].truncated) == ("D", 4, 1)


def test_empty_and_long(spark):
    assert tr.repair_digests(tr.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    n = 20_000
    rows = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat(id, '.') text")
    r = tr.repair(rows).first()
    assert r.audit == "K" * n and r.cost == 0 and len(r.repaired) == n

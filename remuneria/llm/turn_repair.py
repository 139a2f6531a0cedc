"""Conversation structure repair over a suffix-shared automaton.

Each turn is one symbol: ``x`` if it is blank or repeats an earlier turn (it
must go), else its role's initial (s, u, a, or o for any other), upper-case if
its text is cut off. A conversation is the word of its symbols. Words are
minimised from the end: equal words become one, and words with a common end
share its nodes, so a node is a distinct end. Sorted by their reversals (a
range partitioning), words that share an end stand together; a task walks them
with a stack of the nodes of the present word, keeps what the next word
shares, and computes cost-to-go and the first edit of the best audit for each
new node and grammar state: once over all conversations (again only where a
range begins within a shared end). Best audits are read off the stack.

Grammar: the repaired initials are ``(s?(ua)+)?``; states: 0 nothing yet, 1
after s, 2 after u, 3 after a. In each state one of user or assistant fits, so
Insert and Rerole need no name. Edits and costs: Keep 0, Rerole to user or
assistant 3, Delete 4, Insert an empty user or assistant turn 3; a cut-off
turn that stays costs 3 more. Of the cheapest audits (the edits' initials) the
least in ASCII order is taken; from one state two edits never share an
initial, so the least first edit at each node gives the least audit.

Everything but the walk is DataFrame work: one shuffle brings the turns of a
conversation together, audits return to conversations by their word (a common
word is a skewed join, which Spark splits), and rows are rewritten in place.

Defined cases: turns come by turn (nulls first), ties by role and text; a null
role or text counts as one space; a row in which turn, role and text are all
null only names its conversation; a null conv_id is a conversation; role
initials are case-sensitive and an empty role has none; repeated rows are
duplicates; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from .common import CRC_TABLE, crc32_sql, table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, CUT_COST = 3, 4, 3, 3
SPACE = r"\x20\x09-\x0D"
#: The role that fits in each state, and the states after it.
FITS = ("u", "u", "a", "u")
AFTER = {"s": 1, "u": 2, "a": 3}
NAMES = {"u": "user", "a": "assistant"}
#: Node of the empty end: costs and first edits by state ('' stops).
END = ((0, 2 * INSERT_COST, INSERT_COST, 0), ("", INSERT, INSERT, ""))


def node(symbol: str, below: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Costs and first edits of an end that begins with ``symbol``; ``below``: costs of what follows."""
    role, extra = symbol.lower(), CUT_COST if symbol.isupper() else 0
    options = []
    for state, fits in enumerate(FITS):
        here = [(below[state] + DELETE_COST, DELETE)]
        if role != "x":
            here.append((below[AFTER[fits]] + REROLE_COST + extra, REROLE))
            if role == fits or (role == "s" and state == 0):
                here.append((below[AFTER[role]] + extra, KEEP))
        options.append(min(here))
    best = list(options)
    for _ in FITS:                              # inserts lead from state to state in place
        best = [min(o, (best[AFTER[fits]][0] + INSERT_COST, INSERT)) for o, fits in zip(options, FITS)]
    return tuple(c for c, _ in best), tuple(e for _, e in best)


class Walk:
    """The nodes of one word, from its end; words come in order of their reversals."""

    def __init__(self):
        self.word = ""                          # reversed
        self.costs = [array("q", END[0])]
        self.edits = ["\0".join(END[1])]
        self.nodes = 0

    def to(self, word: str) -> None:
        word = word[::-1]
        shared = len(commonprefix([self.word, word]))
        del self.costs[shared + 1:], self.edits[shared + 1:]
        for symbol in word[shared:]:
            costs, edits = node(symbol, self.costs[-1])
            self.costs.append(array("q", costs))
            self.edits.append("\0".join(edits))
            self.nodes += 1
        self.word = word

    def best(self) -> tuple[int, str, list[int | None], list[str | None]]:
        """Cost, audit, and for each repaired turn its row (null: inserted) and new role (null: its own)."""
        size = len(self.word)
        depth, state, audit, rows, roles = size, 0, [], [], []
        while True:
            edit = self.edits[depth].split("\0")[state]
            if not edit:
                break
            audit.append(edit)
            if edit != DELETE:
                kept = self.word[depth - 1].lower() if edit == KEEP else FITS[state]
                rows.append(None if edit == INSERT else size - depth)
                roles.append(None if edit == KEEP else NAMES[kept])
                state = AFTER[kept]
            if edit != INSERT:
                depth -= 1
        return self.costs[size][0], "".join(audit), rows, roles


_PLAN = "word string, cost long, audit string, rows array<int>, roles array<string>"


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = Walk()
    names = ["word", "cost", "audit", "rows", "roles"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())]
    for batch in batches:
        out = []
        for word in batch.column(0).to_pylist():
            walk.to(word)
            out.append((word, *walk.best()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else
                                         [pa.array([], k) for k in kinds], names=names)


def cheapest_audits(words: DataFrame) -> DataFrame:
    """word, cost, audit, rows, roles for each distinct ``word`` of symbols."""
    end = F.reverse("word")
    return words.select("word").distinct().repartitionByRange(end).sortWithinPartitions(end).mapInArrow(_plans, _PLAN)


def _spoken(c: Column) -> Column:
    return F.coalesce(c, F.lit(" "))


def symbols(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns (turn, role, text, ...), word, blank, duplicate, truncated, illegal, gaps."""
    there = F.col("turn").isNotNull() | F.col("role").isNotNull() | F.col("text").isNotNull()
    rows = turns.select("conv_id", "turn", _spoken(F.col("role")).alias("role"), _spoken(F.col("text")).alias("text"),
                        there.alias("there"))
    # one shuffle: what follows is grouped by more than conv_id or by conv_id alone
    rows = rows.repartition("conv_id").withColumn("nth", F.expr(
        "row_number() OVER (PARTITION BY conv_id, there, role, text ORDER BY turn)"))
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    repeat, cut = F.col("nth") > 1, ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    rows = rows.select("conv_id", F.when(F.col("there"), F.struct(
        "turn", "role", "text", "nth", initial.alias("initial"), F.when(blank | repeat, "x").when(cut, F.upper(role)).otherwise(role)
        .alias("symbol"))).alias("t"), *[F.when(F.col("there"), c.cast("long")).alias(n) for n, c in (
            ("blank", blank), ("duplicate", ~blank & repeat), ("truncated", ~blank & ~repeat & cut))])
    total = lambda n: F.coalesce(F.sum(n), F.lit(0)).alias(n)
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"),
                                        total("blank"), total("duplicate"), total("truncated"))
    at = F.filter(F.transform("turns", lambda t: t["turn"]), lambda n: n.isNotNull())
    first = F.transform("turns", lambda t: t["initial"])
    legal = F.transform(first, lambda c, i: F.when(i > 0, F.concat(F.get(first, i - 1), c)).otherwise("su"))
    return convs.select(
        "conv_id", "turns", "blank", "duplicate", "truncated",
        F.array_join(F.transform("turns", lambda t: t["symbol"]), "").alias("word"),
        F.size(F.filter(legal, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"),
        F.coalesce(F.array_max(at) - F.array_min(at) + 1 - F.size(F.array_distinct(at)), F.lit(0)).cast("long").alias("gaps"))


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (array of role, text)."""
    scratch = Scratch(turns.sparkSession, "repair")
    convs = scratch.save(symbols(turns))
    plans = scratch.save(cheapest_audits(convs))
    row = lambda i: F.get("turns", i)
    made = F.zip_with("rows", "roles", lambda i, r: F.struct(
        F.coalesce(r, row(i)["role"]).alias("role"), F.coalesce(row(i)["text"], F.lit("")).alias("text")))
    return convs.join(plans, "word").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", made.alias("repaired"))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows with planted faults, by crc32 of ``conv_id:turn`` mod 20: 0 drops the row (one that only
    names the conversation stays), 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it a user's."""
    name = F.concat(*[_spoken(F.col(c).cast("string")) if c else F.lit(":") for c in ("conv_id", None, "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    role, text = _spoken(F.col("role")), _spoken(F.col("text"))
    row = F.struct("turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
                   F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return turns.select("conv_id", F.explode_outer(F.array_repeat(row, copies)).alias("t")).select("conv_id", "t.*")


def repair_digests(turns: DataFrame) -> DataFrame:
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return repair(turns).withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("repaired")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(damaged(table(spark, sf_dir, "conversations")))


# cost-to-go and audit of every end of every distinct word, by recursion from the end
ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS named FROM conversations
), kinds AS (
  SELECT *, {crc32_sql('named')} % 20 AS kind FROM c, crc_table
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN ''
         WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS ini FROM d
), p AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o
), t AS (
  SELECT *, CASE WHEN blank OR again THEN 'x' WHEN cut THEN upper(CASE WHEN ini IN ('s', 'u', 'a') THEN ini ELSE 'o' END)
                 WHEN ini IN ('s', 'u', 'a') THEN ini ELSE 'o' END AS symbol FROM p
), conv AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate,
         count_if(cut AND NOT again AND NOT blank) AS truncated, count_if(i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal,
         string_agg(symbol, '' ORDER BY i) AS word FROM t GROUP BY conv_id
), ends AS (
  SELECT word, 0 AS k, struct_pack(c := 0, a := '') AS g0, struct_pack(c := 6, a := 'II') AS g1, struct_pack(c := 3, a := 'I') AS g2,
         struct_pack(c := 0, a := '') AS g3 FROM (SELECT DISTINCT word FROM conv)
  UNION ALL
  SELECT word, k, list_min([b0, struct_pack(c := j2.c + 3, a := 'I' || j2.a)]), list_min([b1, struct_pack(c := j2.c + 3, a := 'I' || j2.a)]), j2,
         list_min([b3, struct_pack(c := b2.c + 3, a := 'I' || b2.a)])
  FROM (SELECT *, list_min([b2, struct_pack(c := b3.c + 3, a := 'I' || b3.a)]) AS j2 FROM (
    SELECT word, k + 1 AS k,
      list_min([struct_pack(c := g0.c + 4, a := 'D' || g0.a), CASE WHEN r <> 'x' THEN struct_pack(c := g2.c + 3 + e, a := 'R' || g2.a) END,
        CASE WHEN r = 'u' THEN struct_pack(c := g2.c + e, a := 'K' || g2.a) WHEN r = 's' THEN struct_pack(c := g1.c + e, a := 'K' || g1.a) END]) AS b0,
      list_min([struct_pack(c := g1.c + 4, a := 'D' || g1.a), CASE WHEN r <> 'x' THEN struct_pack(c := g2.c + 3 + e, a := 'R' || g2.a) END,
        CASE WHEN r = 'u' THEN struct_pack(c := g2.c + e, a := 'K' || g2.a) END]) AS b1,
      list_min([struct_pack(c := g2.c + 4, a := 'D' || g2.a), CASE WHEN r <> 'x' THEN struct_pack(c := g3.c + 3 + e, a := 'R' || g3.a) END,
        CASE WHEN r = 'a' THEN struct_pack(c := g3.c + e, a := 'K' || g3.a) END]) AS b2,
      list_min([struct_pack(c := g3.c + 4, a := 'D' || g3.a), CASE WHEN r <> 'x' THEN struct_pack(c := g2.c + 3 + e, a := 'R' || g2.a) END,
        CASE WHEN r = 'u' THEN struct_pack(c := g2.c + e, a := 'K' || g2.a) END]) AS b3
    FROM (SELECT *, lower(substr(word, length(word) - k, 1)) AS r, CASE WHEN substr(word, length(word) - k, 1) IN ('S', 'U', 'A', 'O') THEN 3 ELSE 0 END AS e
          FROM ends WHERE k < length(word))))
), best AS (
  SELECT word, g0.c AS cost, g0.a AS audit FROM ends WHERE k = length(word)
), edits AS (
  SELECT conv_id, j, substr(audit, j, 1) AS e, length(replace(left(audit, j), 'I', '')) AS i, length(replace(left(audit, j), 'D', '')) - 1 AS place
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM conv JOIN best USING (word))
), said AS (
  SELECT edits.*, t.role, t.text, bool_or(place = 0 AND e = 'K' AND left(t.role, 1) = 's') OVER (PARTITION BY edits.conv_id) AS system
  FROM edits LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM edits.conv_id AND t.i = edits.i AND e <> 'I'
), made AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - CASE WHEN system THEN 1 ELSE 0 END) % 2 = 0 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY j) FILTER (e <> 'D') AS lines FROM said GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN conv ON conv.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best ON best.word = conv.word LEFT JOIN made ON made.conv_id IS NOT DISTINCT FROM a.conv_id
"""

QUERIES = {"op13_turn_repair": op13_turn_repair}
ORACLE = {"op13_turn_repair": ORACLE_SQL}

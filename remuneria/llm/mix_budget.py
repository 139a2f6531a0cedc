"""Mixing sources to target weights by hierarchical budgeting.

Documents are the leaves' stock in a domain - language - source tree. The
token budget of a node is shared among its children by weight. A child's
capacity is what its leaves hold, ``max_epochs`` times over; a child that
can't use its share is filled, and the rest of its share goes to its siblings.
Only what all siblings together can't use is missing from their parent, and
so passes to the parent's siblings. Budgets are whole tokens, rounded down at
each node.

A leaf's budget is spent on seeded epochs: in each epoch its documents stand
in the order of md5(seed:epoch:doc_id); all full epochs are taken, and of the
last one the longest prefix of whole documents within the rest of the budget.

The tree is as small as the number of sources: aggregation and windows over
siblings, no documents. The prefix of a leaf with a third of all documents is
found without sorting it in one task: tokens are summed by the first three hex
digits of the key, the digits at which the budget ends are refined by three
more, and only documents that share all six are put in order.

Defined cases: a null text has no tokens; a null lang is ``und``, a source
that no domain names (null too) is in ``other``; a weight that isn't declared
is 1, a weight of 0 takes nothing; a document
without tokens stands in every full epoch of its leaf, and in the last one if
it is in the prefix; rows that repeat an id stand side by side in the order; an empty table
gives no row; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .common import table, text_of

LEVELS = ("domain", "lang", "source")
DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """Declared weights (whole numbers; 1 where none is given) by level and name."""

    domains: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "web": tuple(f"src{i}" for i in range(0, 8)), "news": tuple(f"src{i}" for i in range(8, 14)),
        "books": tuple(f"src{i}" for i in range(14, 18)), "code": tuple(f"src{i}" for i in range(18, 20))})
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {
        "domain": {"web": 35, "news": 25, "books": 20, "code": 20, "other": 5},
        "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 3}})
    percent: int = 60
    max_epochs: int = 3
    seed: str = "mix-1"


MIX = Mix()


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def _named(column: Column, names: dict, default) -> Column:
    out = F.lit(default)
    for k, v in names.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def leaf_of(mix: Mix) -> list[Column]:
    """The domain, lang and source columns of a document."""
    domain = F.lit("other")
    for name, sources in mix.domains.items():
        domain = F.when(F.col("source").isin(*sources), F.lit(name)).otherwise(domain)
    return [domain.alias("domain"), F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")]


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to each child: the parent's ``given`` (equal in all its
    children) by ``weight``, filling children up to ``cap`` and passing on what
    they can't use."""
    own = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = own.orderBy(F.col("cap") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    d = children.withColumn("filled", F.expr("cap") * F.sum("weight").over(rest)
                            <= F.col("weight") * (F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0))))
    d = d.withColumn("used", F.coalesce(F.sum(F.when(F.col("filled"), F.col("cap"))).over(own), F.lit(0)))
    d = d.withColumn("open", F.sum(F.when(~F.col("filled"), F.col("weight"))).over(own))
    return d.withColumn("budget", F.when(F.col("filled"), F.col("cap")).otherwise(
        F.expr("weight * (given - used) div open"))).drop("filled", "used", "open", "given", "cap", "weight")


def leaf_budgets(leaves: DataFrame, mix: Mix, total: Column | None = None) -> DataFrame:
    """domain, lang, source, tokens, budget for each leaf (tokens: of one epoch)."""
    caps = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    for level in LEVELS:
        caps = caps.withColumn("w_" + level, _named(F.col(level), mix.weights.get(level, {}), 1).cast("long"))
    usable = caps.withColumn("cap", F.when((F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0), F.col("cap")).otherwise(0))
    by = lambda n: usable.groupBy(*LEVELS[:n], *["w_" + x for x in LEVELS[:n]]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    top = by(1)
    top = top.withColumn("given", F.expr(f"sum(tokens) over (partition by 0) * {mix.percent} div 100") if total is None else total)
    budget = None
    for n, level in enumerate(LEVELS, 1):
        d = top if n == 1 else by(n).join(budget.withColumnRenamed("budget", "given"), list(LEVELS[:n - 1]))
        d = d.withColumn("weight", F.col("w_" + level)).withColumn("weight", F.when(F.col("cap") > 0, F.col("weight")).otherwise(1))
        budget = share_out(d, list(LEVELS[:n - 1]), level).select(*LEVELS[:n], *(["tokens"] if n == 3 else []), "budget")
    return budget


def _cut(rows: DataFrame, digits: int, scratch: Scratch) -> DataFrame:
    """Rows (leaf, key, n, left) -> the same with ``taken``: true before the
    digits at which ``left`` ends, false behind, null at them (with what is left)."""
    head = F.substring("key", 1, digits)
    sums = rows.groupBy(*LEVELS, "left", head.alias("head")).agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*LEVELS).orderBy("head").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("n").over(order)).filter(F.col("upto") > F.col("left"))
    end = sums.groupBy(*LEVELS).agg(F.min(F.struct("head", (F.col("left") - F.col("upto") + F.col("n")).alias("left"))).alias("end"))
    # written, one row per leaf: the join is a plain shuffle join, whose hot leaves Spark can split
    d = rows.join(scratch.save(end), list(LEVELS), "left")
    taken = F.when(F.col("end").isNull() | (head < F.col("end.head")), True).when(head > F.col("end.head"), False)
    return d.withColumn("taken", taken).withColumn("left", F.coalesce("end.left", "left")).drop("end")


def mix_sources(docs: DataFrame, mix: Mix = MIX) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies, tokens for each document
    that the mix takes (copies: how many epochs hold it)."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.save(docs.select("doc_id", *leaf_of(mix), n_tokens(text_of()).alias("n")))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    budgets = leaf_budgets(leaves, mix)
    budgets = budgets.withColumn("full", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0))
    budgets = budgets.select(*LEVELS, "full", (F.col("budget") - F.col("full") * F.col("tokens")).alias("left"))
    d = rows.join(scratch.save(budgets), list(LEVELS)).withColumn(
        "key", F.md5(F.concat_ws(":", F.lit(mix.seed), "full", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    one = scratch.save(_cut(d, DIGITS, scratch))
    two = scratch.save(_cut(one.filter("taken is null").drop("taken"), 2 * DIGITS, scratch))
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("key", "n").rowsBetween(Window.unboundedPreceding, 0))
    last = two.filter("taken is null").withColumn("taken", upto <= F.col("left"))
    all_ = one.filter("taken is not null").unionByName(two.filter("taken is not null")).unionByName(last)
    copies = F.least(F.col("full") + F.col("taken").cast("long"), F.lit(mix.max_epochs))
    return all_.filter(copies > 0).select("doc_id", *LEVELS, F.col("n").alias("n_tokens"), copies.alias("copies"), (copies * F.col("n")).alias("tokens"))


def op8_mix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def _fill(level: str, above: str, group: str, parents: str) -> str:
    own = f"PARTITION BY {parents}" if parents else ""
    return f"""
{level}_f AS (SELECT *, cap * sum(w) OVER ({own} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (given - coalesce(sum(cap) OVER ({own} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled
  FROM (SELECT {group}, sum(cap) AS cap, sum(tokens) AS tokens, CASE WHEN sum(cap) > 0 THEN any_value(w_{level}) ELSE 1 END AS w,
    {above} FROM leaf {'JOIN ' + parents.split(', ')[-1] + '_b USING (' + parents + ')' if parents else ''} GROUP BY {group})),
{level}_b AS (SELECT {group}, tokens, CASE WHEN filled THEN cap ELSE w * (given - coalesce(sum(cap) FILTER (filled) OVER ({own}), 0))
    // sum(w) FILTER (NOT filled) OVER ({own}) END AS budget FROM {level}_f)"""


def oracle_sql(mix: Mix = MIX) -> str:
    case = lambda level: "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in mix.weights[level].items()) + " ELSE 1 END"
    domain = "CASE" + "".join(f" WHEN source IN ({', '.join(repr(s) for s in v)}) THEN '{k}'" for k, v in mix.domains.items()) + " ELSE 'other' END"
    return rf"""
WITH d AS (SELECT doc_id, {domain} AS domain, coalesce(lang, 'und') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
leaf AS (SELECT domain, lang, source, sum(n) AS tokens, sum(n) * {mix.max_epochs} AS cap,
    {case('domain')} AS w_domain, {case('lang')} AS w_lang, {case('source')} AS w_source FROM d GROUP BY ALL),
{_fill('domain', f'(SELECT sum(tokens) * {mix.percent} // 100 FROM leaf) AS given', 'domain', '').strip()},
{_fill('lang', 'any_value(budget) AS given', 'domain, lang', 'domain').strip().replace('sum(tokens) AS tokens', 'sum(leaf.tokens) AS tokens')},
{_fill('source', 'any_value(budget) AS given', 'domain, lang, source', 'domain, lang').strip().replace('sum(tokens) AS tokens', 'sum(leaf.tokens) AS tokens')},
b AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS fully FROM source_b),
o AS (SELECT d.*, fully, budget - fully * tokens AS remain, sum(n) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{mix.seed}:' || CAST(fully AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), n ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN b USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n::BIGINT AS n_tokens, copies::BIGINT AS copies, (copies * n)::BIGINT AS tokens
FROM (SELECT *, least(fully + (upto <= remain)::INT, {mix.max_epochs}) AS copies FROM o) WHERE copies > 0
"""


QUERIES = {"op8_mix_budget": op8_mix_budget}
ORACLE = {"op8_mix_budget": oracle_sql()}

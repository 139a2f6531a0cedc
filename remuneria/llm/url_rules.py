"""URL filter by association rules.

``apply_prefix_rules`` judges urls by declared (host, path) rules. The urls
that a rule decides are the labelled examples from which ``mine`` learns: the
token combinations that go with a label, of which those that pass the support
and confidence thresholds and aren't implied by a shorter rule of at least the
same confidence stay. ``match`` finds the rules
of a url by an inverted index: a rule is listed under its rarest token, so a
url meets only rules that it can satisfy in full after one containment test.

Tokens of a url: the labels of its host, the segments of its path, and the
names and pairs of its query, each tagged with its kind. All tokens serve for
mining and for matching.

Spark's FP-growth mines whole baskets: all tokens of an example, and its label
as one more item. Three steps before it lose no rule: tokens below the support
go; tokens that stand in the same examples become one item (a url has the item
if it has one of them, as a rule with one of them fires and one with more is
implied); tokens whose examples all have one label, and tokens of all
examples, make rules of their own and leave the baskets (a rule that adds
anything to them is implied by the one without). The frequent sets still are
exponential in tokens that occur together in all mixtures of labels.

The frequent tokens are bounded by the support threshold, not by the data.
Everything is done once per distinct url. DataFrame functions only.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no rule, and tokens only from what it has (none for null); ties go to the
more confident, then the better supported rule, then to ``block``; without a
matching rule, or without labelled examples, the verdict is ``allow``;
repeated rows each get their answer; an empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from .common import table

ALLOW, BLOCK = "allow", "block"
LABEL = "verdict:"
#: (verdict, host, path)
RULES = ((ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"),
         (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.9
MAX_ITEMS = None
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The text after the first ``://``, as (host with A-Z lower-cased, path)."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.regexp_extract(rest, r"(?s)^[^?#]*", 0)
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, _UPPER, _LOWER), F.substring(rest, F.length(host) + 1, F.length(rest))


def _longest(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def apply_prefix_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """url, host, path, rule, given (the rule's verdict)."""
    host, path = host_and_path(F.col("url"))
    d = urls.select("url", host.alias("host"), path.alias("path"))
    d = d.withColumn("r", _longest(F.col("host"), F.col("path"), rules))
    return d.select("url", "host", "path", "r.rule", F.col("r.verdict").alias("given"))


def tokens(url: Column, host: Column, path: Column) -> Column:
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    tag = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    pairs = F.split(query, "&")
    return F.coalesce(F.array_distinct(F.concat(
        tag("host:", F.split(host, r"\.")), tag("path:", F.split(path, "/")), tag("query:", pairs),
        tag("name:", F.transform(pairs, lambda x: F.substring_index(x, "=", 1))))), F.array().cast("array<string>"))


def _containment(sets: DataFrame, rules: DataFrame, rarity: DataFrame) -> DataFrame:
    """The rules (rid, need, ...) whose tokens all stand in ``items``, one row
    per set and rule; a rule is indexed under its rarest token."""
    anchor = (rules.select("rid", F.explode("need").alias("token")).join(rarity, "token")
              .groupBy("rid").agg(F.min_by("token", F.struct("seen", "token")).alias("token")))
    index = rules.join(anchor, "rid")
    at = sets.select("*", F.explode("items").alias("token"))
    return at.join(index, "token").filter(F.size(F.array_except("need", "items")) == 0).drop("token")


def _items(sets: DataFrame, by: list[str], members: DataFrame) -> DataFrame:
    """``by`` columns, items: the items of each set's tokens; sets without one are left out."""
    return (sets.select(*by, F.explode("items").alias("token")).join(members, "token")
            .groupBy(*by).agg(F.array_sort(F.collect_set("item")).alias("items")))


def mine(examples: DataFrame, scratch: Scratch, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         max_items: int | None = MAX_ITEMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules: rid, need, verdict, confidence, support; items: token, seen;
    members: token, item) from ``examples`` (url, items, given), each url once.
    ``max_items`` bounds the items of a rule (None: any number)."""
    total = examples.count()
    need = max(1, math.ceil(min_support * total))
    h = lambda *seed: F.bit_xor(F.xxhash64(*seed, "url"))
    counts = (examples.select("url", F.explode("items").alias("token"), (F.col("given") == BLOCK).cast("long").alias("b"))
              .groupBy("token").agg(F.count("*").alias("seen"), F.sum("b").alias("b"), h().alias("h1"), h(F.lit(1)).alias("h2"))
              .filter(F.greatest("b", F.col("seen") - F.col("b")) >= need))
    # tokens of the same examples, by number, labels and 128 bits of their urls
    items = scratch.save(counts.groupBy("seen", "b", "h1", "h2").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens")))
    members = scratch.save(items.select("item", F.explode("tokens").alias("token")))
    told = [items.select(F.array("item").alias("need"), "seen", "b")]
    mixed = items.filter((F.col("b") > 0) & (F.col("b") < F.col("seen")) & (F.col("seen") < total)).select("item")
    baskets = scratch.save(_items(examples, ["url", "given"], members.join(mixed, "item", "left_semi")).select(
        F.concat("items", F.array(F.concat(F.lit(LABEL), "given"))).alias("items")))
    n = baskets.count()
    if n >= need and max_items != 1:
        sets = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / n).fit(baskets).freqItemsets
        sets = scratch.save(sets.select(F.array_sort(F.filter("items", lambda x: ~x.startswith(LABEL))).alias("need"), F.filter(
            "items", lambda x: x.startswith(LABEL)).alias("label"), "freq").filter(F.size("need") > 1))
        # a set that is frequent with a label is frequent without it
        b = F.coalesce(F.max(F.when(F.get("label", F.lit(0)) == LABEL + BLOCK, F.col("freq"))), F.lit(0))
        a = F.coalesce(F.max(F.when(F.get("label", F.lit(0)) == LABEL + ALLOW, F.col("freq"))), F.lit(0))
        seen = F.max(F.when(F.size("label") == 0, F.col("freq")))
        sets = sets.groupBy("need").agg(seen.alias("seen"), b.alias("b"), a.alias("a")).filter("a + b > 0")
        # below the support a label's number isn't told: it is what the other one leaves
        told.append(sets.select("need", "seen", F.when(F.col("b") > 0, F.col("b")).otherwise(F.col("seen") - F.col("a")).alias("b")))
    sets = reduce(DataFrame.unionByName, told)
    found = sets.select("need", "seen", F.explode(F.array(
        F.struct(F.lit(BLOCK).alias("verdict"), F.col("b").alias("n")),
        F.struct(F.lit(ALLOW).alias("verdict"), (F.col("seen") - F.col("b")).alias("n")))).alias("v"))
    found = found.withColumn("confidence", F.col("v.n") / F.col("seen")).filter((F.col("v.n") >= need) & (F.col("confidence") >= min_confidence))
    if max_items is not None:
        found = found.filter(F.size("need") <= max_items)
    found = scratch.save(found.select(
        F.concat_ws("\n", "need", F.concat(F.lit(LABEL), "v.verdict")).alias("rid"), "need", "v.verdict", "confidence",
        (F.col("v.n") / F.lit(float(max(1, total)))).alias("support")))
    rarity = items.select(F.col("item").alias("token"), "seen")
    shorter = _containment(found.select(F.col("rid").alias("of"), F.col("need").alias("items"), F.col("verdict").alias("v"),
                                        F.col("confidence").alias("c")), found, rarity)
    implied = shorter.filter((F.size("need") < F.size("items")) & (F.col("verdict") == F.col("v"))
                             & (F.col("confidence") >= F.col("c"))).select(F.col("of").alias("rid")).distinct()
    return scratch.save(found.join(implied, "rid", "left_anti")), rarity, members


def judge_urls(pages: DataFrame, rules=RULES, **thresholds) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the mined rule that decided,
    as text) for every row of ``pages``."""
    scratch = Scratch(pages.sparkSession, "url-rules")
    urls = apply_prefix_rules(pages.select("url").distinct(), rules)
    urls = scratch.save(urls.withColumn("items", tokens(F.col("url"), F.col("host"), F.col("path"))))
    known, rarity, members = mine(urls.filter("given is not null").select("url", "items", "given"), scratch, **thresholds)
    open_ = _items(urls.filter("given is null and url is not null"), ["url"], members)
    best = (_containment(open_, known, rarity).groupBy("url")
            .agg(F.max(F.struct("confidence", "support", "verdict", "rid")).alias("m")))
    answer = urls.join(best, "url", "left").select(
        "url", "host", "path", "rule", F.coalesce("given", "m.verdict", F.lit(ALLOW)).alias("verdict"),
        F.col("m.rid").alias("mined"))
    null_safe = F.col("p.url").eqNullSafe(F.col("a.url"))
    return pages.select("page_id", "url").alias("p").join(answer.alias("a"), null_safe).select(
        "p.page_id", "a.host", "a.path", "a.rule", "a.verdict", "a.mined")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op2_url_rules": op2_url_rules}
ORACLE: dict[str, str] = {}

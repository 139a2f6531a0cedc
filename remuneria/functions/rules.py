"""Keyword classifiers as data (survey R1-R29).

A rule set is an ordered list of ``Rule(label, keywords)``. ``classify``
compiles it to ONE native expression:

* ``first``: ``CASE WHEN m1 THEN l1 WHEN m2 THEN l2 ... ELSE default``
* ``last``:  the same CASE with the rules reversed (a later rule overwrites)
* ``multi``: ``filter(array(CASE WHEN m1 THEN l1 END, ...), x -> x IS NOT NULL)``

Each label compiles to one regular expression (an alternation of its
keywords), so a rule set of hundreds of keywords stays a handful of
``rlike`` calls and far below the 64 KB codegen limit.

Matching modes: ``contains`` (literal substring of the lower-cased text),
``regex`` (keywords are regex fragments, as pandas ``str.contains`` treats
them by default, so ``jr.`` means "jr + any char"), ``folded`` (lower case
and accents stripped on both sides).

NULL text matches nothing, so it gets the default label.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _c, fold, fold_text


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]

    def __init__(self, label: str, keywords: Iterable[str]):
        object.__setattr__(self, "label", label)
        object.__setattr__(self, "keywords", tuple(keywords))


@dataclass(frozen=True)
class RuleSet:
    name: str
    rules: tuple[Rule, ...]
    default: str | None = None
    policy: str = "first"          # first | last | multi
    mode: str = "contains"         # contains | regex | folded
    exact: dict = field(default_factory=dict)   # whole-text lookup after the rules (R24)

    @property
    def labels(self) -> list[str]:
        seen: list[str] = []
        for r in self.rules:
            if r.label not in seen:
                seen.append(r.label)
        return seen


def _prepared(text: Column, mode: str) -> Column:
    return fold(text) if mode == "folded" else F.lower(text)


def _pattern(keywords: Sequence[str], mode: str) -> str:
    if mode == "regex":
        return "|".join(f"(?:{k})" for k in keywords)
    if mode == "folded":
        keywords = [fold_text(k) for k in keywords]
    else:
        keywords = [k.lower() for k in keywords]
    return "|".join(re.escape(k) for k in keywords)


def matches(texts: Sequence[Column], keywords: Sequence[str], mode: str = "contains") -> Column:
    """True when any of ``texts`` holds any keyword; NULL text -> False."""
    pat = _pattern(keywords, mode)
    hit = None
    for t in texts:
        one = F.coalesce(_prepared(t, mode).rlike(pat), F.lit(False))
        hit = one if hit is None else (hit | one)
    return hit if hit is not None else F.lit(False)


def classify(texts: Column | str | Sequence[Column | str], rs: RuleSet) -> Column:
    """Label column for rule set ``rs`` over one or several text columns
    (a rule hits when ANY text column holds a keyword)."""
    if not isinstance(texts, (list, tuple)):
        texts = [texts]
    cols = [_c(t) for t in texts]
    hits = [(r.label, matches(cols, r.keywords, rs.mode)) for r in rs.rules]
    if rs.policy == "multi":
        return F.filter(F.array(*[F.when(m, F.lit(lab)) for lab, m in hits]), lambda x: x.isNotNull())
    ordered = hits if rs.policy == "first" else list(reversed(hits))
    expr = None
    for lab, m in ordered:
        expr = F.when(m, F.lit(lab)) if expr is None else expr.when(m, F.lit(lab))
    fallback = F.lit(rs.default)
    if rs.exact:
        kv = []
        for k, v in rs.exact.items():
            kv += [F.lit(k), F.lit(v)]
        key = F.trim(_prepared(cols[0], rs.mode))
        fallback = F.coalesce(F.try_element_at(F.create_map(*kv), key), F.lit(rs.default))
    return expr.otherwise(fallback) if expr is not None else fallback


def flag(text: Column | str, any_of: Sequence[str], none_of: Sequence[str] = (),
         mode: str = "contains") -> Column:
    """Any keyword of ``any_of`` and none of ``none_of``."""
    t = [_c(text)]
    hit = matches(t, any_of, mode)
    if none_of:
        hit = hit & ~matches(t, none_of, mode)
    return hit


def bin_right_closed(x: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """(e0, e1] -> labels[0], (e1, e2] -> labels[1], ...; outside -> NULL
    (pandas ``cut``). The last edge may be ``float('inf')``."""
    v = _c(x)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = v > F.lit(lo)
        if hi != float("inf"):
            cond = cond & (v <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def bin_left_closed(x: Column | str, bands: Sequence[tuple[str, float | None, float | None]]) -> Column:
    """Bands (label, lo, hi) with lo <= x < hi; None = open end."""
    v = _c(x)
    expr = None
    for lab, lo, hi in bands:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (v >= F.lit(lo))
        if hi is not None:
            cond = cond & (v < F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def label_columns(df: DataFrame, specs: dict) -> DataFrame:
    """Add label columns ``{out: (text_column, rule_set)}``: one CASE per set
    in the projection, so a label that the query doesn't use is pruned and the
    source is read once."""
    return df.withColumns({out: classify(text, rs) for out, (text, rs) in specs.items()})

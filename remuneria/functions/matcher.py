"""Rule sets over a dictionary of distinct texts (survey R1-R24).

``rules.classify`` compiles a rule set to one regular expression per label and
runs them on every row. Here the keywords of all rule sets that read a column
stand in one trie (Aho-Corasick), so one pass over a text tells every rule that
it hits; and texts that repeat are judged once:

* ``count_labels`` counts equal texts first, so that a few distinct rows are
  judged whatever the number of rows;
* ``label_distinct`` judges the distinct texts and joins labels back (a small
  dictionary is broadcast by AQE, a large one is a shuffle join whose hot texts
  Spark splits);
* ``rule_hits`` judges the rows as they are, for texts that don't repeat.

Texts are lower-cased or folded by Spark, so every rule set means what it means
in ``rules``; keywords that are more than literal text (``jr.``) stay regular
expressions of their own. A null text hits nothing; equal labels of several
rules, empty tables and texts of any length are as in ``rules.classify``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch
from .rules import RuleSet, _prepared
from .text import fold_text

Specs = Mapping[str, tuple[Sequence[str], RuleSet]]
_SPECIAL = re.compile(r"[.^$*+?{}\[\]\\|()]")


def _literal(keyword: str, mode: str) -> str | None:
    """The keyword as it stands in a prepared text; null for a regular expression."""
    if mode == "regex":
        return None if _SPECIAL.search(keyword) else keyword
    return fold_text(keyword) if mode == "folded" else keyword.lower()


def _tries(specs: Specs) -> dict[tuple[str, str], dict[str, list[tuple[int, int]]]]:
    """(column, preparation): keyword: the (rule set, rule) pairs that it stands for."""
    out: dict = {}
    for s, (columns, rs) in enumerate(specs.values()):
        how = "folded" if rs.mode == "folded" else "lower"
        for c in columns:
            words = out.setdefault((c, how), {})
            for r, rule in enumerate(rs.rules):
                for k in rule.keywords:
                    if (k := _literal(k, rs.mode)) is not None:
                        words.setdefault(k, []).append((s, r))
    return out


def _expressions(columns: Sequence[str], rs: RuleSet) -> list[Column]:
    """The numbers of the rules that a regular expression hits, else null."""
    out = []
    for r, rule in enumerate(rs.rules):
        pattern = "|".join(f"(?:{k})" for k in rule.keywords if _literal(k, rs.mode) is None)
        if pattern:
            hit = F.lit(False)
            for c in columns:
                hit = hit | F.coalesce(_prepared(F.col(c), rs.mode).rlike(pattern), F.lit(False))
            out.append(F.when(hit, F.lit(r)))
    return out


def _search(words: list[dict[str, list[tuple[int, int]]]], n_sets: int, width: int):
    """Batches of (columns, prepared texts) -> columns and one array of rule numbers per rule set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        tries = []
        for column in words:
            trie = ahocorasick.Automaton()
            always = column.get("", [])
            for i, (k, pairs) in enumerate(column.items()):
                if k:
                    trie.add_word(k, (i, pairs))
            trie.make_automaton()
            tries.append((trie, len(trie), always))
        for batch in batches:
            out = [[] for _ in range(n_sets)]
            for texts in zip(*(batch.column(width + j).to_pylist() for j in range(len(tries)))):
                hit: list[set[int]] = [set() for _ in range(n_sets)]
                for text, (trie, size, always) in zip(texts, tries):
                    if text is None:
                        continue
                    for s, r in always:
                        hit[s].add(r)
                    if not size:
                        continue
                    seen: set[int] = set()
                    for _, (i, pairs) in trie.iter(text):
                        if i not in seen:
                            seen.add(i)
                            for s, r in pairs:
                                hit[s].add(r)
                            if len(seen) == size:
                                break
                for s in range(n_sets):
                    out[s].append(sorted(hit[s]))
            new = [pa.array(o, pa.list_(pa.field("element", pa.int32(), False))) for o in out]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=[f"c{i}" for i in range(width + n_sets)])

    return run


def rule_hits(df: DataFrame, specs: Specs) -> DataFrame:
    """``df`` with a column for each of ``specs`` {out: (text columns, rule set)}:
    the sorted numbers of the rules that any of the texts hits."""
    tries = _tries(specs)
    width, outs = len(df.columns), list(specs)
    found = [F.filter(F.array(*e), lambda r: r.isNotNull()) if (e := _expressions(*specs[o])) else None for o in outs]
    work = df.select(*[F.col(f"`{c}`") for c in df.columns], *[_prepared(F.col(c), how) for c, how in tries])
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)]
    fields += [T.StructField(f"c{width + s}", T.ArrayType(T.IntegerType(), False)) for s in range(len(outs))]
    hits = work.toDF(*[f"c{i}" for i in range(len(work.columns))]).mapInArrow(
        _search(list(tries.values()), len(outs), width), T.StructType(fields)).toDF(*df.columns, *outs)
    more = {o: F.array_sort(F.array_union(o, e)) for o, e in zip(outs, found) if e is not None}
    return hits.withColumns(more) if more else hits


def label_of(hits: Column | str, columns: Sequence[str], rs: RuleSet) -> Column:
    """The label (``multi``: array of labels) of rule numbers, as ``rules.classify`` gives it."""
    hits = F.col(hits) if isinstance(hits, str) else hits
    labels = F.array(*[F.lit(r.label) for r in rs.rules])
    if rs.policy == "multi":
        return F.transform(hits, lambda i: F.get(labels, i))
    fallback = F.lit(rs.default)
    if rs.exact:
        table = F.create_map(*[F.lit(x) for kv in rs.exact.items() for x in kv])
        fallback = F.coalesce(F.try_element_at(table, F.trim(_prepared(F.col(columns[0]), rs.mode))), fallback)
    return F.coalesce(F.get(labels, F.array_min(hits) if rs.policy == "first" else F.array_max(hits)), fallback)


def label_rows(df: DataFrame, specs: Specs) -> DataFrame:
    """``df`` with label columns, every row judged."""
    names = {o: f"__hits_{i}" for i, o in enumerate(specs)}
    hits = rule_hits(df, {names[o]: s for o, s in specs.items()})
    return hits.withColumns({o: label_of(names[o], *specs[o]) for o in specs}).drop(*names.values())


def label_distinct(df: DataFrame, specs: Specs) -> DataFrame:
    """``df`` with label columns; the texts of each set of columns are a
    dictionary, of which every entry is judged once."""
    out = df
    for columns in dict.fromkeys(tuple(cols) for cols, _ in specs.values()):
        keys = [f"__text_{i}" for i in range(len(columns))]
        own = {o: s for o, s in specs.items() if tuple(s[0]) == columns}
        words = label_rows(df.select(*columns).distinct(), own).withColumnsRenamed(dict(zip(columns, keys)))
        same = F.lit(True)
        for c, k in zip(columns, keys):
            same = same & out[c].eqNullSafe(words[k])
        out = out.join(words, same, "left").drop(*keys)
    return out


def label_narrow(df: DataFrame, columns: Sequence[str], specs: Specs) -> DataFrame:
    """The named columns of ``df``, written once to the shared folder, with labels by ``label_distinct``."""
    return label_distinct(Scratch(df.sparkSession, "labels").save(df.select(*columns)), specs)


def count_labels(df: DataFrame, columns: Sequence[str], rs: RuleSet, none: str) -> DataFrame:
    """label, n: rows by label (``multi``: by each label), ``none`` for rows without one."""
    texts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    return summed_labels(label_rows(texts, {"__label": (columns, rs)}), rs, none)


def summed_labels(df: DataFrame, rs: RuleSet, none: str) -> DataFrame:
    """label, n of rows with ``__label`` and their number ``__n``."""
    label = F.coalesce("__label", F.lit(none))
    if rs.policy == "multi":
        label = F.explode(F.when(F.size("__label") > 0, F.col("__label")).otherwise(F.array(F.lit(none))))
    return df.select(label.alias("label"), "__n").groupBy("label").agg(F.sum("__n").alias("n"))

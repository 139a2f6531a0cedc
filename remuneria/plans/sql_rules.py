"""Rule sets written out as DuckDB SQL for the oracle.

Independent of the Spark compiler: literal keywords become ``contains``
calls (Spark uses one escaped regex per label), folded mode uses DuckDB's
``strip_accents``, regex mode ``regexp_matches``.
"""

from __future__ import annotations

from ..functions.rules import RuleSet


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _text(expr: str, mode: str) -> str:
    return f"strip_accents(lower({expr}))" if mode == "folded" else f"lower({expr})"


def _kw(k: str, mode: str) -> str:
    return f"strip_accents(lower({q(k)}))" if mode == "folded" else q(k.lower())


def match(exprs: list[str], keywords, mode: str) -> str:
    parts = []
    for e in exprs:
        t = _text(e, mode)
        if mode == "regex":
            parts.append(f"coalesce(regexp_matches({t}, {q('|'.join('(?:' + k + ')' for k in keywords))}), false)")
        else:
            parts.extend(f"coalesce(contains({t}, {_kw(k, mode)}), false)" for k in keywords)
    return "(" + " OR ".join(parts) + ")"


def case(exprs: str | list[str], rs: RuleSet) -> str:
    if isinstance(exprs, str):
        exprs = [exprs]
    hits = [(r.label, match(exprs, r.keywords, rs.mode)) for r in rs.rules]
    if rs.policy == "multi":
        items = ", ".join(f"CASE WHEN {m} THEN {q(lab)} END" for lab, m in hits)
        return f"list_filter([{items}], lambda x: x IS NOT NULL)"
    if rs.policy == "last":
        hits = list(reversed(hits))
    default = "NULL" if rs.default is None else q(rs.default)
    if rs.exact:
        key = f"trim({_text(exprs[0], rs.mode)})"
        lookup = " ".join(f"WHEN {key} = {q(k)} THEN {q(v)}" for k, v in rs.exact.items())
        default = f"CASE {lookup} ELSE {default} END"
    whens = " ".join(f"WHEN {m} THEN {q(lab)}" for lab, m in hits)
    return f"CASE {whens} ELSE {default} END"


def any_of(expr: str, words, mode: str = "contains") -> str:
    return match([expr], words, mode)


def in_list(expr: str, values) -> str:
    return f"{expr} IN ({', '.join(q(v) for v in values)})"

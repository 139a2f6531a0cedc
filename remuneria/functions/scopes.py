"""Row scopes used before the quartile tables (survey R11, R15, R16, R18, R19, C8).

Each returns one boolean Column; all lists are parameters, the study's
values are the defaults in ``rulesets``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rulesets as RS
from .rules import matches
from .text import _c


def in_names(col: Column | str, names: Sequence[str], case_insensitive: bool = True) -> Column:
    """Membership in a literal list. The study compares raw-case
    literals with title-cased names (so some never match); we compare
    case-insensitively by default."""
    c = _c(col)
    if case_insensitive:
        return F.coalesce(F.lower(c).isin([n.lower() for n in names]), F.lit(False))
    return F.coalesce(c.isin(list(names)), F.lit(False))


def junior_scope(role: Column | str, salary: Column | str,
                 regex: str = RS.JUNIOR_REGEX,
                 excluded_titles: Sequence[str] = tuple(RS.JUNIOR_EXCLUDED_TITLES),
                 leadership: Sequence[str] = tuple(RS.LEADERSHIP_WORDS),
                 clear_junior: str = RS.CLEAR_JUNIOR_REGEX,
                 cap: float = RS.JUNIOR_SALARY_CAP) -> Column:
    """Junior-like title, minus fixed titles, minus leadership words
    unless the title clearly says junior, minus salary above the cap (a
    NULL salary is kept)."""
    r = _c(role)
    low = F.lower(r)
    base = F.coalesce(low.rlike(regex), F.lit(False))
    excluded = F.coalesce(r.isin(list(excluded_titles)), F.lit(False))
    lead = matches([r], leadership, "contains") & ~F.coalesce(low.rlike(clear_junior), F.lit(False))
    too_high = F.coalesce(_c(salary) > F.lit(cap), F.lit(False))
    return base & ~excluded & ~lead & ~too_high


def any_scope(company: Column | str, sector: Column | str, role: Column | str | None,
              companies: Sequence[str], sector_regex: str,
              role_words: Sequence[str] = ()) -> Column:
    """Company in a list OR sector matches a regex OR (optionally)
    role holds one of the words."""
    s = in_names(company, companies) | F.coalesce(_c(sector).rlike(sector_regex), F.lit(False))
    if role is not None and role_words:
        s = s | matches([_c(role)], role_words, "regex")
    return s


def rescaled(df, salary: str = "salario_promedio", role: str = "puesto", floor: float = 2000.0,
             trainee: str = RS.TRAINEE_HINT, professional: str = RS.PROFESSIONAL_HINT,
             cols: Sequence[str] = ("salario_minimo", "salario_maximo", "salario_promedio")):
    """Multiply min/max/avg by 10 where avg < floor on a professional,
    non-trainee role; adds a ``rescaled`` flag (the study prints each one)."""
    low = F.lower(F.col(role))
    cond = F.coalesce((F.col(salary) < floor) & ~F.isnan(F.col(salary).cast("double")) & ~F.coalesce(low.rlike(trainee), F.lit(False))
                      & F.coalesce(low.rlike(professional), F.lit(False)), F.lit(False))
    return df.withColumns({**{c: F.when(cond, F.col(c) * 10).otherwise(F.col(c)) for c in cols},
                           "rescaled": cond})

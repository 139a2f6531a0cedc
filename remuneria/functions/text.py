"""Scalar column functions (survey IDs C1-C21, C3/C4 salary text).

Every function maps Column -> Column and uses only built-in Spark
expressions, so the work stays inside whole-stage codegen.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x: ColumnOrName, digits: int = 4) -> Column:
    """Half-up rounding of a published figure. (A deferred quantile spec
    carries the digits to where it is computed.)"""
    if not isinstance(x, (Column, str)):
        return x.with_digits(digits)
    return F.round(_c(x), digits)


# --------------------------------------------------------------------- C1
# A pandas-style "to number, junk -> null". A bare try_cast is not enough:
# Spark reads '1d' as 1.0 and 'nan' as NaN, where pandas gives null.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(x: ColumnOrName) -> Column:
    """Coerce to DOUBLE; text that is not a plain number becomes NULL."""
    s = _c(x).cast("string")
    return F.when(s.rlike(NUMERIC_TEXT), F.trim(s).try_cast("double"))


# --------------------------------------------------------------------- C2
_RUN = r"(\p{L}+|[^\p{L}]+)"


def title_case(x: ColumnOrName) -> Column:
    """Python ``str.title()``: every letter run starts upper-case, the
    rest lower-case; a letter after a digit or apostrophe starts a new run
    ("l'oreal" -> "L'Oreal", "beesb2b" -> "Beesb2B"). ``initcap`` differs."""
    runs = F.regexp_extract_all(_c(x), F.lit(_RUN), 1)
    cased = F.transform(
        runs, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, F.length(t)))))
    return F.when(_c(x).isNotNull(), F.array_join(cased, ""))


def clean_company(x: ColumnOrName) -> Column:
    """Trim + title-case."""
    return title_case(F.trim(_c(x)))


# --------------------------------------------------------------------- C7
def _stripped(text: str) -> str:
    """Canonical decomposition without combining marks (the Unicode rule)."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def _accent_table() -> tuple[str, str]:
    """Every lower-case letter of the basic plane that the rule maps to one
    other letter (Hangul syllables, which decompose without marks, aside)."""
    pairs = [(ch, _stripped(ch)) for ch in map(chr, [*range(0x80, 0xAC00), *range(0xF900, 0x10000)])
             if ch == ch.lower() and unicodedata.category(ch) != "Mn"]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENT_SRC, _ACCENT_DST = _accent_table()


def fold_text(text: str) -> str:
    """``fold`` of a Python string (for keywords)."""
    return _stripped(text.lower())


def fold(x: ColumnOrName) -> Column:
    """Lower case + strip accents (DIRECCIÓN -> direccion), composed or
    decomposed. Pure-ASCII text (most rows) skips the character table."""
    low = F.lower(_c(x))
    bare = F.regexp_replace(F.translate(low, _ACCENT_SRC, _ACCENT_DST), r"\p{Mn}", "")
    return F.when(low.rlike("^[\\x00-\\x7F]*$"), low).otherwise(bare)


# --------------------------------------------------------------------- C3/C4
# The salary patterns of the postings pages.
RANGE_LABEL = r"Rango salarial:\s*(S/[^.]+)"
MONEY_SPAN = r"S/\s*[\d,]+\.?\d*(?:\s*-\s*S/\s*[\d,]+\.?\d*)?"
RANGE_NUMBERS = r"(\d+\.?\d*)\s*-\s*(\d+\.?\d*)"
ONE_NUMBER = r"(\d+\.?\d*)"


STRICT_RANGE_LABEL = r"Rango salarial:\s*(" + MONEY_SPAN + ")"


def _with(x: Column, mark: str) -> Column:
    """The text if the mark, which a pattern asks for, is in it: others needn't be searched."""
    return F.when(x.contains(mark), x)


def salary_text(x: ColumnOrName, strict: bool = False) -> Column:
    """First "Rango salarial: S/..." up to the next '.', else the first
    S/ amount or S/ a - S/ b range; NULL when neither is present. The
    default keeps the study's behaviour ("S/3,600.00 - S/5,000.00" gives
    "S/3,600"); ``strict=True`` reads the whole labelled amount or range."""
    d = _c(x)
    labelled = F.nullif(F.trim(F.regexp_extract(_with(d, "Rango salarial:"), STRICT_RANGE_LABEL if strict else RANGE_LABEL, 1)), F.lit(""))
    span = F.nullif(F.trim(F.regexp_extract(_with(d, "S/"), MONEY_SPAN, 0)), F.lit(""))
    return F.coalesce(labelled, span)


def bare_salary(x: ColumnOrName) -> Column:
    """C4: salary text without 'S/', 'PEN' and thousands commas."""
    clean = _c(x)
    for token in ("S/", "PEN", ","):            # literal replaces, in this order
        clean = F.replace(clean, F.lit(token), F.lit(""))
    return F.trim(clean)


def salary_numbers(clean: Column) -> Column:
    """C4: the first range a - b and the first amount of a ``bare_salary``."""
    number = lambda x, pattern, i: F.nullif(F.regexp_extract(x, pattern, i), F.lit("")).cast("double")
    ranged = _with(clean, "-")
    return F.struct(number(ranged, RANGE_NUMBERS, 1).alias("lo"), number(ranged, RANGE_NUMBERS, 2).alias("hi"), number(clean, ONE_NUMBER, 1).alias("one"))


def salary_range(n: Column) -> Column:
    """C4: struct(min, max, avg) of ``salary_numbers``."""
    lo, hi, one = n["lo"], n["hi"], n["one"]
    has_range = lo.isNotNull() & hi.isNotNull()
    mn = F.when(has_range, lo).otherwise(one)
    mx = F.when(has_range, hi).otherwise(one)
    avg = F.when(has_range, (lo + hi) / 2).otherwise(one)
    return F.struct(mn.alias("min"), mx.alias("max"), avg.alias("avg"))


def parse_salary(x: ColumnOrName) -> Column:
    """C4: salary text -> struct(min, max, avg). Strips 'S/', 'PEN' and
    thousands commas; a range gives (a, b, (a+b)/2), a single amount gives
    (v, v, v), anything else NULLs."""
    return salary_range(salary_numbers(bare_salary(x)))


# --------------------------------------------------------------------- C5/C6
# Legal-suffix replacements of company slugs, applied in order.
SLUG_SUFFIXES = [
    ("-s-a-", " S.A."),
    ("-s.a.", " S.A."),
    ("-sac", " SAC"),
    ("-saa", " SAA"),
    ("-s-a-c-", " S.A.C."),
]


def slug_to_name(x: ColumnOrName, strict: bool = False) -> Column:
    """Url-decode, legal suffixes in order, '-' -> ' ', title case. The
    order is kept by default, so '-s-a-' wins over '-s-a-c-' as in the source
    data; ``strict=True`` tries the longer suffixes first."""
    s = F.try_url_decode(_c(x)) if hasattr(F, "try_url_decode") else F.url_decode(_c(x))
    order = sorted(SLUG_SUFFIXES, key=lambda kv: -len(kv[0])) if strict else SLUG_SUFFIXES
    for old, new in order:
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.replace(s, F.lit("-"), F.lit(" "))
    return title_case(s)


def url_quote(x: ColumnOrName) -> Column:
    """Percent-encode a slug (space as %20, not '+')."""
    return F.replace(F.url_encode(_c(x)), F.lit("+"), F.lit("%20"))


# --------------------------------------------------------------------- C9-C12
def valid_salary(x: ColumnOrName, min_value: float = 0.0) -> Column:
    """A number (not null, not NaN) strictly above ``min_value``."""
    return _c(x).isNotNull() & ~F.isnan(_c(x)) & (_c(x) > F.lit(min_value))


def cut(x: ColumnOrName, n: int) -> Column:
    """First n characters."""
    return F.substring(_c(x), 1, n)


# --------------------------------------------------------------------- C13-C15
# Spanish month abbreviations, January first.
SPANISH_MONTHS = ["ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "set", "oct", "nov", "dic"]


def spanish_date(x: ColumnOrName) -> Column:
    """ISO text -> 'dd-mmm-yyyy' with Spanish months; text that does not
    parse -> its first 10 characters; empty/NULL -> '—'."""
    s = _c(x).cast("string")
    ts = F.coalesce(F.try_to_timestamp(s), F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    months = F.array(*[F.lit(m) for m in SPANISH_MONTHS])
    pretty = F.concat(F.lpad(F.dayofmonth(ts).cast("string"), 2, "0"), F.lit("-"),
                      F.try_element_at(months, F.month(ts)), F.lit("-"), F.year(ts).cast("string"))
    return (F.when(s.isNull() | (s == ""), F.lit("—"))
            .when(ts.isNotNull(), pretty)
            .otherwise(F.substring(s, 1, 10)))


def atom_date(x: ColumnOrName, fallback: ColumnOrName) -> Column:
    """C14: date/timestamp -> RFC 3339 UTC text; midnight moves to 12:00;
    unparsable -> ``fallback`` (an as-of timestamp, never now())."""
    ts = F.coalesce(F.try_to_timestamp(_c(x).cast("string")), _c(fallback).cast("timestamp"))
    midnight = (F.hour(ts) == 0) & (F.minute(ts) == 0)
    ts = F.when(midnight, ts + F.expr("INTERVAL 12 HOURS")).otherwise(ts)
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def money_text(x: ColumnOrName) -> Column:
    """C15: 'S/ 1,234' (whole soles)."""
    return F.concat(F.lit("S/ "), F.format_number(_c(x).cast("double"), 0))


# --------------------------------------------------------------------- C16-C21
def word_count(x: ColumnOrName) -> Column:
    """Number of whitespace-separated words (NULL stays NULL)."""
    return F.size(F.filter(F.split(_c(x), r"\s+"), lambda t: t != ""))


def blank_to(x: ColumnOrName, placeholder: str) -> Column:
    """C17."""
    return F.coalesce(F.nullif(F.trim(_c(x)), F.lit("")), F.lit(placeholder))


def positive_int(x: ColumnOrName) -> Column:
    """Positive salary as a whole number, else NULL."""
    return F.when(_c(x) > 0, F.floor(_c(x)).cast("bigint"))


ACCENTED = "[áéíóúñ]"


def has_accent(x: ColumnOrName) -> Column:
    """C19."""
    return _c(x).rlike(ACCENTED)


def clamp(x: ColumnOrName, lo: float, hi: float) -> Column:
    """C20: max(lo, min(hi, x))."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x)))


def ordinal(x: ColumnOrName, mapping: dict[str, int]) -> Column:
    """Category -> ordinal via a literal map (unknown -> NULL)."""
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*kv), _c(x)) if kv else F.lit(None)

"""Tag-stack parser of page markup, as Column functions.

``tokens`` cuts a page in one pass into tags, whole scripts and styles,
comments and text runs. ``elements`` folds the tags over a stack of open
elements into the list of the wanted elements, nested as deep as they come: a
start tag is pushed; an end tag closes everything down to its latest open
element and is ignored without one; elements without content and ``<x/>`` close
at once; the page's end closes the rest.

Each element knows its content's tokens and, as elements are numbered in
document order, its descendants are one slice of the list. The stack is a small
Python fold over a page's tokens, in Arrow batches: the work is linear in the page.

A null page has null tokens and elements; an empty page has none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that have no content.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]

_QUOTED = r"""(?:"[^"]*+"|'[^']*+')"""
_TAG = rf"""</?[a-z][^>"']*+(?:{_QUOTED}[^>"']*+){{0,500}}+>|</?[a-z][^>]*+>"""
_RAW = r"<(?:script|style)\b[^>]*+>(?:[^<]++|<(?!/(?:script|style)\s*+>))*+(?:<[^>]*+>)?+"
MARKUP = rf"<!--(?:[^-]++|-(?!->))*+(?:-->)?+|{_RAW}|{_TAG}|<"
TOKEN = rf"(?is)[^<]++|{MARKUP}"

_CLOSED = "array<struct<ord:int,name:string,at:int,until:int,last:int>>"
_FIELDS = ["ord", "name", "at", "until", "last"]
_TYPES = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)", re.ASCII)
_NO_TAG = ("", "script", "style")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(html: Column) -> Column:
    """The page as an array of strings that together are the page."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def _mark(tag: str, wanted: frozenset[str]) -> tuple[str, str, bool]:
    """kind ('open', 'close', 'both', '' for none), name, is it wanted."""
    m = _NAME.match(tag)
    name = m[1].lower() if m else ""
    if name in _NO_TAG:
        return "", name, False
    kind = "close" if tag.startswith("</") else "both" if name in VOID or tag.endswith("/>") else "open"
    return kind, name, name in wanted


def _elements(marks: Iterable[tuple[int, tuple[str, str, bool]]], end: int) -> list[list]:
    """name, at, until, last of the wanted elements of one page, in document order."""
    out: list[list] = []
    stack: list[tuple[str, list | None]] = []
    depth: dict[str, int] = {}
    for at, (kind, name, wanted) in marks:
        if kind == "open":
            e = None
            if wanted:
                out.append(e := [name, at, end, None])
            stack.append((name, e))
            depth[name] = depth.get(name, 0) + 1
        elif kind == "close":
            while depth.get(name):
                opened, e = stack.pop()
                depth[opened] -= 1
                if e:
                    e[2] = at
                    e[3] = len(out)
                if opened == name:
                    break
        elif kind and wanted:
            out.append([name, at, at, len(out) + 1])
    for _, e in stack:
        if e:
            e[3] = len(out)
    return out


def elements(toks: Column, wanted: list[str]) -> Column:
    """The wanted elements in document order: ord, name, at (token of the start
    tag), until (token of the end), last (number after the last descendant)."""
    names = frozenset(wanted)

    def fold(pages: pa.Array) -> pa.Array:
        bounds = pages.offsets.to_numpy()
        values = pages.values
        tag = pc.and_(pc.starts_with(values, "<"), pc.ends_with(values, ">"))
        at = np.flatnonzero(tag.to_numpy(zero_copy_only=False))
        coded = values.take(pa.array(at)).dictionary_encode()
        kinds = [_mark(t, names) for t in coded.dictionary.to_pylist()]
        cuts, at, codes = np.searchsorted(at, bounds).tolist(), at.tolist(), coded.indices.to_pylist()
        bounds, present = bounds.tolist(), pages.is_valid().to_pylist()
        ends, found = [], []
        for i, there in enumerate(present):
            ends.append(len(found) if there else None)
            if there:
                marks = ((k - bounds[i], kinds[c]) for k, c in zip(at[cuts[i]:cuts[i + 1]], codes[cuts[i]:cuts[i + 1]]))
                found += [(n, *e) for n, e in enumerate(_elements(marks, bounds[i + 1] - bounds[i]))]
        columns = zip(*found) if found else [()] * len(_FIELDS)
        fields = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_FIELDS)
        return pa.ListArray.from_arrays(pa.array([*ends, len(found)], pa.int32()), fields)

    return F.arrow_udf(fold, _CLOSED)(toks)


def named(elems: Column, *names: str) -> Column:
    return F.filter(elems, lambda e: e["name"].isin(*names))


def _between(values: Column, first: Column, last: Column) -> Column:
    """values[first..last], by place: a slice would copy the whole array first."""
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda i: F.get(values, i)))


def inside(elems: Column, e: Column, *names: str) -> Column:
    """The descendants of ``e`` with one of the names."""
    below = F.coalesce(_between(elems, e["ord"] + 1, e["last"] - 1), F.array().cast(_CLOSED))
    return named(below, *names)


def content(toks: Column, e: Column) -> Column:
    """The text inside ``e``, tags, scripts and comments left out, entities as they stand."""
    inner = F.filter(_between(toks, e["at"] + 1, e["until"] - 1), lambda t: ~t.startswith("<") | (t == "<"))
    return F.coalesce(F.array_join(inner, ""), F.lit(""))


def start_tag(toks: Column, e: Column) -> Column:
    return F.get(toks, e["at"])

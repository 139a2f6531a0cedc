"""The extraction cascade of whole pages, read in Python (survey S8-S11).

``scan`` cuts each page once and gives its organisation, the part of the cascade
that wins and that part's entries, with the meaning that ``pages`` and ``markup``
give them on Columns, in Arrow batches: the work is linear in the page but for
what tables inside tables repeat.

JSON-LD is read by the ``json`` module. Where its text might differ from that of
VARIANT (``Odd``) nothing is guessed: the page is marked ``odd``, its JSON-LD is
left to the Columns, and only the later parts of the cascade are given.
"""

from __future__ import annotations

import gc
import itertools
import json
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markup as M

# Page patterns.
LD_JSON = "application/ld+json"
PAYLOAD_MARK = "self.__next_f.push"
PAYLOAD_PAIR = r'"title"\s*:\s*"([^"]+)"[^}]*?"salary_range"\s*:\s*"([^"]+)"'
UNIVERSITY = r'"universidad"\s*:\s*\{[^}]*"name"\s*:\s*"([^"]+)"'
CURRENCY = "S/"

#: Keys under which a JSON-LD object holds further objects, and how many levels down these are followed.
GRAPH_KEYS = ["@graph", "mainEntity", "itemListElement", "item"]
GRAPH_DEPTH = 5
#: Keys of an object's organisation, in order of trust.
ORGANIZATION_KEYS = ["publisher", "provider", "sourceOrganization", "about"]

# The named entities of page text.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
            ("&aacute;", "á"), ("&eacute;", "é"), ("&iacute;", "í"), ("&oacute;", "ó"), ("&uacute;", "ú"),
            ("&ntilde;", "ñ"), ("&Aacute;", "Á"), ("&Eacute;", "É"), ("&Iacute;", "Í"), ("&Oacute;", "Ó"),
            ("&Uacute;", "Ú"), ("&Ntilde;", "Ñ"), ("&amp;", "&")]
ENTITY = r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z]+);"

ENTRY = ["title", "text", "university", "begin", "end"]
_SCANNED = f"struct<odd:boolean,org:string,priority:int,entries:array<struct<{','.join(f'{f}:string' for f in ENTRY)}>>>"

_TYPES = [("odd", pa.bool_()), ("org", pa.string()), ("priority", pa.int32()),
          ("entries", pa.list_(pa.struct([(f, pa.string()) for f in ENTRY])))]

Entry = tuple[str | None, ...]


def _java(pattern: str) -> re.Pattern:
    """The pattern with the classes that it has in Spark."""
    return re.compile(pattern.replace(r"\b", r"(?u:\b)").replace(r"\z", r"\Z"), re.ASCII)


_ENTITY, _PAIR, _UNIVERSITY = map(_java, (ENTITY, PAYLOAD_PAIR, UNIVERSITY))
# a page but its first text: a tag, whole script or style, comment or lone '<', and the text after it
_PIECE = _java(rf"(?is)({M.MARKUP})([^<]*+)")
# what stands before a whole script, and the script
_SCRIPT = _java(rf"(?is)(?:[^<]++|(?!<script\b[^>]*+>)(?:{M.MARKUP}))*+({M.MARKUP})?+")
_OPENING = re.compile(r"<[^>]*>")
_CLOSING = _java(r"(?i)</script\s*>\z")
_TYPE = _java(r"""(?is)\stype\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_KNOWN = dict(ENTITIES)
_CELLS = ("td", "th")
_WANTED = frozenset(["table", "tr", *_CELLS])
_NO_MARK = ("", "", False)
_MARKS, _CHUNK = 100_000, 1000  # bounds: tags known by their text, pages whose entries are lists at once

# escapes of half characters and of control characters; characters that UTF-16 sorts elsewhere
_ODD_ESCAPE = re.compile(r"\\u(?:[dD][89a-fA-F]|00[01])")
_ODD_TEXT = re.compile("[\U00010000-\U0010ffff]")
_STRINGS = re.compile(r'"(?:[^"\\]|\\.)*+"', re.S)
_DEEP = 500


class Odd(Exception):
    """JSON that only VARIANT knows how to read or to write: half characters, very
    deep or long values; a number that is no short whole one, a list or an object
    where a string is read."""


class _Number:
    """A number that is no short whole one."""

    def __init__(self, digits: str):
        if len(digits) > _DEEP:
            raise Odd


def _object(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key twice")
    return found


def _constant(name: str) -> None:
    raise ValueError(name)


_READ = json.JSONDecoder(object_pairs_hook=_object, parse_float=_Number, parse_constant=_constant,
                         parse_int=lambda digits: int(digits) if len(digits) < 18 else _Number(digits)).raw_decode
# a number has nothing that UNIVERSITY looks at
_WRITE = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), check_circular=False, default=lambda _: 0).encode


def _character(m: re.Match) -> str:
    name = m[0]
    if name[1] != "#":
        return _KNOWN.get(name, name)
    n = int(name[3:-1], 16) if name[2] in "xX" else int(name[2:-1])
    return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else "\ufffd"


def unescape(text: str) -> str:
    """Named and numeric entities to characters, unknown names left alone."""
    return _ENTITY.sub(_character, text) if "&" in text else text


def _string(v: object) -> str | None:
    if v is None or type(v) is str:
        return v
    if type(v) is bool:
        return "true" if v else "false"
    if type(v) is int:
        return str(v)
    raise Odd


def _as_list(v: object) -> list:
    return v if type(v) is list else [] if v is None else [v]


def _is(item: object, name: str) -> bool:
    kind = item.get("@type") if type(item) is dict else None
    return kind == name if type(kind) is str else type(kind) is list and name in kind


def _depth(block: str) -> int:
    steps = (1 if c in "[{" else -1 for c in _STRINGS.sub("", block) if c in "[{]}")
    return max(itertools.accumulate(steps), default=0)


def _is_odd(block: str) -> bool:
    return bool("\\u" in block and _ODD_ESCAPE.search(block) or not block.isascii() and _ODD_TEXT.search(block)
                or block.count("[") + block.count("{") > _DEEP and _depth(block) > _DEEP)


def _items(blocks: Iterable[str]) -> list:
    """Every JSON-LD value of the blocks, those that they hold after them, level by level."""
    level = []
    for block in blocks:
        if _is_odd(block):
            raise Odd
        try:
            outer = _READ(f"[{block}]")[0]
        except ValueError:
            continue
        if len(outer) == 1:
            level += _as_list(outer[0])
    items = [*level]
    for _ in range(GRAPH_DEPTH):
        level = [x for v in level if type(v) is dict for k in GRAPH_KEYS if k in v for x in _as_list(v[k])]
        items += level
    return items


def _organization(items: list) -> str | None:
    """The name of the last Organization, else of the last that an item names."""
    own = next((v for v in reversed(items) if _is(v, "Organization")), None)
    if own is None:
        named = (x for v in reversed(items) if type(v) is dict for k in ORGANIZATION_KEYS for x in reversed(_as_list(v.get(k))))
        own = next((x for x in named if _is(x, "Organization")), None)
    return own and _string(own.get("name"))


def _jobs(items: list, universities: bool) -> list[Entry]:
    out = []
    for v in items:
        if _is(v, "JobPosting") and (title := _string(v.get("title"))):
            at = _UNIVERSITY.search(_WRITE(v)) if universities else None
            out.append((title, _string(v.get("description")), at[1] if at else "", _string(v.get("datePosted")), _string(v.get("validThrough"))))
    return out


def _jsonld(scripts: list[str]) -> tuple[str | None, list[Entry]]:
    blocks = []
    for s in scripts:
        opening = _OPENING.match(s)
        kind = _TYPE.search(opening[0])
        if kind and unescape(kind[1] or kind[2] or kind[3] or "") == LD_JSON:
            end = s.rfind("<", opening.end())
            blocks.append(s[opening.end():end if end > 0 and _CLOSING.match(s, end) else None])
    items = _items(blocks)
    return _organization(items), _jobs(items, any("universidad" in b or "\\u" in b for b in blocks))


def _payload(scripts: list[str]) -> list[Entry]:
    return [(*pair, None, None, None) for s in scripts if PAYLOAD_MARK in s for pair in _PAIR.findall(s)]


class _Marks(dict):
    """``M._mark`` of each tag met."""

    def __missing__(self, tag: str) -> tuple[str, str, bool]:
        if len(self) > _MARKS:
            self.clear()
        self[tag] = mark = M._mark(tag, _WANTED) if tag[-1] == ">" else ("", "", False)
        return mark


def _tables(pieces: list[tuple[str, str]], marks: _Marks) -> list[Entry]:
    tags, after = zip(*pieces)
    if "<" in tags:
        after = [text if tag != "<" else tag + text for tag, text in pieces]
    elems = M._elements(enumerate(map(marks.__getitem__, tags)), len(tags))
    entries: dict[int, Entry | None] = {}

    def text(e: list) -> str:
        return unescape("".join(after[e[1]:e[2]])).strip(" ")

    def entry(row: int) -> Entry | None:
        first = None
        for at in range(row + 1, elems[row][3]):
            e = elems[at]
            if e[0] in _CELLS:
                if first:
                    if CURRENCY in (pay := text(e)) and (title := text(first)):
                        return title, pay, None, None, None
                    return None
                first = e
        return None

    out = []
    for i, e in enumerate(elems):
        if e[0] == "table":
            rows = [j for j in range(i + 1, e[3]) if elems[j][0] == "tr"]
            for row in rows[1:]:
                if row not in entries:
                    entries[row] = entry(row)
                if entries[row]:
                    out.append(entries[row])
    return out


def _page(html: str, marks: _Marks) -> tuple[bool, str | None, int | None, list[Entry]]:
    """odd, organisation, the part that wins (None if none does), its entries."""
    low = html.lower()
    if "<script" not in low and "<table" not in low:
        return False, None, None, []
    scripts = [s for s in _SCRIPT.findall(html) if s] if "<script" in low else []
    try:
        (org, entries), odd = _jsonld(scripts), False
    except (Odd, RecursionError):
        (org, entries), odd = (None, []), True
    if entries:
        return odd, org, 1, entries
    if entries := _payload(scripts):
        return odd, org, 2, entries
    entries = _tables(_PIECE.findall(html, html.find("<")), marks) if "<table" in low else []
    return odd, org, 3 if entries else None, entries


def _chunk(pages: pa.Array, marks: _Marks) -> pa.Array:
    heads, ends, entries = [], [], []
    for html in pages.to_pylist():
        *head, found = _page(html.decode("utf-8", "replace"), marks) if html else (False, None, None, [])
        heads.append(head)
        ends.append(len(entries) if found else None)
        entries += found
    columns = list(zip(*entries)) or [()] * len(ENTRY)
    listed = pa.ListArray.from_arrays(pa.array([*ends, len(entries)], pa.int32()),
                                      pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=ENTRY))
    fields = [pa.array(c, t) for c, t in zip(zip(*heads), (pa.bool_(), pa.string(), pa.int32()))]
    return pa.StructArray.from_arrays([*fields, listed], names=["odd", "org", "priority", "entries"])


def _batch(pages: pa.Array) -> pa.Array:
    marks = _Marks()
    pages = pages.cast(pa.binary())
    collects = gc.isenabled()
    gc.disable()  # what is read here is trees, freed without it
    try:
        chunks = [_chunk(pages[i:i + _CHUNK], marks) for i in range(0, len(pages), _CHUNK)]
    finally:
        if collects:
            gc.enable()
    return pa.concat_arrays(chunks) if chunks else pa.array([], pa.struct(_TYPES))


def scan(html: Column) -> Column:
    """struct(odd, org, priority, entries) of each page; a page without entries has neither priority nor entries."""
    return F.arrow_udf(_batch, _SCANNED)(html)

"""Pages -> rows (survey S8-S14, R29, A38, U4, C3-C6).

The study parses one fetched page at a time. Here the same extraction is a
Spark job over a table of already-fetched pages ``(page_id, url, html)``: one
pass cuts a page into tokens, a fold with a stack finds its elements
(``markup``), JSON-LD blocks are VARIANT values routed by path. The cascade
reads whole pages in Arrow batches (``scan``) and chooses the part that wins
before one ``explode``. The ``html`` column never travels through a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rulesets as RS
from ..functions import text as X
from ..operators.rank import dedup_first
from ..session import Scratch
from . import markup as M
from .scan import ENTITIES, ENTITY, GRAPH_DEPTH, GRAPH_KEYS, LD_JSON, ORGANIZATION_KEYS, UNIVERSITY, scan

# Page patterns (what the cascade reads stands in ``scan``).
TAG = r"<[^>]+>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
TITLE_NAME = r"Salarios en (.+?)(?:\s*[-|])"
COMPANY_PATH = r"/empresa/([^/?#\"']+)"
SITEMAP_LOC = r"<loc>https?://(?:www\.)?[^/<]+/empresa/([^<]+)</loc>"

#: The same as paths.
GRAPH_PATHS = [f"$['{k}']" for k in GRAPH_KEYS]
ORGANIZATION_PATHS = [f"$['{k}']" for k in ORGANIZATION_KEYS]
#: The elements that the extraction reads.
ELEMENTS = ["table", "tr", "td", "th", "select", "datalist", "option", "a"]


def _code_point(n: Column) -> Column:
    """The character of a code point, through its UTF-32 bytes."""
    ok = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))


def unescape_html(x: Column) -> Column:
    """Named and numeric entities to characters; unknown names and a text without '&' are left alone."""
    known = F.expr("map(" + ", ".join(f"""r"{k}", r{chr(39) + v + chr(39) if v != chr(39) else chr(34) + v + chr(34)}""" for k, v in ENTITIES) + ")")

    def one(m: Column) -> Column:
        digits = F.substring(m, 3, F.length(m) - 3)
        value = F.when(digits.rlike("^[xX]"), F.conv(F.substring(digits, 2, F.length(digits)), 16, 10)).otherwise(digits)
        return F.when(m.startswith("&#"), _code_point(value.cast("bigint"))).otherwise(F.coalesce(F.element_at(known, m), m))

    # the text between entities, and the entities, interleaved
    def joined(found: Column) -> Column:
        return F.array_join(F.transform(F.split(x, ENTITY, -1), lambda t, i: F.concat(t, F.coalesce(one(F.get(found, i)), F.lit("")))), "")

    return F.when(x.contains("&"), M.let(F.regexp_extract_all(x, F.lit(ENTITY), 0), joined)).otherwise(x)


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a start tag, in double, single or no quotes; null when absent."""
    m = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, m, i) for i in (1, 2, 3)])
    return F.when(tag.rlike(m), M.let(value, unescape_html))


def _cut(pages: DataFrame, *more: str) -> DataFrame:
    """page_id, url (if there), ``more``, toks: each page cut into tokens once."""
    kept = [c for c in ("page_id", "url", *more) if c in pages.columns]
    # never false, but not deterministic: a filter on what is extracted isn't
    # moved below, where it would repeat the extraction
    once = F.monotonically_increasing_id() >= 0
    return pages.select(*kept, F.when(once, M.tokens(F.col("html"))).alias("toks"))


def parsed(pages: DataFrame, *more: str) -> DataFrame:
    """page_id, url (if there), toks, elems: each page cut into tokens and
    folded into elements once; what follows reads these."""
    return _cut(pages, *more).withColumn("elems", M.elements(F.col("toks"), ELEMENTS))


def _scripts(toks: Column) -> Column:
    return F.filter(toks, lambda t: t.rlike(r"^(?i)<script\b"))


def _script_body(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"^<[^>]*>", ""), r"(?i)</script\s*>\z", "")


def _parsed_json(block: Column) -> Column:
    """One JSON value as VARIANT; null if the text isn't exactly one."""
    return M.let(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), block, F.lit("]"))), "$", "array<variant>"),
                 lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))


def _as_list(v: Column, path: str = "$") -> Column:
    """The values at a path: a list's items, else the one value, else none."""
    one = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"),
                      F.when(one.isNotNull() & ~F.is_variant_null(one), F.array(one)), F.array().cast("array<variant>"))


def _string(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def is_type(item: Column, name: str) -> Column:
    """``@type`` is the name or a list that holds it."""
    return F.coalesce(F.array_contains(F.try_variant_get(item, "$['@type']", "array<string>"), name),
                      _string(item, "$['@type']") == name, F.lit(False))


def jsonld_items(toks: Column, depth: int = GRAPH_DEPTH) -> Column:
    """Every JSON-LD object of a page as VARIANT. A block is any JSON
    value: an object, a list, an object that holds further objects under
    ``GRAPH_PATHS``; these follow the outer ones, ``depth`` levels down. What
    isn't JSON, or names a key twice, yields nothing."""
    blocks = F.filter(_scripts(toks), lambda t: _attribute(F.regexp_extract(t, r"^<[^>]*>", 0), "type") == LD_JSON)
    outer = F.flatten(F.transform(F.transform(blocks, lambda t: _parsed_json(_script_body(t))), lambda v: _as_list(v)))

    def with_parts(level: Column, left: int) -> Column:
        if not left:
            return level
        parts = F.flatten(F.transform(level, lambda v: F.concat(*[_as_list(v, p) for p in GRAPH_PATHS])))
        return F.concat(level, F.when(F.size(parts) > 0, M.let(parts, lambda p: with_parts(p, left - 1))).otherwise(
            F.array().cast("array<variant>")))

    return M.let(outer, lambda items: with_parts(items, depth))


def _entry(title: Column, text: Column, university: Column | None = None,
           begin: Column | None = None, end: Column | None = None) -> Column:
    """A posting as found on the page, its salary not yet parsed."""
    null = F.lit(None).cast("string")
    return F.struct(title.alias("title"), text.alias("text"), *[
        (null if c is None else c).alias(n) for n, c in (("university", university), ("begin", begin), ("end", end))])


def _with_salary(rows: DataFrame) -> DataFrame:
    """Rows of ``priority`` and entry ``e`` with the salary as columns (C4); a
    JSON-LD entry's stands in its description (C3). ``X.parse_salary`` step by
    step, so that each pattern is looked for once."""
    d = rows.withColumn("bare", X.bare_salary(F.when(F.col("priority") == 1, X.salary_text(F.col("e.text"))).otherwise(F.col("e.text"))))
    n = X.salary_numbers(F.col("bare"))
    d = d.withColumns({c: n[c] for c in ("lo", "hi", "one")})
    sal = X.salary_range(F.struct("lo", "hi", "one"))
    return d.withColumns({f"salario_{c}": sal[f] for c, f in (("minimo", "min"), ("maximo", "max"), ("promedio", "avg"))})


def jsonld_postings(items: Column) -> Column:
    """The entries of the JobPosting items with a title; the university is looked for at any depth."""
    jobs = F.filter(items, lambda x: is_type(x, "JobPosting") & (_string(x, "$.title") != ""))
    return F.transform(jobs, lambda x: _entry(
        _string(x, "$.title"), _string(x, "$.description"), F.regexp_extract(F.to_json(x), UNIVERSITY, 1),
        _string(x, "$.datePosted"), _string(x, "$.validThrough")))


def _last_name(items: Column) -> Column:
    """The name of the last Organization item, else of the last organisation
    that an item names under one of ``ORGANIZATION_PATHS``; null without one."""
    own = F.filter(items, lambda x: is_type(x, "Organization"))
    nested = F.filter(F.flatten(F.transform(items, lambda x: F.concat(*[_as_list(x, p) for p in reversed(ORGANIZATION_PATHS)]))),
                      lambda x: is_type(x, "Organization"))
    return _string(F.try_element_at(F.when(F.size(own) > 0, own).otherwise(nested), F.lit(-1)), "$.name")


def page_slug(url: Column | str) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    s = F.regexp_extract(u, COMPANY_PATH, 1)
    last = F.regexp_extract(u, r"^[a-z]+://[^/]+/(?:.*/)?([^/?#]+)/?(?:[?#].*)?$", 1)
    return F.coalesce(F.nullif(s, F.lit("")), F.nullif(last, F.lit("")))


def jsonld_types(pages: DataFrame) -> DataFrame:
    """Type, n: how many JSON-LD objects of the pages are of each type."""
    items = pages.select(jsonld_items(M.tokens(F.col("html"))).alias("items"))
    types = F.flatten(F.transform("items", lambda v: F.coalesce(
        F.try_variant_get(v, "$['@type']", "array<string>"), F.array(_string(v, "$['@type']")))))
    # an outer explode infers no filter, which would read the items twice
    return items.select(F.explode_outer(types).alias("type")).filter("type is not null").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def company_names(pages: DataFrame) -> DataFrame:
    """Name per page: the last Organization name, else the first
    hiringOrganization name, else the '<title>' pattern "Salarios en X -", else
    the slug made readable (C5)."""
    d = pages.select("page_id", "url", jsonld_items(M.tokens(F.col("html"))).alias("items"), page_slug("url").alias("slug"),
                     F.trim(F.regexp_extract(F.regexp_extract("html", TITLE, 1), TITLE_NAME, 1)).alias("from_title"))
    hiring = F.get(F.filter(F.transform("items", lambda x: _string(x, "$.hiringOrganization.name")), lambda n: n.isNotNull()), F.lit(0))
    name = F.coalesce(F.nullif(_last_name(F.col("items")), F.lit("")), F.nullif(hiring, F.lit("")),
                      F.nullif("from_title", F.lit("")), X.slug_to_name("slug"))
    return d.select("page_id", "url", "slug", name.alias("nombre"))


def cascade(pages: DataFrame) -> DataFrame:
    """S11 per page, before rows are written out: page_id, url, empresa,
    priority (1 JSON-LD, 2 payload, 3 tables, null none) and that part's entries:
    S9 the (title, salary_range) pairs of the inline framework payload; S10 every
    table, nested ones too: its rows but the first, first two cells, kept when the
    second holds the currency mark 'S/'. As in the study the rows of a table inside
    a table are rows of both. A later part is looked for only where the earlier
    ones have no posting; JSON-LD that ``scan`` leaves is read here."""
    # never false, but not deterministic: a filter on what is extracted isn't moved below, where it would repeat the extraction
    once = F.monotonically_increasing_id() >= 0
    d = pages.select("page_id", "url", F.when(once, F.col("html")).alias("html")).withColumn("x", scan(F.col("html")))
    d = d.withColumn("items", F.when(F.col("x.odd"), jsonld_items(M.tokens(F.col("html")))))
    d = d.select("page_id", "url", "x", _last_name(F.col("items")).alias("org"), jsonld_postings(F.col("items")).alias("ld"))
    left = F.coalesce(F.size("ld"), F.lit(0)) > 0
    org = F.when(F.col("x.odd"), F.col("org")).otherwise(F.col("x.org"))
    name = F.coalesce(F.nullif(org, F.lit("")), X.slug_to_name(page_slug("url")))
    return d.select("page_id", "url", name.alias("empresa"), F.when(left, 1).otherwise(F.col("x.priority")).alias("priority"),
                    F.when(left, F.col("ld")).otherwise(F.col("x.entries")).alias("entries"))


def extract_postings(pages: DataFrame, extracted: str | None = None) -> DataFrame:
    """The cascade per page: JSON-LD rows if any, else payload rows,
    else table rows (``priority`` 1 to 3, ``pos`` the row's place in its part).
    The company is the page's Organization, else its readable slug.
    ``extracted`` is the extraction stamp (a parameter, never the clock)."""
    # an outer explode infers no filter on the size of the entries
    d = cascade(pages).select("page_id", "priority", "url", "empresa", F.posexplode_outer("entries").alias("pos", "e"))
    d = _with_salary(d.filter("e is not null"))
    text = lambda c: F.nullif(F.col(f"e.{c}"), F.lit(""))
    return d.select("page_id", "priority", "pos", "empresa", F.col("e.title").alias("puesto"), "salario_minimo", "salario_maximo",
                    "salario_promedio", F.lit("PEN").alias("moneda"), text("university").alias("universidad_principal"),
                    F.col("url").alias("url_empresa"), text("begin").alias("fecha_inicio"), text("end").alias("fecha_fin"),
                    F.lit(extracted).cast("string").alias("fecha_extraccion"))


def sitemap_slugs(df: DataFrame, text: str, pattern: str = SITEMAP_LOC) -> DataFrame:
    """Company slugs from sitemap text; blanks and the literal 'None'
    dropped."""
    s = df.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("slug"))
    s = s.select(F.trim("slug").alias("slug"))
    return s.filter((F.col("slug") != "") & (F.col("slug") != "None"))


def extract_links(pages: DataFrame, anchor_prefix: str = "/empresa/", min_options: int = 50,
                  min_anchors: int = 20, min_slug_len: int = 2, part_of: str | None = None) -> DataFrame:
    """S14 + U4: company links from <select> options and <datalist> options
    (each only when the list has more than ``min_options`` entries) and from
    anchors under ``anchor_prefix`` (only when a page has more than
    ``min_anchors``); one row per slug, the first method/page/position wins,
    slugs of ``min_slug_len`` chars or fewer dropped. A listing may run over
    several pages: the entries of those with the same ``part_of`` (a column) are
    counted together, each list with the lists at its place on the others."""
    d = parsed(pages, part_of) if part_of else parsed(pages)
    toks, elems = F.col("toks"), F.col("elems")
    text = lambda e: M.let(M.content(toks, e), lambda x: F.trim(unescape_html(x)))
    attr = lambda e, name: F.coalesce(_attribute(M.start_tag(toks, e), name), F.lit(""))

    def link(slug: Column, label: Column, method: int, at: Column) -> Column:
        return F.struct(slug.alias("slug"), label.alias("nombre"), F.lit(method).alias("method"), at.alias("at"))

    def option(o: Column, from_select: bool) -> Column:
        def made(value: Column) -> Column:
            bare = F.when(value.contains("/empresa/"), F.regexp_replace(F.replace(value, F.lit("/empresa/"), F.lit("")), "^/+|/+$", ""))
            label = text(o) if from_select else F.coalesce(F.nullif(text(o), F.lit("")), value)
            slug = F.coalesce(bare, value) if from_select else value
            shown = (label != "Escoge una empresa") & (value != "default") if from_select else value != "Escoge una empresa"
            return F.when(shown & (value != "") & (label != ""), link(slug, label, 0 if from_select else 1, o["at"]))

        return M.let(F.trim(attr(o, "value")), made)

    def enough(entries: Column, least: int) -> Column:
        return F.lit(True) if part_of else F.size(entries) > least

    def listed(method: int, nth: Column, n: Column, links: Column) -> Column:
        return F.struct(F.lit(method).alias("method"), nth.alias("nth"), n.alias("n"), links.alias("links"))

    def options(container: str, method: int) -> Column:
        lists = F.transform(M.named(elems, container), lambda c: M.inside(elems, c, "option"))
        # options without a value count too
        return F.transform(F.filter(lists, lambda os: enough(os, min_options)), lambda os, i: listed(
            method, i, F.size(os), F.transform(os, lambda o: option(o, container == "select"))))

    anchors = F.filter(F.transform(M.named(elems, "a"), lambda a: F.struct(a.alias("e"), attr(a, "href").alias("href"))),
                       lambda a: a["href"].contains(anchor_prefix))
    prefix = "^.*?" + _re_escape(anchor_prefix)
    linked = M.let(anchors, lambda found: F.when(enough(found, min_anchors), F.array(listed(2, F.lit(0), F.size(found), F.transform(found, lambda a: link(
        F.regexp_replace(F.regexp_replace(a["href"], prefix, ""), "^/+|/+$", ""), text(a["e"]), 2, a["e"]["at"]))))))
    found = F.concat(options("select", 0), options("datalist", 1), F.coalesce(linked, F.array().cast(
        "array<struct<method:int,nth:int,n:int,links:array<struct<slug:string,nombre:string,method:int,at:int>>>>")))
    if part_of:
        lists = Scratch(pages.sparkSession, "link-lists").save(
            d.select("page_id", F.col(part_of).alias("part_of"), F.explode_outer(found).alias("l")).filter("l is not null").select("page_id", "part_of", "l.*"))
        whole = lists.groupBy("part_of", "method", "nth").agg(F.sum("n").alias("total")).filter(
            F.col("total") > F.when(F.col("method") == 2, min_anchors).otherwise(min_options))
        same = [lists[c].eqNullSafe(whole[c]) for c in ("part_of", "method", "nth")]
        rows = lists.join(whole, same, "left_semi").select("page_id", F.explode_outer("links").alias("x"))
    else:
        rows = d.select("page_id", F.explode_outer(F.flatten(F.transform(found, lambda l: l["links"]))).alias("x"))
    rows = rows.filter("x is not null and x.slug <> '' and x.nombre <> ''")
    rows = rows.select("x.slug", "x.nombre", F.struct("x.method", "page_id", "x.at").alias("prio"))
    return dedup_first(rows, "slug", ["prio"], min_key_len=min_slug_len).select("slug", "nombre")


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def validity(pages: DataFrame, words=tuple(RS.PAY_PAGE_WORDS), pass_rate: float = RS.PAY_PAGE_PASS_RATE) -> DataFrame:
    """A page looks like a pay page when it has a table or mentions one
    of the words (case-insensitive except the currency mark); share of such
    pages and pass flag, over ALL pages (not a sample)."""
    h = F.col("html")
    ok = F.coalesce(h.rlike("(?i)<table"), F.lit(False))
    for w in words:
        ok = ok | (F.coalesce(h.contains(w), F.lit(False)) if w == "S/" else F.coalesce(F.lower(h).contains(w.lower()), F.lit(False)))
    agg = pages.agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(ok).alias("n_valid"))
    return agg.select("n_pages", "n_valid", F.round(F.try_divide(F.col("n_valid"), F.col("n_pages")) * 100, 4).alias("rate"),
                      (F.try_divide(F.col("n_valid"), F.col("n_pages")) >= pass_rate).alias("passes"))


def coverage(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Companies, rows, rows with salary; pages with / without rows.
    Per-page counts are one aggregation; distinct companies a second one."""
    per_page = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n"), F.count("salario_promedio").alias("_s"))
    companies = rows.agg(F.count_distinct("empresa")).scalar()
    ok = pages.select("page_id").join(per_page, "page_id", "left")
    return ok.agg(
        F.count_if(F.col("_n") > 0).alias("pages_ok"), F.count_if(F.col("_n").isNull()).alias("pages_failed"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("_s"), F.lit(0)).alias("n_with_salary"),
    ).select("pages_ok", "pages_failed", companies.alias("n_empresas"), "n_rows", "n_with_salary")


def page_coverage(pages: DataFrame) -> DataFrame:
    """A38 of the pages' own extraction, from one pass: ``coverage`` of
    ``extract_postings(pages)`` without writing its rows out."""
    d = cascade(pages).select("priority", "empresa", F.posexplode_outer("entries").alias("pos", "e"))
    # a page without entries is one row without a position
    return _with_salary(d).withColumn("empresa", F.when(F.col("priority").isNotNull(), F.col("empresa"))).agg(
        F.count_if(F.col("pos") == 0).alias("pages_ok"), F.count_if(F.col("pos").isNull()).alias("pages_failed"),
        F.count_distinct("empresa").alias("n_empresas"), F.count("pos").alias("n_rows"), F.count("salario_promedio").alias("n_with_salary"))

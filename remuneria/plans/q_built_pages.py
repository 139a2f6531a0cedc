"""Page extraction on pages built from the driver tables (survey S8-S11 S13
S14 R29 A38), on top of the given ``pages``.

Each supplier is a company; all its line items of one range of ``RANGE``
orders are the entries of one page, so pages grow in number and stay bounded.
The kind of page follows supplier and range: JSON-LD blocks, an inline payload
beside a table, a table alone, no data, a JSON-LD graph with lists of types and
nested items, a table inside a table. The oracles compute the expected rows
from the tables themselves, without any page.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import bindings as B
from ..sources import pages as PG
from .registry import query

URL = "https://www.site.example/empresa/"


RANGE = 4096
KINDS = 6
_PAGE = 1 << 32


def _entries(spark, sf):
    li, pa = B.table(spark, sf, "lineitem"), B.table(spark, sf, "part")
    return li.join(pa, li["l_partkey"] == pa["p_partkey"]).select(
        F.col("l_suppkey").cast("long").alias("k"), F.expr(f"l_orderkey div {RANGE}").alias("block"),
        F.struct("l_orderkey", "l_linenumber", "p_name", F.floor("l_extendedprice").cast("long").alias("pay")).alias("e"))


def built_pages(spark, sf):
    """page_id, url, html: a page for each supplier and range of orders."""
    su = B.table(spark, sf, "supplier")
    e = _entries(spark, sf).groupBy("k", "block").agg(F.sort_array(F.collect_list("e")).alias("es"))
    d = e.join(su, e["k"] == su["s_suppkey"])
    each = lambda f: F.array_join(F.transform("es", f), "")
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    ld = lambda x: text('<script type="application/ld+json">', x, "</script>\n")
    name = F.regexp_replace("s_name", "#0*", " ")
    job = lambda x, kind, more: text('{"@type": ', kind, ', "title": "', x["p_name"], '", "description": "Buen puesto, paga S/ ',
                                     x["pay"], ' al mes", ', more, "}")
    blocks = text(ld(F.lit('{"@type": "Organization", "name": "Before"}')), ld(F.lit("{ not json")),
                  ld(text('{"@type": "Organization", "name": "', name, ' & Hijos"}')),
                  ld(text("[", F.array_join(F.transform("es", lambda x: job(x, '"JobPosting"', '"hiringOrganization": {"name": "Otra"}')), ", "),
                          ', {"@type": "JobPosting", "title": ""}]')))
    graph = ld(text('{"@context": "https://schema.example", "@graph": [{"@type": ["Thing", "Organization"], "name": "', name, ' y Grafo"}, 7, ',
                    '{"@type": "WebPage", "mainEntity": {"@type": "ItemList", "itemListElement": [', F.array_join(F.transform("es", lambda x: text(
                        '{"@type": "ListItem", "item": ', job(x, '["Thing", "JobPosting"]', text(
                            '"educacion": {"universidad": {"name": "U. ', x["l_linenumber"], '"}}')), "}")), ", "), "]}}]}"))
    payload = text("<script>self.__next_f.push([1,'", each(lambda x: text(
        '{"title":"', x["p_name"], '","x":1,"salary_range":"S/ ', x["pay"], " - S/ ", x["pay"] + 1000, '"}')), "'])</script>\n")
    rows = lambda after: each(lambda x: text("<tr><td><b>", x["p_name"], "</b>", after, "</td><td>S/ ", x["pay"],
                                             "</td></tr><tr><td>sin pago</td><td>a convenir</td></tr>"))
    head = "<table><tr><th>Puesto</th><th>Salario</th></tr>"
    table = text(head, rows(" &amp; &#225;rea"), "</table>\n")
    nested = text("<table class='a>b'><tr><td>menu<ul><li>uno<li>dos</ul></td><td>", head, rows(""), "</table></td></tr></table>\n")
    title = F.when(F.col("k") % 8 == 3, text("<title>Salarios en ", name, " Total - Portal</title>")).otherwise(F.lit("<title>Empresa</title>"))
    kind = (F.col("k") + F.col("block")) % KINDS
    body = (F.when(kind == 0, blocks).when(kind == 1, text(payload, table)).when(kind == 2, table).when(kind == 4, graph)
            .when(kind == 5, nested).otherwise(F.lit("<p>nada</p>")))
    slug = F.lower(F.regexp_replace("s_name", "#0*", "-"))
    return d.select((F.col("k") * _PAGE + F.col("block")).alias("page_id"), text(URL, slug, "-sac").alias("url"),
                    text("<html>", title, body, "</html>").alias("html"))


# pages and expected rows; the readable slug is the title case of 'supplier-12-sac'
_P = f"""p AS (
  SELECT DISTINCT l_suppkey::BIGINT * {_PAGE} + l_orderkey // {RANGE} AS page_id, l_suppkey AS k,
         (l_suppkey + l_orderkey // {RANGE}) % {KINDS} AS kind, regexp_replace(s_name, '#0*', ' ') AS name
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
_E = f"""{_P}, rows AS (
  SELECT page_id, CASE kind WHEN 0 THEN 1 WHEN 4 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS priority,
         CASE kind WHEN 0 THEN name || ' & Hijos' WHEN 4 THEN name || ' y Grafo' ELSE name || ' Sac' END AS empresa,
         CASE kind WHEN 2 THEN p_name || ' & área' ELSE p_name END AS puesto, floor(l_extendedprice)::BIGINT AS lo,
         floor(l_extendedprice)::BIGINT + CASE kind WHEN 1 THEN 1000 ELSE 0 END AS hi,
         CASE kind WHEN 4 THEN 'U. ' || l_linenumber END AS universidad
  FROM p JOIN lineitem ON page_id = l_suppkey::BIGINT * {_PAGE} + l_orderkey // {RANGE} JOIN part ON l_partkey = p_partkey
  CROSS JOIN (VALUES (1), (2)) AS copy(n)   -- rows of the inner table are rows of both
  WHERE kind <> 3 AND (n = 1 OR kind = 5))"""


@query("built_pages_cascade", "S8 S9 S10 S11 C3 C4 C5", f"""WITH {_E}
SELECT page_id, priority::INTEGER AS priority, empresa, puesto, lo::DOUBLE AS salario_minimo, hi::DOUBLE AS salario_maximo,
       (lo + hi) / 2.0 AS salario_promedio, universidad AS universidad_principal, '2024-01-31' AS fecha_extraccion FROM rows""")
def built_pages_cascade(spark, sf):
    p = PG.extract_postings(built_pages(spark, sf), extracted="2024-01-31")
    return p.select("page_id", "priority", "empresa", "puesto", "salario_minimo", "salario_maximo", "salario_promedio",
                    "universidad_principal", "fecha_extraccion")


@query("built_pages_names", "S13 C5", f"""WITH {_P}
SELECT page_id, CASE WHEN kind = 0 THEN name || ' & Hijos' WHEN kind = 4 THEN name || ' y Grafo'
                     WHEN k % 8 = 3 THEN name || ' Total' ELSE name || ' Sac' END AS nombre FROM p""")
def built_pages_names(spark, sf):
    return PG.company_names(built_pages(spark, sf)).select("page_id", "nombre")


@query("built_pages_types", "S8", f"""WITH {_E},
t AS (SELECT 'JobPosting' AS type, count_if(priority = 1) + (SELECT count(*) FROM p WHERE kind = 0) AS n FROM rows
      UNION ALL SELECT 'Organization', 2 * count_if(kind = 0) + count_if(kind = 4) FROM p
      UNION ALL SELECT unnest(['WebPage', 'ItemList']), count_if(kind = 4) FROM p
      UNION ALL SELECT 'ListItem', count_if(universidad IS NOT NULL) FROM rows
      UNION ALL SELECT 'Thing', (SELECT count_if(universidad IS NOT NULL) FROM rows) + count_if(kind = 4) FROM p)
SELECT type, n::BIGINT AS n FROM t WHERE n > 0""")
def built_pages_types(spark, sf):
    return PG.jsonld_types(built_pages(spark, sf))


@query("built_pages_coverage", "A38", f"""WITH {_E}
SELECT count(DISTINCT page_id) AS pages_ok, (SELECT count(*) FROM p) - count(DISTINCT page_id) AS pages_failed,
       count(DISTINCT empresa) AS n_empresas, count(*) AS n_rows, count(*) AS n_with_salary FROM rows""")
def built_pages_coverage(spark, sf):
    return PG.page_coverage(built_pages(spark, sf))


@query("built_pages_validity", "R29", f"""WITH {_P},
g AS (SELECT coalesce(regexp_matches(html, '(?i)<table'), false) OR contains(lower(html), 'salario') OR contains(html, 'S/')
             OR contains(lower(html), 'puesto') AS ok FROM pages
      UNION ALL SELECT kind <> 3 OR k % 8 = 3 FROM p),
v AS (SELECT count(*) AS n_pages, count_if(ok) AS n_valid FROM g)
SELECT n_pages, n_valid, round(n_valid * 100.0 / n_pages, 4) AS rate, n_valid * 1.0 / n_pages >= 0.6 AS passes FROM v""")
def built_pages_validity(spark, sf):
    given = B.table(spark, sf, "pages").select("page_id", "url", "html")
    return PG.validity(given.unionByName(built_pages(spark, sf)))


LINKS = 1000


def _link_pages(spark, sf):
    """A nation's listing, a page for each ``LINKS`` keys: a select list (some options without a value) of
    customers, single-quoted anchors of suppliers."""
    def keyed(name, p):
        t = B.table(spark, sf, name)
        return t.select(F.col(f"{p}_nationkey").cast("long").alias("nation"), F.expr(f"{p}_{name[:4]}key div {LINKS}").alias("range"),
                        F.lit(p).alias("p"), F.struct(F.col(f"{p}_{name[:4]}key").alias("key"), F.col(f"{p}_name").alias("name")).alias("x"))

    rows = keyed("supplier", "s").unionByName(keyed("customer", "c"))
    d = rows.groupBy("nation", "range").agg(*[F.sort_array(F.collect_list(F.when(F.col("p") == p, F.col("x")))).alias(p) for p in "sc"])
    anchors = F.array_join(F.transform("s", lambda x: F.concat(F.lit("<a class=x href='/empresa/s"), x["key"].cast("string"), F.lit("'><b>"), x["name"], F.lit("</b></a>"))), "")
    options = F.array_join(F.transform("c", lambda x: F.concat(F.lit("<option>x</option><option value='/empresa/c"), x["key"].cast("string"), F.lit("'>"), x["name"], F.lit(" &amp; Co</option>"))), "")
    return d.select((F.col("nation") * _PAGE + F.col("range")).alias("page_id"), "nation",
                    F.concat(F.lit("<select>"), options, F.lit("</select>"), anchors).alias("html"))


@query("built_pages_links", "S14 U4 C7", """
WITH c AS (SELECT c_custkey, c_name, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
s AS (SELECT s_suppkey, s_name, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT 'c' || c_custkey AS slug, c_name || ' & Co' AS nombre FROM c WHERE 2 * n > 50 AND c_custkey > 9
UNION ALL SELECT 's' || s_suppkey, s_name FROM s WHERE n > 3 AND s_suppkey > 9""")
def built_pages_links(spark, sf):
    return PG.extract_links(_link_pages(spark, sf), min_anchors=3, part_of="nation")

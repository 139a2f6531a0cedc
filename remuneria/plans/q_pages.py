"""Page and catalogue queries (survey S8-S15 R29 U2 U4 T4 A38 C3-C6 C19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import bindings as B
from ..sources import pages as PG
from .registry import query

# Binding parameters: the driver pages link to site paths ("/word"), not to
# "/empresa/<slug>", and carry about six links each.
ANCHOR_PREFIX = "/"
MIN_ANCHORS = 3
HREF_SLUG = r'href="/([^"]*)"'

_TITLE_SQL = ("list_aggregate(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)'), "
              "lambda t: upper(t[1]) || lower(t[2:])), 'string_agg', '')")
_SLUG_SQL = ("coalesce(nullif(regexp_extract(url, '/empresa/([^/?#\"'']+)', 1), ''), "
             "nullif(regexp_extract(url, '^[a-z]+://[^/]+/(?:.*/)?([^/?#]+)/?(?:[?#].*)?$', 1), ''))")


def _slug_name_sql(s):
    x = f"url_decode({s})"
    for old, new in T.SLUG_SUFFIXES:
        x = f"replace({x}, '{old}', '{new}')"
    x = f"replace({x}, '-', ' ')"
    return _TITLE_SQL.format(x=x)


@query("pages_title_name", "S13 C5 C6 C19", f"""
WITH s AS (SELECT page_id, {_SLUG_SQL} AS slug,
                  nullif(trim(regexp_extract(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),
                                             'Salarios en (.+?)(?:\\s*[-|])', 1)), '') AS from_title,
                  regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages)
SELECT page_id, slug, coalesce(from_title, {_slug_name_sql('slug')}) AS nombre, url_encode(slug) AS slug_encoded,
       regexp_matches(title, '[áéíóúñ]') AS title_has_accent FROM s""")
def pages_title_name(spark, sf):
    pages = B.table(spark, sf, "pages")
    names = PG.company_names(pages)
    acc = pages.select("page_id", T.has_accent(F.regexp_extract("html", PG.TITLE, 1)).alias("title_has_accent"))
    return names.join(acc, "page_id").select("page_id", "slug", "nombre", T.url_quote("slug").alias("slug_encoded"),
                                             "title_has_accent")


@query("pages_links", "S14 U4", f"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h,
                  regexp_extract_all(html, '(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS t FROM pages),
ex AS (SELECT page_id, unnest(h) AS href, unnest(t) AS txt, unnest(range(1, len(h) + 1)) AS pos FROM a),
f AS (SELECT * FROM ex WHERE contains(href, '{ANCHOR_PREFIX}')),
g AS (SELECT * FROM f WHERE page_id IN (SELECT page_id FROM f GROUP BY page_id HAVING count(*) > {MIN_ANCHORS})),
c AS (SELECT page_id, pos, regexp_replace(regexp_replace(href, '^.*?/', ''), '^/+|/+$', '', 'g') AS slug,
             trim(regexp_replace(txt, '<[^>]+>', '', 'g')) AS nombre FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id, pos) AS r FROM c
      WHERE slug <> '' AND nombre <> '' AND length(slug) > 2)
SELECT slug, nombre FROM k WHERE r = 1""")
def pages_links(spark, sf):
    return PG.extract_links(B.table(spark, sf, "pages"), anchor_prefix=ANCHOR_PREFIX, min_anchors=MIN_ANCHORS)


@query("pages_slugs", "S12", f"""
WITH s AS (SELECT trim(unnest(regexp_extract_all(html, '{HREF_SLUG}', 1))) AS slug FROM pages)
SELECT slug, count(*) AS n FROM s WHERE slug <> '' AND slug <> 'None' GROUP BY slug""")
def pages_slugs(spark, sf):
    s = PG.sitemap_slugs(B.table(spark, sf, "pages"), "html", HREF_SLUG)
    return s.groupBy("slug").agg(F.count(F.lit(1)).alias("n"))


@query("pages_validity_rate", "R29", """
WITH v AS (SELECT count(*) AS n_pages,
                  count_if(coalesce(regexp_matches(html, '(?i)<table'), false) OR contains(lower(html), 'salario')
                           OR contains(html, 'S/') OR contains(lower(html), 'puesto')) AS n_valid FROM pages)
SELECT n_pages, n_valid, round(n_valid * 100.0 / n_pages, 4) AS rate, n_valid * 1.0 / n_pages >= 0.6 AS passes FROM v""")
def pages_validity_rate(spark, sf):
    return PG.validity(B.table(spark, sf, "pages"))


# the given pages hold none of the cascade's blocks: the oracle says so by the blocks' own marks
@query("pages_jsonld_cascade", "S8 S9 S10 S11", """
SELECT page_id, 0::INTEGER AS priority, 0::INTEGER AS pos, '' AS empresa, '' AS puesto, 0::DOUBLE AS salario_minimo, 0::DOUBLE AS salario_maximo,
       0::DOUBLE AS salario_promedio, 'PEN' AS moneda, NULL::VARCHAR AS universidad_principal, url AS url_empresa,
       NULL::VARCHAR AS fecha_inicio, NULL::VARCHAR AS fecha_fin, NULL::VARCHAR AS fecha_extraccion
FROM pages WHERE regexp_matches(html, '(?i)ld\\+json') OR contains(html, 'self.__next_f.push') OR regexp_matches(html, '(?is)<table.*S/')""")
def pages_jsonld_cascade(spark, sf):
    return PG.extract_postings(B.table(spark, sf, "pages"))


@query("extraction_coverage", "A38", """
SELECT count_if(b) AS pages_ok, count_if(NOT b) AS pages_failed, 0::BIGINT AS n_empresas, 0::BIGINT AS n_rows, 0::BIGINT AS n_with_salary
FROM (SELECT coalesce(regexp_matches(html, '(?i)ld\\+json') OR contains(html, 'self.__next_f.push')
                      OR regexp_matches(html, '(?is)<table.*S/'), false) AS b FROM pages)""")
def extraction_coverage(spark, sf):
    return PG.page_coverage(B.table(spark, sf, "pages"))


_BUILT_TEXT = """CASE l_linenumber % 3
  WHEN 0 THEN 'Rango salarial: S/' || format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) || '.00 - S/'
              || format('{:,}', CAST(floor(l_extendedprice * 1.1) AS BIGINT)) || '.00. Otros datos'
  WHEN 1 THEN 'Sueldo S/ ' || format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) || ' - S/ '
              || format('{:,}', CAST(floor(l_extendedprice * 1.1) AS BIGINT)) || ' mensual'
  ELSE 'Pago S/ ' || format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) || ' al mes' END"""


def _built_text():
    a = F.format_number(F.floor("l_extendedprice").cast("bigint"), 0)
    b = F.format_number(F.floor(F.col("l_extendedprice") * 1.1).cast("bigint"), 0)
    k = F.col("l_linenumber") % 3
    return (F.when(k == 0, F.concat(F.lit("Rango salarial: S/"), a, F.lit(".00 - S/"), b, F.lit(".00. Otros datos")))
            .when(k == 1, F.concat(F.lit("Sueldo S/ "), a, F.lit(" - S/ "), b, F.lit(" mensual")))
            .otherwise(F.concat(F.lit("Pago S/ "), a, F.lit(" al mes"))))


@query("salary_text_parse", "C3 C4", f"""
WITH t AS (SELECT l_orderkey * 100 + l_linenumber AS posting_id, {_BUILT_TEXT} AS descripcion FROM lineitem),
s AS (SELECT posting_id, coalesce(nullif(trim(regexp_extract(descripcion, 'Rango salarial:\\s*(S/[^.]+)', 1)), ''),
                                  nullif(trim(regexp_extract(descripcion, 'S/\\s*[\\d,]+\\.?\\d*(?:\\s*-\\s*S/\\s*[\\d,]+\\.?\\d*)?', 0)), ''))
                         AS salario_texto FROM t),
c AS (SELECT *, trim(replace(replace(replace(salario_texto, 'S/', ''), 'PEN', ''), ',', '')) AS clean FROM s),
p AS (SELECT *, CAST(nullif(regexp_extract(clean, '(\\d+\\.?\\d*)\\s*-\\s*(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS lo,
             CAST(nullif(regexp_extract(clean, '(\\d+\\.?\\d*)\\s*-\\s*(\\d+\\.?\\d*)', 2), '') AS DOUBLE) AS hi,
             CAST(nullif(regexp_extract(clean, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS one FROM c)
SELECT posting_id, salario_texto,
       CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo ELSE one END AS salario_minimo,
       CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN hi ELSE one END AS salario_maximo,
       CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (lo + hi) / 2 ELSE one END AS salario_promedio FROM p""")
def salary_text_parse(spark, sf):
    li = B.table(spark, sf, "lineitem")
    t = li.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("posting_id"), _built_text().alias("d"))
    s = t.select("posting_id", T.salary_text("d").alias("salario_texto"))
    p = T.parse_salary("salario_texto")
    return s.select("posting_id", "salario_texto", p["min"].alias("salario_minimo"),
                    p["max"].alias("salario_maximo"), p["avg"].alias("salario_promedio"))


@query("catalog_union_sorted", "S15 U2 T4 C19", """
WITH c AS (SELECT lower(replace(s_name, '#', '-')) AS slug, s_name AS nombre FROM supplier
           UNION ALL SELECT lower(replace(c_name, '#', '-')), c_name FROM customer),
d AS (SELECT DISTINCT slug, nombre FROM c)
SELECT slug, nombre, 'https://example.org/empresa/' || slug AS url_completa,
       regexp_matches(slug, '[áéíóúñ]') AS has_accent FROM d""")
def catalog_union_sorted(spark, sf):
    su = B.table(spark, sf, "supplier").select(F.col("s_name").alias("nombre"))
    cu = B.table(spark, sf, "customer").select(F.col("c_name").alias("nombre"))
    cat = su.unionByName(cu).select(F.lower(F.replace("nombre", F.lit("#"), F.lit("-"))).alias("slug"), "nombre").distinct()
    return cat.select("slug", "nombre", F.concat(F.lit("https://example.org/empresa/"), "slug").alias("url_completa"),
                      T.has_accent("slug").alias("has_accent")).orderBy(F.lower("nombre"), "slug")


@query("documents_fold_accents", "C7 C16 C19", """
SELECT doc_id, lang, CAST(length(strip_accents(lower(text))) AS INTEGER) AS n_chars_folded,
       lower(text) <> strip_accents(lower(text)) AS has_accents,
       regexp_matches(text, '[áéíóúñ]') AS has_spanish_accent,
       md5(strip_accents(lower(text))) AS folded_md5 FROM documents""")
def documents_fold_accents(spark, sf):
    """Accent folding over whole document texts (C7), with the accent
    predicate (C19); the folded text is published as its md5."""
    d = B.table(spark, sf, "documents")
    folded = T.fold("text")
    return d.select("doc_id", "lang", F.length(folded).alias("n_chars_folded"),
                    (F.lower("text") != folded).alias("has_accents"),
                    T.has_accent("text").alias("has_spanish_accent"),
                    F.md5(folded).alias("folded_md5"))

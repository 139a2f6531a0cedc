"""Page extraction cascade on invented pages."""

import html.parser
import random

from pyspark.sql import functions as F

from remuneria.sources import markup as M
from remuneria.sources import pages as PG

ORG_AND_JOBS = """<html><head><title>Salarios en Banco Alfa - Portal</title>
<script type="application/ld+json">{"@type": "Organization", "name": "Banco Alfa S.A."}</script>
<script type="application/ld+json">[{"@type": "JobPosting", "title": "Analista de Datos",
 "description": "Buen puesto. Rango salarial: S/3,600.00 - S/5,000.00. Otros", "datePosted": "2026-03-01",
 "universidad": {"name": "U. Uno"}},
 {"@type": "JobPosting", "title": "Practicante", "description": "paga S/ 1,200 al mes"},
 {"@type": "JobPosting", "title": "", "description": "S/ 9"}]</script>
<script type="application/ld+json">{ not json </script></head><body></body></html>"""

PAYLOAD_AND_TABLE = """<html><head><title>Empresa</title>
<script>self.__next_f.push([1,"{"title":"Jefe de Planta","x":1,"salary_range":"S/ 8,000 - S/ 9,000"}"])</script>
</head><body><table><tr><th>Puesto</th><th>Salario</th></tr><tr><td>Operario</td><td>S/ 1,500</td></tr></table>
</body></html>"""

TABLE_ONLY = """<html><body><table><tr><th>Puesto</th><th>Salario</th></tr>
<tr><td><b>Operario</b></td><td>S/ 1,500</td></tr><tr><td>Sin sueldo</td><td>a convenir</td></tr>
<tr><td>Chofer</td><td>S/ 2,000 - S/ 2,400</td></tr></table></body></html>"""


def pages(spark):
    return spark.createDataFrame([
        (1, "https://site.pe/empresa/banco-alfa", ORG_AND_JOBS),
        (2, "https://site.pe/empresa/beta-s-a-", PAYLOAD_AND_TABLE),
        (3, "https://site.pe/empresa/gamma-sac", TABLE_ONLY),
        (4, "https://site.pe/empresa/vacia", "<html><p>nada</p></html>")], "page_id long, url string, html string")


def test_cascade(spark):
    got = sorted((r.page_id, r.priority, r.empresa, r.puesto, r.salario_minimo, r.salario_maximo, r.salario_promedio)
                 for r in PG.extract_postings(pages(spark)).collect())
    assert got == [
        (1, 1, "Banco Alfa S.A.", "Analista de Datos", 3600.0, 3600.0, 3600.0),   # stops at the first '.'
        (1, 1, "Banco Alfa S.A.", "Practicante", 1200.0, 1200.0, 1200.0),
        (2, 2, "Beta S.A.", "Jefe de Planta", 8000.0, 9000.0, 8500.0),             # payload wins over the table
        (3, 3, "Gamma Sac", "Chofer", 2000.0, 2400.0, 2200.0),
        (3, 3, "Gamma Sac", "Operario", 1500.0, 1500.0, 1500.0),
    ]


def test_company_names(spark):
    got = {r.page_id: r.nombre for r in PG.company_names(pages(spark)).collect()}
    assert got == {1: "Banco Alfa S.A.", 2: "Beta S.A.", 3: "Gamma Sac", 4: "Vacia"}


def test_sitemap_slugs(spark):
    xml = ("<urlset><url><loc>https://www.site.pe/empresa/a</loc></url><url><loc>https://site.pe/empresa/ </loc></url>"
           "<url><loc>https://site.pe/empresa/None</loc></url><url><loc>https://site.pe/empresa/b%C3%A1</loc></url></urlset>")
    df = spark.createDataFrame([(xml,)], "t string")
    assert [r.slug for r in PG.sitemap_slugs(df, "t").collect()] == ["a", "b%C3%A1"]


def test_links_gates_and_dedup(spark):
    opts = "".join(f'<option value="/empresa/s{i:03d}">Empresa {i}</option>' for i in range(60))
    anchors = "".join(f'<a href="/empresa/s{i:03d}">Otra {i}</a>' for i in range(25))
    few = "".join(f'<a href="/empresa/z{i}">Z</a>' for i in range(5))
    df = spark.createDataFrame([(1, f"<select>{opts}</select>{anchors}"), (2, few),
                                (3, '<select><option value="/empresa/ab">x</option></select>')], "page_id long, html string")
    got = {r.slug: r.nombre for r in PG.extract_links(df).collect()}
    assert len(got) == 60 and got["s001"] == "Empresa 1"       # option beats the anchor for the same slug
    assert not any(k.startswith("z") for k in got)              # 5 anchors <= 20: gated out


def test_validity_and_coverage(spark):
    p = pages(spark)
    v = PG.validity(p).first()
    assert (v.n_pages, v.n_valid, v.passes) == (4, 3, True)
    c = PG.coverage(PG.extract_postings(p), p).first()
    assert (c.pages_ok, c.pages_failed, c.n_rows, c.n_empresas) == (3, 1, 5, 3)


def test_last_organization_and_entities(spark):
    html = ("""<script type="application/ld+json">{"@type": "Organization", "name": "First"}</script>
<script type="application/ld+json">{"@type": "Organization", "name": "Last"}</script>
<table><tr><th>P</th></tr><tr><td>Fusiones &amp; Adq &#243;&#xF1; &lt;x&gt; &amp;lt;</td><td>S/ 5</td></tr></table>""")
    df = spark.createDataFrame([(1, "https://site.pe/empresa/a-b", html)], "page_id long, url string, html string")
    r = PG.extract_postings(df).first()
    assert (r.empresa, r.puesto) == ("Last", "Fusiones & Adq óñ <x> &lt;")


def test_single_quotes_and_options_without_value(spark):
    anchors = "".join(f"<a class=x href='/empresa/s{i:03d}'>E {i}</a>" for i in range(30))
    opts = "<option>none</option>" * 45 + "".join(f"<option value='/empresa/o{i}0'>O {i}</option>" for i in range(6))
    df = spark.createDataFrame([(1, anchors), (2, f"<select>{opts}</select>")], "page_id long, html string")
    got = {r.slug for r in PG.extract_links(df).collect()}
    assert got == {f"s{i:03d}" for i in range(30)} | {f"o{i}0" for i in range(6)}


def test_long_table(spark):
    rows = "".join(f"<tr><td>P{i}</td><td>S/ {i}</td></tr>" for i in range(1, 3000))
    df = spark.createDataFrame([(1, "https://s/empresa/x", f"<table><tr><th>h</th></tr>{rows}</table>")], "page_id long, url string, html string")
    assert PG.extract_postings(df).count() == 2999


def page(spark, html, url="https://s/empresa/x-sac"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def test_jsonld_of_any_shape(spark):
    html = """<script type='application/ld+json' id=a>{"@context": "x", "@graph": [
 {"@type": ["Thing", "Organization"], "name": "Grafo SA"},
 {"@type": "WebPage", "mainEntity": {"@type": "ItemList", "itemListElement": [
   {"@type": "ListItem", "item": {"@type": ["JobPosting"], "title": "Analista", "description": "S/ 100",
    "otros": {"universidad": {"tipo": 1, "name": "U. Dos"}}}},
   {"@type": "ListItem", "item": {"@type": "JobPosting", "title": 77, "description": null}}]}},
 5, null, "text", {"@type": "JobPosting", "title": ""}, {"@type": "JobPosting"}]}</script>
<script type="application/ld+json">{"a": 1}{"b": 2}</script><script type="application/ld+json"></script>
<script type="application/json">{"@type": "JobPosting", "title": "no"}</script>"""
    rows = PG.extract_postings(page(spark, html)).orderBy("pos").collect()
    assert [(r.empresa, r.puesto, r.salario_minimo, r.universidad_principal) for r in rows] == [
        ("Grafo SA", "Analista", 100.0, "U. Dos"), ("Grafo SA", "77", None, None)]


def test_nested_organization(spark):
    html = ("""<script type="application/ld+json">[{"@type": "WebSite", "publisher": {"@type": ["Organization"], "name": "Editora"}},
 {"@type": "JobPosting", "title": "T", "hiringOrganization": {"name": "Contrata"}}]</script>""")
    assert PG.extract_postings(page(spark, html)).first().empresa == "Editora"
    assert PG.company_names(page(spark, html)).first().nombre == "Editora"
    only_hiring = html.replace("publisher", "editor")
    assert PG.company_names(page(spark, only_hiring)).first().nombre == "Contrata"
    assert PG.extract_postings(page(spark, only_hiring)).first().empresa == "X Sac"


class Reader(html.parser.HTMLParser):
    """Elements by a stack, independently of the Spark fold: (name, text) in document order."""

    def __init__(self, text, wanted):
        super().__init__(convert_charrefs=False)
        self.stack, self.out, self.wanted = [], [], wanted
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in M.VOID and tag not in self.wanted:
            return
        e = [tag, ""]
        self.out.append(e)
        self.stack.append(e)
        if tag in M.VOID:
            self.stack.pop()

    def handle_startendtag(self, tag, attrs):
        self.out.append([tag, ""])

    def handle_endtag(self, tag):
        if tag in [e[0] for e in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def add(self, text):
        if not (self.stack and self.stack[-1][0] in ("script", "style")):
            for e in self.stack:
                e[1] += text

    handle_data = add
    handle_entityref = lambda self, name: self.add(f"&{name};")
    handle_charref = lambda self, name: self.add(f"&#{name};")


def test_elements_equal_a_stack(spark):
    rng = random.Random(8)
    tags = ["table", "tr", "td", "div", "p", "option", "a"]
    texts = []
    for n in [0, 1, 3, 10, 40, 40, 40, 200, 200, 3000]:
        parts = []
        for _ in range(n):
            t = rng.choice(tags)
            parts.append(rng.choice([f"<{t}>", f"<{t.upper()} class='a>b' x=\"c>\">", f"</{t}>", f"</{t} >", f"<{t}/>", "<br>", "x", " y ",
                                     "&amp;", "<!-- <td> -->", "<script>if (a<b) '<td>'</script>", "<style>td {}</style>", "\n"]))
        texts.append("".join(parts))
    wanted = ["table", "tr", "td", "option", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, html string").withColumn("toks", M.tokens(F.col("html")))
    df = df.withColumn("e", M.elements(F.col("toks"), wanted)).select(
        "i", F.array_join("toks", "").alias("whole"), F.transform("e", lambda e: F.struct("e", e["name"], M.content(F.col("toks"), e))).alias("c"),
        F.transform("e", lambda e: F.size(M.inside(F.col("e"), e, *wanted))).alias("below"))
    for r in df.collect():
        want = [e for e in Reader(texts[r.i], wanted).out if e[0] in wanted]
        assert r.whole == texts[r.i]
        assert [[c[1], c[2]] for c in r.c] == want
        assert all(0 <= b < len(want) for b in r.below)


def test_null_and_empty_pages(spark):
    df = spark.createDataFrame([(1, "https://s/empresa/a", None), (2, None, ""), (None, None, "<table><tr><td>")],
                               "page_id long, url string, html string")
    assert PG.extract_postings(df).count() == 0 and PG.extract_links(df).count() == 0
    c = PG.page_coverage(df).first()
    assert (c.pages_ok, c.pages_failed, c.n_empresas, c.n_rows) == (0, 3, 0, 0)


def test_nested_tables_and_unclosed_cells(spark):
    inner = "<table><tr><th>P</th><th>S</th></tr><tr><td>Chofer</td><td>S/ 10</td></tr><tr><td>Guía<td>S/ 20</table>"
    got = [(r.puesto, r.salario_minimo) for r in PG.extract_postings(
        page(spark, f"<table><tr><td>menu</td><td>{inner}</td></tr></table>")).orderBy("pos").collect()]
    # rows of the inner table are rows of both tables; an open cell holds what follows
    assert got == [("Chofer", 10.0), ("GuíaS/ 20", 20.0)] * 2


def test_coverage_of_one_pass(spark):
    p = pages(spark)
    assert PG.page_coverage(p).collect() == PG.coverage(PG.extract_postings(p), p).collect()


def test_pages_are_read_once(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    for build in (PG.extract_links, PG.extract_postings, PG.page_coverage):
        plan = build(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1


def test_datalist_options(spark):
    opts = "".join(f'<option value="{v}">' for v in ["Escoge una empresa", "default", ""] + [f"slug-{i}" for i in range(60)])
    got = {r.slug: r.nombre for r in PG.extract_links(page(spark, f"<datalist id=x>{opts}</datalist>")).collect()}
    assert len(got) == 61 and got["slug-3"] == "slug-3" and "default" in got


def test_salaries_parsed_once_and_no_fold_in_lambdas(spark):
    from remuneria.functions import text as X
    for build in (PG.extract_postings, PG.page_coverage):
        plan = build(pages(spark))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(X.RANGE_NUMBERS) <= 2          # one for each number
        assert "lambdafunction(named_struct(stack" not in plan and "ArrowEvalPython" in plan


def test_a_listing_over_several_pages_counts_as_one(spark):
    page = lambda lo, hi: "<select>" + "".join(f"<option value='/empresa/s{i:03d}'>E {i}</option>" for i in range(lo, hi)) + "</select>" + "".join(
        f"<a href='/empresa/a{i:03d}'>A {i}</a>" for i in range(lo, hi, 3))
    df = spark.createDataFrame([(1, "x", page(0, 40)), (2, "x", page(40, 70)), (3, "y", page(100, 130)), (4, None, page(200, 230)), (5, None, page(230, 260))],
                               "page_id long, site string, html string")
    got = {r.slug for r in PG.extract_links(df, part_of="site").collect()}
    assert got == {f"s{i:03d}" for i in [*range(70), *range(200, 260)]} | {f"a{i:03d}" for i in range(0, 40, 3)} | {f"a{i:03d}" for i in range(40, 70, 3)}
    assert PG.extract_links(df).count() == 0    # no page is long enough alone


def test_scan_reads_ordinary_pages_whole(spark):
    got = pages(spark).select("page_id", PG.scan(F.col("html")).alias("x")).orderBy("page_id").select("x.*").collect()
    assert [(r.odd, r.org, r.priority, r.entries and len(r.entries)) for r in got] == [
        (False, "Banco Alfa S.A.", 1, 2), (False, None, 2, 1), (False, None, 3, 2), (False, None, None, None)]
    table = pages(spark).filter("page_id = 3").unionByName(page(spark, None)).unionByName(page(spark, ""))
    assert [r.n for r in table.select(F.size(PG.scan(F.col("html"))["entries"]).alias("n")).collect()] == [2, None, None]


def test_jsonld_that_scan_leaves_is_read_by_columns(spark):
    job = '<script type="application/ld+json">{"@type": "JobPosting", "title": %s, "description": "S/ 9"}</script>' + TABLE_ONLY
    titles = {"7.50": "7.5", '{"b": 1, "a": "x"}': '{"a":"x","b":1}', "[1]": "[1]", "12345678901234567890": "12345678901234567890",
              '"x\\u0001"': "x\x01", "[" * 600 + "]" * 600: "[" * 600 + "]" * 600}
    df = spark.createDataFrame([(i, "https://s/empresa/x", job % t) for i, t in enumerate(titles)], "page_id long, url string, html string")
    assert all(r.odd for r in df.select(PG.scan(F.col("html"))["odd"].alias("odd")).collect())
    assert [(r.priority, r.puesto) for r in PG.extract_postings(df).orderBy("page_id").collect()] == [(1, t) for t in titles.values()]
    # neither an object with a key twice nor a half-read number hides the table
    for bad in ('"a", "title": "b"', "NaN", "01", '"raw\ttab"', "'a'"):
        assert {r.priority for r in PG.extract_postings(page(spark, job % bad)).collect()} == {3}


def test_scan_equals_columns(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(['"A \\u00e1"', '"B &amp; C"', '"x\\"y"', '""', "null", "5", "true", '"JobPosting"'] * 8 + ["2.5", '["u"]', '"😀"'])
    kind = lambda: rng.choice(['"JobPosting"', '["Thing", "JobPosting"]', '"Organization"', '["Organization", null]', "7", "null"])

    def item(depth):
        more = [f'"{rng.choice(["@graph", "mainEntity", "itemListElement", "item", "publisher", "about", "otro"])}": ' + (
            item(depth + 1) if rng.random() < 0.5 else f"[{item(depth + 1)}, 7, null, {item(depth + 1)}]")] if depth < 7 and rng.random() < 0.6 else []
        more += [f'"otros": {{"universidad": {{"z": 1.5, "name": {word()}}}}}'] if rng.random() < 0.3 else []
        return "{" + ", ".join([f'"@type": {kind()}', f'"title": {word()}', f'"name": {word()}', f'"description": {word()}', *more]) + "}"

    block = lambda: f"<{rng.choice(['script', 'SCRIPT'])} type='application/ld+json'>{item(0)}{rng.choice(['', '', '', '] x', ','])}</script>"
    texts = ["".join([block() for _ in range(rng.randint(1, 3))] + ["<!-- ", block(), "-->"]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").withColumn("x", PG.scan(F.col("html")))
    df = df.withColumn("items", PG.jsonld_items(M.tokens(F.col("html")))).select("x", PG._last_name(F.col("items")).alias("org"), PG.jsonld_postings(F.col("items")).alias("ld"))
    got = df.filter("not x.odd").collect()
    assert len(got) > 100 and any(r.ld for r in got)
    assert [(r.x.org, r.x.entries or []) for r in got] == [(r.org, r.ld) for r in got]


def test_only_whole_scripts_are_scripts(spark):
    ld = """<script type="application/ld+json">{"@type": "JobPosting", "title": "%s", "description": "S/ 1"}</script>"""
    html = "".join(["x < y", "<!--", ld % "comment", "-->", '<a title="', (ld % "attribute").replace('"', "'"), '">', "<style>", ld % "style", "</style>",
                    "<scripts>", ld % "yes", "</scripts>", (ld % "open").removesuffix("</script>")])
    # a style ends at the end of a script too, and an open script at the page's
    assert [r.puesto for r in PG.extract_postings(page(spark, html)).orderBy("pos").collect()] == ["yes", "open"]

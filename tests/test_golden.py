"""Hand-computed cases of the rules, band edges included."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusaudit.functions import dates as D
from corpusaudit.functions import html as H
from corpusaudit.functions import urls as U
from corpusaudit.functions.numbers import round_to
from corpusaudit.functions.text import decode_entities, title_case
from corpusaudit.operators import access, authority, cluster, entity, geo, jsonld, links, offpage, sitemap
from corpusaudit.plans.graph import breadth_first
from corpusaudit.sources import sitemaps
from corpusaudit.sources.pages import read_pages_csv

c = F.col


def column(spark, values, expr, kind="string"):
    """Values of an expression over one column ``x``, in input order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(c("x"))).collect()]


def test_normalize_and_resolve(spark):
    urls = ["HTTP://Ex.ORG/A/B/?x=1#y", "https://a.b", "https://a.b/x;p=1", "https://a.b//"]
    assert column(spark, urls, U.normalize_url) == ["http://ex.org/a/b", "https://a.b/", "https://a.b/x", "https://a.b/"]
    base = F.lit("https://a.b/c/d?q#f")
    hrefs = ["", "#z", "?k", "/x/../y", "//h/z", "e", "../e/./f/..", "mailto:m", "http://o/p", "../../../g"]
    want = ["https://a.b/c/d?q#f", "https://a.b/c/d?q#z", "https://a.b/c/d?k", "https://a.b/y", "https://h/z", "https://a.b/c/e",
            "https://a.b/e/", "mailto:m", "http://o/p", "https://a.b/g"]
    assert column(spark, hrefs, lambda x: U.resolve_url(base, x)) == want


def test_dynamic_segments(spark):
    cases = {"": True, "a" * 81: True, "123": True, "3f2504e0-4f89-11d3-9a0c-0305e82c3301": True, "abcdefghi": False, "abcdefghij": True,
             "abcdef1": False, "abcdef12": True, "produits": False, "deadbeef": True, "a_b_c_d_e_f_g": False}
    assert column(spark, list(cases), U.is_dynamic_segment) == list(cases.values())


def test_clean_title(spark):
    rows = [("Guide complet - Marque", "", "https://www.marque.fr/x", "Guide complet"), ("Marque | Nos offres", "", "https://marque.fr/x", "Nos offres"),
            ("abc", "", "https://marque.fr/fr/page-de_test", "Page De Test"), ("", "", "https://marque.fr/fr", "Accueil"),
            ("Titre ignoré ici", "Un titre h1 assez long", "https://marque.fr/", "Un titre h1 assez long"), ("x" * 40, "", "https://m.fr/", "x" * 40),
            ("x" * 41, "", "https://m.fr/", "x" * 40 + "..")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, h string, u string, w string").orderBy("i")
    got = df.select(H.clean_title(c("t"), c("h"), c("u")).alias("g"), "w").collect()
    assert [r.g for r in got] == [r.w for r in got]


def test_text_helpers(spark):
    assert column(spark, ["a &amp;lt; &eacute;&#233;&#xE9; & &zz;", None, "x"], decode_entities) == ["a &lt; ééé & &zz;", None, "x"]
    assert column(spark, ["l'eau-vive 3abc ÉTÉ"], title_case) == ["L'Eau-Vive 3Abc Été"]
    assert column(spark, [2.675, 65.35, 0.125, 1.005, -1.25], lambda x: round_to(x, 2), "double") == [round(x, 2) for x in (2.675, 65.35, 0.125, 1.005, -1.25)]


def test_markup_inside_scripts_is_not_counted(spark):
    page = "<h2>a</h2><script>var x='<h2>no</h2>';</script><!-- <h2>no</h2> --><style>h2{}</style><H2 class=x>b</H2><table><tr></table>"
    got = column(spark, [page, "", None], H.dom_structure)
    assert [(r.h2, r.table) for r in got] == [(2, 1), (0, 0), (0, 0)]


def test_meta_robots_and_spa(spark):
    m = column(spark, ['<meta content="NOINDEX" name="robots"><meta name="gptbot" content="none">', "<p>"], H.meta_robots)
    assert (m[0].noindex, m[0].indexable, m[0].ai_meta_tags) == (True, False, {"gptbot": "none"})
    assert (m[1].noindex, m[1].nofollow, m[1].meta_content, m[1].indexable) == (False, False, "", True)
    s = column(spark, ['<div id="root"></div><script src="/static/React.js"></script><script type="module" src="/_nuxt/e.js"></script>'
                       '<link rel="modulepreload" href="/a.js">'], H.spa_indicators)[0]
    assert [(x.type, x.signal) for x in s] == [("texte", "React (texte)"), ("texte", "Nuxt (texte)"), ("texte", "Nuxt (texte)"),
                                               ("texte", "React (div#root)"), ("script", "Framework JS"), ("script", "Nuxt"),
                                               ("link", "ES Module"), ("module", "1 script(s) ES module")]


def test_description_bands(spark):
    n = [0, 99, 100, 119, 120, 160, 161, 200, 201]
    text = [("mot%d " % 1)[:0] + "".join(chr(97 + i % 26) for i in range(k)) for k in n]
    got = [r.points for r in column(spark, text, geo.score_meta_description)]
    assert got == [0, 5, 9, 9, 12, 12, 9, 9, 5]
    repeated = column(spark, ["guide guide guide un deux", "a b c d e f g a b c"], geo.score_meta_description)
    assert [r.points for r in repeated] == [6, 3]
    assert [x.priority for x in repeated[0].recos] == ["HIGH", "LOW"]


def test_h1_time_and_freshness_bands(spark):
    assert [r.points for r in column(spark, ["", "a" * 39, "a" * 40, "a" * 70, "a" * 71, "Quoi ?"], geo.score_h1)] == [0, 6, 8, 8, 7, 8]
    assert [r.points for r in column(spark, [None, 0.49, 0.5, 0.99, 1.0, 1.99, 2.0], geo.score_response_time, "double")] == [10, 10, 7, 7, 4, 4, 1]
    days = ["2024-01-31", "2023-11-02", "2023-11-01", "2023-08-04", "2023-08-03", "2023-01-31", "2023-01-30", "junk", None]
    got = column(spark, days, lambda x: geo.score_freshness(x, "2024-01-31 00:00:00"))
    assert [r.points for r in got] == [5, 5, 3, 3, 2, 2, 0, 0, 0]
    assert [len(r.recos) for r in got] == [0, 0, 0, 0, 1, 1, 1, 0, 1]


def test_sitemap_freshness_formats(spark):
    values = ["2024-01-24", "2024-01-23", "2024-01-01", "2023-12-31", "2023-11-02 00:00:00", "2023-11-01T00:00:00", "2023-01-31T00:00:00+00:00", "2023-01-30", "x", None]
    got = column(spark, values, lambda x: sitemap.freshness(x, "2024-01-31 00:00:00"), "string")
    assert got == [1.0, 0.9, 0.9, 0.7, 0.7, 0.5, 0.5, 0.3, 0.3, 0.3]
    assert column(spark, ["Tue, 02 Jan 2024 10:00:00 GMT", "2024-01-02T03:04:05+01:00"], lambda x: D.page_date(x).cast("string")) == [
        "2024-01-02 10:00:00", "2024-01-02 03:04:05"]


def test_entity_patterns_follow_unicode_letters(spark):
    texts = ["M. Dupont et Mme Martin", "Acme Corp", "éParis Paris", "12/03/2024 ou 5 mars 2024", "45% et 3 millions", "le 1er Août 2024"]
    assert column(spark, texts, geo.entity_count) == [2, 1, 1, 2, 2, 0]


def test_robots_variants(spark):
    files = {"absent": "", "global": "User-agent: *\nDisallow: /", "one": "User-agent: GPTBot\nDisallow: /\n\nUser-agent: ClaudeBot\nAllow: /",
             "allowed_first": "User-agent: ClaudeBot\nAllow: /\nUser-agent: *\nDisallow: /", "stacked": "User-agent: GPTBot\nUser-agent: Other\nDisallow: /",
             "harmless": "User-agent: *\nDisallow: /admin"}
    df = spark.createDataFrame(list(files.items()), "site string, content string")
    got = {r.site: r for r in access.robots_access(df).collect()}
    assert {k: v.accessible for k, v in got.items()} == {"absent": False, "global": False, "one": False, "allowed_first": False, "stacked": True, "harmless": True}
    assert got["global"].details == access.ALL_BLOCKED and got["one"].blocked_bots == ["gptbot"] and got["one"].allowed_bots == ["claudebot"]
    assert got["allowed_first"].details.startswith(access.SOME_BLOCKED) and got["allowed_first"].allowed_bots == ["claudebot"]


def test_diff_shapes(spark):
    pairs = [(1, None, None), (2, '{"a":1}', '{"a":1.0}'), (3, '{"a":1}', '{"a":{"b":2}}'), (4, '{"a":{"b":2}}', '{"a":1}'), (5, '{"l":[1,2]}', '{"l":[1]}'),
             (6, '{"l":[1]}', '{"l":[1,{"x":[2]}]}'), (7, '{"l":[{"x":[{"y":1}]}]}', '{"l":[{"x":[{"y":2}]}]}'), (8, '{"a":1,"b":2}', '{"a":1}')]
    df = spark.createDataFrame(pairs, "doc_id int, original string, optimized string")
    rows = {}
    for r in jsonld.jsonld_diff(df).collect():
        rows.setdefault(r.doc_id, set()).add((r.path, r.status))
    assert rows == {2: {("a", "same")}, 3: {("a.b", "added")}, 4: {("a", "enriched")}, 5: {("l[0]", "same"), ("l[1]", "removed")},
                    6: {("l[0]", "same"), ("l[1]", "added")}, 7: {("l[0].x[0].y", "enriched")}, 8: {("a", "same"), ("b", "removed")}}
    delta = {r.doc_id: r.delta for r in jsonld.jsonld_delta(df).collect()}
    assert delta[2] == "{}" and delta[3] == '{"a":{"b":2}}' and delta[7] == '{"l":[{"x":[{"y":2}]}]}' and delta[8] == "{}"


def test_validation_cases(spark):
    docs = [(1, '{"@type":"Person","name":"x"}'), (2, '{"@context":"http://autre","@type":["Event"],"name":"n","startDate":"2024-01-01","location":"l"}'),
            (3, '{"@context":"https://schema.org","@type":"Recipe","url":"ftp://x","datePublished":"hier","image_url":"{{u}}"}'), (4, "[1]"), (5, "{}")]
    got = {r.doc_id: r for r in jsonld.validate_jsonld(spark.createDataFrame(docs, "doc_id int, doc string")).collect()}
    assert got[1].errors == ["Champ @context manquant"] and got[1].message == " JSON-LD invalide : 1 erreur(s)"
    assert got[2].valid and got[2].message == " JSON-LD valide avec 1 warning(s)"
    assert len(got[3].errors) == 2 and got[3].warnings == ["Format de date suspect dans datePublished : hier (attendu YYYY-MM-DD)",
                                                          "URL potentiellement invalide dans url : ftp://x..."]
    assert got[4].errors == got[5].errors == ["JSON-LD vide ou invalide"]


def test_structure_similarity_depends_on_order(spark):
    tags = dict.fromkeys(cluster.TOLERANCES, 1)
    shape = "struct<" + ",".join(f"{t}:int" for t in tags) + ">"
    df = spark.createDataFrame([({**tags, "h1": 4}, {**tags, "h1": 5})], f"a {shape}, b {shape}")
    r = df.select(cluster.structure_similarity(c("a"), c("b")).alias("ab"), cluster.structure_similarity(c("b"), c("a")).alias("ba")).head()
    assert r.ab == 1.0 and r.ba == pytest.approx(6 / 7)


def test_frontier_order_and_limit(spark):
    one = [("a", "c"), ("a", "b"), ("b", "d"), ("c", "e"), ("e", "a"), ("x", "y")]
    edges = spark.createDataFrame([("s", *e) for e in one] + [("t", "c", "b"), ("t", "c", "z"), ("t", "a", "b"), ("u", "q", "q")], "site string, src string, dst string")
    seeds = spark.createDataFrame([("s", "a", 0), ("t", "c", 1), ("t", "a", 0), ("u", "q", 0)], "site string, url string, turn int")
    full = [("s", "a", 0, 1), ("s", "b", 1, 2), ("s", "c", 1, 3), ("s", "d", 2, 4), ("s", "e", 2, 5), ("t", "a", 0, 1), ("t", "c", 0, 2), ("t", "b", 1, 3), ("t", "z", 1, 4), ("u", "q", 0, 1)]
    assert sorted(tuple(r) for r in breadth_first(edges, seeds, None).collect()) == sorted(full)
    # The budget counts for each site.
    for most in (1, 2, 3, 4):
        assert sorted(tuple(r) for r in breadth_first(edges, seeds, most).collect()) == sorted(r for r in full if r[3] <= most)


def test_frontier_follows_stored_pages_of_its_crawl(spark):
    link = lambda *hrefs: "".join(f'<a href="{h}">x</a>' for h in hrefs)
    pages = spark.createDataFrame([
        (1, "https://a.fr/", link("/lost", "/two", "https://shop.example/s", "https://b.fr/", "/x.pdf")), (2, "https://a.fr/two", link("/", "/three")),
        (3, "https://www.a.fr/three", link("/")), (4, "https://shop.example/s", link("/t", "https://www.a.fr/three")), (5, "https://shop.example/t", ""), (6, "https://b.fr/", link("/self"))],
        "page_id long, url string, html string")
    crawls = spark.createDataFrame([("A", ["https://a.fr/gone", "https://a.fr"], ["www.shop.example", None, " "]), ("B", ["https://b.fr/"], None)],
                                   "site string, start_urls array<string>, attached array<string>")
    found = links.page_links(pages, crawls=crawls)
    got = {}
    for r in links.crawl_frontier(found, pages, crawls).collect():
        got.setdefault(r.site, {})[r.position] = (r.url, r.depth)
    home = [u for u, d in got["A"].values() if d == 0]
    assert len(home) == 1 and [u.split("/")[-1] for _, (u, d) in sorted(got["A"].items()) if d == 1] == ["two", "s"] and len(got["B"]) == 1
    inside = {(r.page_id, r.href): r.internal for r in found.collect()}
    assert inside[1, "https://shop.example/s"] and not inside[1, "https://b.fr/"] and not inside[1, "/x.pdf"] and inside[4, "https://www.a.fr/three"]
    assert {r.page_id: r.site for r in found.collect()} == {1: "A", 2: "A", 3: "A", 4: "A", 6: "B"}


def test_sector_ties_and_default(spark):
    rows = [(0, "Acme", "rien", "B"), (1, "Acme", "blog", "A"), (2, "Acme", "concert et film", "D"), (3, "Studio film", "concert cinéma", "K")]
    df = spark.createDataFrame(rows, "i int, n string, d string, w string").orderBy("i")
    assert [r[0] for r in df.select(entity.predict_sector(c("n"), c("d"))).collect()] == [r[3] for r in rows]


def test_pillars_weakest_three_then_filter(spark):
    cols = "entity string, " + ", ".join(f"{n} double" for n, _, _ in authority.PILLARS)
    df = spark.createDataFrame([("e", 0.0, 90.0, 85.0, 95.0, 99.0), ("f", 50.0, 50.0, 50.0, 50.0, 50.0)], cols)
    got = [(r.entity, r.rank, r.pillar) for r in authority.authority_recos(df).orderBy("entity", "rank").collect()]
    assert got == [("e", 1, "Ancrage Knowledge Graph"), ("f", 1, "Ancrage Knowledge Graph"), ("f", 2, "Interopérabilité des Données"), ("f", 3, "Autorité de Citation")]
    assert column(spark, [39.9, 40.0, 60.0, 80.0], lambda x: F.substring(authority.interpretation(x), 1, 16), "double") == [
        "Autorite Tres Fa", "Autorite Faible ", "Autorite Moyenne", "Autorite Forte -"]


def test_source_order(spark):
    rows = offpage.select_sources(offpage.source_table(spark), "fast").collect()
    assert [r.domain_key for r in rows] == ["reddit.com", "wikipedia.org", "trustpilot.com", "youtube.com", "quora.com", "linkedin.com"]


def test_csv_import(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("url,content_type,has_jsonld,monthly_traffic\nhttps://a.b/x,guide,True,12\nhttps://a.b/y,faq,,many\n")
    rows = read_pages_csv(spark, str(good)).orderBy("url").collect()
    assert [(r.content_type, r.has_jsonld, r.monthly_traffic, r.backlinks) for r in rows] == [("guide", True, 12, None), ("faq", None, None, None)]
    bad = tmp_path / "bad.csv"
    bad.write_text("url,title\nhttps://a.b/x,t\n")
    with pytest.raises(ValueError, match="content_type"):
        read_pages_csv(spark, str(bad))


def test_sitemap_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([("https://a.b/?x=1&y=2", "2024-01-02T03:04:05", "daily", 0.825), ("https://a.b/é", None, None, None)],
                                    "url string, lastmod string, changefreq string, priority double")
    sitemaps.write_sitemap(entries, str(tmp_path / "map"))
    text = "".join(p.read_text() for p in (tmp_path / "map").glob("part-*"))
    assert "&amp;y=2" in text and 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"' in text and text.count("<lastmod>") == 1
    back = sitemaps.read_sitemap(spark, str(tmp_path / "map")).orderBy("loc").collect()
    assert [(r.loc, r.lastmod) for r in back] == [("https://a.b/?x=1&y=2", "2024-01-02"), ("https://a.b/é", None)]
    sitemaps.write_sitemap_index(entries.select("url"), str(tmp_path / "index"))
    assert "<sitemapindex" in "".join(p.read_text() for p in (tmp_path / "index").glob("part-*"))


def test_sitemap_index_expansion(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    docs = [("root", f"<sitemapindex {ns}><sitemap><loc>a</loc></sitemap><sitemap><loc>sub</loc></sitemap></sitemapindex>"),
            ("sub", f"<sitemapindex {ns}><sitemap><loc>b</loc></sitemap><sitemap><loc>root</loc></sitemap></sitemapindex>"),
            ("a", f"<urlset {ns}><url><loc> u1 </loc><lastmod>2024-01-01</lastmod></url><url><loc>u2</loc></url></urlset>"),
            ("b", f"<urlset {ns}><url><loc>u3</loc></url></urlset>"), ("broken", "<urlset><url>")]
    df = spark.createDataFrame(docs, "loc string, content string")
    got = sitemaps.expand_sitemap_index(df, spark.createDataFrame([("root",), ("broken",)], "loc string")).collect()
    assert sorted((r.root, r.source, r.loc, r.lastmod) for r in got) == [
        ("root", "a", "u1", "2024-01-01"), ("root", "a", "u2", None), ("root", "b", "u3", None)]


def test_main_content_ends_at_its_own_tag(spark):
    cases = {
        '<div class="content"><div>one</div> two three</div> four': "one two three",
        "<p>x</p><MAIN>a<main>b</main >c</main>d<main>e</main>": "a b c",
        "<article id=1>a <article><article>b</article></article> c</article> d": "a b c",
        "<div>no</div><div class='the-Main'><div/>a<div\n>b<div>c</div></div><divider>d</divider></div>e": "a b c d",
        "<div class=\"content\"><div>never</div> closed": "never closed",
        "<article>a</article><main>b</main>": "b",
        "<main-nav>n</main-nav> all": "n all",
        "<main>a<script><main></script><!-- <main> -->b</main>c": "a b",
        "": "", "<main></main>x": "",
    }
    assert column(spark, list(cases), H.main_content) == list(cases.values())
    deep = "<div class='content'>" + "<div>x " * 3000 + "</div>" * 3001 + "out"
    assert column(spark, [deep], H.main_content) == [" ".join(["x"] * 3000)]

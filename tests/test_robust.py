"""Documents of any shape: long strings, deep nesting, broken rows, every character name."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from corpusaudit.functions.text import decode_entities
from corpusaudit.operators import geo, jsonld as J, saves, sitemap
from corpusaudit.operators.pages import page_facts


def nested(depth: int, leaf: dict) -> dict:
    for _ in range(depth):
        leaf = {"@graph": [leaf]}
    return leaf


HARD = [(1, json.dumps({"@type": "A", "t": "\n" * 100_000})), (2, json.dumps(nested(100, {"@type": "Organization", "sameAs": ["x", "y"]}))),
        (3, "{broken" + "[" * 10_000), (4, None), (5, json.dumps({"t": '[{"' * 5000, "@type": "B"})), (6, "[]"), (7, "3")]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, "doc_id long, block string")


def test_types_links_and_organisation(hard):
    got = {r.doc_id: r for r in J.with_same_as(J.with_types(hard)).collect()}
    assert {k: r.types for k, r in got.items()} == {1: ["A"], 2: ["Organization"], 3: [], 4: [], 5: ["B"], 6: [], 7: []}
    assert {k: r.same_as for k, r in got.items()} == {1: 0, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    nodes = {r.doc_id: json.loads(r.node) for r in J.org_node(hard.withColumnRenamed("block", "doc")).collect()}
    assert nodes == {2: {"@type": "Organization", "sameAs": ["x", "y"]}}


def test_diff_and_delta(hard):
    docs = hard.select("doc_id", F.col("block").alias("original"), F.regexp_replace("block", "Organization", "Company").alias("optimized"))
    changed = J.jsonld_diff(docs).filter("status <> 'same'").collect()
    assert [(r.doc_id, r.status, r.path.endswith("@type")) for r in changed] == [(2, "enriched", True)]
    deltas = {r.doc_id: r.delta for r in J.jsonld_delta(docs).collect()}
    assert json.loads(deltas[2])["@graph"] and all(d in ("{}", None) for k, d in deltas.items() if k not in (2, 6, 7))


def test_plans_do_not_follow_the_documents(spark, hard):
    flat = spark.createDataFrame([(1, '{"@type":"A"}')], "doc_id long, block string")

    def operators(df):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        return re.sub(r"#\d+L?|_\d+|LogicalRDD.*|\d+", "", text)

    for build in (J.with_types, J.with_same_as, lambda d: J.org_node(d.withColumnRenamed("block", "doc")),
                  lambda d: J.jsonld_diff(d.selectExpr("doc_id", "block as original", "upper(block) as optimized")),
                  lambda d: J.jsonld_delta(d.selectExpr("doc_id", "block as original", "upper(block) as optimized"))):
        assert operators(build(hard)) == operators(build(flat))


def test_long_runs_of_capitalised_words(spark):
    texts = [("Acme Foo " * 50_000 + "SA", 1), ("Acme Ltd Foo Bar. Beta GmbH, Gamma Inc2 Corp", 2), ("Inc Foo", 0), ("Société Inc", 0), (None, None)]
    df = spark.createDataFrame(texts, "t string, n int")
    assert all(r.n == r.got for r in df.withColumn("got", geo.entity_count(F.col("t"))).collect())


def test_every_character_name_and_number(spark):
    df = spark.createDataFrame([("c&oelig;ur &Ocirc; &sect; &#0000039; &#x0000041; &CounterClockwiseContourIntegral; &nosuch; &#1114112; &amp;lt;",)], "t string")
    assert df.select(decode_entities(F.col("t"))).head()[0] == "cœur Ô § ' A ∳ &nosuch; &#1114112; &lt;"


def test_nothing_is_cut(spark):
    text = json.dumps({"a": "x" * 60_000})
    models = spark.createDataFrame([(1, "M", "Product", 3, "/a", ["u" * 1000] * 7, text, text, text)],
                                   "cluster_id int, model_name string, schema_type string, page_count int, url_pattern string, sample_urls array<string>, "
                                   "dom_structure string, existing_jsonld string, optimized_jsonld string")
    row = saves.models_to_rows(models, "https://s.fr", "w", "u", "2024").head()
    assert row.existing_jsonld == row.optimized_jsonld == row.dom_structure == text and len(json.loads(row.sample_urls)) == 5
    pages = spark.range(6000).selectExpr("id as page_id", "1.0 as seo_priority", "1 as project_id")
    assert sitemap.list_pages(pages, project_id=1).count() == 6000


def test_scores_read_titles_from_the_same_html(spark):
    html = '<html><head><title>Un titre assez long</title><meta name="description" content="Un guide"></head><body><h1>Un grand titre ?</h1></body></html>'
    raw = spark.createDataFrame([(1, "https://a.fr/x", html, None, None)], "page_id long, url string, html string, response_time double, last_modified string")
    facts = page_facts(raw.select("page_id", "url", "html")).select("page_id", "title", "h1", "description")
    joined = geo.geo_score(raw.join(facts, "page_id"), "2024-01-31").collect()
    assert geo.geo_score(raw, "2024-01-31").collect() == joined


def test_patches_are_applied_in_turn(spark):
    from corpusaudit.operators import entity
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "page_id long, content_type string, status string")
    patch = spark.createDataFrame([(1, 1, "c", None), (1, 2, None, "z"), (1, 3, "d", None), (9, 1, "q", "q")], "page_id long, turn int, content_type string, status string")
    assert sorted(map(tuple, sitemap.update_pages(pages, patch, order="turn").collect())) == [(1, "d", "z"), (2, "b", "y")]
    masters = spark.createDataFrame([(1, None, "k", "pending")], "entity_id long, city string, siren string, status string")
    fills = spark.createDataFrame([(1, 1, "", "s"), (1, 2, "Lyon", None), (1, 3, "Paris", None)], "entity_id long, turn int, city string, siren string")
    row = entity.fill_missing(masters, fills, order="turn").head()
    assert (row.city, row.siren, row.status, row.updated) == ("Lyon", "k", "complete", ["city"])
    cols = "save_id string, user_email string, workspace string, site_url string, created_at string, master_json string"
    old = spark.createDataFrame([("s1", "u@x", "w", "https://a.fr", "2024", "{}")], cols)
    rows = spark.createDataFrame([("s1", "U@x ", "w", "https://b.fr", "2025", "1", 1), ("s1", "u@x", "w", "https://c.fr", "2025", "2", 2)], cols + ", turn int")
    kept, rejects = saves.overwrite_saves(old, rows, order="turn")
    assert [r.site_url for r in kept.collect()] == ["https://c.fr"] and rejects.count() == 0
    masters = rows.withColumn("site_url", F.lit("https://a.fr"))
    assert [r.master_json for r in saves.attach_masters(old, masters, "2026", order="turn").collect()] == ["2"]


def test_patches_of_one_key_need_an_order(spark):
    from corpusaudit.plans.shapes import in_turn, last_rows
    cols = "k int, turn int, v string, w string"
    clash = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", "x"), (2, 1, "c", None)], cols)
    for broken in (in_turn(clash, ["k"], ["v", "w"]), last_rows(clash.drop("turn"), ["k"])):
        with pytest.raises(Exception, match="name the column that gives their order"):
            broken.collect()
    twice = clash.filter("turn = 1").unionByName(clash.filter("turn = 1"))
    assert sorted(map(tuple, in_turn(twice, ["k"], ["v", "w"]).collect())) == [(1, "a", None), (2, "c", None)]
    assert sorted(map(tuple, last_rows(clash, ["k"], "turn").collect())) == [(1, 2, "b", "x"), (2, 1, "c", None)]
    # Whatever the partition layout, and on equal turns too.
    many = spark.range(2000).selectExpr("1 AS k", "cast(id % 500 AS int) AS turn", "cast(id AS string) AS v")
    got = {in_turn(many.repartition(n, "v"), ["k"], ["v"], "turn").head().v for n in (1, 3, 8)}
    assert got == {"999"}


def test_pages_without_url_stay_in_clusters(spark):
    from corpusaudit.operators import cluster
    html = "<html><body><p>a</p></body></html>"
    pages = spark.createDataFrame([(1, None, html), (2, "https://a.fr/x", html), (3, None, html)], "page_id long, url string, html string")
    facts = cluster.enrich_pages(pages)
    assert sorted((r.page_id, r.sig) for r in cluster.members_of(facts, cluster.signatures(facts)).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_an_api_host_is_judged_by_its_own_robots_file(spark):
    from corpusaudit.operators import access
    robots = spark.createDataFrame([("a.fr", True), ("zz.a.fr", False), ("api.a.fr", True), ("b.fr", True)], "site string, accessible boolean")
    metas = spark.createDataFrame([("a.fr", True)], "site string, indexable boolean")
    apis = spark.createDataFrame([("a.fr", "api.a.fr", 1), ("a.fr", "zz.a.fr", 0), ("b.fr", "api.b.fr", 1)], "site string, candidate string, rank int")
    got = {r.site: (r.api_detected, r.api_accessible) for r in access.access_summary(robots, metas, apis).collect()}
    assert got["a.fr"] == (True, "FERME") and got["b.fr"] == (False, "NON DETECTEE")


@pytest.mark.parametrize("name", ["page_scores", "page_recommendations", "score_meta_description", "score_entity_richness"])
def test_registered_scores_move_no_html(spark, sf_dir, name):
    from catalog import QUERIES
    text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Exchange" not in text[text.index("== Physical Plan"):]


@pytest.mark.parametrize("name", ["authority_site_text", "cluster_sample_pages", "crawl_stats"])
def test_html_is_not_shuffled_for_a_few_rows(spark, sf_dir, name):
    import re

    from catalog import QUERIES
    out = QUERIES[name](spark, sf_dir)
    text = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    moved = re.findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)
    assert moved and not [m for m in moved if "html#" in m] and text.count("Scan parquet") + text.count("FileScan") > 0
    if name == "crawl_stats":
        assert len(re.findall(r"\(\d+\) Scan parquet", text)) == 1


def test_sitemaps_are_written_per_project(spark, tmp_path):
    from corpusaudit.sources import sitemaps
    entries = spark.range(300).selectExpr("id % 3 as project_id", "concat('https://h', id % 3, '.fr/', id) as url", "'2024-01-02' as lastmod", "'daily' as changefreq", "0.5 as priority")
    sitemaps.write_project_sitemaps(entries, str(tmp_path / "maps"))
    for k in range(3):
        back = sitemaps.read_sitemap(spark, str(tmp_path / f"maps/project_id={k}")).collect()
        assert len(back) == 100 and all(r.loc.startswith(f"https://h{k}.fr/") for r in back)
    index = sitemaps.project_sitemap_index(spark, str(tmp_path / "maps"), "https://cdn.fr/maps/")
    files = {(r.project_id, r.url) for r in index.collect()}
    assert {p for p, _ in files} == {0, 1, 2} and all(f"/project_id={p}/part-" in u for p, u in files)
    sitemaps.write_project_indexes(index, str(tmp_path / "indexes"))
    raw = "".join(f.read_text() for f in (tmp_path / "indexes/project_id=1").glob("part-*"))
    assert "<sitemapindex" in raw and raw.count("<loc>") == sum(p == 1 for p, _ in files)


def test_cluster_queries_compare_pages_of_all_hosts(spark, tmp_path):
    import duckdb

    from catalog import ORACLE, QUERIES

    from .compare import differences
    # Numbers of equal remainders, so that the pages made of them hold the same elements.
    step, page = 27720, '<html><head><meta charset="utf-8"><title>t</title></head><body><h1>h</h1><p>x</p></body></html>'
    rows = [(step * i, f"https://{host}.example.com/blog/{i}", page) for i, host in enumerate("abcab", 1)]
    rows.append((step * 9, "https://a.example.com/one/two/three/four/five/six/seven", page))
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, "s1", 1), (2, "s2", 2)], "s_suppkey long, s_name string, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.page_id // step: r.component // step for r in QUERIES["cluster_components"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 9}
    site = "{}.example.com".format
    assert sorted(tuple(r) for r in QUERIES["cluster_numbers"](spark, str(tmp_path)).collect()) == [
        (site("a"), 1, step, 5, 2), (site("a"), 2, step * 9, 1, 1), (site("b"), 1, step, 5, 2), (site("c"), 1, step, 5, 1)]
    con = duckdb.connect()
    for t in ("pages", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("cluster_similar_pairs", "cluster_models"):
        assert differences(spark, con, QUERIES[name], ORACLE[name], str(tmp_path)) == [], name


def test_diff_is_dealt_over_tasks(spark):
    from corpusaudit.plans.shapes import dealt
    docs = spark.createDataFrame([(i, '{"a":1,"b":[1]}', '{"a":2,"c":{"d":1}}') for i in range(40)], "doc_id long, original string, optimized string").coalesce(1)
    diff = J.jsonld_diff(docs)
    assert diff.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert dealt(docs, "doc_id", 2).rdd.getNumPartitions() == 21
    plan = J.diff_summary(diff)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert {tuple(r)[1:] for r in J.diff_summary(diff).collect()} == {(1, 1, 0, 1, 3)}


def test_stored_snapshots_parse_pages_once(spark, sf_dir, monkeypatch):
    from catalog import QUERIES

    class Seen(Exception):
        pass

    def first(session, path, tables):
        plans = [t._jdf.queryExecution().optimizedPlan().toString() for t in tables.values()]
        assert not any("Relation [" in p for p in plans)
        raise Seen

    monkeypatch.setattr(saves, "append_snapshot", first)
    with pytest.raises(Seen):
        QUERIES["snapshot_stored"](spark, sf_dir)


def test_concept_candidates_are_not_written(spark, monkeypatch):
    from corpusaudit.operators import offpage
    from corpusaudit.plans import shapes
    fixed, keep = [], shapes.checkpoint

    def noted(df):
        out = keep(df)
        fixed.append(out.count() if "mention_id" in out.columns else 0)
        return out

    monkeypatch.setattr(shapes, "checkpoint", noted)
    monkeypatch.setattr(offpage, "checkpoint", noted)
    # All texts share every gram of the concept, one holds it.
    rows = [(i, "b", "abcd cdef", None) for i in range(50)] + [(50, "b", "x ABCDEF", ""), (51, "b", "abcdef", "abcdef"), (51, "b", "abcdef", None), (None, "b", "abcdef", None)]
    m = spark.createDataFrame(rows, "mention_id long, brand string, title string, descr string")
    con = spark.createDataFrame([("b", "ABCDEF"), ("b", "Cdef"), ("b", "zz")], "brand string, concept string")
    got = sorted((r.concept, r.mention_id) for r in offpage.matches(con.filter("concept <> 'Cdef'"), m).collect())
    assert got == [("ABCDEF", 50)] + [("ABCDEF", 51)] * 4 and max(fixed) <= 1
    assert sorted(r.mention_id for r in offpage.matches(con, m, 1).filter("concept = 'ABCDEF'").collect()) == [50] + [51] * 4


def test_clusters_over_all_hosts_keep_every_host(spark, tmp_path):
    import duckdb

    from catalog import ORACLE, QUERIES

    from .compare import differences
    # Two hosts share one cluster, of which each has its own pages, longest pattern and first pages.
    step, page = 27720, '<html><head><meta charset="utf-8"><title>t</title></head><body><h1>h</h1><p>x</p></body></html>'
    rows = [(step * i, f"https://{host}.example.com/{path}/{i}", page) for i, (host, path) in enumerate([("a", "blog")] * 6 + [("b", "blog")] * 2, 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    run = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    a, b = "a.example.com", "b.example.com"
    assert run("cluster_components") == [(step * i, a if i < 7 else b, step) for i in range(1, 9)]
    assert run("cluster_numbers") == [(a, 1, step, 8, 6), (b, 1, step, 8, 2)]
    assert [r[:2] for r in run("cluster_patterns")] == [(a, 1), (b, 1)]
    assert [r[:3] for r in run("cluster_sample_pages")] == [(a, 1, i) for i in range(1, 6)] + [(b, 1, i) for i in (1, 2)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("cluster_components", "cluster_numbers", "cluster_patterns", "cluster_sample_pages"):
        assert differences(spark, con, QUERIES[name], ORACLE[name], str(tmp_path)) == [], name

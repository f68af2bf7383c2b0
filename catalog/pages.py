"""URL functions, page facts, links, categories and token counts over the page tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit.functions import html as H
from corpusaudit.functions import urls as U
from corpusaudit.functions.text import word_count
from corpusaudit.operators import categories, eco, links, pages as P
from corpusaudit.plans.graph import breadth_first
from corpusaudit.plans.shapes import number_in_groups, with_row_number
from corpusaudit.sources.pages import read_pages, truncate_html

from . import sqlfn as S
from .base import query, table, view, with_views

c = F.col
RICH = with_views("rich_pages")
FACTS = f"{RICH},{S.facts()}"
PIPE = "'|'"


def rich(spark, sf):
    return view(spark, sf, "rich_pages")


def facts(spark, sf):
    return P.page_facts(rich(spark, sf))


def join_text(col):
    return F.array_join(col, "|")


# ---------------------------------------------------------------- urls

@query("url_normalized", "URL-1", f"SELECT page_id, {S.normalize('url')} AS normalized FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.normalize_url(c("url")).alias("normalized"))


SHAPES = ("CASE page_id % 9 WHEN 0 THEN '../x?k=1' WHEN 1 THEN '/abs/y' WHEN 2 THEN '?q=1' WHEN 3 THEN '#f' WHEN 4 THEN '//h.org/z' "
          "WHEN 5 THEN 'rel/a' WHEN 6 THEN '../rel/./b' WHEN 7 THEN 'mailto:a@b.c' ELSE '' END")


@query("url_resolved", "URL-2", f"SELECT page_id, {S.resolve('url', 'href')} AS resolved FROM (SELECT page_id, url, {SHAPES} AS href FROM pages)")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", F.expr(SHAPES).alias("href"))
    return p.select("page_id", U.resolve_url(c("url"), c("href")).alias("resolved"))


@query("url_domain_set", "URL-3", f"""
SELECT page_id, array_to_string(list_sort(list_distinct([h, b, 'www.' || b, 'www.shop' || page_id || '.fr', 'shop' || page_id || '.fr'])), {PIPE}) AS domains
FROM (SELECT page_id, {S.host('url')} AS h, regexp_replace({S.host('url')}, '^www\\.', '') AS b FROM pages)""")
def _(spark, sf):
    extra = F.array(F.concat(F.lit(" https://shop"), c("page_id").cast("string"), F.lit(".fr/a ")), F.lit(""))
    return table(spark, sf, "pages").select("page_id", join_text(F.array_sort(U.domain_set(c("url"), extra))).alias("domains"))


TAILS = "url || CASE page_id % 5 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '/b.jpeg?x=.zip' WHEN 2 THEN '/javascript:void(0)' ELSE '' END"


@query("url_excluded", "URL-4", f"""
SELECT page_id, list_filter({S.list_of(U.EXCLUDED)}, lambda p: contains(lower({TAILS}), p))[1] AS pattern FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.excluded_by(F.expr(TAILS)).alias("pattern"))


@query("url_dynamic_segments", "URL-5", f"""
SELECT segment, CAST(count(*) AS BIGINT) AS uses, {S.dynamic('segment')} AS dynamic
FROM (SELECT unnest({S.segments(S.path('url'))}) AS segment FROM pages) GROUP BY segment""")
def _(spark, sf):
    segs = table(spark, sf, "pages").select(F.explode(U.path_segments(U.path(c("url")))).alias("segment"))
    return segs.groupBy("segment").agg(F.count("*").alias("uses")).withColumn("dynamic", U.is_dynamic_segment(c("segment")))


@query("url_patterns", "URL-6", f"SELECT page_id, array_to_string({S.pattern('url')}, '/') AS pattern FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(U.path_pattern(c("url")), "/").alias("pattern"))


@query("url_pattern_similarity", "URL-7", f"""
WITH p AS (SELECT page_id, {S.pattern('url')} AS a FROM pages)
SELECT x.page_id, round(CASE WHEN len(x.a) = 0 AND len(y.a) = 0 THEN 1.0::DOUBLE WHEN len(x.a) = 0 OR len(y.a) = 0 THEN 0.0::DOUBLE
  WHEN len(x.a) = len(y.a) THEN m / len(x.a)::DOUBLE ELSE m / greatest(len(x.a), len(y.a))::DOUBLE * 0.85::DOUBLE END, 6) AS similarity
FROM p x JOIN p y ON y.page_id = x.page_id + 1,
LATERAL (SELECT len(list_filter(list_zip(x.a, y.a), lambda z: z[1] = z[2])) AS m)""")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", U.path_pattern(c("url")).alias("a"))
    y = p.select((c("page_id") - 1).alias("page_id"), c("a").alias("b"))
    return p.join(y, "page_id").select("page_id", F.round(U.pattern_similarity(c("a"), c("b")), 6).alias("similarity"))


@query("url_site_names", "URL-8", "SELECT page_id, string_split(replace(replace(url, 'https://', ''), 'http://', ''), '/')[1] AS site_name FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.site_name(c("url")).alias("site_name"))


@query("url_pattern_group", "URL-9", f"SELECT page_id, {S.group('url')} AS grp FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.pattern_group(c("url")).alias("grp"))


@query("url_same_site_links", "URL-10", f"""
{RICH}, h AS (SELECT page_id, url, unnest({S.hrefs(S.drop('html'))}) AS href FROM rich_pages),
f AS (SELECT page_id, url, {S.resolve('url', 'href')} AS link FROM h)
SELECT DISTINCT page_id, regexp_replace(link, '[#?].*$', '') AS link FROM f WHERE {S.netloc('link')} = {S.netloc('url')}""")
def _(spark, sf):
    h = rich(spark, sf).select("page_id", "url", F.explode(H.hrefs(c("html"))).alias("href"))
    return h.select("page_id", U.same_site_link(c("url"), c("href")).alias("link")).filter("link IS NOT NULL").distinct()


# ---------------------------------------------------------------- html facts

@query("page_snapshot", "SRC-1", "SELECT page_id, url, CAST(length(html) AS BIGINT) AS n, NULL::VARCHAR AS title, NULL::DOUBLE AS response_time FROM pages")
def _(spark, sf):
    return read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("n"), "title", "response_time")


@query("html_dom_structure", "HTML-1", FACTS + " SELECT page_id, " + ", ".join(f"{S.n_tags('tag', t)} AS {t}" for t in H.STRUCTURE_TAGS) + " FROM tagged")
def _(spark, sf):
    return rich(spark, sf).select("page_id", H.dom_structure(c("html")).alias("d")).select(
        "page_id", *[c(f"d.{t}").cast("long").alias(t) for t in H.STRUCTURE_TAGS])


TYPES_SQL = """list_sort(list_distinct(flatten(list_transform(json_ld, lambda j: CASE json_type(j, '$."@type"') WHEN 'ARRAY'
  THEN from_json(json_extract(j, '$."@type"'), '["VARCHAR"]') WHEN 'VARCHAR' THEN [json_extract_string(j, '$."@type"')] ELSE [] END))))"""


@query("html_semantic_features", "HTML-2", f"""{FACTS}
SELECT page_id, {S.n_tags('tag', 'p')} AS p, {S.n_tags('tag', 'ul', 'ol')} AS lists, {S.n_tags('tag', 'img')} AS images,
  CAST({S.n_tags('tag', 'form')} > 0 AS INTEGER) AS has_form, {S.n_tags('tag', 'button')} + {S.rcount('clean', H.INPUT_BUTTON)} AS buttons,
  array_to_string({TYPES_SQL}, {PIPE}) AS types FROM tagged""")
def _(spark, sf):
    return facts(spark, sf).select("page_id", *[c(f"semantic_features.{k}").cast("long").alias(k) for k in ("p", "lists", "images")],
                                   c("semantic_features.has_form").alias("has_form"), c("semantic_features.buttons").cast("long").alias("buttons"),
                                   join_text(c("semantic_features.jsonld_types")).alias("types"))


@query("html_title", "HTML-3", f"{FACTS} SELECT page_id, raw_title AS title FROM tagged")
def _(spark, sf):
    return rich(spark, sf).select("page_id", H.title(c("html")).alias("title"))


@query("html_h1", "HTML-4", f"{FACTS} SELECT page_id, h1 FROM tagged")
def _(spark, sf):
    return rich(spark, sf).select("page_id", H.h1(c("html")).alias("h1"))


@query("html_meta_description", "HTML-5", f"{FACTS} SELECT page_id, description FROM tagged")
def _(spark, sf):
    return rich(spark, sf).select("page_id", H.meta_description(c("html")).alias("description"))


@query("html_counts", "HTML-6", f"{FACTS} SELECT page_id, h2_count, {S.n_tags('tag', 'ul', 'ol')} AS lists_count FROM facts")
def _(spark, sf):
    return rich(spark, sf).select("page_id", H.counts(c("html")).alias("n")).select(
        "page_id", c("n.h2_count").cast("long").alias("h2_count"), c("n.lists_count").cast("long").alias("lists_count"))


TITLES = ("CASE page_id % 6 WHEN 0 THEN raw_title || ' - Marque' WHEN 1 THEN 'Nos offres | ' || raw_title WHEN 2 THEN 'ab' "
          "WHEN 3 THEN 'Un : deux trois : quatre' WHEN 4 THEN '' ELSE raw_title END")
HEADS = "CASE WHEN page_id % 4 = 0 THEN h1 ELSE '' END"


@query("html_clean_title", "HTML-7", f"""{FACTS}, t AS (SELECT page_id, url, {TITLES} AS t, {HEADS} AS h FROM tagged)
SELECT page_id, {S.clean_title('t', 'h', 'url')} AS title FROM t""")
def _(spark, sf):
    f = facts(spark, sf).select("page_id", "url", F.expr(TITLES).alias("t"), F.expr(HEADS).alias("h"))
    return f.select("page_id", H.clean_title(c("t"), c("h"), c("url")).alias("title"))


@query("html_visible_text", "HTML-8", f"SELECT page_id, CAST(length(text) AS BIGINT) AS chars, md5(text) AS digest FROM ({S.visible_staged('pages')})")
def _(spark, sf):
    t = table(spark, sf, "pages").select("page_id", H.visible_text(c("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


@query("text_word_count", "HTML-9", f"SELECT doc_id, {S.words('text')} AS words FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", word_count(c("text")).cast("long").alias("words"))


def inner_sql(d: str, tag: str, first: str) -> str:
    """Text between the tag ``first`` and the end tag that brings the running number of open tags to zero."""
    body = f"substring({d}, strpos({d}, {first}) + length({first}))"
    parts = f"string_split({S.rr(body, f'(?i)(</?{tag}(?:[[:space:]/][^>]*)?>)', chr(1) + chr(92) + '1')}, chr(1))"
    move = f"CASE WHEN lower(p) LIKE '</{tag}%' THEN -1 WHEN lower(p) LIKE '<{tag}%' AND string_split(p, '>')[1] NOT LIKE '%/' THEN 1 ELSE 0 END"
    return (f"(SELECT array_to_string(CASE WHEN closed IS NULL THEN ps ELSE ps[:closed - 1] END, '') FROM (SELECT ps, list_position(list_transform(range(1, len(ps) + 1), "
            f"lambda i: 1 + list_sum(moves[:i])), 0) AS closed FROM (SELECT ps, list_transform(list_concat([''], ps[2:]), lambda p: {move}) AS moves FROM (SELECT {parts} AS ps))))")


def main_sql(html: str) -> str:
    names = [(t, f"(?i)<{t}(?:[[:space:]][^>]*)?>") for t in ("main", "article")] + [("div", "(?i)<div [^>]*class *= *[\"''][^\"'']*(content|main|article)[^\"'']*[\"''][^>]*>")]
    firsts = ", ".join(f"{S.rx('d', p.replace(chr(39) * 2, chr(39)))} AS first_{t}" for t, p in names)
    cases = " ".join(f"WHEN first_{t} <> '' THEN {inner_sql('d', t, f'first_{t}')}" for t, _ in names)
    return (f"(SELECT page_id, url, html, {S.squeeze(S.decode(S.rr('inner_html', S.TAG, ' ')))} AS main FROM (SELECT page_id, url, html, CASE {cases} ELSE d END AS inner_html "
            f"FROM (SELECT *, {firsts} FROM (SELECT page_id, url, html, {S.drop(html, S.ECO)} AS d FROM src))))")


NEST = "<div>trois</div> et <div id=\"a\"><DIV class=\"main\">quatre</DIV><div/></div > cinq"
WRAPS = ("CASE page_id % 6 WHEN 0 THEN '<p>avant</p><main>un <b>deux</b><main class=\"x\">trois</main> quatre</main><main>non</main>' || html WHEN 1 THEN html "
         f"WHEN 2 THEN '<div class=\"page-content\">{NEST}</div><div>non</div>' || REPLACE(html, 'article', 'span') "
         "WHEN 3 THEN '<article>a<article>b</article>c</article>d' || html WHEN 4 THEN '<div class=\"content\"><div>jamais</div>' || REPLACE(html, 'article', 'span') ELSE REPLACE(html, 'article', 'span') END")


@query("html_main_content", "HTML-10", f"""WITH src AS (SELECT page_id, url, {WRAPS} AS html FROM pages)
SELECT page_id, CAST(length(main) AS BIGINT) AS chars, md5(main) AS digest FROM {main_sql('html')}""")
def _(spark, sf):
    t = table(spark, sf, "pages").select("page_id", H.main_content(F.expr(WRAPS)).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


@query("html_script_types", "HTML-11", f"""{RICH}, s AS (SELECT unnest({S.rall("regexp_replace(html, '(?s)<!--.*?-->', '', 'g')", '(?is)<script((?:[[:space:]][^>]*)?)>.*?</script', 1)}) AS a FROM rich_pages)
SELECT CASE WHEN {S.attr('a', 'type')} = '' THEN '(aucun type)' ELSE {S.attr('a', 'type')} END AS type, CAST(count(*) AS BIGINT) AS count FROM s GROUP BY 1""")
def _(spark, sf):
    return P.script_type_counts(rich(spark, sf))


@query("html_spa_indicators", "HTML-12", f"""{RICH}, l AS (SELECT page_id, lower(html) AS low FROM rich_pages),
r AS (SELECT page_id, unnest(list_filter([{', '.join(f"CASE WHEN contains(low, {S.q(p)}) THEN {S.q('texte:' + s)} END" for p, s in H.SPA_TEXT)},
  CASE WHEN page_id % 9 = 0 THEN 'script:Nuxt' END, CASE WHEN page_id % 9 = 0 THEN 'link:ES Module' END,
  CASE WHEN page_id % 9 = 0 THEN 'module:1 script(s) ES module' END], lambda x: x IS NOT NULL)) AS signal FROM l)
SELECT signal, CAST(count(*) AS BIGINT) AS pages FROM r GROUP BY signal""")
def _(spark, sf):
    s = rich(spark, sf).select(F.explode(H.spa_indicators(c("html"))).alias("s"))
    return s.groupBy(F.concat(c("s.type"), F.lit(":"), c("s.signal")).alias("signal")).agg(F.count("*").alias("pages"))


ROBOTS_META = f"lower({S.attr(S.meta('clean', 'robots'), 'content')})"


@query("html_meta_robots", "HTML-13", f"""{FACTS} SELECT page_id, contains({ROBOTS_META}, 'noindex') AS noindex, contains({ROBOTS_META}, 'nofollow') AS nofollow,
  {ROBOTS_META} AS content, NOT contains({ROBOTS_META}, 'noindex') AS indexable,
  CASE WHEN {S.meta('clean', 'gptbot')} <> '' THEN {S.attr(S.meta('clean', 'gptbot'), 'content')} END AS gptbot FROM cleaned""")
def _(spark, sf):
    m = rich(spark, sf).select("page_id", H.meta_robots(c("html")).alias("m"))
    return m.select("page_id", "m.noindex", "m.nofollow", c("m.meta_content").alias("content"), "m.indexable",
                    F.try_element_at(c("m.ai_meta_tags"), F.lit("gptbot")).alias("gptbot"))


@query("html_truncated", "HTML-14", "SELECT page_id, md5(substring(html, 1, 5120)) AS digest, CAST(length(html) AS BIGINT) AS html_full_size FROM pages")
def _(spark, sf):
    return truncate_html(table(spark, sf, "pages")).select("page_id", F.md5("html").alias("digest"), "html_full_size")


LI = r"(?is)<li(?:\s[^>]*)?>(.*?)</li\s*>"
LISTS = r"(?is)<(?:ul|ol)(?:\s[^>]*)?>(.*?)</(?:ul|ol)\s*>"
PARA = r"(?is)<p(?:\s[^>]*)?>(.*?)(?:</p|<p[\s>]|$)"


@query("html_fallback_entity", "HTML-15", f"""{FACTS}
SELECT page_id, substring({S.tight(S.element('clean', 'h1'))}, 1, 150) AS name,
  substring(CASE WHEN {S.meta('clean', 'description')} <> '' THEN {S.attr(S.meta('clean', 'description'), 'content')}
    ELSE array_to_string(list_transform({S.rall('clean', PARA, 1)}[1:2], lambda y: {S.tight('y')}), ' ') END, 1, 300) AS description,
  CAST(least(5, {S.n_tags('tag', 'h2')}) AS BIGINT) AS sections,
  array_to_string(flatten(list_transform({S.rall('clean', LISTS, 1)}[1:3], lambda x: list_transform({S.rall('x', LI, 1)}[1:10], lambda y: substring({S.tight('y')}, 1, 100))))[1:10], {PIPE}) AS items,
  CASE WHEN page_id % 6 = 0 THEN 2 ELSE 0 END AS images FROM tagged""")
def _(spark, sf):
    j = rich(spark, sf).select("page_id", F.try_parse_json(H.html_fallback(c("html"), c("url"))).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    size = lambda path: F.coalesce(F.size(get(path, "array<variant>")), F.lit(0))
    return j.select("page_id", get("$.mainEntity.name", "string").alias("name"), get("$.description", "string").alias("description"),
                    size("$.mainEntity.sections").cast("long").alias("sections"),
                    join_text(get("$.mainEntity.items", "array<string>")).alias("items"), size("$.image").alias("images"))


BODY = "CASE page_id % 5 WHEN 0 THEN html WHEN 1 THEN '  ' WHEN 2 THEN 'User-agent: *' WHEN 3 THEN 'texte <HTML lang=fr>' ELSE 'plain' END"
CTYPE = "CASE WHEN page_id % 10 = 9 THEN 'text/HTML; charset=utf-8' ELSE 'text/plain' END"


@query("html_is_html", "HTML-16", f"""SELECT page_id, page_id % 5 IN (0, 3) OR page_id % 10 = 9 AS is_html FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.is_html(F.expr(BODY), F.expr(CTYPE)).alias("is_html"))


@query("light_pages", "HTML-17", f"""{FACTS} SELECT page_id, url, substring(title, 1, 300) AS title, substring(description, 1, 400) AS description,
  substring(h1, 1, 400) AS h1, h2_count, has_structured_data, CAST(len(json_ld) AS BIGINT) AS blocks FROM facts""")
def _(spark, sf):
    return P.light_pages(facts(spark, sf)).select("page_id", "url", "title", "description", "h1", c("h2_count").cast("long").alias("h2_count"),
                                                  "has_structured_data", F.coalesce(F.size("json_ld"), F.lit(0)).cast("long").alias("blocks"))


def label_sql(title: str, url: str, domain: str) -> str:
    head = S.strip(f"string_split_regex({title}, ' [-|:] ')[1]")
    last = f"string_split(regexp_replace({url}, '/+$', ''), '/')[-1]"
    named = S.title_case(S.strip(f"replace(replace({last}, '-', ' '), '_', ' ')"))
    pick = f"CASE WHEN length({head}) >= 4 THEN {head} WHEN {named} <> '' THEN {named} ELSE {domain} END"
    return f"list_transform([{pick}], lambda v: CASE WHEN length(v) > 22 THEN substring(v, 1, 20) || '..' ELSE v END)[1]"


@query("html_node_labels", "HTML-18", f"{FACTS}, t AS (SELECT page_id, url, site, {TITLES} AS t FROM tagged) SELECT page_id, {label_sql('t', 'url', 'site')} AS label FROM t")
def _(spark, sf):
    f = facts(spark, sf).select("page_id", "url", "site", F.expr(TITLES).alias("t"))
    return f.select("page_id", H.node_label(c("t"), c("url"), c("site")).alias("label"))


@query("html_brand_dna", "HTML-19", f"""{FACTS} SELECT page_id, {S.squeeze('title')} AS title, {S.squeeze('h1')} AS h1, {S.squeeze('description')} AS meta,
  {S.squeeze("substring(array_to_string(list_filter([title, h1, description], lambda x: x <> ''), ' '), 1, 1000)")} AS raw_text FROM facts""")
def _(spark, sf):
    return facts(spark, sf).select("page_id", H.brand_dna(c("title"), c("h1"), c("description")).alias("d")).select("page_id", "d.*")


@query("html_missing_elements", "HTML-20", f"""{FACTS} SELECT page_id, array_to_string(list_filter([CASE WHEN description = '' THEN {S.q(H.MISSING[0])} END,
  CASE WHEN h1 = '' THEN {S.q(H.MISSING[1])} END, CASE WHEN NOT has_structured_data THEN {S.q(H.MISSING[2])} END,
  CASE WHEN h2_count < 2 THEN {S.q(H.MISSING[3])} END], lambda x: x IS NOT NULL), {PIPE}) AS missing FROM facts""")
def _(spark, sf):
    m = H.missing_elements(c("description"), c("h1"), c("has_structured_data"), c("h2_count"))
    return facts(spark, sf).select("page_id", join_text(m).alias("missing"))


HAY = f"lower({S.decode(S.rr('clean', S.TAG))} || chr(1) || array_to_string({S.hrefs('clean')}, ' '))"


@query("html_trust_signals", "HTML-21", f"""{FACTS}, hay AS (SELECT page_id, {HAY} AS hay FROM cleaned)
SELECT page_id, CAST(10 * ({S.any_in('hay', H.LEGAL_WORDS)}::INT + {S.any_in('hay', H.CONTACT_WORDS)}::INT + ({S.rm('hay', H.EMAIL)})::INT + ({S.rm('hay', H.PHONE)})::INT) AS BIGINT) AS trust FROM hay""")
def _(spark, sf):
    return rich(spark, sf).select("page_id", H.trust_signals(c("html")).cast("long").alias("trust"))


@query("html_social_presence", "HTML-22", f"""{FACTS}, h AS (SELECT page_id, lower(array_to_string({S.hrefs('clean')}, ' ')) AS h FROM cleaned)
SELECT page_id, {', '.join(f"contains(h, '{p}') AS {p}" for p in H.SOCIAL_PLATFORMS)} FROM h""")
def _(spark, sf):
    return rich(spark, sf).select("page_id", H.social_presence(c("html")).alias("s")).select("page_id", "s.*")


# ---------------------------------------------------------------- links

@query("link_hrefs", "LNK-1", f"{FACTS} SELECT page_id, CAST(len({S.hrefs('clean')}) AS BIGINT) AS links, md5(array_to_string({S.hrefs('clean')}, {PIPE})) AS digest FROM cleaned")
def _(spark, sf):
    h = rich(spark, sf).select("page_id", H.hrefs(c("html")).alias("h"))
    return h.select("page_id", F.size("h").cast("long").alias("links"), F.md5(F.array_join("h", "|")).alias("digest"))


@query("link_data_hrefs", "LNK-2", f"{RICH} SELECT page_id, CASE WHEN page_id % 6 = 0 THEN '/spa/' || page_id ELSE '' END AS links FROM rich_pages")
def _(spark, sf):
    return rich(spark, sf).select("page_id", join_text(H.data_hrefs(c("html"))).alias("links"))


MARKDOWN = "text || ' [a](/rel/' || CAST(doc_id AS STRING) || ') and ( [b] (mailto:x) https://ex.org/p' || CAST(doc_id AS STRING) || ') [c]( http://c.org/d )'"


@query("link_markdown", "LNK-3", f"""WITH d AS (SELECT doc_id, {MARKDOWN} AS md FROM documents)
SELECT doc_id, CASE WHEN length(md) < 100 THEN '' ELSE array_to_string(list_concat(
  list_filter({S.rall('md', '''\\]\\s*\\(\\s*([^)\\s]+)\\s*\\)''', 1)}, lambda u: starts_with(u, 'http') OR starts_with(u, '/')),
  list_transform({S.rall('md', '''https?://[^\\s\\]\\)"'>]+''', 0)}, lambda u: string_split(string_split(u, ')')[1], ']')[1])), {PIPE}) END AS links FROM d""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", join_text(H.markdown_links(F.expr(MARKDOWN))).alias("links"))


JS = "SPLIT(REPLACE(url, '?', ' ') || ' /a mailto:b #c http:x', ' ')"


@query("link_rendered", "LNK-4", f"""SELECT page_id, array_to_string(list_filter(string_split(replace(url, '?', ' ') || ' /a mailto:b #c http:x', ' '),
  lambda u: starts_with(u, 'http') OR starts_with(u, '/')), {PIPE}) AS links FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", join_text(H.js_links(F.expr(JS))).alias("links"))


@query("link_merged", "LNK-5", f"""{FACTS} SELECT page_id, array_to_string(list_sort(list_distinct(list_concat({S.hrefs('clean')},
  CASE WHEN page_id % 6 = 0 THEN ['/spa/' || page_id] ELSE [] END, ['/js', '#top']))), {PIPE}) AS links FROM cleaned""")
def _(spark, sf):
    h = c("html")
    merged = H.merge_links(H.hrefs(h), H.data_hrefs(h), F.array(F.lit("/js"), F.lit("#top")), F.lit(None).cast("array<string>"))
    return rich(spark, sf).select("page_id", join_text(F.array_sort(merged)).alias("links"))


LINK_SQL = f"""{FACTS}, raw AS (SELECT page_id, url, unnest(list_distinct({S.hrefs('clean')})) AS href FROM cleaned),
resolved AS (SELECT page_id, url, href, {S.resolve('url', 'href')} AS link FROM raw WHERE href <> ''),
linked AS (SELECT page_id, url, link, list_filter({S.list_of(U.EXCLUDED)}, lambda p: contains(lower(link), p))[1] AS excluded_by, {S.host('url')} AS site,
  {S.host('link')} IN ({S.host('url')}, regexp_replace({S.host('url')}, '^www\\.', ''), 'www.' || regexp_replace({S.host('url')}, '^www\\.', '')) AS inside FROM resolved),
links AS (SELECT *, inside AND excluded_by IS NULL AS internal, {S.normalize('url')} AS src, CASE WHEN inside THEN {S.normalize('link')} END AS dst FROM linked)"""


@query("link_filter", "LNK-6", f"""{LINK_SQL} SELECT page_id, CAST(count(*) FILTER (internal) AS BIGINT) AS valid, CAST(count(*) FILTER (NOT internal) AS BIGINT) AS filtered,
  md5(coalesce(string_agg(link, '|' ORDER BY link) FILTER (internal), '')) AS digest FROM links GROUP BY page_id""")
def _(spark, sf):
    f = links.filter_links(links.page_links(rich(spark, sf)))
    return f.select("page_id", F.size("valid_links").cast("long").alias("valid"), "filtered", F.md5(join_text(c("valid_links"))).alias("digest"))


@query("link_edges", "LNK-7", f"{LINK_SQL} SELECT DISTINCT src, dst FROM links WHERE internal AND src <> dst")
def _(spark, sf):
    return links.link_edges(links.page_links(rich(spark, sf)))


@query("crawl_stats", "LNK-8", f"""{LINK_SQL}, p AS (SELECT site, count(*) AS n, sum(len(json_ld)) AS b, count(*) FILTER (len(json_ld) > 0) AS w FROM tagged GROUP BY site),
f AS (SELECT site, count(*) FILTER (NOT internal) AS f FROM links GROUP BY site),
e AS (SELECT site, count(*) AS d, count(*) - count(DISTINCT dst) AS dup FROM (SELECT DISTINCT site, page_id, dst FROM links WHERE internal AND src <> dst) GROUP BY site)
SELECT site, CAST(n AS BIGINT) AS pages_crawled, CAST(coalesce(d, 0) AS BIGINT) AS links_discovered, CAST(coalesce(f, 0) AS BIGINT) AS links_filtered,
  CAST(coalesce(dup, 0) AS BIGINT) AS links_duplicate, CAST(b AS BIGINT) AS jsonld_blocks, CAST(w AS BIGINT) AS pages_with_jsonld
FROM p LEFT JOIN f USING (site) LEFT JOIN e USING (site)""")
def _(spark, sf):
    return links.crawl_stats(facts(spark, sf))


# Crawls over the given pages: one for every third host, which has a neighbour host attached; two start urls, one of them without a page.
CRAWLS = f"""SELECT site, 'x' AS kind, first_url, neighbour FROM (SELECT site, first_url, lead(site) OVER (ORDER BY site) AS neighbour, row_number() OVER (ORDER BY site) AS turn
  FROM (SELECT {S.host('url')} AS site, min(url) AS first_url FROM pages GROUP BY {S.host('url')})) WHERE turn % 3 = 1"""


def crawls(spark, sf):
    hosts = table(spark, sf, "pages").select(U.host(c("url")).alias("site"), "url").groupBy("site").agg(F.min("url").alias("first_url"))
    numbered = with_row_number(hosts, ["site"], "turn")
    after = numbered.select((c("turn") - 1).alias("turn"), c("site").alias("neighbour"))
    return numbered.join(after, "turn", "left").filter("turn % 3 = 1").select(
        F.concat(F.lit("crawl of "), "site").alias("site"), F.array("first_url", F.concat(F.lit("https://"), "site", F.lit("/never-stored"))).alias("start_urls"),
        F.when(c("neighbour").isNotNull(), F.array(F.lit(" "), F.concat(F.lit("www."), "neighbour"))).alias("attached"))


def bare(host: str) -> str:
    return f"regexp_replace({host}, '^www\\.', '')"


SCOPED = f"""{FACTS}, crawl AS ({CRAWLS}), hosts AS (SELECT 'crawl of ' || site AS crawl, {bare('site')} AS h FROM crawl UNION SELECT 'crawl of ' || site, {bare('neighbour')} FROM crawl WHERE neighbour IS NOT NULL),
located AS (SELECT t.*, coalesce(crawl, site) AS crawl FROM tagged t LEFT JOIN hosts ON h = {bare('site')}),
raw AS (SELECT page_id, url, crawl, site, unnest(list_distinct({S.hrefs('clean')})) AS href FROM located),
resolved AS (SELECT page_id, url, crawl, site, {S.resolve('url', 'href')} AS link FROM raw WHERE href <> ''),
judged AS (SELECT r.*, {S.host('link')} AS link_host, list_filter({S.list_of(U.EXCLUDED)}, lambda p: contains(lower(link), p))[1] IS NULL AS allowed FROM resolved r),
links AS (SELECT page_id, url, crawl, link, allowed AND (EXISTS (SELECT 1 FROM hosts WHERE hosts.crawl = judged.crawl AND h = {bare('link_host')})
  OR (NOT EXISTS (SELECT 1 FROM hosts WHERE hosts.crawl = judged.crawl) AND {bare('link_host')} = {bare('site')})) AS internal FROM judged),
edges AS (SELECT DISTINCT crawl, {S.normalize('url')} AS src, {S.normalize('link')} AS dst FROM links WHERE internal)"""


@query("link_filter_scoped", "LNK-6", f"""{SCOPED} SELECT page_id, crawl AS site, CAST(count(*) FILTER (internal) AS BIGINT) AS valid, CAST(count(*) FILTER (NOT internal) AS BIGINT) AS filtered FROM links GROUP BY page_id, crawl""")
def _(spark, sf):
    f = links.filter_links(links.page_links(facts(spark, sf), crawls=crawls(spark, sf)))
    return f.select("page_id", "site", F.size("valid_links").cast("long").alias("valid"), "filtered")


@query("link_edges_scoped", "LNK-7", f"{SCOPED} SELECT DISTINCT src, dst FROM edges WHERE src <> dst")
def _(spark, sf):
    return links.link_edges(links.page_links(facts(spark, sf), crawls=crawls(spark, sf)))


@query("crawl_stats_scoped", "LNK-8", f"""{SCOPED}, p AS (SELECT crawl, count(*) AS n, sum(len(json_ld)) AS b, count(*) FILTER (len(json_ld) > 0) AS w FROM located GROUP BY crawl),
f AS (SELECT crawl, count(*) FILTER (NOT internal) AS f FROM links GROUP BY crawl),
e AS (SELECT crawl, count(*) AS d, count(*) - count(DISTINCT dst) AS dup FROM (SELECT DISTINCT crawl, page_id, {S.normalize('link')} AS dst FROM links WHERE internal AND {S.normalize('link')} <> {S.normalize('url')}) GROUP BY crawl)
SELECT crawl AS site, CAST(n AS BIGINT) AS pages_crawled, CAST(coalesce(d, 0) AS BIGINT) AS links_discovered, CAST(coalesce(f, 0) AS BIGINT) AS links_filtered,
  CAST(coalesce(dup, 0) AS BIGINT) AS links_duplicate, CAST(b AS BIGINT) AS jsonld_blocks, CAST(w AS BIGINT) AS pages_with_jsonld
FROM p LEFT JOIN f USING (crawl) LEFT JOIN e USING (crawl)""")
def _(spark, sf):
    return links.crawl_stats(facts(spark, sf), crawls(spark, sf))


def bfs_sql(head: str, levels: int, cap: int = 500) -> str:
    """Levels unrolled, from CTEs ``edges`` (site, src, dst) and ``v0``: each keeps a site's first pages, by position of the linking page, then by url."""
    out = [head]
    for i in range(1, levels + 1):
        out.append(f"""n{i} AS (SELECT v.site, dst AS url, min(position) AS via FROM v{i-1} v JOIN edges e ON e.site = v.site AND url = src AND depth = {i-1}
  WHERE NOT EXISTS (SELECT 1 FROM v{i-1} w WHERE w.site = v.site AND w.url = dst) GROUP BY v.site, dst)""")
        out.append(f"""v{i} AS MATERIALIZED (SELECT * FROM v{i-1} UNION ALL SELECT * FROM (SELECT site, url, {i} AS depth,
  (SELECT count(*) FROM v{i-1} w WHERE w.site = n.site) + row_number() OVER (PARTITION BY site ORDER BY via, url) AS position FROM n{i} n) WHERE position <= {cap})""")
    return ",\n".join(out) + f"\nSELECT site, url, depth, position FROM v{levels}"


SUPPLY = """SELECT 'crawl' || CAST(l_suppkey % 3 AS STRING) AS site, 'p' || CAST(l_partkey AS STRING) AS src, 's' || CAST(l_suppkey AS STRING) AS dst FROM lineitem WHERE l_linenumber < 4"""


@query("crawl_frontier", "LNK-9", bfs_sql(f"""WITH half AS (SELECT DISTINCT * FROM ({SUPPLY})), edges AS MATERIALIZED (SELECT site, src, dst FROM half UNION SELECT site, dst, src FROM half),
v0 AS (SELECT site, url, 0 AS depth, row_number() OVER (PARTITION BY site ORDER BY url) AS position FROM (SELECT DISTINCT site, src AS url FROM half WHERE src IN ('p1', 'p2')))""", 8))
def _(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    half = spark.sql(SUPPLY).distinct()
    edges = half.unionByName(half.select("site", c("dst").alias("src"), c("src").alias("dst")))
    return breadth_first(edges, half.filter("src IN ('p1', 'p2')").select("site", c("src").alias("url")), 500)


# Further links of a page, as a rendered page would show them: a host's n-th page, by url, links to its pages 2n and 2n + 1.
@query("crawl_frontier_pages", "LNK-9", bfs_sql(f"""{SCOPED.replace('edges AS (', 'anchors AS (')}, real AS (SELECT DISTINCT crawl AS site, {S.normalize('url')} AS url FROM located),
turns AS (SELECT site, crawl, url, row_number() OVER (PARTITION BY site ORDER BY url, page_id) AS n FROM located),
all_edges AS (SELECT crawl, src, dst FROM anchors UNION SELECT a.crawl, {S.normalize('a.url')}, {S.normalize('b.url')} FROM turns a JOIN turns b ON a.site = b.site AND b.n IN (2 * a.n, 2 * a.n + 1)),
edges AS MATERIALIZED (SELECT crawl AS site, src, dst FROM all_edges JOIN real ON real.site = crawl AND real.url = dst WHERE src <> dst),
v0 AS MATERIALIZED (SELECT 'crawl of ' || site AS site, {S.normalize('first_url')} AS url, 0 AS depth, CAST(1 AS BIGINT) AS position FROM crawl)""", 10))
def _(spark, sf):
    scope, f = crawls(spark, sf), facts(spark, sf)
    turns = number_in_groups(f.select("page_id", "url", "site"), ["site"], [c("url"), c("page_id")], "n")
    shown = turns.select("site", F.floor(c("n") / 2).alias("n"), c("url").alias("to")).groupBy("site", "n").agg(F.collect_list("to").alias("shown"))
    more = f.join(turns.join(shown, ["site", "n"]).select("page_id", "shown"), "page_id", "left")
    return links.crawl_frontier(links.page_links(more, c("shown"), crawls=scope), f, scope)


EXTERNAL = f"list_filter({S.hrefs('b')}, lambda z: starts_with(z, 'http') AND NOT contains(z, {S.netloc('url')}))"


@query("link_external", "LNK-10", f"{RICH}, d AS (SELECT page_id, url, {S.drop('html', S.CHROME)} AS b FROM rich_pages) SELECT page_id, CAST(len({EXTERNAL}) AS BIGINT) AS external FROM d")
def _(spark, sf):
    return rich(spark, sf).select("page_id", H.external_links(c("html"), c("url")).cast("long").alias("external"))


@query("site_url_sample", "LNK-11", f"""WITH m AS (SELECT DISTINCT {S.host('url')} AS site, url FROM pages WHERE page_id % 3 <> 0 AND {S.host('url')} NOT LIKE 'www.%'),
l AS (SELECT DISTINCT {S.host('url')} AS site, {S.normalize('url')} AS url FROM pages), s AS (SELECT DISTINCT {S.host('url')} AS site FROM pages),
a AS (SELECT site, 'https://' || site AS url, 0 AS r FROM s UNION ALL SELECT site, url, 1 FROM m UNION ALL SELECT site, url, 1 FROM l WHERE site NOT IN (SELECT site FROM m)),
u AS (SELECT site, url, min(r) AS r FROM a GROUP BY site, url)
SELECT site, url FROM u QUALIFY row_number() OVER (PARTITION BY site ORDER BY r, url) <= 5""")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", U.host(c("url")).alias("site"))
    mapped = p.filter("page_id % 3 <> 0 AND NOT startswith(site, 'www.')").select("site", "url")
    crawled = p.select("site", U.normalize_url(c("url")).alias("url"))
    homes = p.select("site").distinct().withColumn("home", F.concat(F.lit("https://"), c("site")))
    return links.site_urls(mapped, crawled, homes, 5)


GRADED = "SELECT page_id, CAST(page_id * 7 % 101 AS INTEGER) AS total_score, CASE WHEN page_id % 3 = 0 THEN 'A' ELSE 'C' END AS grade FROM pages"
GRAPH_SQL = f"""{FACTS}, sc AS ({GRADED}), g AS (SELECT page_id, site, url, title, {S.group('url')} AS grp FROM facts),
shown AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY site, grp ORDER BY page_id) <= 2)"""


def scored(spark, sf):
    table(spark, sf, "pages").createOrReplaceTempView("pages")
    return spark.sql(GRADED)


@query("site_graph_nodes", "LNK-12", f"""{GRAPH_SQL}
SELECT DISTINCT site, site AS id, upper(site) AS label, 35 AS size, '#0f172a' AS color FROM g
UNION ALL SELECT DISTINCT site, 'group_' || grp, upper(grp), 25, '#cbd5e1' FROM g
UNION ALL SELECT site, url, {label_sql('title', 'url', 'site')} || chr(10) || '[' || grade || ']', 12,
  CASE WHEN total_score >= 95 THEN '#10b981' WHEN total_score >= 50 THEN '#FFA500' ELSE '#FF4B4B' END FROM shown JOIN sc USING (page_id)""")
def _(spark, sf):
    return links.site_graph(facts(spark, sf), scored(spark, sf), 2)[0]


@query("site_graph_edges", "LNK-12", f"""{GRAPH_SQL} SELECT DISTINCT site, site AS src, 'group_' || grp AS dst FROM g UNION ALL SELECT DISTINCT site, 'group_' || grp, url FROM shown""")
def _(spark, sf):
    return links.site_graph(facts(spark, sf), scored(spark, sf), 2)[1]


@query("link_duplicate_journal", "LNK-14", f"""{LINK_SQL}, e AS (SELECT DISTINCT site, page_id, dst FROM links WHERE internal AND src <> dst),
n AS (SELECT site, dst AS url, CAST(count(*) - 1 AS BIGINT) AS occurrences, {S.path('dst')} AS path FROM e GROUP BY site, dst HAVING count(*) > 1)
SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY site ORDER BY occurrences DESC, url) <= 200""")
def _(spark, sf):
    return links.duplicate_journal(links.page_links(rich(spark, sf)))


@query("link_filtered_journal", "LNK-15", f"""{LINK_SQL}, h AS (SELECT site, excluded_by AS pattern, link AS url FROM links WHERE excluded_by IS NOT NULL)
SELECT site, pattern, url, CAST(count(*) OVER (PARTITION BY site, pattern) AS BIGINT) AS links FROM h QUALIFY row_number() OVER (PARTITION BY site, pattern ORDER BY url) <= 100""")
def _(spark, sf):
    return links.filtered_journal(links.page_links(rich(spark, sf))).select("site", "pattern", "url", "links")


@query("api_subdomains", "LNK-16", f"""{RICH}, b AS (SELECT {S.host('url')} AS site, replace({S.host('url')}, 'www.', '') AS bare, html FROM rich_pages),
h AS (SELECT site, bare, lower(unnest({S.rall('html', '''https?://([a-zA-Z0-9\\-]+\\.[a-zA-Z0-9\\-.]+)[/"'\\s]''', 1)})) AS x FROM b),
f AS (SELECT site, bare, lower(unnest({S.rall('html', '''(?i)(?:fetch|axios|api_url|apiUrl|API_BASE|baseURL|endpoint)[^"']*["']https?://([^/"']+)''', 1)})) AS x FROM b),
sniffed AS (SELECT DISTINCT site, x FROM h WHERE x LIKE '%.' || bare AND length(x) - length(replace(x, '.', '')) = length(bare) - length(replace(bare, '.', '')) + 1 AND x <> site AND x <> 'www.' || bare
  UNION SELECT DISTINCT site, x FROM f WHERE contains(x, bare)),
guess AS (SELECT DISTINCT site, unnest(['api.', 'backend.', 'data.', 'rest.', 'app.']) || bare AS x, unnest([1, 2, 3, 4, 5]) AS r FROM b)
SELECT site, x AS candidate, 'sniffer' AS source, 0 AS rank FROM sniffed UNION ALL
SELECT site, x, 'deduction', r FROM guess g WHERE NOT EXISTS (SELECT 1 FROM sniffed s WHERE s.site = g.site AND s.x = g.x)""")
def _(spark, sf):
    return links.api_subdomains(rich(spark, sf))


# ---------------------------------------------------------------- categories

def category_sql() -> str:
    text = f"lower({S.path('url')}) || ' ' || lower(title) || ' ' || lower(h1)"
    segs = f"list_filter({S.segments('lower(' + S.path('url') + ')')}, lambda s: s NOT IN ('fr','en','de','es','www'))"
    whens = " ".join(f"WHEN {S.any_in('t', ws)} THEN {S.q(name)}" for name, ws in categories.CATEGORIES.items())
    first = S.title_case("replace(replace(seg, '-', ' '), '_', ' ')")
    return (f"(SELECT *, CASE {whens} WHEN seg IS NOT NULL THEN {first} ELSE 'Pages statiques' END AS category "
            f"FROM (SELECT *, {text} AS t, ({segs})[1] AS seg FROM facts))")


@query("page_categories", "CAT-1", f"{FACTS} SELECT page_id, category FROM {category_sql()}")
def _(spark, sf):
    return categories.categorize(facts(spark, sf)).select("page_id", "category")


@query("url_pattern_groups", "CAT-2", f"""{FACTS}, g AS (SELECT site, page_id, url, {S.group('url')} AS grp FROM facts)
SELECT site, grp AS "group", CAST(count(*) AS BIGINT) AS count, array_to_string(list(url ORDER BY page_id)[1:3], {PIPE}) AS samples FROM g GROUP BY site, grp""")
def _(spark, sf):
    return categories.pattern_groups(facts(spark, sf), 3).withColumn("samples", join_text(c("samples")))


@query("crawl_journal", "CAT-3", f"""{FACTS}, sc AS ({GRADED}) SELECT site, category, CAST(count(*) OVER (PARTITION BY site, category) AS BIGINT) AS category_size, page_id, grade,
  trim(title) AS shown_title, CASE WHEN {S.path('url')} = '' THEN '/' ELSE {S.path('url')} END AS path FROM {category_sql()} JOIN sc USING (page_id)""")
def _(spark, sf):
    return categories.crawl_journal(facts(spark, sf), scored(spark, sf))


# ---------------------------------------------------------------- tokens and carbon

TOKEN_SQL = f"""WITH src AS (SELECT page_id, url, html FROM pages),
d AS (SELECT page_id, {S.rcount('text', eco.PRE_TOKEN)} AS tokens_dirty FROM ({S.visible_staged('src', S.ECO)})),
m AS (SELECT page_id, {S.drop('html', S.ECO)} AS k, main FROM {main_sql('html')}),
parts AS (SELECT page_id, array_to_string(list_filter([{S.text_of(S.element('k', 'title'))}, {S.squeeze(S.decode(S.rr(S.element('k', 'h1'), S.TAG, ' ')))}, main], lambda x: x <> ''), ' ') AS p FROM m),
t AS (SELECT page_id, CAST(tokens_dirty AS BIGINT) AS tokens_dirty,
  CAST({S.rcount(S.squeeze("p || ' ' || substring(p, 1, greatest(100, length(p) // 10))"), eco.PRE_TOKEN)} AS BIGINT) AS tokens_clean FROM parts JOIN d USING (page_id)),
saved AS (SELECT *, greatest(0, tokens_dirty - tokens_clean) AS tokens_saved, greatest(0, tokens_dirty - tokens_clean) / 1000.0::DOUBLE * 0.0004::DOUBLE AS kwh,
  greatest(0, tokens_dirty - tokens_clean) / 1000.0::DOUBLE * 0.0004::DOUBLE * 475 AS co2 FROM t)"""


def tokens(spark, sf):
    return eco.page_tokens(table(spark, sf, "pages")).drop("html")


@query("page_tokens", "ECO-1 ECO-2", f"{TOKEN_SQL} SELECT page_id, tokens_dirty, tokens_clean FROM t")
def _(spark, sf):
    return tokens(spark, sf).select("page_id", "tokens_dirty", "tokens_clean")


@query("token_savings", "ECO-3", f"{TOKEN_SQL} SELECT page_id, tokens_saved, CAST(printf('%.6f', CAST(kwh AS DOUBLE)) AS DOUBLE) AS kwh_saved, CAST(printf('%.2f', CAST(co2 AS DOUBLE)) AS DOUBLE) AS co2_saved FROM saved")
def _(spark, sf):
    return eco.savings(tokens(spark, sf)).select("page_id", "tokens_saved", "kwh_saved", "co2_saved")


@query("token_savings_annual", "ECO-4", f"""{TOKEN_SQL} SELECT page_id, tokens_saved * 36500000 AS annual_tokens_saved, CAST(printf('%.2f', CAST(kwh * 36500000 AS DOUBLE)) AS DOUBLE) AS annual_kwh_saved,
  CAST(printf('%.2f', CAST(co2 * 36500000 AS DOUBLE)) AS DOUBLE) AS annual_co2_grammes FROM saved""")
def _(spark, sf):
    return eco.annualize(eco.savings(tokens(spark, sf))).select("page_id", "annual_tokens_saved", "annual_kwh_saved", "annual_co2_grammes")


@query("token_savings_corpus", "ECO-4", f"""{TOKEN_SQL} SELECT CAST(count(*) AS BIGINT) AS pages, CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved,
  CAST(sum(tokens_saved) * 36500 AS BIGINT) AS annual_tokens_saved, CAST(printf('%.2f', CAST(CAST(sum(tokens_saved) AS BIGINT) / 1000.0::DOUBLE * 0.0004::DOUBLE * 36500 AS DOUBLE)) AS DOUBLE) AS annual_kwh_saved,
  CAST(printf('%.2f', CAST(CAST(sum(tokens_saved) AS BIGINT) / 1000.0::DOUBLE * 0.0004::DOUBLE * 475 * 36500 AS DOUBLE)) AS DOUBLE) AS annual_co2_grammes FROM saved""")
def _(spark, sf):
    return eco.corpus_savings(eco.savings(tokens(spark, sf)))


@query("token_savings_monthly", "ECO-5", f"""{TOKEN_SQL}, days AS (SELECT unnest({eco.DAYS_CUMULATED}) AS days, unnest(range(1, 13)) AS month),
r AS (SELECT *, CAST(printf('%.6f', CAST(kwh AS DOUBLE)) AS DOUBLE) AS k, CAST(printf('%.2f', CAST(co2 AS DOUBLE)) AS DOUBLE) AS g FROM saved)
SELECT page_id, CAST(month AS INTEGER) AS month, tokens_saved * 100000 * days AS cumul_tokens, CAST(printf('%.2f', CAST(k * 100000 * days AS DOUBLE)) AS DOUBLE) AS cumul_kwh, CAST(printf('%.2f', CAST(g * 100000 * days AS DOUBLE)) AS DOUBLE) AS cumul_gco2,
  CAST(printf('%.2f', CAST(g * 100000 * 365 / 1000000.0::DOUBLE AS DOUBLE)) AS DOUBLE) AS annual_co2_tonnes, CAST(printf('%.1f', CAST(g * 100000 * 365 / 1000000.0::DOUBLE AS DOUBLE)) AS DOUBLE) AS flights, CAST(printf('%.2f', CAST(k * 100000 * 365 / 1000.0::DOUBLE AS DOUBLE)) AS DOUBLE) AS annual_mwh
FROM r CROSS JOIN days""")
def _(spark, sf):
    m = eco.monthly_projection(eco.savings(tokens(spark, sf)))
    return m.select("page_id", "month", "cumul_tokens", "cumul_kwh", "cumul_gco2", "annual_co2_tonnes", "flights", "annual_mwh")



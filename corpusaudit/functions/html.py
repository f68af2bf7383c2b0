"""Page facts read from raw HTML with regular expressions.

Scripts, styles and comments are removed first, so markup inside them is never counted.
Every function takes the raw ``html`` column; ``page_facts`` in the operators shares the
cleaned text and the tag list between facts instead of cleaning once per fact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, cut, decode_entities, falsy, let, squeeze, strip, text_or, title_case
from .urls import LANGUAGES, host, path, path_segments

COMMENT = r"<!--.*?-->"
CODE_TAGS = ("script", "style")
CHROME_TAGS = ("script", "style", "nav", "footer", "header")
ECO_TAGS = ("script", "style", "noscript")
TAG = r"</?[A-Za-z!?][^>]*>"
TAG_NAME = r"<([A-Za-z][A-Za-z0-9:-]*)"
ANCHOR_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
DATA_HREF = r"""(?is)<[a-z][^>]*?\sdata-href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
META_DESCRIPTION = r"""(?s)<(?i:meta)\b[^>]*\b(?i:name)\s*=\s*["']description["'][^>]*>"""
CONTENT_DIV = r"""(?is)<div\b[^>]*\bclass\s*=\s*["'][^"']*(?:content|main|article)[^"']*["'][^>]*>"""
INPUT_BUTTON = r"""(?is)<input\b[^>]*\btype\s*=\s*["']?[^"'>\s]*(?:submit|button)"""
BREADCRUMB = r"""(?is)<nav\b[^>]*\baria-label\s*=\s*["'][^"']*breadcrumb"""

# Tags counted as page structure.
STRUCTURE_TAGS = ["h1", "h2", "h3", "article", "section", "form", "table"]

# Separators between a page title and a brand, in test order.
TITLE_SEPARATORS = [" - ", " | ", " : ", " — ", " – ", " · "]

# Text markers of client-side frameworks and the signal each one stands for.
SPA_TEXT = [
    ("react", "React (texte)"),
    ("__next", "Next.js (texte)"),
    ("nuxt", "Nuxt (texte)"),
    ("_nuxt", "Nuxt (texte)"),
    ("vue", "Vue (texte)"),
    ("angular", "Angular (texte)"),
    ("data-reactroot", "React (data-reactroot)"),
    ('<div id="root">', "React (div#root)"),
    ('<div id="app">', "Vue (div#app)"),
]

# Crawler names with a meta tag of their own.
ROBOT_METAS = ["googlebot", "gptbot", "claudebot"]

# Trust markers searched in the lower-cased text and links of a home page.
LEGAL_WORDS = ["mentions", "legal", "légal", "confidentialité", "privacy", "terms", "conditions", "cgv", "cgu",
               "mentions-legales"]
CONTACT_WORDS = ["contact", "about", "propos", "nous-contacter", "a-propos"]
EMAIL = r"(?:mailto:)?[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = (r"(?:\+33|0)[\s.-]?[1-9](?:[\s.-]?\d{2}){4}|"
         r"\+?\d{1,4}[\s.-]?\(?\d{2,3}\)?[\s.-]?\d{2}[\s.-]?\d{2}[\s.-]?\d{2}")

# Social platforms looked for in links.
SOCIAL_PLATFORMS = ["linkedin", "twitter", "facebook", "youtube", "instagram"]

# Texts of the missing-element list.
MISSING = ["Meta description manquante", "H1 manquant", "JSON-LD manquant", "Peu de H2"]


def drop_pattern(tags) -> str:
    """Pattern of comments and of whole elements with the given names."""
    return "(?is)" + "|".join([COMMENT] + [rf"<{t}(?:\s[^>]*)?>.*?</{t}\s*>" for t in tags])


def drop_elements(html: Column, tags=CODE_TAGS) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), drop_pattern(tags), " ")


def tag_names(clean: Column) -> Column:
    """Lower-cased name of every opening tag, in document order."""
    return F.transform(F.regexp_extract_all(clean, F.lit(TAG_NAME), F.lit(1)), F.lower)


def count_tags(tags: Column, *names: str) -> Column:
    left = tags
    for n in names:
        left = F.array_remove(left, n)
    return F.size(tags) - F.size(left)


def element_pattern(tag: str) -> str:
    return rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"


def element(clean: Column, tag: str) -> Column:
    """Inner HTML of the first element with the given name, empty if there is none."""
    return F.regexp_extract(clean, element_pattern(tag), 1)


def attribute(tag_text: Column, name: str) -> Column:
    """Value of an attribute inside the text of one tag; empty if absent."""
    raw = F.regexp_extract(tag_text, rf"""(?is)\b{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return decode_entities(unquote(raw))


def unquote(c: Column) -> Column:
    return F.regexp_replace(c, """^["']|["']$""", "")


def text_of(inner: Column, sep: str = "") -> Column:
    """Text of a piece of HTML: tags removed, entities decoded, trimmed."""
    return strip(decode_entities(F.regexp_replace(inner, TAG, sep)))


def tight_text(inner: Column) -> Column:
    """Text of an element with white space around tags removed."""
    return strip(decode_entities(F.regexp_replace(inner, rf"\s*{TAG}\s*", "")))


def structure_of(tags: Column) -> Column:
    return F.struct(*[count_tags(tags, t).alias(t) for t in STRUCTURE_TAGS])


def dom_structure(html: Column) -> Column:
    """Counts of the structure tags."""
    return structure_of(tag_names(drop_elements(html)))


def semantics_of(clean: Column, tags: Column, jsonld_types: Column | None = None) -> Column:
    types = jsonld_types if jsonld_types is not None else F.array().cast("array<string>")
    return F.struct(
        count_tags(tags, "p").alias("p"),
        count_tags(tags, "ul", "ol").alias("lists"),
        count_tags(tags, "img").alias("images"),
        F.when(count_tags(tags, "form") > 0, 1).otherwise(0).alias("has_form"),
        (count_tags(tags, "button") + F.regexp_count(clean, F.lit(INPUT_BUTTON))).alias("buttons"),
        F.array_sort(F.array_distinct(types)).alias("jsonld_types"),
    )


def semantic_features(html: Column, jsonld_types: Column | None = None) -> Column:
    """Counts of paragraphs, lists, images, buttons, whether a form exists, and the given JSON-LD types."""
    clean = drop_elements(html)
    return semantics_of(clean, tag_names(clean), jsonld_types)


def title(html: Column) -> Column:
    return text_of(element(drop_elements(html), "title"))


def h1(html: Column) -> Column:
    return text_of(element(drop_elements(html), "h1"))


def meta_description(html: Column) -> Column:
    return strip(attribute(F.regexp_extract(drop_elements(html), META_DESCRIPTION, 0), "content"))


def heads(clean: Column, url: Column) -> dict[str, Column]:
    """Columns to add in this order to cleaned HTML: raw title, h1, description and readable title (of the two before)."""
    return {"_raw_title": text_of(element(clean, "title")), "h1": text_of(element(clean, "h1")),
            "description": strip(attribute(F.regexp_extract(clean, META_DESCRIPTION, 0), "content")),
            "title": clean_title(F.col("_raw_title"), F.col("h1"), url)}


def counts(html: Column) -> Column:
    tags = tag_names(drop_elements(html))
    return F.struct(count_tags(tags, "h2").alias("h2_count"), count_tags(tags, "ul", "ol").alias("lists_count"))


def clean_title(title_: Column, h1_: Column, url: Column) -> Column:
    """Readable page title without the brand part, from h1, title or the last path segment."""
    text = F.when(F.length(h1_) > 10, h1_).when(F.length(title_) > 5, title_).otherwise(F.lit(""))
    source = F.struct(text.alias("text"), F.split(host(url), r"\.")[0].alias("brand"))

    def useful(t: Column, brand: Column) -> Column:
        brand_only = lambda sq: sq.contains(brand) & (F.length(sq) < F.length(brand) + 5)
        return (F.length(t) >= 3) & ~let(F.regexp_replace(F.lower(t), "[ -]", ""), brand_only)

    def longest_part(s: Column) -> Column:
        # Only the first separator present is applied; the longest useful part wins, the earliest on ties.
        sep = F.coalesce(*[F.when(s["text"].contains(x), F.lit(rf"\Q{x}\E")) for x in TITLE_SEPARATORS])
        parts = F.filter(F.transform(F.split(s["text"], sep), strip), lambda t: useful(t, s["brand"]))
        longest = F.array_max(F.transform(parts, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))))
        return F.struct(F.coalesce(longest["t"], s["text"]).alias("text"), s["brand"].alias("brand"))

    segs = F.filter(path_segments(path(url)), lambda s: ~s.isin([*LANGUAGES, "www"]))
    named = title_case(F.translate(F.try_element_at(segs, F.lit(-1)), "-_", "  "))
    chosen = let(let(source, longest_part), lambda s: F.when(useful(s["text"], s["brand"]), s["text"]))
    return F.coalesce(let(strip(F.coalesce(chosen, named)), lambda t: cut(t, 40)), F.lit("Accueil"))


def visible_text(html: Column, drop=CHROME_TAGS) -> Column:
    """Text without the given elements, white space collapsed."""
    return squeeze(decode_entities(F.regexp_replace(drop_elements(html, drop), TAG, " ")))


def open_element(clean: Column, tag: str, start: str) -> Column:
    """Inner HTML of the first element ``tag`` whose start tag matches ``start``, up to its own end tag; null if there is none.

    The text is cut before each start and end tag of that name, and a fold over the pieces follows the depth until the element closes; one that never
    closes goes on to the end. Pieces are counted, not joined, on the way, so the work is in proportion to the text.
    """
    rest = F.regexp_extract(clean, f"{start}(.*)", 1)
    pieces = F.split(rest, rf"(?i)(?=</?{tag}[\s/>])")
    opens = lambda p: p.rlike(rf"(?is)^<{tag}(?![^>]*/>)[\s>]")
    closes = lambda p: p.rlike(rf"(?i)^</{tag}[\s/>]")
    step = lambda s, p: F.when(s["depth"] == 0, s).otherwise(let(
        s["depth"] + F.when(opens(p), 1).when(closes(p), -1).otherwise(0),
        lambda d: F.struct(d.alias("depth"), (s["kept"] + F.when(d > 0, 1).otherwise(0)).alias("kept"))))
    kept = lambda ps: F.aggregate(ps, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("kept")), step, lambda s: s["kept"])
    return F.when(clean.rlike(start), let(pieces, lambda ps: F.array_join(F.slice(ps, F.lit(1), kept(ps)), "")))


def main_content(html: Column) -> Column:
    """Text of ``main``, else ``article``, else a content division, else the whole page; elements of the same name inside it belong to it."""
    start = lambda tag: rf"(?is)<{tag}(?:\s[^>]*)?>"
    inner = let(drop_elements(html, ECO_TAGS), lambda clean: F.coalesce(
        open_element(clean, "main", start("main")), open_element(clean, "article", start("article")), open_element(clean, "div", CONTENT_DIV), clean))
    return squeeze(decode_entities(F.regexp_replace(inner, TAG, " ")))


def script_types(html: Column) -> Column:
    """Declared type of every script element; ``(aucun type)`` where there is none."""
    attrs = F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)" + COMMENT, ""),
                                 F.lit(r"(?is)<script((?:\s[^>]*)?)>.*?</script"), F.lit(1))
    return F.transform(attrs, lambda a: text_or(strip(attribute(a, "type")), "(aucun type)"))


def spa_indicators(html: Column) -> Column:
    """Signs of client-side rendering as an array of (type, signal, pattern)."""
    low = F.lower(F.coalesce(html, F.lit("")))
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)" + COMMENT, "")

    def row(kind: str, signal: Column, pattern: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), signal.alias("signal"), pattern.alias("pattern"))

    texts = F.array_compact(F.array(*[F.when(low.contains(p), row("texte", F.lit(s), F.lit(p))) for p, s in SPA_TEXT]))

    def script_row(tag: Column) -> Column:
        src = attribute(tag, "src")
        s = F.lower(src)
        signal = F.when(s.contains("_nuxt"), "Nuxt").when(s.contains("__next"), "Next.js") \
            .when(s.contains("react") | s.contains("vue") | s.contains("angular"), "Framework JS")
        shown = F.concat(F.lit("src="), F.substring(src, 1, 60), F.lit("..."))
        return F.when(signal.isNotNull(), row("script", signal, shown))

    def link_row(tag: Column) -> Column:
        rel, href = F.lower(attribute(tag, "rel")), F.lower(attribute(tag, "href"))
        hit = rel.contains("modulepreload") & (href.contains(".js") | href.contains("_nuxt"))
        return F.when(hit, row("link", F.lit("ES Module"),
                               F.concat(F.lit("modulepreload "), F.substring(href, 1, 50), F.lit("..."))))

    scripts = F.regexp_extract_all(bare, F.lit(r"(?is)<script\s[^>]*>"), F.lit(0))
    links = F.regexp_extract_all(bare, F.lit(r"(?is)<link\s[^>]*>"), F.lit(0))
    modules = F.size(F.filter(scripts, lambda t: attribute(t, "type") == "module"))
    module_row = F.when(modules > 0, row("module", F.concat(modules.cast("string"), F.lit(" script(s) ES module")),
                                         F.lit("type=module")))
    return F.concat(texts, F.array_compact(F.transform(scripts, script_row)),
                    F.array_compact(F.transform(links, link_row)), F.array_compact(F.array(module_row)))


def named_meta(clean: Column, name: str) -> Column:
    """The first meta tag with the given name, empty if there is none."""
    return F.regexp_extract(clean, rf"""(?s)<(?i:meta)\b[^>]*\b(?i:name)\s*=\s*["']{name}["'][^>]*>""", 0)


def meta_robots(html: Column) -> Column:
    """Indexing directives of a page."""
    def named(tags: Column, name: str) -> Column:
        return F.try_element_at(F.filter(tags, lambda t: F.length(named_meta(t, name)) > 0), F.lit(1))

    def directives(tags: Column) -> Column:
        bots = F.array(*[F.struct(F.lit(b).alias("k"), attribute(named(tags, b), "content").alias("v")) for b in ROBOT_METAS])
        return F.struct(F.coalesce(F.lower(attribute(named(tags, "robots"), "content")), F.lit("")).alias("content"),
                        F.map_from_entries(F.filter(bots, lambda e: e["v"].isNotNull())).alias("bots"))

    metas = F.regexp_extract_all(drop_elements(html), F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    return let(let(metas, directives), lambda d: F.struct(
        d["content"].contains("noindex").alias("noindex"),
        d["content"].contains("nofollow").alias("nofollow"),
        d["content"].alias("meta_content"),
        d["bots"].alias("ai_meta_tags"),
        (~d["content"].contains("noindex")).alias("indexable"),
    ))


def is_html(body: Column, ctype: Column) -> Column:
    """True where a response body is an HTML page."""
    text = strip(F.coalesce(body, F.lit("")))
    start = F.lower(F.substring(text, 1, 500))
    return (text != "") & (F.lower(F.coalesce(ctype, F.lit(""))).contains("text/html")
                           | start.startswith("<!") | start.contains("<html") | start.contains("<!doctype"))


def truncated_html(html: Column, n: int = 5120) -> Column:
    return F.struct(F.substring(html, 1, n).alias("html_content"), F.length(html).alias("html_full_size"))


def html_fallback(html: Column, url: Column) -> Column:
    """Stand-in WebPage JSON for a page without JSON-LD."""
    return let(drop_elements(html), lambda clean: _fallback_of(clean, url))


def _fallback_of(clean: Column, url: Column) -> Column:
    def elements(tag: str, of: Column = None) -> Column:
        return F.regexp_extract_all(clean if of is None else of, F.lit(element_pattern(tag)), F.lit(1))

    meta_tag = F.regexp_extract(clean, META_DESCRIPTION, 0)
    paragraphs = F.slice(F.regexp_extract_all(clean, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?:</p|<p[\s>]|$)"), F.lit(1)), 1, 2)
    from_text = F.when(F.size(paragraphs) > 0, F.array_join(F.transform(paragraphs, tight_text), " "))
    description = F.substring(F.when(meta_tag != "", attribute(meta_tag, "content")).otherwise(from_text), 1, 300)
    sections = F.transform(F.slice(elements("h2"), 1, 5), lambda x: F.substring(tight_text(x), 1, 100))
    lists = F.slice(F.regexp_extract_all(clean, F.lit(r"(?is)<(?:ul|ol)(?:\s[^>]*)?>(.*?)</(?:ul|ol)\s*>"), F.lit(1)), 1, 3)
    items = F.slice(F.flatten(F.transform(lists, lambda x: F.transform(
        F.slice(elements("li", x), 1, 10), lambda y: F.substring(tight_text(y), 1, 100)))), 1, 10)
    imgs = F.slice(F.regexp_extract_all(clean, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0)), 1, 5)
    pictures = F.filter(
        F.transform(imgs, lambda t: F.struct(
            attribute(t, "src").alias("url"), F.nullif(F.substring(attribute(t, "alt"), 1, 150), F.lit("")).alias("description"))),
        lambda s: (s["url"] != "") | s["description"].isNotNull())
    has_h1 = clean.rlike(element_pattern("h1"))
    return F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("WebPage").alias("@type"),
        url.alias("url"),
        F.struct(
            F.when(has_h1, F.substring(tight_text(element(clean, "h1")), 1, 150)).alias("name"),
            F.when(F.size(sections) > 0, sections).alias("sections"),
            F.when(F.size(items) > 0, items).alias("items"),
        ).alias("mainEntity"),
        description.alias("description"),
        F.when(F.size(imgs) > 0, pictures).alias("image"),
    ))


def node_label(title_: Column, url: Column, domain: Column) -> Column:
    """Short label of a page in the site graph."""
    head = strip(F.split(strip(F.coalesce(title_, F.lit(""))), r" [-|:] ")[0])
    last = F.element_at(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""), "/"), -1)
    named = title_case(strip(F.translate(last, "-_", "  ")))
    label = F.coalesce(let(head, lambda t: F.when(F.length(t) >= 4, t)), F.nullif(named, F.lit("")), text_or(domain, "Page"))
    return let(label, lambda t: cut(t, 22, "..", 20))


def brand_dna(title_: Column, h1_: Column, description: Column) -> Column:
    """Cleaned brand texts and their first 1,000 joined characters."""
    parts = [F.nullif(c, F.lit("")) for c in (title_, h1_, description)]
    blank = F.lit("")
    return F.struct(
        squeeze(F.coalesce(title_, blank)).alias("title"), squeeze(F.coalesce(h1_, blank)).alias("h1"),
        squeeze(F.coalesce(description, blank)).alias("meta"),
        squeeze(F.substring(F.concat_ws(" ", *parts), 1, 1000)).alias("raw_text"))


def missing_elements(description: Column, h1_: Column, has_structured_data: Column, h2_count: Column) -> Column:
    tests = [falsy(description), falsy(h1_), ~F.coalesce(has_structured_data, F.lit(False)),
             F.coalesce(h2_count, F.lit(0)) < 2]
    return F.array_compact(F.array(*[F.when(t, F.lit(m)) for t, m in zip(tests, MISSING)]))


def hrefs(html: Column, drop=CODE_TAGS) -> Column:
    """Link targets of a page, in document order."""
    return links_of(drop_elements(html, drop))


def links_of(clean: Column) -> Column:
    """Link targets of a page whose scripts, styles and comments are gone."""
    raw = F.regexp_extract_all(clean, F.lit(ANCHOR_HREF), F.lit(1))
    return F.transform(raw, lambda x: decode_entities(unquote(x)))


def data_hrefs(html: Column) -> Column:
    """``data-href`` targets except fragments."""
    raw = F.regexp_extract_all(drop_elements(html), F.lit(DATA_HREF), F.lit(1))
    return F.filter(F.transform(raw, lambda x: strip(decode_entities(unquote(x)))), lambda x: (x != "") & ~x.startswith("#"))


def trust_signals(html: Column) -> Column:
    """0 to 40: legal notice, contact, e-mail and telephone in the text or links, ten points each."""
    clean = drop_elements(html)
    text = decode_entities(F.regexp_replace(clean, TAG, ""))
    # The separator keeps the patterns from matching across the text and the links.
    hay = F.lower(F.concat_ws("\u0001", text, F.array_join(hrefs(html), " ")))
    points = lambda test: F.when(test, 10).otherwise(0)
    return let(hay, lambda h: points(contains_any(h, LEGAL_WORDS)) + points(contains_any(h, CONTACT_WORDS))
               + points(h.rlike(EMAIL)) + points(h.rlike(PHONE)))


def social_presence(html: Column) -> Column:
    """Which social platforms the links of a page point to."""
    joined = F.lower(F.array_join(hrefs(html), "\n"))
    return let(joined, lambda j: F.struct(*[j.contains(p).alias(p) for p in SOCIAL_PLATFORMS]))


def markdown_links(md: Column) -> Column:
    """Link targets and bare addresses in Markdown text of at least 100 characters."""
    inline = F.filter(F.regexp_extract_all(md, F.lit(r"\]\s*\(\s*([^)\s]+)\s*\)"), F.lit(1)),
                      lambda u: u.startswith("http") | u.startswith("/"))
    bare = F.transform(F.regexp_extract_all(md, F.lit(r"""https?://[^\s\]\)"'>]+"""), F.lit(0)),
                       lambda u: F.regexp_replace(u, r"[)\]].*$", ""))
    return F.when(F.length(md) >= 100, F.concat(inline, bare)).otherwise(F.array().cast("array<string>"))


def js_links(links: Column) -> Column:
    """Absolute or root-relative entries of a link array."""
    kept = F.filter(links, lambda u: u.startswith("http") | u.startswith("/"))
    return F.coalesce(kept, F.array().cast("array<string>"))


def merge_links(*columns: Column) -> Column:
    """Distinct links of all sources."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(c, empty) for c in columns]))


def external_links(html: Column, url: Column) -> Column:
    """Absolute links outside page chrome that do not mention the page's own host."""
    from .urls import netloc
    site = netloc(url)
    hits = F.size(F.filter(hrefs(html, CHROME_TAGS), lambda h: h.startswith("http") & ~h.contains(site)))
    return F.when(site == "", F.lit(0)).otherwise(hits)



"""SQL expressions of the reference engine; independent of the DataFrame code but for shared fixed values."""

from __future__ import annotations


SP = r"[\s\x{A0}]"


def q(text: str) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def rx(c: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({c}, {q(pattern)}, {group})"


def rr(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"


def rall(c: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({c}, {q(pattern)}, {group})"


def rcount(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


def rm(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def strip(c: str) -> str:
    return rr(c, f"^{SP}+|{SP}+$")


def squeeze(c: str) -> str:
    return f"trim({rr(c, SP + '+', ' ')})"


def words(c: str) -> str:
    """Word count of text."""
    return f"CAST(len(list_filter(string_split({squeeze(c)}, ' '), lambda w: w <> '')) AS BIGINT)"


def cut(c: str, n: int, tail: str = "..", keep: int | None = None) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substring({c}, 1, {keep or n}) || {q(tail)} ELSE {c} END"


def list_of(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def any_in(c: str, items) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(i)})" for i in items) + ")"


def title_case(c: str) -> str:
    runs = rall(c, r"(\p{L}+|\P{L}+)", 1)
    return f"array_to_string(list_transform({runs}, lambda r: upper(substring(r, 1, 1)) || lower(substring(r, 2))), '')"


# The entity names that the given pages and the views over them hold.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "copy": "©", "middot": "·", "nbsp": "\u00a0", "eacute": "é"}


def decode(c: str) -> str:
    table = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in ENTITIES.items()) + "}"
    name = "regexp_extract(e, '^(#?[A-Za-z0-9]{1,8});', 1)"
    char = f"CASE WHEN starts_with({name}, '#') THEN chr(try_cast(substring({name}, 2) AS INTEGER)) ELSE ({table})[{name}] END"
    one = f"CASE WHEN {char} IS NULL THEN '&' || e ELSE {char} || substring(e, length({name}) + 2) END"
    parts = f"string_split({c}, '&')"
    return (f"CASE WHEN contains({c}, '&') THEN array_to_string(list_concat({parts}[1:1], "
            f"list_transform({parts}[2:], lambda e: {one})), '') ELSE {c} END")


# ---- urls

def scheme(c: str) -> str:
    return f"lower({rx(c, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)})"


def netloc(c: str) -> str:
    return rx(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def host(c: str) -> str:
    return f"lower({netloc(c)})"


def path(c: str) -> str:
    return rr(rx(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1), ";[^/]*$")


def segments(c: str) -> str:
    return f"list_filter(string_split({c}, '/'), lambda s: s <> '')"


def normalize(c: str) -> str:
    base = f"regexp_replace({c}, '(?s)[#?].*$', '')"
    p = f"lower(regexp_replace({path(base)}, '/+$', ''))"
    return f"{scheme(base)} || '://' || {host(base)} || CASE WHEN {p} = '' THEN '/' ELSE {p} END"


def dynamic(s: str) -> str:
    return (f"(length({s}) = 0 OR length({s}) > 80 OR {rm(s, '^[0-9]+$')} OR "
            f"{rm(s, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')} OR "
            f"(length({s}) >= 10 AND {rm(s, '(?i)^[a-z0-9-]+$')}) OR (length({s}) >= 8 AND {rm(s, '(?i)^[a-f0-9]+$')}))")


def pattern(c: str) -> str:
    return f"list_transform({segments('lower(' + path(c) + ')')}, lambda g: CASE WHEN {dynamic('g')} THEN '{{slug}}' ELSE g END)"


def group(c: str) -> str:
    s = segments(path(c))
    return (f"CASE WHEN len({s}) = 0 THEN 'Accueil' WHEN ({s})[1] IN ('fr','en','de','es') AND len({s}) > 1 "
            f"THEN ({s})[2] ELSE ({s})[1] END")


def resolve(base: str, href: str) -> str:
    """Links of the shapes the data holds; dot segments one level deep."""
    root = f"({scheme(base)} || '://' || {netloc(base)})"
    folder = f"regexp_extract({path(base)}, '^(.*/)', 1)"
    up = f"regexp_replace({folder}, '[^/]+/$', '')"
    rel = f"regexp_replace({href}, '^\\.\\./', '')"
    rel = f"replace({rel}, '/./', '/')"
    return (f"CASE WHEN {href} = '' THEN {base} WHEN {rm(href, '^[A-Za-z][A-Za-z0-9+.-]*:')} THEN {href} "
            f"WHEN starts_with({href}, '//') THEN {scheme(base)} || ':' || {href} "
            f"WHEN starts_with({href}, '#') THEN regexp_replace({base}, '#.*$', '') || {href} "
            f"WHEN starts_with({href}, '?') THEN regexp_replace({base}, '[#?].*$', '') || {href} "
            f"WHEN starts_with({href}, '/') THEN {root} || {href} "
            f"WHEN starts_with({href}, '../') THEN {root} || {up} || {rel} "
            f"ELSE {root} || {folder} || {href} END")


# ---- html

def drop(c: str, tags=("script", "style")) -> str:
    return rr(c, "(?is)" + "|".join(["<!--.*?-->"] + [rf"<{t}(?:\s[^>]*)?>.*?</{t}\s*>" for t in tags]), " ")


CHROME = ("script", "style", "nav", "footer", "header")
ECO = ("script", "style", "noscript")
TAG = r"</?[A-Za-z!?][^>]*>"


def tags(clean: str) -> str:
    return f"list_transform({rall(clean, '<([A-Za-z][A-Za-z0-9:-]*)', 1)}, lambda t: lower(t))"


def n_tags(tag_list: str, *names: str) -> str:
    return f"CAST(len(list_filter({tag_list}, lambda t: t IN ({', '.join(q(n) for n in names)}))) AS BIGINT)"


def element(clean: str, tag: str) -> str:
    return rx(clean, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)


def text_of(inner: str, sep: str = "") -> str:
    return strip(decode(rr(inner, TAG, sep)))


def tight(inner: str) -> str:
    return strip(decode(rr(inner, rf"\s*{TAG}\s*", "")))


def attr(tag: str, name: str) -> str:
    raw = rx(tag, rf"""(?is)\b{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return decode(rr(raw, """^["']|["']$"""))


META = r"""(?s)<(?i:meta)\b[^>]*\b(?i:name)\s*=\s*["']%s["'][^>]*>"""


def meta(clean: str, name: str) -> str:
    return rx(clean, META % name, 0)


def hrefs(clean: str) -> str:
    raw = rall(clean, r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    inner = decode("regexp_replace(h, '^[\"'']|[\"'']$', '', 'g')")
    return f"list_transform({raw}, lambda h: {inner})"


def visible(html: str, dropped=CHROME) -> str:
    return squeeze(decode(rr(drop(html, dropped), TAG, " ")))


def visible_staged(source: str, dropped=CHROME) -> str:
    """Query (page_id, url, text) over ``source``; staged so that each step is evaluated once."""
    return (f"SELECT page_id, url, {squeeze('x')} AS text FROM (SELECT page_id, url, {decode('x')} AS x FROM "
            f"(SELECT page_id, url, {rr(drop('html', dropped), TAG, ' ')} AS x FROM {source}))")


def clean_title(title: str, h1: str, url: str) -> str:
    seps = [" - ", " | ", " : ", " — ", " – ", " · "]
    brand = f"string_split({host(url)}, '.')[1]"

    def useful(t: str) -> str:
        sq = f"replace(replace(lower({t}), ' ', ''), '-', '')"
        return f"(length({t}) >= 3 AND NOT (contains({sq}, {brand}) AND length({sq}) < length({brand}) + 5))"

    text = f"CASE WHEN length({h1}) > 10 THEN {h1} WHEN length({title}) > 5 THEN {title} ELSE '' END"
    cases = []
    for s in seps:
        parts = f"list_filter(list_transform(string_split(v, {q(s)}), lambda z: {strip('z')}), lambda z: {useful('z')})"
        longest = f"list_reduce({parts}, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)"
        cases.append(f"WHEN contains(v, {q(s)}) THEN CASE WHEN len({parts}) > 0 THEN {longest} ELSE v END")
    chosen = f"list_transform([{text}], lambda v: CASE {' '.join(cases)} ELSE v END)[1]"
    segs = f"list_filter({segments(path(url))}, lambda s: s NOT IN ('fr','en','de','es','www'))"
    named = title_case(f"replace(replace(({segs})[-1], '-', ' '), '_', ' ')")
    return (f"list_transform([{chosen}], lambda v: CASE WHEN {useful('v')} THEN {cut(strip('v'), 40)} "
            f"WHEN len({segs}) > 0 THEN {cut(strip(named), 40)} ELSE 'Accueil' END)[1]")


def facts(source: str = "rich_pages") -> str:
    """CTEs ending in ``facts``: the page facts most checks start from."""
    return f"""
cleaned AS (SELECT page_id, url, html, {drop('html')} AS clean FROM {source}),
tagged AS (SELECT *, {tags('clean')} AS tag, {text_of(element('clean', 'title'))} AS raw_title, {text_of(element('clean', 'h1'))} AS h1,
  {strip(attr(meta('clean', 'description'), 'content'))} AS description, {host('url')} AS site,
  list_filter(list_transform({rall('html', '''(?is)<script\\b[^>]*\\btype\\s*=\\s*["']?[^"'>]*ld\\+json[^>]*>(.*?)</script''', 1)}, lambda b: {strip('b')}), lambda b: b <> '' AND json_valid(b)) AS json_ld
  FROM cleaned),
facts AS (SELECT *, {clean_title('raw_title', 'h1', 'url')} AS title, len(json_ld) > 0 AS has_structured_data, {n_tags('tag', 'h2')} AS h2_count FROM tagged)"""

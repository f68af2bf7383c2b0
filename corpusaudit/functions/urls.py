"""URL scalar functions on regular expressions, so that malformed input never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, text_or

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
PARAMS = r";[^/]*$"

# Link substrings that are never followed, in test order.
EXCLUDED = [
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".zip",
    ".doc", ".docx", "tel:", "mailto:", "javascript:", "void(0)",
]

# Path segments that name a language.
LANGUAGES = ["fr", "en", "de", "es"]

UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
SLUG = r"(?i)^[a-z0-9-]+$"
HEXADECIMAL = r"(?i)^[a-f0-9]+$"
SLUG_MARK = "{slug}"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, NETLOC, 1)


def host(url: Column) -> Column:
    return F.lower(netloc(url))


def path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, PATH, 1), PARAMS, "")


def path_segments(p: Column) -> Column:
    return F.array_remove(F.split(p, "/"), "")


def cut_query(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)[#?].*$", "")


def normalize_url(url: Column) -> Column:
    """Cut query and fragment, lower-case, drop trailing slashes; an empty path becomes ``/``."""
    base = cut_query(url)
    sch, net = scheme(base), host(base)
    p = text_or(F.lower(F.regexp_replace(path(base), "/+$", "")), "/")
    return F.concat(
        F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise(F.lit("")),
        F.when(net != "", F.concat(F.lit("//"), net)).otherwise(F.lit("")),
        p,
    )


def _drop_dots(p: Column) -> Column:
    segs = F.split(p, "/")
    kept = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last_is_dir = F.element_at(segs, -1).isin(".", "..")
    joined = F.concat(F.array_join(kept, "/"), F.when(last_is_dir, F.lit("/")).otherwise(F.lit("")))
    clean = F.concat(F.lit("/"), F.regexp_replace(joined, "^/+", ""))
    return F.when(p.rlike(r"(?:^|/)\.\.?(?:/|$)"), clean).otherwise(p)


def resolve_url(base: Column, href: Column) -> Column:
    """Resolve a link found on page ``base``."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    href_path = F.regexp_extract(href, "(?s)^([^?#]*)", 1)
    tail = href.substr(F.length(href_path) + 1, F.length(href))
    base_path = F.regexp_extract(base, PATH, 1)
    base_dir = text_or(F.regexp_extract(base_path, "^(.*/)", 1), "/")
    merged = F.regexp_replace(F.concat(base_dir, href_path), "/{2,}", "/")
    return (
        F.when(href == "", base)
        .when(href.rlike(SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "(?s)#.*$", ""), href))
        .when(href.startswith("?"), F.concat(cut_query(base), href))
        .when(href.startswith("/"), F.concat(root, _drop_dots(href_path), tail))
        .otherwise(F.concat(root, _drop_dots(merged), tail))
    )


def host_variants(h: Column) -> Column:
    """The host itself, without ``www.`` and with ``www.``."""
    bare = F.regexp_replace(h, r"^www\.", "")
    return F.array(h, bare, F.concat(F.lit("www."), bare))


def domain_set(start_url: Column, extra: Column | None = None) -> Column:
    """Hosts that count as the same site: variants of the start host and of attached domains."""
    own = host_variants(host(start_url))
    if extra is None:
        return F.array_distinct(own)
    named = F.filter(F.transform(extra, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    with_scheme = F.transform(named, lambda x: F.when(x.contains("://"), x).otherwise(F.concat(F.lit("https://"), x)))
    hosts = F.filter(F.transform(with_scheme, host), lambda h: h != "")
    return F.array_distinct(F.concat(own, F.flatten(F.transform(hosts, host_variants))))


def excluded_by(url: Column) -> Column:
    """First excluded substring found in the url, or null."""
    low = F.lower(url)
    return F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in EXCLUDED])


def is_dynamic_segment(s: Column) -> Column:
    """True where a path segment looks like an identifier or slug."""
    n = F.length(s)
    return (
        s.isNull() | (n == 0) | (n > 80)
        | s.rlike(r"^\p{Nd}+$")
        | s.rlike(UUID)
        | ((n >= 10) & s.rlike(SLUG))
        | ((n >= 8) & s.rlike(HEXADECIMAL))
    )


def path_pattern(url: Column) -> Column:
    """Path segments with identifier-like ones replaced by a placeholder."""
    segs = path_segments(F.lower(strip(path(url))))
    return F.transform(segs, lambda s: F.when(is_dynamic_segment(s), F.lit(SLUG_MARK)).otherwise(s))


def pattern_similarity(a: Column, b: Column) -> Column:
    """Share of equal positions; patterns of unequal length are damped by 0.85."""
    na, nb = F.size(a), F.size(b)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x)).cast("double")
    return (
        F.when((na == 0) & (nb == 0), F.lit(1.0))
        .when((na == 0) | (nb == 0), F.lit(0.0))
        .when(na == nb, same / na)
        .otherwise(same / F.greatest(na, nb) * F.lit(0.85))
    )


def site_name(url: Column) -> Column:
    """Display name of a site: the host part, at most 200 characters."""
    bare = F.replace(F.replace(F.coalesce(strip(url), F.lit("")), F.lit("https://")), F.lit("http://"))
    return text_or(F.substring(F.split(bare, "/")[0], 1, 200), "Site")


def pattern_group(url: Column) -> Column:
    """First path segment after a leading language; ``Accueil`` for the root."""
    segs = path_segments(path(url))
    return (
        F.when(F.size(segs) == 0, F.lit("Accueil"))
        .when(F.get(segs, F.lit(0)).isin(LANGUAGES) & (F.size(segs) > 1), F.get(segs, F.lit(1)))
        .otherwise(F.get(segs, F.lit(0)))
    )


def same_site_link(base: Column, href: Column) -> Column:
    """The resolved link without query and fragment where it stays on the host of ``base``, else null."""
    full = resolve_url(base, href)
    return F.when(netloc(full) == netloc(base), cut_query(full))

"""Text helpers shared by the URL, HTML and scoring functions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character name of the HTML standard that ends with a semicolon.
NAMED_ENTITIES = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}

SPACE = r"[\s\x{A0}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it.

    Without it every mention repeats the whole expression in the plan; a few nested mentions are
    enough to make planning slower than the query.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_map(table: dict) -> Column:
    """A fixed lookup table as one map literal."""
    text = lambda x: repr(x) + "D" if isinstance(x, float) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{text(k)}, {text(v)}" for k, v in table.items()) + ")")


def falsy(c: Column) -> Column:
    """True where a text value is missing or empty."""
    return c.isNull() | (c == "")


def text_or(c: Column, default: str) -> Column:
    """The value, or ``default`` where it is missing or empty."""
    return F.when(falsy(c), F.lit(default)).otherwise(c)


def trimmed_or(c: Column, default: str) -> Column:
    return text_or(strip(c), default)


def strip(c: Column) -> Column:
    """Drop white space, no-break spaces included, at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def word_count(c: Column) -> Column:
    """Number of blank-separated words; 0 for missing or blank text."""
    def count(t: Column) -> Column:
        return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "))) + 1)

    return let(squeeze(F.coalesce(c, F.lit(""))), count)


def cut(c: Column, n: int, tail: str = "..", keep: int | None = None) -> Column:
    """First ``keep`` (default ``n``) characters plus ``tail`` where longer than ``n``."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, keep or n), F.lit(tail))).otherwise(c)


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))),
        "",
    )


def contains_any(c: Column, words) -> Column:
    """True where any of a fixed list of substrings occurs."""
    return c.rlike("|".join(rf"\Q{w}\E" for w in words))


def decode_entities(c: Column) -> Column:
    """Decode the named entities of HTML and numeric references in one pass over the text."""
    # One JSON literal, folded to a map when the query is planned; two thousand literals would slow every plan.
    table = F.from_json(F.lit(json.dumps(NAMED_ENTITIES)), "map<string,string>")

    def from_code(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    def one(part: Column) -> Column:
        return let(F.regexp_extract(part, "^(#?[A-Za-z0-9]+);", 1), lambda name: replaced(part, name))

    def replaced(part: Column, name: Column) -> Column:
        rest = part.substr(F.length(name) + 2, F.length(part))
        dec = F.regexp_extract(name, "^#0*([0-9]{1,7})$", 1).try_cast("bigint")
        hexa = F.conv(F.regexp_extract(name, "^#[xX]0*([0-9A-Fa-f]{1,6})$", 1), 16, 10).try_cast("bigint")
        code = F.when(name.startswith("#"), F.coalesce(dec, hexa))
        valid = lambda n: F.when((n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), from_code(n))
        char = F.coalesce(F.try_element_at(table, name), let(code, valid))
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), part))

    def joined(t: Column) -> Column:
        return F.array_join(F.transform(F.split(t, "&"), lambda part, i: F.when(i == 0, part).otherwise(one(part))), "")

    return let(c, lambda t: F.when(t.contains("&"), joined(t)).otherwise(t))

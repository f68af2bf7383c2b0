"""Recursive JSON on VARIANT values, level by level inside the row: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT, LIST = "map<string,variant>", "array<variant>"


def parse(c: Column) -> Column:
    return F.try_parse_json(c)


def as_object(v: Column) -> Column:
    """Fields of an object, null for anything else."""
    return F.try_variant_get(v, "$", OBJECT)


def as_list(v: Column) -> Column:
    """Items of a list, null for anything else."""
    return F.try_variant_get(v, "$", LIST)


def kind(v: Column) -> Column:
    """First word of the variant's type: OBJECT, ARRAY, STRING, VOID, ..."""
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def as_text(v: Column) -> Column:
    """Text of a string, null for anything else."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def field(v: Column, name: str) -> Column:
    """A field of an object, as a variant."""
    return F.try_variant_get(v, f"$['{name}']", "variant")


def is_truthy(v: Column) -> Column:
    """Python truth of a JSON value: null, false, zero and everything empty are false."""
    return F.coalesce(~F.to_json(v).isin("null", "false", "0", '""', "[]", "{}"), F.lit(False))


def nothing() -> Column:
    return F.array().cast(LIST)


def children(v: Column) -> Column:
    """Field values of an object or items of a list."""
    return F.coalesce(F.map_values(as_object(v)), as_list(v), nothing())


def nesting(c: Column) -> Column:
    """Greatest bracket depth of JSON text, strings left out. Possessive repeats make the match a loop, however many escapes a string has."""
    bare = F.regexp_replace(c, r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    brackets = F.split(F.regexp_replace(bare, r"[^{}\[\]]++", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(acc: Column, ch: Column) -> Column:
        now = acc["now"] + F.when(ch.isin("{", "["), 1).when(ch.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    return F.aggregate(brackets, start, step, lambda acc: acc["top"])


def depth(c: Column) -> Column:
    """Nesting of valid JSON text; 0 for a scalar, for null and for text that is not JSON."""
    return F.coalesce(F.when(parse(c).isNotNull(), nesting(c)), F.lit(0))


def descend(rounds: Column, state: Column, step, finish) -> Column:
    """Apply ``step`` to a state once per nesting level of the row's own document, the root included.

    The loop runs inside the row, so the plan is the same for flat and for deep documents, and one odd
    document costs no other row anything.
    """
    return F.aggregate(F.sequence(F.lit(0), rounds), state, lambda s, _: step(s), finish)

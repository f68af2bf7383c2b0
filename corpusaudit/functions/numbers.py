"""Rounding as the audited scores define it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

SPLITTER = float(2**27 + 1)


def round_to(c: Column | str, digits: int) -> Column:
    """Nearest decimal of the exact binary value, to the even digit on a true tie.

    ``round`` looks at the shortest decimal text of a double instead and moves 65.35, which is stored a
    little below that, up. The value is cut into two halves whose products with the scale are exact,
    so the distance to the midpoint has the right sign.
    """
    value = F.col(c) if isinstance(c, str) else c
    scale = 10.0 ** digits

    def parts(x: Column) -> Column:
        return let(x * F.lit(SPLITTER), lambda big: let(big - (big - x), lambda high: F.struct(
            high.alias("high"), (x - high).alias("low"), F.floor(x * F.lit(scale)).alias("k"))))

    def nearest(p: Column) -> Column:
        double = F.lit(2 * scale)
        gap = (double * p["high"] - (p["k"] * 2 + 1)) + double * p["low"]
        up = F.when(gap > 0, 1).when(gap < 0, 0).otherwise(F.pmod(p["k"], F.lit(2)).cast("int"))
        return (p["k"] + up).cast("double") / F.lit(scale)

    return let(let(value.cast("double"), parts), nearest)

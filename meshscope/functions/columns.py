"""Column expressions shared by several operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_text(c: Column) -> Column:
    """Text number with an optional decimal comma -> text with a dot; '' -> NULL."""
    return decimal_point(F.trim(c))


def decimal_point(c: Column) -> Column:
    """``decimal_text`` of a trimmed text."""
    return F.nullif(F.translate(c, ",", "."), F.lit(""))


# Decimal places of a value's place in [0, 1] before binning (fixed value shared
# with the oracle).
POSITION_DIGITS = 9


def equal_width_bin(v: Column, lo: float, hi: float, bins: int) -> Column:
    """1-based equal-width bin of ``v`` over [lo, hi]; the maximum joins the last bin.

    The place (v - lo) / (hi - lo) is rounded to ``POSITION_DIGITS`` decimals, so
    a value that lies on a bin edge is binned by its value and not by the last
    bit of a floating sum, whatever the column's scale.  Every value falls in
    bin 1 when ``hi == lo``.
    """
    if hi == lo:
        return F.lit(1)
    place = F.round((v - F.lit(lo)) / (F.lit(hi) - F.lit(lo)), POSITION_DIGITS)
    return F.least(F.lit(bins).cast("bigint"), F.floor(place * F.lit(bins)) + 1).cast("int")


def share_band(share: Column, width: int = 10) -> Column:
    """Lower edge of the ``width``-point band of a percent share."""
    return (F.floor(share / width) * width).cast("int")


def share_label(share: Column) -> Column:
    """Edge label such as ``20.0%``."""
    return F.concat(share.cast("string"), F.lit("%"))

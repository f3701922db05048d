"""Rounding, binning and strict parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def half_even(value: Column, digits: int) -> Column:
    """Round for output to `digits` decimals, as a double.

    The exact binary value decides, and exact ties go to even: 0.25 gives 0.2,
    and 0.35, which is stored a little below itself, gives 0.3. Scaling
    alone would round 0.35 up, because 3.5 is the nearest double of the product;
    so for an apparent tie the error of the product is worked out by splitting
    the value in two halves whose products are exact.
    """
    scale = F.lit(float(10**digits))
    value = value.cast("double")
    scaled = value * scale
    nearest = F.rint(scaled)
    spread = value * F.lit(float(2**27 + 1))
    high = spread - (spread - value)
    error = (high * scale - scaled) + (value - high) * scale
    tie = F.abs(scaled - nearest) == 0.5
    whole = F.when(tie & (error > 0), scaled + 0.5).when(tie & (error < 0), scaled - 0.5).otherwise(nearest)
    return whole / scale


def value_bin(value: Column, resolution: int = 16) -> Column:
    """Histogram bin that never decreases as the value grows.

    Square roots are correctly rounded, so the order of two values is never
    turned round at a bin edge. Bins are about 0.8% wide near 1.0 and get
    relatively finer above it.
    """
    value = value.cast("double")
    root = F.sqrt(F.sqrt(F.abs(value) * F.lit(1e6)))
    size = F.floor(root * F.lit(float(resolution)))
    return F.when(value < 0, -size).otherwise(size).cast("long")


def order_key(major: Column, minor: Column) -> Column:
    """One number that orders like (major, minor): a time or count below 10^17 and any 64-bit number.

    As the ordering of min_by and max_by it keeps their buffers numeric, so that
    they aggregate by hash; a struct would make Spark sort all rows first.
    """
    apart = F.lit("2" + "0" * 19).cast("decimal(20,0)")  # more than two 64-bit numbers lie apart
    return (major.cast("decimal(17,0)") * apart + minor.cast("decimal(19,0)")).cast("decimal(38,0)")


def order_of(df: DataFrame, major: str, minor: str) -> Column:
    """The ordering (major, minor) of a table: one number where ids are whole numbers, else a struct."""
    if isinstance(df.schema[minor].dataType, IntegralType):
        return order_key(F.col(major), F.col(minor))
    return F.struct(major, minor)


def plain_number(value: Column) -> Column:
    """A number as text without an exponent, with at least one decimal."""
    value = value.cast("double")
    text = value.cast("string")
    digits = F.regexp_replace(value.cast("decimal(38,12)").cast("string"), r"(\.[0-9]+?)0*$", "$1")
    return F.when(F.contains(text, F.lit("E")), digits).otherwise(text)


def decimal_digits_only(raw: Column) -> Column:
    return raw.rlike(r"\A[0-9]+\z")


def strict_int(raw: Column) -> Column:
    """Digits only, always decimal: '010' is ten. Anything else is null."""
    return F.when(decimal_digits_only(raw), raw.try_cast("bigint"))


def reject_reason(raw: Column) -> Column:
    """Why a setting is refused; null for a good or an empty one."""
    empty = raw.isNull() | (raw == "")
    return (
        F.when(empty, F.lit(None).cast("string"))
        .when(~decimal_digits_only(raw), F.lit("not a decimal integer"))
        .when(raw.try_cast("bigint").isNull(), F.lit("out of range"))
    )

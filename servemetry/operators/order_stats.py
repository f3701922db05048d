"""Exact percentiles and medians by rank, without sorting a whole group.

A histogram per group, small after map-side counting, says which bin holds the
wanted rank. Only the rows of that bin are looked at again, as counts of equal
values. No group, however large, is sorted or collected in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import value_bin
from ..sources.storage import pin
from .keys import null_safe_join, salted_join

Rank = Callable[[Column], Column]
#: Parts into which the range of a wanted bin is cut.
PARTS = 4096


def nearest(q: float) -> Rank:
    """Rank rint(q * (n - 1)), counted from 0."""
    return lambda n: F.rint(F.lit(float(q)) * (n - 1)).cast("long")


def lower_middle(n: Column) -> Column:
    return F.floor((n - 1) / 2).cast("long")


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2).cast("long")


def values_at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Rank]) -> DataFrame:
    """One row per group with the value found at each named rank.

    Nulls do not count; groups of nulls only are absent. A rank may look at the
    key columns and be null for groups that do not want it.
    """
    binned = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_v"), value_bin(F.col(value)).alias("_bin")
    )
    counts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    group = Window.partitionBy(*keys)
    below = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(
        *keys,
        "_bin",
        "_n",
        "_least",
        "_most",
        F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"),
        F.sum("_n").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("rank"), (rank(F.col("_total")) - F.col("_below")).alias("offset"))
            for i, rank in enumerate(ranks.values())
        ]
    )
    bins = placed.select(
        *keys, "_bin", "_n", "_least", "_most", F.filter(wanted, lambda w: (w["offset"] >= 0) & (w["offset"] < F.col("_n"))).alias("_want")
    ).where(F.size("_want") > 0)

    # _want belongs to the bin; as a grouping key it comes along without a join.
    # Salted, because one value may make up most of the rows of a bin; pinned, as the join reads the few bins more than once.
    in_bin = [*keys, "_bin"]
    equal = salted_join(binned, pin(bins), in_bin, "_n").groupBy(*in_bin, "_v", "_want", "_least", "_most").agg(F.count("*").alias("_c"))
    # However many values crowd into one bin, its own range is cut into PARTS: counts run within a
    # part, and the parts of a bin are few. The cut never decreases as the value grows.
    share = (F.col("_v") - F.col("_least")) / F.nullif(F.col("_most") - F.col("_least"), F.lit(0.0))
    equal = equal.withColumn("_part", F.coalesce(F.floor(share * PARTS), F.lit(0))).drop("_least", "_most")
    in_part = [*in_bin, "_part"]
    earlier = Window.partitionBy(*in_bin).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = equal.groupBy(*in_part).agg(F.sum("_c").alias("_c")).select(*in_part, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_ahead"))
    upto = Window.partitionBy(*in_part).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = null_safe_join(equal.withColumn("_hi", F.sum("_c").over(upto)), parts, in_part)
    ranked = ranked.withColumn("_hi", F.col("_hi") + F.col("_ahead")).withColumn("_lo", F.col("_hi") - F.col("_c"))

    def found(i: int, name: str) -> Column:
        here = F.exists(
            "_want", lambda w: (w["rank"] == i) & (w["offset"] >= F.col("_lo")) & (w["offset"] < F.col("_hi"))
        )
        return F.max(F.when(here, F.col("_v"))).alias(name)

    return ranked.groupBy(*keys).agg(*[found(i, name) for i, name in enumerate(ranks)])


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """Nearest-rank percentiles; rank ties go to the even index."""
    return values_at_ranks(df, keys, value, {name: nearest(q) for name, q in quantiles.items()})


def median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Middle value, or the mean of the two middle values."""
    middle = values_at_ranks(df, keys, value, {"_low": lower_middle, "_high": upper_middle})
    return middle.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def approximate(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float], accuracy: int = 10000) -> DataFrame:
    """Opt-in one-pass percentiles within 1/accuracy of the rank."""
    return df.groupBy(*keys).agg(
        *[F.percentile_approx(value, q, accuracy).alias(name) for name, q in quantiles.items()]
    )

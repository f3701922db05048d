"""Joins on keys that may be null or hot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that pairs null keys; each key appears once in the result."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "right"):
        joined = joined.withColumns({k: F.coalesce(k, f"_r_{k}") for k in keys})
    return joined.drop(*[f"_r_{k}" for k in keys])


def salted_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], weight: str, how: str = "inner", tasks: int | None = None
) -> DataFrame:
    """Inner or left join in which the rows of a hot key spread over several tasks.

    `small` holds one row per key, with the number of rows that `big` has of it as `weight`, which is
    dropped; it is read three times. With `tasks` tasks (as many as shuffle partitions) a key is hot if it has more than
    one task's share of those rows. Only hot keys are salted, each with as many salts as it has shares:
    so there are fewer than `tasks` hot keys, their list can be broadcast, and the rows repeated for them are fewer than
    twice `tasks`, however many keys there are. The salt is the number of the task that produced
    the row: equal rows differ in it, and a task that is run again gives the same one. As the salt is part
    of the join key, an aggregation behind the join combines its rows before they move on.
    """
    tasks = tasks or int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = small.select(F.sum(F.col(weight).cast("double"))).scalar()
    shares = F.ceil(F.col(weight) * F.lit(tasks) / total).cast("int")
    salts = F.when(shares > 1, shares).otherwise(F.lit(1))
    numbered = small.withColumn("_salts", salts).drop(weight)
    hot = numbered.where("_salts > 1").select(*keys, "_salts")
    spread = F.pmod(F.spark_partition_id(), F.coalesce("_salts", F.lit(1)))
    salted = null_safe_join(big, F.broadcast(hot), keys, "left").withColumn("_salt", spread).drop("_salts")
    repeated = numbered.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return null_safe_join(salted, repeated, [*keys, "_salt"], how).drop("_salt")


def lookup_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Ordinary equi-join to a lookup table that is expected to be small; null keys match nothing.

    Spark broadcasts it by its size in bytes (spark.sql.autoBroadcastJoinThreshold), and splits hot
    partitions of a larger one at run time.
    """
    return big.join(small, list(keys), how)

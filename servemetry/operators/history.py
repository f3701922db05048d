"""In-flight counts over a long history, of which a new stretch reads only its own part.

A history is a folder of two tables: the arrivals and releases of the requests, by day, and the change
of each resource's load by hour. What is in flight when a stretch begins is the sum of the changes before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import running
from .routing import arrival_events

HOUR = 3_600_000_000
DAY = 24 * HOUR


def _number(width: int) -> Column:
    return F.floor(F.col("_t") / F.lit(width)).cast("long")


def append_history(requests: DataFrame, path: str, batch: int, resource: str = "lane") -> None:
    """Add a batch of requests (resource, request_id, start_us, end_us) to the history at `path`.

    Batches may overlap in time and come in any order. A batch that is written again, also after a
    failure half way, replaces what it wrote before.
    """
    events = arrival_events(requests, resource).withColumn("day", _number(DAY))
    written = f"{path}/events/batch={int(batch)}"
    events.write.mode("overwrite").partitionBy("day").parquet(written)
    told = requests.sparkSession.read.schema(events.schema).parquet(written)
    changes = told.groupBy(resource, _number(HOUR).alias("hour")).agg(F.sum("_delta").cast("long").alias("change"))
    changes.write.mode("overwrite").parquet(f"{path}/changes/batch={int(batch)}")


def history_events(spark: SparkSession, path: str, from_us: int, to_us: int) -> DataFrame:
    """Arrivals and releases from the hour of `from_us` on, up to `to_us`; other days are not opened."""
    start = from_us // HOUR * HOUR
    days = F.col("day").between(start // DAY, (to_us - 1) // DAY)
    return spark.read.parquet(f"{path}/events").where(days & (F.col("_t") >= start) & (F.col("_t") < to_us)).drop("day", "batch")


def history_load(spark: SparkSession, path: str, from_us: int, resource: str = "lane") -> DataFrame:
    """Requests that hold each resource when the hour of `from_us` begins."""
    changes = spark.read.parquet(f"{path}/changes").where(F.col("hour") < from_us // HOUR)
    return changes.groupBy(resource).agg(F.sum("change").alias("load"))


def inflight_between(spark: SparkSession, path: str, from_us: int, to_us: int, resource: str = "lane") -> DataFrame:
    """As `inflight_at_arrival` over the whole history, for the arrivals from `from_us` up to, but not at, `to_us`.

    It reads the events of that time and one row an hour, resource and batch of the time before. The load at the start is an
    event of its own, ahead of all others.
    """
    events = history_events(spark, path, from_us, to_us)
    opening = history_load(spark, path, from_us, resource).select(
        resource,
        F.lit(None).cast(events.schema["_id"].dataType).alias("_id"),
        F.lit(from_us // HOUR * HOUR - 1).cast(events.schema["_t"].dataType).alias("_t"),
        F.lit(0).alias("_kind"),
        F.col("load").alias("_delta"),
    )
    counted = running(events.unionByName(opening), [resource], ["_t", "_kind", "_id"], sums={"inflight": "_delta"})
    return counted.where((F.col("_kind") == 1) & (F.col("_t") >= from_us)).select(
        resource, F.col("_id").alias("request_id"), F.col("_t").alias("at_us"), F.col("inflight").cast("long").alias("inflight")
    )

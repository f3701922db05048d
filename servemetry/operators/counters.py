"""Monotone engine counters: brackets, window deltas and draft-depth advice.

A sample carries engine, scraped_us, sample_id, kind ('counter' or 'gauge'),
accepted, drafted and rate. A failed scrape has a null kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_even, order_of
from ..functions.speculation import CURRENT_K, K_SET, MAX_SEQS, STEP_COST, advice
from .ordered import running

MIN_DRAFT_TOKENS = 2000
_READING = ("kind", "accepted", "drafted", "rate")


def _reading() -> Column:
    fields = [F.col("kind"), F.col("accepted").cast("double"), F.col("drafted").cast("double"), F.col("rate").cast("double")]
    return F.when(F.col("kind").isNotNull(), F.struct(*[f.alias(n) for f, n in zip(fields, _READING)]))


def counter_bracket(spans: DataFrame, samples: DataFrame) -> DataFrame:
    """The reading in force at the start of each span, and the first at or after its end.

    `spans` carries engine, span_id, start_us and end_us.
    """
    nothing = F.lit(None).cast("struct<kind:string,accepted:double,drafted:double,rate:double>")
    points = samples.where("kind IS NOT NULL").select(
        "engine", F.col("scraped_us").alias("_t"), F.lit(1).alias("_side"), F.col("sample_id").alias("_id"), _reading().alias("_reading")
    )
    # An end is searched from before the samples of its instant, a start from behind them.
    edges = spans.select(
        "engine",
        F.explode(
            F.array(
                F.struct(F.col("end_us").alias("_t"), F.lit(0).alias("_side")),
                F.struct(F.col("start_us").alias("_t"), F.lit(2).alias("_side")),
            )
        ).alias("_edge"),
        F.col("span_id").alias("_id"),
    ).select("engine", "_edge._t", "_edge._side", "_id", nothing.alias("_reading"))
    walked = running(
        points.unionByName(edges),
        ["engine"],
        ["_t", "_side", "_id"],
        lasts={"_before": "_reading"},
        nexts={"_after": "_reading"},
    )

    def of(side: int, column: str) -> Column:
        return F.max(F.when(F.col("_side") == side, F.col(column)))

    def parts(side: int, name: str) -> list[Column]:
        counted = F.max(F.when(F.col("_side") == side, F.col(f"{name}.kind") == "counter")).alias(f"{name}_counted")
        return [counted, *[of(side, f"{name}.{f}").alias(f"{name}_{f}") for f in _READING[1:]]]

    def reading(name: str) -> Column:
        counted = F.col(f"{name}_counted")
        kind = F.when(counted, "counter").otherwise("gauge").alias("kind")
        return F.when(counted.isNotNull(), F.struct(kind, *[F.col(f"{name}_{f}").alias(f) for f in _READING[1:]])).alias(name)

    # The two edges of a span meet again; numbers only, so by hash.
    return (
        walked.where("_side <> 1")
        .groupBy("engine", F.col("_id").alias("span_id"))
        .agg(
            of(2, "_t").alias("start_us"), of(0, "_t").alias("end_us"), *parts(2, "_before"), *parts(0, "_after")
        )
        .select("engine", "span_id", "start_us", "end_us", reading("_before").alias("before"), reading("_after").alias("after"))
    )


def acceptance_of(before: Column, after: Column) -> Column:
    """Counter delta when drafts moved, else the last gauge when positive, else null."""
    drafted = after["drafted"] - before["drafted"]
    counted = (before["kind"] == "counter") & (after["kind"] == "counter") & (drafted > 0)
    gauged = before.isNotNull() & (after["kind"] == "gauge") & (after["rate"] > 0)
    return half_even(
        F.when(counted, (after["accepted"] - before["accepted"]) / drafted).when(gauged, after["rate"]), 3
    )


def acceptance_delta(spans: DataFrame, samples: DataFrame) -> DataFrame:
    return counter_bracket(spans, samples).withColumn("acceptance", acceptance_of(F.col("before"), F.col("after")))


def counter_window_delta(ticks: DataFrame, min_draft: int = MIN_DRAFT_TOKENS) -> DataFrame:
    """Difference of each tick to the last successful one, with its status.

    A failed scrape keeps the previous reading, so the next delta spans it. A
    thin window, or a counter reset, is dropped and not carried over. The first
    reading of an engine only starts the series.
    """
    counted = F.when(F.col("kind") == "counter", F.struct("accepted", "drafted"))
    walked = running(
        ticks.withColumn("_now", counted), ["engine"], ["scraped_us", "sample_id"], lasts={"_prev": "_now"}
    )
    d_acc = F.col("_now.accepted") - F.col("_prev.accepted")
    d_dra = F.col("_now.drafted") - F.col("_prev.drafted")
    status = (
        F.when(F.col("_prev").isNull(), F.lit("starting"))
        .when(F.col("_now").isNull(), F.lit("metrics-unavailable"))
        .when(d_dra < min_draft, F.lit("insufficient traffic"))
        .otherwise(F.lit("ok"))
    )
    return walked.select(
        "engine",
        "scraped_us",
        "sample_id",
        status.alias("status"),
        F.when(status.isin("ok", "insufficient traffic"), d_dra).alias("draft_tokens"),
        F.when(status == "ok", d_acc / d_dra).alias("acceptance"),
    )


def recommend_k(
    rates: DataFrame,
    *,
    k_set: Sequence[int] = K_SET,
    current_k: int = CURRENT_K,
    max_seqs: int = MAX_SEQS,
    step_cost: float = STEP_COST,
) -> DataFrame:
    """Depth advice beside each acceptance; null where there is none to give."""
    told = advice(F.col("acceptance"), k_set=k_set, current_k=current_k, max_seqs=max_seqs, step_cost=step_cost)
    return rates.withColumn("advice", told)


def draft_depth_advice(ticks: DataFrame, *, min_draft: int = MIN_DRAFT_TOKENS, **depths) -> DataFrame:
    """One advice row per engine and tick."""
    rows = recommend_k(counter_window_delta(ticks, min_draft), **depths)
    return rows.select(
        "engine",
        "scraped_us",
        "sample_id",
        "status",
        "draft_tokens",
        "advice.acceptance",
        "advice.current_k",
        "advice.recommended_k",
        "advice.expected_gain",
        "advice.apply",
    )


def ticks_per_window(samples: DataFrame, window_s: int = 300) -> DataFrame:
    """The last scrape of each engine in each tumbling window, failed or not."""
    width = window_s * 1_000_000
    last = order_of(samples, "scraped_us", "sample_id")
    end = (F.floor(F.col("scraped_us") / width) * width + width).cast("long")
    ticks = samples.groupBy("engine", end.alias("window_end_us")).agg(
        *[F.max_by(c, last).alias(c) for c in ("scraped_us", "sample_id", "accepted", "drafted", "rate")],
        F.max_by(F.col("kind") == "counter", last).alias("_counter"),
    )
    kind = F.when(F.col("_counter"), "counter").when(~F.col("_counter"), "gauge")
    return ticks.withColumn("kind", kind).drop("_counter")


def series_increase(samples: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """How much each metric grew since the scrape before, per scrape, counted series by series.

    `samples` carries the keys, scraped_us, metric, series and value, one row a series and scrape. A value below
    the one before is a restart: the series began at 0 again, and the others are not touched by it. The first
    value of a series starts it and adds nothing. `restarts` counts the series that began again.
    """
    needed = samples.select(*keys, "scraped_us", "metric", "series", "value", F.col("value").alias("_value"))
    walked = running(needed, [*keys, "series"], ["scraped_us"], lasts={"_before": "_value"})
    grown = F.when(F.col("value") >= F.col("_before"), F.col("value") - F.col("_before")).when(F.col("_before").isNotNull(), F.col("value"))
    return walked.groupBy(*keys, "scraped_us", "metric").agg(
        F.coalesce(F.sum(grown), F.lit(0.0)).alias("increase"), F.count_if(F.col("value") < F.col("_before")).alias("restarts")
    )


def series_acceptance(samples: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Accepted over drafted tokens since the scrape before, from `series_increase`; null where nothing was drafted."""
    both = series_increase(samples, keys).groupBy(*keys, "scraped_us").agg(
        *[F.sum(F.when(F.col("metric") == m, F.col("increase"))).alias(m) for m in ("accepted", "drafted")], F.sum("restarts").alias("restarts")
    )
    return both.withColumn("acceptance", half_even(F.when(F.col("drafted") > 0, F.col("accepted") / F.col("drafted")), 6))

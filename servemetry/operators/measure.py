"""Throughput and latency of measured requests: request, trial, cell, run.

A measured request carries request_id (a number or a text), its cell columns, trial, started_us,
wall_s, ttft_s, sse_chunks, completion_tokens and prompt_tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_even, order_of
from ..sources.storage import pin
from .counters import acceptance_delta
from .keys import null_safe_join, salted_join
from .order_stats import Rank, lower_middle, median, nearest, upper_middle, values_at_ranks

MIN_RUN_S = 30
MIN_TRIALS = 3


def usable(requests: DataFrame) -> Column:
    return F.coalesce(F.col("completion_tokens") > 0, F.lit(False)) & (F.col("wall_s") > 0)


def request_rate(requests: DataFrame) -> DataFrame:
    """Tokens per second of every request that reported its token usage."""
    return requests.where(usable(requests)).withColumn("tok_s", F.col("completion_tokens") / F.col("wall_s"))


def refused_requests(requests: DataFrame) -> DataFrame:
    """Requests without usable token counts: refused, not counted as zero."""
    return requests.where(~F.coalesce(usable(requests), F.lit(False)))


def _trial_totals(rated: DataFrame, cell: Sequence[str]) -> DataFrame:
    ended = F.col("started_us") + F.col("wall_s") * 1e6
    first = order_of(rated, "started_us", "request_id")
    return rated.groupBy(*cell, "trial").agg(
        F.count("*").alias("_requests"),
        F.sum("completion_tokens").alias("_tokens"),
        F.sum("sse_chunks").alias("_chunks"),
        F.max("wall_s").alias("_longest"),
        ((F.max(ended) - F.min("started_us")) / 1e6).alias("_makespan"),
        F.min_by("prompt_tokens", first).alias("_prompt"),
    )


def _aggregate_rate() -> Column:
    return half_even(F.col("_tokens") / F.col("_longest"), 1)


def trial_rollup(requests: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Aggregate and median per-stream rate of each trial.

    `aggregate_tok_s` divides by the longest request. With staggered arrivals
    that overstates it, so the rate over the whole makespan stands beside it.
    """
    rated = request_rate(requests)
    keys = [*cell, "trial"]
    middle = median(rated, keys, "tok_s", "_median")
    return null_safe_join(_trial_totals(rated, cell), middle, keys).select(
        *keys,
        _aggregate_rate().alias("aggregate_tok_s"),
        half_even(F.col("_median"), 1).alias("per_stream_median"),
        half_even(F.col("_tokens") / F.col("_makespan"), 1).alias("makespan_tok_s"),
    )


def discard_warmup(requests: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Without the first trial of each cell."""
    first = pin(requests.groupBy(*cell).agg(F.min("trial").alias("_first"), F.count("*").alias("_n")))
    return salted_join(requests, first, cell, "_n").where(F.col("trial") > F.col("_first")).drop("_first")


def chunk_tripwire(requests: DataFrame, cell: Sequence[str], near_one: float = 0.05) -> DataFrame:
    """Tokens per stream chunk; about 1 means chunks were counted as tokens."""
    ratio = F.sum("completion_tokens") / F.greatest(F.sum("sse_chunks"), F.lit(1))
    return (
        request_rate(requests)
        .groupBy(*cell)
        .agg(ratio.alias("_ratio"))
        .select(
            *cell,
            half_even(F.col("_ratio"), 2).alias("tokens_per_sse_chunk"),
            (F.abs(F.col("_ratio") - 1) <= near_one).alias("suspect"),
        )
    )


def cell_rollup(requests: DataFrame, cell: Sequence[str], *, drop_warmup: bool = False) -> DataFrame:
    """The published row of each cell: medians over trials, TTFT over requests.

    The rates of each trial and the TTFTs of each cell go through one rank
    search, so the requests are read three times in all: totals, histogram and
    the rows of the wanted bins.
    """
    if drop_warmup:
        requests = discard_warmup(requests, cell)
    rated = request_rate(requests)
    per_trial = F.struct(F.col("trial"), F.lit(True).alias("_is_rate"), F.col("tok_s").alias("_value"))
    per_cell = F.struct(
        F.lit(None).cast("int").alias("trial"), F.lit(False).alias("_is_rate"), F.col("ttft_s").alias("_value")
    )
    values = rated.select(*cell, F.explode(F.array(per_trial, per_cell)).alias("_x")).select(*cell, "_x.*")

    def only(is_rate: bool, rank: Rank) -> Rank:
        return lambda n: F.when(F.col("_is_rate") == is_rate, rank(n))

    found = values_at_ranks(
        values,
        [*cell, "trial", "_is_rate"],
        "_value",
        {
            "_low": only(True, lower_middle),
            "_high": only(True, upper_middle),
            "_p50": only(False, nearest(0.50)),
            "_p95": only(False, nearest(0.95)),
        },
    )
    # Totals belong to the rows of rates: a null trial must not pair with the per-cell row.
    totals = _trial_totals(rated, cell).withColumn("_is_rate", F.lit(True))
    joined = null_safe_join(found, totals, [*cell, "trial", "_is_rate"], "left")
    # The built-in median counts equal values; these are rounded to one decimal,
    # so what it holds stays small however many trials a cell has.
    return (
        joined.groupBy(*cell)
        .agg(
            F.min_by("_prompt", "trial").alias("prompt_tokens_actual"),
            F.count("_tokens").alias("trials"),
            F.sum("_requests").alias("requests"),
            F.median(half_even((F.col("_low") + F.col("_high")) / 2, 1)).alias("_stream"),
            F.median(_aggregate_rate()).alias("_aggregate"),
            F.max("_p50").alias("_p50"),
            F.max("_p95").alias("_p95"),
            (F.sum("_tokens") / F.greatest(F.sum("_chunks"), F.lit(1))).alias("_per_chunk"),
        )
        .select(
            *cell,
            "prompt_tokens_actual",
            "trials",
            "requests",
            half_even(F.col("_stream"), 1).alias("per_stream_tok_s"),
            half_even(F.col("_aggregate"), 1).alias("aggregate_tok_s"),
            half_even(F.col("_p50"), 3).alias("ttft_p50_s"),
            half_even(F.col("_p95"), 3).alias("ttft_p95_s"),
            half_even(F.col("_per_chunk"), 2).alias("tokens_per_sse_chunk"),
        )
    )


def published_cells(requests: DataFrame, samples: DataFrame, cell: Sequence[str], run: Sequence[str] = ("run",)) -> DataFrame:
    """The rollup of each cell with its run's elapsed time and the acceptance measured while it ran.

    `requests` also carries the engine that served them, one per cell. A cell's span goes from its first
    start to its last end; `samples` are the counter readings of the engines.
    """
    ended = F.ceil(F.col("started_us") + F.col("wall_s") * 1e6).cast("bigint")
    extents = request_rate(requests).groupBy(*cell, "engine").agg(F.min("started_us").alias("start_us"), F.max(ended).alias("end_us"))
    # Pinned, as the spans and the cells they belong to must get the same numbers.
    extents = pin(extents.withColumn("span_id", F.monotonically_increasing_id()))
    measured = acceptance_delta(extents.select("engine", "span_id", "start_us", "end_us"), samples)
    accepted = extents.select("span_id", *cell).join(measured.select("span_id", "acceptance"), "span_id").drop("span_id")
    elapsed = extents.groupBy(*run).agg(((F.max("end_us") - F.min("start_us")) / 1e6).alias("elapsed_s"))
    cells = null_safe_join(cell_rollup(requests, cell), accepted, list(cell), "left")
    return null_safe_join(cells, elapsed, list(run), "left")


def publish_gate(
    cells: DataFrame, run: Sequence[str], *, require_acceptance: bool = True, min_elapsed_s: float = MIN_RUN_S
) -> DataFrame:
    """Refusals and protocol violations of each run.

    `cells` carries the run columns, elapsed_s, trials, prompt_tokens_actual,
    concurrency, thinking and acceptance. Short runs and runs without any
    acceptance are refused; the rest is reported, not refused.
    """
    triple = F.col("prompt_tokens_actual").isNull() | F.col("concurrency").isNull() | F.col("thinking").isNull()
    facts = cells.groupBy(*run).agg(
        F.max("elapsed_s").alias("elapsed_s"),
        F.min(F.coalesce("trials", F.lit(0))).alias("fewest_trials"),
        F.count("acceptance").alias("_measured"),
        F.count_if(triple).alias("_bare"),
        F.count("*").alias("cells"),
    )
    refusals = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("elapsed_s") < min_elapsed_s, F.lit(False)), F.lit("no steady state")),
            F.when(F.lit(require_acceptance) & (F.col("_measured") == 0), F.lit("no acceptance")),
        )
    )
    violations = F.array_compact(
        F.array(
            F.when(F.col("fewest_trials") < MIN_TRIALS, F.lit("fewer than three trials")),
            F.when(F.col("_bare") > 0, F.lit("cell without workload triple")),
        )
    )
    return facts.select(
        *run,
        "cells",
        "fewest_trials",
        (F.size(refusals) == 0).alias("publish"),
        F.array_join(refusals, "; ").alias("refusals"),
        F.array_join(violations, "; ").alias("violations"),
    )

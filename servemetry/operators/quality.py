"""Degenerate output, retrieval verdicts and probe gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chat, quality
from ..functions.numeric import half_even
from ..sources.storage import pin
from .ordered import running


def repeat_run_features(outputs: DataFrame) -> DataFrame:
    """Run features of reasoning and content together."""
    text = quality.full_text(F.col("reasoning_content"), F.col("content"))
    longest = quality.longest_bang_run(text)
    return outputs.withColumns(
        {
            "longest_bang_run": longest,
            "total_bangs": quality.occurrences(text, "!"),
            "replacement_chars": quality.occurrences(text, "�"),
            "is_loop": longest >= quality.LOOP_RUN,
        }
    )


def sticky_poison(outputs: DataFrame) -> DataFrame:
    """Mark outputs that follow a loop on the same server since its last restart.

    `outputs` carries server, seq, restart and the two text columns. A restart
    row starts a new epoch.
    """
    marked = repeat_run_features(outputs).withColumns(
        {
            "_restart_at": F.when(F.col("restart"), F.col("seq")),
            "_restarts": F.col("restart").cast("int"),
            "_loop_at": F.when(F.col("is_loop"), F.col("seq")),
        }
    )
    # Pinned, as the range bounds of the walk are sampled and the texts should be searched once.
    slim = pin(marked.drop("reasoning_content", "content"))
    walked = running(
        slim,
        ["server"],
        ["seq"],
        sums_through={"epoch": "_restarts"},
        lasts_through={"_since": "_restart_at"},
        lasts={"_last_loop": "_loop_at"},
    )
    poisoned_by_loop = F.col("_last_loop").isNotNull() & (
        F.col("_since").isNull() | (F.col("_last_loop") >= F.col("_since"))
    )
    return walked.withColumn("suspect", poisoned_by_loop).drop(
        "_restart_at", "_restarts", "_loop_at", "_since", "_last_loop"
    )


def poison_outcomes(outputs: DataFrame) -> DataFrame:
    """Outcome of each server epoch; `follow_up` tells short probes from long ones."""
    reproduced = F.bool_or(F.col("is_loop") & ~F.col("follow_up"))
    poisoned = F.bool_or(F.col("is_loop") & F.col("follow_up"))
    return (
        sticky_poison(outputs)
        .groupBy("server", "epoch")
        .agg(
            F.count("*").alias("outputs"),
            F.count_if("is_loop").alias("loops"),
            F.count_if("suspect").alias("suspects"),
            reproduced.alias("_reproduced"),
            poisoned.alias("_poisoned"),
        )
        .select(
            "server",
            "epoch",
            "outputs",
            "loops",
            "suspects",
            F.when(F.col("_reproduced") & F.col("_poisoned"), "reproduced and poisoned")
            .when(F.col("_reproduced"), "reproduced")
            .when(F.col("_poisoned"), "poisoned only")
            .otherwise("clean")
            .alias("outcome"),
        )
    )


def degeneration_scan(outputs: DataFrame) -> DataFrame:
    """The flagged outputs only: loops, token-zero texts and suspects."""
    zero = outputs.withColumn("token_zero", quality.is_token_zero(F.col("content")))
    return sticky_poison(zero).where("is_loop OR suspect OR token_zero")


# Fixed value: what a server logs when it lost its GPU.
LOST_GPU = "ggml_cuda_init: failed"
DAY_US = 86_400_000_000


def trailing_lines(logs: DataFrame, *, signature: str = LOST_GPU, span_us: int = DAY_US) -> DataFrame:
    """At each time a container logs the signature: how often it did in the `span_us` up to then, both ends included.

    `logs` carries container, at and line. A container is suspect from a time told here until `span_us` later.
    A line counts when it comes and is taken back when it leaves the span, so a container with most of the lines
    is walked in slices, not as one window.
    """
    hits = logs.where(F.contains("line", F.lit(signature))).groupBy("container", F.unix_micros("at").alias("_t")).agg(F.count("*").alias("_n"))
    edge = lambda t, side, n: F.struct(t.alias("_t"), F.lit(side).alias("_side"), n.alias("_n"))
    t, n = F.col("_t"), F.col("_n")
    # What leaves at an instant still counts for it, so arrivals come first.
    edges = hits.select("container", F.explode(F.array(edge(t, 0, n), edge(t + span_us, 1, -n))).alias("_e")).select("container", "_e.*")
    walked = running(edges, ["container"], ["_t", "_side"], sums_through={"lines": "_n"})
    return walked.where("_side = 0").select("container", F.col("_t").alias("at_us"), F.col("lines").cast("long").alias("lines"))


def corruption_verdicts(trials: DataFrame) -> DataFrame:
    """TOKEN-ZERO, ok or MISS per trial, and whether the trial counts as bad."""
    long_zero = quality.is_token_zero(F.col("long_text"))
    found = F.coalesce(F.contains("long_text", "needle"), F.lit(False))
    return trials.withColumns(
        {
            "flag": F.when(long_zero, "TOKEN-ZERO").when(found, "ok").otherwise("MISS"),
            "bad": long_zero | ~found | quality.is_token_zero(F.col("partner_text")),
        }
    )


def corruption_trials(trials: DataFrame, run: Sequence[str]) -> DataFrame:
    """Clean and bad trials per run."""
    return (
        corruption_verdicts(trials)
        .groupBy(*run)
        .agg(
            F.count("*").alias("trials"),
            F.count_if(~F.col("bad")).alias("clean"),
            F.count_if(F.col("flag") == "TOKEN-ZERO").alias("token_zero"),
            F.count_if(F.col("flag") == "MISS").alias("missed"),
            F.bool_or("bad").alias("reproduced"),
        )
    )


def retrieval_verdict(cases: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Passed of total by kind, by depth, by depth and position, and overall.

    `passed` is recomputed: the needle must be in the output.
    """
    run = list(run)
    judged = cases.withColumn("passed", F.coalesce(F.contains("output", "needle"), F.lit(False)))
    sets = [[*run, "kind"], [*run, "depth_tokens"], [*run, "depth_tokens", "position"], run]
    level = (
        F.when(F.grouping("kind") == 0, "kind")
        .when(F.grouping("position") == 0, "depth and position")
        .when(F.grouping("depth_tokens") == 0, "depth")
        .otherwise("all")
    )
    return judged.groupingSets(sets, *run, "kind", "depth_tokens", "position").agg(
        level.alias("level"),
        F.count_if("passed").alias("passed"),
        F.count("*").alias("total"),
        F.when(F.bool_and("passed"), "RELIABLE").otherwise("DEGRADED").alias("verdict"),
    )


def loss_gate(log: DataFrame, run: Sequence[str] = ("run",), fell_below: float = 0.9) -> DataFrame:
    """First and last logged loss of each run, the smoke gate and the warning."""
    points = log.where(F.col("loss").isNotNull())
    return (
        points.groupBy(*run)
        .agg(
            F.count("*").alias("points"),
            F.min_by("loss", "step").alias("_first"),
            F.max_by("loss", "step").alias("_last"),
        )
        .select(
            *run,
            "points",
            half_even(F.col("_first"), 4).alias("loss_first"),
            half_even(F.col("_last"), 4).alias("loss_last"),
            (F.col("_last") < fell_below * F.col("_first")).alias("smoke_passed"),
            ((F.col("points") >= 2) & (F.col("_last") >= F.col("_first"))).alias("did_not_fall"),
        )
    )


def tokens_per_unit(probes: DataFrame, keys: Sequence[str], target: Column | int) -> DataFrame:
    """Units (lines) that reach a target depth, from measured tokens per unit."""
    target = F.lit(target) if isinstance(target, int) else target
    return (
        probes.groupBy(*keys)
        .agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("units").alias("units"))
        .where("prompt_tokens > 0 AND units > 0")
        .withColumn("_per_unit", F.col("prompt_tokens") / F.col("units"))
        .select(
            *keys,
            "prompt_tokens",
            "units",
            half_even(F.col("_per_unit"), 1).alias("tokens_per_unit"),
            F.greatest(F.lit(1), F.rint(target / F.col("_per_unit")).cast("long")).alias("units_for_target"),
        )
    )


def probe_gate(probes: DataFrame, keys: Sequence[str] = ("node",)) -> DataFrame:
    """No failure is OK, some a warning, all a failure."""
    return (
        probes.groupBy(*keys)
        .agg(F.count_if(~F.coalesce("ok", F.lit(False))).alias("failures"), F.count("*").alias("probes"))
        .withColumn(
            "verdict",
            F.when(F.col("failures") == 0, "OK").when(F.col("failures") < F.col("probes"), "WARN").otherwise("FAIL"),
        )
    )


def response_repair(responses: DataFrame) -> DataFrame:
    """Finish reason, tool calls and first effective stop of each response."""
    return responses.withColumns(
        {
            "finish_reason": chat.repaired_finish(F.col("engine_finish"), F.size("tool_calls") > 0),
            "kept_calls": chat.kept_tool_calls(F.col("engine_finish"), F.col("tool_calls")),
            "stopped": chat.first_effective_stop(F.col("text"), F.col("stops"), F.col("armed")),
        }
    )


def repair_counts(responses: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Repairs by model and finish reason."""
    dropped = F.coalesce(F.size("tool_calls"), F.lit(0)) - F.coalesce(F.size("kept_calls"), F.lit(0))
    return (
        response_repair(responses)
        .groupBy(*keys, "finish_reason")
        .agg(
            F.count("*").alias("responses"),
            F.sum(F.greatest(dropped, F.lit(0))).alias("dropped_calls"),
            F.count("stopped").alias("stopped_responses"),
        )
    )

"""Streamed response frames to measured requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keys import salted_join
from .schemas import STREAM_FRAME
from .storage import pin

_BLANK = " \t\n\r\x0b\x0c"


def frame_body(line: Column) -> Column:
    """What follows 'data:' in a stream line; null for any other line."""
    trimmed = F.btrim(line, F.lit(_BLANK))
    return F.when(trimmed.startswith("data:"), F.btrim(F.substr(trimmed, F.lit(6)), F.lit(_BLANK)))


def usage_tokens(usage: Column, name: str) -> Column:
    return F.coalesce(F.get_json_object(usage, f"$.{name}").try_cast("bigint"), F.lit(0))


def whole_frame(body: Column) -> Column:
    """The frame that a line's body holds, if the body is one whole JSON object; else null.

    It is read as the first of two frames. The second carries the body's digest, which is seen only
    if the reader came to the end of the body with exactly one value read. Only what stands in braces is
    given to the reader at all, as each failure costs it far more than a frame.
    """
    body = F.when(body.startswith("{") & body.endswith("}"), body)
    seal = F.md5(body.cast("binary"))
    both = F.from_json(F.concat(F.lit("["), body, F.lit(',{"usage":"'), seal, F.lit('"}]')), f"array<struct<{STREAM_FRAME}>>")
    sealed = (F.size(both) == 2) & (F.get(both, F.lit(1))["usage"] == seal)
    return F.when(sealed, F.get(both, F.lit(0)))


def with_frame_columns(frames: DataFrame) -> DataFrame:
    """Add token counts, number of non-empty chunks and end mark of each line.

    The token counts are null on a line without usage. The parsed frame is a
    column of its own. A line that is not one whole JSON value counts as no frame.
    """
    chunks = F.filter(
        "_frame.choices",
        lambda c: (F.coalesce(c["delta"]["content"], F.lit("")) != "")
        | (F.coalesce(c["delta"]["reasoning_content"], F.lit("")) != ""),
    )
    usage = F.col("_frame.usage")
    told = ~F.coalesce(usage, F.lit("null")).isin("null", "{}")
    return (
        frames.withColumn("_body", frame_body(F.col("line")))
        .withColumn("_frame", whole_frame(F.col("_body")))
        .withColumns(
            {
                "completion_tokens": F.when(told, usage_tokens(usage, "completion_tokens")),
                "prompt_tokens": F.when(told, usage_tokens(usage, "prompt_tokens")),
                "chunks": F.greatest(F.coalesce(F.size(chunks), F.lit(0)), F.lit(0)),
                "is_end": F.coalesce(F.col("_body") == "[DONE]", F.lit(False)),
            }
        )
        .drop("_body", "_frame")
    )


def _read(parsed: DataFrame) -> DataFrame:
    # Numbers only: with text in its buffers Spark would sort all frames first.
    told_at = F.when(F.col("completion_tokens").isNotNull(), F.col("seq"))
    ends = F.min(F.when(F.col("is_end"), F.col("seq")))
    return parsed.groupBy("request_id").agg(
        F.min("sent_us").alias("sent_us"),
        F.min(F.when(F.col("chunks") > 0, F.col("at_us"))).alias("first_us"),
        F.max("at_us").alias("last_us"),
        F.sum("chunks").alias("chunks"),
        F.max_by("completion_tokens", told_at).alias("completion_tokens"),
        F.max_by("prompt_tokens", told_at).alias("prompt_tokens"),
        F.bool_or("is_end").alias("done"),
        ends.alias("_end"),
        (ends < F.max("seq")).alias("_overrun"),
        F.count("*").alias("_n"),
    )


def read_requests(frames: DataFrame) -> DataFrame:
    """What a client has read of each request: up to its end marker, if it came.

    Frames are read once, and the one row of each request is pinned. Only if a request has frames behind
    its end marker, which a sound server never sends, are its frames parsed again, without those.
    """
    first = pin(_read(with_frame_columns(frames)))
    overrun = F.coalesce("_overrun", F.lit(False))
    cuts = first.where(overrun).select("request_id", "_end", "_n")
    sound = first.where(~overrun).drop("_end", "_overrun", "_n")
    if cuts.isEmpty():
        return sound
    cut = salted_join(frames, cuts, ["request_id"], "_n").where("seq <= _end").drop("_end")
    return sound.unionByName(_read(with_frame_columns(cut)).drop("_end", "_overrun", "_n"))


def sse_to_requests(frames: DataFrame) -> DataFrame:
    """Wall time, time to first token, chunks and usage of each streamed request.

    `frames` carries request_id, seq, sent_us, at_us and line. A request without
    usage keeps zero tokens and is refused by the rate operators.
    """
    return read_requests(frames).select(
        "request_id",
        F.col("sent_us").alias("started_us"),
        ((F.col("last_us") - F.col("sent_us")) / 1e6).alias("wall_s"),
        ((F.col("first_us") - F.col("sent_us")) / 1e6).alias("ttft_s"),
        F.col("chunks").alias("sse_chunks"),
        F.coalesce("completion_tokens", F.lit(0)).alias("completion_tokens"),
        F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"),
    )

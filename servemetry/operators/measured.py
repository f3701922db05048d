"""Measured cells from what a benchmark leaves behind: streamed frames and scrape text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.exposition import scrape_readings
from ..sources.frames import sse_to_requests
from ..sources.storage import pin
from .measure import published_cells


def measured_cells(calls: DataFrame, frames: DataFrame, lines: DataFrame, cell: Sequence[str], run: Sequence[str] = ("run",)) -> DataFrame:
    """The published cells of runs, from text alone.

    `calls` says what was asked: request_id, engine, the cell columns and trial. `frames` are the lines
    that came back (request_id, seq, sent_us, at_us, line); a call without any is not measured, nor are frames without a call.
    `lines` are scrapes (source, the engine; scraped_us, line).
    """
    # Narrow and read once for the totals, the ranks and the extents each.
    requests = pin(sse_to_requests(frames).join(calls.select("request_id", "engine", *cell, "trial"), "request_id"))
    readings = scrape_readings(lines).withColumnRenamed("source", "engine")
    # A scrape is told from others by its engine and time.
    return published_cells(requests, readings.withColumn("sample_id", F.lit(0)), cell, run)

"""Router logs, chat files and the advice log, as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import training_rows
from .schemas import CHAT_ROW, ROUTER_LOG


def with_end(log: DataFrame) -> DataFrame:
    """Add start and end; the log has whole seconds and a duration."""
    start = F.col("ts") * 1_000_000
    return log.withColumns({"start_us": start, "end_us": start + F.col("ms") * 1000})


def router_log_scan(spark: SparkSession, path: str) -> DataFrame:
    """Logged decisions. Refusals and unreachable backends were never logged."""
    return with_end(spark.read.schema(ROUTER_LOG).json(path))


def router_log_stream(spark: SparkSession, path: str) -> DataFrame:
    return with_end(spark.readStream.schema(ROUTER_LOG).json(path))


def router_log_sink(log: DataFrame, path: str) -> None:
    log.select("ts", "lane", "backend", "rule", "path", "status", "ms").write.mode("append").json(path)


def chat_jsonl_scan(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Training texts of JSON lines that hold a text or a list of messages.

    Blank lines and rows with neither are skipped; a file without any usable
    row is an error.
    """
    rows = training_rows(spark.read.schema(CHAT_ROW).option("mode", mode).json(path))
    if rows.limit(1).isEmpty():
        raise ValueError(f"no usable rows in {path}")
    return rows


def advice_sink(advice: DataFrame, path: str) -> None:
    """Append advice rows as JSON lines; nothing written is ever changed."""
    advice.write.mode("append").json(path)


def iso_utc(micros: Column) -> Column:
    """UTC stamp as text, to the second."""
    utc = F.to_utc_timestamp(F.timestamp_micros(micros), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")

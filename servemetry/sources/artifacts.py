"""Benchmark artifacts and retrieval reports as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numeric import plain_number
from .schemas import ARTIFACT, CELL, RETRIEVAL

CORRECTION_TOLERANCE = 0.0006


def artifact_scan(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per cell of every artifact, whatever its age.

    Old artifacts have prompt_tokens only; corrected ones keep the raw
    acceptance, of which the published one must be half.
    """
    runs = spark.read.schema(ARTIFACT).option("multiLine", multi_line).json(path)
    cells = runs.select(
        F.col("_metadata.file_path").alias("artifact"),
        "lane",
        "suite",
        "model",
        "trials",
        "elapsed_s",
        "utc",
        "environment.gpu",
        F.explode_outer("cells").alias("c"),
    )
    halved = F.abs(F.col("c.acceptance") - F.col("c.acceptance_raw") / 2) <= CORRECTION_TOLERANCE
    return cells.select(
        *[c for c in cells.columns if c != "c"],
        F.coalesce("c.prompt_tokens_actual", "c.prompt_tokens_nominal", "c.prompt_tokens").alias("prompt_tokens"),
        F.coalesce("c.prompt_tokens_nominal", "c.prompt_tokens").alias("prompt_tokens_nominal"),
        "c.prompt_tokens_actual",
        "c.concurrency",
        "c.thinking",
        "c.per_stream_tok_s",
        "c.aggregate_tok_s",
        "c.ttft_p50_s",
        "c.ttft_p95_s",
        "c.acceptance",
        "c.acceptance_raw",
        halved.alias("correction_holds"),
        "c.tokens_per_sse_chunk",
        "c.class",
    )


def retrieval_scan(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per case of every retrieval report."""
    reports = spark.read.schema(RETRIEVAL).option("multiLine", multi_line).json(path)
    return reports.select(
        F.col("_metadata.file_path").alias("report"), "verdict", "why", F.explode("cases").alias("c")
    ).select("report", "verdict", "why", "c.*")


def artifact_documents(cells: DataFrame) -> DataFrame:
    """One document per date, lane and suite: what is known of the run, and its cells nested.

    A suite bounds the cells of a document. Columns that are not there are left out.
    """
    header = [h for h in ("model", "elapsed_s", "utc", "environment") if h in cells.columns]
    summed = [F.max(h).alias(h) for h in header]
    if "trials" in cells.columns:
        summed.append(F.min("trials").cast("int").alias("trials"))
    fields = [f for f in StructType.fromDDL(f"c {CELL}")["c"].dataType.names if f in cells.columns]
    return cells.groupBy("date", "lane", "suite").agg(*summed, F.collect_list(F.struct(*fields)).alias("cells"))


def artifact_sink(cells: DataFrame, path: str) -> None:
    """Write the documents of cells under date, lane and suite; a repeated run replaces its own folder.

    `artifact_scan` reads them back, cell for cell.
    """
    (
        artifact_documents(cells)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date", "lane", "suite")
        .json(path)
    )


def report_rows(cells: DataFrame) -> DataFrame:
    """The lines of the published table: '-' for a missing number, on or off for thinking."""

    def shown(name: str) -> Column:
        return F.coalesce(plain_number(F.col(name)), F.lit("-"))

    prompt = F.coalesce(
        F.nullif("class", F.lit("")),
        F.nullif("prompt_tokens_actual", F.lit(0)).cast("string"),
        F.col("prompt_tokens_nominal").cast("string"),
    )
    fields = [
        prompt,
        F.col("concurrency").cast("string"),
        F.when(F.col("thinking"), "on").otherwise("off"),
        *[shown(n) for n in ("per_stream_tok_s", "aggregate_tok_s", "ttft_p50_s", "ttft_p95_s", "acceptance")],
    ]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *fields), F.lit(" |"))
    return cells.withColumn("line", line)

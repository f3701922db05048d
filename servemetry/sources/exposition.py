"""Counter scrapes in the text exposition format."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The engines' series. Only whole names count, so `*_created` and `*_per_pos_total`
# beside them do not.
ENGINES = ("vllm", "sglang")
TOTALS = {
    f"{engine}:{infix}num_{counted}_tokens_total": (engine, metric)
    for engine in ENGINES
    for infix in ("", "spec_decode_")
    for counted, metric in (("accepted", "accepted"), ("draft", "drafted"))
}
RATE = "sglang:spec_accept_rate"

# A sample is a name, labels in braces and a number. A quoted value may hold any character; a
# backslash takes the next one with it. No character can be read in two ways, so nothing need be given
# back (`++`, `*+`): a run of characters is one step, and long labels are no deep recursion.
_QUOTED = r'"((?:[^"\\]++|\\.)*+)"'
_SAMPLE = r'^([^\s{]++)(\{(?:[^"}]++|"(?:[^"\\]++|\\.)*+")*+\})\s++(\S++)'
_LABEL = r"([A-Za-z_][A-Za-z0-9_]*)\s*=\s*" + _QUOTED

SCRAPE = ("source", "scraped_us")


def _lines(read: DataFrame, stamp: str) -> DataFrame:
    file = F.col("_metadata.file_path")
    named = F.nullif(F.regexp_extract(file, stamp, 1), F.lit("")).cast("bigint") * 1_000_000
    return read.select(
        file.alias("source"),
        F.regexp_extract(file, "([^/]+)/[^/]*$", 1).alias("engine"),
        F.coalesce(named, F.unix_micros("_metadata.file_modification_time")).alias("scraped_us"),
        F.col("value").alias("line"),
    )


_STAMP = r"([0-9]{10})[^/0-9]*$"


def scrape_lines(spark: SparkSession, path: str, stamp: str = _STAMP) -> DataFrame:
    """Lines of folders of scrapes, one file per scrape; the folder of a file names its engine.

    The time of a scrape is the first group of `stamp` in its file name, in seconds since 1970; where
    the name has none, the time at which the file was last written.
    """
    return _lines(spark.read.option("recursiveFileLookup", True).text(path), stamp)


def scrape_line_stream(spark: SparkSession, path: str, stamp: str = _STAMP, **options) -> DataFrame:
    """The same as a stream that sees each new file; `options` are those of Spark's file source."""
    return _lines(spark.readStream.options(recursiveFileLookup=True, **options).text(path), stamp)


def sample_name(line: Column) -> Column:
    """Name of a sample line with labels; empty for any other line."""
    return F.regexp_extract(line, _SAMPLE, 1)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once, however often and in whatever lambdas `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sample_labels(line: Column) -> Column:
    """Labels of a sample line as an array of (name, value), escapes resolved."""

    def read(braces: Column) -> Column:
        names, values = (F.regexp_extract_all(braces, F.lit(_LABEL), F.lit(i)) for i in (1, 2))
        plain = F.transform(values, lambda v: F.when(F.contains(v, F.lit("\\")), _unescaped(v)).otherwise(v))
        return F.arrays_zip(names.alias("name"), plain.alias("value"))

    return _once(F.regexp_extract(line, _SAMPLE, 2), read)


def _unescaped(value: Column) -> Column:
    return F.regexp_replace(F.replace(value, F.lit("\\n"), F.lit("\n")), r'\\(["\\])', "$1")


def label_map(line: Column) -> Column:
    """Labels of a sample line as a map; of a name given twice the last value counts."""

    def last_of_each(labels: Column) -> Column:
        later = F.filter(labels, lambda x, i: ~F.exists(F.slice(labels, i + 2, F.size(labels)), lambda y: y["name"] == x["name"]))
        return F.map_from_entries(later)

    # Bound first: inside a lambda the expressions of the line would run again for every label.
    none = F.array().cast("array<struct<name:string,value:string>>")
    return _once(F.coalesce(sample_labels(line), none), last_of_each)


def sample_value(line: Column) -> Column:
    """Number of a sample line; null if there is none."""
    return F.regexp_extract(line, _SAMPLE, 3).try_cast("double")


def _told(lines: DataFrame) -> DataFrame:
    """The lines of the series that count, with name and value; other lines keep null ones."""
    line = F.col("line")
    likely = F.contains(line, F.lit("_tokens_total{")) | F.startswith(line, F.lit(RATE + "{"))
    return lines.withColumns({"_name": F.when(likely, sample_name(line)), "_value": F.when(likely, sample_value(line))})


def _of(name: Column, part: int) -> Column:
    """Engine (0) or metric (1) of a total's name; null for other names."""
    found = F.lit(None).cast("string")
    for series, told in TOTALS.items():
        found = F.when(name == series, told[part]).otherwise(found)
    return found


def counter_scan(lines: DataFrame, scrape: Sequence[str] = SCRAPE) -> DataFrame:
    """The accepted and drafted totals of each scrape, summed over label sets."""
    return (
        _told(lines)
        .where(F.col("_name").isin(*TOTALS))
        .select(*scrape, _of(F.col("_name"), 0).alias("engine_family"), _of(F.col("_name"), 1).alias("metric"), "_value")
        .groupBy(*scrape, "engine_family", "metric")
        .agg(F.sum("_value").alias("value"))
    )


def scrape_readings(lines: DataFrame, scrape: Sequence[str] = SCRAPE) -> DataFrame:
    """One reading per scrape: counters, else the mean rate gauge, else nothing.

    `kind` is null for a scrape that held neither.
    """
    metric, value = _of(F.col("_name"), 1), F.col("_value")
    sums = _told(lines).groupBy(*scrape).agg(
        F.sum(F.when(metric == "accepted", value)).alias("accepted"),
        F.sum(F.when(metric == "drafted", value)).alias("drafted"),
        F.avg(F.when(F.col("_name") == RATE, value)).alias("rate"),
    )
    counted = F.col("accepted").isNotNull() & F.col("drafted").isNotNull()
    gauged = ~counted & F.col("rate").isNotNull()
    return sums.select(
        *scrape,
        F.when(counted, "counter").when(gauged, "gauge").alias("kind"),
        F.when(counted, F.col("accepted")).alias("accepted"),
        F.when(counted, F.col("drafted")).alias("drafted"),
        F.when(gauged, F.col("rate")).alias("rate"),
    )


def series_samples(lines: DataFrame, scrape: Sequence[str] = SCRAPE) -> DataFrame:
    """The accepted and drafted totals of each scrape series by series: metric, labels (a map), series (their text in order of name), value."""
    labelled = _told(lines).where(F.col("_name").isin(*TOTALS)).withColumn("labels", label_map(F.col("line")))
    in_order = F.sort_array(F.map_entries("labels"))
    series = F.array_join(F.transform(in_order, lambda x: F.concat(x["key"], F.lit("="), F.to_json(F.array(x["value"])))), ",")
    return labelled.select(
        *scrape, _of(F.col("_name"), 0).alias("engine_family"), _of(F.col("_name"), 1).alias("metric"), "labels",
        F.concat("_name", F.lit("{"), series, F.lit("}")).alias("series"), F.col("_value").alias("value"),
    )

"""Streams: draft-depth advice, the token-zero guard with its marks, first-token latency, the log alert.

Windows, duplicates and watermarks are Spark's own; what a window cannot hold stands in Spark's keyed state
(`transformWithState`), so a batch touches the keys it has rows for and a restarted query goes on from its
checkpoint. Lines and token ids are reduced to numbers by column rules before they reach a state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.numeric import order_of
from ..functions.quality import TOKEN_ZERO_RUN
from ..operators.counters import MIN_DRAFT_TOKENS, recommend_k
from ..operators.quality import LOST_GPU
from ..sources.exposition import scrape_readings
from ..sources.frames import with_frame_columns
from ..sources.storage import fresh_path

WINDOW_S = 300
LATE = "10 minutes"
SILENT_S = 7200

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str = "None") -> DataFrame:
    """`processor` over the rows of each key, appending; its state needs the RocksDB store."""
    spark = stream.sparkSession
    if "RocksDB" not in spark.conf.get(_STORE, ""):
        spark.conf.set(_STORE, _ROCKSDB)
    return stream.groupBy(key).transformWithState(processor, schema, "Append", time)


class _Processor(StatefulProcessor):
    """A processor whose only state is one value."""

    state: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)

    def close(self) -> None:
        pass


# Draft-depth advice ------------------------------------------------------


def window_ticks(samples: DataFrame, window_s: int = WINDOW_S, late: str = LATE) -> DataFrame:
    """The last scrape of each engine and closed tumbling window, reduced map-side."""
    last = order_of(samples, "scraped_us", "sample_id")
    return (
        samples.withColumn("at", F.timestamp_micros("scraped_us"))
        .withWatermark("at", late)
        .groupBy("engine", F.window("at", f"{window_s} seconds"))
        .agg(
            F.max_by(F.col("kind") == "counter", last).alias("_counter"),
            F.max_by("accepted", last).alias("accepted"),
            F.max_by("drafted", last).alias("drafted"),
        )
        .select("engine", F.unix_micros("window.end").alias("window_end_us"), F.col("_counter").alias("counted"), "accepted", "drafted")
    )


class WindowDelta(_Processor):
    """The delta of each closed window to the engine's last counters, which are the state.

    A window without counters keeps them, so the next delta spans it. The engine's first window only
    starts the series.
    """

    state = "accepted double, drafted double"
    rows = "engine {key}, window_end_us long, status string, draft_tokens double, acceptance double"

    def __init__(self, min_draft: float):
        self.min_draft = min_draft

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self.held.get()
        for r in sorted(rows, key=lambda r: r.window_end_us):
            moved = r.drafted - before[1] if before and r.counted else None
            status, acceptance = "ok", None
            if before is None:
                status = "starting"
            elif moved is None:
                status = "metrics-unavailable"
            elif moved < self.min_draft:
                status = "insufficient traffic"
            else:
                acceptance = (r.accepted - before[0]) / moved
            yield Row(engine=key[0], window_end_us=r.window_end_us, status=status, draft_tokens=moved, acceptance=acceptance)
            if r.counted:
                before = (r.accepted, r.drafted)
                self.held.update(before)


def advice_stream(ticks: DataFrame, *, window_s: int = WINDOW_S, min_draft: float = MIN_DRAFT_TOKENS, **depths) -> DataFrame:
    """Draft-depth advice per engine and closed window, as a stream."""
    schema = WindowDelta.rows.format(key=ticks.schema["engine"].dataType.simpleString())
    told = recommend_k(_keyed(ticks, "engine", WindowDelta(min_draft), schema), **depths)
    return told.select("engine", "window_end_us", F.lit(window_s).alias("window_s"), "status", "draft_tokens", "advice.*")


def live_acceptance(samples: DataFrame, *, window_s: int = WINDOW_S, late: str = LATE, folder: str | None = None, **rules) -> DataFrame:
    """Advice on a stream of samples, over everything there is now."""
    return drain(advice_stream(window_ticks(samples, window_s, late), window_s=window_s, **rules), "live-acceptance", folder)


def scrape_ticks(lines: DataFrame, window_s: int = WINDOW_S, late: str = LATE) -> DataFrame:
    """Window ticks from a stream of scrape lines (engine, scraped_us, line).

    A line that is delivered again while its scrape may still come late counts once. The series of a
    scrape are summed when its window closes, and the window's last scrape is its tick.
    """
    timed = lines.select("engine", "scraped_us", "line", F.timestamp_micros("scraped_us").alias("at"))
    once = timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["engine", "scraped_us", "line"])
    windowed = once.withColumn("window", F.window("at", f"{window_s} seconds"))
    readings = scrape_readings(windowed, ("engine", "window", "scraped_us"))
    return (
        readings.groupBy("engine", "window")
        .agg(
            F.max_by(F.coalesce(F.col("kind") == "counter", F.lit(False)), "scraped_us").alias("counted"),
            F.max_by("accepted", "scraped_us").alias("accepted"),
            F.max_by("drafted", "scraped_us").alias("drafted"),
        )
        .select("engine", F.unix_micros("window.end").alias("window_end_us"), "counted", "accepted", "drafted")
    )


def scrape_advice(lines: DataFrame, *, window_s: int = WINDOW_S, late: str = LATE, **rules) -> DataFrame:
    """Advice on a stream of scrape lines."""
    return advice_stream(scrape_ticks(lines, window_s, late), window_s=window_s, **rules)


def start_advice(lines: DataFrame, path: str, progress: str, *, trigger: dict | None = None, **rules) -> StreamingQuery:
    """Append advice on scrape lines to JSON files under `path`, each engine and window exactly once.

    `progress` keeps the query's place: started again after a failure it goes on there, and the files'
    own log tells readers which of them count. `trigger` is that of `DataStreamWriter.trigger`; without
    one the query ends with the input there is now.
    """
    advice = scrape_advice(lines, **rules)
    return (
        advice.writeStream.outputMode("append").format("json").option("path", path).option("checkpointLocation", progress)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


# Token-zero guard --------------------------------------------------------


def zero_runs(chunks: DataFrame, run: int = TOKEN_ZERO_RUN) -> DataFrame:
    """Chunks (request_id, pos, ids, ...) with numbers instead of ids: size, zeros in front and behind, place of the first run inside."""
    shape = F.array_join(F.transform("ids", lambda t: F.when(t == 0, "0").otherwise("x")), "")
    place = F.locate("0" * run, F.col("_shape"))
    kept = [c for c in chunks.columns if c != "ids"]
    return chunks.withColumn("_shape", shape).select(
        *kept,
        F.size("ids").alias("size"),
        (F.size("ids") - F.length(F.ltrim(F.col("_shape"), F.lit("0")))).alias("front"),
        (F.size("ids") - F.length(F.rtrim(F.col("_shape"), F.lit("0")))).alias("behind"),
        F.when(place > 0, place + run - 1).alias("inside"),
    )


class ZeroRun(_Processor):
    """Where a request's first run of zeros ends; state are the zeros that stand at its end so far.

    `every` reports each request at its last chunk (`is_last`), looping or not; else only those that loop,
    as soon as they do. State that no chunk has touched for `keep_ms` of event time is cleared by its timer.
    """

    state = "zeros long, finished long, last_ms long"
    rows = "request_id {key}, server string, seq long, restart boolean, finished_len long"

    def __init__(self, run: int, every: bool, keep_ms: int):
        self.run, self.every, self.keep_ms = run, every, keep_ms

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        zeros, finished, last_ms = self.held.get() or (0, None, 0)
        last = None
        for r in sorted(rows, key=lambda r: r.pos):
            end, last_ms = None, max(last_ms, r.at_us // 1000)
            if finished is None:
                ahead = min(zeros, self.run - 1)
                end = self.run - ahead if ahead and ahead + r.front >= self.run else r.inside
            zeros = zeros + r.size if r.front == r.size else r.behind
            if end is not None:
                finished = r.pos + end - self.run + 1
            if (r.is_last if self.every else end is not None):
                last = r
        if last is not None:
            yield Row(request_id=key[0], server=last.server, seq=last.seq, restart=last.restart, finished_len=finished)
        self.held.update((zeros, finished, last_ms))
        self.handle.registerTimer(last_ms + self.keep_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self.held.get()
        if held is not None and expiredTimerInfo.getExpiryTimeInMs() >= held[2] + self.keep_ms:
            self.held.clear()
        yield from ()


class Suspects(_Processor):
    """Outputs of a server that follow a looping one since its last restart; the epoch and whether one looped are the state."""

    state = "epoch long, poisoned boolean"
    rows = "server string, seq long, epoch long, is_loop boolean, suspect boolean"

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        epoch, poisoned = self.held.get() or (0, False)
        for r in sorted(rows, key=lambda r: r.seq):
            if r.restart:
                epoch, poisoned = epoch + 1, False
            loops = r.finished_len is not None
            yield Row(server=key[0], seq=r.seq, epoch=epoch, is_loop=loops, suspect=poisoned)
            poisoned = poisoned or loops
        self.held.update((epoch, poisoned))


def _guarded(chunks: DataFrame, run: int, every: bool, silent_s: int, late: str) -> DataFrame:
    known = {c: F.lit(None).cast(kind) for c, kind in (("server", "string"), ("seq", "long"), ("restart", "boolean"), ("is_last", "boolean")) if c not in chunks.columns}
    shaped = zero_runs(chunks.withColumns(known | {"at": F.timestamp_micros("at_us")}), run).withWatermark("at", late)
    schema = ZeroRun.rows.format(key=chunks.schema["request_id"].dataType.simpleString())
    return _keyed(shaped, "request_id", ZeroRun(run, every, silent_s * 1000), schema, "EventTime")


def token0_guard(
    chunks: DataFrame, *, run: int = TOKEN_ZERO_RUN, silent_s: int = SILENT_S, late: str = LATE, folder: str | None = None
) -> DataFrame:
    """Requests that looped, each once, and where to cut them, over everything there is now.

    `chunks` carries request_id of any type, pos (ids before the chunk), at_us and ids. A request's chunks
    come in order of pos from batch to batch.
    """
    found = _guarded(chunks, run, False, silent_s, late).select("request_id", "finished_len")
    return drain(found, "token0-guard", folder)


def suspect_stream(chunks: DataFrame, *, run: int = TOKEN_ZERO_RUN, silent_s: int = SILENT_S, late: str = LATE) -> DataFrame:
    """Marks of all outputs, as a stream: the guard, and behind it what each server did before.

    `chunks` also carry server, seq (the order of a server's outputs, in which they end), restart and is_last.
    """
    ended = _guarded(chunks, run, True, silent_s, late)
    return _keyed(ended, "server", Suspects(), Suspects.rows)


# First token latency -----------------------------------------------------


class OpenRequests(StatefulProcessor):
    """The requests of a bucket from their frames; state is one row for each that is open or lately finished.

    A request ends with its end marker, or when the watermark is `silent_ms` past its last frame. A finished
    request is remembered until the watermark passes its last frame, so that frames behind the marker
    count nowhere. A bucket has one timer, for the first of its requests that falls due: the store is asked
    a few times for a bucket and not for each request.
    """

    state = "request_id {key}, sent long, first long, last long, chunks long, tokens long, done boolean"
    rows = "request_id {key}, ended string, sent_us long, first_us long, last_us long, chunks long, completion_tokens long"

    def __init__(self, silent_ms: int, key: str):
        self.silent_ms, self.key = silent_ms, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.state.format(key=self.key))
        self.due = handle.getValueState("due", "at_ms long")

    def close(self) -> None:
        pass

    def _row(self, ended: str, held: tuple) -> Row:
        name, sent, first, last, chunks, tokens, _ = held
        return Row(request_id=name, ended=ended, sent_us=sent, first_us=first, last_us=last, chunks=chunks, completion_tokens=tokens)

    def _expiry(self, held: tuple) -> int:
        return held[3] // 1000 + (1 if held[6] else self.silent_ms)

    def _keep(self, held: list[tuple], fired: int | None = None) -> None:
        """Store the requests and set the timer to the first that falls due; the timer that has `fired` is gone by itself."""
        told = self.due.get()
        told = told[0] if told else None
        now = min(map(self._expiry, held), default=None)
        if told is not None and told not in (now, fired):
            self.handle.deleteTimer(told)
        if held:
            self.held.put(held)
            if now != told:
                self.handle.registerTimer(now)
                self.due.update((now,))
        else:
            self.held.clear()
            self.due.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # Any type of id can be told by its text.
        held = {repr(h[0]): tuple(h) for h in self.held.get()}
        came: dict[str, list] = {}
        for r in rows:
            name = repr(r.request_id)
            before = held.get(name)
            if before is None or not before[6]:
                came.setdefault(name, []).append((r.seq, r.request_id, r.sent_us, r.at_us, r.chunks, r.completion_tokens, r.is_end))
        for name, frames in came.items():
            held[name] = now = self._read(held.get(name), frames)
            if now[6]:
                yield self._row("done", now)
        if came:
            self._keep(list(held.values()))

    def _read(self, before: tuple | None, frames: list[tuple]) -> tuple:
        _, sent, first, last, chunks, tokens, done = before or (None, None, None, None, 0, None, False)
        for _, _, sent_us, at_us, n, told, is_end in sorted(frames, key=lambda f: f[0]):
            sent = sent_us if sent is None else min(sent, sent_us)
            last = at_us if last is None else max(last, at_us)
            if n:
                chunks, first = chunks + n, at_us if first is None else min(first, at_us)
            tokens = tokens if told is None else told
            if is_end:
                done = True
                break
        return (frames[0][1], sent, first, last, chunks, tokens, done)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        # All that a timer of their own would have told of by now.
        fired, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        kept = []
        for h in map(tuple, self.held.get()):
            at = self._expiry(h)
            if at > fired and at >= passed:
                kept.append(h)
            elif not h[6]:
                yield self._row("timeout", h)
        self._keep(kept, fired)


#: Buckets of requests; a stream's checkpoint holds it, so it must stay.
REQUEST_BUCKETS = 2048


def latency_stream(frames: DataFrame, *, late: str = LATE, silent_s: int = SILENT_S) -> DataFrame:
    """Time to first token and rate of each live request, at its end or when it falls silent, as a stream."""
    parsed = with_frame_columns(frames).select(
        "request_id", "seq", "sent_us", "at_us", "chunks", "completion_tokens", "is_end", F.timestamp_micros("at_us").alias("at")
    )
    key = frames.schema["request_id"].dataType.simpleString()
    dealt = parsed.withWatermark("at", late).withColumn("bucket", F.pmod(F.xxhash64("request_id"), F.lit(REQUEST_BUCKETS)).cast("int"))
    rows = _keyed(dealt, "bucket", OpenRequests(silent_s * 1000, key), OpenRequests.rows.format(key=key), "EventTime")
    wall = (F.col("last_us") - F.col("sent_us")) / 1e6
    tokens = F.coalesce("completion_tokens", F.lit(0))
    return rows.select(
        "request_id",
        "ended",
        wall.alias("wall_s"),
        ((F.col("first_us") - F.col("sent_us")) / 1e6).alias("ttft_s"),
        F.col("chunks").alias("sse_chunks"),
        tokens.alias("completion_tokens"),
        F.when((tokens > 0) & (wall > 0), tokens / wall).alias("tok_s"),
    )


def first_token_latency(frames: DataFrame, *, folder: str | None = None, **limits) -> DataFrame:
    """The same over everything there is now; ids of any type."""
    return drain(latency_stream(frames, **limits), "first-token", folder)


# Log alert ---------------------------------------------------------------


def log_signature_alert(logs: DataFrame, *, signature: str = LOST_GPU, window: str = "24 hours", slide: str = "1 hour", late: str = LATE) -> DataFrame:
    """Containers that logged the signature within the `window` before each full `slide`; a closed window is told once."""
    return (
        logs.where(F.contains("line", F.lit(signature)))
        .withWatermark("at", late)
        .groupBy("container", F.window("at", window, slide))
        .agg(F.count("*").alias("lines"), F.max("at").alias("last_at"))
        .select("container", F.unix_micros("window.end").alias("told_us"), "lines", F.unix_micros("last_at").alias("last_us"))
    )


# Router log --------------------------------------------------------------


def live_routes(log: DataFrame, *, window_s: int = WINDOW_S, late: str = LATE, keys: tuple[str, ...] = ("lane", "backend", "rule")) -> DataFrame:
    """What each route did in each closed window of arrivals: requests, status mix, mean and longest time.

    `log` is a stream of logged decisions with their start (`sources.logs.router_log_stream`). A request is logged when it ends,
    so one that takes longer than `late` beyond the newest arrival seen is not counted.
    """
    mix = {"ok": (200, 299), "client_errors": (400, 499), "server_errors": (500, 599)}
    return (
        log.withColumn("at", F.timestamp_micros("start_us"))
        .withWatermark("at", late)
        .groupBy(*keys, F.window("at", f"{window_s} seconds"))
        .agg(
            F.count("*").alias("requests"),
            *[F.count_if(F.col("status").between(*codes)).alias(name) for name, codes in mix.items()],
            (F.sum("ms") / F.count("ms")).alias("mean_ms"),
            F.max("ms").alias("longest_ms"),
        )
        .select(*keys, F.unix_micros("window.end").alias("window_end_us"), "requests", *mix, "mean_ms", "longest_ms")
    )


def drain(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Append a stream to a table, over everything there is now, and read it back."""
    spark: SparkSession = stream.sparkSession
    folder = folder or fresh_path(spark, label)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

"""Streams fed file by file agree with their batch twins."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from servemetry.operators import counters, quality
from servemetry.sources import exposition, logs
from servemetry.sources import frames as sse
from servemetry.sources.storage import fresh_path
from servemetry.streaming import live

MINUTE = 60_000_000
#: Real times lie well behind 1970, where an empty watermark stands.
START = 1_700_000_000_000_000


def parts(rows, files, order):
    rows, size = sorted(rows, key=order), -(-len(rows) // files)
    return [rows[i * size : (i + 1) * size] for i in range(files)]


def add_file(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def as_stream(spark, rows, schema, files, order):
    """The rows as a stream of `files` micro-batches, in order."""
    path = fresh_path(spark, "stream-test")
    for part in parts(rows, files, order):
        add_file(spark, path, part, schema)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def engine_samples(rng):
    rows, totals = [], {}
    for i in range(400):
        engine = "hot" if rng.random() < 0.7 else "cold"
        acc, dra = totals.get(engine, (0, 0))
        step = rng.randint(0, 900)
        totals[engine] = (acc + int(step * rng.random()), dra + step)
        if rng.random() < 0.05:
            totals[engine] = (0, 0)
        ok = rng.random() < 0.8
        rows.append((engine, START + i * MINUTE, i, "counter" if ok else None, *(map(float, totals[engine]) if ok else (None, None)), None))
    return rows


SAMPLE = "engine string, scraped_us long, sample_id long, kind string, accepted double, drafted double, rate double"


def closed_advice(spark, rows):
    ticks = counters.ticks_per_window(spark.createDataFrame(rows, SAMPLE))
    batch = counters.recommend_k(counters.counter_window_delta(ticks.withColumn("scraped_us", F.col("window_end_us"))))
    newest = max(r[1] for r in rows) - 10 * MINUTE
    return {(r.engine, r.scraped_us): r for r in batch.collect() if r.scraped_us <= newest}


def same_advice(got, want):
    assert len(got) == len(want) and {(r.engine, r.window_end_us) for r in got} == set(want)
    for r in got:
        twin = want[(r.engine, r.window_end_us)]
        assert (r.status, r.draft_tokens) == (twin.status, twin.draft_tokens)
        assert r.recommended_k == (twin.advice.recommended_k if twin.advice else None)


def test_live_acceptance_equals_batch_on_closed_windows(spark):
    rows = engine_samples(random.Random(4))
    got = live.live_acceptance(as_stream(spark, rows, SAMPLE, 4, lambda r: r[1])).collect()
    same_advice(got, closed_advice(spark, rows))
    assert {"ok", "insufficient traffic", "metrics-unavailable"} <= {r.status for r in got}


def test_advice_service_from_scrape_text_restarted_in_between(spark, tmp_path):
    """Scrape files come in bits, some twice; the service is ended and started again, and each window is told once."""
    rows = [r for r in engine_samples(random.Random(9)) if r[3]]
    path, out, progress = (str(tmp_path / name) for name in ("scrapes", "advice", "progress"))
    (tmp_path / "scrapes").mkdir()
    lines = exposition.scrape_line_stream(spark, path, maxFilesPerTrigger=40)
    for part, rows_now in enumerate(parts(rows, 3, lambda r: r[1])):
        for engine, at, number, _, accepted, drafted, _ in rows_now:
            text = f'vllm:num_accepted_tokens_total{{w="0"}} {int(accepted)}\nvllm:num_accepted_tokens_total{{w="1"}} 0\nvllm:num_draft_tokens_total{{w="0"}} {int(drafted)}\n# end\n'
            for copy in range(1 + (number % 7 == 0)):
                file = tmp_path / "scrapes" / engine / f"{'again' if copy else 'scrape'}-{at // 1_000_000}.txt"
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_text(text)
        live.start_advice(lines, out, progress).awaitTermination()
        assert len(spark.read.json(out).collect()) > 20 * part
    got = spark.read.schema(live.scrape_advice(lines).schema).json(out).collect()
    same_advice(got, closed_advice(spark, rows))


def last_state(folder):
    """Rows in each stateful operator after the last batch, by the query's own account."""
    return folder.lastProgress["stateOperators"]


def test_only_engines_stand_in_the_advice_state(spark, tmp_path):
    rows = engine_samples(random.Random(5))
    advice = live.advice_stream(live.window_ticks(as_stream(spark, rows, SAMPLE, 4, lambda r: r[1])))
    query = advice.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
    query.awaitTermination()
    operators = {o["operatorName"]: o["numRowsTotal"] for o in last_state(query)}
    assert operators["transformWithStateInPySparkExec"] == 2 and operators["stateStoreSave"] < 12


CHUNK = "request_id {id}, pos long, at_us long, ids array<long>, server string, seq long, restart boolean, is_last boolean"


def chunked(rng, requests, name=int):
    rows = []
    for rid, ids in requests.items():
        pos = 0
        while True:
            size = rng.randint(1, 20)
            rows.append((name(rid), pos, START + pos * 1000, ids[pos : pos + size], f"s{rid % 3}", rid, rid % 11 == 0, pos + size >= len(ids)))
            pos += size
            if pos >= len(ids):
                break
    return rows


def zero_requests(rng):
    requests = {1: [0] * 16, 2: [7, 3] + [0] * 16, 3: [0] * 15 + [1] + [0] * 15, 4: [5] * 40, 5: [1] + [0] * 40 + [2]}
    return requests | {i: [0 if rng.random() < 0.9 else 9 for _ in range(rng.randint(0, 90))] for i in range(6, 60)}


def first_run(ids):
    return next((n - 15 for n in range(16, len(ids) + 1) if not any(ids[n - 16 : n])), None)


@pytest.mark.parametrize(("files", "name"), [(1, int), (5, int), (3, "req-{}".format)])
def test_token0_guard_across_batches(spark, files, name):
    rng = random.Random(files)
    requests = zero_requests(rng)
    schema = CHUNK.format(id="long" if name is int else "string")
    stream = as_stream(spark, chunked(rng, requests, name), schema, files, lambda r: (r[1], r[5])).select("request_id", "pos", "at_us", "ids")
    got = [(r.request_id, r.finished_len) for r in live.token0_guard(stream).collect()]
    want = {name(rid): first_run(ids) for rid, ids in requests.items() if first_run(ids)}
    assert len(got) == len(set(got)) and dict(got) == want


@pytest.mark.parametrize("files", [1, 4])
def test_suspect_stream_equals_sticky_poison(spark, files):
    """Outputs end one after the other; what the guard finds marks the later ones of the same server until it starts again."""
    rng = random.Random(files)
    requests = zero_requests(rng)
    rows = chunked(rng, requests)
    stream = as_stream(spark, rows, CHUNK.format(id="long"), files, lambda r: (r[5], r[1]))
    got = sorted((r.server, r.seq, r.epoch, r.is_loop, r.suspect) for r in live.drain(live.suspect_stream(stream, late="30 days"), "suspects").collect())
    texts = [(f"s{rid % 3}", rid, None, "".join("!" if t == 0 else "x" for t in ids), rid % 11 == 0) for rid, ids in requests.items()]
    outputs = spark.createDataFrame(texts, "server string, seq long, reasoning_content string, content string, restart boolean")
    assert got == sorted((r.server, r.seq, r.epoch, r.is_loop, r.suspect) for r in quality.sticky_poison(outputs).collect())


FRAME = "request_id long, seq int, sent_us long, at_us long, line string"


def frames_of(rng, rid, sent):
    lines = ['data: {"choices":[{"delta":{"content":"x"}}]}' if rng.random() < 0.7 else ": ping" for _ in range(rng.randint(1, 9))]
    if rng.random() < 0.8:
        lines.append('data: {"choices":[],"usage":{"completion_tokens":%d}}' % rng.randint(1, 50))
    if rid % 4:
        lines += ["data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}],"usage":{"completion_tokens":999}}']
    return [(rid, i, START + sent, START + sent + (i + 1) * MINUTE, line) for i, line in enumerate(lines)]


def test_first_token_latency_across_batches(spark):
    rng = random.Random(8)
    rows = [f for rid in range(80) for f in frames_of(rng, rid, rid * MINUTE // 2)]
    rows.append((1000, 0, START + 10_000 * MINUTE, START + 10_000 * MINUTE, ": ping"))
    got = live.first_token_latency(as_stream(spark, rows, FRAME, 4, lambda r: r[3])).collect()
    batch = {r.request_id: r for r in sse.sse_to_requests(spark.createDataFrame(rows, FRAME)).collect()}
    batch.pop(1000)
    assert len(got) == len(batch) and {r.request_id for r in got} == set(batch)
    for r in got:
        twin = batch[r.request_id]
        assert r.ended == ("done" if r.request_id % 4 else "timeout")
        assert (r.wall_s, r.ttft_s, r.sse_chunks, r.completion_tokens) == (twin.wall_s, twin.ttft_s, twin.sse_chunks, twin.completion_tokens)


class CountedStore:
    """A state handle that counts what the store is asked."""

    def __init__(self):
        self.asked, self.timers = 0, set()

    def getListState(self, name, schema):
        return CountedStore.Held(self, [])

    def getValueState(self, name, schema):
        return CountedStore.Held(self, None)

    def registerTimer(self, at):
        self.asked += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.asked += 1
        self.timers.remove(at)

    class Held:
        def __init__(self, store, empty):
            self.store, self.empty, self.value = store, empty, empty

        def get(self):
            self.store.asked += 1
            return self.value

        def put(self, value):
            self.store.asked += 1
            self.value = value

        update = put

        def clear(self):
            self.put(self.empty)


def test_a_bucket_asks_the_store_a_few_times(spark):
    store, bucket = CountedStore(), live.OpenRequests(7200_000, "long")
    bucket.init(store)
    ids = [None, *range(500)]
    columns = ("request_id", "seq", "sent_us", "at_us", "chunks", "completion_tokens", "is_end")
    frames = [Row(**dict(zip(columns, (i, n, 0, (i or 0) * 1000 + n, 1, None, n == 1 and i is not None and i % 2 == 0)))) for n in (1, 0) for i in ids]
    told = list(bucket.handleInputRows((1,), iter(frames), None))
    assert sorted(r.request_id for r in told) == list(range(0, 500, 2)) and {(r.ended, r.chunks) for r in told} == {("done", 2)}
    assert store.asked < 10 and store.timers == {1}
    # Frames behind the marker count nowhere; those of an open request move its end.
    late = [Row(**dict(zip(columns, (i, 2, 0, 900_000, 1, None, False)))) for i in (0, 1)]
    assert list(bucket.handleInputRows((1,), iter(late), None)) == []

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getExpiryTimeInMs(self):
            return self.ms

        getCurrentWatermarkInMs = getExpiryTimeInMs

    def fire(ms):
        due = [t for t in store.timers if t <= ms]
        store.timers -= set(due)
        return [r for t in due for r in bucket.handleExpiredTimer((1,), At(ms), At(t))]

    assert fire(600) == [] and store.timers == {7200_000}  # what had ended is forgotten
    # The open ones fall silent: the null id first, the one that had a later frame last.
    assert [r.request_id for r in fire(7200_002)] == [None] and store.timers == {7200_003}
    assert sorted(r.request_id for r in fire(7200_800)) == list(range(3, 500, 2))
    assert [(r.request_id, r.ended, r.chunks) for r in fire(7200_900)] == [(1, "timeout", 3)] and not store.timers


def test_requests_leave_the_state_and_a_restart_goes_on(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "frames")
    stream = spark.readStream.schema(FRAME).parquet(path) if (add_file(spark, path, [f for rid in range(1, 9) for f in frames_of(rng, rid, 0)], FRAME) or True) else None

    def run():
        query = (
            live.latency_stream(stream).writeStream.format("json").option("path", str(tmp_path / "rows"))
            .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return {o["operatorName"]: o["numRowsTotal"] for o in last_state(query)}["transformWithStateInPySparkExec"]

    first = run()
    # An hour on, what had ended is gone and only requests that never did are left; after three hours they fell silent.
    add_file(spark, path, [f for rid in (101, 102) for f in frames_of(rng, rid, 60 * MINUTE)], FRAME)
    later = run()
    assert first >= 8 and later < first
    add_file(spark, path, [f for rid in (201,) for f in frames_of(rng, rid, 300 * MINUTE)], FRAME)
    run()
    told = [(r.request_id, r.ended) for r in spark.read.schema("request_id long, ended string").json(str(tmp_path / "rows")).collect()]
    assert sorted(told) == sorted([*((n, "done" if n % 4 else "timeout") for n in range(1, 9)), (101, "done"), (102, "done"), (201, "done")])


def log_rows(spark, rows):
    return spark.createDataFrame(rows, "container string, us long, line string").withColumn("at", F.timestamp_micros("us"))


def test_log_alert_looks_a_day_back(spark):
    lost, day = "x ggml_cuda_init: failed y", 24 * 60 * MINUTE
    rows = [("a", START, lost), ("a", START, lost), ("a", START + day, lost), ("a", START + day + 1, lost), ("b", START + 7, "fine"), ("b", START + 8, lost)]
    got = sorted(tuple(r) for r in quality.trailing_lines(log_rows(spark, rows)).collect())
    assert got == [("a", START, 2), ("a", START + day, 3), ("a", START + day + 1, 2), ("b", START + 8, 1)]
    # A line at 23:59 counts at 01:00 of the next day, and no more at 01:00 the day after.
    late = START - START % day + 23 * 60 * MINUTE + 59 * MINUTE
    told = {r.told_us: r.lines for r in live.log_signature_alert(log_rows(spark, [("c", late, lost)])).collect()}
    assert told == {late + MINUTE + n * 60 * MINUTE: 1 for n in range(24)}


def test_labels_and_restarts_are_per_series(spark):
    def scrape(at, first, second, swap):
        a, b = ('w="0",z="x,\\"}"', 'z="x,\\"}",w="0"')
        name = "sglang:num_draft_tokens_total"
        return [("e", at, f"{name}{{{b if swap else a}}} {first}"), ("e", at, f'{name}{{w="1"}} {second}'), ("e", at, "# note")]

    rows = scrape(1, 100, 50, False) + scrape(2, 160, 80, True) + scrape(3, 20, 90, False) + scrape(4, 30, 95, True)
    samples = exposition.series_samples(spark.createDataFrame(rows, "source string, scraped_us long, line string"))
    labels = {json.dumps(r.labels, sort_keys=True) for r in samples.collect()}
    assert labels == {json.dumps({"w": "0", "z": 'x,"}'}), json.dumps({"w": "1"})}
    got = {r.scraped_us: (r.increase, r.restarts) for r in counters.series_increase(samples).collect()}
    # The restart of one worker between 2 and 3 costs nothing but its own lost tokens.
    assert got == {1: (0.0, 0), 2: (90.0, 0), 3: (30.0, 1), 4: (15.0, 0)}


def test_a_line_is_parsed_once_for_its_labels(spark):
    name, wide = "vllm:num_accepted_tokens_total", "x" * 30_000
    many = ",".join(f'l{i % 20}="{i}"' for i in range(30))
    rows = [("e", at, f"{name}{{{labels}}} {at}") for labels in (f'w="{wide}"', many) for at in (1, 2)] + [("e", 3, f'{name}{{w="{wide}}} 3')]
    samples = exposition.series_samples(spark.createDataFrame(rows, "source string, scraped_us long, line string"))
    got = samples.collect()
    assert len(got) == 4 and {len(r.labels) for r in got} == {1, 20}
    assert all(r.labels == {"w": wide} or r.labels == {f"l{i % 20}": str(i) for i in range(30)} for r in got)
    assert {(r.scraped_us, r.increase) for r in counters.series_increase(samples).collect()} == {(1, 0.0), (2, 2.0)}
    plan = samples._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2


def test_live_routes_equal_the_batch(spark):
    rng = random.Random(8)
    rows = [(START // 1_000_000 + 20 * i, rng.choice(["depth", "fleet"]), "b", "default", "/v1", rng.choice([200, 404, 500, None]), rng.choice([5, 70, None])) for i in range(300)]
    schema = "ts long, lane string, backend string, rule string, path string, status int, ms long"
    stream = logs.with_end(as_stream(spark, rows, schema, 5, lambda r: r[0]))
    got = live.drain(live.live_routes(stream), "routes-test").collect()
    want = {}
    for ts, lane, _, _, _, status, ms in rows:
        n = want.setdefault((lane, (ts // 300 + 1) * 300_000_000), [0, 0, 0, 0, []])
        n[0] += 1
        if status:
            n[{200: 1, 404: 2, 500: 3}[status]] += 1
        n[4] += [ms] if ms is not None else []
    newest = rows[-1][0] * 1_000_000 - 10 * MINUTE
    closed = {k: (*n[:4], sum(n[4]) / len(n[4]) if n[4] else None, max(n[4], default=None)) for k, n in want.items() if k[1] <= newest}
    assert {(r.lane, r.window_end_us): (r.requests, r.ok, r.client_errors, r.server_errors, r.mean_ms, r.longest_ms) for r in got} == closed
    assert len(got) == len(closed) > 20

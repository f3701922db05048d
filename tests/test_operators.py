"""Table operators against brute force and small fixtures."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from servemetry.operators import counters, history, ingest, measure, order_stats, quality, reconcile, routing
from servemetry.operators.ordered import running


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def rank(values, q):
    ordered = sorted(values)
    return ordered[min(len(ordered) - 1, max(0, round(q * (len(ordered) - 1))))]


# Percentiles -------------------------------------------------------------


def test_nearest_rank_anchors(spark):
    data = [("ten", i / 10) for i in range(1, 11)] + [("one", 5.0), ("two", 2.0), ("two", 1.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = order_stats.nearest_rank(df, ["g"], "v", {"p50": 0.5, "p95": 0.95})
    assert rows(got, "g", "p50", "p95") == [("one", 5.0, 5.0), ("ten", 0.5, 1.0), ("two", 1.0, 2.0)]


def test_ranks_and_medians_of_a_hot_group(spark):
    """One group, and one value, hold most of the rows; null is a group too."""
    rng = random.Random(5)
    data = [("hot", rng.choice([3.25, rng.expovariate(0.02), -rng.random()])) for _ in range(4000)]
    data += [(None, rng.gauss(0, 50)) for _ in range(101)]
    data += [(f"g{i}", rng.random() * 1000) for i in range(60) for _ in range(rng.randint(1, 4))]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    groups = {}
    for g, v in data:
        groups.setdefault(g, []).append(v)
    got = {r.g: r for r in order_stats.nearest_rank(df, ["g"], "v", {"p1": 0.01, "p50": 0.5, "p95": 0.95}).collect()}
    middles = {r.g: r.m for r in order_stats.median(df, ["g"], "v", "m").collect()}
    assert set(got) == set(groups) == set(middles)
    for g, values in groups.items():
        assert (got[g].p1, got[g].p50, got[g].p95) == (rank(values, 0.01), rank(values, 0.5), rank(values, 0.95))
        assert middles[g] == pytest.approx(statistics.median(values), abs=1e-12)


# Running values ----------------------------------------------------------



def test_ranks_of_values_that_crowd_into_few_bins(spark):
    rng = random.Random(6)
    crowded = {"tiny": [rng.random() * 1e-8 for _ in range(3001)], "same": [0.25] * 500 + [0.25 + 1e-12] * 400, "one": [-3e-9]}
    df = spark.createDataFrame([(k, v) for k, vs in crowded.items() for v in vs], "g string, v double")
    got = {r.g: (r.p10, r.p50, r.p99) for r in order_stats.nearest_rank(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    assert got == {k: tuple(sorted(vs)[round(q * (len(vs) - 1))] for q in (0.1, 0.5, 0.99)) for k, vs in crowded.items()}


@pytest.mark.parametrize("partitions", ["1", "3", "8"])
def test_running_equals_a_plain_walk_whatever_the_slices(spark, partitions):
    rng = random.Random(11)
    data = [("hot" if rng.random() < 0.8 else f"k{rng.randint(0, 3)}", rng.randint(0, 30), i, rng.choice([None, rng.randint(1, 9)])) for i in range(1500)]
    df = spark.createDataFrame(data, "k string, t int, id int, v int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(
            df,
            ["k"],
            ["t", "id"],
            sums={"s": "v"},
            sums_through={"st": "v"},
            lasts={"l": "v"},
            lasts_through={"lt": "v"},
            nexts={"n": "v"},
        ).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)
    assert len(got) == len(data)
    want = {}
    for key in {d[0] for d in data}:
        line = sorted((d for d in data if d[0] == key), key=lambda d: (d[1], d[2]))
        for i, d in enumerate(line):
            seen = [x[3] for x in line[:i] if x[3] is not None]
            ahead = [x[3] for x in line[i + 1 :] if x[3] is not None]
            through = seen + ([d[3]] if d[3] is not None else [])
            want[d[2]] = (sum(seen), sum(through), seen[-1] if seen else None, through[-1] if through else None, ahead[0] if ahead else None)
    assert {r.id: (r.s, r.st, r.l, r.lt, r.n) for r in got} == want


# Measured requests -------------------------------------------------------

REQUEST = (
    "request_id long, cell string, trial int, started_us long, wall_s double, ttft_s double, sse_chunks int,"
    " completion_tokens int, prompt_tokens int"
)


def measured(spark):
    data = [
        (1, "a", 0, 0, 10.0, 0.5, 10, 100, 7),
        (2, "a", 0, 0, 5.0, 0.1, 10, 100, 8),
        (3, "a", 1, 0, 4.0, 0.3, 10, 100, 9),
        (4, "a", 1, 0, 2.0, None, 10, 100, 9),
        (5, "a", 2, 0, 1.0, 0.2, 0, 50, 9),
        (6, "a", 2, 0, 1.0, 0.9, 9, 0, 9),
        (7, "b", 0, 3_000_000, 2.0, None, 64, 64, 5),
        (8, "b", 0, 0, 2.0, None, 64, 64, 6),
    ]
    return spark.createDataFrame(data, REQUEST)


def test_requests_without_usage_are_refused(spark):
    assert [r.request_id for r in measure.refused_requests(measured(spark)).collect()] == [6]
    rated = {r.request_id: r.tok_s for r in measure.request_rate(measured(spark)).collect()}
    assert 6 not in rated and rated[2] == 20.0


def test_trial_rollup(spark):
    got = rows(measure.trial_rollup(measured(spark), ["cell"]), "cell", "trial", "aggregate_tok_s", "per_stream_median", "makespan_tok_s")
    assert got == [
        ("a", 0, 20.0, 15.0, 20.0),
        ("a", 1, 50.0, 37.5, 50.0),
        ("a", 2, 50.0, 50.0, 50.0),
        ("b", 0, 64.0, 32.0, 25.6),
    ]


def test_cell_rollup(spark):
    got = rows(
        measure.cell_rollup(measured(spark), ["cell"]),
        "cell", "prompt_tokens_actual", "trials", "requests", "per_stream_tok_s", "aggregate_tok_s", "ttft_p50_s", "ttft_p95_s", "tokens_per_sse_chunk",
    )
    assert got == [
        ("a", 7, 3, 5, 37.5, 50.0, rank([0.5, 0.1, 0.3, 0.2], 0.5), 0.5, 11.25),
        ("b", 6, 1, 2, 32.0, 64.0, None, None, 1.0),
    ]


def test_warmup_is_dropped_per_cell(spark):
    got = measure.discard_warmup(measured(spark), ["cell"])
    assert sorted(r.request_id for r in got.collect()) == [3, 4, 5, 6]


def test_chunk_tripwire(spark):
    assert rows(measure.chunk_tripwire(measured(spark), ["cell"]), "cell", "suspect") == [("a", False), ("b", True)]


def test_publish_gate(spark):
    data = [
        ("good", 60.2, 3, 48, 1, False, 0.7),
        ("good", 60.2, 3, 48, 1, False, None),
        ("short", 29.0, 2, 48, 1, False, 0.7),
        ("blind", 30.0, 3, None, 1, False, None),
    ]
    schema = "run string, elapsed_s double, trials int, prompt_tokens_actual int, concurrency int, thinking boolean, acceptance double"
    got = rows(measure.publish_gate(spark.createDataFrame(data, schema), ["run"]), "run", "publish", "refusals", "violations")
    assert got == [
        ("blind", False, "no acceptance", "cell without workload triple"),
        ("good", True, "", ""),
        ("short", False, "no steady state", "fewer than three trials"),
    ]
    lenient = measure.publish_gate(spark.createDataFrame(data, schema), ["run"], require_acceptance=False)
    assert ("blind", True) in rows(lenient, "run", "publish")


# Counters ----------------------------------------------------------------

SAMPLE = "engine string, scraped_us long, sample_id long, kind string, accepted double, drafted double, rate double"


def test_bracket_and_acceptance(spark):
    samples = spark.createDataFrame(
        [
            ("c", 10, 1, "counter", 100.0, 200.0, None),
            ("c", 20, 2, None, None, None, None),
            ("c", 30, 3, "counter", 160.0, 300.0, None),
            ("c", 40, 4, "counter", 160.0, 300.0, None),
            ("g", 10, 5, "gauge", None, None, 0.5),
            ("g", 30, 6, "gauge", None, None, 0.775),
            ("m", 10, 7, "gauge", None, None, 0.5),
            ("m", 30, 8, "counter", 9.0, 10.0, None),
        ],
        SAMPLE,
    )
    spans = spark.createDataFrame(
        [("c", 1, 10, 30), ("c", 2, 9, 30), ("c", 3, 20, 21), ("c", 4, 30, 40), ("c", 5, 35, 41), ("g", 6, 15, 25), ("m", 7, 15, 25)],
        "engine string, span_id long, start_us long, end_us long",
    )
    got = counters.acceptance_delta(spans, samples)
    assert rows(got, "span_id", "acceptance") == [(1, 0.6), (2, None), (3, 0.6), (4, None), (5, None), (6, 0.775), (7, None)]
    assert rows(got, "span_id", F.col("before.drafted"), F.col("after.drafted"))[4] == (5, 300.0, None)


def test_window_delta_statuses(spark):
    readings = [(100.0, 1000.0), None, (1600.0, 3999.0), (2600.0, 5999.0), (2600.0, 7998.0), (10.0, 20.0), (1510.0, 2520.0)]
    data = [("e", i, i, "counter" if r else None, *(r or (None, None)), None) for i, r in enumerate(readings)]
    data += [("f", 0, 9, None, None, None, None), ("f", 1, 10, "gauge", None, None, 0.5)]
    got = counters.counter_window_delta(spark.createDataFrame(data, SAMPLE))
    by_engine = {}
    for engine, at, status, draft, acceptance in rows(got, "engine", "scraped_us", "status", "draft_tokens", "acceptance"):
        by_engine.setdefault(engine, []).append((status, draft, acceptance))
    assert by_engine["e"] == [
        ("starting", None, None),
        ("metrics-unavailable", None, None),
        ("ok", 2999.0, 1500 / 2999),
        ("ok", 2000.0, 0.5),
        ("insufficient traffic", 1999.0, None),
        ("insufficient traffic", -7978.0, None),
        ("ok", 2500.0, 0.6),
    ]
    assert [s for s, _, _ in by_engine["f"]] == ["starting", "starting"]


# Routing -----------------------------------------------------------------


def brute_inflight(requests):
    out = {}
    for rid, lane, start, _ in requests:
        out[rid] = sum(1 for o, l, s, e in requests if l == lane and (s, o) < (start, rid) and e > start)
    return out


def test_inflight_with_ties_and_empty_requests(spark):
    rng = random.Random(2)
    requests = []
    for i in range(600):
        start = rng.randint(0, 60)
        requests.append((i, "hot" if rng.random() < 0.7 else "cold", start, start + rng.choice([0, 1, 2, 5, 30])))
    df = spark.createDataFrame(requests, "request_id long, lane string, start_us long, end_us long")
    got = {r.request_id: r.inflight for r in routing.inflight_at_arrival(df).collect()}
    assert got == brute_inflight(requests)


def test_history_gives_the_counts_of_the_whole_log(spark, tmp_path):
    """Late, overlapping and repeated batches; holds that begin days before or end in the same instant as others begin."""
    rng = random.Random(12)
    requests = []
    for i in range(900):
        start = rng.randint(0, 5 * 24 * 60) * 60_000_000
        requests.append((i, rng.choice(["depth", "fleet"]), start, start + rng.choice([0, 60_000_000, 7_200_000_000, 2 * history.DAY])))
    df = spark.createDataFrame(requests, "request_id long, lane string, start_us long, end_us long")
    path = str(tmp_path / "history")
    for batch in (2, 0, 1, 0):
        history.append_history(df.where(f"request_id % 3 = {batch}"), path, batch)
    whole, starts = brute_inflight(requests), {r[0]: r[2] for r in requests}
    for from_us, to_us in ((0, 6 * history.DAY), (4 * history.DAY, 5 * history.DAY), (3 * history.DAY + 60_000_000, 3 * history.DAY + 5_000_000_000)):
        got = {r.request_id: r.inflight for r in history.inflight_between(spark, path, from_us, to_us).collect()}
        assert got == {i: n for i, n in whole.items() if from_us <= starts[i] < to_us}
    # A day opens the events of that day and one row an hour, lane and batch of the time before.
    read = history.history_events(spark, path, 4 * history.DAY, 5 * history.DAY)
    assert read.count() == sum(4 * history.DAY <= t < 5 * history.DAY for _, _, s, e in requests for t in ((s, e) if e > s else (s,)))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert spark.read.parquet(f"{path}/changes").count() <= 3 * 2 * 24 * 8
    assert {r.lane: r.load for r in history.history_load(spark, path, 0).collect()} == {}


def test_least_outstanding(spark):
    requests = [(i, "fleet", "fleet-A", 0, 100) for i in range(3)] + [(3, "fleet", "fleet-B", 0, 100), (4, "fleet", "fleet-A", 50, 60)]
    requests += [(10 + i, "depth", "depth", i, 1000) for i in range(33)]
    backends = [("depth", "depth", 0), ("fleet", "fleet-A", 0), ("fleet", "fleet-B", 1)]
    df = spark.createDataFrame(requests, "request_id long, lane string, backend string, start_us long, end_us long")
    got = routing.least_outstanding(df, spark.createDataFrame(backends, "lane string, backend string, ord int"))
    picked = {r.request_id: (r.lane_inflight, r.picked_backend) for r in got.collect()}
    assert picked[4] == (4, "fleet-B")
    assert picked[0] == (0, "fleet-A")
    assert picked[41] == (31, "depth") and picked[42] == (32, None)
    unlisted = routing.least_outstanding(df, spark.createDataFrame(backends[1:], "lane string, backend string, ord int"))
    assert unlisted.count() == len(requests)
    assert {r.picked_backend for r in unlisted.where("lane = 'depth'").collect()} == {None}


def test_route_rollup(spark):
    log = spark.createDataFrame(
        [("depth", "depth", "default", 200, 10), ("depth", "depth", "default", 500, 30), ("depth", "depth", "default", 404, 20)],
        "lane string, backend string, rule string, status int, ms long",
    )
    assert rows(routing.route_rollup(log), "requests", "ok", "client_errors", "server_errors", "p50_ms", "p95_ms") == [(3, 1, 1, 1, 20, 30)]
    assert rows(routing.route_totals(log), "lane", "backend", "requests", "failures")[0] == ("depth", "depth", 3, 2)


# Quality -----------------------------------------------------------------


def test_sticky_poison(spark):
    loop = "!" * 16
    data = [
        ("s", 1, None, "fine", False, False),
        ("s", 2, None, loop, False, False),
        ("s", 3, None, "fine", False, True),
        ("s", 4, None, loop, True, False),
        ("s", 5, "a", loop, False, True),
        ("s", 6, "a", "fine", True, True),
        ("t", 1, None, "fine", False, False),
    ]
    df = spark.createDataFrame(data, "server string, seq long, reasoning_content string, content string, restart boolean, follow_up boolean")
    assert rows(quality.sticky_poison(df), "server", "seq", "epoch", "suspect") == [
        ("s", 1, 0, False), ("s", 2, 0, False), ("s", 3, 0, True), ("s", 4, 1, False), ("s", 5, 1, True), ("s", 6, 2, False), ("t", 1, 0, False),
    ]
    assert rows(quality.poison_outcomes(df), "server", "epoch", "outcome") == [
        ("s", 0, "reproduced"), ("s", 1, "reproduced and poisoned"), ("s", 2, "clean"), ("t", 0, "clean"),
    ]


def test_corruption_trials(spark):
    data = [
        ("r", 1, "KEY", "the KEY is", "prose"),
        ("r", 2, "KEY", "nothing", "prose"),
        ("r", 3, "KEY", "!!!!!!!!!!", "prose"),
        ("r", 4, "KEY", "KEY", "!!!!!!!!!!"),
        ("r", 5, "KEY", None, None),
    ]
    df = spark.createDataFrame(data, "run string, trial int, needle string, long_text string, partner_text string")
    assert rows(quality.corruption_verdicts(df), "trial", "flag", "bad") == [
        (1, "ok", False), (2, "MISS", True), (3, "TOKEN-ZERO", True), (4, "ok", True), (5, "MISS", True),
    ]
    assert rows(quality.corruption_trials(df, ["run"]), "trials", "clean", "token_zero", "missed") == [(5, 1, 1, 2)]


def test_retrieval_verdict(spark):
    shape = [("control", 48, None), ("decode", 0, None), ("binding", 900, None), ("radix", 901, None)]
    shape += [("niah", depth, pos) for depth in (1024, 2048, 4096, 8192) for pos in (0.0, 0.5, 1.0)] + [("niah", 65536, 0.5)]
    cases = [(kind, "BT56", "BT56", depth, pos) for kind, depth, pos in shape]
    schema = "kind string, needle string, output string, depth_tokens int, position double"
    clean = rows(quality.retrieval_verdict(spark.createDataFrame(cases, schema)).where("level = 'all'"), "passed", "total", "verdict")
    assert clean == [(17, 17, "RELIABLE")]
    cases[5] = ("niah", "BT56", "!!!!!!!!", 1024, 0.5)
    spoilt = quality.retrieval_verdict(spark.createDataFrame(cases, schema))
    assert rows(spoilt.where("level = 'all'"), "passed", "total", "verdict") == [(16, 17, "DEGRADED")]
    assert rows(spoilt.where("level = 'depth and position' AND verdict = 'DEGRADED'"), "depth_tokens", "position") == [(1024, 0.5)]


def test_loss_gate(spark):
    data = [("smoke", 1, 2.12), ("smoke", 30, 0.21), ("flat", 1, 1.0), ("flat", 2, 1.0), ("point", 1, 3.0), ("point", 2, None)]
    got = rows(quality.loss_gate(spark.createDataFrame(data, "run string, step int, loss double")), "run", "loss_last", "smoke_passed", "did_not_fall")
    assert got == [("flat", 1.0, False, True), ("point", 3.0, False, False), ("smoke", 0.21, True, False)]


def test_probe_gate_and_units(spark):
    data = [(n, i, i >= n) for n in (0, 1, 3) for i in range(3)]
    assert rows(quality.probe_gate(spark.createDataFrame(data, "node int, attempt int, ok boolean")), "node", "failures", "verdict") == [
        (0, 0, "OK"), (1, 1, "WARN"), (3, 3, "FAIL"),
    ]
    probe = spark.createDataFrame([("c", 3000, 200), ("tiny", 10**6, 1)], "corpus string, prompt_tokens long, units long")
    assert rows(quality.tokens_per_unit(probe, ["corpus"], 33000), "corpus", "units_for_target") == [("c", 2200), ("tiny", 1)]


# Reconciliation ----------------------------------------------------------


def test_run_compare(spark):
    schema = "class string, concurrency int, thinking boolean, speculating boolean, aggregate_tok_s double"
    left = [("code", 1, False, True, 20.9), ("math", 1, False, True, 21.8), (None, 4, False, False, 3.3), ("tool", 1, False, True, 22.4)]
    right = [("code", 1, False, True, 38.4), ("math", 1, False, True, 49.2), (None, 4, False, False, 10.1), ("tool", 1, True, True, 42.1)]
    got = rows(reconcile.run_compare(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["class"]), "class", "thinking", "status", "ratio")
    assert got == [
        ("code", False, "paired", 1.84), ("math", False, "paired", 2.26), ("tool", False, "left only", None),
        ("tool", True, "right only", None), (None, False, "paired", 3.06),
    ]


def test_claims(spark):
    claims = [("gguf", "M-here", 9.7, "clean"), ("contended", "M-here", 1.8, "loaded"), ("kv", "M-here", 5.0, "gone"), ("other", "M-else", 1.0, "gone"), ("good", "M-here", 12.8, "resident")]
    artifacts = [("clean", 10.1), ("loaded", 3.3), ("resident", 12.8)]
    c = spark.createDataFrame(claims, "claim_id string, label string, value double, artifact string")
    a = spark.createDataFrame(artifacts, "artifact string, value double")
    assert rows(reconcile.claim_reconcile(c, a, 0.05), "claim_id", "problem") == [("contended", "value differs"), ("gguf", "value differs"), ("kv", "no artifact")]
    assert rows(reconcile.claims_without_artifact(c, a), "claim_id") == [("kv",)]


def test_claims_with_many_digits_and_cells(spark):
    claims = [("a", 0.697, "r", "c1"), ("b", 68.1, "r", "c1"), ("c", 51.2, "r", "c4"), ("d", 0.181, "r", "c2"), ("e", 33.7, "r", "c3"), (None, 1.0, None, "c1")]
    made = [("r", "c1", "acceptance", 0.697), ("r", "c2", "acceptance", 0.181)]
    made += [("r", f"c{n}", "rate", v) for n, v in enumerate((68.1, 72.2, 33.6, 51.2), start=1)]
    metric = F.when(F.col("value") < 1, "acceptance").otherwise("rate")
    c = spark.createDataFrame([(i, "M-here", v, a, cell) for i, v, a, cell in claims], "claim_id string, label string, value double, artifact string, cell string")
    a = spark.createDataFrame(made, "artifact string, cell string, metric string, value double")
    found = reconcile.claim_reconcile(c.withColumn("metric", metric), a, 0.0, ["artifact", "cell", "metric"])
    assert sorted((r.claim_id or "", r.problem) for r in found.collect()) == [("", "no artifact"), ("e", "value differs")]


@pytest.mark.parametrize("name", [lambda n: f"chatcmpl-{9 - n}", lambda n: 9_200_000_000_000_000_000 - n])
def test_ids_of_any_kind(spark, name):
    requests = [(name(n), "run-0", 1, 1_700_000_000_000_000 + n // 2, 2.0, 0.1, 5, 20, n) for n in range(4)]
    kind = "string" if isinstance(name(0), str) else "long"
    df = spark.createDataFrame(
        requests, f"request_id {kind}, run string, trial int, started_us long, wall_s double, ttft_s double, sse_chunks int, completion_tokens int, prompt_tokens int"
    )
    (row,) = measure.cell_rollup(df, ["run"]).collect()
    assert row.prompt_tokens_actual == 1  # the later of the two that start first has the smaller id
    assert measure.trial_rollup(df, ["run"]).count() == 1


def test_cell_rollup_counts_a_null_trial_once(spark):
    requests = [(n, "run-0", "code", 1, False, t, 1000 * n, 2.0, 0.1, 5, 20, 7) for n, t in enumerate((None, None, 1, 1))]
    df = spark.createDataFrame(
        requests, "request_id long, run string, class string, concurrency int, thinking boolean, trial int, started_us long, wall_s double,"
        " ttft_s double, sse_chunks int, completion_tokens int, prompt_tokens int",
    )
    (row,) = measure.cell_rollup(df, ["run", "class", "concurrency", "thinking"]).collect()
    assert (row.requests, row.trials) == (4, 2)


def test_capacity_fit(spark):
    models = spark.createDataFrame([(f"m{w}", float(w)) for w in (156, 108, 135, 181, 164, 29, 121, 242, 243)], "model string, weights_gib double")
    nodes = spark.createDataFrame([("head", 121.0), ("worker", 121.0)], "node string, usable_gib double")
    fits = {r.model: r.fit for r in reconcile.capacity_fit(models, nodes).collect()}
    assert {m for m, f in fits.items() if f == "one node"} == {"m108", "m29", "m121"}
    assert {m for m, f in fits.items() if f == "does not fit"} == {"m243"}
    alone = reconcile.capacity_fit(models, nodes.limit(1))
    assert {r.fit for r in alone.collect()} == {"one node", "does not fit"}


def test_inventory_diff(spark):
    schema = "kind string, name string, value string"
    head = spark.createDataFrame([("image", "a", "1"), ("image", "b", "2"), ("file", "c", "3"), ("file", "e", None)], schema)
    worker = spark.createDataFrame([("image", "a", "1"), ("image", "a", "1"), ("image", "b", "9"), ("file", "d", "4"), ("file", "e", None)], schema)
    assert rows(reconcile.inventory_diff(head, worker), "name", "problem") == [("b", "mismatch"), ("c", "missing on worker"), ("d", "missing on head")]


def test_revert_plan(spark):
    captured = spark.createDataFrame([("own-a",), ("web",), ("",), ("db",), (None,)], "name string")
    running_now = spark.createDataFrame([("db",), ("db",)], "name string")
    assert rows(reconcile.revert_plan(captured, running_now, "own-"), "name") == [("web",)]
    assert rows(reconcile.revert_plan_as_difference(captured, running_now, "own-"), "name") == [("web",)]


@pytest.mark.parametrize("suite, cells", [("standard", 20), ("quick", 9), ("fleet", 10), ("mixed-long", 2), ("spec", 4)])
def test_suite_grid(spark, suite, cells):
    runs = spark.createDataFrame([("r",)], "run string")
    assert reconcile.suite_grid(runs, suite).distinct().count() == cells


def test_suite_coverage(spark):
    measured_cells = spark.createDataFrame([("r", "code", 1), ("r", "math", 1)], "run string, class string, concurrency int")
    assert rows(reconcile.suite_coverage(measured_cells, "spec"), "class") == [("prose",), ("tool",)]


def test_latest_capture(spark):
    df = spark.createDataFrame([("n", "incumbent-20260825-0101", 1), ("n", "incumbent-20260826-0001", 2)], "node string, capture string, c int")
    assert rows(reconcile.latest_capture(df, ["node"]), "c") == rows(reconcile.latest_capture(df), "c") == [(2,)]


# Ingest ------------------------------------------------------------------


def test_render_chats_of_any_length(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(10)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    whole = ingest.render_chats(df).collect()
    turns = sorted(ingest.render_turns(df).collect(), key=lambda r: r.turn)
    assert len(whole) == 1 and len(turns) == 10
    assert "".join(t.text for t in turns) == whole[0].text
    long = spark.range(5000).selectExpr("7L AS conv_id", "id AS turn", "'user' AS role", "'x' AS text").repartition(7)
    assert ingest.render_chats(long).selectExpr("count(*)", "max(length(text))").first() == (1, 5000 * len("<|user|>\nx\n"))
    assert whole[0].text.startswith("<|user|>\nt0\n<|assistant|>\nt1\n")


def test_salted_join_keeps_every_row(spark):
    from servemetry.operators.keys import lookup_join, salted_join

    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, 300)], "k string, i int")
    small = spark.createDataFrame([("hot", 1, 200), ("k0", 2, 1), (None, 3, 1)], "k string, v int, n long")
    joined = salted_join(big.repartition(8), small, ["k"], "n", "left")
    assert joined.columns == ["k", "i", "v"]
    assert joined.count() == 301 and [joined.where(f"v = {v}").count() for v in (1, 2, 3)] == [200, 1, 1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = rows(lookup_join(big, small, ["k"]), "i", "v")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows(lookup_join(big, small, ["k"]), "i", "v") == shuffled
    assert len(shuffled) == 201


def test_salted_join_repeats_hot_keys_only(spark):
    """With 20,000 shuffle partitions the repeated rows are fewer than twice that, whatever the number of keys."""
    from servemetry.operators import keys

    tasks, n = 20_000, 50_000
    small = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") == 7, n).otherwise(1).alias("n"))
    big = spark.range(2 * n).select(F.when(F.col("id") < n, 7).otherwise(F.col("id") - n).alias("k")).repartition(16)
    before, made = keys.null_safe_join, []
    keys.null_safe_join = lambda left, right, *rest: made.append(right) or before(left, right, *rest)
    try:
        joined = keys.salted_join(big, small, ["k"], "n", tasks=tasks)
    finally:
        keys.null_safe_join = before
    hot, repeated = (df.count() for df in made)
    assert hot == 1 and n < repeated <= n + tasks
    assert joined.count() == 2 * n and joined.where("k = 7").count() == n + 1


def test_requests_that_share_an_id_or_have_none_keep_their_rows(spark):
    columns = "request_id long, lane string, backend string, start_us long, end_us long, header_lane string, model string, path string, body_ok boolean, draining boolean, backend_failed boolean, max_tokens long, prompt_tokens long"
    made = [(rid, lane, backend, at, at + 100, None, "m", "/v1/chat/completions", True, False, False, 10, 5)
            for rid, lane, backend, at in ((1, "depth", "depth", 10), (1, "depth", "depth", 20), (None, "depth", "depth", 30), (None, "fleet", "fleet-A", 40), (2, "fleet", "fleet-B", 50))]
    asked = spark.createDataFrame(made, columns)
    audited = routing.routing_audit(asked, lane_max=4, split_enabled=True, fleet_enabled=True).collect()
    assert sorted((r.start_us, r.depth_inflight, r.lane_inflight) for r in audited) == [(10, 0, 0), (20, 1, 1), (30, 2, 2), (40, 3, 3), (50, 3, 3)]
    assert sorted(r.start_us for r in routing.admission(routing.decide_lane(asked)).collect()) == [10, 20, 30, 40, 50]
    backends = spark.createDataFrame([("depth", "depth", 0), ("fleet", "fleet-A", 0), ("fleet", "fleet-B", 1)], "lane string, backend string, ord int")
    picked = [(str(r.request_id), r.lane, r.lane_inflight, r.picked_backend) for r in routing.least_outstanding(asked, backends, lane_max=12).collect()]
    assert sorted(picked) == [("1", "depth", 0, "depth"), ("1", "depth", 1, "depth"), ("2", "fleet", 1, "fleet-B"), ("None", "depth", 2, "depth"), ("None", "fleet", 0, "fleet-A")]


def test_capacity_counts_nodes_and_names_the_smallest(spark):
    nodes = spark.createDataFrame([("b", 20.0), ("a", 20.0), ("c", 50.0), ("d", 10.0), ("e", None)], "node string, usable_gib double")
    models = spark.createDataFrame([(1, 5.0), (2, 10.0), (3, 10.5), (4, 20.0), (5, 50.0), (6, 51.0), (7, None), (4, 20.0)], "model long, weights_gib double")
    got = sorted(((r.model, r.nodes_fitting, r.smallest_node) for r in reconcile.capacity_nodes(models, nodes).collect()))
    assert got == [(1, 4, "d"), (2, 4, "d"), (3, 3, "a"), (4, 3, "a"), (4, 3, "a"), (5, 1, "c"), (6, 0, None), (7, None, None)]
    alone = reconcile.capacity_nodes(models, nodes.limit(0)).collect()
    assert {(r.nodes_fitting, r.smallest_node) for r in alone if r.model != 7} == {(0, None)}

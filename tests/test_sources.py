"""Readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from servemetry.sources import artifacts, exposition, frames, logs, prompts
from servemetry.sources.storage import fresh_path

VLLM = """# a scrape of one engine
vllm:spec_decode_num_draft_tokens_total{path="/a{b}c",note="x \\"y\\" z"} 412
vllm:spec_decode_num_accepted_tokens_per_pos_total{path="/a{b}c",slot="2"} 88
vllm:spec_decode_num_accepted_tokens_created{path="/a{b}c"} 1.7e+09
vllm:spec_decode_num_accepted_tokens_total{path="/a{b}c"} 231
vllm:spec_decode_num_drafts_total{path="/a{b}c"} 103"""
SGLANG = """sglang:spec_accept_rate{model="m"} 0.31
sglang:num_draft_tokens_total{model="m"} 640
sglang:num_accepted_tokens_total{model="m"} 198
sglang:num_draft_tokens_created{model="m"} 1.6e+09"""
GAUGE = """sglang:spec_accept_rate{e="0"} 0.75
sglang:spec_accept_rate{e="1"} 0.25
sglang:num_accepted_tokens_total 5"""
TWO_LABELS = """vllm:num_accepted_tokens_total{e="0"} 1e2
vllm:num_accepted_tokens_total{e="1"} 2.5e+2
vllm:num_draft_tokens_total{e="0"} 1e-05"""


def scrapes(spark):
    texts = {"vllm": VLLM, "sglang": SGLANG, "gauge": GAUGE, "two": TWO_LABELS, "down": "# timeout"}
    lines = [(name, 1, line) for name, text in texts.items() for line in text.split("\n")]
    return spark.createDataFrame(lines, "source string, scraped_us long, line string")


def test_counter_scan_takes_totals_only(spark):
    got = {(r.source, r.metric): r.value for r in exposition.counter_scan(scrapes(spark)).collect()}
    assert got == {
        ("vllm", "accepted"): 231, ("vllm", "drafted"): 412, ("sglang", "accepted"): 198, ("sglang", "drafted"): 640,
        ("two", "accepted"): 350, ("two", "drafted"): 1e-05,
    }


def test_gauge_only_without_counters(spark):
    got = {r.source: (r.kind, r.accepted, r.drafted, r.rate) for r in exposition.scrape_readings(scrapes(spark)).collect()}
    assert got["sglang"] == ("counter", 198, 640, None)
    assert got["gauge"] == ("gauge", None, None, 0.5)
    assert got["down"] == (None, None, None, None)


def test_scrape_directory(spark, tmp_path):
    (tmp_path / "a-1700000123.prom").write_text(VLLM)
    (tmp_path / "b.prom").write_text(SGLANG)
    got = exposition.counter_scan(exposition.scrape_lines(spark, str(tmp_path))).collect()
    assert sorted(r.value for r in got) == [198, 231, 412, 640]
    assert {r.scraped_us for r in got if r.engine_family == "vllm"} == {1_700_000_123_000_000}


def test_labels_of_a_sample(spark):
    line = F.lit('m{path="/a{b}c",note="x \\"y\\" \\\\ z",empty=""} 4.5e1')
    row = spark.range(1).select(exposition.sample_labels(line).alias("l"), exposition.sample_value(line).alias("v")).first()
    assert [tuple(x) for x in row.l] == [("path", "/a{b}c"), ("note", 'x "y" \\ z'), ("empty", "")] and row.v == 45


def stream(spark):
    def chunk(**delta):
        return "data: " + json.dumps({"choices": [{"delta": delta}]})

    usage = 'data: {"choices":[],"usage":{"completion_tokens":20,"prompt_tokens":7}}'
    lines = [
        (1, 0, ": ping"), (1, 1, "data: {bad"), (1, 2, chunk(role="assistant", content="")), (1, 3, chunk(reasoning_content="r")),
        (1, 4, chunk(content="c")), (1, 5, '  data:{"choices":[{"delta":null},{"delta":{"content":"d"}}],"usage":{}}  '), (1, 6, usage),
        (1, 7, "data: [DONE]"), (1, 8, chunk(content="late")), (1, 9, 'data: {"usage":{"completion_tokens":99}}'),
        (2, 0, chunk(content="x")), (2, 1, 'data: {"choices":[],"usage":null}'),
        (2, 2, 'data: {"usage":{"completion_tokens":50}} and more'), (2, 3, chunk(content="y") + "}"), (3, 0, "event: x"), (3, 1, "data: [DONE]"),
    ]
    rows = [(r, s, 1_000_000, 1_000_000 + (s + 1) * 100_000, line) for r, s, line in lines]
    return spark.createDataFrame(rows, "request_id long, seq int, sent_us long, at_us long, line string")


def test_sse_to_requests(spark):
    got = {r.request_id: r for r in frames.sse_to_requests(stream(spark)).collect()}
    assert (got[1].ttft_s, got[1].sse_chunks, got[1].completion_tokens, got[1].prompt_tokens, got[1].wall_s) == (0.4, 3, 20, 7, 0.8)
    assert (got[2].ttft_s, got[2].sse_chunks, got[2].completion_tokens) == (0.1, 1, 0)
    assert (got[3].ttft_s, got[3].sse_chunks, got[3].completion_tokens, got[3].wall_s) == (None, 0, 0, 0.2)


def test_only_frames_up_to_an_early_end_are_parsed_again(spark, monkeypatch):
    parsed, parse = [], frames.with_frame_columns

    def counted(some):
        parsed.append(some.count())
        return parse(some)

    monkeypatch.setattr(frames, "with_frame_columns", counted)
    got = {r.request_id: r for r in frames.sse_to_requests(stream(spark)).collect()}
    # Of request 1 the lines 0 to 7; 2 and 3 have nothing behind an end.
    assert parsed == [16, 8] and got[1].completion_tokens == 20


def test_only_whole_objects_are_frames(spark):
    whole = '{"choices":[{"delta":{"content":"c"}}],"usage":{"completion_tokens":3}}'
    odd = ["[DONE]", "{broken", "null", "1", '"{}"', "", None, f"[{whole}]", f"{whole},{whole}", f"{whole} {whole}", f"{whole},", f"{whole}}}", f"{{{whole}}}", f"x{whole}", f"\u00a0{whole}"]
    rows = spark.createDataFrame([(n, b) for n, b in enumerate([*odd, whole, "{}"])], "n int, body string")
    got = {r.n: r.f for r in rows.select("n", frames.whole_frame(F.col("body")).alias("f")).collect()}
    assert [n for n in got if got[n] is not None] == [len(odd), len(odd) + 1]
    assert got[len(odd)].usage == '{"completion_tokens":3}' and got[len(odd)].choices[0].delta.content == "c"


FULL = {
    "lane": "next", "suite": "spec", "model": "m", "trials": 2, "elapsed_s": 72.5, "utc": "2025-02-03T04:05:06Z", "environment": {"gpu": "card"},
    "cells": [{"prompt_tokens_nominal": 0, "prompt_tokens_actual": 48, "concurrency": 1, "thinking": False, "per_stream_tok_s": 47.8,
               "aggregate_tok_s": 47.8, "ttft_p50_s": 0.191, "ttft_p95_s": 0.208, "acceptance": 0.767, "tokens_per_sse_chunk": 3.02, "class": "code"}],
}
OLD = {
    "lane": "gguf", "suite": "standard", "model": "q",
    "cells": [{"prompt_tokens": 256, "concurrency": 1, "thinking": False, "aggregate_tok_s": 3.3, "per_stream_tok_s": 3.3}],
}
CORRECTED = {
    "lane": "depth", "suite": "standard", "model": "d", "trials": 2, "elapsed_s": 2908.5, "correction_note": "halved",
    "cells": [{"prompt_tokens_nominal": 256, "prompt_tokens_actual": 218, "concurrency": 1, "thinking": False, "acceptance": 0.367,
               "acceptance_raw": 0.734, "class": None},
              {"prompt_tokens_nominal": 256, "prompt_tokens_actual": 218, "concurrency": 2, "thinking": False, "acceptance": 0.5,
               "acceptance_raw": 0.734, "class": None}],
}


def test_artifact_scan_reads_every_shape(spark, tmp_path):
    for i, artifact in enumerate((FULL, OLD, CORRECTED, {"lane": "empty", "suite": "x", "cells": []})):
        (tmp_path / f"{i}.json").write_text(json.dumps(artifact, indent=2))
    cells = artifacts.artifact_scan(spark, str(tmp_path))
    got = sorted((r.lane, r.prompt_tokens, r.concurrency, r.correction_holds, r.gpu) for r in cells.collect() if r.lane != "empty")
    assert got == [("depth", 218, 1, True, None), ("depth", 218, 2, False, None), ("gguf", 256, 1, None, None), ("next", 48, 1, None, "card")]
    assert cells.where("lane = 'empty' AND concurrency IS NULL").count() == 1
    lines = sorted(r.line for r in artifacts.report_rows(cells.where("lane IN ('next', 'gguf')")).collect())
    assert lines == ["| 256 | 1 | off | 3.3 | 3.3 | - | - | - |", "| code | 1 | off | 47.8 | 47.8 | 0.191 | 0.208 | 0.767 |"]


def test_artifact_sink_replaces_only_its_own_run(spark):
    path = fresh_path(spark, "sink-test")
    schema = "date string, lane string, suite string, aggregate_tok_s double"
    artifacts.artifact_sink(spark.createDataFrame([("2026-08-29", "a", "spec", 1.0), ("2026-08-29", "b", "spec", 2.0)], schema), path)
    artifacts.artifact_sink(spark.createDataFrame([("2026-08-29", "a", "spec", 3.0)], schema), path)
    got = artifacts.artifact_scan(spark, path, multi_line=False).collect()
    assert sorted((r.lane, r.suite, r.aggregate_tok_s) for r in got) == [("a", "spec", 3.0), ("b", "spec", 2.0)]


def test_report_prints_large_and_small_numbers_plainly(spark):
    row = ("code", 1, False, 1e7, 0.0001, None, 12.5, 0.697)
    cells = spark.createDataFrame([row], "class string, concurrency int, thinking boolean, per_stream_tok_s double, aggregate_tok_s double, ttft_p50_s double, ttft_p95_s double, acceptance double")
    cells = cells.withColumns({"prompt_tokens_actual": F.lit(1), "prompt_tokens_nominal": F.lit(1)})
    assert artifacts.report_rows(cells).first().line == "| code | 1 | off | 10000000.0 | 0.0001 | - | 12.5 | 0.697 |"


def test_retrieval_scan(spark, tmp_path):
    report = {"verdict": "RELIABLE", "why": "w", "pool": {"model": "m"}, "cases": [
        {"name": "control/no-haystack", "kind": "control", "passed": True, "needle": "BT56", "output": "BT56", "depth_tokens": 48, "position": None},
        {"name": "niah/1024@0", "kind": "niah", "passed": True, "needle": "X", "output": "X", "depth_tokens": 1024, "position": 0.0}]}
    (tmp_path / "r.json").write_text(json.dumps(report, indent=2))
    got = artifacts.retrieval_scan(spark, str(tmp_path)).collect()
    assert [(r.kind, r.depth_tokens, r.position, r.verdict) for r in got] == [("control", 48, None, "RELIABLE"), ("niah", 1024, 0.0, "RELIABLE")]


def test_router_log(spark, tmp_path):
    line = {"ts": 100, "lane": "depth", "backend": "depth", "rule": "default", "path": "/v1/models", "status": 200, "ms": 1500}
    (tmp_path / "log.jsonl").write_text(json.dumps(line) + "\n")
    row = logs.router_log_scan(spark, str(tmp_path)).first()
    assert (row.start_us, row.end_us) == (100_000_000, 101_500_000)
    live = logs.router_log_stream(spark, str(tmp_path))
    assert live.isStreaming and live.schema == logs.router_log_scan(spark, str(tmp_path)).schema


def test_chat_jsonl(spark, tmp_path):
    message = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    lines = [json.dumps({"messages": message}), "", json.dumps({"text": "plain"}), json.dumps({"text": "wins", "messages": message}), json.dumps({"other": 1})]
    (tmp_path / "rows.jsonl").write_text("\n".join(lines) + "\n")
    got = sorted(r.text for r in logs.chat_jsonl_scan(spark, str(tmp_path / "rows.jsonl")).collect())
    assert got == ["<|user|>\nq\n<|assistant|>\na\n", "plain", "wins"]
    (tmp_path / "none.jsonl").write_text('{"other": 1}\n\n')
    with pytest.raises(ValueError, match="no usable rows"):
        logs.chat_jsonl_scan(spark, str(tmp_path / "none.jsonl"))


def test_advice_is_appended(spark):
    path = fresh_path(spark, "advice-test")
    rows = spark.createDataFrame([("e", "ok")], "engine string, status string")
    logs.advice_sink(rows, path)
    logs.advice_sink(rows, path)
    assert spark.read.json(path).count() == 2


def test_iso_stamp(spark):
    assert spark.range(1).select(logs.iso_utc(F.lit(1_000_000))).first()[0] == "1970-01-01T00:00:01Z"


def test_cold_prompts(spark):
    df = spark.createDataFrame([(2048, "salt-a"), (2048, "salt-b"), (64, "s")], "n int, salt string")
    made = [r[0] for r in df.select(prompts.cold_prompt(F.col("n"), F.col("salt"))).collect()]
    assert made[0] != made[1]
    assert 0.5 < len(made[0]) / (2048 * 4) <= 1.0
    assert all(p.endswith(prompts.TASK) for p in made)
    assert len(made[2]) == 64 * 4 - 128 + len(prompts.TASK)


def test_haystack_depends_on_the_seed_only(spark):
    def hay(seed, partitions):
        df = spark.range(4).repartition(partitions)
        return {r[0]: r[1] for r in df.select("id", prompts.haystack_lines(F.lit(seed), F.lit(10))).collect()}

    first = hay(1, 1)
    assert first == hay(1, 4) and first[0] != hay(2, 1)[0]
    assert len(first[0]) == 10 and first[0][3].startswith("log 00003: ") and len(first[0][3].split()) == 8


def test_needle_position(spark):
    cases = spark.createDataFrame([(1, 7, "2ZDJ")], "case_id long, seed long, needle string")
    made = prompts.eval_set(cases, [4], [0.0, 0.5, 1.0]).orderBy("position").collect()
    places = [[i for i, line in enumerate(r.prompt.split("\n")) if "word is 2ZDJ" in line] for r in made]
    assert places == [[0], [2], [4]]


def test_measured_cells_from_text(spark):
    from servemetry.operators.measured import measured_cells

    def sent(rid, at, tokens, chunks):
        said = ['data: {"choices":[{"delta":{"content":"a"}}]}'] * chunks + [f'data: {{"choices":[],"usage":{{"completion_tokens":{tokens},"prompt_tokens":9}}}}', "data: [DONE]"]
        return [(rid, i, at, at + (i + 1) * 1_000_000, line) for i, line in enumerate(said)]

    calls = [(1, "e0", "r", 0), (2, "e0", "r", 1), (3, "e0", "r", 2), (4, "e0", "r", 0)]  # nothing came back for 4
    frames = [f for rid, at, n, c in ((1, 0, 40, 2), (2, 20_000_000, 60, 4), (3, 60_000_000, 50, 3), (9, 0, 7, 1)) for f in sent(rid, at, n, c)]

    def scrape(at, accepted, drafted):
        return [("e0", at, f'vllm:spec_decode_num_{name}_tokens_total{{w="0"}} {n}') for name, n in (("accepted", accepted), ("draft", drafted))]

    lines = scrape(0, 10, 20) + scrape(30_000_000, 1, 2) + scrape(66_000_000, 70, 100) + scrape(90_000_000, 0, 0)
    cells = measured_cells(
        spark.createDataFrame(calls, "request_id long, engine string, run string, trial int"),
        spark.createDataFrame(frames, "request_id long, seq int, sent_us long, at_us long, line string"),
        spark.createDataFrame(lines, "source string, scraped_us long, line string"),
        ["run"],
    ).collect()
    (cell,) = cells
    # Rates 40 / 4, 60 / 6 and 50 / 5; from the reading at 0 s to the one at 66 s, just after the end at 65 s.
    assert (cell.trials, cell.requests, cell.prompt_tokens_actual, cell.per_stream_tok_s, cell.aggregate_tok_s) == (3, 3, 9, 10.0, 10.0)
    assert (cell.ttft_p50_s, cell.tokens_per_sse_chunk, cell.elapsed_s, cell.acceptance) == (1.0, 16.67, 65.0, 0.75)

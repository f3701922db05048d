"""Column rules against small fixtures."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from servemetry.functions import chat, numeric, quality, speculation


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_half_even_rounds_as_python_does(spark, digits):
    rng = random.Random(digits)
    numbers = [0.25, 0.35, 2.675, -0.25, 1.05, 1.005, 0.0005, 8.35, 1e15, 0.0]
    numbers += [rng.randint(-9999, 9999) / 10 ** (digits + 1) for _ in range(500)]
    numbers += [rng.randint(-9999, 9999) / 8 / 10**digits for _ in range(200)]
    numbers += [rng.uniform(-1, 1) * 10 ** rng.randint(-4, 8) for _ in range(200)]
    got = values(spark, "v double", [(x,) for x in numbers], numeric.half_even(F.col("v"), digits))
    assert [g[0] for g in got] == [round(x, digits) for x in numbers]


def test_value_bin_never_decreases(spark):
    rng = random.Random(3)
    points = sorted(rng.uniform(-1, 1) * 10 ** rng.randint(-7, 9) for _ in range(3000))
    bins = [b for (b,) in values(spark, "v double", [(p,) for p in points], numeric.value_bin(F.col("v")))]
    assert bins == sorted(bins)
    assert len(set(bins)) > 1000


def test_strict_int(spark):
    rows = [("010",), ("8.5",), ("12\r",), ("",), (None,), ("-3",), ("9" * 30,), ("7\n",)]
    got = values(spark, "raw string", rows, numeric.strict_int(F.col("raw")), numeric.reject_reason(F.col("raw")))
    assert got == [
        (10, None),
        (None, "not a decimal integer"),
        (None, "not a decimal integer"),
        (None, None),
        (None, None),
        (None, "not a decimal integer"),
        (None, "out of range"),
        (None, "not a decimal integer"),
    ]


MESSAGES = "m array<struct<role:string,content:string,is_text:boolean>>"


def test_prompt_tokens_floor_per_message(spark):
    rows = [
        ([("user", "abcdefg", True), ("user", "abc", True)],),
        ([("user", None, False)],),
        ([("user", "x" * 40000, True)],),
        ([],),
        (None,),
    ]
    got = values(spark, MESSAGES, rows, chat.prompt_tokens(F.col("m")))
    assert [g[0] for g in got] == [1, 256, 10000, 0, 0]


def test_body_tokens_of_content_of_any_json_type(spark):
    def body(*contents):
        return json.dumps({"messages": [{"role": "user", "content": c} for c in contents]})

    want = {
        body("abcdefg", "abc"): 1,
        body([{"type": "text", "text": "x" * 4000}], {"text": "abcd"}, 12345678, True, None): 5 * 256,
        body("12345678", "[1, 2]", "null", '"q\\\n"'): 2 + 1 + 1 + 1,
        body("\U0001f600" * 9, "é" * 4): 2 + 1,
        body("x" * 400_000): 100_000,
        '{"messages":[{"role":"user"},{}]}': 512,
        body(): 0,
        "{}": 0,
        '{"messages":null}': None,
        '{"messages":"abcd"}': None,
        '{"messages":["abcd"]}': None,
        '{"messages":[{"content":"abcd"},null]}': None,
        body("abcd") + " x": None,
        body("abcd") + ',"y"': None,
        '{"messages":[{"content":"abcd","content":[1]}]}': None,
        '["messages"]': None,
        "": None,
    }
    got = values(spark, "b string", [*[(b,) for b in want], (None,)], chat.body_tokens(F.col("b")))
    assert [g[0] for g in got] == [*want.values(), None]


def test_model_lane_split(spark):
    rows = [("m@split", "fleet"), ("m", "fleet"), ("a@b@depth", None), ("m@unknown", "fleet"), ("m@", None), ("m", None)]
    model, header = F.col("model"), F.col("header")
    got = values(
        spark,
        "model string, header string",
        rows,
        chat.requested_lane(model, header),
        chat.model_without_lane(model),
    )
    assert got == [
        ("split", "m"),
        ("fleet", "m"),
        ("depth", "a@b"),
        ("unknown", "m"),
        ("", "m"),
        (None, "m"),
    ]


@pytest.mark.parametrize(
    "requested, prompt, load, split, fleet, lane",
    [
        ("fleet", 1, 0, True, True, "fleet"),
        ("split", 1, 0, True, True, "split"),
        (None, 10000, 0, True, True, "split"),
        (None, 1, 0, True, True, "depth"),
        (None, 1, 6, True, True, "fleet"),
        (None, 1, 5, True, True, "depth"),
        (None, 10000, 0, False, False, "depth"),
        (None, 1, 6, False, False, "depth"),
        ("unknown", 1, 0, True, True, "depth"),
        ("unknown", 8192, 9, True, True, "split"),
    ],
)
def test_lane_choice(spark, requested, prompt, load, split, fleet, lane):
    choice = chat.lane_choice(F.col("r"), F.col("p"), F.col("l"), split_enabled=split, fleet_enabled=fleet)
    got = values(spark, "r string, p long, l long", [(requested, prompt, load)], choice["lane"])
    assert got == [(lane,)]


def test_max_tokens(spark):
    rows = [(None, 10), (0, 10), (9999999, 10), (100, 10), (9999999, 999990)]
    got = values(
        spark,
        "m long, p long",
        rows,
        chat.requested_max_tokens(F.col("m")),
        chat.effective_max_tokens(F.col("m"), F.col("p"), 1000000),
    )
    assert got == [(32768, 32768), (32768, 32768), (9999999, 999990), (100, 100), (9999999, 10)]


def test_refusals_in_order(spark):
    generate = "/v1/chat/completions"
    rows = [
        ("/health", True, False, "depth", 1, None, 0, False),
        (generate, False, True, "depth", 1, None, 99, False),
        (generate, True, True, "depth", 2000000, None, 99, False),
        (generate, True, False, "depth", 2000000, None, 99, False),
        (generate, True, False, "fleet", 2000000, None, 32, True),
        (generate, True, False, "fleet", 2000000, None, 31, True),
        (generate, True, False, "depth", 1048576 - 32768, 0, 0, False),
        ("/v1/models", True, True, "depth", 2000000, None, 0, False),
    ]
    schema = "path string, ok boolean, drain boolean, lane string, p long, m long, load long, failed boolean"
    code = chat.refusal(*[F.col(c) for c in ("path", "ok", "drain", "lane", "p", "m", "load", "failed")])["code"]
    assert [g[0] for g in values(spark, schema, rows, code)] == [404, 400, 503, 413, 429, 502, None, None]


def test_json_check_agrees_with_a_strict_parser(spark):
    texts = [
        '{"a": 1}', '{"a": 1} x', '{"a": ', "null", '"s"', "12", '{"a": 1, "a": 2}', "[1, 2", "[1]", ' {"a": 1} ',
        '{"a": 1}}', "{'a': 1}", '{"a": 01}', '{"a": 1,}', "true", '{"a": [1, {"b": "c"}]}', "nope", " ",
    ]

    def whole(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    got = values(spark, "s string", [(t,) for t in texts], F.col("s"), chat.parses_as_json(F.col("s")))
    assert got == [(t, whole(t)) for t in texts]


CALLS = "finish string, calls array<struct<name:string,arguments:string>>"


def test_text_behind_a_json_value_is_no_json(spark):
    texts = {'{"a":1}] x': False, "1],[2": False, '{"a":1} x': False, '{"a":1}}': False, "1,2": False, '"x","y"': False, "": False, '{"a":1}': True, ' [1, {"b": "]"}] ': True, "null": True, '"q"': True}
    got = values(spark, "s string", [(t,) for t in texts], F.col("s"), chat.parses_as_json(F.col("s")))
    assert dict(got) == texts


def test_tool_call_repair(spark):
    calls = [("ok", '{"a": 1}'), ("cut", '{"a": '), ("empty", ""), ("none", None)]
    rows = [("length", calls), ("stop", calls), ("length", [("cut", '{"a": ')]), ("length", None), (None, calls)]
    kept = F.transform(chat.kept_tool_calls(F.col("finish"), F.col("calls")), lambda c: c["name"])
    finish = chat.repaired_finish(F.col("finish"), F.coalesce(F.size("calls") > 0, F.lit(False)))
    got = values(spark, CALLS, rows, kept, finish)
    everything = ["ok", "cut", "empty", "none"]
    assert got == [
        (["ok", "empty", "none"], "length"),
        (everything, "tool_calls"),
        (None, "length"),
        (None, "length"),
        (everything, "tool_calls"),
    ]


def test_stops_stay_dormant_in_reasoning(spark):
    rows = [
        ("plan Question: x</think>done", ["Question:"], True),
        ("plan</think>a Question: b", ["Question:"], True),
        ("Question: plan</think>a Question: b", ["Question:"], True),
        ("Question: never closed", ["Question:"], True),
        ("Question: not armed", ["Question:"], False),
        ("abc", ["", "c", "bc"], False),
        ("xaby", ["b", "ab", "a"], False),
    ]
    stop = chat.first_effective_stop(F.col("t"), F.col("s"), F.col("a"))
    got = values(spark, "t string, s array<string>, a boolean", rows, stop["position"], stop["stop"])
    assert got == [
        (None, None),
        (15, "Question:"),
        (25, "Question:"),
        (None, None),
        (1, "Question:"),
        (2, "bc"),
        (2, "ab"),
    ]


def test_render_chat(spark):
    rows = [([("user", "hi", True), ("assistant", None, True)],)]
    got = values(spark, MESSAGES, rows, chat.render_chat(F.col("m")))
    assert got == [("<|user|>\nhi\n<|assistant|>\n\n",)]


def test_bang_runs(spark):
    rows = [(None, "Hello"), ("plan", "ok " + "!" * 16), ("!!!", "!!! a !"), (None, None), ("a�", "�!")]
    text = quality.full_text(F.col("r"), F.col("c"))
    got = values(
        spark,
        "r string, c string",
        rows,
        quality.longest_bang_run(text),
        quality.occurrences(text, "!"),
        quality.occurrences(text, "�"),
        quality.is_loop(F.col("r"), F.col("c")),
    )
    assert got == [(0, 0, 0, False), (16, 16, 0, True), (6, 7, 0, False), (0, 0, 0, False), (1, 1, 2, False)]


def test_token_zero(spark):
    texts = ["!" * 12, "  " + "!" * 10 + " ", "!!!", "Wow!!!!!!!!! great", "", None, "\n\t" + "!" * 8 + " \n", "!!!!!!!!\n!!!!!!!!"]
    got = values(spark, "t string", [(t,) for t in texts], quality.is_token_zero(F.col("t")))
    assert [g[0] for g in got] == [True, True, False, False, False, False, True, False]


def test_token_zero_strips_what_python_strips(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    got = values(spark, "t string", [(s + "!" * 9 + s,) for s in spaces], quality.is_token_zero(F.col("t")))
    assert all(g[0] for g in got)


def test_token_zero_tail(spark):
    rows = [([0] * 15,), ([7, 3] + [0] * 16,), ([0] * 15 + [1],), ([],), ([0] * 20,)]
    ids = F.col("ids")
    got = values(spark, "ids array<long>", rows, quality.ends_in_token_zero(ids), quality.token_zero_finished_len(ids))
    assert got == [(False, None), (True, 3), (False, None), (False, None), (True, 5)]


def test_accepted_len_anchors(spark):
    rows = [(0.0, 5), (1.0, 5), (0.6, 5), (0.9, 5), (0.8, 7), (0.8, 3)]
    got = [g[0] for g in values(spark, "a double, k int", rows, speculation.accepted_len(F.col("a"), F.col("k")))]
    assert got[0] == pytest.approx(1.0) and got[1] == pytest.approx(6.0)
    assert got[2] == pytest.approx(2.38, abs=0.02)
    assert got[3] > got[2] and got[4] > got[5]


def test_advice(spark):
    rows = [(0.90,), (0.40,), (0.72,), (None,)]
    told = speculation.advice(F.col("a"), k_set=(8, 7, 5, 3))
    got = values(
        spark, "a double", rows, told["recommended_k"], told["apply"], told["expected_gain"], speculation.allowed_k((3, 5, 7, 8))
    )
    assert [g[3] for g in got] == [[3, 5, 7]] * 4
    assert got[0][0] == 7 and "restart" in got[0][1] and got[0][2] > 0
    assert got[1][0] == 3
    kept = got[2][0] == 5
    assert (got[2][1] == "keep current k") == kept
    assert got[3][:3] == (None, None, None)


def test_no_allowed_depth_keeps_the_current_one(spark):
    told = speculation.advice(F.col("a"), k_set=(60,))
    assert values(spark, "a double", [(0.5,)], told["recommended_k"], told["expected_gain"]) == [(5, 0.0)]


def test_bins_of_extremes(spark):
    got = values(spark, "v double", [(0.0,), (-0.0,), (math.inf,), (1e300,)], numeric.value_bin(F.col("v")))
    assert got[0] == got[1] == (0,)
    assert got[2][0] >= got[3][0] > 0

"""Rules over chat requests and responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lane names, generation paths and the router's thresholds.
LANES = ("depth", "fleet", "split")
GENERATE_PATHS = ("/v1/chat/completions", "/v1/completions", "/v1/responses")
PROMPT_THRESHOLD = 8192
DEPTH_HIGH_WATER = 5
LANE_MAX_INFLIGHT = 32
DEPTH_CEILING = 1048576
DEFAULT_MAX_TOKENS = 32768
CHARS_PER_TOKEN = 4
NON_TEXT_TOKENS = 256

REASONING_END = "</think>"


def message_tokens(content: Column, is_text: Column) -> Column:
    """Token estimate of one message. The floor is per message."""
    by_length = F.floor(F.length(content) / CHARS_PER_TOKEN).cast("long")
    textual = is_text & content.isNotNull()
    return F.when(textual, by_length).otherwise(F.lit(NON_TEXT_TOKENS).cast("long"))


def prompt_tokens(messages: Column) -> Column:
    """Token estimate of an array of (role, content, is_text) messages."""
    return F.aggregate(
        F.coalesce(messages, F.array().cast("array<struct<role:string,content:string,is_text:boolean>>")),
        F.lit(0).cast("long"),
        lambda total, m: total + message_tokens(m["content"], m["is_text"]),
    )


def one_json_value(text: Column) -> Column:
    """The text as a variant if it is one whole JSON value, else null; so is an object that has a key twice.

    Read as the first of two elements, as in `parses_as_json`.
    """
    seal = F.md5(text.cast("binary"))
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]')))
    return F.when(F.try_variant_get(both, "$[1]", "string") == seal, F.try_variant_get(both, "$[0]", "variant"))


def json_kind(value: Column) -> Column:
    """What a variant holds: 'STRING', 'OBJECT', 'ARRAY', a kind of number, 'BOOLEAN' or 'VOID' (a JSON null); null for no variant."""
    return F.substring_index(F.schema_of_variant(value), "<", 1)


def content_tokens(content: Column) -> Column:
    """Token estimate of one message whose content is a variant: a text by its length, anything else, or none, at a flat rate."""
    return message_tokens(F.try_variant_get(content, "$", "string"), F.coalesce(json_kind(content) == "STRING", F.lit(False)))


def body_tokens(body: Column) -> Column:
    """Token estimate of a request body, a JSON text; content may be of any JSON type.

    A body without messages has 0. Null if the body is not one whole JSON object, or its messages are no list of objects.
    """
    whole = one_json_value(body)
    messages = F.try_variant_get(whole, "$.messages", "variant")
    listed = F.try_variant_get(messages, "$", "array<variant>")
    total = F.aggregate(listed, F.lit(0).cast("long"), lambda n, m: n + content_tokens(F.try_variant_get(m, "$.content", "variant")))
    sound = (json_kind(messages) == "ARRAY") & F.forall(listed, lambda m: F.coalesce(json_kind(m) == "OBJECT", F.lit(False)))
    return F.when(json_kind(whole) == "OBJECT", F.when(messages.isNull(), F.lit(0).cast("long")).when(sound, total))


def lane_suffix(model: Column) -> Column:
    """What follows the last '@' of a model name; null when there is no '@'."""
    return F.when(F.contains(model, F.lit("@")), F.substring_index(model, "@", -1))


def model_without_lane(model: Column) -> Column:
    """The model name up to its last '@', whether or not the lane is known."""
    cut = F.length(model) - F.length(F.substring_index(model, "@", -1)) - 1
    return F.when(F.contains(model, F.lit("@")), F.left(model, cut)).otherwise(model)


def requested_lane(model: Column, header_lane: Column) -> Column:
    """A suffix overrides the header."""
    return F.coalesce(lane_suffix(model), header_lane)


def lane_choice(
    requested: Column,
    prompt: Column,
    depth_inflight: Column,
    *,
    split_enabled: bool = False,
    fleet_enabled: bool = False,
    prompt_threshold: int = PROMPT_THRESHOLD,
    high_water: int = DEPTH_HIGH_WATER,
) -> Column:
    """(lane, rule) by the ordered rules; an unknown requested lane is ignored."""

    def pick(lane: Column | str, rule: str) -> Column:
        lane = F.lit(lane) if isinstance(lane, str) else lane
        return F.struct(lane.alias("lane"), F.lit(rule).alias("rule"))

    return (
        F.when(requested.isin(*LANES), pick(requested, "pinned"))
        .when(F.lit(split_enabled) & (prompt >= prompt_threshold), pick("split", f"prompt>={prompt_threshold}"))
        .when(F.lit(fleet_enabled) & (depth_inflight > high_water), pick("fleet", f"depth-high-water>{high_water}"))
        .otherwise(pick("depth", "default"))
    )


def requested_max_tokens(max_tokens: Column) -> Column:
    """Null and zero both mean the default."""
    return F.coalesce(F.nullif(max_tokens, F.lit(0)), F.lit(DEFAULT_MAX_TOKENS)).cast("long")


def effective_max_tokens(max_tokens: Column, prompt_len: Column, window: Column | int) -> Column:
    """Decode bound: an oversized ask is cut to the window, never refused."""
    window = F.lit(window) if isinstance(window, int) else window
    return F.least(requested_max_tokens(max_tokens), window, window - prompt_len).cast("long")


def is_generate_path(path: Column) -> Column:
    return path.isin(*GENERATE_PATHS)


def refusal(
    path: Column,
    body_ok: Column,
    draining: Column,
    lane: Column,
    prompt: Column,
    max_tokens: Column,
    lane_inflight: Column,
    backend_failed: Column,
    *,
    ceiling: int = DEPTH_CEILING,
    lane_max: int = LANE_MAX_INFLIGHT,
) -> Column:
    """Typed refusal (code, kind), or null for an admitted request."""

    def no(code: int, kind: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(kind).alias("kind"))

    generates = is_generate_path(path)
    too_large = (lane == "depth") & (prompt + requested_max_tokens(max_tokens) > ceiling)
    return (
        F.when(~path.startswith("/v1/"), no(404, "not_found"))
        .when(~body_ok, no(400, "invalid_json"))
        .when(generates & draining, no(503, "draining"))
        .when(generates & too_large, no(413, "prompt_too_large_for_lane"))
        .when(lane_inflight >= lane_max, no(429, "lane_saturated"))
        .when(backend_failed, no(502, "backend_unreachable"))
    )


def parses_as_json(text: Column) -> Column:
    """True when the whole string is one JSON value.

    The text is read as the first of two elements. The second is the text's own digest: it is seen
    only if the reader came to the end of the text with exactly one value read.
    """
    seal = F.md5(text.cast("binary"))
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]')), "array<string>", {"allowSingleQuotes": "false"})
    return F.coalesce((F.size(parsed) == 2) & (F.get(parsed, F.lit(1)) == seal), F.lit(False))


def kept_tool_calls(engine_finish: Column, tool_calls: Column) -> Column:
    """Calls that survive: after a length cut, only those with whole arguments."""

    def usable(call: Column) -> Column:
        arguments = call["arguments"]
        return arguments.isNull() | (arguments == "") | parses_as_json(arguments)

    kept = F.filter(tool_calls, usable)
    cut = F.coalesce(engine_finish == "length", F.lit(False))
    return F.when(~cut, tool_calls).when(F.size(kept) > 0, kept)


def repaired_finish(engine_finish: Column, claims_tool_calls: Column) -> Column:
    """A length cut is never reported as a clean tool call."""
    cut = F.coalesce(engine_finish == "length", F.lit(False))
    return F.when(claims_tool_calls & ~cut, F.lit("tool_calls")).otherwise(
        F.coalesce(F.nullif(engine_finish, F.lit("")), F.lit("stop"))
    )


def first_effective_stop(text: Column, stops: Column, armed: Column) -> Column:
    """(position, stop) of the first stop that counts, position from 1.

    While the reasoning guard is armed only text after the first end marker is
    searched; without a marker nothing fires.
    """
    marker = F.locate(REASONING_END, text)
    start = F.when(~armed, F.lit(1)).when(marker > 0, marker + len(REASONING_END))
    hits = F.transform(
        F.filter(stops, lambda s: F.length(s) > 0),
        lambda s, i: F.struct(
            F.call_function("locate", s, text, start).alias("position"), i.alias("ord"), s.alias("stop")
        ),
    )
    best = F.array_min(F.filter(hits, lambda h: h["position"] > 0))
    return F.when(start.isNotNull() & best.isNotNull(), F.struct(best["position"].alias("position"), best["stop"].alias("stop")))


def render_message(role: Column, content: Column) -> Column:
    """One message of the plain role-tag template."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.coalesce(content, F.lit("")), F.lit("\n"))


def render_chat(messages: Column) -> Column:
    """A whole chat as one string, without a generation prompt."""
    return F.array_join(F.transform(messages, lambda m: render_message(m["role"], m["content"])), "")

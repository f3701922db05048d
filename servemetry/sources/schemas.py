"""Schemas of the telemetry formats, as Spark DDL."""

CELL = (
    "struct<prompt_tokens:int, prompt_tokens_nominal:int, prompt_tokens_actual:int, concurrency:int,"
    " thinking:boolean, per_stream_tok_s:double, aggregate_tok_s:double, ttft_p50_s:double, ttft_p95_s:double,"
    " acceptance:double, acceptance_raw:double, tokens_per_sse_chunk:double, class:string>"
)

# Superset of the full, the old and the corrected artifact shape.
ARTIFACT = (
    "lane string, suite string, model string, trials int, elapsed_s double, utc string,"
    f" environment struct<gpu:string>, cells array<{CELL}>, correction_note string"
)

RETRIEVAL = (
    "started string, suite string, seed int, verdict string, why string,"
    " pool struct<kv_cache_dtype:string, max_total_num_tokens:double, context_length:int, model:string>,"
    " cases array<struct<name:string, kind:string, passed:boolean, needle:string, output:string,"
    " depth_tokens:int, position:double, prompt_tokens:int, completion_tokens:int, latency_s:double,"
    " ttft_s:double, prefill_tps:double, decode_tps:double, cache_hit:string, cache_flushed:boolean, error:string>>"
)

ROUTER_LOG = "ts long, lane string, backend string, rule string, path string, status int, ms long"

CHAT_ROW = "text string, messages array<struct<role:string, content:string>>"

STREAM_FRAME = (
    "usage string, choices array<struct<delta:struct<content:string, reasoning_content:string>>>"
)

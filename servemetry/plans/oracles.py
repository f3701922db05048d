"""The registered queries restated in SQL over the raw tables.

Written apart from the Spark jobs: percentiles sort a list, in-flight counts
are range self-joins, counter brackets are ASOF joins.
"""

from __future__ import annotations

from ..sources.prompts import FILLER, PLANTED, QUESTION, TASK, WORDS


def rounded(value: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', CAST({value} AS DOUBLE)) AS DOUBLE)"


def at_rank(value: str, q: float) -> str:
    listed = f"list_sort(list({value}) FILTER (WHERE {value} IS NOT NULL))"
    return f"{listed}[CAST(round_even({q}::DOUBLE * (count({value}) - 1), 0) AS BIGINT) + 1]"


def middle(value: str) -> str:
    listed = f"list_sort(list({value}))"
    return f"(({listed}[(count({value}) - 1) // 2 + 1] + {listed}[count({value}) // 2 + 1]) / 2)"


def stack(*views: str, select: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + select


# Views -------------------------------------------------------------------

EV = """ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS at_us,
  CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"""

REQ = """req AS (SELECT event_id AS request_id, 'run-' || (user_id % 8) AS run, nullif(event_type, 'view') AS class,
  CAST(1 + (user_id // 8) % 4 AS INT) AS concurrency, (user_id // 32) % 2 = 1 AS thinking,
  CAST(event_id % 3 AS INT) AS trial, at_us AS started_us, value AS wall_s,
  CASE WHEN k % 17 <> 0 THEN value / 10 END AS ttft_s, CAST(1 + k // 3 AS INT) AS sse_chunks,
  CASE WHEN event_type = 'error' AND k < 20 THEN 0 ELSE 16 + k END AS completion_tokens,
  CAST(64 * (1 + user_id % 8) AS INT) AS prompt_tokens FROM ev)"""

GOOD = "good AS (SELECT *, completion_tokens / wall_s AS tok_s FROM req WHERE completion_tokens > 0 AND wall_s > 0)"

LATER_GOOD = """good AS (SELECT *, completion_tokens / wall_s AS tok_s FROM
  (SELECT *, min(trial) OVER (PARTITION BY run, class, concurrency, thinking) AS f FROM req) WHERE trial > f
  AND completion_tokens > 0 AND wall_s > 0)"""

TRIALS = f"""trials AS (SELECT run, class, concurrency, thinking, trial,
  {rounded("sum(completion_tokens) / max(wall_s)", 1)} AS aggregate_tok_s,
  {rounded(middle("tok_s"), 1)} AS per_stream_median,
  {rounded("sum(completion_tokens) / ((max(started_us + wall_s * 1e6) - min(started_us)) / 1e6)", 1)} AS makespan_tok_s
  FROM good GROUP BY ALL)"""

CELLS = f"""cells AS (SELECT a.*, b.per_stream_tok_s, b.aggregate_tok_s, b.trials FROM
  (SELECT run, class, concurrency, thinking,
    first(prompt_tokens ORDER BY trial, started_us, request_id) AS prompt_tokens_actual, count(*) AS requests,
    {rounded(at_rank("ttft_s", 0.5), 3)} AS ttft_p50_s, {rounded(at_rank("ttft_s", 0.95), 3)} AS ttft_p95_s,
    {rounded("sum(completion_tokens) / greatest(sum(sse_chunks), 1)", 2)} AS tokens_per_sse_chunk
    FROM good GROUP BY ALL) a JOIN
  (SELECT run, class, concurrency, thinking, {rounded(middle("per_stream_median"), 1)} AS per_stream_tok_s,
    {rounded(middle("aggregate_tok_s"), 1)} AS aggregate_tok_s, count(*) AS trials FROM trials GROUP BY ALL) b
  ON a.run = b.run AND a.class IS NOT DISTINCT FROM b.class AND a.concurrency = b.concurrency AND a.thinking = b.thinking)"""

SAMPLES = """samples AS (SELECT 'engine-' || (user_id % 8) AS engine, at_us AS scraped_us, event_id AS sample_id,
  CASE WHEN event_type = 'error' THEN NULL WHEN user_id % 8 >= 6 THEN 'gauge' ELSE 'counter' END AS kind,
  CASE WHEN event_type <> 'error' AND user_id % 8 < 6
    THEN CAST((event_id % 2500) * 4 * (30 + 8 * (user_id % 8)) + k AS DOUBLE) END AS accepted,
  CASE WHEN event_type <> 'error' AND user_id % 8 < 6 THEN CAST((event_id % 2500) * 400 + 4 * k AS DOUBLE) END AS drafted,
  CASE WHEN event_type <> 'error' AND user_id % 8 >= 6 THEN 0.05::DOUBLE * (1 + k % 19) END AS rate FROM ev)"""

SPANS = """spans AS (SELECT 'engine-' || (user_id % 8) AS engine, event_id AS span_id, at_us AS start_us,
  at_us + CAST(round_even(value * 1e6, 0) AS BIGINT) * 30 AS end_us FROM ev)"""

BRACKETS = """read_ok AS (SELECT * FROM samples WHERE kind IS NOT NULL),
 back AS (SELECT s.span_id, b.kind, b.accepted, b.drafted, b.rate FROM spans s ASOF LEFT JOIN read_ok b
   ON s.engine = b.engine AND s.start_us >= b.scraped_us),
 ahead AS (SELECT s.span_id, b.kind, b.accepted, b.drafted, b.rate FROM spans s ASOF LEFT JOIN read_ok b
   ON s.engine = b.engine AND s.end_us <= b.scraped_us)"""

ACCEPTANCE = """CASE WHEN b.kind = 'counter' AND a.kind = 'counter' AND a.drafted > b.drafted
    THEN (a.accepted - b.accepted) / (a.drafted - b.drafted)
    WHEN b.kind IS NOT NULL AND a.kind = 'gauge' AND a.rate > 0 THEN a.rate END"""

PUBLISHED = f"""{SAMPLES},
 spans AS (SELECT *, 'engine-' || run[5:] AS engine, row_number() OVER () AS span_id FROM (SELECT run, class, concurrency, thinking,
   min(started_us) AS start_us, max(CAST(ceil(started_us + wall_s * 1e6) AS BIGINT)) AS end_us FROM good GROUP BY ALL)),
 {BRACKETS},
 published AS (SELECT c.*, (max(s.end_us) OVER of_run - min(s.start_us) OVER of_run) / 1e6 AS elapsed_s, {rounded(ACCEPTANCE, 3)} AS acceptance
   FROM cells c JOIN spans s ON c.run = s.run AND c.class IS NOT DISTINCT FROM s.class AND c.concurrency = s.concurrency
   AND c.thinking = s.thinking JOIN back b USING (span_id) JOIN ahead a USING (span_id) WINDOW of_run AS (PARTITION BY c.run))"""

ROUTES = """routes AS (SELECT request_id, lane, CASE WHEN lane = 'depth' THEN 'depth'
    WHEN lane = 'fleet' AND (user_id // 3) % 2 = 0 THEN 'fleet-A' WHEN lane = 'fleet' THEN 'fleet-B'
    ELSE 'split-decode' END AS backend, start_us,
  CASE WHEN k = 0 THEN start_us ELSE start_us + CAST(round_even(value * 1e6, 0) AS BIGINT) * 100 END AS end_us,
  CASE WHEN k % 4 = 0 THEN 'pinned' ELSE 'default' END AS rule,
  CASE WHEN event_type <> 'error' THEN 200 WHEN k % 2 = 0 THEN 500 ELSE 400 END AS status,
  CAST(round_even(value * 1000, 0) AS BIGINT) AS ms FROM
  (SELECT event_id AS request_id, user_id, event_type, value, k, at_us AS start_us,
    CASE WHEN user_id % 3 = 0 THEN 'depth' WHEN user_id % 3 = 1 THEN 'fleet' ELSE 'split' END AS lane FROM ev))"""

ASKED = """asked AS (SELECT doc_id AS request_id,
  CASE WHEN doc_id % 5 < 3 THEN 'depth' WHEN doc_id % 5 = 3 THEN 'fleet' ELSE 'split' END AS lane,
  doc_id * 10000000 AS start_us,
  CASE WHEN doc_id % 50 = 0 THEN doc_id * 10000000 ELSE doc_id * 10000000 + n_chars * 20000 END AS end_us,
  CASE WHEN doc_id % 11 = 0 THEN 'fleet' WHEN doc_id % 13 = 0 THEN 'unknown' END AS header_lane,
  CASE WHEN doc_id % 7 = 0 THEN 'm@split' WHEN doc_id % 9 = 0 THEN 'm@x@depth' WHEN doc_id % 10 = 0 THEN 'm@nowhere'
    ELSE 'm' END AS model,
  CASE WHEN doc_id % 31 = 0 THEN '/v1/models' WHEN doc_id % 37 = 0 THEN '/metrics' ELSE '/v1/chat/completions' END AS path,
  doc_id % 41 <> 0 AS body_ok, doc_id % 43 = 0 AS draining, doc_id % 29 = 0 AS backend_failed,
  CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 1000 * 1200 END AS max_tokens,
  length('You answer briefly.') // 4 + length(text) // 4 + CASE WHEN doc_id % 10 = 0 THEN 256 ELSE 0 END AS prompt_tokens
  FROM documents)"""

SUFFIXED = """suffixed AS (SELECT *, CASE WHEN contains(model, '@') THEN string_split(model, '@')[-1] END AS suffix,
  CASE WHEN contains(model, '@') THEN regexp_extract(model, '^(.*)@[^@]*$', 1) ELSE model END AS served_model,
  CASE WHEN contains(model, '@') THEN string_split(model, '@')[-1] ELSE header_lane END AS requested FROM asked)"""

DECIDED = """depth_load AS (SELECT r.request_id, count(o.request_id) AS depth_inflight FROM asked r LEFT JOIN asked o
   ON o.lane = 'depth' AND (o.start_us < r.start_us OR (o.start_us = r.start_us AND o.request_id < r.request_id))
   AND o.end_us > r.start_us GROUP BY ALL),
 chosen AS (SELECT s.*, d.depth_inflight, CASE WHEN path <> '/v1/chat/completions' THEN 'passthrough'
    WHEN requested IN ('depth', 'fleet', 'split') THEN 'pinned' WHEN prompt_tokens >= 2048 THEN 'prompt>=2048'
    WHEN depth_inflight > 5 THEN 'depth-high-water>5' ELSE 'default' END AS derived_rule
   FROM suffixed s JOIN depth_load d USING (request_id)),
 decided AS (SELECT *, CASE derived_rule WHEN 'pinned' THEN requested WHEN 'prompt>=2048' THEN 'split'
    WHEN 'depth-high-water>5' THEN 'fleet' ELSE 'depth' END AS derived_lane FROM chosen)"""

JUDGED = """lane_load AS (SELECT r.request_id, count(o.request_id) AS lane_inflight FROM decided r LEFT JOIN asked o
   ON o.lane = r.derived_lane AND (o.start_us < r.start_us OR (o.start_us = r.start_us AND o.request_id < r.request_id))
   AND o.end_us > r.start_us GROUP BY ALL),
 wanting AS (SELECT d.*, l.lane_inflight, prompt_tokens + coalesce(nullif(max_tokens, 0), 32768) - 1048576 AS over
   FROM decided d JOIN lane_load l USING (request_id)),
 judged AS (SELECT *, CASE WHEN NOT starts_with(path, '/v1/') THEN 404 WHEN NOT body_ok THEN 400
    WHEN path = '/v1/chat/completions' AND draining THEN 503
    WHEN path = '/v1/chat/completions' AND derived_lane = 'depth' AND over > 0 THEN 413
    WHEN lane_inflight >= 4 THEN 429 WHEN backend_failed THEN 502 END AS refusal_code FROM wanting)"""

OUTPUTS = """outputs AS (SELECT source AS server, doc_id AS seq, CASE WHEN doc_id % 5 <> 0 THEN text END AS reasoning_content,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN ' ' || chr(9) || repeat('!', doc_id % 24) || chr(10)
    ELSE text || ' ok ' || repeat('!', doc_id % 24) || chr(65533) END AS content,
  doc_id % 170 < 20 AS restart, (doc_id // 20) % 2 = 1 AS follow_up FROM documents)"""

RUNS = """features AS (SELECT *, coalesce(list_max(list_transform(regexp_extract_all(t, '!+'), lambda r: length(r))), 0)
    AS longest_bang_run, length(t) - length(replace(t, '!', '')) AS total_bangs,
    length(t) - length(replace(t, chr(65533), '')) AS replacement_chars
   FROM (SELECT *, coalesce(reasoning_content, '') || coalesce(content, '') AS t FROM outputs)),
 looped AS (SELECT *, longest_bang_run >= 16 AS is_loop,
    coalesce(regexp_full_match(content, '\\s*!{8,}\\s*'), false) AS token_zero FROM features)"""

EPOCHS = """epochs AS (SELECT *, CAST(sum(CAST(restart AS INT)) OVER (PARTITION BY server ORDER BY seq) AS BIGINT) AS epoch
   FROM looped),
 suspects AS (SELECT *, coalesce(bool_or(is_loop) OVER (PARTITION BY server, epoch ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS suspect FROM epochs)"""

TRIED = """tried AS (SELECT source AS run, doc_id AS trial,
  CASE WHEN doc_id % 4 = 0 THEN 'K7PQ-44XM' ELSE substr(text, 5, 12) END AS needle,
  CASE WHEN doc_id % 9 = 0 THEN repeat('!', 20) ELSE text END AS long_text,
  doc_id % 11 = 0 AS partner_zero FROM documents),
 flagged AS (SELECT *, CASE WHEN trial % 9 = 0 THEN 'TOKEN-ZERO' WHEN contains(long_text, needle) THEN 'ok' ELSE 'MISS' END
   AS flag FROM tried)"""

CASES = """cases AS (SELECT d.source AS run, (['control', 'decode', 'niah', 'binding', 'radix'])[doc_id % 5 + 1] AS kind,
  CAST(1024 * pow(2, doc_id % 4) AS INT) AS depth_tokens,
  CASE WHEN doc_id % 5 >= 2 THEN CAST(doc_id % 3 AS DOUBLE) * 0.5::DOUBLE END AS position,
  CASE WHEN doc_id % 60 = 7 THEN contains(d.text, b.text) ELSE true END AS passed
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""

RESPONSES = """responses AS (SELECT doc_id AS d, lang AS model, text AS plain,
  CASE WHEN doc_id % 3 = 0 THEN 'length' WHEN doc_id % 3 = 1 THEN 'stop' END AS engine_finish,
  CASE WHEN doc_id % 4 = 0 THEN ['whole', 'cut', 'tail', 'blank', 'none'] WHEN doc_id % 4 = 1 THEN ['cut'] END AS calls,
  CASE WHEN doc_id % 5 = 0 THEN text ELSE substr(text, 1, n_chars // 2) || '</think>' || substr(text, n_chars // 2 + 1) END
    AS text, doc_id % 2 = 0 AS armed FROM documents),
 repaired AS (SELECT *, CASE WHEN len(calls) > 0 AND engine_finish IS DISTINCT FROM 'length' THEN 'tool_calls'
    ELSE coalesce(engine_finish, 'stop') END AS finish_reason,
  CASE WHEN engine_finish IS DISTINCT FROM 'length' THEN calls
    WHEN doc_id_mod = 0 THEN ['whole', 'blank', 'none'] END AS kept FROM (SELECT *, d % 4 AS doc_id_mod FROM responses)),
 armed_from AS (SELECT *, CASE WHEN NOT armed THEN 1 WHEN contains(text, '</think>') THEN instr(text, '</think>') + 8 END
    AS start FROM repaired),
 hits AS (SELECT *, list_filter([instr(substr(text, start), s) FOR s IN
    ['Question:', substr(plain, 3, 4), right(plain, 5), 'the']], lambda p: p > 0) AS found,
    ['Question:', substr(plain, 3, 4), right(plain, 5), 'the'] AS stops FROM armed_from),
 stopped AS (SELECT *, CAST(CASE WHEN len(found) > 0 THEN list_min(found) + start - 1 END AS INT) AS position FROM hits),
 named AS (SELECT *, CASE WHEN position IS NOT NULL THEN
    list_filter(stops, lambda s: substr(text, position, length(s)) = s)[1] END AS stop FROM stopped)"""

ADVICE_COLUMNS = "3, 5, 7"


def advised(acceptance: str, ks: str) -> str:
    """Score every depth by formula and pick the best, smaller on ties."""
    score = f"((CASE WHEN {acceptance} < 1 THEN (1 - pow({acceptance}, k + 1)) / (1 - {acceptance}) ELSE k + 1 END) / (1 + 0.08::DOUBLE * k))"
    return f"""scored AS (SELECT p.*, k, {score} AS score FROM points p, unnest([{ks}]) t(k) WHERE 6 * (k + 1) <= 48),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, k) AS rn,
   max(CASE WHEN k = 5 THEN score END) OVER (PARTITION BY pid) AS now_score FROM scored),
 advised AS (SELECT *, CAST(k AS INT) AS recommended_k, {rounded("score / greatest(1e-9, now_score) - 1", 3)} AS expected_gain,
   CASE WHEN k = 5 THEN 'keep current k' ELSE 'restart at a quiet moment with k=' || k END AS apply FROM ranked WHERE rn = 1)"""


def ticks(window_s: int, closed_only: bool) -> str:
    closed = "WHERE window_end_us <= (SELECT max(at_us) // 1000 * 1000 - 600000000 FROM ev)" if closed_only else ""
    return f"""ticks AS (SELECT * FROM (SELECT *, (scraped_us // {window_s}000000 + 1) * {window_s}000000 AS window_end_us,
   row_number() OVER (PARTITION BY engine, scraped_us // {window_s}000000 ORDER BY scraped_us DESC, sample_id DESC) AS rn
   FROM samples) WHERE rn = 1),
 moved AS (SELECT *, last_value(CASE WHEN kind = 'counter' THEN accepted END IGNORE NULLS) OVER w AS pa,
   last_value(CASE WHEN kind = 'counter' THEN drafted END IGNORE NULLS) OVER w AS pd FROM ticks {closed}
   WINDOW w AS (PARTITION BY engine ORDER BY scraped_us, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


DELTAS = """deltas AS (SELECT *, CASE WHEN pd IS NULL THEN 'starting' WHEN kind IS DISTINCT FROM 'counter'
    THEN 'metrics-unavailable' WHEN drafted - pd < 2000 THEN 'insufficient traffic' ELSE 'ok' END AS status FROM moved)"""

TICK_ADVICE = """points AS (SELECT sample_id AS pid, (accepted - pa) / (drafted - pd) AS a FROM deltas WHERE status = 'ok')"""

SUITE = """measured AS (SELECT DISTINCT user_id AS run, ([256, 2048, 8192, 32768, 131072])[k % 5 + 1] AS prompt_tokens,
  ([1, 2, 4, 6])[(k // 5) % 4 + 1] AS concurrency FROM ev)"""

CHAT_ROWS = """chat_rows AS (SELECT doc_id AS row_id, source, doc_id % 4 < 2 AS has_text, doc_id % 4 IN (1, 2) AS has_messages,
  CASE WHEN doc_id % 4 < 2 THEN text
    WHEN doc_id % 4 = 2 THEN '<|user|>' || chr(10) || text || chr(10) || '<|assistant|>' || chr(10) || 'in ' || lang || chr(10)
  END AS text FROM documents)"""

SETTINGS = """settings AS (SELECT o_orderpriority AS source, o_orderkey AS name, CASE o_orderkey % 9
  WHEN 0 THEN '0' || o_orderkey WHEN 1 THEN o_orderkey || '.5' WHEN 2 THEN o_orderkey || chr(13) WHEN 3 THEN ''
  WHEN 4 THEN NULL WHEN 5 THEN o_orderkey || '99999999999999999999' ELSE '' || o_orderkey END AS raw FROM orders),
 reasoned AS (SELECT *, CASE WHEN raw IS NULL OR raw = '' THEN NULL WHEN NOT regexp_full_match(raw, '[0-9]+')
  THEN 'not a decimal integer' WHEN TRY_CAST(raw AS BIGINT) IS NULL THEN 'out of range' END AS reason FROM settings)"""

ORDERED = "SELECT kind, name, head_value, worker_value, problem FROM diff WHERE problem IS NOT NULL"

INVENTORY = """head AS (SELECT CASE WHEN c_custkey % 10 = 3 THEN -c_custkey ELSE c_custkey END AS name, CASE WHEN c_custkey % 4 = 0 THEN '5-LOW' ELSE '2-HIGH' END AS value
  FROM customer),
 worker AS (SELECT name, min(v) AS lo, max(v) AS hi FROM (SELECT CASE WHEN o_custkey % 12 = 5 THEN o_custkey + 1000000000
   ELSE o_custkey END AS name, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority ELSE '2-HIGH' END AS v FROM orders) GROUP BY ALL),
 diff AS (SELECT 'file' AS kind, coalesce(h.name, w.name) AS name, h.value AS head_value, w.lo AS worker_value,
   CASE WHEN h.name IS NULL THEN 'missing on head' WHEN w.name IS NULL THEN 'missing on worker'
     WHEN h.value <> w.lo OR h.value <> w.hi THEN 'mismatch' END AS problem
   FROM head h FULL JOIN worker w ON h.name = w.name)"""

REVERT = """SELECT {distinct} name FROM (SELECT CASE WHEN c_custkey % 50 = 0 THEN '' WHEN c_custkey % 7 = 0
  THEN 'own-' || c_custkey ELSE 'svc-' || c_custkey END AS name FROM customer)
WHERE name <> '' AND NOT starts_with(name, 'own-')
  AND name NOT IN (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'svc-' ELSE 'idle-' END || o_custkey FROM orders)"""

CAPTURES = """captures AS (SELECT user_id % 10 AS node, 'incumbent-' || lpad(CAST(at_us // 60000000 AS VARCHAR), 12, '0') || '-'
  || lpad(CAST(event_id AS VARCHAR), 12, '0') AS capture, k AS containers FROM ev)"""

LOGS = """lost AS (SELECT 'container-' || (user_id % 8) AS container, at_us FROM ev WHERE event_type = 'error' AND k < 10)"""

ALERTS = """SELECT container, told_us, count(*) AS lines, max(at_us) AS last_us FROM
  (SELECT container, at_us, (at_us // 3600000000 + unnest(range(1, 25))) * 3600000000 AS told_us FROM lost) {where} GROUP BY ALL"""

WHOLE_TEXT = "SELECT seq, rtrim(coalesce(reasoning_content, '') || coalesce(content, ''), chr(10) || chr(65533)) AS t FROM outputs"

SERIES = """series AS (SELECT 'engine-' || (user_id % 8) AS source, event_id * 1000000 AS scraped_us, unnest(['accepted', 'accepted', 'drafted', 'drafted']) AS metric,
   unnest([0, 1, 0, 1]) AS worker, CAST(unnest([event_id * 6 + k, event_id % 400 * 2 + k, event_id * 9 + 2 * k, event_id % 400 * 4 + 2 * k]) AS DOUBLE) AS value FROM ev),
 lagged AS (SELECT *, lag(value) OVER (PARTITION BY source, metric, worker ORDER BY scraped_us) AS before FROM series),
 grown AS (SELECT *, value < before AS again, CASE WHEN before IS NULL THEN NULL WHEN value < before THEN value ELSE value - before END AS grown FROM lagged)"""

_WORD_LIST = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
_TASK_SQL, _QUESTION_SQL = (x.replace("\n", "' || chr(10) || '") for x in (TASK, QUESTION))

FRAMES = """framed AS (SELECT *, 1 + k % 5 AS m, k % 11 <> 0 AS ends FROM ev)"""

READ = """req AS (SELECT event_id AS request_id, 'run-' || (user_id % 8) AS run, nullif(event_type, 'view') AS class,
  CAST(1 + (user_id // 8) % 4 AS INT) AS concurrency, (user_id // 32) % 2 = 1 AS thinking, CAST(event_id % 3 AS INT) AS trial,
  at_us AS started_us, ((CASE WHEN ends THEN m + 4 ELSE m + 5 END) * 1000 * (1 + k)) / 1e6 AS wall_s, (3 * 1000 * (1 + k)) / 1e6 AS ttft_s,
  CASE WHEN ends THEN m ELSE m + 1 END AS sse_chunks, CASE WHEN NOT ends THEN 9999 WHEN event_type = 'error' THEN 0 ELSE 16 + k END AS completion_tokens,
  CAST(CASE WHEN NOT ends OR event_type = 'error' THEN 0 ELSE 64 * (1 + user_id % 8) END AS BIGINT) AS prompt_tokens FROM framed)"""

# Two gauges a scrape, the second half of the first, written with two and three decimals.
SCRAPED = PUBLISHED.replace(
    SAMPLES,
    SAMPLES.replace("samples AS", "made AS", 1) + ",\n samples AS (SELECT * REPLACE ((round(rate, 2) + round(rate / 2, 3)) / 2 AS rate) FROM made)",
)

CELL_COLUMNS = """run, class, concurrency, thinking, prompt_tokens_actual, trials, requests, per_stream_tok_s,
  aggregate_tok_s, ttft_p50_s, ttft_p95_s, tokens_per_sse_chunk"""

ORACLES: dict[str, str] = {
    "request_rate": stack(EV, REQ, GOOD, select=f"SELECT request_id, completion_tokens, wall_s, {rounded('tok_s', 3)} AS tok_s FROM good"),
    "refused_requests": stack(EV, REQ, select="SELECT request_id, run, completion_tokens FROM req WHERE completion_tokens <= 0 OR wall_s <= 0"),
    "trial_rollup": stack(EV, REQ, GOOD, TRIALS, select="SELECT * FROM trials"),
    "cell_rollup": stack(EV, REQ, GOOD, TRIALS, CELLS, select=f"SELECT {CELL_COLUMNS} FROM cells"),
    "discard_warmup": stack(EV, REQ, LATER_GOOD, TRIALS, CELLS, select=f"SELECT {CELL_COLUMNS} FROM cells"),
    "latency_nearest_rank": stack(
        EV,
        REQ,
        select=f"""SELECT class, {at_rank("ttft_s", 0.5)} AS p50, {at_rank("ttft_s", 0.95)} AS p95,
  {at_rank("ttft_s", 0.99)} AS p99 FROM req WHERE ttft_s IS NOT NULL GROUP BY class""",
    ),
    "chunk_tripwire": stack(
        EV,
        REQ,
        GOOD,
        select=f"""SELECT run, class, concurrency, thinking,
  {rounded("sum(completion_tokens) / greatest(sum(sse_chunks), 1)", 2)} AS tokens_per_sse_chunk,
  abs(sum(completion_tokens) / greatest(sum(sse_chunks), 1) - 1) <= 0.05::DOUBLE AS suspect FROM good GROUP BY ALL""",
    ),
    "published_cells": stack(EV, REQ, GOOD, TRIALS, CELLS, PUBLISHED, select="SELECT * FROM published"),
    "measured_cells": stack(EV, FRAMES, READ, GOOD, TRIALS, CELLS, SCRAPED, select="SELECT * FROM published"),
    "publish_gate": stack(
        EV,
        REQ,
        GOOD,
        TRIALS,
        CELLS,
        PUBLISHED,
        select="""SELECT run, count(*) AS cells, min(trials) AS fewest_trials,
  max(elapsed_s) >= 30 AND count(acceptance) > 0 AS publish,
  concat_ws('; ', CASE WHEN max(elapsed_s) < 30 THEN 'no steady state' END,
    CASE WHEN count(acceptance) = 0 THEN 'no acceptance' END) AS refusals,
  CASE WHEN min(trials) < 3 THEN 'fewer than three trials' ELSE '' END AS violations FROM published GROUP BY run""",
    ),
    "counter_scan": stack(
        EV,
        SAMPLES,
        select="""SELECT engine AS source, scraped_us, CASE WHEN sample_id % 2 = 0 THEN 'vllm' ELSE 'sglang' END AS engine_family,
  unnest(['accepted', 'drafted']) AS metric, unnest([accepted, drafted]) AS value FROM samples WHERE kind = 'counter'""",
    ),
    "gauge_fallback": stack(
        EV,
        SAMPLES,
        select=f"""SELECT engine AS source, scraped_us, kind, accepted, drafted,
  {rounded("(rate + rate / 2) / 2", 4)} AS rate FROM samples""",
    ),
    "counter_bracket": stack(
        EV,
        SAMPLES,
        SPANS,
        BRACKETS,
        select="""SELECT engine, span_id, b.accepted AS accepted_before, b.drafted AS drafted_before,
  a.accepted AS accepted_after, a.drafted AS drafted_after FROM spans JOIN back b USING (span_id) JOIN ahead a USING (span_id)""",
    ),
    "acceptance_delta": stack(
        EV,
        SAMPLES,
        SPANS,
        BRACKETS,
        select=f"""SELECT engine, span_id, {rounded(ACCEPTANCE, 3)} AS acceptance
  FROM spans JOIN back b USING (span_id) JOIN ahead a USING (span_id)""",
    ),
    "counter_window_delta": stack(
        EV,
        SAMPLES,
        """moved AS (SELECT *, last_value(CASE WHEN kind = 'counter' THEN accepted END IGNORE NULLS) OVER w AS pa,
   last_value(CASE WHEN kind = 'counter' THEN drafted END IGNORE NULLS) OVER w AS pd FROM samples
   WINDOW w AS (PARTITION BY engine ORDER BY scraped_us, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        DELTAS,
        select=f"""SELECT engine, scraped_us, sample_id, status,
  CASE WHEN status IN ('ok', 'insufficient traffic') THEN drafted - pd END AS draft_tokens,
  CASE WHEN status = 'ok' THEN {rounded("(accepted - pa) / (drafted - pd)", 6)} END AS acceptance FROM deltas""",
    ),
    "accepted_length": stack(
        EV,
        """lengths AS (SELECT event_id, k2 AS k, CASE WHEN k + 1 < 100 THEN (1 - pow((k + 1) / 100, k2 + 1)) / (1 - (k + 1) / 100)
    ELSE k2 + 1 END AS l FROM ev, unnest([3, 5, 7]) t(k2))""",
        select=f"SELECT event_id, CAST(k AS INT) AS k, {rounded('l', 4)} AS accepted_len, {rounded('l / (1 + 0.08::DOUBLE * k)', 4)} AS score FROM lengths",
    ),
    "allowed_depths": stack(
        EV,
        select="""SELECT event_id, CAST(1 + user_id % 12 AS INT) AS max_seqs, array_to_string(
  [c FOR c IN [3, 5, 7, 8] IF (1 + user_id % 12) * (c + 1) <= 48], ',') AS allowed FROM ev""",
    ),
    "recommend_k": stack(
        EV,
        "points AS (SELECT event_id AS pid, (k + 1) / 100 AS a FROM ev)",
        advised("a", "3, 5, 7, 8"),
        select=f"SELECT pid AS event_id, {rounded('a', 3)} AS acceptance, 5 AS current_k, recommended_k, expected_gain, apply FROM advised",
    ),
    "draft_depth_advice": stack(
        EV,
        SAMPLES,
        ticks(3600, False),
        DELTAS,
        TICK_ADVICE,
        advised("a", ADVICE_COLUMNS),
        select=f"""SELECT engine, scraped_us, sample_id, status,
  CASE WHEN status IN ('ok', 'insufficient traffic') THEN drafted - pd END AS draft_tokens, {rounded("a", 3)} AS acceptance,
  CASE WHEN a IS NOT NULL THEN 5 END AS current_k, recommended_k, expected_gain, apply
  FROM deltas LEFT JOIN advised ON pid = sample_id""",
    ),
    "sse_to_requests": stack(
        EV,
        FRAMES,
        select="""SELECT event_id AS request_id, at_us AS started_us,
  ((CASE WHEN ends THEN m + 4 ELSE m + 5 END) * 1000 * (1 + k)) / 1e6 AS wall_s, (3 * 1000 * (1 + k)) / 1e6 AS ttft_s,
  CAST(CASE WHEN ends THEN m ELSE m + 1 END AS BIGINT) AS sse_chunks,
  CAST(CASE WHEN NOT ends THEN 9999 WHEN event_type = 'error' THEN 0 ELSE 16 + k END AS BIGINT) AS completion_tokens,
  CAST(CASE WHEN NOT ends OR event_type = 'error' THEN 0 ELSE 64 * (1 + user_id % 8) END AS BIGINT) AS prompt_tokens FROM framed""",
    ),
    "prompt_token_estimate": """SELECT conv_id, CAST(sum(CASE WHEN text IS NULL THEN 256 ELSE length(text) // 4 END) AS BIGINT)
  AS prompt_tokens, count(*) AS messages FROM conversations GROUP BY conv_id""",
    "message_token_estimate": stack(ASKED, select="SELECT request_id, prompt_tokens FROM asked"),
    "body_token_estimate": """SELECT doc_id AS request_id, CAST(CASE doc_id % 9 WHEN 0 THEN length(text) // 4 WHEN 1 THEN 256 WHEN 3 THEN 256 + 256 + 2
  WHEN 2 THEN 256 + length(text) // 4 WHEN 4 THEN 256 + length(text) // 4 WHEN 5 THEN 256 + length(text) // 4 WHEN 6 THEN 0
  WHEN 7 THEN CASE WHEN doc_id % 2 = 0 THEN length(text) // 4 END END AS BIGINT) AS prompt_tokens FROM documents WHERE text IS NOT NULL""",
    "model_lane_split": stack(ASKED, SUFFIXED, select="SELECT request_id, model, suffix, served_model, requested FROM suffixed"),
    "lane_choice": stack(
        ASKED,
        SUFFIXED,
        DECIDED,
        select="SELECT request_id, served_model, prompt_tokens, depth_inflight, derived_lane, derived_rule FROM decided",
    ),
    "admission": stack(
        ASKED,
        SUFFIXED,
        DECIDED,
        JUDGED,
        select="""SELECT request_id, derived_lane, lane_inflight, refusal_code, CASE refusal_code WHEN 404 THEN 'not_found'
  WHEN 400 THEN 'invalid_json' WHEN 503 THEN 'draining' WHEN 413 THEN 'prompt_too_large_for_lane' WHEN 429 THEN 'lane_saturated'
  WHEN 502 THEN 'backend_unreachable' END AS refusal_kind, CASE WHEN refusal_code = 413 THEN over END AS shortfall_tokens
  FROM judged""",
    ),
    "routing_audit": stack(
        ASKED,
        SUFFIXED,
        DECIDED,
        JUDGED,
        select="""SELECT lane, start_us // 3600000000 AS hour, count(*) AS requests,
  count(*) FILTER (WHERE lane <> derived_lane) AS mismatches, count(refusal_code) AS refusals FROM judged GROUP BY ALL""",
    ),
    "effective_max_tokens": stack(
        ASKED,
        select="""SELECT request_id, max_tokens, coalesce(nullif(max_tokens, 0), 32768) AS requested,
  least(coalesce(nullif(max_tokens, 0), 32768), 262144, 262144 - prompt_tokens) AS effective FROM asked""",
    ),
    "inflight_at_arrival": stack(
        EV,
        ROUTES,
        select="""SELECT r.lane, r.request_id, r.start_us AS at_us, count(o.request_id) AS inflight FROM routes r LEFT JOIN routes o
  ON o.lane = r.lane AND (o.start_us < r.start_us OR (o.start_us = r.start_us AND o.request_id < r.request_id))
  AND o.end_us > r.start_us GROUP BY ALL""",
    ),
    "inflight_history": stack(
        EV,
        ROUTES,
        select="""SELECT r.lane, r.request_id, r.start_us AS at_us, count(o.request_id) AS inflight FROM routes r LEFT JOIN routes o
  ON o.lane = r.lane AND (o.start_us < r.start_us OR (o.start_us = r.start_us AND o.request_id < r.request_id)) AND o.end_us > r.start_us
  WHERE r.start_us >= (SELECT max(start_us) // 86400000000 * 86400000000 FROM routes) GROUP BY ALL""",
    ),
    "least_outstanding": stack(
        EV,
        ROUTES,
        "backends(lane, backend, ord) AS (VALUES ('depth', 'depth', 0), ('fleet', 'fleet-A', 0), ('fleet', 'fleet-B', 1), ('split', 'split-decode', 0))",
        """loads AS (SELECT r.lane, r.request_id, b.backend, b.ord, count(o.request_id) AS n FROM routes r JOIN backends b USING (lane)
  LEFT JOIN routes o ON o.backend = b.backend AND o.end_us > r.start_us
  AND (o.start_us < r.start_us OR (o.start_us = r.start_us AND o.request_id < r.request_id)) GROUP BY ALL)""",
        select="""SELECT lane, request_id, CAST(sum(n) AS BIGINT) AS lane_inflight,
  CASE WHEN sum(n) < 12 THEN first(backend ORDER BY n, ord) END AS picked_backend FROM loads GROUP BY ALL""",
    ),
    "route_rollup": stack(
        EV,
        ROUTES,
        select=f"""SELECT lane, backend, rule, count(*) AS requests, count(*) FILTER (WHERE status = 200) AS ok,
  count(*) FILTER (WHERE status = 400) AS client_errors, count(*) FILTER (WHERE status = 500) AS server_errors,
  {at_rank("ms", 0.5)} AS p50_ms, {at_rank("ms", 0.95)} AS p95_ms FROM routes GROUP BY lane, backend, rule""",
    ),
    "route_totals": stack(
        EV,
        ROUTES,
        select="""SELECT lane, backend, count(*) AS requests, count(*) FILTER (WHERE status <> 200) AS failures,
  GROUPING(lane, backend) AS level FROM routes GROUP BY ROLLUP (lane, backend)""",
    ),
    "router_log_scan": stack(
        EV,
        ROUTES,
        select="""SELECT start_us // 1000000 AS ts, lane, backend, rule, status, ms,
  start_us // 1000000 * 1000000 + ms * 1000 AS end_us FROM routes""",
    ),
    "repeat_run_features": stack(OUTPUTS, RUNS, select="SELECT seq, longest_bang_run, total_bangs, replacement_chars, is_loop FROM looped"),
    "token_zero_outputs": stack(OUTPUTS, RUNS, select="SELECT seq, token_zero FROM looped"),
    "token_zero_tail": stack(
        OUTPUTS,
        select=f"""SELECT seq AS request_id, CAST(length(t) AS INT) AS tokens, right(t, 16) = repeat('!', 16) AS looping,
  CAST(CASE WHEN right(t, 16) = repeat('!', 16) THEN length(t) - 15 END AS INT) AS finished_len FROM ({WHOLE_TEXT})""",
    ),
    "sticky_poison": stack(OUTPUTS, RUNS, EPOCHS, select="SELECT server, seq, epoch, is_loop, suspect FROM suspects"),
    "poison_outcomes": stack(
        OUTPUTS,
        RUNS,
        EPOCHS,
        select="""SELECT server, epoch, count(*) AS outputs, count(*) FILTER (WHERE is_loop) AS loops,
  count(*) FILTER (WHERE suspect) AS suspects, CASE
    WHEN bool_or(is_loop AND NOT follow_up) AND bool_or(is_loop AND follow_up) THEN 'reproduced and poisoned'
    WHEN bool_or(is_loop AND NOT follow_up) THEN 'reproduced' WHEN bool_or(is_loop) THEN 'poisoned only' ELSE 'clean' END
  AS outcome FROM suspects GROUP BY server, epoch""",
    ),
    "degeneration_scan": stack(
        OUTPUTS,
        RUNS,
        EPOCHS,
        select="SELECT server, seq, epoch, is_loop, token_zero, suspect FROM suspects WHERE is_loop OR token_zero OR suspect",
    ),
    "corruption_verdicts": stack(TRIED, select="SELECT run, trial, flag, flag <> 'ok' OR partner_zero AS bad FROM flagged"),
    "corruption_trials": stack(
        TRIED,
        select="""SELECT run, count(*) AS trials, count(*) FILTER (WHERE flag = 'ok' AND NOT partner_zero) AS clean,
  count(*) FILTER (WHERE flag = 'TOKEN-ZERO') AS token_zero, count(*) FILTER (WHERE flag = 'MISS') AS missed,
  bool_or(flag <> 'ok' OR partner_zero) AS reproduced FROM flagged GROUP BY run""",
    ),
    "retrieval_verdict": stack(
        CASES,
        select="""SELECT kind, depth_tokens, position, CASE WHEN GROUPING(kind) = 0 THEN 'kind'
    WHEN GROUPING(position) = 0 THEN 'depth and position' WHEN GROUPING(depth_tokens) = 0 THEN 'depth' ELSE 'all' END AS level,
  count(*) FILTER (WHERE passed) AS passed, count(*) AS total,
  CASE WHEN bool_and(passed) THEN 'RELIABLE' ELSE 'DEGRADED' END AS verdict FROM cases
  GROUP BY GROUPING SETS ((kind), (depth_tokens), (depth_tokens, position), ())""",
    ),
    "retrieval_scan": stack(
        CASES,
        select="""SELECT run, count(*) FILTER (WHERE passed) AS passed, count(*) AS total,
  CASE WHEN bool_and(passed) THEN 'RELIABLE' ELSE 'DEGRADED' END AS verdict FROM cases GROUP BY run""",
    ),
    "repair_tool_calls": stack(RESPONSES, select="SELECT d AS response_id, finish_reason, array_to_string(kept, ',') AS kept FROM repaired"),
    "first_effective_stop": stack(RESPONSES, select="SELECT d AS response_id, position, stop FROM named"),
    "response_repair_audit": stack(
        RESPONSES,
        select="""SELECT model, finish_reason, count(*) AS responses,
  CAST(sum(coalesce(len(calls), 0) - coalesce(len(kept), 0)) AS BIGINT) AS dropped_calls, count(position) AS stopped_responses
  FROM named GROUP BY model, finish_reason""",
    ),
    "loss_gate": stack(
        EV,
        """ends AS (SELECT user_id % 50 AS run, count(*) AS points, first(value ORDER BY event_id) AS f,
  last(value ORDER BY event_id) AS l FROM ev WHERE k % 13 <> 0 GROUP BY ALL)""",
        select=f"""SELECT run, points, {rounded("f", 4)} AS loss_first, {rounded("l", 4)} AS loss_last,
  l < 0.9::DOUBLE * f AS smoke_passed, points >= 2 AND l >= f AS did_not_fall FROM ends""",
    ),
    "tokens_per_unit": f"""SELECT source, prompt_tokens, units, {rounded("prompt_tokens / units", 1)} AS tokens_per_unit,
  greatest(1, CAST(round_even(33000 / (prompt_tokens / units), 0) AS BIGINT)) AS units_for_target FROM
  (SELECT source, CAST(sum(length(text) // 4) AS BIGINT) AS prompt_tokens,
    CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS units FROM documents GROUP BY source)""",
    "probe_gate": stack(
        EV,
        """shot AS (SELECT user_id AS node, NOT ((event_type = 'error' AND user_id % 4 > 0) OR user_id % 9 = 0) AS ok FROM ev)""",
        select="""SELECT node, count(*) FILTER (WHERE NOT ok) AS failures, count(*) AS probes,
  CASE WHEN bool_and(ok) THEN 'OK' WHEN bool_or(ok) THEN 'WARN' ELSE 'FAIL' END AS verdict FROM shot GROUP BY node""",
    ),
    "render_chat": """SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || coalesce(text, '') || chr(10), ''
  ORDER BY turn) AS text FROM conversations GROUP BY ALL""",
    "training_set": stack(
        CHAT_ROWS, select="SELECT row_id, source, length(text) AS chars, md5(text) AS digest FROM chat_rows WHERE text IS NOT NULL"
    ),
    "training_profile": stack(
        CHAT_ROWS,
        select="""SELECT source, count(*) AS rows, count(*) FILTER (WHERE has_text) AS from_text,
  count(*) FILTER (WHERE has_messages AND NOT has_text) AS from_messages, count(*) FILTER (WHERE text IS NULL) AS dropped,
  CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest FROM chat_rows GROUP BY source""",
    ),
    "chat_jsonl_scan": stack(
        CHAT_ROWS, select="SELECT md5(text) AS digest, count(*) AS rows FROM chat_rows WHERE text IS NOT NULL GROUP BY ALL"
    ),
    "strict_int": stack(SETTINGS, select="SELECT name, TRY_CAST(nullif(raw, '') AS BIGINT) AS value FROM reasoned WHERE reason IS NULL"),
    "rejected_settings": stack(SETTINGS, select="SELECT name, raw, reason FROM reasoned WHERE reason IS NOT NULL"),
    "ingest_quarantine": stack(
        SETTINGS,
        select="""SELECT source, count(*) AS settings, count(*) FILTER (WHERE reason IS NULL AND raw <> '') AS good,
  count(*) FILTER (WHERE raw IS NULL OR raw = '') AS empty, count(reason) AS rejected FROM reasoned GROUP BY source""",
    ),
    "cold_prompts": f"""SELECT doc_id, length(p) AS chars, md5(p) AS digest FROM (SELECT doc_id, substr('cell-' || source || '-' || doc_id
  || ' ' || repeat('{FILLER}', CAST(n // 6 + 1 AS INT)), 1, n * 4 - 128) || '{_TASK_SQL}' AS p
  FROM (SELECT *, 64 * (1 + doc_id % 40) AS n FROM documents))""",
    "eval_set": f"""WITH grid AS (SELECT doc_id, source, lang, depth, pos FROM documents, unnest([16, 64]) a(depth), unnest([0.0, 0.5, 1.0]) b(pos)),
 hay AS (SELECT *, list_transform(range(0, depth), lambda i: 'log ' || lpad(CAST(i AS VARCHAR), 5, '0') || ': ' || array_to_string(
   list_transform(range(0, 6), lambda s: ({_WORD_LIST})[CAST('0x' || substr(md5((1000 + doc_id) || '/' || depth || ':' || i || ':' || s), 1, 8)
     AS BIGINT) % 26 + 1]), ' ')) AS lines, CAST(floor(depth * pos) AS INT) AS ahead FROM grid),
 made AS (SELECT *, array_to_string(list_concat(list_concat(lines[1:ahead], ['{PLANTED[0]}' || upper(source || '-' || lang)
   || '{PLANTED[1]}']), lines[ahead + 1:]), chr(10)) || '{_QUESTION_SQL}'
   AS prompt FROM hay)
SELECT doc_id AS case_id, CAST(depth AS INT) AS depth_lines, CAST(pos AS DOUBLE) AS position, length(prompt) AS chars, md5(prompt) AS digest FROM made""",
    "artifact_scan": stack(
        EV,
        REQ,
        GOOD,
        TRIALS,
        CELLS,
        PUBLISHED,
        select="""SELECT run AS lane, class, prompt_tokens_actual AS prompt_tokens, concurrency, thinking, aggregate_tok_s, ttft_p95_s,
  CASE WHEN acceptance IS NOT NULL THEN true END AS correction_holds FROM published""",
    ),
    "artifact_sink": stack(
        EV,
        REQ,
        GOOD,
        TRIALS,
        CELLS,
        PUBLISHED,
        select="""SELECT run AS lane, 'spec' AS suite, min(trials) OVER (PARTITION BY run) AS trials, class, prompt_tokens_actual AS prompt_tokens,
  concurrency, thinking, per_stream_tok_s, aggregate_tok_s, ttft_p50_s, ttft_p95_s, acceptance FROM published""",
    ),
    "artifact_report": stack(
        EV,
        REQ,
        GOOD,
        TRIALS,
        CELLS,
        PUBLISHED,
        select="""SELECT run, '| ' || coalesce(class, CAST(prompt_tokens_actual AS VARCHAR)) || ' | ' || concurrency || ' | '
  || CASE WHEN thinking THEN 'on' ELSE 'off' END || ' | ' || per_stream_tok_s || ' | ' || aggregate_tok_s || ' | '
  || coalesce(CAST(ttft_p50_s AS VARCHAR), '-') || ' | ' || coalesce(CAST(ttft_p95_s AS VARCHAR), '-') || ' | '
  || coalesce(CAST(acceptance AS VARCHAR), '-') || ' |' AS line FROM published""",
    ),
    "advice_sink": stack(
        EV,
        SAMPLES,
        ticks(3600, False),
        DELTAS,
        TICK_ADVICE,
        advised("a", ADVICE_COLUMNS),
        select="""SELECT engine, status, count(*) AS windows, count(*) FILTER (WHERE recommended_k <> 5) AS changes
  FROM deltas LEFT JOIN advised ON pid = sample_id GROUP BY engine, status""",
    ),
    "run_compare": stack(
        EV,
        REQ,
        GOOD,
        TRIALS,
        CELLS,
        select=f"""SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.class, b.class) AS class, coalesce(a.concurrency, b.concurrency) AS concurrency,
  coalesce(a.thinking, b.thinking) AS thinking, coalesce(a.s, b.s) AS speculating, a.v AS left_value, b.v AS right_value,
  CASE WHEN a.run IS NULL THEN 'right only' WHEN b.run IS NULL THEN 'left only' ELSE 'paired' END AS status,
  {rounded("b.v / nullif(a.v, 0)", 2)} AS ratio FROM
  (SELECT *, CAST(run[5:] AS INT) AS pair, tokens_per_sse_chunk > 3.75::DOUBLE AS s, aggregate_tok_s AS v FROM cells) a FULL JOIN
  (SELECT *, (CAST(run[5:] AS INT) + 7) % 8 AS pair, tokens_per_sse_chunk > 3.75::DOUBLE AS s, aggregate_tok_s AS v FROM cells) b
  ON a.pair = b.pair AND a.class IS NOT DISTINCT FROM b.class AND a.concurrency = b.concurrency AND a.thinking = b.thinking AND a.s = b.s""",
    ),
    "claim_reconcile": """WITH proof AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(28, 2))) AS DOUBLE) AS v
  FROM lineitem GROUP BY 1)
SELECT o_orderkey AS claim_id, o_orderkey AS artifact, o_totalprice AS value, v AS artifact_value,
  CASE WHEN v IS NULL THEN 'no artifact' ELSE 'value differs' END AS problem
FROM orders LEFT JOIN proof ON l_orderkey = o_orderkey WHERE o_orderpriority < '4' AND (v IS NULL OR abs(o_totalprice - v) > 0.005::DOUBLE)""",
    "claims_without_artifact": """SELECT o_orderkey AS artifact, o_orderkey AS claim_id, 'M-here' AS label, o_totalprice AS value FROM orders
WHERE o_orderpriority < '4' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "capacity_fit": """SELECT p_partkey AS model, p_size * 1.5::DOUBLE AS weights_gib, CASE
  WHEN p_size * 1.5 <= (SELECT max(10 + n_nationkey) FROM nation) THEN 'one node'
  WHEN p_size * 1.5 <= 2 * (SELECT 10 + n_nationkey FROM nation ORDER BY n_nationkey DESC LIMIT 1 OFFSET 1) THEN 'two nodes'
  ELSE 'does not fit' END AS fit FROM part""",
    "capacity_nodes": """SELECT p_partkey AS model, p_size * 1.5::DOUBLE AS weights_gib, count(n_name) AS nodes_fitting,
  arg_min(n_name, n_nationkey) AS smallest_node FROM part LEFT JOIN nation ON 10 + n_nationkey >= p_size * 1.5 GROUP BY ALL""",
    "inventory_diff": stack(INVENTORY, select=ORDERED),
    "revert_plan": REVERT.format(distinct=""),
    "revert_difference": REVERT.format(distinct="DISTINCT"),
    "suite_coverage": stack(
        EV,
        SUITE,
        select="""SELECT r.run, CAST(p AS INT) AS prompt_tokens, CAST(c AS INT) AS concurrency FROM (SELECT DISTINCT run FROM measured) r,
  unnest([256, 2048, 8192, 32768, 131072]) x(p), unnest([1, 2, 4, 6]) y(c)
WHERE NOT EXISTS (SELECT 1 FROM measured m WHERE m.run = r.run AND m.prompt_tokens = p AND m.concurrency = c)""",
    ),
    "latest_capture": stack(EV, CAPTURES, select="SELECT node, max(capture) AS capture, arg_max(containers, capture) AS containers FROM captures GROUP BY node"),
    "latest_capture_overall": stack(EV, CAPTURES, select="SELECT * FROM captures ORDER BY capture DESC LIMIT 1"),
    "live_acceptance": stack(
        EV,
        SAMPLES,
        ticks(3600, True),
        DELTAS,
        TICK_ADVICE,
        advised("a", ADVICE_COLUMNS),
        select=f"""SELECT engine, window_end_us, 3600 AS window_s, status,
  CASE WHEN status IN ('ok', 'insufficient traffic') THEN drafted - pd END AS draft_tokens, {rounded("a", 3)} AS acceptance,
  CASE WHEN a IS NOT NULL THEN 5 END AS current_k, recommended_k, expected_gain, apply
  FROM deltas LEFT JOIN advised ON pid = sample_id""",
    ),
    "scrape_advice": stack(
        EV,
        SAMPLES,
        ticks(3600, True),
        DELTAS,
        TICK_ADVICE,
        advised("a", ADVICE_COLUMNS),
        select=f"""SELECT engine, window_end_us, 3600 AS window_s, status,
  CASE WHEN status IN ('ok', 'insufficient traffic') THEN drafted - pd END AS draft_tokens, {rounded("a", 3)} AS acceptance,
  CASE WHEN a IS NOT NULL THEN 5 END AS current_k, recommended_k, expected_gain, apply
  FROM deltas LEFT JOIN advised ON pid = sample_id""",
    ),
    "token0_guard": stack(
        OUTPUTS,
        select=f"""SELECT seq AS request_id, CAST(instr(t, repeat('!', 16)) AS BIGINT) AS finished_len
  FROM ({WHOLE_TEXT}) WHERE contains(t, repeat('!', 16))""",
    ),
    "suspect_stream": stack(OUTPUTS, RUNS, EPOCHS, select="SELECT server, seq, epoch, is_loop, suspect FROM suspects"),
    "first_token_latency": stack(
        EV,
        FRAMES,
        """timed AS (SELECT *, at_us + CASE WHEN ends THEN m + 4 ELSE m + 5 END * 1000 * (1 + k) AS last_us,
   CASE WHEN NOT ends THEN 9999 WHEN event_type = 'error' THEN 0 ELSE 16 + k END AS tokens,
   ((CASE WHEN ends THEN m + 4 ELSE m + 5 END) * 1000 * (1 + k)) / 1e6 AS wall_s FROM framed)""",
        select=f"""SELECT event_id AS request_id, CASE WHEN ends THEN 'done' ELSE 'timeout' END AS ended, wall_s,
  (3 * 1000 * (1 + k)) / 1e6 AS ttft_s, CAST(CASE WHEN ends THEN m ELSE m + 1 END AS BIGINT) AS sse_chunks,
  CAST(tokens AS BIGINT) AS completion_tokens, CASE WHEN tokens > 0 THEN {rounded("tokens / wall_s", 3)} END AS tok_s
  FROM timed WHERE ends OR last_us + 7200000000 < (SELECT max(last_us) - 600000000 FROM timed)""",
    ),
    "log_signature_trailing": stack(
        EV,
        LOGS,
        select="""SELECT DISTINCT container, at_us, count(*) OVER (PARTITION BY container ORDER BY to_timestamp(at_us / 1e6)
    RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS lines FROM lost""",
    ),
    "log_signature_alert": stack(EV, LOGS, select=ALERTS.format(where="")),
    "log_signature_stream": stack(
        EV, LOGS, select=ALERTS.format(where="WHERE told_us <= (SELECT max(at_us) // 1000 * 1000 - 600000000 FROM lost)")
    ),
    "live_routes": stack(
        EV,
        ROUTES,
        f"""told AS (SELECT lane, backend, rule, (start_us // 1000000 // 300 + 1) * 300000000 AS window_end_us, count(*) AS requests,
  count(*) FILTER (WHERE status BETWEEN 200 AND 299) AS ok, count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS client_errors,
  count(*) FILTER (WHERE status BETWEEN 500 AND 599) AS server_errors, {rounded("sum(ms) / count(ms)", 3)} AS mean_ms, max(ms) AS longest_ms
  FROM routes GROUP BY ALL)""",
        select="SELECT * FROM told WHERE window_end_us <= (SELECT max(start_us) // 1000000 * 1000000 - 600000000 FROM routes)",
    ),
    "series_increase": stack(EV, SERIES, select="SELECT source, scraped_us, metric, sum(coalesce(grown, 0)) AS increase, count(*) FILTER (WHERE again) AS restarts FROM grown GROUP BY ALL"),
    "series_acceptance": stack(
        EV,
        SERIES,
        select=f"""SELECT source, scraped_us, accepted, drafted, restarts, CASE WHEN drafted > 0 THEN {rounded("accepted / drafted", 6)} END AS acceptance
  FROM (SELECT source, scraped_us, sum(coalesce(grown, 0)) FILTER (WHERE metric = 'accepted') AS accepted,
    sum(coalesce(grown, 0)) FILTER (WHERE metric = 'drafted') AS drafted, count(*) FILTER (WHERE again) AS restarts FROM grown GROUP BY ALL)""",
    ),
}

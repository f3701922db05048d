"""Routing and admission seen from a request log.

A logged request carries request_id, lane, backend, start_us and end_us, and for
the audit also its path, model, header lane, prompt tokens and flags.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chat
from ..functions.numeric import order_key
from .keys import lookup_join, null_safe_join
from .order_stats import nearest_rank
from .ordered import running
from ..sources.storage import pin

_ROW = "_request_row"


def _numbered(requests: DataFrame) -> DataFrame:
    """The rows, fixed, each with a number of its own, as ids may be null or given twice."""
    return requests if _ROW in requests.columns else pin(requests.withColumn(_ROW, F.monotonically_increasing_id()))


def inflight_at(holds: DataFrame, probes: DataFrame, resource: str = "lane") -> DataFrame:
    """Requests that hold `resource` when each probe arrives.

    `holds` carries the resource, request_id, start_us and end_us; `probes` the
    resource, request_id and at_us. At one instant releases come first, then
    arrivals by id and row; a request never counts itself. A hold of no length never
    occupies anything. Where both have the row numbers of `_numbered`, each probe keeps its own.
    """
    row = [_ROW] if _ROW in holds.columns and _ROW in probes.columns else []
    held = holds.where("end_us > start_us").select(
        resource,
        F.explode(
            F.array(
                F.struct(F.col("end_us").alias("_t"), F.lit(0).alias("_kind"), F.lit(-1).alias("_delta")),
                F.struct(F.col("start_us").alias("_t"), F.lit(1).alias("_kind"), F.lit(1).alias("_delta")),
            )
        ).alias("_e"),
        F.col("request_id").alias("_id"),
        *row,
        F.lit(1).alias("_sub"),
    )
    asked = probes.select(
        resource,
        F.struct(F.col("at_us").alias("_t"), F.lit(1).alias("_kind"), F.lit(0).alias("_delta")).alias("_e"),
        F.col("request_id").alias("_id"),
        *row,
        F.lit(0).alias("_sub"),
    )
    events = held.unionByName(asked).select(resource, "_e._t", "_e._kind", "_e._delta", "_id", *row, "_sub")
    counted = running(events, [resource], ["_t", "_kind", "_id", *row, "_sub"], sums={"inflight": "_delta"})
    return counted.where("_kind = 1 AND _sub = 0").select(
        resource, F.col("_id").alias("request_id"), *row, F.col("_t").alias("at_us"), F.col("inflight").cast("long").alias("inflight")
    )


def arrival_events(requests: DataFrame, resource: str = "lane") -> DataFrame:
    """Each arrival, which is also the start of its hold, and the release of each hold that lasts: time, kind, change of the load."""
    lasts = F.col("end_us") > F.col("start_us")
    arrival = F.struct(
        F.col("start_us").alias("_t"), F.lit(1).alias("_kind"), F.when(lasts, 1).otherwise(0).alias("_delta")
    )
    release = F.struct(F.col("end_us").alias("_t"), F.lit(0).alias("_kind"), F.lit(-1).alias("_delta"))
    return requests.select(
        resource, F.col("request_id").alias("_id"), F.explode(F.array_compact(F.array(arrival, F.when(lasts, release)))).alias("_e")
    ).select(resource, "_id", "_e.*")


def inflight_at_arrival(requests: DataFrame, resource: str = "lane") -> DataFrame:
    """Requests in flight on the same resource when each request arrives.

    As `inflight_at` with the requests as their own probes, in two rows per
    request: its arrival is both the question and the start of its hold.
    """
    events = arrival_events(requests, resource)
    counted = running(events, [resource], ["_t", "_kind", "_id"], sums={"inflight": "_delta"})
    return counted.where("_kind = 1").select(
        resource, F.col("_id").alias("request_id"), F.col("_t").alias("at_us"), F.col("inflight").cast("long").alias("inflight")
    )


def least_outstanding(
    requests: DataFrame, backends: DataFrame, lane_max: int = chat.LANE_MAX_INFLIGHT
) -> DataFrame:
    """Backend with the fewest requests in flight at each arrival.

    `backends` lists lane, backend and ord; the first in order wins ties and a
    lane that is full as a whole gives none. A request of a lane without backends has a null pick.
    Rows that share an id, or have none, are requests of their own.
    """
    requests = _numbered(requests)
    arrivals = requests.select("lane", "request_id", _ROW, F.col("start_us").alias("at_us"))
    choices = backends.groupBy("lane").agg(F.collect_set(F.struct("backend", "ord")).alias("_choices"))
    offered = (
        lookup_join(arrivals, choices, ["lane"])
        .select("lane", "request_id", _ROW, "at_us", F.explode("_choices").alias("_choice"))
        .select("lane", "request_id", _ROW, "at_us", "_choice.*")
    )
    loads = lookup_join(inflight_at(requests, offered, "backend"), backends, ["backend"])
    least = loads.groupBy("lane", "request_id", _ROW).agg(
        F.min_by("ord", order_key(F.col("inflight"), F.col("ord"))).alias("ord"), F.sum("inflight").alias("lane_inflight")
    )
    picked = lookup_join(least, backends, ["lane", "ord"]).select(
        "lane",
        "request_id",
        "lane_inflight",
        F.when(F.col("lane_inflight") < lane_max, F.col("backend")).alias("picked_backend"),
    )
    unlisted = lookup_join(arrivals, choices.select("lane"), ["lane"], "left_anti")
    nothing = [F.lit(None).cast(picked.schema[c].dataType).alias(c) for c in ("lane_inflight", "picked_backend")]
    return picked.unionByName(unlisted.select("lane", "request_id", *nothing))


def decide_lane(requests: DataFrame, **rules) -> DataFrame:
    """Add the lane and rule the policy gives, from what was in flight on depth; every row keeps its own, also where ids repeat or are null."""
    numbered = _numbered(requests)
    return _decided(numbered, **rules).drop(_ROW)


def _decided(requests: DataFrame, **rules) -> DataFrame:
    depth = requests.where("lane = 'depth'").select("lane", "request_id", _ROW, "start_us", "end_us")
    probes = requests.select(F.lit("depth").alias("lane"), "request_id", _ROW, F.col("start_us").alias("at_us"))
    load = inflight_at(depth, probes).select(_ROW, F.col("inflight").alias("depth_inflight"))
    choice = chat.lane_choice(
        chat.requested_lane(F.col("model"), F.col("header_lane")),
        F.col("prompt_tokens"),
        F.col("depth_inflight"),
        **rules,
    )
    passthrough = F.struct(F.lit("depth").alias("lane"), F.lit("passthrough").alias("rule"))
    routed = F.when(chat.is_generate_path(F.col("path")), choice).otherwise(passthrough)
    return (
        requests.join(load, _ROW)
        .withColumn("_routed", routed)
        .withColumn("derived_lane", F.col("_routed.lane"))
        .withColumn("derived_rule", F.col("_routed.rule"))
        .withColumn("served_model", chat.model_without_lane(F.col("model")))
        .drop("_routed")
    )


def admission(
    decided: DataFrame, *, ceiling: int = chat.DEPTH_CEILING, lane_max: int = chat.LANE_MAX_INFLIGHT
) -> DataFrame:
    """Add the typed refusal, and by how much a too large request overshoots; every row keeps its own."""
    numbered = _numbered(decided)
    return _admitted(numbered, ceiling, lane_max).drop(_ROW)


def _admitted(decided: DataFrame, ceiling: int, lane_max: int) -> DataFrame:
    holds = decided.select("lane", "request_id", _ROW, "start_us", "end_us")
    probes = decided.select(F.col("derived_lane").alias("lane"), "request_id", _ROW, F.col("start_us").alias("at_us"))
    load = inflight_at(holds, probes).select(_ROW, F.col("inflight").alias("lane_inflight"))
    refused = chat.refusal(
        F.col("path"),
        F.col("body_ok"),
        F.col("draining"),
        F.col("derived_lane"),
        F.col("prompt_tokens"),
        F.col("max_tokens"),
        F.col("lane_inflight"),
        F.col("backend_failed"),
        ceiling=ceiling,
        lane_max=lane_max,
    )
    over = F.col("prompt_tokens") + chat.requested_max_tokens(F.col("max_tokens")) - ceiling
    return (
        decided.join(load, _ROW)
        .withColumn("_refused", refused)
        .withColumn("refusal_code", F.col("_refused.code"))
        .withColumn("refusal_kind", F.col("_refused.kind"))
        .withColumn("shortfall_tokens", F.when(F.col("refusal_code") == 413, over))
        .drop("_refused")
    )


def routing_audit(
    requests: DataFrame,
    *,
    ceiling: int = chat.DEPTH_CEILING,
    lane_max: int = chat.LANE_MAX_INFLIGHT,
    **rules,
) -> DataFrame:
    """One row per request: recorded against derived lane, and any refusal."""
    judged = _admitted(_decided(_numbered(requests), **rules), ceiling, lane_max).drop(_ROW)
    return judged.withColumn("mismatch", ~F.col("lane").eqNullSafe(F.col("derived_lane")))


def audit_rates(audited: DataFrame) -> DataFrame:
    """Mismatch and refusal counts by recorded lane and hour."""
    hour = 3_600_000_000
    return audited.groupBy("lane", F.floor(F.col("start_us") / hour).cast("long").alias("hour")).agg(
        F.count("*").alias("requests"),
        F.count_if("mismatch").alias("mismatches"),
        F.count("refusal_code").alias("refusals"),
    )


def route_rollup(log: DataFrame, keys: Sequence[str] = ("lane", "backend", "rule")) -> DataFrame:
    """Requests, status mix and nearest-rank latency by route."""
    counts = log.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        F.count_if(_status(200, 299)).alias("ok"),
        F.count_if(_status(400, 499)).alias("client_errors"),
        F.count_if(_status(500, 599)).alias("server_errors"),
    )
    times = nearest_rank(log, keys, "ms", {"_p50": 0.50, "_p95": 0.95})
    return null_safe_join(counts, times, keys, "left").select(
        *keys,
        "requests",
        "ok",
        "client_errors",
        "server_errors",
        F.col("_p50").cast("long").alias("p50_ms"),
        F.col("_p95").cast("long").alias("p95_ms"),
    )


def route_totals(log: DataFrame) -> DataFrame:
    """Subtotals by lane and backend, by lane, and over everything."""
    return (
        log.rollup("lane", "backend")
        .agg(F.count("*").alias("requests"), F.count_if(~_status(200, 299)).alias("failures"), F.grouping_id().alias("level"))
    )


def _status(low: int, high: int) -> Column:
    return F.col("status").between(low, high)

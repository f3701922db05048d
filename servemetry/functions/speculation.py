"""Draft-depth arithmetic of speculative decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import half_even

K_SET = (3, 5, 7)
CURRENT_K = 5
MAX_SEQS = 6
CAPTURE_LIMIT = 48
STEP_COST = 0.08


def accepted_len(acceptance: Column, k: Column) -> Column:
    """Expected output of one verification: the accepted drafts and the token that follows them."""
    geometric = (1.0 - F.pow(acceptance, k + 1)) / (1.0 - acceptance)
    return F.when(acceptance < 1.0, geometric).otherwise((k + 1).cast("double"))


def throughput_score(acceptance: Column, k: Column, step_cost: float = STEP_COST) -> Column:
    return accepted_len(acceptance, k) / (1.0 + F.lit(step_cost) * k)


def fits_capture(k: Column, max_seqs: Column | int = MAX_SEQS, limit: int = CAPTURE_LIMIT) -> Column:
    return max_seqs * (k + 1) <= limit


def allowed_k(k_set: Sequence[int] = K_SET, max_seqs: Column | int = MAX_SEQS, limit: int = CAPTURE_LIMIT) -> Column:
    """The candidate depths that fit the captured graphs, ascending."""
    candidates = F.array(*[F.lit(int(k)) for k in sorted(k_set)])
    return F.filter(candidates, lambda k: fits_capture(k, max_seqs, limit))


def best_k(acceptance: Column, ks: Column, current_k: Column, step_cost: float = STEP_COST) -> Column:
    """Highest score, smallest depth on ties, the current depth when none is allowed."""
    scored = F.transform(
        ks, lambda k: F.struct(throughput_score(acceptance, k, step_cost).alias("score"), (-k).alias("neg_k"))
    )
    return F.coalesce(-F.array_max(scored)["neg_k"], current_k)


def advice(
    acceptance: Column,
    *,
    k_set: Sequence[int] = K_SET,
    current_k: int = CURRENT_K,
    max_seqs: Column | int = MAX_SEQS,
    step_cost: float = STEP_COST,
) -> Column:
    """Struct of the recommended depth, the gain expected and the action."""
    now = F.lit(current_k)
    best = best_k(acceptance, allowed_k(k_set, max_seqs), now, step_cost)
    floor_score = F.greatest(F.lit(1e-9), throughput_score(acceptance, now, step_cost))
    gain = throughput_score(acceptance, best, step_cost) / floor_score - 1
    action = F.when(best == now, F.lit("keep current k")).otherwise(
        F.concat(F.lit("restart at a quiet moment with k="), best.cast("string"))
    )
    return F.when(
        acceptance.isNotNull(),
        F.struct(
            half_even(acceptance, 3).alias("acceptance"),
            now.alias("current_k"),
            best.alias("recommended_k"),
            half_even(gain, 3).alias("expected_gain"),
            action.alias("apply"),
        ),
    )

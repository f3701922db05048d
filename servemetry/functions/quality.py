"""Features of degenerate output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOOP_RUN = 16
TOKEN_ZERO_RUN = 16
TOKEN_ZERO_MIN_CHARS = 8

# Fixed value: the characters a Unicode-aware strip removes.
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def full_text(reasoning: Column, content: Column) -> Column:
    return F.concat(F.coalesce(reasoning, F.lit("")), F.coalesce(content, F.lit("")))


def longest_bang_run(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit("(!+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def is_loop(reasoning: Column, content: Column, run: int = LOOP_RUN) -> Column:
    return longest_bang_run(full_text(reasoning, content)) >= run


def is_token_zero(text: Column) -> Column:
    """Nothing but '!', at least eight, once outer white space is gone."""
    pattern = rf"\A{_SPACE}*!{{{TOKEN_ZERO_MIN_CHARS},}}{_SPACE}*\z"
    return F.coalesce(text.rlike(pattern), F.lit(False))


def ends_in_token_zero(ids: Column, run: int = TOKEN_ZERO_RUN) -> Column:
    """The last `run` ids exist and are all zero."""
    tail = F.slice(ids, -run, run)
    return (F.size(ids) >= run) & F.forall(tail, lambda t: t == 0)


def token_zero_finished_len(ids: Column, run: int = TOKEN_ZERO_RUN) -> Column:
    """Length to which a looping output is cut; null when it does not loop."""
    return F.when(ends_in_token_zero(ids, run), F.size(ids) - run + 1)

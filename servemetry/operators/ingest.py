"""Rows on their way in: chats, training rows and strict settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chat
from ..functions.numeric import decimal_digits_only, reject_reason, strict_int

def estimate_turns(turns: DataFrame) -> DataFrame:
    """Prompt token estimate of chats stored one message per row."""
    return turns.groupBy("conv_id").agg(
        F.sum(chat.message_tokens(F.col("text"), F.lit(True))).alias("prompt_tokens"), F.count("*").alias("messages")
    )


def render_turns(turns: DataFrame) -> DataFrame:
    """Every turn of a chat as rendered text, one row each; nothing is collected."""
    return turns.select("conv_id", "turn", chat.render_message(F.col("role"), F.col("text")).alias("text"))


def render_chats(turns: DataFrame) -> DataFrame:
    """Chats stored one message per row as one text each, in turn order.

    A chat's text is one value, whatever its number of turns; where single values may become
    too large for a row, use `render_turns`.
    """
    listed = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return render_turns(turns).groupBy("conv_id").agg(listed.alias("_turns")).select(
        "conv_id", F.array_join(F.transform("_turns", lambda t: t["text"]), "").alias("text")
    )


def training_rows(rows: DataFrame) -> DataFrame:
    """One text per usable row: a given text wins, else the rendered messages."""
    rendered = F.when(F.col("messages").isNotNull(), chat.render_chat(F.col("messages")))
    return rows.withColumn("text", F.coalesce("text", rendered)).where("text IS NOT NULL").drop("messages")


def training_profile(rows: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Kept and dropped rows and the size of what is kept, by source."""
    rendered = F.when(F.col("messages").isNotNull(), chat.render_chat(F.col("messages")))
    text = F.coalesce("text", rendered)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("text").isNotNull()).alias("from_text"),
        F.count_if(F.col("text").isNull() & F.col("messages").isNotNull()).alias("from_messages"),
        F.count_if(text.isNull()).alias("dropped"),
        F.sum(F.length(text)).alias("chars"),
        F.max(F.length(text)).alias("longest"),
    )


def split_settings(knobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) settings; an empty one is good and null."""
    reason = reject_reason(F.col("raw"))
    good = knobs.where(reason.isNull()).withColumn("value", strict_int(F.col("raw")))
    return good, knobs.withColumn("reason", reason).where("reason IS NOT NULL")


def quarantine_rates(knobs: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Good, empty and rejected settings by source."""
    reason = reject_reason(F.col("raw"))
    return knobs.groupBy(*keys).agg(
        F.count("*").alias("settings"),
        F.count_if(reason.isNull() & decimal_digits_only(F.coalesce("raw", F.lit("")))).alias("good"),
        F.count_if(reason.isNull() & (F.coalesce("raw", F.lit("")) == "")).alias("empty"),
        F.count(reason).alias("rejected"),
    )

"""Conversations (conv_id, turn, role, content): sanitizing, windows, folding to one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def sanitize(turns: DataFrame, most: int = P.HISTORY_TURNS, chars: int = P.CONTENT_CHARS) -> DataFrame:
    """Turns of users and assistants, cut to a length, the last ``most`` of each conversation."""
    ok = turns.filter(F.col("role").isin("user", "assistant") & F.col("content").isNotNull()).withColumn("content", F.left("content", F.lit(chars)))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return ok.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")


def history(turns: DataFrame, cap: int = P.HISTORY_CHARS) -> DataFrame:
    """(conv_id, history): the last turns as lines, evened out and cut, the newest end of them."""
    last = sanitize(turns)
    label = F.when(F.col("role") == "user", "Student: ").otherwise("Assistant: ")
    line = F.concat(label, F.left(T.even_space(F.col("content")), F.lit(P.TURN_CHARS)))
    rows = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))  # at most 12 a group
    joined = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return rows.select("conv_id", F.right(joined, F.lit(cap)).alias("history"))


def last_user_turn(turns: DataFrame) -> DataFrame:
    """Each turn with what the user said last before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("previous", F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w))


def search_text(turns: DataFrame) -> DataFrame:
    """What to search for at a user's turn: the turn before it if this one disputes the sources."""
    rows = last_user_turn(turns).filter(F.col("role") == "user")
    challenge = F.coalesce(T.is_source_challenge(F.col("content")), F.lit(False)) & F.col("previous").isNotNull()
    return rows.select("conv_id", "turn", challenge.alias("challenge"), F.when(challenge, F.col("previous")).otherwise(F.col("content")).alias("search_text"))

"""What happens to a ranked list of hits: caps, permutations, recency, a token budget.

A hit list has query_id and pos (1-based); every operator keeps the list's order except where it says
otherwise and never looks across queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..plans.physical import materialize


def _renumber(df: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return df.withColumn("_pos", F.row_number().over(w)).drop("pos").withColumnRenamed("_pos", "pos")


def cap_per_source(hits: DataFrame, source: str = "source_url", most: int = P.MAX_PER_SOURCE) -> DataFrame:
    """At most ``most`` hits of a source; hits without a source count as one source."""
    w = Window.partitionBy("query_id", F.coalesce(F.col(source), F.lit(""))).orderBy("pos")
    kept = hits.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")
    return _renumber(kept, F.col("pos"))


def permute(hits: DataFrame, replies: DataFrame) -> DataFrame:
    """Order by the numbers in a reply (query_id, reply): valid ones first, each once, the rest in old
    order at the back; lists of one hit and replies without a valid number change nothing."""
    sizes = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    named = replies.select("query_id", F.posexplode(F.regexp_extract_all("reply", F.lit(r"\d+"), F.lit(0))).alias("_at", "_number"))
    first = named.select("query_id", F.try_to_number("_number", F.lit("999999999")).cast("int").alias("pos"), "_at").groupBy("query_id", "pos").agg(F.min("_at").alias("_at"))
    rows = hits.join(sizes, "query_id").join(first, ["query_id", "pos"], "left")
    at = F.when(F.col("_n") > 1, F.col("_at"))
    return _renumber(rows, F.coalesce(at, F.lit(2**31 - 1)), F.col("pos")).drop("_at", "_n")


def prefer_recent(hits: DataFrame, year: str = "source_date") -> DataFrame:
    """Undated hits first, then newer before older, then what isn't a year; else old order."""
    y = F.expr(f"try_cast(`{year}` AS INT)")
    undated = F.coalesce(F.col(year), F.lit("")) == ""
    return _renumber(hits, F.when(undated, 0).otherwise(1), F.when(undated, 0).otherwise(F.coalesce(-y, F.lit(0))), F.col("pos"))


def within_budget(hits: DataFrame, text: str = "text", budget: int = P.PROMPT_BUDGET, overhead: int = P.CHUNK_OVERHEAD) -> DataFrame:
    """The hits before the budget runs out, the first in any case. Costs are positive, so the running
    sum tells where a reader would have stopped."""
    w = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cost = T.estimated_tokens(F.coalesce(F.col(text), F.lit(""))) + overhead
    return hits.withColumn("used", F.sum(cost).over(w)).filter((F.col("used") <= budget) | (F.col("pos") == 1))


def last_wins(log: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value of each key, with map-side aggregation (no window, so no hot partition)."""
    return log.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def first_wins(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def first_of_each(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group; the rank filter is applied before the shuffle too."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def every_nth(rows: DataFrame, order: str, n: int) -> DataFrame:
    """Systematic sample of about n rows in the order of a dense integer rank. Ranks come from counts of
    sorted ranges, so no single task sorts all rows."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(max(1, spark.sparkContext.defaultParallelism), order).sortWithinPartitions(order)
    placed = materialize(ranged.select(F.col(order).alias("_o")).withColumn("_p", F.spark_partition_id()))  # written, so that all uses see the same partitions
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    step = max(1, placed.count() // n)
    w = Window.partitionBy("_p").orderBy("_o")
    chosen = placed.join(F.broadcast(offsets), "_p").withColumn("_r", F.row_number().over(w) - 1 + F.col("_before")).filter((F.col("_r") % step == 0) & (F.col("_r") < step * n))
    return rows.join(chosen.select(F.col("_o").alias(order)), order, "left_semi")

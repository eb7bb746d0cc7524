"""Health of vectors and of long runs: defect lists, rolling failure rates, stop rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P


def vector_defects(vectors: DataFrame, row_id: str, vector: str, dim: int) -> DataFrame:
    """(id, defect) of the vectors that can't be used; the first defect that applies."""
    v = F.col(vector)
    defect = (
        F.when(v.isNull(), "missing")
        .when(F.size(v) != dim, "wrong length")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x)), "not a number")
        .when(~F.exists(v, lambda x: x != 0), "all zero")
    )
    return vectors.select(F.col(row_id).alias("id"), defect.alias("defect")).filter("defect IS NOT NULL")


def rolling_failures(attempts: DataFrame, stream: str, order: str, failed: str, window: int = P.FAILURE_WINDOW, rate: float = P.FAILURE_RATE) -> DataFrame:
    """Failure rate over the last ``window`` attempts of each stream, and whether it is a reason to stop
    (only once the window is full)."""
    w = Window.partitionBy(stream).orderBy(order).rowsBetween(-(window - 1), 0)
    rows = attempts.withColumn("in_window", F.count(F.lit(1)).over(w)).withColumn("failure_rate", F.avg(F.col(failed).cast("double")).over(w))
    return rows.withColumn("stop", (F.col("in_window") == window) & (F.col("failure_rate") > rate))


def running_failures(attempts: DataFrame, stream: str, order: str, failed: str, least: int = P.CRAWL_MIN_ATTEMPTS, rate: float = P.CRAWL_FAILURE_RATE) -> DataFrame:
    """Cumulative rate of each stream, judged from ``least`` attempts on."""
    w = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = attempts.withColumn("attempt", F.count(F.lit(1)).over(w)).withColumn("failure_rate", F.avg(F.col(failed).cast("double")).over(w))
    return rows.withColumn("stop", (F.col("attempt") >= least) & (F.col("failure_rate") > rate))


def refusal_runs(attempts: DataFrame, stream: str, order: str, status: str, most: int = 3) -> DataFrame:
    """Refusals (403) since the last success; other failures neither count nor end a run. ``stop`` from
    ``most`` on, once there was a success, and at any 429."""
    w = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col(status).between(200, 299)
    rows = attempts.withColumn("_island", F.sum(F.when(ok, 1).otherwise(0)).over(w))
    inside = Window.partitionBy(stream, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("refusals", F.sum(F.when(F.col(status) == 403, 1).otherwise(0)).over(inside))
    stop = (F.col(status) == 429) | ((F.col(status) == 403) & (F.col("_island") > 0) & (F.col("refusals") >= most))
    return rows.withColumn("stop", stop).drop("_island")


def unreachable(attempts: DataFrame, stream: str, order: str, failed: str, most: int = P.UNREACHABLE) -> DataFrame:
    """(stream, restart_at, stop_at): every ``most`` failures in a row ask for a restart, which starts the
    count anew; the second such point is where the stream stops."""
    w = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = attempts.withColumn("_island", F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w))
    inside = Window.partitionBy(stream, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum(F.col(failed).cast("int")).over(inside)).filter(F.col(failed) & (F.col("_run") % most == 0))
    points = rows.withColumn("_k", F.row_number().over(Window.partitionBy(stream).orderBy(order))).filter("_k <= 2")
    return points.groupBy(stream).agg(F.min(order).alias("restart_at"), F.max(F.when(F.col("_k") == 2, F.col(order))).alias("stop_at"))


def count_in_range(rows: DataFrame, least: int, most: int) -> DataFrame:
    """One row: n, and whether it is within the range."""
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("in_range", F.col("n").between(least, most))


def first_stop(rows: DataFrame, stream: str, order: str) -> DataFrame:
    """Where each stream stops, if it does."""
    return rows.filter("stop").groupBy(stream).agg(F.min(order).alias("stop_at"))


def mode_accuracy(results: DataFrame) -> DataFrame:
    """One row from (expected, mode, n_failures, latency): hits, contract failures, latencies."""
    return results.agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("mode") == F.col("expected")).cast("int")).alias("right_mode"),
        F.sum((F.col("n_failures") > 0).cast("int")).alias("broken_contracts"), F.round(F.avg("latency"), 6).alias("mean_latency"), F.max("latency").alias("max_latency"),
    )


def compare_models(runs: DataFrame, models: list[str]) -> DataFrame:
    """A row for each question and a latency column for each model."""
    return runs.groupBy("question").pivot("model", models).agg(F.round(F.avg("latency"), 6))

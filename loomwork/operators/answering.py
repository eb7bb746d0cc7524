"""From a pool of hits and a model's replies to an answer: which evidence is read, and what is shown.

Replies of models (an order of passages, an answer, a second try, a class of question) are input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from . import ranking


def top_scores(pool: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, top): best score of each query's pool, 0 where the pool is empty."""
    best = pool.groupBy("query_id").agg(F.max("score").alias("top"))
    return queries.select("query_id").distinct().join(best, "query_id", "left").select("query_id", F.coalesce("top", F.lit(0.0)).alias("top"))


def read_first(pool: DataFrame, replies: DataFrame, dated: DataFrame | None = None, pool_size: int = P.RERANK_POOL, keep: int = P.RERANK_KEEP, k: int = P.TOP_K) -> DataFrame:
    """The ``k`` hits to read: of the first ``pool_size`` at most some a source, the first ``keep`` of
    these in the order of a reply (query_id, reply), cut to ``k``; for the queries of ``dated`` (query_id)
    current sources then come first. ``pool`` has query_id, pos, source_url, source_date."""
    few = ranking.cap_per_source(pool.filter(F.col("pos") <= pool_size)).filter(F.col("pos") <= keep)
    read = ranking.permute(few, replies).filter(F.col("pos") <= k)
    if dated is None:
        return read
    named = dated.select("query_id").distinct().withColumn("_dated", F.lit(True))
    marked = read.join(named, "query_id", "left")  # one row a query
    recent = ranking.prefer_recent(marked.filter("_dated"))
    return recent.unionByName(marked.filter("_dated IS NULL")).drop("_dated")


def cited(kept: Column, citations: Column) -> Column:
    """The kept sources that are cited, or all of them where none is."""
    named = F.filter(kept, lambda h: F.array_contains(citations, h["source_url"]))
    return F.when(F.size(named) > 0, named).otherwise(kept)


def second_try(answered: Column, body: Column, citations: Column, retry: Column, urls: Column) -> Column:
    """A reply that is a header only is asked for again without the format: struct of answered, body,
    citations, which then are all sources. What stays empty isn't an answer."""
    empty = F.trim(F.coalesce(body, F.lit(""))) == ""
    again = answered & empty
    text = F.when(again, F.trim(F.coalesce(retry, F.lit("")))).otherwise(F.coalesce(body, F.lit("")))
    links = F.when(again, F.filter(urls, lambda u: u.isNotNull() & (u != ""))).otherwise(citations)
    return F.struct((answered & (F.trim(text) != "")).alias("answered"), text.alias("body"), links.alias("citations"))


def decided(n_hits: Column, top: Column, reply: Column, supported: Column, unsupported: Column, kind: Column, general: Column, provenance: Column, flag: str, refusal: str, contacts: str) -> Column:
    """What is shown: struct of mode, text, citations. ``reply``: struct of ``second_try``.

    GROUNDED: hits above the floor, an answer, support over the gate and no unsupported claim; its text
    ends with the provenance line. Else GENERAL for a generic question: flag and the model's own text,
    without citations. Else REFUSE: what the model said in place of an answer, if it makes no unsupported
    claim, or the standard refusal; then whom to ask."""
    close = (n_hits > 0) & (top >= P.RELEVANCE_FLOOR)
    grounded = close & reply["answered"] & (supported >= P.SUPPORT_GATE) & (unsupported == 0)
    said = F.when(close & (unsupported == 0), reply["body"]).otherwise(F.lit(""))
    none = F.array().cast("array<string>")
    as_struct = lambda mode, text, links: F.struct(F.lit(mode).alias("mode"), text.alias("text"), links.alias("citations"))
    return (
        F.when(grounded, as_struct("GROUNDED", F.concat(reply["body"], F.coalesce(provenance, F.lit(""))), reply["citations"]))
        .when(kind == "GENERIC", as_struct("GENERAL", F.concat(F.lit(flag + "\n\n"), F.coalesce(general, F.lit(""))), none))
        .otherwise(as_struct("REFUSE", F.concat(F.when(said != "", said).otherwise(F.lit(refusal)), F.lit("\n\n" + contacts)), none))
    )

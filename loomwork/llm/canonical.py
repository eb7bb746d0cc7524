"""Problem 1: records that are the same but for formatting.

``canonical_text``/``canonical_url`` fold letter case, decode percent escapes, drop everything but
letters and digits and sort URL parameters, all as JVM expressions. ``keyed`` hashes the result to
128 bits, ``groups`` counts copies with map-side combining and checks every group with an
independent 64-bit hash: groups whose check values differ are keyed again by the whole canonical
text, so no two different records are ever merged.

Defined results: a record with a null key field is never a copy of another; empty or purely
punctuation fields are equal to each other; repeated ids are copies like any other row; an empty
table gives an empty result; other columns are not looked at and names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.physical import join_small, materialize, skew_join

_STRAY_PERCENT = "%(?![0-9A-Fa-f]{2})"
_NEITHER = r"[^\p{L}\p{Nd}]+"


def decoded(c: Column) -> Column:
    """Percent escapes replaced by the characters they stand for (UTF-8)."""
    plus = F.regexp_replace(F.regexp_replace(c, _STRAY_PERCENT, "%25"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(plus), c)


def canonical_text(c: Column) -> Column:
    """Letters and digits only, in lower case; accents stay."""
    return F.regexp_replace(F.lower(decoded(c)), _NEITHER, "")


def canonical_url(c: Column) -> Column:
    """As ``canonical_text``, with the parameters after the first ``?`` in sorted order."""
    text = F.lower(decoded(c))
    at = F.instr(text, "?")
    head = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    tail = F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(F.lit(""))
    params = F.array_sort(F.transform(F.split(tail, "&"), lambda p: F.regexp_replace(p, _NEITHER, "")))
    return F.concat(F.regexp_replace(head, _NEITHER, ""), F.array_join(params, ""))


def page_key(url: str = "url", slug: str = "slug") -> Column:
    """One string that is equal for two manifest entries just if they are copies."""
    return F.concat_ws("\x00", canonical_url(F.col(url)), canonical_text(F.col(slug)))


def digest(c: Column) -> Column:
    """128 bits of a string."""
    return F.unhex(F.md5(c))


def keyed(df: DataFrame, row_id: str, fields: list[str], canon: Column, hash_128=digest) -> DataFrame:
    """(_id, _h, _c) of all rows without a null in ``fields``: id, 128-bit key, check value.
    Materialized: 32 bytes a row, so that later passes read no text."""
    there = F.lit(True)
    for f in fields:
        there = there & F.col(f).isNotNull()
    rows = df.filter(there).select(F.col(row_id).alias("_id"), canon.alias("_text"))
    pairs = materialize(rows.select("_id", hash_128(F.col("_text")).alias("_h"), F.xxhash64("_text").alias("_c")))
    bad = pairs.groupBy("_h").agg(F.min("_c").alias("lo"), F.max("_c").alias("hi")).filter("lo <> hi").select("_h")
    bad = materialize(bad)
    if bad.limit(1).count() == 0:
        return pairs
    full = rows.withColumn("_h", hash_128(F.col("_text")))
    again = join_small(full, bad, ["_h"], "left_semi").withColumn("_h", F.encode(F.concat(F.lit("text:"), "_text"), "UTF-8"))
    good = join_small(pairs, bad, ["_h"], "left_anti")
    return materialize(good.unionByName(again.select("_id", "_h", F.xxhash64("_text").alias("_c"))))


def groups(pairs: DataFrame) -> DataFrame:
    """(_h, n_copies, keep_id) of every key, counted with partial aggregation before the shuffle."""
    return pairs.groupBy("_h").agg(F.count(F.lit(1)).alias("n_copies"), F.min("_id").alias("keep_id"))


def copies(df: DataFrame, row_id: str, fields: list[str], canon: Column, hash_128=digest) -> DataFrame:
    """(keep_id, copy_id): one row for each record that repeats an earlier one. A hot group is
    joined by broadcast of its single (key, keep_id) row, so it stays spread over all tasks."""
    pairs = keyed(df, row_id, fields, canon, hash_128)
    many = materialize(groups(pairs).filter("n_copies > 1"))
    found = skew_join(pairs, many, "_h", "n_copies", pairs.count())
    return found.filter("_id <> keep_id").select("keep_id", F.col("_id").alias("copy_id"))


def collapse(df: DataFrame, row_id: str, fields: list[str], canon: Column, hash_128=digest) -> DataFrame:
    """The records that stay, one of each group (the smallest id), with ``n_copies``. Records with a
    null key field stay with n_copies 1. ``row_id`` must be unique for this form."""
    pairs = keyed(df, row_id, fields, canon, hash_128)
    kept = groups(pairs).select(F.col("keep_id").alias(row_id), "n_copies")
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.col(f).isNull()
    alone = df.filter(missing).withColumn("n_copies", F.lit(1).cast("bigint"))
    return df.filter(~missing).drop("n_copies").join(kept, row_id).select(alone.columns).unionByName(alone)


def manifest_copies(manifest: DataFrame) -> DataFrame:
    """``copies`` of a crawl manifest."""
    return copies(manifest, "row_id", ["url", "slug"], page_key())


def manifest_collapsed(manifest: DataFrame) -> DataFrame:
    """``collapse`` of a crawl manifest."""
    return collapse(manifest, "row_id", ["url", "slug"], page_key())

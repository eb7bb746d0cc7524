"""Problem 4: lines that come back in the documents of one source.

Pass 1 reads each text once and builds mergeable heavy-hitter summaries (Misra-Gries) of line keys
for each source, with the weight that was subtracted as their error bound. Summaries merge by
addition, so they are written per batch of rows, summed with map-side combining, and every key that
can reach the threshold becomes a candidate. Where the bound is too weak for a source (its error
reaches the threshold), pass 2 takes every line of that source. Pass 2 counts the candidates
exactly, in the documents that hold them; confirmed lines are removed.

A line key: trimmed, runs of whitespace as one blank, lower case, runs of digits 0-9 as one; only
lines with a letter count. A line is repeated if it is in at least ``least`` documents and in at
least ``share`` of all documents of its source.

Defined results: rows with null text or source never have cases (null text counts as a document);
empty texts have no lines; every occurrence in a document is a case, but a document counts once;
rows are taken as documents even if ids repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.physical import BROADCAST_ROWS, materialize, skew_join

_DIGITS = re.compile("[0-9]+")
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Repeats:
    """``counters``: entries of a summary; ``flush``: entries held by a task before it writes its
    summaries out (they merge later, so this bounds memory and changes no result)."""

    least: int = 5
    share: float = 0.25
    counters: int = 128
    flush: int = 300_000


def line_key(line: str) -> int | None:
    """64-bit key (signed) of a line, None for lines without a letter."""
    if not _LETTER.search(line):
        return None
    key = xxhash.xxh3_64_intdigest(_DIGITS.sub("0", " ".join(line.split()).lower()))
    return key - (1 << 64) if key >> 63 else key


def shrink(counts: dict[int, int], size: int) -> int:
    """Misra-Gries step: subtract so much that at most ``size`` keys stay; gives what was subtracted."""
    if len(counts) <= size:
        return 0
    take = sorted(counts.values(), reverse=True)[size]
    for k in [k for k, n in counts.items() if n <= take]:
        del counts[k]
    for k in counts:
        counts[k] -= take
    return take


_SUMMARY = "source string, documents bigint, error bigint, key bigint, n bigint"


def _summaries(rule: Repeats):
    schema = pa.schema([("source", pa.string()), ("documents", pa.int64()), ("error", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])

    def emit(held):
        cols: list[list] = [[], [], [], [], []]
        for source, (documents, error, counts) in held.items():
            rows = [(source, documents, error, None, None)] + [(source, 0, 0, k, n) for k, n in counts.items()]
            for c, values in zip(cols, zip(*rows)):
                c.extend(values)
        for at in range(0, len(cols[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000], t) for c, t in zip(cols, schema.types)], schema=schema)

    def run(batches):
        held: dict[str, list] = {}
        entries = 0
        for b in batches:
            for source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = held.get(source)
                if own is None:
                    own = held[source] = [0, 0, Counter()]
                    entries += 1
                own[0] += 1
                if not text:
                    continue
                counts = own[2]
                before = len(counts)
                counts.update({k for k in map(line_key, text.split("\n")) if k is not None})
                if len(counts) > 2 * rule.counters:
                    own[1] += shrink(counts, rule.counters)
                entries += len(counts) - before
            if entries > rule.flush:
                yield from emit(held)
                held, entries = {}, 0
        yield from emit(held)

    return run


def candidates(docs: DataFrame, rule: Repeats = Repeats()) -> tuple[DataFrame, DataFrame]:
    """((source, key) that may be repeated, with null key for sources to be counted whole;
    (source, documents)). ``docs`` has source and text."""
    parts = materialize(docs.select("source", "text").mapInArrow(_summaries(rule), _SUMMARY))
    sources = parts.groupBy("source").agg(F.sum("documents").alias("documents"), F.sum("error").alias("error"))
    sources = materialize(sources.filter(F.col("documents") >= rule.least).withColumn("need", F.greatest(F.lit(rule.least), F.ceil(F.col("documents") * rule.share))))
    merged = parts.filter("key IS NOT NULL").groupBy("source", "key").agg(F.sum("n").alias("n"))
    may = merged.join(sources, "source").filter(F.col("error") < F.col("need")).filter(F.col("n") + F.col("error") >= F.col("need")).select("source", "key")
    whole = sources.filter(F.col("error") >= F.col("need")).select("source", F.lit(None).cast("bigint").alias("key"))
    return materialize(may.unionByName(whole)), sources


_LINES = "id string, source string, key bigint, line_no int, first int"


def _matches(wanted):
    """Lines of the documents that are candidates: with a broadcast set of (source hash ^ key), or all
    lines where ``wanted`` is None."""
    schema = pa.schema([("id", pa.string()), ("source", pa.string()), ("key", pa.int64()), ("line_no", pa.int32()), ("first", pa.int32())])

    def run(batches):
        keys, all_of = (frozenset(wanted.value[0].tolist()), frozenset(wanted.value[1].tolist())) if wanted else (None, None)
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for id_, source, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if not text:
                    continue
                salt = xxhash.xxh3_64_intdigest(source)
                every = keys is None or salt in all_of
                seen = set()
                for no, line in enumerate(text.split("\n"), 1):
                    key = line_key(line)
                    if key is None or not (every or ((key ^ salt) & _M64) in keys):
                        continue
                    for c, v in zip(cols, (id_, source, key, no, int(key not in seen))):
                        c.append(v)
                    seen.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return run


_M64 = (1 << 64) - 1


def _wanted(spark, may: DataFrame, broadcast_rows: int):
    """A broadcast of (source hash ^ key) of candidates and the hashes of sources to be counted whole, or
    None if there are more than ``broadcast_rows`` (16 bytes a row)."""
    if may.limit(broadcast_rows + 1).count() > broadcast_rows:
        return None
    rows = may.collect()  # counted above
    mixed = np.array([(k ^ xxhash.xxh3_64_intdigest(s)) & _M64 for s, k in rows if k is not None], np.uint64)
    salts = np.array([xxhash.xxh3_64_intdigest(s) for s, k in rows if k is None], np.uint64)
    return spark.sparkContext.broadcast((mixed, salts))


def _confirmed(docs: DataFrame, rule: Repeats, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """(candidate lines; the confirmed ones of them: mark, s, k, n_lines). ``docs`` has id, source, text."""
    may, sources = candidates(docs, rule)
    wanted = _wanted(docs.sparkSession, may, broadcast_rows)
    lines = docs.select(F.col("id").cast("string"), "source", "text").mapInArrow(_matches(wanted), _LINES)
    if wanted is None:
        named = may.filter("key IS NOT NULL")
        every = may.filter("key IS NULL").select("source")
        lines = lines.join(every, "source", "left_semi").unionByName(lines.join(named, ["source", "key"], "left_semi"))
    lines = materialize(lines.withColumn("mark", F.xxhash64("source", "key")))
    counts = lines.groupBy("mark", "source", "key").agg(F.sum("first").alias("n"), F.count(F.lit(1)).alias("n_lines"))
    sure = counts.join(sources.select("source", "need"), "source").filter(F.col("n") >= F.col("need"))
    return lines, materialize(sure.select("mark", F.col("source").alias("s"), F.col("key").alias("k"), "n_lines"))


def repeated_lines(docs: DataFrame, rule: Repeats = Repeats(), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, source, line_no, key): every occurrence of a repeated line. ``docs`` has id, source, text.
    The candidate set is broadcast to the second pass if it was counted to be within
    ``broadcast_rows``; else the lines are joined to it by shuffle."""
    lines, sure = _confirmed(docs.filter("source IS NOT NULL"), rule, broadcast_rows)
    if sure.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hit = lines.join(F.broadcast(sure), "mark")
    else:
        hit = skew_join(lines, sure, "mark", "n_lines", lines.count())
    return hit.filter("source = s AND key = k").select("id", "source", "line_no", "key")


def chunk_lines(chunks: DataFrame, rule: Repeats = Repeats()) -> DataFrame:
    """(id, line_no) of the lines to be removed from ``chunks``."""
    return repeated_lines(chunks.select("id", F.col("source_url").alias("source"), "text"), rule).select("id", "line_no")


def _cleaned(wanted):
    """Texts without the lines of a broadcast set, or of the row's own ``keys`` where there is none."""

    def run(batches):
        sets = frozenset(wanted.value[0].tolist()) if wanted else None
        for b in batches:
            out, removed = [], []
            for i, (source, text) in enumerate(zip(b.column("_source").to_pylist(), b.column("_text").to_pylist())):
                own = (b.column("_keys")[i].as_py() or ()) if sets is None else None
                gone = 0
                if text and source is not None and (sets or own):
                    salt = xxhash.xxh3_64_intdigest(source)
                    kept = []
                    for line in text.split("\n"):
                        key = line_key(line)
                        if key is not None and (key in own if sets is None else ((key ^ salt) & _M64) in sets):
                            gone += 1
                        else:
                            kept.append(line)
                    text = "\n".join(kept)
                out.append(text)
                removed.append(gone)
            rest = [b.column(i) for i, f in enumerate(b.schema) if f.name not in ("_source", "_text", "_keys")]
            names = [f.name for f in b.schema if f.name not in ("_source", "_text", "_keys")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.string()), pa.array(removed, pa.int32())], names=[*names, "_text", "_removed"])

    return run


def without_repeats(chunks: DataFrame, rule: Repeats = Repeats(), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``chunks`` with the repeated lines taken out of ``text``; ``n_removed`` tells how many. Lines are
    removed row by row, by a broadcast set of the confirmed ones (counted to be within
    ``broadcast_rows``; beyond that each row gets the keys of its source by a join that parts hot ones),
    so no text is shuffled and ids need not be unique."""
    spark = chunks.sparkSession
    docs = chunks.select("id", F.col("source_url").alias("source"), "text").filter("source IS NOT NULL")
    _, sure = _confirmed(docs, rule, broadcast_rows)
    sure = sure.select(F.col("s").alias("source"), F.col("k").alias("key"))
    names = [c for c in chunks.columns if c not in ("text", "n_removed")]
    wanted = _wanted(spark, sure, broadcast_rows)
    rows = chunks.select(*names, F.col("source_url").alias("_source"), F.col("text").alias("_text"))
    if wanted is None:
        own = sure.groupBy("source").agg(F.collect_list("key").alias("_keys"))  # at most 1 / share * lines a document
        sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
        keyed = materialize(own.join(sizes, "source").withColumnRenamed("source", "_source"))
        rows = skew_join(rows, keyed, "_source", "_n", chunks.count(), "left").drop("_n")
    else:
        rows = rows.withColumn("_keys", F.lit(None).cast("array<bigint>"))
    fields = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in names), "_text string", "_removed int"])
    clean = rows.select(*names, "_source", "_text", "_keys").mapInArrow(_cleaned(wanted), schema)
    return clean.select(*[F.col("_text").alias(c) if c == "text" else F.col(c) for c in chunks.columns if c != "n_removed"], F.col("_removed").alias("n_removed"))

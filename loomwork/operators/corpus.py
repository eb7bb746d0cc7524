"""Building and auditing a corpus: filters with reasons, repeated lines, coverage, link graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..plans.physical import BROADCAST_ROWS, materialize


def reject_reasons(pages: DataFrame, url: str = "url", text: str = "text", doc_type: str | None = None) -> DataFrame:
    """``pages`` with reject_reason (null: kept) in one scan: junk URL, then too few words."""
    n = F.coalesce(T.words(F.col(text)), F.lit(0))
    least = F.lit(P.MIN_PAGE_WORDS)
    if doc_type:
        least = F.when(F.col(doc_type) == "pdf", P.MIN_DOCUMENT_WORDS).otherwise(P.MIN_PAGE_WORDS)
    return pages.withColumn("n_words", n).withColumn("reject_reason", F.when(T.is_junk_url(F.col(url)), "theme demo").when(n < least, "too thin"))


def html_only(responses: DataFrame, content_type: str = "content_type") -> DataFrame:
    """Responses that are pages; a missing content type isn't one."""
    return responses.filter(F.contains(F.lower(F.col(content_type)), F.lit("text/html")))


def union_in_order(lists: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value) over several lists (key, value, pos): a key that is in more than one belongs to the
    first list that has it, at its first place there."""
    rows = None
    for k, part in enumerate(lists):
        part = part.select(key, F.struct(F.lit(k).alias("list"), "pos").alias("_at"), value)
        rows = part if rows is None else rows.unionByName(part)
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, "_at").alias(value))


def table_totals(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row: lines of tables, and pages that have any."""
    n = T.table_lines(F.col(text))
    return pages.agg(F.coalesce(F.sum(n), F.lit(0)).alias("table_rows"), F.count_if(n > 0).alias("pages_with_tables"))


def page_lines(pages: DataFrame, page: str, text: str) -> DataFrame:
    """(page, line) of the trimmed non-blank lines, repeats included."""
    edge = f"^{P.SPACE}+|{P.SPACE}+$"
    return pages.select(F.col(page).alias("page"), F.explode(F.transform(T.lines(F.col(text)), lambda x: F.regexp_replace(x, edge, ""))).alias("line")).filter("line <> ''")


def common_lines(pages: DataFrame, page: str, text: str, share: float) -> DataFrame:
    """(line, n_pages) of the lines on at least a share of the pages with text. Distinct pairs are
    formed within each row's array, so the only shuffle is of partial counts."""
    edge = f"^{P.SPACE}+|{P.SPACE}+$"
    own = F.array_distinct(F.filter(F.transform(T.lines(F.col(text)), lambda x: F.regexp_replace(x, edge, "")), lambda x: x != ""))
    n = pages.filter(F.col(text).isNotNull()).count()
    counts = pages.select(F.explode(own).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n_pages"))
    return counts.filter(F.col("n_pages") >= F.lit(share) * n)


def boilerplate_pages(pages: DataFrame, page: str, text: str, line_share: float = 0.3, page_share: float = 0.9) -> DataFrame:
    """(page, share) of pages that are common lines for the most part; pages without lines never are."""
    common = materialize(common_lines(pages, page, text, line_share).select("line"))
    # at most (lines a page) / line_share lines can be common; still counted before it is broadcast
    side = F.broadcast(common) if common.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else common
    marked = page_lines(pages, page, text).join(side.withColumn("_is", F.lit(1)), "line", "left")
    return marked.groupBy("page").agg((F.count("_is") / F.count(F.lit(1))).alias("share")).filter(F.col("share") >= page_share)


def resume(targets: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Targets that aren't done."""
    return targets.join(done.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def coverage(targets: DataFrame, corpus: DataFrame, thin: DataFrame, failed: DataFrame) -> DataFrame:
    """Targets that aren't in the corpus, with the cause: thin before failed before unexplained."""
    missing = resume(targets, corpus)
    t = thin.groupBy("url").agg(F.max(F.lit(1)).alias("_thin"))
    f = failed.groupBy("url").agg(F.max(F.lit(1)).alias("_failed"))
    bucket = F.when(F.col("_thin").isNotNull() & T.is_junk_url(F.col("url")), "thin: theme demo page").when(F.col("_thin").isNotNull(), "thin: real page").when(F.col("_failed").isNotNull(), "fetch failed").otherwise("unexplained")
    return missing.join(t, "url", "left").join(f, "url", "left").select(*targets.columns, bucket.alias("bucket"))


def reachable(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(url, depth) of what can be reached in up to ``depth`` steps: one join and one anti-join a step,
    each step's frontier in the shared folder."""
    e = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    frontier = materialize(seeds.select("url").filter("url IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for k in range(1, depth + 1):
        step = frontier.join(e, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        frontier = materialize(step.join(seen, "url", "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(frontier)
    return seen


def allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``allowed`` by the longest matching path prefix of ``rules`` (prefix, allow), a
    small table of one host's rules; without a match a URL is allowed. Prefix lengths are folded into
    one array expression, so no join multiplies rows."""
    if rules.limit(10_001).count() > 10_000:
        raise ValueError("rules of one host are expected, at most 10,000")
    table = rules.select(F.struct(F.length("prefix").alias("n"), F.col("allow").cast("int").alias("a"), "prefix").alias("r")).agg(F.sort_array(F.collect_list("r"), asc=False).alias("rs"))
    path = F.when(T.url_path(F.col(url)) == "", "/").otherwise(T.url_path(F.col(url)))
    rows = urls.join(F.broadcast(table), F.lit(True))  # one row
    first = F.filter("rs", lambda r: path.startswith(r["prefix"]))
    return rows.withColumn("allowed", F.coalesce(F.get(first, F.lit(0))["a"] == 1, F.lit(True))).drop("rs")


def missing_in_source(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks whose first twelve words don't stand in their source text (joined by source_file)."""
    probe = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(P.NOT_SPACE + "+"), F.lit(0)), 1, 12), " ")
    both = chunks.select("id", "source_file", probe.alias("probe")).join(sources.select("source_file", T.even_space(F.col("source_text")).alias("source_text")), "source_file", "left")
    return both.filter(~F.coalesce(F.contains("source_text", F.col("probe")), F.lit(False))).select("id", F.col("source_text").isNull().alias("no_source"))

"""Queries of this subpackage and, where SQL can say the same, the SQL to compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate, canonical, mixing, neighbours, packing, repeated, residue, spam, splitting


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark, d):
    return canonical.manifest_copies(_t(spark, d, "manifest"))


def p1_collapsed(spark, d):
    return canonical.manifest_collapsed(_t(spark, d, "manifest")).select("row_id", "url", "slug", "n_copies")


def p2_found(spark, d):
    return boilerplate.corpus_furniture(_t(spark, d, "corpus_text"), _t(spark, d, "manifest"))


def p2_bodies(spark, d):
    return boilerplate.bodies(_t(spark, d, "corpus_text"), _t(spark, d, "manifest"))


def p3_found(spark, d):
    return neighbours.chunk_pairs(_t(spark, d, "chunk_vectors"))


def p3_similar(spark, d):
    """The ten nearest of every vector, however far."""
    return neighbours.similar(_t(spark, d, "chunk_vectors"), "id", "embedding", 64, 10)


def p4_found(spark, d):
    return repeated.chunk_lines(_t(spark, d, "chunks"))


def p4_cleaned(spark, d):
    return repeated.without_repeats(_t(spark, d, "chunks")).select("id", "text", "n_removed")


def p5_found(spark, d):
    return residue.bad_entries(_t(spark, d, "manifest"))


def p5_clean(spark, d):
    return residue.without_residue(_t(spark, d, "manifest"))


def p6_found(spark, d):
    return splitting.oversized(_t(spark, d, "chunks"))


def p6_pieces(spark, d):
    return splitting.split_chunks(_t(spark, d, "chunks")).select("id", "source_url", "chunk_index", "n_chunks", "piece", "n_pieces", "piece_start", "piece_end", "text")


def p7_contexts(spark, d):
    return packing.pack(_t(spark, d, "documents"))


def p7_report(spark, d):
    return packing.report(p7_contexts(spark, d))


def p8_mix(spark, d):
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets")).rows


def p8_shares(spark, d):
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets")).shares


def p9_found(spark, d):
    return spam.spam_pages(_t(spark, d, "documents"))


_P1_KEYS = r"""
WITH raw AS (
  SELECT row_id, url, slug,
    lower(url_decode(regexp_replace(url, '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f])', '%25\1', 'g'))) AS u,
    lower(url_decode(slug)) AS s
  FROM manifest WHERE url IS NOT NULL AND slug IS NOT NULL),
keys AS (
  SELECT row_id, url, slug,
    regexp_replace(split_part(u, '?', 1), '[^\p{L}\p{Nd}]+', '', 'g') ||
    CASE WHEN contains(u, '?') THEN array_to_string(list_sort(list_transform(
      string_split(substr(u, strpos(u, '?') + 1), '&'),
      lambda p: regexp_replace(p, '[^\p{L}\p{Nd}]+', '', 'g'))), '') ELSE '' END AS uk,
    regexp_replace(s, '[^\p{L}\p{Nd}]+', '', 'g') AS sk
  FROM raw),
groups AS (SELECT uk, sk, min(row_id) AS keep_id, count(*) AS n_copies FROM keys GROUP BY uk, sk)
"""

_P4_LINES = r"""
WITH lines AS (
  SELECT id, source_url, i AS line_no, lower(trim(regexp_replace(regexp_replace(x, '[\s\x1c-\x1f\x0b\x85\p{Z}]+', ' ', 'g'), '[0-9]+', '0', 'g'))) AS line
  FROM (SELECT id, source_url, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM chunks WHERE source_url IS NOT NULL)),
docs AS (SELECT source_url, count(*) AS n_docs FROM chunks GROUP BY source_url),
often AS (SELECT source_url, line FROM lines JOIN docs USING (source_url)
  WHERE regexp_matches(line, '\p{L}')
  GROUP BY source_url, line, n_docs HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) * 4 >= n_docs)
"""

_P6_SIZES = r"""
WITH lines AS (
  SELECT id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS ls,
    len(regexp_extract_all(text, '[^\s\x1c-\x1f\x0b\x85\p{Z}]+')) AS words FROM chunks WHERE text IS NOT NULL),
sized AS (
  SELECT id, greatest(words * 133 // 100, length(text) // 3) + 1 AS size, len(ls) AS n,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[|]'))) AS pipes FROM lines)
"""

QUERIES = {"p1_found": p1_found, "p1_collapsed": p1_collapsed, "p2_found": p2_found, "p2_bodies": p2_bodies, "p3_found": p3_found, "p3_similar": p3_similar, "p4_found": p4_found, "p4_cleaned": p4_cleaned, "p5_found": p5_found, "p5_clean": p5_clean, "p6_found": p6_found, "p6_pieces": p6_pieces, "p7_contexts": p7_contexts, "p7_report": p7_report, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found}
SQL = {
    "p4_found": _P4_LINES + "SELECT id, line_no::INT AS line_no FROM lines JOIN often USING (source_url, line)",
    "p4_cleaned": _P4_LINES + """, gone AS (SELECT id, list(line_no) AS g FROM lines JOIN often USING (source_url, line) GROUP BY id)
SELECT id, CASE WHEN g IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(g, i)), chr(10)) END AS text,
  coalesce(len(g), 0)::INT AS n_removed FROM chunks LEFT JOIN gone USING (id)""",
    "p6_found": _P6_SIZES + "SELECT id FROM sized WHERE size > CASE WHEN n >= 2 AND pipes >= 2 AND pipes * 10 >= 6 * n THEN 1800 ELSE 512 END",
    "p1_found": _P1_KEYS + "SELECT keep_id, row_id AS copy_id FROM keys JOIN groups USING (uk, sk) WHERE row_id <> keep_id",
    "p1_collapsed": _P1_KEYS + "SELECT row_id, url, slug, n_copies FROM keys JOIN groups USING (uk, sk) WHERE row_id = keep_id",
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)

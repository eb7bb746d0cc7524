"""Operators that SQL can't say, against plain Python over whole small tables or fixtures."""

import re

from pyspark.sql import functions as F
from sqlcheck import DATA

from loomwork import queries as Q
from loomwork.functions import patterns as P
from loomwork.operators import answering, guards


def texts(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(*columns).collect()]


def size(t):
    return max(int(len(t.split()) * 1.33), int(len(t) / 3.0)) + 1


def test_figures(spark):
    figure = re.compile(P.FIGURE, re.ASCII)
    want = {i: len(figure.findall(t)) for i, t in texts(spark, "documents", "doc_id", "text") if t is not None}
    got = {r.doc_id: r.n_figures for r in Q.QUERIES["figures"](spark, DATA).collect()}
    assert got == want and sum(want.values()) > 0
    rows = spark.createDataFrame([("a 12,345 b 1234 c 123 d 1.2345 e x1234 f 12,345,678x g 2021.", 0)], "text string, i int")
    from loomwork.functions import text as T

    assert rows.select(T.figures(F.col("text")).alias("f")).first().f == figure.findall("a 12,345 b 1234 c 123 d 1.2345 e x1234 f 12,345,678x g 2021.")


def test_names_without_support(spark):
    name = re.compile(P.TITLED_NAME, re.ASCII)
    docs = {i: t for i, t in texts(spark, "documents", "doc_id", "text") if t is not None}
    want = {}
    for i, t in docs.items():
        if i + 1 not in docs:
            continue
        known, bad = re.sub(r"\s+", " ", docs[i + 1], flags=re.ASCII).lower(), []
        for n in name.findall(t):
            parts = [p for p in re.split(r"\s+", n, flags=re.ASCII) if len(p) > 2 and p.lower().strip(".") not in P.NAME_NOISE]
            if parts and not re.search(rf"\b{re.escape(parts[-1].lower().strip('.,'))}\b", known, re.ASCII):
                bad.append(n)
        want[i] = bad
    got = {r.doc_id: list(r.names) for r in Q.QUERIES["unsupported_names"](spark, DATA).collect()}
    assert got == want and any(want.values())


def test_ended_terms(spark):
    rows = [(1, "Dean Anna, 2001-2004."), (2, "Report of 2001-2004."), (3, "head of the lab, 2019 to March 2024"), (4, "Director 2020 until 2090"), (5, None), (6, ""), (7, "x" * 130 + "2001-2002 " + "y" * 50 + " dean")]
    df = spark.createDataFrame(rows, "i int, t string").select("i", guards.ended_terms("t", F.lit(2026)).alias("e"))
    assert {r.i: r.e for r in df.collect()} == {1: ["2001-2004"], 2: [], 3: ["2019-2024"], 4: [], 5: [], 6: [], 7: []}
    span = re.compile(P.PAST_TERM)
    want = {}
    for i, t in texts(spark, "documents", "doc_id", "text"):
        near = lambda m, t=t: t[max(0, m.start() - 120) : m.end() + 40].lower()
        found = [f"{m[1]}-{m[2]}" for m in span.finditer(t or "") if int(m[2]) < Q.YEAR and any(w in near(m) for w in P.ROLE_WORDS)]
        if found:
            want[i] = found
    assert {r.doc_id: list(r.ended) for r in Q.QUERIES["ended_terms"](spark, DATA).collect()} == want


def test_document_chunks(spark):
    docs = dict(texts(spark, "documents", "doc_id", "text"))
    chunks = {}
    for r in Q.QUERIES["document_chunks"](spark, DATA).collect():
        chunks.setdefault(r.doc_id, []).append((r.chunk_index, r.text))
    assert set(chunks) == {i for i, t in docs.items() if t and t.strip()}
    for i, parts in chunks.items():
        parts = [t for _, t in sorted(parts)]
        assert all(t.strip() for t in parts)
        assert all(len(t.split()) <= 384 or size(t) <= P.TABLE_TOKENS for t in parts)
        whole, joined = docs[i].split(), " ".join(parts).split()
        if "|" not in docs[i]:  # every word comes, in order; what overlaps comes again
            at = 0
            for w in joined:
                at += at < len(whole) and w == whole[at]
            assert at == len(whole) or set(whole) <= set(joined)
        if size(docs[i]) <= P.TARGET_TOKENS and "|" not in docs[i]:
            assert len(parts) == 1 and parts[0].split() == whole


def test_chunk_records(spark):
    rows = Q.QUERIES["chunk_records"](spark, DATA).collect()
    of_page = {}
    for r in rows:
        assert r.id == f"{r.category}/{r.source_file.rsplit('/', 1)[-1].removesuffix('.txt')}#{r.chunk_index}" or r.id.endswith(f"#{r.chunk_index}")
        of_page.setdefault((r.id.rsplit("#", 1)[0], r.source_url), []).append(r)
    assert rows
    for parts in of_page.values():
        assert {r.n_chunks for r in parts} and all(0 <= r.chunk_index < r.n_chunks for r in parts)


def test_answers_of_all_modes(spark):
    c = F.col
    rows = [
        (1, 1, 0.9, True, "It is so.", None, 0.9, 0, "SPECIFIC"), (2, 1, 0.9, True, "", "Second.", 0.9, 0, "SPECIFIC"), (3, 1, 0.9, True, "", None, 1.0, 0, "GENERIC"), (4, 1, 0.9, False, "Only a former one.", None, 1.0, 0, "SPECIFIC"),
        (5, 1, 0.9, True, "Invented.", None, 1.0, 1, "SPECIFIC"), (6, 0, 0.0, True, "No hits.", None, 1.0, 0, "SPECIFIC"), (7, 1, 0.4, True, "Far off.", None, 1.0, 0, "GENERIC"), (8, 1, 0.9, True, None, " ", 1.0, 0, "SPECIFIC"), (9, 1, 0.9, True, "Weak.", None, 0.1, 0, "SPECIFIC"),
    ]
    df = spark.createDataFrame(rows, "i int, n int, top double, answered boolean, body string, retry string, support double, bad int, kind string")
    reply = answering.second_try(c("answered"), c("body"), F.array(F.lit("u1")), c("retry"), F.array(F.lit("u1"), F.lit("u2"), F.lit(None)))
    shown = answering.decided(c("n"), c("top"), reply, c("support"), c("bad"), c("kind"), F.lit("In general."), F.lit(" (2021)"), "[general]", "Nothing.", "Ask.")
    got = {r.i: (r.a.mode, r.a.text, list(r.a.citations)) for r in df.select("i", shown.alias("a")).collect()}
    refuse = lambda t: ("REFUSE", f"{t}\n\nAsk.", [])
    general = ("GENERAL", "[general]\n\nIn general.", [])
    assert got == {1: ("GROUNDED", "It is so. (2021)", ["u1"]), 2: ("GROUNDED", "Second. (2021)", ["u1", "u2"]), 3: general, 4: refuse("Only a former one."), 5: refuse("Nothing."), 6: refuse("Nothing."), 7: general, 8: refuse("Nothing."), 9: refuse("Weak.")}
    kept = F.array(*[F.struct(F.lit(u).alias("source_url"), F.lit(k).alias("k")) for k, u in enumerate(["u1", "u2", "u1"])])
    one = spark.range(1).select(answering.cited(kept, F.array(F.lit("u1"))).alias("a"), answering.cited(kept, F.array(F.lit("u9"))).alias("b")).first()
    assert [h.k for h in one.a] == [0, 2] and [h.k for h in one.b] == [0, 1, 2]


def test_figures_need_their_period(spark):
    table = "| Item | Fee per semester |\n|---|---|\n| Hostel | 45,000 |"
    rows = [(1, "It is 45,000.", [table]), (2, "It is 45,000 per semester.", [table]), (3, "It is 45,000.", ["A fee of 45,000 is paid once. Annual dues differ."]), (4, None, [table]), (5, "None.", None)]
    df = spark.createDataFrame(rows, "i int, body string, texts array<string>").select("i", guards.figure_without_period("body", "texts").alias("f"))
    assert {r.i: r.f for r in df.collect()} == {1: "45,000", 2: None, 3: None, 4: None, 5: None}
    c = F.col
    full = df.withColumn("body", F.lit("x")).select("i", guards.contract_failures(F.lit("GROUNDED"), F.lit("GROUNDED"), c("body"), F.array(F.lit("u")), F.array(F.lit("u")), "[g]", "s", ("office",), c("f")).alias("w"))
    assert {r.i: len(r.w) for r in full.collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0}

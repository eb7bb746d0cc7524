import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sqlcheck import DATA, compare

from loomwork.llm import boilerplate, canonical, cells, entry, hnsw, mixing, neighbours, packing, repeated, residue, spam, splitting, tokens


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_same_as_sql(spark, name):
    compare(spark, DATA, entry.QUERIES[name], entry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(entry.QUERIES) - set(entry.SQL)))
def test_runs(spark, name):
    df = entry.QUERIES[name](spark, DATA)
    got = df.collect()
    assert got and all(r[0] is not None for r in got)


# 1 -----------------------------------------------------------------------------------------------
M = "row_id bigint, url string, slug string, n_copies string"
PAGES = [
    (1, "https://a.example/X-y/?b=2&a=1", "x-y", "clash"), (2, "HTTPS://A.example/x%2Dy?a=1&b=2", "X Y", None), (3, "https://a.example/x-é/", "x-e", None),
    (4, "https://a.example/x-e/", "x-e", None), (5, None, "x", None), (6, None, "x", None), (7, "", "", None), (8, "%%", "--", None), (9, "https://a.example/%zz?", "q", None),
]


def test_copies(spark):
    df = spark.createDataFrame(PAGES, M)
    assert rows(canonical.manifest_copies(df)) == [(1, 2), (7, 8)]
    kept = {r.row_id: r.n_copies for r in canonical.manifest_collapsed(df).collect()}
    assert kept == {1: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2, 9: 1}
    assert canonical.manifest_copies(df.limit(0)).count() == 0


def test_hash_collisions_are_told_apart(spark):
    df = spark.createDataFrame([(i, f"u{i % 40}", "s") for i in range(200)], "row_id bigint, url string, slug string")
    weak = lambda c: F.unhex(F.hex(F.pmod(F.crc32(c), F.lit(3))))
    got = canonical.copies(df, "row_id", ["url", "slug"], canonical.page_key(), weak)
    assert rows(got) == sorted([(i % 40, i) for i in range(40, 200)], key=str)


def test_one_group_with_most_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, "https://hot/").otherwise(F.concat(F.lit("https://c/"), "id")).alias("url"), F.lit("s").alias("slug"))
    got = canonical.manifest_copies(df)
    assert got.count() == 1499 and {r.keep_id for r in got.collect()} == {0}


# 2 -----------------------------------------------------------------------------------------------
def site(n, seed=0):
    rnd = random.Random(seed)
    words = "river stone cloud paper window garden letter engine winter market".split()
    prose = lambda: " ".join(rnd.choice(words) for _ in range(14)).capitalize() + "."
    out = []
    for i in range(n):
        head = ["Home | News | Staff | Contact", "Skip to content"]
        side = ["Latest", f"» Bridges (Mar {i % 28 + 1})", f"» Bridges [PDF, {i + 100} KB]"]
        body = [" ".join(rnd.choice(words) for _ in range(3)).title(), prose(), prose(), "Offices involved:", "News", "Staff", prose()]
        foot = ["Subscribe to our letter", f"© {2000 + i % 20} The Site", "Contact"]
        lines = head + body[:2] + (side if i % 2 else []) + body[2:] + foot
        gone = [True] * 2 + [False] * 2 + ([True] * 3 if i % 2 else []) + [False] * 5 + [True] * 3
        out.append((i, f"https://h{i % 2}.example/p/{i}", "\n".join(lines), gone))
    return out


def test_body_and_furniture(spark):
    pages = site(120)
    df = spark.createDataFrame([(i, u, t) for i, u, t, _ in pages] + [(900, "https://h0.example/e", ""), (901, None, None)], "row_id bigint, url string, text string")
    got = {tuple(r) for r in boilerplate.furniture(df).collect()}
    want = {(i, k) for i, _, _, gone in pages for k, g in enumerate(gone, 1) if g}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert boilerplate.furniture(df.limit(0)).count() == 0
    joined = {tuple(r) for r in boilerplate.furniture(df, broadcast_rows=0).collect()}  # host keys joined, not broadcast
    assert joined == got


def test_regions_decide_what_goes(monkeypatch):
    lines = boilerplate.lines_of("Home\nNews\nOffice: Room 4\nA paragraph of some words that ends here.\nStaff\nOddly named\nContact")
    known = {boilerplate.key_of(boilerplate.key_text(t)): boilerplate.TEMPLATE for t in ("Home", "News", "Office: Room 4", "Staff", "Contact")}
    gone = boilerplate.decide(lines, lambda k: known.get(k, 0), boilerplate.Shares.sigma)
    assert gone.tolist() == [True, True, False, False, True, True, True]  # the unknown line goes with what stands around it
    monkeypatch.setattr(boilerplate, "regions", lambda r, sigma: np.ones(len(r), bool))
    assert not boilerplate.decide(lines, lambda k: known.get(k, 0), boilerplate.Shares.sigma).any()


def test_bodies_keep_their_columns(spark):
    pages = site(60)
    corpus = spark.createDataFrame([(i, "c", t, 1) for i, _, t, _ in pages] + [(901, None, None, 1)], "row_id bigint, category string, text string, line_no int")
    manifest = spark.createDataFrame([(i, u) for i, u, _, _ in pages], "row_id bigint, url string")
    got = boilerplate.bodies(corpus, manifest)
    assert got.columns == corpus.columns and got.count() == 61
    assert got.filter("row_id = 0").first().text.startswith(pages[0][2].split("\n")[2])


def test_html_regions():
    body = "".join(f"<p>{'A long paragraph of words that says something. ' * 4}</p>" for _ in range(6))
    html = "<ul>" + "<li><a href=x>Menu</a></li>" * 12 + f"</ul><script>var x = '<p>'</script>{body}<div>" + "<a href=y>Link</a> " * 5 + "</div>" + "<div><a>f</a></div>" * 5
    got = boilerplate.html_body(html)
    assert "A long paragraph" in got and "Menu" not in got and "var x" not in got
    assert boilerplate.html_body(None) is None and boilerplate.html_body("") == ""


# 3 -----------------------------------------------------------------------------------------------
def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32) + 2 * rng.normal(size=(8, dim)).astype(np.float32)[rng.integers(0, 8, n)]
    v[n // 2 : n // 2 + 40] = v[:40] + 0.02 * rng.normal(size=(40, dim)).astype(np.float32)
    return v


def brute(ids, v, k):
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {ids[i]: {ids[j] for j in np.argsort(-s[i], kind="stable")[:k]} for i in range(len(ids))}


def test_graph_recall():
    v = vectors(5000, 24)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = hnsw.build(v, top=256)
    assert len(hnsw.levels(g)) >= 2
    got, _ = hnsw.search(hnsw.assemble(v, hnsw.levels(g)), v[:300], 11, 32)
    want = brute(list(range(5000)), v, 10)
    assert np.mean([len(set(got[i]) - {i} & set(range(5000)) & want[i] | (set(got[i]) & want[i])) / 10 for i in range(300)]) > 0.9


def test_similar(spark):
    v = vectors(3000, 16)
    ids = [f"v{i:05d}" for i in range(3000)]
    data = [(i, x.tolist(), 1) for i, x in zip(ids, v)]
    data += [("null", None, 1), ("short", [1.0] * 3, 1), ("zero", [0.0] * 16, 1), ("nan", [float("nan")] * 16, 1), ("inf", [float("inf")] * 16, 1), (None, [1.0] * 16, 1), ("hole", [None] + [1.0] * 15, 1)]
    df = spark.createDataFrame(data, "id string, embedding array<float>, rank int")
    got = defaultdict(set)
    for r in neighbours.similar(df, "id", "embedding", 16, 10).collect():
        got[r.id].add(r.other)
    want = brute(ids, v, 10)
    assert set(got) == set(ids) and np.mean([len(got[i] & want[i]) / 10 for i in ids]) > 0.9
    assert neighbours.similar(df.limit(0), "id", "embedding", 16, 10).count() == 0


def test_widths_follow_the_size_of_shards():
    g = neighbours.Graphs()
    assert [g.fitted(n) == g for n in (0, 500, 79_000)] == [True] * 3
    big = g.fitted(10**8)
    assert g.shards(10**8) == 1000 and (big.m, big.ef_build, big.ef) == (28, 112, 76)
    assert g.fitted(160_000).ef > g.ef


def test_many_equal_vectors(spark):
    df = spark.range(900).select(F.format_string("x%04d", "id").alias("id"), F.when(F.col("id") % 3 == 0, F.array(*[F.lit(1.0)] * 4)).otherwise(F.array(F.col("id").cast("double"), F.lit(1.0), F.lit(2.0), F.lit(-1.0))).cast("array<float>").alias("v"))
    got = defaultdict(list)
    for r in neighbours.similar(df, "id", "v", 4, 5).orderBy("rank").collect():
        got[r.id].append((r.other, r.similarity))
    assert len(got) == 900 and all(len(x) == 5 for x in got.values())
    assert [o for o, s in got["x0300"]] == ["x0000", "x0003", "x0006", "x0009", "x0012"] and all(s > 0.999999 for o, s in got["x0300"])
    assert [o for o, s in got["x0000"]] == ["x0003", "x0006", "x0009", "x0012", "x0015"]


def near_vectors(n, d=16, seed=1):
    """Every third vector is near another, some of them exactly at the floor of 0.95 or just below."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(1, n, 3):
        z = v[i] - v[i] @ v[i - 1] * v[i - 1]
        s = (0.9495, 0.9505, 0.96, 0.99)[i % 4]
        v[i] = s * v[i - 1] + (1 - s * s) ** 0.5 * z / np.linalg.norm(z)
    return v.astype(np.float32)


def alike_by_force(ids, v, k, floor):
    v = v.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    return {a: [ids[j] for j in sorted(np.flatnonzero(s[i] >= floor), key=lambda j: (-round(s[i, j], 12), ids[j]))[:k]] for i, a in enumerate(ids) if s[i].max() >= floor}


@pytest.mark.parametrize("crowd", [0, 600])
def test_alike_in_blocks_of_shards(spark, crowd):
    v = near_vectors(3000)
    if crowd:  # a large part about one place, which is more than a shard may hold
        v[:crowd] = v[0] + np.random.default_rng(2).normal(scale=0.02, size=(crowd, 16)).astype(np.float32)
    ids = [f"v{i:05d}" for i in range(len(v))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "id string, vector array<float>").repartition(3)
    conf = cells.Cells(shard_rows=200, least_rows=300, cell_rows=16, pairs=1024, together=256, pack=64, least_round=200_000)
    got = {r.id: [x.id for x in r.found] for r in cells.alike(df, len(v), 16, 5, 0.95, conf).collect()}
    want = alike_by_force(ids, v, 5, 0.95)
    hits, found = sum(map(len, want.values())), sum(len(set(want[i]) & set(got.get(i, ()))) for i in want)
    assert found >= 0.995 * hits and hits > 1000 and all(len(x) <= 5 for x in got.values())
    far = {i: x for i, x in got.items() if i not in want}
    assert not far
    if crowd:
        assert all(got[i] == want[i] for i in ids[:crowd])


def test_strong_floor_looks_at_few_cells(spark, monkeypatch):
    """Before, each vector was searched for in every shard: work grew with the square of the table."""
    monkeypatch.setattr(neighbours, "build_index", None)
    v = near_vectors(2000)
    v[1000:1300] = v[:300]  # equal vectors are a class, of which one is compared
    ids = [f"v{i:05d}" for i in range(len(v))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "id string, v array<float>")
    got = defaultdict(list)
    for r in neighbours.similar(df, "id", "v", 16, 3, 0.95).orderBy("rank").collect():
        got[r.id].append(r.other)
    want = alike_by_force(ids, v, 3, 0.95)
    assert sum(len(set(want[i]) & set(got[i])) for i in want) >= 0.995 * sum(map(len, want.values())) and set(got) <= set(want)
    assert neighbours.similar(df.limit(0), "id", "v", 16, 3, 0.95).count() == 0

    def compared(n):
        x = cells.unit(np.random.default_rng(3).normal(size=(n, 64)))
        m = cells.plan(x, n, 0.95, 2, cells.Cells())
        size = np.bincount(cells._best_pivot(x, m.pivots), minlength=len(m.pivots))
        s = x[:2000] @ m.pivots.T
        return len(m.pivots) + ((s >= s.max(1, keepdims=True) - m.margin) @ size).mean()

    assert compared(64_000) < 2.7 * compared(16_000) and compared(64_000) < 0.1 * 64_000


def test_packed_vectors():
    v = cells.unit(np.array([[3.0, -4, 0], [1e-30, 0, 0], [-1, 1e-9, 1]], np.float32))
    assert np.array_equal(cells._unpacked(cells._packed(v), 3), v) and np.abs(v - [[0.6, -0.8, 0], [1, 0, 0], [-(0.5**0.5), 0, 0.5**0.5]]).max() < 2e-7


# 4 -----------------------------------------------------------------------------------------------
def brute_lines(docs, least=5, share=0.25):
    n, have = Counter(), defaultdict(set)
    key = lambda x: re.sub("[0-9]+", "0", " ".join(x.split()).lower())
    for k, (_, s, t) in enumerate(docs):
        if s is not None:
            n[s] += 1
            for x in (t or "").split("\n"):
                if any(c.isalpha() for c in x):
                    have[s, key(x)].add(k)
    return sorted([(i, no) for i, s, t in docs if s is not None for no, x in enumerate((t or "").split("\n"), 1) if len(have.get((s, key(x)), ())) >= max(least, share * n[s])], key=str)


def line_docs(seed, n=300):
    rnd = random.Random(seed)
    out = [("n1", None, "Share this"), ("n2", "s", None), ("n3", "s", "")]
    for i in range(n):
        s = rnd.choice(["s", "s", "hot", "hot", "hot", "rare", f"one{i}"])
        lines = [f"Line {rnd.randint(0, 400)} of {rnd.choice('abcdefgh') * rnd.randint(1, 9)}" for _ in range(rnd.randint(0, 9))] + ["  SHARE\tthis  12", "---", "share this 7"][: rnd.randint(0, 3)]
        rnd.shuffle(lines)
        out.append((f"d{i}", s, "\n".join(lines)))
    return out


@pytest.mark.parametrize("rule,limit", [(repeated.Repeats(), 10**6), (repeated.Repeats(counters=3, flush=50), 10**6), (repeated.Repeats(counters=2, flush=20), 0), (repeated.Repeats(), 0)])
def test_repeated_lines(spark, rule, limit):
    docs = line_docs(3)
    df = spark.createDataFrame(docs, "id string, source string, text string").repartition(3)
    got = repeated.repeated_lines(df, rule, broadcast_rows=limit).select("id", "line_no")
    assert rows(got) == brute_lines(docs)
    assert repeated.repeated_lines(df.limit(0), rule).count() == 0


def test_summary_bound():
    rnd = random.Random(5)
    stream = [rnd.choice([1, 1, 1, rnd.randint(2, 500)]) for _ in range(4000)]
    c, error = Counter(), 0
    for x in stream:
        c[x] += 1
        if len(c) > 20:
            error += repeated.shrink(c, 10)
    assert all(n - error <= c.get(k, 0) <= n for k, n in Counter(stream).items())


def test_lines_removed(spark):
    df = spark.createDataFrame([(f"i{k}", "s", f"body {'abcdefg'[k]}\nFooter {k}", "old") for k in range(6)], "id string, source_url string, text string, n_removed string")
    assert {(r.text, r.n_removed) for r in repeated.without_repeats(df).collect()} == {(f"body {c}", 1) for c in "abcdef"}


def test_lines_removed_by_row_and_not_by_id(spark):
    data = [("d0", "s", "body a\nFooter"), ("d0", "s", "Footer 9\nkeep me please"), ("d0", "s", None), (None, "s", "Footer\nb"), ("d1", "s", "c\n footer "), ("d2", "s", "FOOTER\r\nd"), ("d3", None, "Footer\ne"), ("d4", "t", "")]
    data += [(f"e{k}", "s", f"x{'abc'[k]}") for k in range(3)]
    df = spark.createDataFrame(data, "id string, source_url string, text string")
    want = sorted([("body a", 1), ("Footer 9\nkeep me please", 0), ("b", 1), ("c", 1), ("d", 1), ("Footer\ne", 0), ("", 0), (None, 0), ("xa", 0), ("xb", 0), ("xc", 0)], key=str)
    rule = repeated.Repeats(least=3)
    for limit in (10, 0):
        assert sorted([(r.text, r.n_removed) for r in repeated.without_repeats(df, rule, limit).collect()], key=str) == want
    assert repeated.without_repeats(df.limit(0)).count() == 0


# 5 -----------------------------------------------------------------------------------------------
def test_residue(spark):
    good = [(i, f"https://h.example/course/c-{i}/", f"c-{i}", f"{n} of {s} | Site") for i, (n, s) in enumerate([(n, s) for n in ("Study", "Report", "Theory", "Handbook") for s in ("rivers", "stones", "clouds", "gardens", "letters") for _ in range(8)])]
    bad = [
        (1000, "https://h.example/a/", "a", "{{ page_title }} | Site"), (1001, "https://h.example/b/", "b", "404 Not Found"), (1002, "https://h.example/c/", "c", "Please enable JavaScript"),
        (1003, "https://h.example/__slug__/x/", "x", "Study of rivers | Site"), (1004, "https://h.example/d/", "d", "Lorem ipsum"), (1005, "HTTPS://H.example/d", "D", None), (1006, None, None, "Access denied"),
    ]
    real = [(2000, "https://h.example/e/", "e", "JavaScript and rivers"), (2001, "https://h.example/f/", "f", None), (2002, None, "g", ""), (2003, "https://h.example/g/", "g", "Site")]
    df = spark.createDataFrame(good + bad + real, "row_id bigint, url string, slug string, title string")
    assert [r.row_id for r in residue.bad_entries(df).orderBy("row_id").collect()] == [b[0] for b in bad]
    assert residue.without_residue(df).count() == len(good) + len(real)
    assert residue.bad_entries(df.limit(0)).count() == 0


def test_residue_fit_on_all_passages(spark):
    rnd = random.Random(8)
    nouns = "rivers stones clouds gardens letters bridges".split()
    titles = [f"{rnd.choice(['Study', 'Report', 'Theory'])} of {rnd.choice(nouns)} {rnd.choice(nouns)}" for _ in range(300)]
    titles += ["Page not found", "Your page could not be found", "Page missing", "Not found here", "Please enable JavaScript", "Enable scripts please", "Lorem ipsum", "Ipsum page lorem", "Sorry, page missing"] * 3
    df = spark.createDataFrame([(i, f"https://h.example/c-{i}/", f"c-{i}", t) for i, t in enumerate(titles)], "row_id bigint, url string, slug string, title string").repartition(3)
    none = residue.Fit(held=0)
    whole, by_parts = residue.model_of(df), residue.model_of(df, none)
    assert by_parts.told == whole.told and by_parts.odds.keys() == whole.odds.keys()
    assert all(abs(whole.odds[f] - v) < 1e-6 for f, v in by_parts.odds.items())
    assert rows(residue.bad_entries(df, none)) == rows(residue.bad_entries(df))


def test_residue_finds_wordings_that_no_record_has(spark):
    rnd = random.Random(3)
    nouns = "rivers stones clouds gardens letters bridges".split()
    some = lambda: f"{rnd.choice(nouns)} and {rnd.choice(nouns)}"
    real = [f"{rnd.choice(['Study', 'Report', 'Theory'])} of {some()}" for _ in range(200)]
    real += [f"{p} {some()}" for p in ("JavaScript and", "Page tables and", "Error analysis in", "Access denied? Appeals on", "Not found in nature:", "Hello world: first workshop on", "Undefined behaviour and") for _ in range(6)] + ["Untitled: student art show", "Lost and found office"] * 5
    held_out = ["Kindly switch on scripting in your browser", "You must activate JavaScript to continue", "Sorry, your request could not be found", "The file you want was moved or deleted", "Oops, this record cannot be shown"]
    assert not any(residue.kind(p) for t in held_out + real for p in residue.passages(None, t))
    for n in (1, 20):  # few or many records
        titles = held_out + real * n
        df = spark.createDataFrame([(i, None, None, t) for i, t in enumerate(titles)], "row_id bigint, url string, slug string, title string")
        assert sorted(r.row_id for r in residue.bad_entries(df).collect()) == list(range(len(held_out)))


# 6 -----------------------------------------------------------------------------------------------
def size(t):
    return max(len(t.split()) * 133 // 100, len(t) // 3) + 1


def check_cut(text, limits=splitting.Limits()):
    spans = splitting.cut(text, limits)
    pieces = [text[a:b] for a, b in spans]
    assert all(size(p) <= splitting.limit_of(p, limits) for p in pieces)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a2 <= b1 < b2 for (_, b1), (a2, b2) in zip(spans, spans[1:]))
    assert (len(spans) > 1) == (size(text) > splitting.limit_of(text, limits))
    return spans


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["word ", "a", ". ", "\n", "\n\n", "| x | y |\n", "long" * 30, " ", "é,"]), max_size=900))
def test_cuts(parts):
    check_cut("".join(parts))


def test_cut_cases():
    for text in ("", " " * 9000, "x" * 9000, "w " * 4000, "| a | b |\n" * 2000, "x" * 3000 + " " + "y " * 700, "One sentence here. " * 400):
        check_cut(text)
    spans = check_cut("One sentence here is it. " * 300)
    text = "One sentence here is it. " * 300
    assert all(text[:b].rstrip().endswith(".") for _, b in spans[:-1])
    assert all(len(text[a2:b1].split()) == 24 for (_, b1), (a2, _) in zip(spans, spans[1:]))


def test_pieces(spark):
    data = [("p/a#0", "short", "u", 0, 3, 7), ("p/a#1", "Some words here. " * 500, "u", 1, 3, 7), ("p/a#2", None, "u", 2, 3, 7), ("p/b#0", "", "v", 0, 1, 7)]
    df = spark.createDataFrame(data, "id string, text string, source_url string, chunk_index int, n_chunks int, piece int")
    got = splitting.split_chunks(df).orderBy("id", "piece").collect()
    a = [r for r in got if r.id.startswith("p/a")]
    assert sorted(r.chunk_index for r in a) == list(range(len(a))) and {r.n_chunks for r in a} == {len(a)}
    assert [r.id for r in splitting.oversized(df).collect()] == ["p/a#1"]
    blocks = splitting.renumber(splitting.split(df), splitting.chunk_source(), span=1)
    assert rows(blocks.select("id", "piece", "chunk_index")) == rows(splitting.split_chunks(df).select("id", "piece", "chunk_index"))


def test_pieces_numbered_on_narrow_rows(spark):
    long = "\n".join(f"Sentence number {k} goes on for some more words." for k in range(400))
    data = [(f"c/s{a}#{k}", long if (a + k) % 4 == 0 else f"short {k}", k if a else k * 2, 5, "x") for a in range(3) for k in range(5)] + [("c/s9#0", None, 0, 1, "x")]
    df = spark.createDataFrame(data, "id string, text string, chunk_index int, n_chunks int, piece string")
    narrow, wide = splitting.split_chunks(df), splitting.renumber(splitting.split(df), splitting.chunk_source())
    assert rows(narrow.select(wide.columns)) == rows(wide) and set(narrow.columns) == set(wide.columns)
    twice = df.unionByName(df.filter("chunk_index = 0"))
    assert rows(splitting.split_chunks(twice).select(wide.columns)) == rows(splitting.renumber(splitting.split(twice), splitting.chunk_source()).select(wide.columns))
    assert splitting.split_chunks(df.limit(0)).count() == 0


# 7, 8 --------------------------------------------------------------------------------------------
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .'\n\t\r 　é日1,s\x1c"), max_size=60))
def test_token_counts(text):
    c = tokens.Counter()
    assert c.count(pa.array([text]))[0] == len(tokens.encoding().encode_ordinary(text))


def test_hilbert_is_a_curve():
    for d, bits in ((2, 3), (3, 2), (4, 1)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * d)).reshape(d, -1).T
        order = cells[np.argsort(packing.hilbert(cells, bits))]
        assert sorted(packing.hilbert(cells, bits)) == list(range(len(cells)))
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def docs(spark, n=400):
    rnd = random.Random(9)
    data = [(i, " ".join(rnd.choice(["river", "stone", "cloud"]) for _ in range(rnd.choice([1, 5, 40, 200, 900]))), rnd.choice("abc"), 1) for i in range(n)]
    return spark.createDataFrame(data + [(n, None, "a", 1), (n + 1, "", "b", 1), (n + 2, "null source", None, 1), (None, "no id", "a", 1)], "doc_id bigint, text string, source string, n_tokens int")


def test_packing(spark):
    df = docs(spark)
    conf = packing.Packing(capacity=256, stretch=150, window=64)
    placed = packing.pack(df, conf).collect()
    c = tokens.Counter()
    want = {r.doc_id: int(c.count(pa.array([r.text]))[0]) for r in df.filter("length(text) > 0").collect()}
    got = Counter()
    for r in placed:
        got[r.doc_id] += r.n_tokens
    assert dict(got) == want
    parts = Counter(r.doc_id for r in placed)
    assert all(parts[k] == -(-n // 256) for k, n in want.items())
    used = Counter()
    for r in placed:
        used[r.context_id] += r.n_tokens
    best: list[int] = []  # first fit, larger ones first, over all texts
    for n in sorted((n % 256 for n in want.values() if n % 256), reverse=True):
        k = next((k for k, free in enumerate(best) if free >= n), None)
        if k is None:
            best.append(256 - n)
        else:
            best[k] -= n
    assert max(used.values()) <= 256 and len(used) <= sum(n // 256 for n in want.values()) + 1.05 * len(best) + 6
    assert packing.pack(df.limit(0), conf).count() == 0


def test_trades_keep_tokens():
    rng = np.random.default_rng(2)
    sizes, p = rng.integers(1, 50, 500).astype(float), np.full(500, 0.3)
    before = (sizes * p).sum()
    left = mixing.trade(sizes, p, rng.random(500))
    assert abs((sizes * p).sum() - before) < 1e-6 and sum(0 < x < 1 for x in p) <= 1 and (left < 0 or 0 < p[left] < 1)
    picks = np.zeros(20)
    for seed in range(3000):
        q = np.full(20, 0.35)
        mixing.trade(np.arange(1, 21, dtype=float), q, np.random.default_rng(seed).random(20))
        picks += q
    assert np.abs(picks / 3000 - 0.35).max() < 0.04


def test_mixing(spark):
    df = docs(spark)
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.2, 1), ("c", 0.2, 2), ("gone", 0.1, 2), (None, 0.3, 1), ("z", 0.0, 1), ("y", 0.1, 0)], "source string, target_share double, max_repeats int")
    for fan, window in ((64, 20_000), (2, 16)):
        m = mixing.mix(df.repartition(7), targets, fan=fan, window=window)
        shares = {r.source: r for r in m.shares.collect()}
        assert set(shares) == {"a", "b", "c", "gone"} and shares["gone"].tokens == 0
        for s, want in (("a", 5 / 9), ("b", 2 / 9), ("c", 2 / 9)):
            assert abs(shares[s].actual_share - want) < 0.02 and shares[s].most_copies <= shares[s].max_repeats
        assert m.rows.select("doc_id", "copies").filter("copies < 1").count() == 0
    assert mixing.mix(df.limit(0), targets).rows.count() == 0
    short = mixing.mix(df, targets, total_tokens=10**7).shares.filter("source = 'b'").first()
    assert short.most_copies == 1


def test_scarce_source_leaves_the_others_whole(spark):
    data = [(i, "river stone cloud " * 20, "wide") for i in range(50)] + [(100, "river stone cloud " * 20, "few"), (101, "river", "scarce")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("wide", 0.5, 1), ("few", 0.4, 3), ("scarce", 0.1, 1)], "source string, target_share double, max_repeats int")
    whole = int(tokens.Counter().count(pa.array([t for _, t, _ in data])).sum())
    got = {r.source: r for r in mixing.mix(df, targets).shares.collect()}
    one = len(tokens.encoding().encode_ordinary(data[0][1]))
    assert abs(got["wide"].tokens - 0.5 * whole) <= one / 2  # a scarce source takes nothing from it
    assert (got["few"].n_used, got["few"].most_copies, got["scarce"].n_used, got["scarce"].most_copies) == (1, 3, 1, 1)
    assert got["few"].actual_share < 0.2 and abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9


def test_same_mix_under_any_partitioning(spark):
    df = docs(spark)
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.2, 1), ("c", 0.3, 2)], "source string, target_share double, max_repeats int")
    more = df.unionByName(df.limit(1).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) if c == "doc_id" else F.col(c) for c in df.columns]))
    more = more.unionByName(more.filter("doc_id IS NULL")).unionByName(more.filter("doc_id IS NULL"))
    got = [sorted(map(tuple, mixing.mix(more.repartition(n), targets, seed=5, window=16, fan=2).rows.collect()), key=str) for n in (1, 3, 9)]
    assert got[0] and got[0] == got[1] == got[2]
    other = sorted(map(tuple, mixing.mix(more, targets, seed=6, window=16, fan=2).rows.collect()), key=str)
    assert other != got[0]


# 9 -----------------------------------------------------------------------------------------------
def test_spam(spark):
    rnd = random.Random(4)
    keys = ["cheap watches", "free coins", "loan offers", "best pills", "casino bonus"]
    w = "the committee will review a report on rivers and gardens before winter because it was late in the year".split()
    prose = lambda n: " ".join(" ".join(rnd.sample(w, 14)).capitalize() + "." for _ in range(n))
    bad, good = [], []
    for i in range(12):
        bad.append("\n".join(f"https://s{rnd.randint(0, 99)}.example/{rnd.choice(keys).replace(' ', '-')}" for _ in range(20)))
        bad.append("Tags: " + ", ".join(rnd.choice(keys) for _ in range(40)))
        bad.append(" ".join(x if k % 4 else x + " " + keys[i % 5] for k, x in enumerate(prose(9).split())))
        bad.append(" ".join("#" + rnd.choice(keys).title().replace(" ", "") for _ in range(20)))
        good += [prose(12), prose(10) + "\nSee also: https://x.example/a\nTags: rivers, gardens", "\n".join(f"| {rnd.choice(keys)} | {k} |" for k in range(12))]
        good.append("\n".join(f"Dr. N{rnd.randint(1, 999)} M{k}, Rivers, Room {k}, ext. {rnd.randint(1000, 9999)}" for k in range(12)))
    data = list(enumerate(bad + good)) + [(9001, None), (9002, ""), (9003, "free coins"), (None, bad[0])]
    df = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id bigint, text string, sure int")
    assert sorted(r.doc_id for r in spam.spam_pages(df).collect()) == list(range(len(bad)))
    assert spam.spam_pages(df.limit(0)).count() == 0


def test_phrases_beyond_the_broadcast(spark):
    rnd = random.Random(6)
    keys = ["cheap watches", "free coins", "loan offers", "best pills", "casino bonus"]
    sure = ["Tags: " + ", ".join(rnd.choice(keys) for _ in range(40)) for _ in range(20)]
    plain = "river stone cloud garden letter bridge winter museum harbour valley meadow teacher orchard captain village lantern forest island temple castle".split()
    lines = lambda words, n: "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))
    held = [lines(rnd.sample(keys, 4) + rnd.sample(keys, 4), 2) for _ in range(6)]
    other = [lines(rnd.sample(plain, 16), 4) for _ in range(6)]
    texts = sure + held + other + held[:1] * 9
    want = [i for i, t in enumerate(texts) if t not in other]
    assert {spam.judge(t, spam.Spam())[0] for t in held + other} == {1}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for most in (100_000, 3, 0):
        assert sorted(r.doc_id for r in spam.spam_pages(df, spam.Spam(lexicon=most)).collect()) == want


def test_shapes_decide_which_pages_are_looked_at(spark, monkeypatch):
    spam_text = "\n".join(f"Order the {w} lamp in red for {k}.50 with code AB{k}!" for k, w in enumerate(["new", "best", "top", "last"] * 3))
    prose = "The ferry was late, so we had to wait at the pier until six. Nobody had told us that it would rain. When the captain came on deck, he asked for our tickets and smiled. It is a short trip. My sister slept all the way, but I watched the shore go by."
    assert spam.flagged(spam.units_of(spam_text), spam.Spam()) and not spam.flagged(spam.units_of(prose), spam.Spam())
    lists = "Tags: " + ", ".join(["free coins", "loan offers", "best pills"] * 9)
    df = spark.createDataFrame([(1, lists), (1, lists), (2, prose), (3, "a\tb\x1fc " * 9)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in spam.spam_pages(df).collect()) == [1, 3]  # 3 repeats three words
    monkeypatch.setattr(spam, "flagged", lambda units, rule: False)  # nothing is found without the shapes
    assert all(spam.judge(t, spam.Spam()) is None for t in (spam_text, prose, lists))


def test_units_come_back_from_the_table():
    for t in ("See https://a.example/free-coins_now and http://b.example.", "| a | b |", "#OneTag #TwoTags", "", "It is late, so we will go home.", "İstanbul ſtreet ẞ"):
        for u in spam.units_of(t):
            v = spam.Unit.unpacked(u.packed())
            assert (v.words, v.address_words, v.links, v.table, v.sentence) == (u.words, u.address_words, u.links, u.table, u.sentence)


def test_counters_of_tokens_reset():
    c = tokens.Counter(dims=4)
    texts = pa.array(["one two", None, "", "three  four"])
    n, v = c.measure(texts)
    assert n.tolist() == [2, 0, 0, len(tokens.encoding().encode_ordinary("three  four"))] and v.shape == (4, 4)

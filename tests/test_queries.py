import pytest
from sqlcheck import DATA, compare

from loomwork import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, name):
    compare(spark, DATA, Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    rows = Q.QUERIES[name](spark, DATA).collect()  # what they hold is tested in test_brute
    assert name == "ended_terms" or rows and all(r[0] is not None for r in rows)


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).columns == ["query_id", "id", "rank", "fused", "score"]
    assert set(E.oracle_sql()) <= set(E.queries())


def test_names_in_texts_of_any_label(spark, tmp_path):
    texts = ["Ask Dr. Anna Berg.", "Prof. Carl Dahl and Dr. Anna Berg.", None, "Mr. Edo Falk.", "Nobody.", "Mrs. Gro Hall.", "Mrs. Gro Hall."]
    data = [(i, x, lang) for i, (x, lang) in enumerate(zip(texts, ["en", "und", "en", None, "EN", "en", "de"]))]
    spark.createDataFrame(data, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.names for r in Q.QUERIES["unsupported_names"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 3, 4, 5]
    assert got[3] == ["Edo Falk."] and not (got[0] or got[4] or got[5])

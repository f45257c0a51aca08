import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as R

S = "id long, file_path string, name string, start_line int, content string"


def find(spark, rows, query, limit=10):
    df = spark.createDataFrame([(k, f, n, 1, c) for k, (f, n, c) in enumerate(rows)], S)
    return [(r["name"], r["pass"], r["score"]) for r in R.search_symbols(df, query, limit).collect()]


def test_exact_name_first(spark):
    got = find(spark, [("c.ts", "unrelated", "calls handler()"), ("b.ts", "handlerFactory", ""), ("a.ts", "handler", "")], "handler")
    assert got[0] == ("handler", 1, 101) and got[1][2] == 51 and got[2][2] == 1


def test_stop_words_and_fallback(spark):
    rows = [("a.ts", "checkAuth", "auth middleware for session"), ("b.ts", "otherThing", "nothing")]
    assert find(spark, rows, "where is the auth middleware?")[0][0] == "checkAuth"
    assert find(spark, rows, "auth nonexistentterm12345") == [("checkAuth", 2, 51)]


@pytest.mark.parametrize("query", ["handler()", "a:b", '"quoted"', "***", "(((", "a-b-c", "", "   "])
def test_hostile_queries(spark, query):
    find(spark, [("a.ts", "handler", "a b c quoted")], query)


def test_nulls_and_empty_table(spark):
    assert find(spark, [], "x") == []
    assert find(spark, [("a.ts", None, None), ("b.ts", "x", None)], "x") == [("x", 1, 101)]


def test_bm25(spark):
    df = spark.createDataFrame([(1, "graph graph memory"), (2, "graph"), (3, None), (4, "other words here"), (5, "graph")], "k long, t string")
    top = R.bm25_topk(df, "k", F.col("t"), "graph memory", 10).collect()
    assert [r["k"] for r in top] == [1, 2, 5]  # ties by key
    assert R.bm25_topk(df, "k", F.col("t"), "!!!", 2).collect() == [(1, 0.0), (2, 0.0)]
    twice = R.bm25_topk(df, "k", F.col("t"), "memory memory", 1).first()["score"]
    assert abs(twice - 2 * R.bm25_topk(df, "k", F.col("t"), "memory", 1).first()["score"]) < 1e-5
    assert R.bm25_topk(df.where("false"), "k", F.col("t"), "graph", 3).count() == 0

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G

SYMBOLS = "id long, file_path string, name string, type string, start_line int, end_line int, content string, refs array<struct<name:string,type:string,specifier:string>>"


def symbols(spark, rows):
    return spark.createDataFrame([(k, f, n, "function", line, line + 5, "", [(a, b, c) for a, b, c in refs] if refs is not None else None) for k, (f, n, line, refs) in enumerate(rows)], SYMBOLS)


def calls(edges):
    return {(r["src"], r["dst"], r["confidence"]) for r in edges.where("type <> 'contains'").collect()}


def node(path, name, line=1):
    return f"symbol:{path}:{name}:{line}"


def test_single_target(spark):
    s = symbols(spark, [("a.ts", "alpha", 1, [("beta", "call", None)]), ("b.ts", "beta", 1, None), ("c.ts", "gamma", 1, [])])
    assert calls(G.build_edges(s)) == {(node("a.ts", "alpha"), node("b.ts", "beta"), "EXTRACTED")}


def test_ambiguous_fans_out_and_is_hidden(spark):
    s = symbols(spark, [("a.ts", "alpha", 1, [("beta", "call", None)]), ("b.ts", "beta", 1, []), ("c.ts", "beta", 1, [])])
    e = G.build_edges(s)
    assert {c for *_, c in calls(e)} == {"INFERRED"} and len(calls(e)) == 2
    assert calls(G.visible(e)) == set() and len(calls(G.visible(e, inferred=True))) == 2


def test_import_decides(spark):
    s = symbols(spark, [("src/a.ts", "run", 1, [("handler", "call", None), ("handler", "import", "./moduleA")]), ("src/moduleA.ts", "handler", 1, []), ("src/moduleB.ts", "handler", 1, [])])
    assert calls(G.build_edges(s)) == {(node("src/a.ts", "run"), node("src/moduleA.ts", "handler"), "EXTRACTED")}


def test_alias_decides_between_two(spark):
    s = symbols(spark, [("src/a.ts", "run", 1, [("widget", "call", None), ("widget", "import", "@app/widget")]), ("src/app/widget.ts", "widget", 1, []), ("lib/widget.ts", "widget", 1, [])])
    assert calls(G.build_edges(s, aliases=[("@app/*", "src/app/*")])) == {(node("src/a.ts", "run"), node("src/app/widget.ts", "widget"), "EXTRACTED")}


def test_same_file_before_others(spark):
    s = symbols(spark, [("a.ts", "alpha", 1, [("beta", "call", None)]), ("a.ts", "beta", 9, []), ("c.ts", "beta", 1, [])])
    assert calls(G.build_edges(s)) == {(node("a.ts", "alpha"), node("a.ts", "beta", 9), "EXTRACTED")}


def test_reexports(spark):
    direct = spark.createDataFrame([("origin.ts", "handler"), ("other.ts", "x")], "file_path string, name string")
    chain = spark.createDataFrame([("mid.ts", "origin.ts", "handler", "run"), ("barrel.ts", "mid.ts", "*", "*"), ("top.ts", "barrel.ts", "*", "*")], "file_path string, target string, imported string, exported string")
    got = {(r["file_path"], r["name"]): (r["origin"], r["origin_name"]) for r in G.expand_reexports(direct, chain).collect()}
    assert got[("top.ts", "run")] == ("origin.ts", "handler") and ("top.ts", "handler") not in got
    exports = G.expand_reexports(direct, chain)
    s = symbols(spark, [("a.ts", "go", 1, [("run", "call", None), ("run", "import", "./top")]), ("origin.ts", "handler", 1, []), ("top.ts", "other", 1, [])])
    assert calls(G.build_edges(s, exports)) == {(node("a.ts", "go"), node("origin.ts", "handler"), "EXTRACTED")}


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "call", "EXTRACTED", "") for a, b in pairs], "src string, dst string, type string, confidence string, reason string")


def test_walks(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "b"), ("d", "a")])
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    assert {tuple(r) for r in G.reach(e, one("a"), "out", 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {tuple(r) for r in G.impact(e, one("b"), 1).collect()} == {("a", 1), ("x", 1)}
    assert [r["node"] for r in G.shortest_path(e, "x", "d").collect()] == ["x", "b", "a", "d"]
    assert G.shortest_path(e, "a", "nowhere").count() == 0
    assert [r["node"] for r in G.shortest_path(e, "a", "a").collect()] == ["a"]
    nodes = spark.createDataFrame([(n,) for n in "abcdxz"], "node string")
    assert {tuple(r) for r in G.hubs(nodes, e, 2).collect()} == {("b", 3), ("a", 2)}
    assert G.degrees(nodes, e).where("node = 'z'").first()["degree"] == 0


@pytest.mark.parametrize(("path", "want"), [("./a//b/../c.ts", "a/c.ts"), ("..\\x\\y", "../x/y"), ("a/./b", "a/b"), ("", "")])
def test_clean_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(G.clean_path(F.col("p"))).first()[0] == want

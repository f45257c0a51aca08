"""The inverted index, the context response, search neighbourhoods, git sources and ignore rules."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.operators import context as C
from tessera.operators import graph as G
from tessera.operators import retrieval as R
from tessera.operators.budget import surrogate
from tessera.operators.inverted import TOKENS, InvertedIndex, indexed_topk, search_indexed
from tessera.sources import git, tree

SYMBOL = "id long, file_path string, name string, type string, start_line int, end_line int, content string, refs array<struct<name:string,type:string,specifier:string>>"


def symbols(spark, rows):
    return spark.createDataFrame([(k, p, n, "function", k, k + 1, c, [(r, "call", None) for r in refs]) for k, (p, n, c, refs) in enumerate(rows, 1)], SYMBOL)


def test_index_equals_scan(spark, tmp_path):
    rng = random.Random(1)
    words = ["vault", "vaulted", "session", "token_id", "x", "é", "the", "merge"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) if k % 9 else None) for k in range(200)]
    docs = spark.createDataFrame(rows, "k long, t string").selectExpr("*", "1 as term", "2 as tf")
    index = InvertedIndex(spark, str(tmp_path / "d")).build(docs, "k", F.col("t"))
    for query in ("vault session", "session session merge", "nothing", "", "x"):
        assert [tuple(r) for r in indexed_topk(index, query, 7).collect()] == [tuple(r) for r in R.bm25_topk(docs, "k", F.col("t"), query, 7).collect()], query
    some = docs.where("k % 2 = 0")
    assert [tuple(r) for r in indexed_topk(index, "vault merge", 5, some.select(F.col("k").alias("key"))).collect()] == [tuple(r) for r in R.bm25_topk(some, "k", F.col("t"), "vault merge", 5).collect()]


def test_symbol_index_equals_scan(spark, tmp_path):
    rng = random.Random(2)
    words = ["vault", "vaultRoom", "token_id", "token", "id", "merge", "return null"]
    rows = [(f"f{k % 7}.ts", rng.choice(words), " ".join(rng.choice(words) for _ in range(8)) if k % 11 else None, []) for k in range(150)]
    s = symbols(spark, rows)
    index = InvertedIndex(spark, str(tmp_path / "s"), TOKENS, True).build(s, "id", F.concat_ws(" ", "name", "content"))
    for query in ("vault", "token_id", "token_i merge", "where is the vault", "zzz", "", "return_nu vault"):
        assert [tuple(r) for r in search_indexed(index, s, query, 6).collect()] == [tuple(r) for r in R.search_symbols(s, query, 6).collect()], query


def test_refresh_and_compact(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "k long, t string")
    index = InvertedIndex(spark, str(tmp_path / "r")).build(df([(1, "old words here"), (2, "other words"), (3, "gone words")]), "k", F.col("t"))
    index.refresh(df([(1, "new text"), (4, "more words")]), "k", F.col("t"), df([(3, None)]).select("k"))
    now = df([(1, "new text"), (2, "other words"), (4, "more words")])
    want = [tuple(r) for r in R.bm25_topk(now, "k", F.col("t"), "words new", 9).collect()]
    assert [tuple(r) for r in indexed_topk(index, "words new", 9).collect()] == want
    index.compact()
    assert len(index.segments()) == 1 and [tuple(r) for r in indexed_topk(index, "words new", 9).collect()] == want
    empty = InvertedIndex(spark, str(tmp_path / "e")).build(df([]), "k", F.col("t"))
    assert indexed_topk(empty, "x", 3).count() == 0


def test_searches_of_many_terms(spark, tmp_path):
    rng = random.Random(3)
    words = ["alpha", "alphaBeta", "beta_gamma", "gamma", "delta"]
    s = symbols(spark, [(f"f{k}.ts", rng.choice(words), " ".join(rng.choice(words) for _ in range(6)), []) for k in range(60)])
    index = InvertedIndex(spark, str(tmp_path / "m"), TOKENS, True).build(s, "id", F.concat_ws(" ", "name", "content"))
    asked = [("alpha", 0), ("beta_gam", 1), ("nothing", 2), ("delta", 3)]
    rows = s.select(F.col("id").alias("key"), "name", "refs")
    got = G.search_many(index, rows, spark.createDataFrame(asked, "q string, place int"), 10).groupBy("place").agg(F.collect_set("key").alias("k")).collect()
    by = {r["place"]: set(r["k"]) for r in got}
    for q, place in asked:
        assert by.get(place, set()) == {r["id"] for r in R.search_symbols(s, q, 10).collect()}, q


def test_neighbourhood_and_pool(spark, tmp_path):
    s = symbols(spark, [("a.ts", "startHere", "middleOne()", ["middleOne"]), ("b.ts", "middleOne", "lastOne()", ["lastOne"]), ("c.ts", "lastOne", "x", []), ("d.ts", "unrelated", "x", [])])
    index = InvertedIndex(spark, str(tmp_path / "n"), TOKENS, True).build(s, "id", F.concat_ws(" ", "name", "content"))
    found, cut = G.neighbourhood(index, s, ["startHere"], 100)
    assert {r["key"] for r in found.collect()} == {1, 2, 3} and not cut
    only, cut = G.neighbourhood(index, s, ["startHere"], 100, pushing=1)
    assert {r["key"] for r in only.collect()} == {1, 2} and not cut
    seeds = C.with_node(s).where("name = 'middleOne'").select("id", "node")
    assert {r["node"] for r in G.pool_neighbours(index, s, seeds).collect()} == {"symbol:a.ts:startHere:1", "symbol:c.ts:lastOne:3"}


def test_hybrid_and_response(spark, tmp_path):
    s = symbols(spark, [("a.ts", "openVault", "vault body " * 30, ["checkKey"]), ("b.ts", "checkKey", "nothing", []), ("c.ts", "callerOf", "nothing", ["openVault"])])
    index = InvertedIndex(spark, str(tmp_path / "h"), TOKENS, True).build(s, "id", F.concat_ws(" ", "name", "content"))
    results = C.hybrid_results(index, s, G.build_edges(s), "vault", 10)
    assert {(r["id"], r["pass"], r["score"]) for r in results.collect()} == {(1, 1, 51.0), (2, 3, 0.5), (3, 3, 0.5)}
    chunks = C.collected_chunks(results, s)
    assert [c.path for c in chunks] == ["a.ts", "b.ts", "c.ts"]
    for budget in (0, 1, 20, 150, 800, 5000):
        text, _, _ = C.respond("vault", chunks, budget, "memory " * 20, 2, ["change " * 300], ["- test"])
        assert surrogate(text) <= budget
    assert C.baseline_tokens(results, s).count() == 3
    assert C.respond("q", [], 500)[0].endswith("Nothing found for: q")


def test_assembly():
    assert C.assemble([], 100) == ("", 0, 0, 0)
    text, used, included, dropped = C.assemble([C.Chunk("a", "w " * 400, 1, None, "x"), C.Chunk("b", "w w", None, None, "x")], 5)
    assert (used, included, dropped) == (2, 1, 1) and text == "### b [x]\n```\nw w\n```"
    text, used, included, dropped = C.assemble([C.Chunk("a", "w " * 400, 3, None, "x"), C.Chunk("b", "w", 1, 2, "x")], 200)
    assert (used, included, dropped) == (200, 1, 1) and text.startswith("### a:3-3 [x]\n")


def test_git(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b.example", "-c", "user.name=Ann Example", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    (root / "a.ts").write_text("one\ntwo\nthree\n")
    (root / "gone.ts").write_text("x\n")
    run("add", ".")
    run("commit", "-m", "first")
    run("checkout", "-b", "work")
    (root / "a.ts").write_text("one\nTWO\nthree\nfour\n")
    (root / "gone.ts").unlink()
    run("commit", "-am", "second change")
    (root / "new file.ts").write_text("1\n2\n")
    got = {r["file_path"]: (r["status"], r["diff"]) for r in git.changed_files(spark, str(root), "main").collect()}
    assert set(got) == {"a.ts", "gone.ts"} and got["gone.ts"] == ("D", "") and "@@ -2 +2 @@" in got["a.ts"][1]
    more = {r["file_path"]: (r["status"], r["diff"]) for r in git.changed_files(spark, str(root), "main", worktree=True).collect()}
    assert more["new file.ts"] == ("??", "@@ -0,0 +1,2 @@")
    log = git.history(spark, str(root), "a.ts").collect()
    assert [r["message"] for r in log] == ["second change", "first"] and log[0]["author"].startswith("Ann Example")
    assert [r["message"] for r in git.history(spark, str(root), "a.ts", 4, 4).collect()] == ["second change"]
    assert git.history(spark, str(root), "nothing.ts", 1, 2).collect() == []
    with pytest.raises(RuntimeError):
        git.changed_files(spark, str(root), "no-such-base")


def test_ignore_rules(spark):
    rules = tree.read_ignores("# c\nnode_modules/\n*.gen.ts\n!keep.gen.ts\n/top\na/**/z.ts\n\n")
    paths = {"node_modules/x.ts": True, "src/node_modules/x.ts": True, "b/x.gen.ts": True, "b/keep.gen.ts": False, "top/x.ts": True, "b/top/x.ts": False, "a/z.ts": True, "a/b/c/z.ts": True, "a/b/y.ts": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", tree.ignored_by(F.col("p"), rules).alias("i"))
    assert {r["p"]: r["i"] for r in df.collect()} == paths


def test_gitignore_of_the_root(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("skip/\n")
    for p in ("a.ts", "skip/b.ts"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    assert [r["file_path"] for r in tree.list_files(spark, str(tmp_path)).select("file_path").collect()] == ["a.ts"]


def test_aliases():
    assert tree.read_aliases('{ // c\n "compilerOptions": {"baseUrl": "src", "paths": {"@app/*": ["app/*", "x"], /* x */ "~": ["main"],},} }') == [("@app/*", "src/app/*"), ("~", "src/main")]
    assert tree.read_aliases("{") == [] and tree.read_aliases("[]") == [] and tree.read_aliases('{"compilerOptions": null}') == []

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import budget, diff, evaluate, failures, memory
from tessera.sources import extract, markers, memory_files, tree
from tessera.sources.index import index_tree
from tessera.sources.provider import provider_source
from tessera.sources.store import BucketedTable, VersionedTable, replace_files
from tessera.streaming import guard, watcher

M = "rev_id long, id string, type string, title string, description string, tags array<string>, scope string, collection string, ts timestamp, source string, supersedes string, invalidated boolean, body string"


def mem(spark, rows):
    base = {"type": "Memory", "tags": [], "scope": "general", "invalidated": False, "body": ""}
    names = [f.split()[0] for f in M.split(", ")]
    return spark.createDataFrame([tuple({**base, "rev_id": k, **r}.get(n) for n in names) for k, r in enumerate(rows)], M)


def test_ids(spark):
    m = mem(spark, [{"title": "Fix Auth Bug!"}, {"title": "fix auth bug"}, {"title": "Fix Auth Bug!"}, {"title": "!!!"}, {"title": None}])
    got = {r["title"]: r["id"] for r in memory.assign_ids(m).collect()}
    assert got["Fix Auth Bug!"] == "general/fix-auth-bug" and got["fix auth bug"] == "general/fix-auth-bug-2" and len(got) == 3


def test_life_cycle(spark):
    m = mem(spark, [{"id": "a/x", "title": "X", "scope": "a"}, {"id": "a/y", "title": "Y", "scope": "a", "invalidated": True}, {"id": "b/z", "title": "Z", "scope": "b", "body": None}])
    gone = memory.invalidate(m, spark.createDataFrame([("b/z", "old")], "id string, reason string"))
    assert gone.where("id = 'b/z'").first()["body"].endswith("> Invalidated: old")
    assert memory.active(gone).count() == 1 and memory.delete(m, scope="a").count() == 1
    assert {(r["scope"], r["collection"]): r["n"] for r in memory.status(m).collect()} == {(None, None): 2, ("a", None): 1, ("a", "general"): 1, ("b", None): 1, ("b", "general"): 1}


def test_front_matter_round_trip(spark):
    m = mem(spark, [{"id": "a/x", "title": 'A "quoted": title', "tags": ["p", "q"], "body": "line\n\n---\nend", "collection": "c"}, {"id": "a/y", "title": None, "type": None}])
    r = memory.parse_front_matter(memory.front_matter(m)).collect()
    assert len(r) == 1 and (r[0]["title"], r[0]["tags"], r[0]["body"], r[0]["collection"]) == ('A "quoted": title', ["p", "q"], "line\n\n---\nend", "c")


def test_migration(spark):
    s = mem(spark, [{"id": "a/1", "title": "One", "body": "x"}, {"id": "a/2", "title": "Two"}, {"id": "a/3", "title": "Three"}])
    t = mem(spark, [{"id": "a/1", "title": "One", "body": "x"}, {"id": "a/2", "title": "Two", "body": "other"}, {"id": "a/9", "title": "Three"}])
    assert {r["id"]: r["verdict"] for r in memory.classify_migration(s, t).collect()} == {"a/1": "skip", "a/2": "conflict_id", "a/3": "conflict_title"}


def test_trees(spark, tmp_path):
    m = mem(spark, [{"id": "a/x", "title": "X", "scope": "a", "type": "Decision"}, {"id": "a/y", "title": "Y", "scope": "a", "invalidated": True}])
    rows = memory_files.export_tree(m).collect()
    assert [(r["wing"], r["room"], r["file"]) for r in rows] == [("a", "decisions", "x.md")]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text(rows[0]["document"])
    (tmp_path / "a" / "index.md").write_text("# index")
    (tmp_path / "a" / "stray.md").write_text("no front matter")
    assert [(r["id"], r["title"]) for r in memory_files.read_memories(spark, str(tmp_path)).collect()] == [("a/x", "X")]
    back = memory_files.import_tree(spark.createDataFrame([("w/r/x.md", rows[0]["document"])], "path string, document string")).first()
    assert (back["scope"], back["collection"]) == ("w", "r")
    s = memory_files.parse_session(spark.createDataFrame([(1, "## Memories\n### A\nbody\n### B\n\n## Other\n### C\n")], "k int, t string"), "k", "t")
    assert [(r["title"], r["block"]) for r in s.collect()] == [("A", "body"), ("B", "")]


def test_guard_equals_the_state_machine(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["s", None]), rng.choice(["a", "b"]), rng.choice([True, False, False, None]), rng.choice([True, False, False, None])) for k in range(300)]
    df = spark.createDataFrame(rows, "failure_id long, scope string, command string, ok boolean, retry_known_failure boolean")
    got = {r["failure_id"]: (r["state_before"], r["state_after"], r["refused"]) for r in failures.guard_batch(df, ["scope", "command"], "failure_id", "ok", "retry_known_failure", width=37).collect()}
    state, want = {}, {}
    for i, s, c, ok, retry in rows:
        before = state.get((s, c), failures.CLEAN)
        after, refused = failures.next_state(before, ok, retry)
        want[i], state[(s, c)] = (before, after, refused), after
    assert got == want
    assert failures.guard_batch(df.where("false"), ["scope", "command"], "failure_id", "ok", "retry_known_failure").count() == 0


def test_guard_stream(spark, tmp_path):
    rows = [(1, "s", "c", False, False), (2, "s", "c", False, False), (3, "s", "c", True, False), (4, "s", "c", True, True), (5, None, "c", True, None)]
    df = spark.createDataFrame(rows, "failure_id long, scope string, command string, ok boolean, retry_known_failure boolean")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = guard.guard_stream(stream).writeStream.format("memory").queryName("guarded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["failure_id"]: (r["state_after"], r["refused"]) for r in spark.table("guarded").collect()} == {1: ("RECORDED", False), 2: ("BLOCKING", False), 3: ("BLOCKING", True), 4: ("CLEAN", False), 5: ("CLEAN", False)}


def test_packing(spark):
    rows = [(1, "f", "a b c", 0.9), (2, "f", " ".join("w" for _ in range(400)), 0.8), (3, "f", "x y", None)]
    df = spark.createDataFrame(rows, "chunk_id long, file string, content string, score double")
    assert tuple(budget.pack_context(df, "file", "chunk_id", "content", "score", 5).first())[1:] == (5, 2, 1)
    assert tuple(budget.pack_context(df, "file", "chunk_id", "content", "score", 200).first())[1:] == (200, 2, 1)


def test_packing_looks_at_every_chunk(spark):
    sizes = [950] + [400] * 4999 + [50]
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, n int").selectExpr("if(k < 0, '', null) as file", "k", "repeat('. ', n) as content", "-double(k) as score")
    df = df.union(df.where("k = 0").selectExpr("'b'", "k", "content", "score"))
    got = {r["file"]: tuple(r)[1:] for r in budget.pack_context(df, "file", "k", "content", "score", 1000).collect()}
    assert got == {None: (1000, 2, 4999), "b": (950, 1, 0)}


def test_hunks(spark):
    d = spark.createDataFrame([(1, "@@ -2,0 +3,2 @@\n@@ -1,3 +0,0 @@\n@@ -6,2 +5,1 @@\n@@ -5 +4,0 @@\n@@ bad @@"), (2, None), (3, "")], "k long, d string")
    assert [(r["start"], r["end"]) for r in diff.hunk_ranges(d, "k", "d").orderBy("hunk").collect()] == [(3, 4), (1, 0), (5, 5), (5, 4)]
    s = spark.createDataFrame([("f", "in", 3, 7), ("f", "after", 5, 9), ("f", "none", None, 9), ("g", "else", 1, 99)], "file_path string, name string, start_line int, end_line int")
    r = spark.createDataFrame([("f", 5, 4)], "file_path string, start long, end long")
    assert [x["name"] for x in diff.changed_symbols(s, r).collect()] == ["in"]


def test_associations_and_review(spark):
    s = spark.createDataFrame([(1, "src/math.ts", "add", "function", 1, 3, "", None), (2, "src/math.ts", "subtract", "function", 5, 7, "", None), (3, "src/other.ts", "addAll", "function", 1, 2, "", None)], "id long, file_path string, name string, type string, start_line int, end_line int, content string, refs array<struct<name:string,type:string,specifier:string>>")
    t = spark.createDataFrame([("test/math.test.ts", "import { add as plus } from '../src/math'\naddAll()")], "path string, content string")
    a = diff.test_associations(s, t)
    assert {(r["symbol_name"], r["confidence"]) for r in a.collect()} == {("add", "import"), ("addAll", "mention")}
    ranges = spark.createDataFrame([("src/math.ts", 1, 7)], "file_path string, start long, end long")
    edges = spark.createDataFrame([("symbol:src/other.ts:addAll:1", "symbol:src/math.ts:add:1", "call", "EXTRACTED", "")], "src string, dst string, type string, confidence string, reason string")
    counts = ["file_path", "n_symbols", "n_untested", "n_callers"]
    assert tuple(diff.review_pack(ranges, s, ranges, edges, a).select(*counts).first()) == ("src/math.ts", 2, 1, 1)
    files = spark.createDataFrame([("src/math.ts", "M"), ("src/gone.ts", "D"), ("src/z.ts", "A")], "file_path string, status string")
    debts = spark.createDataFrame([("src/math.ts",), ("src/math.ts",)], "file_path string")
    said = spark.createDataFrame([("src/math.ts", 3)], "path string, n long")
    pack = diff.review_pack(files, s, ranges, edges, a, 2, debts, said)
    assert [tuple(r) for r in pack.orderBy("file_path").collect()] == [("src/gone.ts", "D", 0, 0, 0, 0, 0, 3, True), ("src/math.ts", "M", 2, 1, 1, 2, 3, 3, True)]
    assert {r["risk"] for r in diff.risks(pack).collect()} == {"has open debt markers", "1 changed symbol(s) have no matching test", "3 past failure record(s) mention this file"}
    block = spark.createDataFrame([("text",)], "t string").select(diff.inject_block(F.col("t"), F.lit("one")).alias("t"))
    assert block.select(diff.inject_block(F.col("t"), F.lit("one"))).first()[0] == block.first()["t"]


def test_evaluation(spark):
    cols = "task_id string, success boolean, attempts int, repeated_failures int, duration_ms bigint, input_tokens bigint"
    a = spark.createDataFrame([("a", True, 1, 0, 100, 1000), ("b", False, 3, 1, 400, 2000), ("c", True, 2, 1, 300, 3000)], cols)
    b = spark.createDataFrame([("a", True, 1, 0, 80, 700), ("b", True, 2, 1, 200, 1200), ("c", True, 1, 0, 160, 1700)], cols)
    m = evaluate.metrics(a).first()
    assert (round(m["completion"], 4), round(m["first_pass"], 4), m["repeated"], m["median_ms"], m["mean_tokens"]) == (0.6667, 0.3333, 2, 200.0, 2000.0)
    d = evaluate.deltas(a, b).first()
    assert (round(d["d_completion"], 4), round(d["d_first_pass"], 4), round(d["d_repeated_rate"], 4), d["d_repeated"], d["d_median_ms"], d["d_mean_tokens"]) == (0.3333, 0.3333, -0.3333, -1, -40.0, -800.0)
    assert evaluate.metrics(a.where("not success")).first()["median_ms"] is None
    assert evaluate.unpaired(a, b.where("task_id <> 'b'")).collect() == [("b", "treatment")]
    bad = spark.createDataFrame([("a", True, 1, 1, 0, 0), ("a", True, 1, 0, 0, 0), (" ", True, 1, 0, 0, 0)], cols)
    assert {r["problem"] for r in evaluate.invalid(bad).collect()} == {"more repeated failures than retries", "task named twice", "task_id is empty"}


def test_markers(spark):
    rows = [(1, "a.ts", "// rin: later, if slow\nx = `\n// rin: not this\n`\n  # rin: plain"), (2, "b.py", 'print("// rin: text")'), (3, None, None)]
    got = markers.debt_markers(spark.createDataFrame(rows, "k long, p string, c string"), "k", "p", "c").collect()
    assert [(r["line_no"], r["comment"], r["has_upgrade"]) for r in got] == [(1, "later, if slow", True), (5, "plain", False)]


def test_extraction():
    src = "import { b as c } from './m';\nexport * from './all';\nexport { x as y } from './some';\nexport function run(a) {\n  return c(a);\n}\nexport class K extends Base {\n}\nconst f = async () => {\n}\n"
    symbols, reexports = extract.parse_file("a.ts", src)
    assert [(s[0], s[1], s[2], s[3]) for s in symbols] == [("run", "function", 4, 6), ("K", "class", 7, 8), ("f", "variable", 9, 10)]
    assert ("c", "call", None) in symbols[0][5] and ("c", "import", "./m") in symbols[0][5] and ("Base", "implements", None) in symbols[1][5]
    assert reexports == [("./all", "*", "*"), ("./some", "x", "y")]
    py, _ = extract.parse_file("a.py", "@d\ndef f():\n    pass\n\nclass C:\n    def m(self):\n        pass\n")
    assert [(s[0], s[1], s[2], s[3]) for s in py] == [("f", "function", 1, 3), ("C", "class", 5, 7), ("m", "function", 6, 7)]
    assert [s[0] for s in extract.parse_file("a.go", "func (r *T) Name(a int) {\n}\ntype T struct {\n}\n")[0]] == ["Name", "T"]
    assert [s[0] for s in extract.parse_file("a.rs", "pub async fn go(x: u8) {\n}\npub struct S {\n}\n")[0]] == ["go", "S"]
    assert extract.parse_file("a.txt", "def x(): pass") == ([], [])


def test_index_and_watch(spark, tmp_path):
    root, store = tmp_path / "src", tmp_path / "store"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.py").write_text("def a():\n    pass\n")
    (root / "b.py").write_text("def b():\n    pass\n")
    (root / "node_modules" / "c.py").write_text("def c(): pass\n")
    (root / "n.txt").write_text("x")
    assert index_tree(spark, str(root), str(store)) == {"indexed": 2, "failed": 0, "purged": 0}
    assert index_tree(spark, str(root), str(store)) == {"indexed": 0, "failed": 0, "purged": 0}
    (root / "b.py").unlink()
    (root / "a.py").write_text("def a2():\n    return 1\n")
    (root / "bad.py").write_bytes(b"\xff\xfe\x00bad")
    assert index_tree(spark, str(root), str(store)) == {"indexed": 1, "failed": 1, "purged": 1}
    assert [r["name"] for r in BucketedTable(spark, f"{store}/symbols").read().collect()] == ["a2"]
    live = tmp_path / "live"
    q = watcher.watch(spark, str(root), str(live), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert {r["name"] for r in BucketedTable(spark, f"{live}/symbols").read().collect()} == {"a2"}
    assert not watcher.progress(q)["active"]
    (root / "a.py").write_text("x = 1\n")  # a file that has lost its symbols loses its rows
    (root / "d.py").write_text("def d():\n    pass\n")
    watcher.watch(spark, str(root), str(live), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert {r["name"] for r in BucketedTable(spark, f"{live}/symbols").read().collect()} <= {"a2", "d"}
    watcher.watch(spark, str(root), str(tmp_path / "live2"), str(tmp_path / "cp2"), once=True).awaitTermination(120)
    assert {r["name"] for r in BucketedTable(spark, f"{tmp_path}/live2/symbols").read().collect()} == {"d"}
    assert {r["file_path"]: r["symbol_count"] for r in BucketedTable(spark, f"{tmp_path}/live2/files").read().collect()} == {"a.py": 0, "d.py": 1}
    (root / "a.py").unlink()
    assert watcher.reconcile(spark, str(root), str(live)) == 1


def test_replace_keeps_rows_of_failed_files(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "file_path string, name string")
    fresh = spark.createDataFrame([("a", None, "boom"), ("b", "z", None)], "file_path string, name string, error string")
    assert {tuple(r) for r in replace_files(old, fresh).collect()} == {("a", "x"), ("b", "z")}


def test_lines(spark):
    f = spark.createDataFrame([(1, "a\nB\nc\nb"), (2, None)], "k long, c string")
    assert [(r["line_no"], r["line"]) for r in tree.grep(f, "k", "c", "b", 1).collect()] == [(2, "B")]
    assert tree.line_range(f, "k", "c", 2, 99).where("k = 1").first()["text"] == "B\nc\nb"


def test_provider(spark):
    def search(query, limit):
        if query == "down":
            raise ValueError("private words")
        return [{"text": query, "wing": "w", "room": "r", "source_file": "f", "similarity": 0.5}] * 3

    spark.dataSource.register(provider_source("stub", search))
    assert spark.read.format("stub").option("query", "q" * 300).option("limit", "2").load().collect() == [("q" * 250, "w", "r", "f", 0.5)] * 2
    with pytest.raises(Exception, match="the provider failed"):
        spark.read.format("stub").option("query", "down").load().collect()
    more = provider_source("more", search, taxonomy=lambda q, n: {"w": {"r": 2, "s": 1}}, status=lambda q, n: {"ok": True}, get=lambda q, n: [{"id": q, "wing": "w", "room": "r", "content": "c"}])
    spark.dataSource.register(more)
    read = lambda action: sorted(spark.read.format("more").option("action", action).option("query", "d1").load().collect())
    assert read("taxonomy") == [("w", "r", 2), ("w", "s", 1)] and read("status") == [("ok", "True")] and read("get") == [("d1", "w", "r", "c")]
    with pytest.raises(Exception, match="no list"):
        read("list")


def test_buckets_are_rewritten_alone(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), 4)
    assert t.read() is None
    df = lambda rows: spark.createDataFrame(rows, "file_path string, name string")
    first = df([(f"f{k}", f"n{k}") for k in range(20)])
    assert t.replace(first, first) == [0, 1, 2, 3]
    touched = t.replace(df([("f3", "new"), ("f3", "more")]), df([("f3", None)]))
    assert len(touched) == 1
    got = {(r["file_path"], r["name"]) for r in t.read().collect()}
    assert len(got) == 21 and {("f3", "new"), ("f3", "more")} <= got and ("f3", "n3") not in got
    t.replace(df([]), first)
    assert t.read().count() == 0 and t.expire(1) >= 1 and t.read().count() == 0


def test_versions_expire(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "v"))
    for k in range(4):
        t.write(spark.range(k + 1))
    assert t.expire(1) == 3 and t.read().count() == 4


def test_memories_written_can_be_read(spark, tmp_path):
    rows = mem(spark, [{"id": "proj-a/one", "title": "One", "scope": "proj-a", "body": "b"}, {"id": "../x", "title": "No", "body": "b"}, {"id": "general/two", "title": "Two é", "body": ""}])
    assert memory_files.write_memories(rows, str(tmp_path / "m")) == 2
    back = memory_files.read_memories(spark, str(tmp_path / "m")).collect()
    assert {(r["id"], r["title"]) for r in back} == {("proj-a/one", "One"), ("general/two", "Two é")}


def test_memory_lookups(spark):
    rows = mem(spark, [{"id": "proj-a/one", "title": "One", "scope": "Proj A", "collection": "Big Ones"}, {"id": "proj-a/two", "title": "Two", "scope": "Proj A", "invalidated": True}])
    assert memory.get_memory(rows, "Proj A/One").count() == 1
    assert memory.find_by_title(rows, "proj a", "Two").count() == 1 and memory.find_by_title(rows, "proj a", "two").count() == 0
    assert memory.list_memories(rows, "proj-a").count() == 1 and memory.list_memories(rows, "proj-a", include_invalidated=True).count() == 2
    assert memory.list_memories(rows, collection="big-ones").count() == 1
    verdicts = memory.imported_docs(mem(spark, [{"id": "x/one", "title": "Other", "scope": "proj-a"}, {"id": "x/two", "title": "Two", "scope": "proj-a"}, {"id": "x/new", "title": "New", "scope": "proj-a", "type": "Decision"}]), rows)
    assert {(r["id"], r["verdict"], r["collection"]) for r in verdicts.collect()} == {("proj-a/one", "clash", "general"), ("proj-a/two", "replace", "general"), ("proj-a/new", "write", "decisions")}
    assert memory.manifest(rows).first()["n"] == 2 and memory.scope_index(rows).count() == 2


@pytest.mark.parametrize("links", [10, 1000])
def test_long_logs_are_chained_in_levels(spark, monkeypatch, links):
    monkeypatch.setattr(failures, "LINKS", links)
    rng = random.Random(4)
    rows = [(k * 3, "s", "c" if k % 3 else "d", rng.random() < 0.3, rng.random() < 0.1) for k in range(3000)]
    df = spark.createDataFrame(rows, "failure_id long, scope string, command string, ok boolean, retry boolean")
    got = {r["failure_id"]: (r["state_before"], r["state_after"], r["refused"]) for r in failures.guard_batch(df, ["scope", "command"], "failure_id", "ok", "retry", 7).collect()}
    state = {}
    for i, s, c, ok, retry in rows:
        before = state.get((s, c), "CLEAN")
        after, refused = failures.next_state(before, ok, retry)
        assert got[i] == (before, after, refused)
        state[s, c] = after


def test_failure_is_settled_by_a_later_success(spark):
    from tessera.operators import failures

    rows = [(1, None, "a", "x", False, False), (2, None, "a", "y", False, False), (3, None, "a", None, True, False), (4, None, "a", None, True, True), (5, None, "b", "z", False, False), (6, None, "a", "x", False, False)]
    df = spark.createDataFrame(rows, "failure_id long, scope string, command string, symptom string, ok boolean, retry boolean")
    guarded = failures.guard_batch(df, ["scope", "command"], "failure_id", "ok", "retry", 2)
    got = {(r["command"], r["symptom"]): (r["n"], r["status"]) for r in failures.settled_records(df, ["scope", "command"], "failure_id", "symptom", guarded).collect()}
    assert got == {("a", "x"): (2, "unresolved"), ("a", "y"): (1, "resolved"), ("b", "z"): (1, "unresolved")}

"""Queries of the context response, the graph around a query, impact, hand-over and ingest, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import context as C
from tessera.operators import diff as D
from tessera.operators import evaluate as E
from tessera.operators import failures as FL
from tessera.operators import graph as G
from tessera.operators import memory as M
from tessera.plans import analysis_queries as A
from tessera.plans import retrieval_queries as R
from tessera.plans import store_queries as S
from tessera.plans.cut import Cutter
from tessera.session import table
from tessera.sources import extract, markers, memory_files, store, tree
from tessera.streaming import guard

QUERY = "where is the vault token"

# --- the graph with imports and re-exports

#: A few files beside the table, for the ways that its own rows don't take.
FIX_SYMBOLS = [
    ("fx/moduleA.ts", "zhandler", "function", []), ("fx/moduleB.ts", "zhandler", "function", []), ("fx/run.ts", "zrun", "function", [("zhandler", "call", None), ("zhandler", "import", "./moduleA")]),
    ("fx/user.ts", "zuser", "function", [("zhandler", "call", None), ("zhandler", "import", "./barrel")]), ("fx/barrel.ts", "zbarrel", "variable", []),
    ("fx/origin.ts", "zorigin", "function", []), ("fx/elsewhere.ts", "zorigin", "function", []), ("fx/mid.ts", "zmid", "variable", []), ("fx/caller.ts", "zcaller", "function", [("zalias", "call", None), ("zalias", "import", "./mid")]),
    ("src/index/zwidget.ts", "zwidget", "class", []), ("other/zwidget.ts", "zwidget", "class", []), ("fx/app.ts", "zapp", "function", [("zwidget", "call", None), ("zwidget", "import", "@app/zwidget")]),
    ("fx/plain.ts", "zplain", "function", [("zhandler", "call", None)]), ("fx/home.ts", "zhome", "function", [("ztwin", "call", None)]), ("fx/home.ts", "ztwin", "function", []), ("fx/away.ts", "ztwin", "function", []),
]
FIX_REEXPORTS = [("fx/barrel.ts", "./moduleA", "*", "*"), ("fx/mid.ts", "./origin", "zorigin", "zalias")]


def _fixed_symbols(spark: SparkSession, d: str) -> DataFrame:
    columns = "id long, file_path string, name string, type string, start_line int, refs array<struct<name:string,type:string,specifier:string>>"
    more = spark.createDataFrame([(-1 - k, p, n, t, 1, refs) for k, (p, n, t, refs) in enumerate(FIX_SYMBOLS)], columns)
    return table(spark, d, "symbols").select("id", "file_path", "name", "type", "start_line", "refs").unionByName(more)


def _fixed_exports(spark: SparkSession, symbols: DataFrame) -> DataFrame:
    raw = spark.createDataFrame(FIX_REEXPORTS, "file_path string, specifier string, imported string, exported string")
    nodes = G.symbol_nodes(symbols)
    led = raw.join(G.resolve_specifiers(raw, nodes), ["file_path", "specifier"])
    return G.expand_reexports(nodes.select("file_path", "name"), led.select("file_path", "target", "imported", "exported"))


def graph_imports(spark: SparkSession, d: str) -> DataFrame:
    """All references of the graph with imports, aliases and re-exports, those of a few files beside the table included."""
    symbols = _fixed_symbols(spark, d)
    return G.build_edges(symbols, _fixed_exports(spark, symbols), A.ALIASES).where("type <> 'contains'")


def graph_exports(spark: SparkSession, d: str) -> DataFrame:
    """What each file exports, by itself and through re-exports."""
    known = _fixed_exports(spark, _fixed_symbols(spark, d))
    return G.export_map(known).select("file_path", F.array_join("names", ",").alias("names"))


# --- around a query


def graph_match(spark: SparkSession, d: str) -> DataFrame:
    return G.match_nodes(A.stored_nodes(spark, d), "vault session", 25)


def graph_query_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_query(A.stored_nodes(spark, d), A.calls(spark, d), "vault session")[0]


def graph_query_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_query(A.stored_nodes(spark, d), A.calls(spark, d), "vault session")[1]


def _ends(spark: SparkSession, d: str) -> tuple[str, str]:
    """The first node of the changed file that calls anything, and the last of those three steps from it."""
    calls = A.calls(spark, d)
    start = calls.join(A.seeds(spark, d).select(F.col("node").alias("src")), "src", "left_semi").agg(F.min("src")).first()[0]
    far = G.reach(calls, spark.createDataFrame([(start,)], "node string"), "both", 3).where("depth = 3").agg(F.max("node")).first()[0]
    return start, far or start


def graph_path(spark: SparkSession, d: str) -> DataFrame:
    return G.shortest_path(A.calls(spark, d), *_ends(spark, d))


def graph_top(spark: SparkSession, d: str) -> DataFrame:
    """The edges between the 400 nodes of highest degree."""
    return G.top_subgraph(A.stored_nodes(spark, d), A.stored_edges(spark, d))[1]


def graph_detail(spark: SparkSession, d: str) -> DataFrame:
    """Callers and callees of the hubs."""
    hubs = G.hubs(A.stored_nodes(spark, d), A.stored_edges(spark, d).where("type <> 'contains'"), 20)
    return G.node_detail(A.stored_edges(spark, d), hubs)


def graph_labels(spark: SparkSession, d: str) -> DataFrame:
    return G.labels_like(A.stored_nodes(spark, d), " Merge").select("node", "name")


def graph_pool(spark: SparkSession, d: str) -> DataFrame:
    """What searches find around a name, level by level."""
    found, _ = G.neighbourhood(R.symbol_index(spark, d), table(spark, d, "symbols"), ["mergeAlert"], 300)
    return found.select(F.col("key").alias("id"))


def impact_first(spark: SparkSession, d: str) -> DataFrame:
    """The nearest hundred that depend on the changed file."""
    return A.graph_impact(spark, d).orderBy("depth", "node").limit(100)


def impact_tests(spark: SparkSession, d: str) -> DataFrame:
    """The tests of the changed file and of all that depends on it."""
    nodes = A.stored_nodes(spark, d)
    affected = nodes.join(A.graph_impact(spark, d).select("node").unionByName(A.seeds(spark, d).select("node")), "node", "left_semi")
    docs = table(spark, d, "documents").where("text is not null and path is not null").select(F.concat(F.lit("docs/test/"), "path").alias("path"), F.col("text").alias("content"))
    return D.impact_tests(affected, D.test_associations(table(spark, d, "symbols"), docs))


def heat_markers(spark: SparkSession, d: str) -> DataFrame:
    symbols = table(spark, d, "symbols")
    found = markers.debt_markers(symbols, "id", "file_path", "content", "todo").join(symbols.select("id", G.clean_path(F.col("file_path")).alias("file_path")), "id")
    return D.marker_heat(found, A.stored_nodes(spark, d))


def heat_failures(spark: SparkSession, d: str) -> DataFrame:
    """How many failures name the files that memories come from, by their last name."""
    files = table(spark, d, "memories").where("source like '%/%'").select(G.clean_path(F.col("source")).alias("file_path")).distinct()
    return D.failure_heat(table(spark, d, "failures"), "failure_id", "symptom", files.select(F.concat(F.lit("file:"), "file_path").alias("node"), "file_path"))


def review_risks(spark: SparkSession, d: str) -> DataFrame:
    return D.risks(A.review_files(spark, d))


# --- the response


def _results(spark: SparkSession, d: str) -> DataFrame:
    return C.hybrid_results(R.symbol_index(spark, d), table(spark, d, "symbols"), A.stored_edges(spark, d), QUERY, 20)


def context_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Lexical hits and their neighbours in the graph."""
    return _results(spark, d)


def context_response(spark: SparkSession, d: str) -> DataFrame:
    """The whole response at budgets small and large: never over budget, and nothing lost between included and dropped."""
    symbols, memories = table(spark, d, "symbols"), table(spark, d, "memories").where("not coalesce(invalidated, false)")
    results = Cutter(spark, "context").cut(_results(spark, d))
    chunks, structural = C.collected_chunks(results, symbols), results.where("pass = 3").count()
    rows = []
    for budget in (100, 500, 2000, 8000, 100_000):
        said = C.memory_text(R.memory_index(spark, d), memories, QUERY, budget // 5)
        text, included, dropped = C.respond(QUERY, chunks, budget, said, structural, ["changed: " + "x " * 400], ["- test/a.test.ts"] * 30)
        rows.append((budget, C.surrogate(text) <= budget, len(chunks), included + dropped >= min(1, len(chunks)), C.surrogate(said) <= budget // 5))
    return spark.createDataFrame(rows, "budget int, fits boolean, n_chunks int, looked_at boolean, memories_fit boolean")


def context_baseline(spark: SparkSession, d: str) -> DataFrame:
    """What reading the whole files of the results would cost."""
    return C.baseline_tokens(_results(spark, d), table(spark, d, "symbols"))


# --- memories and sessions


def memory_get(spark: SparkSession, d: str) -> DataFrame:
    """Every version of the memory that was superseded last, asked for by its untidy name."""
    m = table(spark, d, "memories")
    name = m.where("supersedes is not null and supersedes <> ''").agg(F.max_by("supersedes", "rev_id")).first()[0] or ""
    return M.get_memory(m, name.upper()).select("rev_id", "title")


def memory_by_title(spark: SparkSession, d: str) -> DataFrame:
    """All rows that share scope and title with the newest memory of the general scope."""
    m = table(spark, d, "memories")
    title = m.where("scope = 'general' and title is not null").agg(F.max_by("title", "rev_id")).first()[0] or ""
    return M.find_by_title(m, "General", title).select("rev_id", "invalidated")


def memory_list(spark: SparkSession, d: str) -> DataFrame:
    return M.list_memories(table(spark, d, "memories"), "General", "Decisions").select("rev_id")


def memory_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imported memories moved into the general scope, judged against what is there."""
    m = table(spark, d, "memories")
    return M.imported_docs(m.where("source = 'import'"), m.where("coalesce(source, '') <> 'import'"), "general")


def memory_index_lines(spark: SparkSession, d: str) -> DataFrame:
    return M.scope_index(table(spark, d, "memories"))


def memory_log(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "memories").where("id is not null and title is not null").select(F.col("rev_id").alias("at"), F.when(F.col("invalidated"), "invalidate").otherwise("store").alias("action"), "id", "title")
    return M.log_lines(changes)


def memory_manifest(spark: SparkSession, d: str) -> DataFrame:
    return M.manifest(table(spark, d, "memories")).select("n", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"))


def memory_tree(spark: SparkSession, d: str) -> DataFrame:
    """Rooms and files of an export, by wing."""
    return M.tree_counts(memory_files.export_tree(table(spark, d, "memories")))


def session_handover(spark: SparkSession, d: str) -> DataFrame:
    symbols = table(spark, d, "symbols")
    found = markers.debt_markers(symbols, "id", "file_path", "content", "todo")
    dirty = symbols.where("file_path is not null").select("file_path", F.lit("M").alias("status")).distinct()
    return memory_files.session_sections(table(spark, d, "memories"), table(spark, d, "failures"), markers=found, dirty=dirty).select("section", "rev_id", "title")


def session_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Memories written as one hand-over each and read again."""
    text = F.concat(F.lit("# Session\n\n## Memories\n\n### "), F.coalesce(F.regexp_replace("title", r"\s+", " "), F.lit("x")), F.lit("\n"), F.regexp_replace(F.coalesce("description", F.lit("")), r"[#\r\n]", " "), F.lit("\n\n## Other\n\n### not this one\nx\n"))
    rows = table(spark, d, "memories").select("rev_id", text.alias("text"))
    return memory_files.parse_session(rows, "rev_id", "text").select("rev_id", "place", "title")


# --- failures


def failure_fields(spark: SparkSession, d: str) -> DataFrame:
    """What is read back from the bodies of failure records."""
    rows = table(spark, d, "failures").withColumn("body", M.failure_body())
    b = F.col("body")
    return rows.select("failure_id", T.legacy_command(b).alias("command"), T.do_not_retry(b).alias("advice"), T.next_path(b).alias("next_path"))


def failure_settled(spark: SparkSession, d: str) -> DataFrame:
    """Records of commands and symptoms, resolved by a later success that was run."""
    f = table(spark, d, "failures").select("failure_id", "scope", "command", "symptom", "ok", "retry_known_failure")
    guarded = Cutter(spark, "settled").cut(FL.guard_batch(f, ["scope", "command"], "failure_id", "ok", "retry_known_failure", 2000))
    return FL.settled_records(f, ["scope", "command"], "failure_id", "symptom", guarded).select("last", "n", "status")


def failure_stream(spark: SparkSession, d: str) -> DataFrame:
    """The guard over the same log as a stream."""
    place = Cutter(spark, "guard").folder
    source = table(spark, d, "failures")
    files = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    name = source.inputFiles()[0]
    folder = name[: name.index("failures.parquet")] + ("failures.parquet" if "failures.parquet/" in name else "")
    stream = (files if "failures.parquet/" in name else files.option("pathGlobFilter", "failures.parquet")).parquet(folder)
    out = guard.guard_stream(stream.select("failure_id", "scope", "command", "ok", "retry_known_failure"))
    out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out")


# --- evaluation and text


def latency(spark: SparkSession, d: str) -> DataFrame:
    return E.latency(table(spark, d, "events"), "event_type", "value")


def outcome_report(spark: SparkSession, d: str) -> DataFrame:
    return E.report_lines(A.outcome_deltas(spark, d))


INVALID = [("a", True, 1, 1, 5, 5), ("b", True, 0, 0, 5, 5), ("", True, 1, 0, 5, 5), ("c", None, 1, 0, 5, 5), ("d", True, 2, 1, -1, 5), ("e", True, 1, 0, 1, 1), ("e", True, 1, 0, 1, 1)]


def outcome_invalid(spark: SparkSession, d: str) -> DataFrame:
    rows = A._arm(spark, d, False).select("task_id", "success", "attempts", F.col("repeated_failures").cast("int").alias("repeated_failures"), "duration_ms", "input_tokens")
    more = spark.createDataFrame(INVALID, "task_id string, success boolean, attempts int, repeated_failures int, duration_ms long, input_tokens long")
    return E.invalid(rows.unionByName(more))


def percents(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("score is not null")
    return c.select("chunk_id", T.percent_text(F.round("score", 3)).alias("share"), T.signed_text(F.round(F.col("score") * 10 - 5, 1), " pp").alias("change"))


def capped_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.cap_text(F.col("text"), 1000), 256).alias("sha"))


def handoff_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A block put into each document, and put in again with other words."""
    once = D.inject_block(F.coalesce("text", F.lit("")), F.lit("first"))
    twice = D.inject_block(F.col("one"), F.lit("second"))
    return table(spark, d, "documents").select("doc_id", once.alias("one")).select("doc_id", F.sha2(twice, 256).alias("sha"))


# --- sources


def source_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines 3 to 8 of every document."""
    return tree.line_range(table(spark, d, "documents"), "doc_id", "text", 3, 8).select("doc_id", F.sha2("text", 256).alias("sha"))


def source_walk(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "symbols").where("file_path is not null").select("file_path").distinct()
    return tree.walk(files, 3, "e")


def source_admitted(spark: SparkSession, d: str) -> DataFrame:
    """Paths of symbols and memories that an index would take, with a project's own rules."""
    rules = tree.read_ignores("generated/\n*.rs\n!pkg/**/*.rs\n")
    paths = table(spark, d, "symbols").select("file_path").unionByName(table(spark, d, "memories").select(F.col("source").alias("file_path"))).where("file_path is not null").distinct()
    return paths.where(tree.should_index(F.col("file_path"), (), rules))


def source_hashes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return tree.with_hash(rows).select("doc_id", "content_hash")


def commit_log(spark: SparkSession, d: str) -> DataFrame:
    """Commits written as a log and read again, twenty lines of each patch kept."""
    c = table(spark, d, "commits")
    said = F.coalesce(F.regexp_replace("message", r"\s+", " "), F.lit("-"))
    text = F.concat(F.lit("commit "), "hash", F.lit("\nAuthor: "), F.coalesce("author", F.lit("-")), F.lit("\nDate:   "), F.coalesce("date", F.lit("-")), F.lit("\n\n    "), said, F.lit("\n\n"), F.coalesce("diff", F.lit("")), F.lit("\n"))
    rows = c.where(r"hash rlike '^[0-9a-f]{7,40}$'").select("commit_id", text.alias("text"))
    parsed = D.git_log(rows, "text", keep="commit_id")
    return parsed.select("commit_id", "hash", "date", F.sha2("message", 256).alias("message"), F.regexp_count("diff", F.lit("(?m)^[+@-]")).alias("n_lines"))


def extract_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose own text, read as a file, declares their name; of the variables those of scripts, as others are no symbols."""
    symbols = table(spark, d, "symbols").where("content is not null and name is not null")
    symbols = symbols.where(~((F.col("type") == "variable") & F.lower("file_path").rlike(r"\.(py|go|java|rs)\W*$")) | F.col("file_path").isNull())
    ending = F.regexp_replace(F.lower(F.regexp_extract("file_path", r"\.([A-Za-z]+)\W*$", 1)), "^$", "ts")
    files = symbols.select(F.concat(F.col("id").cast("string"), F.lit("/a."), ending).alias("file_path"), "content")
    found = extract.extract_symbols(files).where("error is null")
    own = found.select(F.substring_index("file_path", "/", 1).cast("long").alias("id"), "name").distinct()
    return own.join(symbols.select("id", "name"), ["id", "name"], "left_semi").select("id", "name")


def index_replace(spark: SparkSession, d: str) -> DataFrame:
    """An index of files after a batch: new rows for what was read, old ones for what failed, none for what is gone."""
    docs = table(spark, d, "documents").where("path is not null").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none"))).alias("file_path"), F.col("doc_id").alias("n"), "ts", F.lower(F.coalesce("lang", F.lit(""))).alias("l"))
    old = docs.where("ts < '2025-09-01'").select("file_path", "n")
    fresh = docs.where("ts >= '2025-09-01'").select("file_path", "n", F.when(F.col("l") == "fr", "failed").alias("error"))
    gone = docs.where("l = 'de'").select("file_path").distinct()
    return store.replace_files(old, fresh, gone).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("first"))


QUERIES = {
    f.__name__: f
    for f in (
        graph_imports, graph_exports, graph_match, graph_query_nodes, graph_query_edges, graph_path, graph_top, graph_detail, graph_labels, graph_pool, impact_first, impact_tests, heat_markers, heat_failures, review_risks,
        context_hybrid, context_response, context_baseline, memory_get, memory_by_title, memory_list, memory_imports, memory_index_lines, memory_log, memory_manifest, memory_tree, session_handover, session_blocks,
        failure_fields, failure_settled, failure_stream, latency, outcome_report, outcome_invalid, percents, capped_texts, handoff_blocks, source_lines, source_walk, source_admitted, source_hashes, commit_log, extract_symbols, index_replace,
    )
}

# --- SQL


def _refs(refs: list[tuple]) -> str:
    rows = ", ".join("{" + f"'name': '{n}', 'type': '{t}', 'specifier': {'NULL' if s is None else repr(s)}" + "}" for n, t, s in refs)
    return f"CAST([{rows}] AS STRUCT(name VARCHAR, type VARCHAR, specifier VARCHAR)[])"


_FIX = " UNION ALL ".join(f"SELECT {-1 - k}, '{p}', '{n}', '{t}', 1, {_refs(refs)}" for k, (p, n, t, refs) in enumerate(FIX_SYMBOLS))
_REX = ", ".join(str(r) for r in FIX_REEXPORTS)
_BASE_R = A._BASE
_EXPORTS = f"""
ex0 AS (SELECT * FROM (VALUES {_REX}) v(file_path, specifier, imported, exported)),
ex1 AS (SELECT e.file_path, e.imported, e.exported, arg_min(f.file_path, k) AS target FROM (SELECT *, {_BASE_R} AS base FROM ex0) e, {A._SUFFIX}, (SELECT DISTINCT file_path FROM node) f WHERE f.file_path = base || suffix GROUP BY ALL),
ex2 AS (SELECT file_path AS at_file, name AS at_name, file_path AS origin, name AS origin_name, 0 AS pass FROM (SELECT DISTINCT file_path, name FROM node)
  UNION SELECT e.file_path, CASE imported WHEN '*' THEN at_name ELSE exported END, origin, origin_name, pass + 1 FROM ex1 e JOIN ex2 ON ex2.at_file = e.target AND imported IN ('*', at_name) WHERE pass < 5),
ex3 AS (SELECT at_file, at_name, min({{'p': pass, 'o': origin, 'n': origin_name}}) AS m FROM ex2 GROUP BY ALL),
expo AS (SELECT at_file, at_name, m.o AS origin, m.n AS origin_name FROM ex3),"""
_FIXED = A._GRAPH.replace("FROM symbols WHERE name", f"FROM (SELECT id, file_path, name, type, start_line, refs FROM symbols UNION ALL {_FIX}) WHERE name")
_FIXED = _FIXED.replace("cnt AS (SELECT name", _EXPORTS + "\ncnt AS (SELECT name", 1)
_FIXED = _FIXED.replace("cls AS (SELECT r.*, i.target,", "cls AS (SELECT r.*, coalesce(x.origin, i.target) AS target, coalesce(x.origin_name, ref_name) AS goal_name,")
_FIXED = _FIXED.replace("LEFT JOIN cnt c ON c.name = ref_name LEFT JOIN here g ON g.file_path = i.target AND g.name = ref_name", "LEFT JOIN expo x ON x.at_file = i.target AND x.at_name = ref_name LEFT JOIN cnt c ON c.name = ref_name LEFT JOIN here g ON g.file_path = coalesce(x.origin, i.target) AND g.name = coalesce(x.origin_name, ref_name)")
_FIXED = _FIXED.replace("JOIN node n ON n.name = c.ref_name AND (kind IN ('one', 'any') OR kind = 'import' AND n.file_path = c.target OR", "JOIN node n ON n.name = CASE kind WHEN 'import' THEN c.goal_name ELSE c.ref_name END AND (kind IN ('one', 'any') OR kind = 'import' AND n.file_path = c.target OR")

_G = A._GRAPH.rstrip()
_SCORE = "CASE WHEN h = 'vault session' THEN 100 WHEN contains(h, 'vault session') THEN 50 ELSE 0 END + contains(h, 'vault')::INT + contains(h, 'session')::INT"
_MATCH = f"mat AS (SELECT node, {_SCORE} AS score FROM (SELECT node, lower(name || ' ' || file_path) AS h FROM node) WHERE {_SCORE} > 0 ORDER BY score DESC, node LIMIT %d)"
_AROUND = f"{_MATCH % 5}, wk AS (SELECT node, 0 AS depth FROM mat UNION SELECT b, depth + 1 FROM wk JOIN ways ON a = node WHERE depth < 5), aro AS (SELECT node, min(depth) AS depth FROM wk GROUP BY node ORDER BY 2, 1 LIMIT 40)"
_HYBRID = f""",
lex AS (SELECT x.*, s.content, 'symbol:' || {A._CLEAN} || ':' || s.name || ':' || coalesce(s.start_line, 0) AS node FROM ({R._symbol_sql(QUERY, 20)}) x JOIN symbols s USING (id)),
nea AS (SELECT DISTINCT b AS node FROM (SELECT src AS a, dst AS b FROM call WHERE type = 'call' UNION SELECT dst, src FROM call WHERE type = 'call') WHERE a IN (SELECT node FROM lex WHERE node IS NOT NULL) AND b NOT IN (SELECT node FROM lex WHERE node IS NOT NULL) ORDER BY 1 LIMIT 6),
hyb AS (SELECT id, node, pass, score::DOUBLE AS score FROM lex
  UNION ALL SELECT max(s.id), n.node, 3, (SELECT greatest(least(min(score), 1) - 0.5, 0) FROM lex) FROM nea n JOIN (SELECT id, 'symbol:' || {A._CLEAN} || ':' || name || ':' || coalesce(start_line, 0) AS node FROM symbols) s USING (node) GROUP BY n.node)"""
_ACTIVE = "NOT coalesce(invalidated, false)"
_SLUG = "left(regexp_replace(regexp_replace(lower(%s), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80)"
_KIND = "CASE type WHEN 'Decision' THEN 'decisions' WHEN 'FailureRecord' THEN 'failures' ELSE 'general' END"

SQL = {
    "graph_imports": _FIXED + "SELECT * FROM edge WHERE type <> 'contains'",
    "graph_exports": _FIXED + "SELECT at_file AS file_path, string_agg(at_name, ',' ORDER BY at_name) AS names FROM expo GROUP BY at_file",
    "graph_match": _G + f", {_MATCH % 25} SELECT * FROM mat",
    "graph_query_nodes": _G + f", {_AROUND} SELECT * FROM aro",
    "graph_query_edges": _G + f", {_AROUND} SELECT * FROM call WHERE src IN (SELECT node FROM aro) AND dst IN (SELECT node FROM aro)",
    "graph_path": _G
    + """,
st AS (SELECT min(src) AS node FROM call WHERE src IN (SELECT node FROM seed)), pw AS (SELECT node, 0 AS depth FROM st UNION SELECT b, depth + 1 FROM pw JOIN ways ON a = node WHERE depth < 3),
ds AS (SELECT node, min(depth) AS depth FROM pw GROUP BY node), go AS (SELECT coalesce(max(node) FILTER (WHERE depth = 3), (SELECT node FROM st)) AS node FROM ds),
ty AS (SELECT src AS a, dst AS b, type FROM call UNION SELECT dst, src, type FROM call),
pr AS (SELECT t.b AS node, d2.depth, min({'a': t.a, 't': t.type}) AS p FROM ty t JOIN ds d1 ON d1.node = t.a JOIN ds d2 ON d2.node = t.b AND d2.depth = d1.depth + 1 GROUP BY ALL),
bk AS (SELECT g.node, d.depth, p.p FROM go g JOIN ds d USING (node) LEFT JOIN pr p ON p.node = g.node UNION ALL SELECT b.p.a, b.depth - 1, p.p FROM bk b LEFT JOIN pr p ON p.node = b.p.a WHERE b.depth > 0)
SELECT depth AS step, node, CASE WHEN depth > 0 THEN p.t END AS via FROM bk""",
    "graph_top": _G + ", dg AS (SELECT n.node, coalesce(k, 0) AS k FROM (SELECT DISTINCT node FROM node) n LEFT JOIN (SELECT e AS node, count(*) AS k FROM (SELECT unnest([src, dst]) AS e FROM edge) GROUP BY e) USING (node)), tp AS (SELECT node FROM dg ORDER BY k DESC, node LIMIT 400) SELECT * FROM edge WHERE src IN (SELECT node FROM tp) AND dst IN (SELECT node FROM tp)",
    "graph_detail": _G + f", hu AS (SELECT node FROM ({A._DEGREE}) ORDER BY degree DESC, node LIMIT 20), cl AS (SELECT DISTINCT src, dst FROM edge WHERE type <> 'contains'), sd AS (SELECT dst AS node, 'caller' AS side, src AS other FROM cl UNION ALL SELECT src, 'callee', dst FROM cl) SELECT node, side, other FROM sd WHERE node IN (SELECT node FROM hu) QUALIFY row_number() OVER (PARTITION BY node, side ORDER BY other) <= 12",
    "graph_labels": _G + " SELECT node, name FROM node WHERE contains(lower(name), 'merge')",
    "impact_first": A.SQL["graph_impact"] + " ORDER BY depth, node LIMIT 100",
    "impact_tests": _G + f", {A._mention(False)}, aff AS (SELECT name, file_path FROM node WHERE node IN (SELECT node FROM up)) SELECT DISTINCT test_file FROM men m JOIN aff a ON a.name = m.symbol_name AND a.file_path = m.source_file",
    "heat_markers": _G + f", mk AS (SELECT {A._CLEAN} AS file_path FROM ({A.SQL['debt_markers']}) m JOIN symbols USING (id)) SELECT node, count(*) AS n FROM node JOIN mk ON node.file_path = mk.file_path OR ends_with(node.file_path, '/' || mk.file_path) GROUP BY node",
    "heat_failures": "WITH node AS (SELECT DISTINCT 'file:' || " + A._CLEAN.replace("file_path", "source") + " AS node, " + A._CLEAN.replace("file_path", "source") + r""" AS file_path FROM memories WHERE source LIKE '%/%'), tk AS (SELECT failure_id, unnest(list_distinct(regexp_extract_all(symptom, '[A-Za-z0-9_./-]*[A-Za-z0-9_]\.[A-Za-z0-9_]{1,8}'))) AS token FROM failures),
tl AS (SELECT DISTINCT failure_id, unnest(list_transform(range(1, len(string_split(token, '/')) + 1), lambda i: array_to_string(string_split(token, '/')[i:], '/'))) AS path FROM tk), cn AS (SELECT path, count(*) AS n FROM tl GROUP BY path)
SELECT node, n FROM node JOIN cn ON cn.path = string_split(file_path, '/')[-1]""",
    "review_risks": f"""WITH pack AS ({A.SQL["review_files"]}) SELECT file_path, 'has open debt markers' AS risk FROM pack WHERE n_debts > 0
UNION ALL SELECT file_path, n_untested || ' changed symbol(s) have no matching test' FROM pack WHERE n_untested > 0 UNION ALL SELECT file_path, n_failures || ' past failure record(s) mention this file' FROM pack WHERE n_failures > 0""",
    "context_hybrid": _G + _HYBRID + " SELECT * FROM hyb",
    "context_response": _G + _HYBRID + " SELECT b AS budget, true AS fits, (SELECT count(*) FROM hyb)::INT AS n_chunks, true AS looked_at, true AS memories_fit FROM (VALUES (100), (500), (2000), (8000), (100000)) v(b)",
    "context_baseline": _G + _HYBRID + f" SELECT {A._CLEAN} AS file_path, sum({R._count_sql("coalesce(content, '')")})::BIGINT AS tokens FROM symbols WHERE {A._CLEAN} IN (SELECT {A._CLEAN} FROM symbols WHERE id IN (SELECT id FROM hyb)) GROUP BY 1",
    "memory_get": f"""WITH w AS (SELECT arg_max(supersedes, rev_id) AS s FROM memories WHERE supersedes <> '') SELECT rev_id, title FROM memories, w WHERE id = array_to_string(list_transform(string_split(s, '/'), lambda p: {_SLUG % 'p'}), '/')""",
    "memory_by_title": f"SELECT rev_id, invalidated FROM memories WHERE coalesce(nullif({_SLUG % 'scope'}, ''), 'general') = 'general' AND title = (SELECT arg_max(title, rev_id) FROM memories WHERE scope = 'general' AND title IS NOT NULL)",
    "memory_list": f"SELECT rev_id FROM memories WHERE {_ACTIVE} AND coalesce(nullif({_SLUG % 'scope'}, ''), 'general') = 'general' AND {_SLUG % 'collection'} = 'decisions'",
    "memory_imports": f"""WITH m AS (SELECT rev_id, title, coalesce(nullif({_SLUG % "coalesce(collection, '')"}, ''), {_KIND}) AS collection, 'general/' || {_SLUG % "string_split(id, '/')[-1]"} AS id FROM memories WHERE source = 'import' AND id IS NOT NULL),
h AS (SELECT id, min(title) AS a, max(title) AS b FROM memories WHERE coalesce(source, '') <> 'import' GROUP BY id)
SELECT m.rev_id, m.id, m.collection, CASE WHEN h.a IS NULL THEN 'write' WHEN a = title AND b = title THEN 'replace' ELSE 'clash' END AS verdict FROM m LEFT JOIN h USING (id)""",
    "memory_index_lines": "SELECT DISTINCT coalesce(scope, 'general') AS scope, id, '* [' || coalesce(title, '') || '](./' || string_split(id, '/')[-1] || '.md) - ' || coalesce(description, '') AS line FROM memories WHERE id IS NOT NULL",
    "memory_log": "SELECT rev_id AS at, '* **' || CASE WHEN invalidated THEN 'invalidate' ELSE 'store' END || '**: ' || title || ' (`' || id || '`)' AS line FROM memories WHERE id IS NOT NULL AND title IS NOT NULL",
    "memory_manifest": "SELECT count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM memories",
    "memory_tree": f"""SELECT coalesce(nullif({_SLUG % "coalesce(scope, 'general')"}, ''), 'general') AS wing, count(DISTINCT coalesce(nullif({_SLUG % f"coalesce(collection, {_KIND})"}, ''), 'general')) AS n_rooms, count(*) AS n_files FROM memories WHERE {_ACTIVE} AND id IS NOT NULL GROUP BY 1""",
    "session_handover": f"""SELECT * FROM (SELECT 'memories' AS section, rev_id, title FROM memories WHERE {_ACTIVE} ORDER BY ts DESC NULLS LAST, rev_id DESC LIMIT 15)
UNION ALL SELECT * FROM (SELECT 'unresolved', failure_id, left(command, 80) FROM failures WHERE status = 'unresolved' ORDER BY failure_id DESC LIMIT 10) UNION ALL SELECT * FROM (SELECT 'resolved', failure_id, left(command, 80) FROM failures WHERE status = 'resolved' ORDER BY failure_id DESC LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'markers', id, left(comment, 80) FROM ({A.SQL['debt_markers']}) ORDER BY id, line_no LIMIT 10) UNION ALL SELECT * FROM (SELECT DISTINCT 'dirty', NULL::BIGINT, file_path FROM symbols WHERE file_path IS NOT NULL ORDER BY 3 LIMIT 20)""",
    "session_blocks": r"SELECT rev_id, 0 AS place, trim(coalesce(regexp_replace(title, '\s+', ' ', 'g'), 'x')) AS title FROM memories",
    "failure_fields": "SELECT failure_id, CASE WHEN contains(command, chr(10)) THEN NULL ELSE command END AS command, nullif(trim(do_not_retry), '') AS advice, nullif(trim(next_path), '') AS next_path FROM failures",
    "latency": "SELECT event_type, count(*) AS n, min(value) AS min_ms, median(value) AS median_ms, max(value) AS max_ms FROM events WHERE value IS NOT NULL GROUP BY 1",
    "outcome_report": f"""WITH d AS ({A.SQL["outcome_deltas"]}), l AS (SELECT unnest([{{'name': 'completion', 'v': d_completion * 100, 's': ' pp'}}, {{'name': 'first_pass', 'v': d_first_pass * 100, 's': ' pp'}}, {{'name': 'repeated_rate', 'v': d_repeated_rate * 100, 's': ' pp'}}, {{'name': 'repeated', 'v': d_repeated, 's': ''}}, {{'name': 'median_ms', 'v': d_median_ms, 's': ''}}, {{'name': 'mean_tokens', 'v': d_mean_tokens, 's': ''}}]) AS x FROM d),
r AS (SELECT x.name AS name, round(x.v, 1) AS v, x.s AS s FROM l) SELECT name, CASE WHEN v > 0 THEN '+' ELSE '' END || CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE printf('%.1f', v) END || s AS value FROM r""",
    "outcome_invalid": f"""WITH o AS (SELECT * FROM ({A._ARM % 'false'}) UNION ALL SELECT * FROM (VALUES {", ".join(str(r).replace("None", "NULL") for r in INVALID)}) v(task_id, success, attempts, repeated_failures, duration_ms, input_tokens))
SELECT * FROM (SELECT task_id, CASE WHEN coalesce(trim(task_id), '') = '' THEN 'task_id is empty' WHEN success IS NULL THEN 'success is missing' WHEN attempts < 1 THEN 'attempts below 1' WHEN repeated_failures < 0 THEN 'repeated_failures below 0' WHEN repeated_failures > attempts - 1 THEN 'more repeated failures than retries'
  WHEN duration_ms < 0 THEN 'duration_ms below 0' WHEN input_tokens < 0 THEN 'input_tokens below 0' END AS problem FROM o) WHERE problem IS NOT NULL UNION ALL SELECT task_id, 'task named twice' FROM o GROUP BY 1 HAVING count(*) > 1""",
    "percents": "SELECT chunk_id, printf('%.1f', round(score, 3) * 100) || '%' AS share, CASE WHEN v > 0 THEN '+' ELSE '' END || CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE printf('%.1f', v) END || ' pp' AS change FROM (SELECT *, round(score * 10 - 5, 1) AS v FROM chunks WHERE score IS NOT NULL)",
    "capped_texts": "SELECT doc_id, sha256(CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 1000) || chr(10) || '… ' || (length(text) - 1000) || ' more characters truncated' END) AS sha FROM documents",
    "handoff_blocks": "SELECT doc_id, sha256(coalesce(text, '') || chr(10) || chr(10) || '<!-- handoff:start -->' || chr(10) || 'second' || chr(10) || '<!-- handoff:end -->') AS sha FROM documents",
    "source_lines": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) SELECT doc_id, sha256(array_to_string(ls[least(3, len(ls)):least(8, len(ls))], chr(10))) AS sha FROM l",
    "source_walk": "SELECT DISTINCT file_path FROM symbols WHERE len(string_split(file_path, '/')) <= 3 AND contains(file_path, 'e') AND NOT list_bool_or(list_transform(string_split(file_path, '/'), lambda p: starts_with(p, '.') OR p IN ('node_modules', 'dist')))",
    "source_admitted": r"""WITH p AS (SELECT DISTINCT file_path FROM (SELECT file_path FROM symbols UNION ALL SELECT source FROM memories) WHERE file_path IS NOT NULL)
SELECT file_path FROM p WHERE regexp_matches(lower(file_path), '\.(ts|tsx|mts|cts|js|jsx|mjs|py|go|rs|java)$') AND NOT list_bool_or(list_transform(string_split(file_path, '/'), lambda x: starts_with(x, '.') OR x IN ('node_modules', '.git', 'dist', 'build', 'coverage', '.next', '.nuxt', '.DS_Store')))
AND NOT contains(file_path, '/../') AND CASE WHEN regexp_matches(file_path, '^pkg/(.*/)?[^/]*\.rs(/|$)') THEN true ELSE NOT regexp_matches(file_path, '\.rs(/|$)') AND NOT regexp_matches(file_path, '(^|/)generated/') END""",
    "source_hashes": "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents",
    "commit_log": r"SELECT commit_id, hash, trim(coalesce(date, '-')) AS date, sha256(trim(coalesce(regexp_replace(message, '\s+', ' ', 'g'), '-'))) AS message, least(20, len(list_filter(string_split(coalesce(diff, ''), chr(10)), lambda x: regexp_matches(x, '^[+@-]') AND NOT regexp_matches(x, '^(\+\+\+|---) ')))) AS n_lines FROM commits WHERE regexp_matches(hash, '^[0-9a-f]{7,40}$')",
    "index_replace": """WITH d AS (SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS file_path, doc_id AS n, ts, lower(coalesce(lang, '')) AS l FROM documents WHERE path IS NOT NULL),
f AS (SELECT file_path, n FROM d WHERE ts >= TIMESTAMPTZ '2025-09-01 00:00:00+00' AND l <> 'fr'), o AS (SELECT file_path, n FROM d WHERE ts < TIMESTAMPTZ '2025-09-01 00:00:00+00' AND file_path NOT IN (SELECT file_path FROM f) AND file_path NOT IN (SELECT file_path FROM d WHERE l = 'de'))
SELECT file_path, count(*) AS n, min(n) AS first FROM (SELECT * FROM o UNION ALL SELECT * FROM f) GROUP BY 1""",
}
SQL["failure_stream"] = S.SQL["failure_guard"]
SQL["failure_settled"] = f"""WITH g AS ({S.SQL["failure_guard"]}), r AS (SELECT f.failure_id, f.scope, f.command, f.symptom, coalesce(f.ok, false) AS ok FROM failures f JOIN g USING (failure_id) WHERE NOT refused),
s AS (SELECT scope, command, max(failure_id) AS solved FROM r WHERE ok GROUP BY ALL), b AS (SELECT scope, command, symptom, count(*) AS n, max(failure_id) AS last FROM r WHERE NOT ok GROUP BY ALL)
SELECT last, n, CASE WHEN solved > last THEN 'resolved' ELSE 'unresolved' END AS status FROM b LEFT JOIN s ON s.scope IS NOT DISTINCT FROM b.scope AND s.command IS NOT DISTINCT FROM b.command"""
SQL["extract_symbols"] = r"SELECT id, name FROM symbols WHERE content IS NOT NULL AND name IS NOT NULL AND NOT coalesce(type = 'variable' AND regexp_matches(lower(file_path), '\.(py|go|java|rs)\W*$'), false)"

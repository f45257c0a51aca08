"""Graph, diff, ingest and evaluation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import diff as D
from tessera.operators import evaluate as E
from tessera.operators import graph as G
from tessera.plans.stored import stored_table
from tessera.session import table
from tessera.sources import markers as K
from tessera.sources import tree as S

ALIASES = [("@app/*", "src/index/*")]


def stored_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the symbol graph, built once and read by every query on it."""
    symbols = table(spark, d, "symbols")
    return stored_table(spark, "edges", symbols.select("id", "file_path", "name", "type", "start_line", "refs"), lambda: G.build_edges(symbols, aliases=ALIASES))


def stored_nodes(spark: SparkSession, d: str) -> DataFrame:
    symbols = table(spark, d, "symbols")
    return stored_table(spark, "nodes", symbols.select("id", "file_path", "name", "type", "start_line"), lambda: G.symbol_nodes(symbols))


def graph_build(spark: SparkSession, d: str) -> DataFrame:
    """All edges of the symbol graph with confidence and reason, built anew."""
    return G.build_edges(table(spark, d, "symbols"), aliases=ALIASES)


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """The stored edges."""
    return stored_edges(spark, d)


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(stored_nodes(spark, d), stored_edges(spark, d).where("type <> 'contains'"))


def graph_hubs(spark: SparkSession, d: str) -> DataFrame:
    return G.hubs(stored_nodes(spark, d), stored_edges(spark, d).where("type <> 'contains'"), 20)


def graph_report(spark: SparkSession, d: str) -> DataFrame:
    """Edges by type and confidence."""
    return stored_edges(spark, d).groupBy("type", "confidence").agg(F.count(F.lit(1)).alias("n"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    return G.visible(stored_edges(spark, d)).where("type <> 'contains'")


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """Where the walks start: the symbols of the file that was changed."""
    return stored_nodes(spark, d).where("file_path = 'src/generated/api_surface.ts'")


def graph_reach(spark: SparkSession, d: str) -> DataFrame:
    """What the symbols of one file reach within three steps, edges taken both ways."""
    return G.reach(calls(spark, d), seeds(spark, d), "both", 3)


def graph_impact(spark: SparkSession, d: str) -> DataFrame:
    """Who depends on the symbols of the generated file, two steps deep."""
    return G.impact(stored_edges(spark, d), seeds(spark, d), 2)


def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbours(stored_edges(spark, d), seeds(spark, d), 6)


def import_targets(spark: SparkSession, d: str) -> DataFrame:
    """The file each import leads to."""
    symbols = table(spark, d, "symbols")
    imports = symbols.select(G.clean_path(F.col("file_path")).alias("file_path"), F.explode("refs").alias("r")).where("r.type = 'import'").select("file_path", "r.specifier")
    return G.resolve_specifiers(imports, G.symbol_nodes(symbols), ALIASES)


def reexport_origins(spark: SparkSession, d: str) -> DataFrame:
    """Every function's origin through export symbols that stand in several files, as a chain of re-exports."""
    symbols = table(spark, d, "symbols").where("name is not null and file_path is not null")
    clean = symbols.select(G.clean_path(F.col("file_path")).alias("file_path"), "name", "type").distinct()
    direct = clean.where("type = 'function'").select("file_path", "name")
    folder = F.regexp_replace("file_path", r"/[^/]*$", "")
    barrels = clean.select(F.concat(folder, F.lit("/index")).alias("file_path"), F.col("file_path").alias("target"), F.lit("*").alias("imported"), F.lit("*").alias("exported")).distinct()
    return G.expand_reexports(direct, barrels)


# --- diffs and tests


def commit_hunks(spark: SparkSession, d: str) -> DataFrame:
    return D.hunk_ranges(table(spark, d, "commits"), "commit_id", "diff")


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    """Hunks laid over files: a commit changes the file of each symbol that its message names, if only one file has the name."""
    symbols = table(spark, d, "symbols").where("name is not null and file_path is not null").select("name", G.clean_path(F.col("file_path")).alias("file_path")).distinct()
    owners = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("file_path").alias("file_path")).where("n = 1").drop("n")
    commits = table(spark, d, "commits")
    named = commits.where("message is not null").select("commit_id", F.explode(F.array_distinct(F.regexp_extract_all("message", F.lit(r"([A-Za-z_]\w{3,})"), F.lit(1)))).alias("name"))
    return named.join(owners, "name").join(D.hunk_ranges(commits, "commit_id", "diff"), "commit_id").select("file_path", "start", "end")


def changed_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose lines a hunk touches."""
    symbols = table(spark, d, "symbols").select("id", G.clean_path(F.col("file_path")).alias("file_path"), "name", "start_line", "end_line")
    return D.changed_symbols(symbols, _ranges(spark, d)).select("id", "name")


def _as_tests(spark: SparkSession, d: str) -> DataFrame:
    """All documents, taken as test files that mention symbols, and two that import them."""
    docs = table(spark, d, "documents").where("text is not null and path is not null").select(F.concat(F.lit("docs/test/"), "path").alias("path"), F.col("text").alias("content"))
    return docs.unionByName(spark.createDataFrame(TESTS, "path string, content string"))


def _with_tested(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "symbols").select("file_path", "name")
    return rows.unionByName(spark.createDataFrame(TESTED, "file_path string, name string"))


TESTED = [("lib/sum.ts", "addAll"), ("lib/other.ts", "addAll"), ("lib/sum.ts", "subtractAll"), ("lib/index.ts", "onlyHere")]
TESTS = [("test/sum.test.ts", "import { addAll as add } from '../lib/sum';\nimport onlyHere from '../lib';\nimport { subtractAll } from 'sums';\ntest(add);"), ("test/mention.test.ts", "// subtractAll and addAll are mentioned")]


def review_files(spark: SparkSession, d: str) -> DataFrame:
    """A review pack's table over the changed files, with debt markers and failures that name them."""
    symbols = table(spark, d, "symbols")
    clean = symbols.withColumn("file_path", G.clean_path(F.col("file_path")))
    ranges = _ranges(spark, d)
    marked = K.debt_markers(symbols, "id", "file_path", "content", "todo").join(clean.select("id", "file_path"), "id")
    failures = table(spark, d, "failures")
    mentions = D.mentions_of_paths(failures, "failure_id", "next_path", clean.select("file_path"))
    return D.review_pack(ranges, clean, ranges, stored_edges(spark, d), D.test_associations(symbols, _as_tests(spark, d)), 30, marked, mentions)


def symbol_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that test files import or mention."""
    return D.test_associations(_with_tested(spark, d), _as_tests(spark, d))


def untested_symbols(spark: SparkSession, d: str) -> DataFrame:
    symbols = _with_tested(spark, d).where("name is not null and file_path is not null").select(G.clean_path(F.col("file_path")).alias("file_path"), "name").distinct()
    return D.untested(symbols, symbol_mentions(spark, d))


def path_heat(spark: SparkSession, d: str) -> DataFrame:
    """How many failures name each file that a memory comes from."""
    files = table(spark, d, "memories").where("source like '%/%'").select(G.clean_path(F.col("source")).alias("file_path"))
    return D.mentions_of_paths(table(spark, d, "failures"), "failure_id", "symptom", files)


def debt_markers(spark: SparkSession, d: str) -> DataFrame:
    """Marker comments of all symbols."""
    return K.debt_markers(table(spark, d, "symbols"), "id", "file_path", "content", "todo")


def debt_ledger(spark: SparkSession, d: str) -> DataFrame:
    return K.debt_ledger(debt_markers(spark, d))


# --- ingest


def index_diff(spark: SparkSession, d: str) -> DataFrame:
    """Files of a snapshot against a state: new, stale, unchanged, gone.

    A document is a version of the file that its path without its number names. The state is what
    the files held at CUTOFF, the snapshot what they hold since a year before it: every version of
    every file is in one of them.
    """
    docs = table(spark, d, "documents").where("path is not null").select(F.regexp_replace("path", r"-\d+(\.\w+)?$", "$1").alias("file_path"), "text", "ts", "doc_id")
    newest = F.max_by(F.struct("text", "ts"), F.struct(F.coalesce("ts", F.lit("0001-01-01").cast("timestamp")), "doc_id")).alias("v")
    content = F.coalesce("v.text", F.lit(""))

    def held(rows: DataFrame) -> DataFrame:
        one = rows.groupBy("file_path").agg(newest)
        return one.select("file_path", F.sha2(content, 256).alias("content_hash"), F.length(content).cast("long").alias("size"), F.coalesce(F.unix_millis("v.ts"), F.lit(0)).alias("mtime_ms"))

    before = held(docs.where(f"ts is null or ts < '{CUTOFF}'"))
    now = held(docs.where(f"ts >= '{CUTOFF}' - interval 365 days"))
    return S.classify_files(now, before)


CUTOFF = "2025-12-01"


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    symbols = table(spark, d, "symbols")
    return symbols.groupBy(F.lower(F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1)).alias("extension")).agg(F.count(F.lit(1)).alias("n_symbols"), F.countDistinct("file_path").alias("n_files"), F.date_format(F.max("indexed_at"), "yyyy-MM-dd HH:mm:ss").alias("newest"))


def frequent_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "symbols").where(F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]{4,}$"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(5)


def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that match an expression, at most 5 of a file."""
    return S.grep(table(spark, d, "symbols"), "id", "content", "vault\\(", 5)


# --- evaluation


def _arm(spark: SparkSession, d: str, retried: bool) -> DataFrame:
    f = table(spark, d, "failures").where(F.coalesce("retry_known_failure", F.lit(False)) == retried)
    return f.groupBy(F.coalesce("scope", F.lit("general")).alias("task_id")).agg(
        F.max(F.coalesce("ok", F.lit(False))).alias("success"), F.count(F.lit(1)).cast("int").alias("attempts"), (F.count_if(~F.coalesce("ok", F.lit(False))) - 1).cast("int").alias("r"),
        F.sum(F.length("command")).cast("long").alias("duration_ms"), F.sum(F.coalesce(F.length("symptom"), F.lit(0))).cast("long").alias("input_tokens"),
    ).withColumn("repeated_failures", F.greatest(F.col("r"), F.lit(0)))


def outcome_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.metrics(_arm(spark, d, False))


def outcome_deltas(spark: SparkSession, d: str) -> DataFrame:
    return E.deltas(_arm(spark, d, False), _arm(spark, d, True))


def outcome_unpaired(spark: SparkSession, d: str) -> DataFrame:
    return E.unpaired(_arm(spark, d, False), _arm(spark, d, True))


QUERIES = {
    f.__name__: f
    for f in (
        graph_build, graph_edges, graph_degrees, graph_hubs, graph_report, graph_reach, graph_impact, graph_neighbours, import_targets, reexport_origins, commit_hunks, changed_symbols, review_files, symbol_mentions,
        untested_symbols, path_heat, debt_markers, debt_ledger, index_diff, index_stats, frequent_names, grep_lines, outcome_metrics, outcome_deltas, outcome_unpaired,
    )
}

_CLEAN = "array_to_string(list_filter(string_split(replace(file_path, '\\', '/'), '/'), lambda x: x <> '' AND x <> '.'), '/')"
_UP = "regexp_replace(regexp_replace(%s, '[^/]+/\\.\\./', ''), '[^/]+/\\.\\./', '')"
_SUFFIX = "(VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '/index.ts'), (6, '/index.tsx'), (7, '/index.js'), (8, '/index.jsx')) x(k, suffix)"
_BASE = f"CASE WHEN starts_with(specifier, '.') THEN {_UP % ('replace(regexp_replace(file_path, ' + chr(39) + '[^/]*$' + chr(39) + ', ' + chr(39) * 2 + ') || specifier, ' + chr(39) + '/./' + chr(39) + ', ' + chr(39) + '/' + chr(39) + ')')} WHEN starts_with(specifier, '@app/') THEN 'src/index/' || substr(specifier, 6) END"

_GRAPH = rf"""
WITH RECURSIVE sym AS (SELECT id, {_CLEAN} AS file_path, name, type, start_line, refs FROM symbols WHERE name IS NOT NULL AND file_path IS NOT NULL),
node AS (SELECT 'symbol:' || file_path || ':' || name || ':' || coalesce(start_line, 0) AS node, file_path, name, start_line, arg_max(type, id) AS type FROM sym GROUP BY ALL),
raw AS (SELECT 'symbol:' || file_path || ':' || name || ':' || coalesce(start_line, 0) AS node, file_path, name AS owner, refs, unnest(refs) AS r FROM sym),
ref AS (SELECT DISTINCT node, file_path, owner, r.name AS ref_name, r.type AS ref_type, list_filter(refs, lambda i: i.type = 'import' AND i.name = r.name)[-1].specifier AS specifier FROM raw WHERE r.type <> 'import'),
pair AS (SELECT DISTINCT file_path, specifier FROM ref WHERE specifier IS NOT NULL),
imp AS (SELECT p.file_path, p.specifier, arg_min(f.file_path, k) AS target FROM (SELECT *, {_BASE} AS base FROM pair) p, {_SUFFIX}, (SELECT DISTINCT file_path FROM node) f WHERE f.file_path = base || suffix GROUP BY ALL),
cnt AS (SELECT name, count(*) AS n FROM node GROUP BY name), here AS (SELECT file_path, name, count(*) AS n FROM node GROUP BY ALL),
cls AS (SELECT r.*, i.target, CASE WHEN c.n = 1 THEN 'one' WHEN g.n > 0 THEN 'import' WHEN c.n IS NULL THEN NULL WHEN coalesce(h.n, 0) - (owner = ref_name)::INT > 0 THEN 'home' ELSE 'any' END AS kind
  FROM ref r LEFT JOIN imp i ON i.file_path = r.file_path AND i.specifier = r.specifier LEFT JOIN cnt c ON c.name = ref_name LEFT JOIN here g ON g.file_path = i.target AND g.name = ref_name LEFT JOIN here h ON h.file_path = r.file_path AND h.name = ref_name),
lnk AS (
  SELECT c.node AS src, n.node AS dst, ref_type AS type, CASE kind WHEN 'any' THEN 'INFERRED' ELSE 'EXTRACTED' END AS confidence,
    CASE kind WHEN 'one' THEN 'only symbol of the name' WHEN 'import' THEN 'imported file' WHEN 'home' THEN 'same file' ELSE 'ambiguous name' END AS reason
  FROM cls c JOIN node n ON n.name = c.ref_name AND (kind IN ('one', 'any') OR kind = 'import' AND n.file_path = c.target OR kind = 'home' AND n.file_path = c.file_path) WHERE c.node <> n.node),
edge AS (
  SELECT 'file:' || file_path AS src, node AS dst, 'contains' AS type, 'EXTRACTED' AS confidence, 'declared in file' AS reason FROM node
  UNION ALL SELECT src, dst, type, min({{'c': confidence, 'r': reason}}).c, min({{'c': confidence, 'r': reason}}).r FROM lnk GROUP BY src, dst, type),
call AS (SELECT * FROM edge WHERE confidence = 'EXTRACTED' AND type <> 'contains'),
seed AS (SELECT node FROM node WHERE file_path = 'src/generated/api_surface.ts'),
ways AS (SELECT src AS a, dst AS b FROM call UNION SELECT dst, src FROM call),
walk AS (SELECT node, 0 AS depth FROM seed UNION SELECT b, depth + 1 FROM walk JOIN ways ON a = node WHERE depth < 3),
up AS (SELECT node, 0 AS depth FROM seed UNION SELECT src, depth + 1 FROM up JOIN call ON dst = node WHERE depth < 2)
"""
_DEGREE = "SELECT n.node, coalesce(d.degree, 0) AS degree FROM (SELECT DISTINCT node FROM node) n LEFT JOIN (SELECT e AS node, count(*) AS degree FROM (SELECT unnest([src, dst]) AS e FROM edge WHERE type <> 'contains') GROUP BY e) d USING (node)"
_HUNKS = r"""h0 AS (SELECT commit_id, list_filter(string_split(diff, chr(10)), lambda x: starts_with(x, '@@ ')) AS hs FROM commits WHERE diff IS NOT NULL),
h1 AS (SELECT commit_id, unnest(hs) AS line, generate_subscripts(hs, 1) - 1 AS hunk FROM h0),
h2 AS (SELECT commit_id, hunk, regexp_extract(line, '\+(\d+)(?:,(\d+))?', 1) AS s, regexp_extract(line, '\+(\d+)(?:,(\d+))?', 2) AS c FROM h1),
h3 AS (SELECT commit_id, hunk, s::BIGINT AS s, CASE WHEN c = '' THEN 1 ELSE c::BIGINT END AS c FROM h2 WHERE s <> ''),
hunks AS (SELECT commit_id, hunk, CASE WHEN c = 0 THEN s + 1 ELSE s END AS start, CASE WHEN c = 0 THEN s ELSE s + c - 1 END AS "end" FROM h3)"""
_CHANGED = f"""{_HUNKS}, csym AS (SELECT id, {_CLEAN} AS file_path, name, start_line, end_line FROM symbols),
onl AS (SELECT name, min(file_path) AS file_path FROM (SELECT DISTINCT name, file_path FROM csym WHERE name IS NOT NULL AND file_path IS NOT NULL) GROUP BY name HAVING count(*) = 1),
nmd AS (SELECT DISTINCT commit_id, unnest(regexp_extract_all(message, '[A-Za-z_][A-Za-z0-9_]{{3,}}')) AS name FROM commits),
rng AS (SELECT o.file_path, h.start, h."end" FROM nmd JOIN onl o USING (name) JOIN hunks h USING (commit_id)),
hit AS (SELECT id, file_path, name, start_line FROM csym s WHERE EXISTS (SELECT 1 FROM rng r WHERE r.file_path = s.file_path AND s.start_line <= r."end" AND s.end_line >= r.start))"""
_VALUES = lambda rows: ", ".join("(" + ", ".join("'" + c.replace("'", "''") + "'" for c in r) + ")" for r in rows)


def _mention(tested: bool) -> str:
    """Which tests go with a symbol: imports by where they lead, else mentions of a name that one file has."""
    more = f" UNION SELECT name, file_path FROM (VALUES {_VALUES(TESTED)}) v(file_path, name)" if tested else ""
    return rf"""src AS (SELECT DISTINCT name, {_CLEAN} AS source_file FROM symbols WHERE name IS NOT NULL AND NOT regexp_matches(file_path, '{"|".join(T.TEST_FILES)}'){more}),
own AS (SELECT name, count(*) AS owners, min(source_file) AS only_file FROM src GROUP BY name),
tst AS (SELECT 'docs/test/' || path AS test_file, text FROM documents WHERE text IS NOT NULL AND path IS NOT NULL UNION ALL SELECT * FROM (VALUES {_VALUES(TESTS)}) v(test_file, text)),
im0 AS (SELECT test_file, unnest(regexp_extract_all(text, 'import\s+\{{[^}}]+\}}\s+from\s+[''"][^''"]+[''"]')) AS i FROM tst),
im1 AS (SELECT test_file, unnest(string_split(regexp_extract(i, '\{{([^}}]+)\}}', 1), ',')) AS n, regexp_extract(i, 'from\s+[''"]([^''"]+)', 1) AS specifier FROM im0
  UNION ALL SELECT test_file, regexp_extract(i, 'import\s+(\w+)', 1), regexp_extract(i, 'from\s+[''"]([^''"]+)', 1) FROM (SELECT test_file, unnest(regexp_extract_all(text, 'import\s+[A-Za-z_]\w*\s+from\s+[''"][^''"]+[''"]')) AS i FROM tst)),
imt AS (SELECT DISTINCT test_file, regexp_replace(trim(n), '\s+as\s+.*$', '') AS name, specifier FROM im1 WHERE trim(n) <> ''),
gol AS (SELECT imt.*, regexp_replace(regexp_replace(test_file, '[^/]*$', '') || specifier, '[^/]+/\.\./', '') AS goal FROM imt),
bim AS (SELECT DISTINCT g.name AS symbol_name, source_file, test_file, 'import' AS confidence FROM gol g JOIN src USING (name) JOIN own USING (name)
  WHERE CASE WHEN starts_with(specifier, '.') THEN source_file = goal OR regexp_replace(source_file, '\.[^./]+$', '') IN (goal, goal || '/index') ELSE owners = 1 END),
wrd AS (SELECT DISTINCT test_file, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))) AS name FROM tst),
men AS (SELECT * FROM bim UNION ALL SELECT w.name, only_file, test_file, 'mention' FROM wrd w JOIN own USING (name) WHERE owners = 1 AND length(w.name) >= 4 AND NOT EXISTS (SELECT 1 FROM imt WHERE imt.test_file = w.test_file AND imt.name = w.name))"""


_MENTION = _mention(True)
_ARM = """SELECT coalesce(scope, 'general') AS task_id, max(coalesce(ok, false)) AS success, count(*) AS attempts, greatest(count(*) FILTER (WHERE NOT coalesce(ok, false)) - 1, 0) AS repeated_failures,
sum(length(command))::BIGINT AS duration_ms, sum(coalesce(length(symptom), 0))::BIGINT AS input_tokens FROM failures WHERE coalesce(retry_known_failure, false) = %s GROUP BY 1"""
_METRICS = """SELECT count(*) AS tasks, count(*) FILTER (WHERE success) / count(*) AS completion, count(*) FILTER (WHERE success AND attempts = 1) / count(*) AS first_pass, count(*) FILTER (WHERE repeated_failures > 0) / count(*) AS repeated_rate,
sum(repeated_failures)::BIGINT AS repeated, median(duration_ms) FILTER (WHERE success) AS median_ms, avg(input_tokens) AS mean_tokens FROM (%s)"""

SQL = {
    "graph_build": _GRAPH + "SELECT * FROM edge",
    "graph_edges": _GRAPH + "SELECT * FROM edge",
    "graph_degrees": _GRAPH + _DEGREE,
    "graph_hubs": _GRAPH + f"SELECT * FROM ({_DEGREE}) ORDER BY degree DESC, node LIMIT 20",
    "graph_report": _GRAPH + "SELECT type, confidence, count(*) AS n FROM edge GROUP BY ALL",
    "graph_reach": _GRAPH + "SELECT node, min(depth) AS depth FROM walk GROUP BY node",
    "graph_impact": _GRAPH + "SELECT node, min(depth) AS depth FROM up GROUP BY node HAVING min(depth) > 0",
    "graph_neighbours": _GRAPH
    + "SELECT DISTINCT b AS node FROM (SELECT src AS a, dst AS b FROM call WHERE type = 'call' UNION SELECT dst, src FROM call WHERE type = 'call') WHERE a IN (SELECT node FROM node WHERE file_path = 'src/generated/api_surface.ts') AND b NOT IN (SELECT node FROM node WHERE file_path = 'src/generated/api_surface.ts') ORDER BY node LIMIT 6",
    "import_targets": f"""WITH sym AS (SELECT {_CLEAN} AS file_path, name, refs FROM symbols WHERE file_path IS NOT NULL), pair AS (SELECT DISTINCT file_path, r.specifier AS specifier FROM (SELECT file_path, unnest(refs) AS r FROM sym) WHERE r.type = 'import' AND r.specifier IS NOT NULL)
SELECT p.file_path, p.specifier, arg_min(f.file_path, k) AS target FROM (SELECT *, {_BASE} AS base FROM pair) p, {_SUFFIX}, (SELECT DISTINCT file_path FROM sym WHERE name IS NOT NULL) f WHERE f.file_path = base || suffix GROUP BY ALL""",
    "reexport_origins": f"""WITH sym AS (SELECT DISTINCT {_CLEAN} AS file_path, name, type FROM symbols WHERE name IS NOT NULL AND file_path IS NOT NULL),
d AS (SELECT DISTINCT file_path, name FROM sym WHERE type = 'function'), b AS (SELECT DISTINCT regexp_replace(file_path, '/[^/]*$', '') || '/index' AS file_path, file_path AS target FROM sym),
s AS (SELECT b.file_path, d.name, min(d.file_path) AS origin FROM b JOIN d ON d.file_path = b.target WHERE (b.file_path, d.name) NOT IN (SELECT (file_path, name) FROM d) GROUP BY ALL)
SELECT file_path, name, file_path AS origin, name AS origin_name FROM d UNION ALL SELECT file_path, name, origin, name FROM s""",
    "commit_hunks": f"WITH {_HUNKS} SELECT * FROM hunks",
    "changed_symbols": f"WITH {_CHANGED} SELECT id, name FROM hit",
    "symbol_mentions": f"WITH {_MENTION} SELECT * FROM men",
    "untested_symbols": f"""WITH {_MENTION}, s AS (SELECT DISTINCT {_CLEAN} AS file_path, name FROM symbols WHERE name IS NOT NULL AND file_path IS NOT NULL UNION SELECT file_path, name FROM (VALUES {_VALUES(TESTED)}) v(file_path, name))
SELECT * FROM s WHERE NOT regexp_matches(file_path, '{"|".join(T.TEST_FILES)}') AND NOT EXISTS (SELECT 1 FROM men h WHERE h.symbol_name = s.name AND h.source_file = s.file_path)""",
    "path_heat": rf"""WITH t AS (SELECT failure_id, unnest(list_distinct(regexp_extract_all(symptom, '[A-Za-z0-9_./-]*[A-Za-z0-9_]\.[A-Za-z0-9_]{{1,8}}'))) AS token FROM failures),
p AS (SELECT failure_id, string_split(token, '/') AS ps FROM t), u AS (SELECT DISTINCT failure_id, unnest(list_transform(range(1, len(ps) + 1), lambda i: array_to_string(ps[i:], '/'))) AS path FROM p)
SELECT path, count(*) AS n FROM u WHERE path IN (SELECT {_CLEAN.replace('file_path', 'source')} FROM memories WHERE source LIKE '%/%') GROUP BY path""",
    "index_diff": rf"""WITH d AS (SELECT regexp_replace(path, '-\d+(\.\w+)?$', '\1') AS file_path, coalesce(text, '') AS text, ts, doc_id FROM documents WHERE path IS NOT NULL),
b AS (SELECT * FROM d WHERE ts IS NULL OR ts < TIMESTAMPTZ '{CUTOFF} 00:00:00+00' QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY ts DESC NULLS LAST, doc_id DESC) = 1),
n AS (SELECT * FROM d WHERE ts >= TIMESTAMPTZ '{CUTOFF} 00:00:00+00' - INTERVAL 365 DAYS QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY ts DESC, doc_id DESC) = 1)
SELECT coalesce(n.file_path, b.file_path) AS file_path, CASE WHEN b.file_path IS NULL THEN 'new' WHEN n.file_path IS NULL THEN 'gone' WHEN b.text = n.text THEN 'unchanged' ELSE 'stale' END AS verdict FROM n FULL JOIN b ON n.file_path = b.file_path""",
    "index_stats": r"SELECT lower(regexp_extract(file_path, '\.([A-Za-z]+)$', 1)) AS extension, count(*) AS n_symbols, count(DISTINCT file_path) AS n_files, strftime(max(indexed_at), '%Y-%m-%d %H:%M:%S') AS newest FROM symbols GROUP BY 1",
    "frequent_names": "SELECT name, count(*) AS n FROM symbols WHERE regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]{4,}$') GROUP BY name ORDER BY n DESC, name LIMIT 5",
    "grep_lines": r"""WITH l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM symbols)
SELECT id, line_no, line FROM l WHERE regexp_matches(line, '(?i)vault\(') QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no) <= 5""",
    "outcome_metrics": _METRICS % (_ARM % "false"),
    "outcome_deltas": f"WITH a AS ({_METRICS % (_ARM % 'false')}), b AS ({_METRICS % (_ARM % 'true')}) SELECT b.completion - a.completion AS d_completion, b.first_pass - a.first_pass AS d_first_pass, b.repeated_rate - a.repeated_rate AS d_repeated_rate, b.repeated - a.repeated AS d_repeated, b.median_ms - a.median_ms AS d_median_ms, b.mean_tokens - a.mean_tokens AS d_mean_tokens FROM a, b",
    "outcome_unpaired": f"SELECT coalesce(a.task_id, b.task_id) AS task_id, CASE WHEN a.task_id IS NULL THEN 'baseline' ELSE 'treatment' END AS missing_in FROM ({_ARM % 'false'}) a FULL JOIN ({_ARM % 'true'}) b ON a.task_id = b.task_id WHERE a.task_id IS NULL OR b.task_id IS NULL",
    "debt_markers": r"""WITH l AS (SELECT id, file_path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM symbols),
t AS (SELECT *, coalesce(sum(len(regexp_extract_all(replace(line, '\`', ''), '`'))) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ticks FROM l)
SELECT id, line_no, trim(regexp_extract(line, '(?i)^\s*(?://|#|\*)\s*todo:\s*(.+)$', 1)) AS comment, regexp_matches(trim(regexp_extract(line, '(?i)^\s*(?://|#|\*)\s*todo:\s*(.+)$', 1)), '(?i),|if\s|when\s|until\s') AS has_upgrade
FROM t WHERE regexp_matches(line, '(?i)^\s*(?://|#|\*)\s*todo:\s*(.+)$') AND NOT (coalesce(regexp_matches(file_path, '\.[cm]?[jt]sx?$'), false) AND ticks % 2 = 1)""",
}
SQL["debt_ledger"] = f"SELECT id, count(*) AS n, count(*) FILTER (WHERE NOT has_upgrade) AS n_without_trigger FROM ({SQL['debt_markers']}) GROUP BY id"
SQL["review_files"] = (
    _GRAPH.rstrip()
    + f""",
{_CHANGED}, {_mention(False)},
ff AS (SELECT file_path FROM rng GROUP BY file_path ORDER BY file_path LIMIT 30), ht AS (SELECT DISTINCT file_path, name, start_line, 'symbol:' || file_path || ':' || name || ':' || coalesce(start_line, 0) AS node FROM hit SEMI JOIN ff USING (file_path)),
un AS (SELECT file_path, count(*) AS k FROM ht WHERE NOT regexp_matches(file_path, '{"|".join(T.TEST_FILES)}') AND NOT EXISTS (SELECT 1 FROM men m WHERE m.symbol_name = ht.name AND m.source_file = ht.file_path) GROUP BY 1),
ca AS (SELECT file_path, count(*) AS k FROM ht JOIN (SELECT DISTINCT src, dst FROM call) c ON c.dst = ht.node GROUP BY 1),
ns AS (SELECT file_path, count(*) AS k FROM ht GROUP BY 1), de AS (SELECT s.file_path, count(*) AS k FROM ({SQL["debt_markers"]}) m JOIN csym s USING (id) GROUP BY 1),
tk AS (SELECT failure_id, unnest(list_distinct(regexp_extract_all(next_path, '[A-Za-z0-9_./-]*[A-Za-z0-9_]\\.[A-Za-z0-9_]{{1,8}}'))) AS token FROM failures),
tl AS (SELECT DISTINCT failure_id, unnest(list_transform(range(1, len(string_split(token, '/')) + 1), lambda i: array_to_string(string_split(token, '/')[i:], '/'))) AS path FROM tk), fa AS (SELECT path AS file_path, count(*) AS k FROM tl GROUP BY 1)
SELECT ff.file_path, 'M' AS status, coalesce(ns.k, 0) AS n_symbols, coalesce(un.k, 0) AS n_untested, coalesce(ca.k, 0) AS n_callers, coalesce(de.k, 0) AS n_debts, coalesce(fa.k, 0) AS n_failures,
  (SELECT count(DISTINCT file_path) FROM rng) AS n_touched, (SELECT count(DISTINCT file_path) FROM rng) > 30 AS truncated
FROM ff LEFT JOIN ns USING (file_path) LEFT JOIN un USING (file_path) LEFT JOIN ca USING (file_path) LEFT JOIN de USING (file_path) LEFT JOIN fa USING (file_path)"""
)

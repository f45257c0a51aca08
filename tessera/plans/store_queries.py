"""Memory store and failure log queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import failures as FL
from tessera.operators import memory as M
from tessera.session import table


def memory_latest(spark: SparkSession, d: str) -> DataFrame:
    """The version of every memory that counts."""
    m = table(spark, d, "memories").where("id is not null").select("id", "rev_id", "title", "ts")
    return M.upsert_latest(m, ["id"], [F.coalesce("ts", F.lit("0001-01-01").cast("timestamp")), F.col("rev_id")]).select("id", "rev_id", "title")


def memory_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids as the store gives them, suffixes for taken slugs included."""
    return M.assign_ids(table(spark, d, "memories"))


def memory_invalidated(spark: SparkSession, d: str) -> DataFrame:
    """Every memory that another one supersedes marked invalid."""
    m = table(spark, d, "memories")
    old = m.where("supersedes is not null").select(T.memory_id(F.col("supersedes")).alias("id"), F.lit("superseded").alias("reason"))
    return M.invalidate(m, old).select("rev_id", "invalidated", F.length("body").cast("long").alias("n_chars"))


def memory_deleted(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories")
    return M.delete(m, m.where("type = 'Note'").select("id"), "general").select("rev_id")


def memory_status(spark: SparkSession, d: str) -> DataFrame:
    return M.status(table(spark, d, "memories"))


def memory_recall(spark: SparkSession, d: str) -> DataFrame:
    return M.recall(table(spark, d, "memories"), 20)


def memory_federated(spark: SparkSession, d: str) -> DataFrame:
    """Imported memories and all decisions as a legacy store beside the others; those that are the same come from the archive."""
    m = table(spark, d, "memories").select("rev_id", "id", "type", "title", "body", "source")
    both = M.federate(m.where("coalesce(source, '') <> 'import'"), m.where("coalesce(source, '') = 'import' or type = 'Decision'"))
    return both.select("rev_id", "archive_source")


MOVED = [(-1, "general/moved-a", "general", "A title that another id has", "x"), (-2, "general/moved-b", "general", "A new title", "x"), (-3, "general/moved-c", "general", "Twice", "x"), (-4, "general/moved-c", "general", "Twice", "y")]
THERE = [(-9, "general/there-a", "general", "A title that another id has", "x")]


def migration_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What a migration of all memories would do to an archive that holds the newest version of all but the notes."""
    columns = "rev_id long, id string, scope string, title string, body string"
    m = table(spark, d, "memories").where("id is not null and title is not null").select("rev_id", "id", "scope", "title", "body", "type", "ts")
    newest = M.upsert_latest(m, ["id"], [F.coalesce("ts", F.lit("0001-01-01").cast("timestamp")), F.col("rev_id")]).where("type <> 'Note'").select("rev_id", "id", "scope", "title", "body")
    source = m.select("rev_id", "id", "scope", "title", "body").unionByName(spark.createDataFrame(MOVED, columns))
    return M.classify_migration(source, newest.unionByName(spark.createDataFrame(THERE, columns)))


def session_mining(spark: SparkSession, d: str) -> DataFrame:
    """Blocks around keywords of all documents."""
    return M.mine_windows(table(spark, d, "documents"), "doc_id", "text")


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Memories written as documents and read again."""
    m = table(spark, d, "memories")
    return M.parse_front_matter(M.front_matter(m)).select("rev_id", "type", "title", F.size("tags").cast("long").alias("n_tags"), "scope", "collection", "invalidated", F.length("body").cast("long").alias("n_chars"))


GUARD_WIDTH = 2000  # ids of a stretch of a command's log


def failure_guard(spark: SparkSession, d: str) -> DataFrame:
    """The state of each scope's and command's guard before and after each event."""
    f = table(spark, d, "failures").select("failure_id", "scope", "command", "ok", "retry_known_failure")
    return FL.guard_batch(f, ["scope", "command"], "failure_id", "ok", "retry_known_failure", GUARD_WIDTH).select("failure_id", "state_before", "state_after", "refused")


def failure_records(spark: SparkSession, d: str) -> DataFrame:
    return FL.failure_records(table(spark, d, "failures"))


def failure_split(spark: SparkSession, d: str) -> DataFrame:
    """Open and settled failures by scope."""
    f = table(spark, d, "failures").groupBy(F.coalesce("scope", F.lit("general")).alias("scope"))
    return f.agg(F.count_if(F.col("status") == "unresolved").alias("n_open"), F.count_if(F.col("status") == "resolved").alias("n_resolved"), F.count_if(F.col("next_path").isNotNull()).alias("n_with_path"))


QUERIES = {
    f.__name__: f
    for f in (memory_latest, memory_ids, memory_invalidated, memory_deleted, memory_status, memory_recall, memory_federated, migration_verdicts, session_mining, front_matter, failure_guard, failure_records, failure_split)
}

_ID = "array_to_string(list_transform(string_split(supersedes, '/'), lambda p: left(regexp_replace(regexp_replace(lower(p), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80)), '/')"
_SLUG = "left(regexp_replace(regexp_replace(lower(%s), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80)"
_FP = "sha256(coalesce(id, chr(1)) || chr(2) || coalesce(type, chr(1)) || chr(2) || coalesce(title, chr(1)) || chr(2) || coalesce(body, chr(1)))"

SQL = {
    "memory_latest": "SELECT id, rev_id, title FROM memories WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS LAST, rev_id DESC) = 1",
    "memory_ids": f"""WITH t AS (SELECT scope, title, min(rev_id) AS seen FROM memories WHERE title IS NOT NULL GROUP BY ALL),
s AS (SELECT *, coalesce(nullif({_SLUG % 'title'}, ''), left(sha256(title), 8)) AS slug, coalesce(nullif({_SLUG % "coalesce(scope, 'general')"}, ''), 'general') AS room FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY room, slug ORDER BY seen, title) AS k FROM s)
SELECT scope, title, room || '/' || slug || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS id FROM n""",
    "memory_invalidated": f"""WITH old AS (SELECT DISTINCT {_ID} AS id FROM memories WHERE supersedes IS NOT NULL)
SELECT rev_id, CASE WHEN o.id IS NOT NULL THEN true ELSE invalidated END AS invalidated, CASE WHEN o.id IS NOT NULL THEN length(coalesce(body, '')) + 27 ELSE length(body) END AS n_chars FROM memories m LEFT JOIN old o ON o.id = m.id""",
    "memory_deleted": "SELECT rev_id FROM memories WHERE (id IS NULL OR id NOT IN (SELECT id FROM memories WHERE type = 'Note' AND id IS NOT NULL)) AND scope IS DISTINCT FROM 'general'",
    "memory_status": "SELECT scope, collection, count(*) AS n FROM (SELECT coalesce(scope, 'general') AS scope, coalesce(collection, 'general') AS collection FROM memories WHERE NOT coalesce(invalidated, false)) GROUP BY ROLLUP (scope, collection)",
    "memory_recall": "SELECT rev_id, id, title FROM memories WHERE NOT coalesce(invalidated, false) ORDER BY ts DESC NULLS LAST, rev_id DESC LIMIT 20",
    "memory_federated": f"""WITH m AS (SELECT rev_id, source, type, {_FP} AS fp FROM memories), a AS (SELECT * FROM m WHERE coalesce(source, '') <> 'import')
SELECT rev_id, 'archive' AS archive_source FROM a UNION ALL SELECT rev_id, 'legacy' FROM m WHERE (coalesce(source, '') = 'import' OR type = 'Decision') AND fp NOT IN (SELECT fp FROM a)""",
    "migration_verdicts": f"""WITH m0 AS (SELECT rev_id, id, scope, title, body, type, ts FROM memories WHERE id IS NOT NULL AND title IS NOT NULL),
n0 AS (SELECT * FROM m0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS LAST, rev_id DESC) = 1),
h AS (SELECT rev_id, id, scope, title, body FROM m0 UNION ALL SELECT * FROM (VALUES {", ".join(map(str, MOVED))}) v(rev_id, id, scope, title, body)),
s AS (SELECT *, sha256(coalesce(title, '') || chr(1) || coalesce(body, '')) AS fp FROM h),
t AS (SELECT *, sha256(coalesce(title, '') || chr(1) || coalesce(body, '')) AS fp FROM (SELECT rev_id, id, scope, title, body FROM n0 WHERE type <> 'Note' UNION ALL SELECT * FROM (VALUES {", ".join(map(str, THERE))}) v(rev_id, id, scope, title, body))),
ti AS (SELECT id, max(fp) AS t_fp FROM t GROUP BY id), tt AS (SELECT scope, title, max(id) AS t_id FROM t GROUP BY ALL), b AS (SELECT id, count(DISTINCT fp) AS kinds FROM s GROUP BY id)
SELECT rev_id, s.id, s.title, CASE WHEN kinds > 1 THEN 'conflict_batch' WHEN t_fp = fp THEN 'skip' WHEN t_fp IS NOT NULL THEN 'conflict_id' WHEN t_id <> s.id THEN 'conflict_title' ELSE 'copy' END AS verdict
FROM s LEFT JOIN ti ON ti.id = s.id LEFT JOIN tt ON tt.scope = s.scope AND tt.title = s.title JOIN b ON b.id = s.id""",
    "session_mining": rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, len(lines) AS n, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM l),
h AS (SELECT doc_id, n, i, greatest(i - 1, 0) AS a, least(i + 1, n - 1) AS b FROM x WHERE regexp_matches(line, '(?i)\b{T.KEYWORDS}\b')),
g AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM h),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block FROM g),
r AS (SELECT doc_id, block, min(a) AS first_line, max(b) AS last_line, min(i) AS key_line FROM k GROUP BY ALL)
SELECT r.doc_id, block, first_line, last_line, left(regexp_replace(regexp_replace(x.line, '^\s+|\s+$', '', 'g'), '^[-*#\s]+', ''), 80) AS title FROM r JOIN x ON x.doc_id = r.doc_id AND x.i = key_line WHERE block < 20""",
    "front_matter": "SELECT rev_id, type, title, coalesce(len(tags), 0) AS n_tags, coalesce(scope, 'general') AS scope, collection, coalesce(invalidated, false) AS invalidated, length(coalesce(body, '')) AS n_chars FROM memories WHERE type IS NOT NULL",
    "failure_guard": """WITH RECURSIVE e AS (SELECT failure_id, scope, command, coalesce(ok, false) AS ok, coalesce(retry_known_failure, false) AS retry, row_number() OVER (PARTITION BY scope, command ORDER BY failure_id) AS k FROM failures),
s AS (
  SELECT failure_id, scope, command, k, 'CLEAN' AS state_before, CASE WHEN ok THEN 'CLEAN' ELSE 'RECORDED' END AS state_after, false AS refused FROM e WHERE k = 1
  UNION ALL SELECT e.failure_id, e.scope, e.command, e.k, s.state_after,
    CASE WHEN s.state_after = 'BLOCKING' AND NOT e.retry THEN 'BLOCKING' WHEN e.ok THEN 'CLEAN' WHEN s.state_after = 'CLEAN' THEN 'RECORDED' ELSE 'BLOCKING' END, s.state_after = 'BLOCKING' AND NOT e.retry
  FROM s JOIN e ON e.k = s.k + 1 AND e.command = s.command AND e.scope IS NOT DISTINCT FROM s.scope)
SELECT failure_id, state_before, state_after, refused FROM s""",
    "failure_records": r"""WITH f AS (SELECT failure_id, command, coalesce(nullif(left(trim(regexp_replace(symptom, '\s+', ' ', 'g')), 300), ''), 'Command returned a failure.') AS symptom FROM failures WHERE NOT coalesce(ok, false) AND command IS NOT NULL)
SELECT left(command, 50) || ' ' || left(sha256(command || chr(10) || symptom), 8) AS title, 'command-' || left(sha256(command), 16) AS tag, count(*) AS n, max(failure_id) AS last_id FROM f GROUP BY command, symptom""",
    "failure_split": "SELECT coalesce(scope, 'general') AS scope, count(*) FILTER (WHERE status = 'unresolved') AS n_open, count(*) FILTER (WHERE status = 'resolved') AS n_resolved, count(next_path) AS n_with_path FROM failures GROUP BY 1",
}

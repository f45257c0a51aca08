"""Retrieval, text and token budget queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.prose import compressed
from tessera.operators import budget as B
from tessera.operators import retrieval as R
from tessera.operators.inverted import TOKENS, indexed_topk, search_indexed
from tessera.plans.stored import stored_index
from tessera.session import table

QUERY = "stale registry decoder registry"


def _documents_index(spark: SparkSession, d: str):
    return stored_index(spark, "documents", table(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"))


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return indexed_topk(_documents_index(spark, d), QUERY, 10).withColumnRenamed("key", "doc_id")


def bm25_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the scope alone: the filter comes first."""
    scope = table(spark, d, "documents").where("scope = 'general'").select(F.col("doc_id").alias("key"))
    return indexed_topk(_documents_index(spark, d), QUERY, 10, scope).withColumnRenamed("key", "doc_id")


def bm25_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same search without an index, as for a table that is asked once."""
    return R.bm25_topk(table(spark, d, "documents"), "doc_id", F.col("text"), QUERY, 10)


WEIGHTS = {"title": 3, "tags": 2, "description": 2, "collection": 2, "body": 1}


def memory_index(spark: SparkSession, d: str):
    memories = table(spark, d, "memories").select("rev_id", *WEIGHTS)
    return stored_index(spark, "memories", memories, "rev_id", R.weighted_text(WEIGHTS))


def _active(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").where("not coalesce(invalidated, false)").select(F.col("rev_id").alias("key"), "type")


def memory_search(spark: SparkSession, d: str) -> DataFrame:
    return indexed_topk(memory_index(spark, d), "merge nested wrapper", 10, _active(spark, d)).withColumnRenamed("key", "rev_id")


def failure_search(spark: SparkSession, d: str) -> DataFrame:
    """Twice the wanted rows are searched and only failure records kept of them, in that order."""
    best = indexed_topk(memory_index(spark, d), "restore failed command", 10, _active(spark, d))
    kept = best.join(_active(spark, d), "key").where("type = 'FailureRecord'").orderBy(F.desc("score"), "key").limit(5)
    return kept.select(F.col("key").alias("rev_id"), "score")


def _bm25_sql(key: str, rows: str, query: str, limit: int) -> str:
    terms = query.lower().split()
    return f"""
WITH base AS (SELECT {key}, regexp_extract_all(lower(t), '([A-Za-z0-9_]{{2,}})') AS w FROM ({rows})),
lens AS (SELECT {key}, len(w)::DOUBLE AS dl FROM base),
stats AS (SELECT count(*)::DOUBLE AS n, CASE WHEN avg(dl) = 0 THEN 1 ELSE avg(dl) END AS mean FROM lens),
q AS (SELECT unnest({terms!r}) AS term),
tf AS (SELECT {key}, term, count(*)::DOUBLE AS tf FROM (SELECT {key}, unnest(w) AS term FROM base) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
s AS (SELECT tf.{key}, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN lens ON lens.{key} = tf.{key}, stats GROUP BY tf.{key})
SELECT {key}, round(score, 6) AS score FROM s WHERE round(score, 6) > 0 ORDER BY round(score, 6) DESC, {key} LIMIT {limit}"""


_MEMORY_TEXT = "concat_ws(' ', title, title, title, array_to_string(tags, ' '), array_to_string(tags, ' '), description, description, collection, collection, body)"
_MEMORIES = f"SELECT rev_id, {_MEMORY_TEXT} AS t FROM memories WHERE NOT coalesce(invalidated, false)"


def symbol_index(spark: SparkSession, d: str):
    symbols = table(spark, d, "symbols").select("id", "name", "content")
    return stored_index(spark, "symbols", symbols, "id", F.concat_ws(" ", "name", "content"), TOKENS, True)


def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    """All terms first, then any."""
    return search_indexed(symbol_index(spark, d), table(spark, d, "symbols"), "where is the vault token", 20).select("id", "name", "pass", "score")


def symbol_search_name(spark: SparkSession, d: str) -> DataFrame:
    return search_indexed(symbol_index(spark, d), table(spark, d, "symbols"), "mergeAlert", 10).select("id", "name", "pass", "score")


def symbol_search_phrase(spark: SparkSession, d: str) -> DataFrame:
    """A term of several tokens is a phrase whose last token is a prefix."""
    return search_indexed(symbol_index(spark, d), table(spark, d, "symbols"), "return_nul", 10).select("id", "name", "pass", "score")


def symbol_search_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same search without an index."""
    return R.search_symbols(table(spark, d, "symbols"), "where is the vault token", 20).select("id", "name", "pass", "score")


def symbol_like(spark: SparkSession, d: str) -> DataFrame:
    return R.like_fallback(table(spark, d, "symbols"), "vault(", 10)


_SYMBOL_SEARCH = """
WITH base AS (SELECT id, file_path, name, start_line, lower(name) AS lname, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, content)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS w FROM symbols),
tfs AS (SELECT *, len(w)::DOUBLE AS dl, %(tfs)s FROM base),
stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean, %(dfs)s FROM tfs),
scored AS (SELECT tfs.*, round(%(score)s, 9) AS bm25, CASE WHEN lname = '%(exact)s' THEN 101 WHEN contains(lname, '%(first)s') THEN 51 ELSE 1 END AS score FROM tfs, stats),
a0 AS (SELECT * FROM scored WHERE %(all)s ORDER BY bm25 DESC, id LIMIT %(over)d), a AS (SELECT *, 1 AS pass FROM a0 ORDER BY score DESC, bm25 DESC, id LIMIT %(limit)d),
b0 AS (SELECT * FROM scored WHERE %(any)s ORDER BY bm25 DESC, id LIMIT %(over)d), b AS (SELECT *, 2 AS pass FROM b0 ORDER BY score DESC, bm25 DESC, id LIMIT %(limit)d)
SELECT id, name, pass, score FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE %(two)s AND (file_path, start_line, name) NOT IN (SELECT (file_path, start_line, name) FROM a WHERE start_line IS NOT NULL AND file_path IS NOT NULL)) ORDER BY pass, score DESC, bm25 DESC, id LIMIT %(limit)d"""


def _symbol_sql(query: str, limit: int, phrases: dict[str, str] = {}) -> str:  # noqa: B006
    terms = R.query_terms(query)
    k = range(len(terms))
    return _SYMBOL_SEARCH % {
        "tfs": ", ".join(phrases.get(t, f"len(list_filter(w, lambda t: starts_with(t, '{t}')))") + f"::DOUBLE AS tf{i}" for i, t in enumerate(terms)),
        "dfs": ", ".join(f"sum((tf{i} > 0)::INT)::DOUBLE AS df{i}" for i in k),
        "score": " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in k),
        "exact": query.strip().lower(), "first": terms[0], "all": " AND ".join(f"tf{i} > 0" for i in k), "any": " OR ".join(f"tf{i} > 0" for i in k),
        "over": min(max(5 * limit, 50), 500), "limit": limit, "two": "true" if len(terms) > 1 else "false",
    }


# --- text


def compress_prose(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.compress_prose(F.col("text")).alias("short"))


def compress_protected(spark: SparkSession, d: str) -> DataFrame:
    """With code, links, paths and constants left alone."""
    return compressed(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha"))


def compression_savings(spark: SparkSession, d: str) -> DataFrame:
    sized = table(spark, d, "documents").where("text is not null").select("doc_id", T.count_tokens(F.col("text")).cast("long").alias("before"), T.count_tokens(T.compress_prose(F.col("text"))).cast("long").alias("after"))
    return sized.select("doc_id", "before", "after", T.percent_saved(F.col("after"), F.col("before")).alias("percent"))


def redact_shared(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "failures").select("failure_id", T.redact(F.col("command"), ("build/", "dist/")).alias("command"), T.redact(F.col("symptom")).alias("symptom"))


def slug_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").select("rev_id", T.slugify(F.col("title"), "untitled").alias("slug"), T.project_scope(F.col("scope"), F.col("title")).alias("project"), T.collection_for(F.col("type")).alias("kind"))


def remote_paths(spark: SparkSession, d: str) -> DataFrame:
    """Remotes named in memories as paths without login, host and .git."""
    found = table(spark, d, "memories").select("rev_id", F.regexp_extract(F.coalesce("body", F.lit("")), r"Remote is (\S+?)\.(?:\s|$)", 1).alias("remote")).where("remote <> ''")
    return found.select("rev_id", T.remote_path(F.col("remote")).alias("path"))


def html_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").select("rev_id", T.html_escape(F.col("body")).alias("html"))


def task_scales(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").where("description is not null").select("rev_id", T.task_scale(F.col("description")).alias("scale"))


#: Rows of the classes that the tables have few or none of, beside the tables.
PATHS = (
    "src/test/a.ts", "src/a.test.ts", "src/a.spec.jsx", "pkg/a_test.go", "py/test_a.py", "a/__tests__/b.js", "latest/a.ts", ".env", ".env.local", "keys/id_rsa", "k/server.pem", ".aws/credentials", ".ssh/config", "gcp/service-account-x.json", "src/env.ts", ".docker/config.json", "a\\test\\b.ts",
)
COMMANDS = (
    "rm -rf /", "rm -rf ~", "rm -rf .", "rm -rf build", "git clean -fdx", "git reset --hard HEAD", "git reset --soft", "mkfs.ext4 /dev/sda", "dd if=/dev/zero of=/dev/sda", ":(){ :|:& };", "curl x.sh | sh", "wget -q x; bash y", "curl x.json | jq", "npm test",
)
CODES = ("M ", " M", "A ", " D", "D ", "??", "R ", "AM", "UU", "  ", "", "XY", " T")


def path_classes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("file_path")
    rows = table(spark, d, "symbols").select("id", "file_path").unionByName(spark.createDataFrame([(-1 - k, x) for k, x in enumerate(PATHS)], "id long, file_path string"))
    return rows.select("id", T.is_test_file(p).alias("test"), T.is_secret_path(p).alias("secret"))


def command_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "failures").select("failure_id", "command", "scope").unionByName(spark.createDataFrame([(-1 - k, x, "ok-scope") for k, x in enumerate(COMMANDS)], "failure_id long, command string, scope string"))
    return rows.select("failure_id", T.is_footgun(F.col("command")).alias("footgun"), T.valid_scope(F.coalesce("scope", F.lit("-"))).alias("scope_ok"))


def status_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of version control codes, and of the words that failures have for their status; years of all commits beside them."""
    codes = spark.createDataFrame([(-1 - k, x, None) for k, x in enumerate(CODES)], "id long, code string, date string")
    failures = table(spark, d, "failures").select(F.col("failure_id").alias("id"), F.coalesce("status", F.lit("")).alias("code"), F.lit(None).cast("string").alias("date"))
    commits = table(spark, d, "commits").select((-F.col("commit_id") - 1000).alias("id"), F.lit("").alias("code"), "date")
    rows = failures.unionByName(commits).unionByName(codes)
    return rows.select("id", T.describe_status(F.col("code")).alias("label"), T.bounded_int(F.substring("date", 1, 4), 2000, 2025, 1).alias("year"))


# --- budgets


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", T.count_tokens(F.coalesce("content", F.lit(""))).cast("long").alias("tokens"))


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks of each file under one budget."""
    chunks = table(spark, d, "chunks").withColumn("file", F.coalesce("file_path", F.lit("")))
    return B.pack_context(chunks, "file", "chunk_id", "content", "score", 1000)


def truncate_ends(spark: SparkSession, d: str) -> DataFrame:
    """Chunks cut to 200 tokens, with both ends kept."""
    return B.truncated(table(spark, d, "chunks").where("content is not null"), "chunk_id", "content", 200).select("chunk_id", F.length("text").alias("n_chars"), T.count_tokens(F.col("text")).alias("tokens"))




def _nested(column: str, rules: list[tuple[str, str, str]]) -> str:
    for pattern, to, flags in rules:
        column = f"regexp_replace({column}, '{pattern}', '{to}', '{flags}')"
    return column


def _compress_sql(column: str) -> str:
    rules = [(rf"\b{p}\b", to, "gi") for p, to in T.PHRASES]
    rules += [(r"\s+([,.;:!?])", r"\1", "g"), *[(rf"{c}{{2,}}", c.replace("\\", ""), "g") for c in (",", ";", ":", "!", r"\?")], (r"\s{2,}", " ", "g"), (r"\s+-\s+", " — ", "g"), (r"^\s+|\s+$", "", "g")]
    body = _nested(column, rules)
    return f"CASE WHEN regexp_replace({column}, '^\\s+|\\s+$', '', 'g') = '' THEN {column} WHEN {body} = '' THEN '' ELSE regexp_extract({column}, '^\\s*') || {body} || regexp_extract({column}, '\\s*$') END"


_TOKENS_SQL = r"\p{L}+|\p{Nd}{1,3}|[^\s\p{L}\p{Nd}]"


def _count_sql(column: str) -> str:
    return f"len(regexp_extract_all({column}, '{_TOKENS_SQL}'))"


def _redact_sql(column: str, roots: tuple[str, ...] = ()) -> str:
    for r in sorted(roots, key=lambda r: (-len(r), r)):
        column = f"replace({column}, '{r}', '[REDACTED_PATH]')"
    values = T.KEY_VALUES.replace("'", "''")
    return _nested(column, [(rf"\b{T.BEARER}", "Bearer [REDACTED]", "gi"), (rf"\b{T.TOKEN_SHAPES}\b", "[REDACTED_SECRET]", "g"), (values, r"\1[REDACTED]", "gi")])


def _slug_sql(column: str) -> str:
    return f"left(regexp_replace(regexp_replace(lower({column}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80)"


def _any_sql(column: str, patterns: tuple[str, ...], flags: str = "") -> str:
    joined = "|".join(f"(?:{p})" for p in patterns)
    return f"regexp_matches({column}, '{flags}{joined}')"


_STATUS_SQL = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.STATUS_CODES.items()) + " ELSE coalesce(nullif(trim(code), ''), 'changed') END"


def _values(texts: tuple[str, ...]) -> str:
    return ", ".join(f"({-1 - k}, '{x}')" for k, x in enumerate(texts))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_search, bm25_scoped, bm25_scan, memory_search, failure_search, symbol_search, symbol_search_name, symbol_search_phrase, symbol_search_scan, symbol_like, compress_prose, compress_protected, compression_savings, redact_shared,
        slug_titles, remote_paths, html_titles, task_scales, path_classes, command_classes, status_labels, token_counts, context_pack, truncate_ends,
    )
}

SQL = {
    "bm25_search": _bm25_sql("doc_id", "SELECT doc_id, coalesce(text, '') AS t FROM documents", QUERY, 10),
    "bm25_scoped": _bm25_sql("doc_id", "SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE scope = 'general'", QUERY, 10),
    "memory_search": _bm25_sql("rev_id", _MEMORIES, "merge nested wrapper", 10),
    "failure_search": f"SELECT rev_id, score FROM ({_bm25_sql('rev_id', _MEMORIES, 'restore failed command', 10)}) JOIN (SELECT rev_id, type FROM memories) USING (rev_id) WHERE type = 'FailureRecord' ORDER BY score DESC, rev_id LIMIT 5",
    "bm25_scan": _bm25_sql("doc_id", "SELECT doc_id, coalesce(text, '') AS t FROM documents", QUERY, 10),
    "symbol_search_scan": _symbol_sql("where is the vault token", 20),
    "symbol_search_phrase": _symbol_sql("return_nul", 10, {"return_nul": "len(list_filter(range(1, len(w)), lambda i: w[i] = 'return' AND starts_with(w[i + 1], 'nul')))"}),
    "symbol_search": _symbol_sql("where is the vault token", 20),
    "symbol_search_name": _symbol_sql("mergeAlert", 10),
    "symbol_like": "SELECT id, name, CASE WHEN lower(name) = 'vault(' THEN 101 WHEN contains(lower(name), 'vault') THEN 51 ELSE 1 END AS score, length(content) AS size FROM symbols WHERE contains(lower(name), 'vault') OR contains(lower(content), 'vault') ORDER BY score DESC, size, id LIMIT 10",
    "compress_prose": f"SELECT doc_id, {_compress_sql('text')} AS short FROM documents",
    "compression_savings": f"WITH s AS (SELECT doc_id, {_count_sql('text')} AS before, {_count_sql(_compress_sql('text'))} AS after FROM documents WHERE text IS NOT NULL) SELECT doc_id, before, after, CASE WHEN before > 0 THEN floor((1 - after / before) * 100 + 0.5)::BIGINT ELSE 0 END AS percent FROM s",
    "redact_shared": f"SELECT failure_id, {_redact_sql('command', ('build/', 'dist/'))} AS command, {_redact_sql('symptom')} AS symptom FROM failures",
    "slug_titles": f"SELECT rev_id, coalesce(nullif({_slug_sql('title')}, ''), 'untitled') AS slug, coalesce(nullif(regexp_replace(lower(scope), '[^a-z0-9]+', '-', 'g'), ''), 'project') || '-' || left(sha256(title), 8) AS project, CASE type WHEN 'Decision' THEN 'decisions' WHEN 'FailureRecord' THEN 'failures' ELSE 'general' END AS kind FROM memories",
    "remote_paths": r"""WITH r AS (SELECT rev_id, regexp_extract(coalesce(body, ''), 'Remote is (\S+?)\.(?:\s|$)', 1) AS remote FROM memories),
p AS (SELECT rev_id, CASE WHEN contains(remote, '://') THEN regexp_extract(remote, '^[^:]+://[^/]*(/.*)?$', 1) WHEN regexp_matches(remote, '^(?:[^@/]+@)?[^:/]+:.+$') THEN regexp_extract(remote, '^(?:[^@/]+@)?[^:/]+:(.+)$', 1) ELSE remote END AS p FROM r WHERE remote <> '')
SELECT rev_id, nullif(regexp_replace(regexp_replace(replace(regexp_replace(p, '[?#].*$', ''), '\', '/'), '^/+|/+$', '', 'g'), '\.git$', '', 'i'), '') AS path FROM p""",
    "html_titles": "SELECT rev_id, replace(replace(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM memories",
    "task_scales": rf"SELECT rev_id, CASE WHEN len(regexp_split_to_array(description, '\s+')) > 50 OR regexp_matches(description, '(?i)\b{T.LARGE}\b') THEN 'large' WHEN len(regexp_split_to_array(description, '\s+')) < 15 AND regexp_matches(description, '(?i)\b{T.SMALL}\b') THEN 'small' ELSE 'medium' END AS scale FROM memories WHERE description IS NOT NULL",
    "path_classes": f"""WITH p AS (SELECT id, file_path, regexp_split_to_array(file_path, '[/\\\\]') AS parts FROM (SELECT id, file_path FROM symbols UNION ALL SELECT * FROM (VALUES {_values(PATHS)}) v(id, file_path)))
SELECT id, {_any_sql('file_path', T.TEST_FILES)} AS test, parts[-1] IN {T.SECRET_FILES} OR {_any_sql('parts[-1]', T.SECRET_NAMES, '(?i)')} OR coalesce(parts[-2] IN {T.SECRET_FOLDERS}, false) AS secret FROM p""",
    "command_classes": f"SELECT failure_id, {_any_sql('command', T.FOOTGUNS)} AS footgun, regexp_matches(coalesce(scope, '-'), '^[a-z0-9](?:[a-z0-9-]{{0,78}}[a-z0-9])?$') AS scope_ok FROM (SELECT failure_id, command, scope FROM failures UNION ALL SELECT *, 'ok-scope' FROM (VALUES {_values(COMMANDS)}) v(failure_id, command))",
    "status_labels": f"""WITH r AS (SELECT failure_id AS id, coalesce(status, '') AS code, NULL AS date FROM failures UNION ALL SELECT -commit_id - 1000, '', date FROM commits UNION ALL SELECT *, NULL FROM (VALUES {_values(CODES)}) v(id, code))
SELECT id, {_STATUS_SQL} AS label, CASE WHEN try_cast(substr(date, 1, 4) AS DOUBLE) IS NULL THEN 1 ELSE least(2025, greatest(2000, floor(try_cast(substr(date, 1, 4) AS DOUBLE))))::BIGINT END AS year FROM r""",
    "token_counts": f"SELECT chunk_id, {_count_sql("coalesce(content, '')")} AS tokens FROM chunks",
    "context_pack": f"""
WITH RECURSIVE c AS (SELECT coalesce(file_path, '') AS file, row_number() OVER (PARTITION BY coalesce(file_path, '') ORDER BY score DESC NULLS LAST, chunk_id) AS k, {_count_sql("coalesce(content, '')")}::BIGINT AS tokens FROM chunks),
f AS (
  SELECT file, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS included, 0::BIGINT AS dropped FROM (SELECT DISTINCT file FROM c)
  UNION ALL SELECT f.file, c.k,
    CASE WHEN f.dropped > 0 AND f.used >= 1000 THEN f.used WHEN f.used + c.tokens <= 1000 THEN f.used + c.tokens WHEN 1000 - f.used > 100 THEN 1000 ELSE f.used END,
    f.included + CASE WHEN f.dropped > 0 AND f.used >= 1000 THEN 0 WHEN f.used + c.tokens <= 1000 OR 1000 - f.used > 100 THEN 1 ELSE 0 END,
    f.dropped + CASE WHEN f.dropped > 0 AND f.used >= 1000 THEN 0 WHEN f.used + c.tokens <= 1000 THEN 0 ELSE 1 END
  FROM f JOIN c ON c.file = f.file AND c.k = f.k + 1)
SELECT file, used, included, dropped FROM f QUALIFY row_number() OVER (PARTITION BY file ORDER BY k DESC) = 1""",
}

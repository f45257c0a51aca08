"""Queries of the training-data operators and the SQL some of them are compared with."""

from __future__ import annotations

from collections.abc import Callable
from secrets import token_bytes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.docpairs import function_pairs
from tessera.llm.formatdup import collapse_formatting
from tessera.llm.leak import leaked_items
from tessera.llm.packing import pack_windows
from tessera.llm.pii import learn_names, pseudonymised
from tessera.llm.secrets import secrets_in
from tessera.llm.split import split_oversized
from tessera.llm.truncation import truncated_texts, truncation_rates
from tessera.session import table

Query = Callable[[SparkSession, str], DataFrame]


P1_PARTS = (("memories.body", "memories", "rev_id", "body", False), ("failures.symptom", "failures", "failure_id", "symptom", False), ("commits.author", "commits", "commit_id", "author", True))


def p1_pseudonymised(spark: SparkSession, d: str) -> DataFrame:
    """Every text of the three columns with typed placeholders, and the kinds found in it.

    The key is the session's setting tessera.pseudonym.key; without it each call makes one of its
    own, so its pseudonyms are linked within one result and can't be undone by anyone.
    """
    named = spark.conf.get("tessera.pseudonym.key", "")
    secret = named.encode() if named else token_bytes(32)
    names = learn_names([(table(spark, d, t), text, author) for _, t, _, text, author in P1_PARTS])
    found = [pseudonymised(table(spark, d, t), key, text, secret, author, names).select(F.lit(src).alias("src"), "*") for src, t, key, text, author in P1_PARTS]
    return found[0].unionByName(found[1]).unionByName(found[2])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """kinds holds a kind once and ids are unique, so the rows are distinct without a shuffle. Dates and accounts are no kinds of its cases."""
    return p1_pseudonymised(spark, d).select("src", "row_id", F.explode("kinds").alias("kind")).where("kind not in ('date', 'account')")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every oversized chunk and symbol."""
    chunks = split_oversized(table(spark, d, "chunks"), "chunk_id", "content")
    symbols = split_oversized(table(spark, d, "symbols"), "id", "content")
    return chunks.select(F.lit("chunks.content").alias("src"), "*").unionByName(symbols.select(F.lit("symbols.content").alias("src"), "*"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Contents that had to be cut; the second piece stands for the content."""
    return p2_pieces(spark, d).where("piece_no = 1").select("src", "row_id")


def p2_reassembled(spark: SparkSession, d: str) -> DataFrame:
    """Every oversized content put together again from its pieces, and whether they keep the limit and repeat what they must.

    Each piece gives the part of it that is new; a content's parts are joined in order.
    """
    pieces = p2_pieces(spark, d)
    own = F.expr("if(piece_no = 0, piece, substring(piece, 201, length(piece)))")
    parts = pieces.groupBy("src", "row_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", "start", "piece", own.alias("own")))).alias("ps"), F.max(F.length("piece")).alias("longest"), F.max("n_pieces").alias("n_pieces"))
    whole = F.array_join(F.transform("ps", lambda p: p["own"]), "")
    repeats = F.forall(F.sequence(F.lit(2), F.size("ps")), lambda k: F.right(F.element_at("ps", k - 1)["piece"], F.lit(200)) == F.left(F.element_at("ps", k)["piece"], F.lit(200)))
    return parts.select("src", "row_id", F.sha2(whole, 256).alias("sha"), ((F.col("longest") <= 2000) & (F.size("ps") == F.col("n_pieces")) & repeats).alias("fits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return collapse_formatting(table(spark, d, "failures"), "failure_id", "command").where("n_copies >= 2").select("rep_id", "n_copies")


def p3_commands(spark: SparkSession, d: str) -> DataFrame:
    """One record per command, those without copies included."""
    return collapse_formatting(table(spark, d, "failures"), "failure_id", "command")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and description of every documented function."""
    return function_pairs(table(spark, d, "symbols"), "id", "content", "file_path")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pairs(spark, d).select(F.col("row_id").alias("id"), "func_name").distinct()


def p5_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Every text of the three columns that holds secrets, with their places and the masked text."""
    failures = table(spark, d, "failures")
    parts = (("symbols.content", table(spark, d, "symbols"), "id", "content"), ("failures.command", failures, "failure_id", "command"), ("failures.symptom", failures, "failure_id", "symptom"))
    found = [secrets_in(rows, key, text).select(F.lit(src).alias("src"), "*") for src, rows, key, text in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


def p4_misplaced(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose code doesn't stand at the place that is given for it: none."""
    pairs = p4_pairs(spark, d)
    contents = table(spark, d, "symbols").select(F.col("id").alias("row_id"), "content")
    return pairs.join(contents, "row_id").where(F.expr("substring(content, start + 1, end - start)") != F.col("code")).select(F.col("row_id").alias("id"), "func_name")


def p5_misplaced(spark: SparkSession, d: str) -> DataFrame:
    """Secrets that don't stand at the place given for them, or still stand in the masked text where they were: none."""
    found = p5_secrets(spark, d).where("src = 'symbols.content'")
    contents = table(spark, d, "symbols").select(F.col("id").alias("row_id"), "content")
    wrong = F.exists("secrets", lambda s: (F.substr(F.col("content"), s["start"] + 1, s["end"] - s["start"]) != s["secret"]) | (F.col("redacted") == F.col("content")))
    return found.join(contents, "row_id").where(wrong).select("src", "row_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """A text's secrets are made distinct in its own row, and ids are unique, so nothing is shuffled."""
    return p5_secrets(spark, d).select("src", "row_id", F.explode(F.array_distinct(F.transform("secrets", lambda s: s["secret"]))).alias("secret"))


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    return pack_windows(table(spark, d, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts the packing had to divide."""
    return p7_windows(spark, d).where("piece = 1").select("doc_id")


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Each document's tokens and pieces over all its windows, and whether those windows hold what they say and no more than they can."""
    rows = p7_windows(spark, d)
    sums = rows.groupBy("window_id").agg(F.sum("n_tokens").alias("held"), F.max("window_tokens").alias("said"))
    good = sums.select("window_id", ((F.col("held") == F.col("said")) & (F.col("held") <= 2048)).alias("good"))
    return rows.join(good, "window_id").groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"), F.every("good").alias("fits"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with a whole passage of 13 words: those at distance 0."""
    return p8_leaks(spark, d).where("distance = 0 and n_words = 13").select("doc_id", "item_id")


def p9_judged(spark: SparkSession, d: str) -> DataFrame:
    return truncated_texts(table(spark, d, "documents"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_judged(spark, d).where("truncated").select("doc_id")


def p9_flips(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose verdict the posterior of their length turns over: what their ending alone would say, and what is said."""
    return p9_judged(spark, d).where("alone <> truncated").select("doc_id", "source", "ending", "posterior", "alone", "truncated")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return truncation_rates(p9_judged(spark, d))


P2_FOUND = """
SELECT 'chunks.content' AS src, chunk_id AS row_id FROM chunks WHERE length(content) > 2000
UNION ALL SELECT 'symbols.content', id FROM symbols WHERE length(content) > 2000
"""

P2_REASSEMBLED = """
SELECT 'chunks.content' AS src, chunk_id AS row_id, sha256(content) AS sha, true AS fits FROM chunks WHERE length(content) > 2000
UNION ALL SELECT 'symbols.content', id, sha256(content), true FROM symbols WHERE length(content) > 2000
"""

# Words of a command: quotes and the like before them dropped, words without letter or digit left out.
_DASH = "[\\-‐-―−]"
P3_COMMANDS = f"""
WITH d AS (SELECT command, min(failure_id) AS rec, count(*) AS n FROM failures WHERE command IS NOT NULL GROUP BY command),
w AS (SELECT rec, n, list_transform(list_filter(regexp_split_to_array(lower(command), '[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]')), lambda t: regexp_replace(t, '^[^\\p{{L}}\\p{{N}}\\-‐-―−]+', '')) AS ts FROM d),
h AS (SELECT *, coalesce(list_position(list_transform(ts, lambda t: regexp_matches(t, '^[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*=')), false) - 1, len(ts)) AS k FROM w),
r AS (SELECT rec, n, ts[1:k] AS head, ts[k + 1:] AS ts FROM h),
o AS (SELECT *, list_transform(ts, lambda t: regexp_matches(t, '^{_DASH}')) AS dash FROM r),
v AS (SELECT *, list_transform(range(1, len(ts) + 1), lambda i: i > 1 AND dash[i - 1] AND NOT contains(ts[i - 1], '=') AND NOT dash[i]) AS val FROM o),
c AS (SELECT rec, n, list_transform(head, lambda t: trim(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS a,
  trim(regexp_replace(array_to_string(list_transform(list_filter(range(1, len(ts) + 1), lambda i: NOT dash[i] AND NOT val[i]), lambda i: ts[i]), ' '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS b,
  list_transform(list_filter(range(1, len(ts) + 1), lambda i: dash[i]), lambda i: trim(regexp_replace(ts[i] || CASE WHEN i < len(ts) AND val[i + 1] THEN ' ' || ts[i + 1] ELSE '' END, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS e FROM v)
SELECT min(rec) AS rep_id, sum(n)::BIGINT AS n_copies, count(*) AS n_notations FROM c GROUP BY list_sort(a), b, list_sort(e)
"""
P3_FOUND = f"SELECT rep_id, n_copies FROM ({P3_COMMANDS}) WHERE n_copies >= 2"

_TOKENS = r"\p{L}+|\p{Nd}{1,3}|[^\p{L}\p{Nd}\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
P7_INVARIANTS = f"WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '{_TOKENS}')) AS n FROM documents) SELECT doc_id, n AS n_tokens, (n + 2047) // 2048 AS n_pieces, true AS fits FROM t WHERE n > 0"

P7_FOUND = r"""
SELECT doc_id FROM documents
WHERE len(regexp_extract_all(text, '\p{L}+|\p{Nd}{1,3}|[^\p{L}\p{Nd}\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')) > 2048
"""

_GRAM = "w || " + " || ".join(f"' ' || lead(w, {k}) OVER o" for k in range(1, 13))
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
P8_FOUND = f"""
WITH i0 AS (SELECT item_id, {_WORDS} AS ws FROM eval_items), i1 AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS n FROM i0),
d0 AS (SELECT doc_id, {_WORDS} AS ws FROM documents), d1 AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS n FROM d0),
i2 AS (SELECT DISTINCT item_id, {_GRAM} AS g FROM i1 WINDOW o AS (PARTITION BY item_id ORDER BY n)),
d2 AS (SELECT doc_id, {_GRAM} AS g FROM d1 WINDOW o AS (PARTITION BY doc_id ORDER BY n))
SELECT DISTINCT doc_id, item_id FROM d2 JOIN i2 USING (g)
"""

# All ways that a passage of 13 words can stand with one word dropped, replaced or put in, looked up among the windows of every document.
_ROWS = "doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND %d FOLLOWING"
_WITHOUT = "ws[1:j - 1] || ws[j + 1:%d]"
P8_LEAKS = f"""
WITH i0 AS (SELECT item_id, {_WORDS} AS ws FROM eval_items), i1 AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS n FROM i0),
p AS (SELECT DISTINCT item_id, ws FROM (SELECT item_id, array_agg(w) OVER (PARTITION BY item_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS ws FROM i1) WHERE len(ws) = 13),
voc AS (SELECT DISTINCT w FROM i1),
d0 AS (SELECT doc_id, {_WORDS} AS ws FROM documents), d1 AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS n FROM d0),
d2 AS (SELECT d1.*, (voc.w IS NOT NULL)::INT AS k FROM d1 LEFT JOIN voc USING (w)),
d3 AS (SELECT doc_id, array_agg(w) OVER (PARTITION BY {_ROWS % 13}) AS ws, sum(k) OVER (PARTITION BY {_ROWS % 13}) AS known FROM d2),
d AS (SELECT DISTINCT doc_id, ws FROM d3 WHERE known >= 12),
j AS (SELECT unnest(range(1, 14)) AS j),
pk AS (
  SELECT item_id, ws AS p, 'e' AS kind, ws AS key FROM p UNION ALL SELECT item_id, ws, 'i', ws FROM p
  UNION ALL SELECT item_id, ws, 'd', {_WITHOUT % 13} FROM p, j UNION ALL SELECT item_id, ws, 's' || j, {_WITHOUT % 13} FROM p, j WHERE j BETWEEN 2 AND 12),
dk AS (
  SELECT doc_id, 'e' AS kind, ws[1:13] AS key FROM d UNION SELECT doc_id, 'd', ws[1:12] FROM d
  UNION SELECT doc_id, 's' || j, {_WITHOUT % 13} FROM d, j WHERE j BETWEEN 2 AND 12 AND len(ws) >= 13 UNION SELECT doc_id, 'i', {_WITHOUT % 14} FROM d, j WHERE j >= 2 AND len(ws) = 14),
m AS (SELECT doc_id, item_id, p, min(CASE kind WHEN 'e' THEN 0 ELSE 1 END) AS dist FROM dk JOIN pk USING (kind, key) GROUP BY ALL)
SELECT doc_id, item_id, min(dist) AS distance, count(*) AS n_passages, 13 AS n_words FROM m GROUP BY doc_id, item_id
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_pseudonymised, p2_found, p2_pieces, p2_reassembled, p3_found, p3_commands, p4_found, p4_pairs, p4_misplaced, p5_found, p5_secrets, p5_misplaced, p7_found, p7_windows, p7_invariants, p8_found, p8_leaks, p9_found, p9_judged, p9_flips, p9_rates)}


def oracle_sql() -> dict[str, str]:
    none = "SELECT %s FROM symbols WHERE false"
    return {
        "p2_found": P2_FOUND, "p2_reassembled": P2_REASSEMBLED, "p3_found": P3_FOUND, "p3_commands": P3_COMMANDS, "p4_misplaced": none % "id, name AS func_name", "p5_misplaced": none % "'symbols.content' AS src, id AS row_id",
        "p7_found": P7_FOUND, "p7_invariants": P7_INVARIANTS, "p8_found": P8_FOUND, "p8_leaks": P8_LEAKS,
    }

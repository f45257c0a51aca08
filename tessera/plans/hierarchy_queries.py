"""Queries over the memories' line of succession."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import memory_id
from tessera.operators.hierarchy import descendants, resolve_hierarchy
from tessera.session import table


def _latest_memories(spark: SparkSession, d: str) -> DataFrame:
    """The version with the latest ts of each memory and the id it supersedes, read like an id."""
    memories = table(spark, d, "memories").select("id", "ts", "rev_id", "supersedes").where("id is not null")
    latest = memories.groupBy("id").agg(F.max(F.struct(F.coalesce("ts", F.lit("0001-01-01").cast("timestamp")).alias("ts"), "rev_id", "supersedes")).alias("v"))
    return latest.select("id", memory_id(F.col("v.supersedes")).alias("parent"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return resolve_hierarchy(_latest_memories(spark, d), "id", "parent")


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full paths, and how many memories stand below each."""
    resolved = resolve_hierarchy(_latest_memories(spark, d), "id", "parent", paths=True)
    below = descendants(resolved).groupBy("node_id").agg(F.count(F.lit(1)).alias("n_below"))
    return resolved.join(below, "node_id", "left").select("node_id", "root_id", "depth", F.array_join("path", " > ").alias("path"), F.coalesce("n_below", F.lit(0)).alias("n_below"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(resolve_hierarchy(_latest_memories(spark, d), "id", "parent", paths=True))


_LINKS = r"""
WITH RECURSIVE latest AS (
  SELECT id, supersedes FROM memories WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS LAST, rev_id DESC) = 1),
read AS (SELECT id, array_to_string(list_transform(string_split(supersedes, '/'), lambda p: left(regexp_replace(regexp_replace(lower(p), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80)), '/') AS s FROM latest),
links AS (SELECT r.id, p.id AS parent FROM read r LEFT JOIN (SELECT id FROM latest) p ON p.id = r.s),
down AS (
  SELECT id, id AS root_id, 0::BIGINT AS depth, id AS path FROM links WHERE parent IS NULL
  UNION ALL SELECT l.id, d.root_id, d.depth + 1, d.path || ' > ' || l.id FROM down d JOIN links l ON l.parent = d.id),
up AS (
  SELECT id AS start, id AS cur, [id] AS seen, false AS closed FROM links WHERE id NOT IN (SELECT id FROM down)
  UNION ALL SELECT u.start, l.parent, list_append(u.seen, l.parent), list_contains(u.seen, l.parent) FROM up u JOIN links l ON l.id = u.cur WHERE NOT u.closed),
loops AS (SELECT start AS id, list_min(seen[list_position(seen, cur):]) AS root_id, (-1)::BIGINT AS depth, NULL::VARCHAR AS path FROM up WHERE closed),
resolved AS (SELECT * FROM down UNION ALL SELECT * FROM loops)
"""

P6_FOUND = _LINKS + "SELECT id AS node_id, root_id, depth FROM resolved"
P6_DESCENDANTS = _LINKS + ", pairs AS (SELECT id, depth, unnest(string_split(path, ' > ')) AS a, generate_subscripts(string_split(path, ' > '), 1) - 1 AS pos FROM down) SELECT a AS node_id, id AS descendant_id, depth - pos AS distance FROM pairs WHERE pos < depth"
P6_PATHS = (
    _LINKS
    + ", pairs AS (SELECT id, unnest(string_split(path, ' > ')) AS a FROM down), below AS (SELECT a, count(*) - 1 AS n FROM pairs GROUP BY a) SELECT r.id AS node_id, root_id, depth, path, coalesce(n, 0) AS n_below FROM resolved r LEFT JOIN below b ON b.a = r.id"
)

QUERIES = {f.__name__: f for f in (p6_found, p6_paths, p6_descendants)}
SQL = {"p6_found": P6_FOUND, "p6_paths": P6_PATHS, "p6_descendants": P6_DESCENDANTS}

"""Memories as Markdown files: <scope>/<slug>.md below a folder, read, written, exported and imported."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import collection_for, slugify, trim_all
from tessera.operators.memory import active, front_matter, parse_front_matter


def read_memories(spark: SparkSession, root: str) -> DataFrame:
    """All memories below root with their id from the path; index.md and unreadable documents are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
    files = files.where(~F.col("path").endswith("/index.md"))
    parts = F.split(F.regexp_replace("path", r"\.md$", ""), "/")
    files = files.select(F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)).alias("id"), "document")
    return parse_front_matter(files, "id")


def write_memories(memories: DataFrame, root: str) -> int:
    """One Markdown file <id>.md for each memory below root, as read_memories reads them; their number.

    For exports of bounded size, as each memory is a file of its own. Files are written by the
    executors, each whole under another name first and then renamed; an id that isn't a plain path
    below root is refused.
    """
    docs = front_matter(memories).join(memories.select("rev_id", "id"), "rev_id").where(F.col("id").rlike(r"^[a-z0-9-]+(?:/[a-z0-9-]+)*$")).select("id", "document")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for pdf in batches:
            for id_, document in zip(pdf["id"], pdf["document"]):
                place = f"{base.rstrip('/')}/{id_}.md"
                files.create_dir(place.rpartition("/")[0], recursive=True)
                with files.open_output_stream(f"{place}.part") as out:
                    out.write(document.encode())
                files.move(f"{place}.part", place)
            yield pd.DataFrame({"n": [len(pdf)]})

    return docs.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def export_tree(memories: DataFrame) -> DataFrame:
    """(wing, room, file, document) of the active memories; write it partitioned by wing and room."""
    rows = active(memories).where("id is not null")
    room = slugify(F.coalesce(F.col("collection"), collection_for(F.col("type"))), "general")
    place = rows.select("rev_id", slugify(F.coalesce("scope", F.lit("general")), "general").alias("wing"), room.alias("room"), F.concat(slugify(F.substring_index("id", "/", -1)), F.lit(".md")).alias("file"))
    return place.join(front_matter(rows), "rev_id").select("wing", "room", "file", "document")


def unreadable(tree: DataFrame) -> DataFrame:
    """One row: how many documents of a tree(path, document) have no readable front matter and are left out."""
    good = F.col("document").rlike(r"(?s)^---\r?\n(?:.*\n)?type:[ \t]*\S.*?\r?\n---")
    return tree.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("n_unreadable"))


def import_tree(tree: DataFrame) -> DataFrame:
    """Memories of a tree (path, document): the wing is the scope, the room the collection if the document names none and the path has one."""
    parts = F.split(F.col("path"), "/")
    depth = F.size(parts)
    rows = tree.select("path", "document", F.when(depth >= 3, F.element_at(parts, -2)).alias("room"), F.when(depth >= 2, F.element_at(parts, 1)).alias("wing"))
    parsed = parse_front_matter(rows, "path").join(rows.select("path", "room", "wing"), "path")
    return parsed.withColumn("collection", F.coalesce("collection", "room")).withColumn("scope", F.coalesce("wing", "scope")).drop("room", "wing")


def session_sections(memories: DataFrame, failures: DataFrame, max_memories: int = 15, max_open: int = 10, max_resolved: int = 5, markers: DataFrame | None = None, dirty: DataFrame | None = None, max_markers: int = 10, max_dirty: int = 20) -> DataFrame:
    """(section, rev_id, title, body) of a session's hand-over: newest memories, open and resolved failures, debt markers, changed files.

    markers is (id, line_no, comment), dirty is (file_path, status); either may be left out.
    """
    m = active(memories).orderBy(F.desc_nulls_last("ts"), F.desc("rev_id")).limit(max_memories).select(F.lit("memories").alias("section"), "rev_id", "title", "body")
    parts = [m]
    for status, limit in (("unresolved", max_open), ("resolved", max_resolved)):
        f = failures.where(F.col("status") == status).orderBy(F.desc("failure_id")).limit(limit)
        parts.append(f.select(F.lit(status).alias("section"), F.col("failure_id").alias("rev_id"), F.substring("command", 1, 80).alias("title"), F.coalesce("next_path", "symptom").alias("body")))
    if markers is not None:
        parts.append(markers.orderBy("id", "line_no").limit(max_markers).select(F.lit("markers").alias("section"), F.col("id").cast("long").alias("rev_id"), F.substring("comment", 1, 80).alias("title"), F.col("line_no").cast("string").alias("body")))
    if dirty is not None:
        parts.append(dirty.orderBy("file_path").limit(max_dirty).select(F.lit("dirty").alias("section"), F.lit(None).cast("long").alias("rev_id"), F.col("file_path").alias("title"), F.col("status").alias("body")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parse_session(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, title, body) of the ### blocks below headings on memories, decisions or failures; without such a heading, of all blocks."""
    section = F.split(F.col(text), r"(?m)^(?=## )")
    wanted = F.filter(section, lambda s: s.rlike(r"(?i)^## .*(?:memor|decision|failure)"))
    body = texts.where(F.col(text).isNotNull()).select(F.col(key), F.when(F.size(wanted) > 0, F.array_join(wanted, "\n")).otherwise(F.col(text)).alias("body"))
    blocks = F.filter(F.split("body", r"(?m)^(?=### )"), lambda b: b.startswith("### "))
    one = body.select(key, F.posexplode(blocks).alias("place", "b"))
    return one.select(key, "place", F.trim(F.regexp_extract("b", r"^### (.*)", 1)).alias("title"), trim_all(F.regexp_replace(F.regexp_replace("b", r"^### .*\n?", ""), r"(?s)\n## .*$", "")).alias("block"))

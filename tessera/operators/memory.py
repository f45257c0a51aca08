"""The versioned memory store: upserts, invalidation, deletion, status, recall, federation, migration, mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collection_for, has_keyword, memory_id, slugify, trim_all


def upsert_latest(versions: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of every key. max_by over a struct combines map-side, so a hot key is no hot task."""
    rest = [c for c in versions.columns if c not in keys]
    best = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v"))
    return best.select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])


def assign_ids(memories: DataFrame, scope: str = "scope", title: str = "title", first_seen: str = "rev_id") -> DataFrame:
    """(scope, title, id): slug ids, with -2, -3 ... for later titles whose slug is taken in their scope.

    Titles are told apart by case, slugs are not. A title without letters or digits gets a hash.
    """
    titles = memories.where(F.col(title).isNotNull()).groupBy(scope, title).agg(F.min(first_seen).alias("seen"))
    slug = slugify(F.col(title), F.substring(F.sha2(F.col(title), 256), 1, 8))
    titles = titles.withColumn("slug", slug).withColumn("room", slugify(F.coalesce(F.col(scope), F.lit("general")), "general"))
    number = F.row_number().over(Window.partitionBy("room", "slug").orderBy("seen", title))
    return titles.select(scope, title, F.concat("room", F.lit("/"), "slug", F.when(number > 1, F.concat(F.lit("-"), number.cast("string"))).otherwise("")).alias("id"))


def invalidate(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """memories with those named in ids(id, reason) marked, the reason appended to their body; of several the least counts."""
    marked = memories.join(ids.where("id is not null").groupBy("id").agg(F.min("reason").alias("reason")), "id", "left")
    hit = F.col("reason").isNotNull()
    body = F.when(hit, F.concat(F.coalesce("body", F.lit("")), F.lit("\n\n> Invalidated: "), "reason")).otherwise(F.col("body"))
    return marked.withColumn("body", body).withColumn("invalidated", F.when(hit, True).otherwise(F.col("invalidated"))).select(*memories.columns)


def delete(memories: DataFrame, ids: DataFrame | None = None, scope: str | None = None) -> DataFrame:
    """memories without those in ids(id) and without a scope; the scope's invalidated rows go too."""
    out = memories.join(ids.select("id").distinct(), "id", "left_anti").select(*memories.columns) if ids is not None else memories
    return out.where(~F.col("scope").eqNullSafe(scope)) if scope is not None else out


def active(memories: DataFrame) -> DataFrame:
    return memories.where(~F.coalesce("invalidated", F.lit(False)))


def get_memory(memories: DataFrame, id: str) -> DataFrame:
    """The rows of one memory; each name between slashes of the id is read as a slug."""
    return memories.where(F.col("id") == memory_id(F.lit(id)))


def find_by_title(memories: DataFrame, scope: str, title: str) -> DataFrame:
    """The rows of a scope with exactly this title, invalidated ones included."""
    return memories.where((slugify(F.coalesce("scope", F.lit("general")), "general") == slugify(F.lit(scope), "general")) & (F.col("title") == title))


def list_memories(memories: DataFrame, scope: str | None = None, collection: str | None = None, include_invalidated: bool = False) -> DataFrame:
    """Memories of a scope and a collection, compared as slugs; invalidated ones only if asked for."""
    rows = memories if include_invalidated else active(memories)
    if scope is not None:
        rows = rows.where(slugify(F.coalesce("scope", F.lit("general")), "general") == slugify(F.lit(scope), "general"))
    if collection is not None:
        rows = rows.where(slugify(F.coalesce("collection", F.lit("")), "") == slugify(F.lit(collection), ""))
    return rows


def imported_docs(docs: DataFrame, existing: DataFrame, scope: str | None = None) -> DataFrame:
    """(rev_id, id, collection, verdict) of documents to import: write, replace, or clash if the id belongs to another title.

    The id is the scope's slug and the slug of the document's own last name; a missing collection
    follows from the type. A clash stops an import, so callers look for clashes before they write.
    """
    room = slugify(F.coalesce(F.lit(scope) if scope else F.col("scope"), F.lit("general")), "general")
    kept = docs.where("id is not null").select("rev_id", "title", "type", "collection", F.concat(room, F.lit("/"), slugify(F.substring_index("id", "/", -1))).alias("id"))
    have = existing.groupBy("id").agg(F.min("title").alias("first"), F.max("title").alias("last"))
    joined = kept.join(have, "id", "left")
    verdict = F.when(F.col("first").isNull(), "write").when((F.col("first") == F.col("title")) & (F.col("last") == F.col("title")), "replace").otherwise("clash")
    return joined.select("rev_id", "id", slugify(F.coalesce("collection", F.lit("")), collection_for(F.col("type"))).alias("collection"), verdict.alias("verdict"))


def scope_index(memories: DataFrame) -> DataFrame:
    """(scope, place, line): the lines of each scope's index, by id, invalidated memories included.

    Places are counted inside a scope; written with the scope as a partition they are its index file.
    """
    rows = memories.where("id is not null").select(F.coalesce("scope", F.lit("general")).alias("scope"), "id", F.concat(F.lit("* ["), F.coalesce("title", F.lit("")), F.lit("](./"), F.substring_index("id", "/", -1), F.lit(".md) - "), F.coalesce("description", F.lit(""))).alias("line"))
    return rows.select("scope", "id", "line").distinct()


def log_lines(changes: DataFrame) -> DataFrame:
    """(at, line) of an append-only log from changes(at, action, id, title)."""
    return changes.select("at", F.concat(F.lit("* **"), "action", F.lit("**: "), "title", F.lit(" (`"), "id", F.lit("`)")).alias("line"))


def manifest(memories: DataFrame, at: str = "ts") -> DataFrame:
    """One row: how many memories there are, invalidated ones included, and when the last one changed."""
    return memories.agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("latest"))


def tree_counts(tree: DataFrame) -> DataFrame:
    """(wing, n_rooms, n_files) of an exported tree(wing, room, file)."""
    return tree.groupBy("wing").agg(F.countDistinct("room").alias("n_rooms"), F.count(F.lit(1)).alias("n_files"))


def failure_body() -> Column:
    """The body of a failure's record: command, status, advice and next path, each on a line of its own if it is known."""
    return F.concat_ws(
        "\n\n", F.concat(F.lit("**Command:** `"), "command", F.lit("`")), F.concat(F.lit("**Status:** "), "status"), F.concat(F.lit("⚠️ **Do NOT retry:** "), "do_not_retry"), F.concat(F.lit("→ **Next path:** "), "next_path"),
    )


def status(memories: DataFrame) -> DataFrame:
    """(scope, collection, n) with subtotals: a null collection row totals its scope, a null scope row everything."""
    named = active(memories).select(F.coalesce("scope", F.lit("general")).alias("scope"), F.coalesce("collection", F.lit("general")).alias("collection"))
    return named.rollup("scope", "collection").agg(F.count(F.lit(1)).alias("n"))


def recall(memories: DataFrame, limit: int = 20) -> DataFrame:
    """The newest active memories; unknown times last, ties by revision."""
    return active(memories).orderBy(F.desc_nulls_last("ts"), F.desc("rev_id")).limit(limit).select("rev_id", "id", "title")


def fingerprint(*fields: str) -> Column:
    """Hash of fields as JSON; nulls keep their place."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(f), F.lit("\x00")) for f in fields])), 256)


def federate(archive: DataFrame, legacy: DataFrame) -> DataFrame:
    """archive and those of legacy that aren't in it, by fingerprint of id, type, title and body."""
    key = fingerprint("id", "type", "title", "body")
    have = archive.select(key.alias("fp")).distinct()
    new = legacy.withColumn("fp", key).join(have, "fp", "left_anti").drop("fp")
    return archive.withColumn("archive_source", F.lit("archive")).unionByName(new.withColumn("archive_source", F.lit("legacy")))


def classify_migration(source: DataFrame, target: DataFrame) -> DataFrame:
    """(rev_id, id, title, verdict): copy, skip (there already), conflict_id, conflict_title or conflict_batch.

    One conflict stops a migration, so callers check for conflicts before they write.
    """
    same = F.sha2(F.concat_ws("\x01", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))), 256)
    s = source.select("rev_id", "id", "scope", "title", same.alias("fp"))
    t_id = target.groupBy("id").agg(F.max(same).alias("t_fp"))
    t_title = target.where(F.col("title").isNotNull()).groupBy("scope", "title").agg(F.max("id").alias("t_id"))
    batch = s.groupBy("id").agg(F.countDistinct("fp").alias("kinds"))
    joined = s.join(t_id, "id", "left").join(t_title, ["scope", "title"], "left").join(batch, "id", "left")
    verdict = (
        F.when(F.col("kinds") > 1, "conflict_batch").when(F.col("t_fp") == F.col("fp"), "skip").when(F.col("t_fp").isNotNull(), "conflict_id")
        .when(F.col("t_id").isNotNull() & (F.col("t_id") != F.col("id")), "conflict_title").otherwise("copy")
    )
    return joined.select("rev_id", "id", "title", verdict.alias("verdict"))


def mine_windows(texts: DataFrame, key: str, text: str, keywords: str | None = None, per_text: int = 20) -> DataFrame:
    """(key, block, first_line, last_line, title) of the blocks of lines around keywords.

    A keyword's line is taken with its neighbours; blocks that overlap or touch become one. Lines
    count from 0. The first per_text blocks of a text come out. All of it is a fold over each
    row's own array, so nothing is shuffled.
    """
    hit = (lambda line: has_keyword(line, keywords)) if keywords else (lambda line: has_keyword(line))
    lines = texts.where(F.col(text).isNotNull()).select(F.col(key), F.split(F.col(text), "\n").alias("lines"))
    at = F.filter(F.transform("lines", lambda line, i: F.when(hit(line), i)), lambda i: i.isNotNull())
    lines = lines.withColumn("at", at).where(F.size("at") > 0)
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")

    def grow(acc: Column, i: Column) -> Column:
        a, b = F.greatest(i - 1, F.lit(0)), F.least(i + 1, F.size("lines") - 1)
        last = F.try_element_at(acc, F.lit(-1))
        joins = last.isNotNull() & (a <= last["b"] + 1)
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(joins, F.concat(head, F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], b).alias("b"))))).otherwise(F.concat(acc, F.array(F.struct(a.alias("a"), b.alias("b")))))

    blocks = lines.select(key, "lines", F.slice(F.aggregate("at", none, grow), 1, per_text).alias("blocks"))
    blocks = blocks.select(key, "lines", F.posexplode("blocks").alias("block", "r"))
    inside = F.transform(F.slice("lines", F.col("r.a") + 1, F.col("r.b") - F.col("r.a") + 1), trim_all)
    first = F.try_element_at(F.filter(inside, hit), F.lit(1))
    return blocks.select(key, "block", F.col("r.a").alias("first_line"), F.col("r.b").alias("last_line"), F.substring(F.regexp_replace(first, r"^[-*#\s]+", ""), 1, 80).alias("title"))


def front_matter(memories: DataFrame) -> DataFrame:
    """(rev_id, document): each memory as a Markdown document with its front matter, keys in a fixed order."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', 1)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    fields = [
        line("type", F.col("type")), line("title", quoted("title")), line("description", quoted("description")), line("tags", F.to_json("tags")), line("scope", F.col("scope")),
        line("collection", F.col("collection")), line("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), line("source", F.col("source")), line("supersedes", quoted("supersedes")),
        F.when(F.col("invalidated"), F.lit("invalidated: true")),
    ]
    return memories.select("rev_id", F.concat(F.lit("---\n"), F.concat_ws("\n", *fields), F.lit("\n---\n\n"), F.coalesce("body", F.lit(""))).alias("document"))


def parse_front_matter(documents: DataFrame, key: str = "rev_id", document: str = "document") -> DataFrame:
    """(key, type, title, description, tags, scope, collection, ts, source, supersedes, invalidated, body) of Markdown documents.

    Fields are read one by one with defaults for absent ones; a document without a type gives no row.
    """
    head = F.regexp_extract(F.col(document), r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    raw = documents.where(F.col(document).startswith("---")).select(key, head.alias("head"), F.regexp_replace(F.col(document), r"(?s)^---\r?\n.*?\r?\n---(?:\r?\n){0,2}", "").alias("body"))
    bare = lambda name: F.nullif(F.regexp_extract("head", rf"(?m)^{name}:[ \t]*(.*)$", 1), F.lit(""))
    text = lambda name: F.when(bare(name).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), bare(name), F.lit("}")), "$.v")).otherwise(bare(name))
    out = raw.select(
        key, bare("type").alias("type"), text("title").alias("title"), text("description").alias("description"), F.coalesce(F.from_json(bare("tags"), "array<string>"), F.array().cast("array<string>")).alias("tags"),
        F.coalesce(bare("scope"), F.lit("general")).alias("scope"), bare("collection").alias("collection"), F.coalesce(F.try_to_timestamp(bare("timestamp")), F.current_timestamp()).alias("ts"),
        bare("source").alias("source"), text("supersedes").alias("supersedes"), (F.coalesce(bare("invalidated"), F.lit("")) == "true").alias("invalidated"), "body",
    )
    return out.where(F.col("type").isNotNull())

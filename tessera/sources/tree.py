"""Source trees: listing, admission, change detection, line search and ranges of lines."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What is read, and what is left out.
EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "py", "go", "rs", "java")
IGNORED = ("node_modules", ".git", "dist", "build", "coverage", ".next", ".nuxt", ".DS_Store")
IGNORED_ENDINGS = ("lock", "log")


def should_index(path: Column, ignored: tuple[str, ...] = (), rules: list[tuple[str, bool]] = []) -> Column:  # noqa: B006
    """Whether a path, relative to the root, is admitted; one filter for batches and streams. rules are those of read_ignores."""
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*IGNORED, *ignored))
    ending = F.lower(F.substring_index(path, ".", -1))
    return ending.isin(*EXTENSIONS) & ~ending.isin(*IGNORED_ENDINGS) & ~hidden & ~ignored_by(path, rules) & ~path.startswith("../") & ~path.contains("/../")


def read_ignores(text: str) -> list[tuple[str, bool]]:
    """(expression, whether it admits again) of a .gitignore's lines, to be tried in order; the last that matches counts."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        again = line.startswith("!")
        rule = line[again:].lstrip("\\") if line[again:].startswith(("\\#", "\\!")) else line[again:]
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        anchored = "/" in rule
        body = ""
        for part in re.findall(r"/\*\*/|\*\*/|/\*\*|\*|\?|\[[^\]]+\]|.", rule.lstrip("/")):
            body += {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part, part if part[0] == "[" and len(part) > 1 else re.escape(part))
        out.append((f"{'^' if anchored else '(?:^|/)'}{body}{'/' if folder else '(?:/|$)'}", again))
    return out


def ignored_by(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether a relative path is ignored; the rules are configuration, a handful, and become expressions."""
    out = F.lit(False)
    for expression, again in rules:
        out = F.when(path.rlike(expression), F.lit(not again)).otherwise(out)
    return out


def read_aliases(text: str) -> list[tuple[str, str]]:
    """(pattern, target) of the path aliases of a tsconfig with comments; none if it can't be read.

    Of several targets the first counts; targets are read from the base folder.
    """
    bare = re.sub(r'("(?:\\.|[^"\\])*")|/\*[\s\S]*?\*/|//[^\n]*', lambda m: m[1] or "", text)
    bare = re.sub(r",(\s*[}\]])", r"\1", bare)
    try:
        options = json.loads(bare).get("compilerOptions") or {}
        base = str(options.get("baseUrl") or ".").rstrip("/")
        pairs = [(k, v[0]) for k, v in (options.get("paths") or {}).items() if isinstance(v, list) and v and isinstance(v[0], str)]
    except (ValueError, AttributeError, TypeError):
        return []
    return [(k, v if base in ("", ".") else f"{base}/{v}") for k, v in pairs]


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^[a-z]+:/*", "/"), "^" + root.rstrip("/").replace("\\", "\\\\").replace(".", "\\.") + "/", "")


def list_files(spark: SparkSession, root: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(file_path, size, mtime_ms, content) of the admitted files below root; unread columns are never loaded.

    The root's own .gitignore counts.
    """
    place = Path(root) / ".gitignore"
    rules = read_ignores(place.read_text()) if place.is_file() else []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select(relative(F.col("path"), root).alias("file_path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")
    return files.where(should_index(F.col("file_path"), ignored, rules))


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha2("content", 256))


def classify_files(now: DataFrame, state: DataFrame) -> DataFrame:
    """(file_path, verdict): new, stale, unchanged or gone.

    Both are (file_path, content_hash, size, mtime_ms). The same size and time mean unchanged
    without a look at the hash; otherwise the hash decides.
    """
    a = now.select("file_path", F.col("content_hash").alias("h1"), F.col("size").alias("s1"), F.col("mtime_ms").alias("m1"), F.lit(True).alias("is_now"))
    b = state.select("file_path", F.col("content_hash").alias("h0"), F.col("size").alias("s0"), F.col("mtime_ms").alias("m0"), F.lit(True).alias("was"))
    same = (F.col("s1") == F.col("s0")) & (F.col("m1") == F.col("m0")) | (F.col("h1") == F.col("h0"))
    verdict = F.when(F.col("was").isNull(), "new").when(F.col("is_now").isNull(), "gone").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("stale")
    return a.join(b, "file_path", "full_outer").select("file_path", verdict.alias("verdict"))


def grep(files: DataFrame, key: str, content: str, pattern: str, per_file: int = 50, limit: int | None = None, case: bool = False) -> DataFrame:
    """(key, line_no, line) of matching lines, the first per_file of each file and at most limit in all."""
    regex = pattern if case else f"(?i){pattern}"
    rows = files.where(F.col(content).rlike(regex)).select(F.col(key), F.split(F.col(content), "\n").alias("lines"))
    hits = F.filter(F.transform("lines", lambda line, i: F.when(line.rlike(regex), F.struct((i + 1).alias("line_no"), line.alias("line")))), lambda h: h.isNotNull())
    out = rows.select(key, F.explode(F.slice(hits, 1, per_file)).alias("h")).select(key, "h.line_no", "h.line")
    return out.orderBy(key, "line_no").limit(max(1, min(1000, limit))) if limit is not None else out


def line_range(files: DataFrame, key: str, content: str, first: int | None = None, last: int | None = None, max_size: int = 5 << 20) -> DataFrame:
    """(key, text) with the lines first to last, both included and kept within the file; larger files give null."""
    lines = F.split(F.col(content), "\n")
    a = F.least(F.lit(max(1, first or 1)), F.size(lines))
    b = F.least(F.greatest(F.lit(last if last is not None else 1 << 30), a), F.size(lines))
    return files.select(F.col(key), F.when(F.octet_length(F.col(content)) <= max_size, F.array_join(F.slice(lines, a, b - a + 1), "\n")).alias("text"))


def walk(files: DataFrame, depth: int = 5, contains: str = "") -> DataFrame:
    """(file_path) down to a depth, without hidden, node_modules and dist folders, names holding a substring."""
    parts = F.split("file_path", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin("node_modules", "dist"))
    return files.select("file_path").where((F.size(parts) <= depth) & ~hidden & F.col("file_path").contains(contains))

"""Diff analytics: hunks, changed symbols, tests of symbols, review packs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_test_file
from tessera.operators.graph import clean_path, join_path


def hunk_ranges(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, hunk, start, end): the new lines of every hunk of a diff.

    A hunk that only deletes gives the inverted range (start + 1, start): an overlap test then
    asks for strict containment. Null and empty diffs and lines without a range give no row.
    """
    lines = diffs.where(F.col(diff).isNotNull()).select(F.col(key), F.filter(F.split(F.col(diff), "\n"), lambda x: x.startswith("@@ ")).alias("hunks"))
    one = lines.select(key, F.posexplode("hunks").alias("hunk", "line"))
    start = F.regexp_extract("line", r"\+(\d+)(?:,(\d+))?", 1)
    count = F.regexp_extract("line", r"\+(\d+)(?:,(\d+))?", 2)
    one = one.where(start != "").select(key, "hunk", start.cast("long").alias("s"), F.when(count == "", 1).otherwise(count.try_cast("long")).alias("c"))
    return one.select(key, "hunk", F.when(F.col("c") == 0, F.col("s") + 1).otherwise(F.col("s")).alias("start"), F.when(F.col("c") == 0, F.col("s")).otherwise(F.col("s") + F.col("c") - 1).alias("end"))


def decode_git_path(value: str) -> str:
    """A path as git prints it, with quotes and escaped bytes undone."""
    if len(value) < 2 or not (value.startswith('"') and value.endswith('"')):
        return value
    simple = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13}
    out = bytearray()
    for m in re.finditer(r"\\([0-7]{1,3})|\\(.)|([^\\]+)", value[1:-1], re.S):
        if m[1]:
            out.append(int(m[1], 8) & 255)
        elif m[2]:
            out += bytes([simple[m[2]]]) if m[2] in simple else m[2].encode()
        else:
            out += m[3].encode()
    return out.decode("utf-8", "replace")


def parse_name_status(raw: str) -> list[tuple[str, str, str | None]]:
    """(status, path, old path) of the lines of a name-status listing."""
    out = []
    for line in filter(None, raw.split("\n")):
        status, *paths = line.split("\t")
        if status[:1] in "RC" and len(paths) > 1:
            out.append((status, decode_git_path(paths[1]), decode_git_path(paths[0])))
        elif paths and paths[0]:
            out.append((status, decode_git_path(paths[0]), None))
    return out


def git_log(logs: DataFrame, text: str, max_lines: int = 20, keep: str | None = None) -> DataFrame:
    """([keep,] hash, date, author, message, diff) of log texts with records 'commit', 'Author:', 'Date:', a message and a patch.

    Of a patch only lines that begin with +, - or @ are kept, at most max_lines.
    """
    record = F.explode(F.filter(F.split(F.col(text), r"(?m)^(?=commit [0-9a-f]{7,40}\b)"), lambda r: r.startswith("commit ")))
    kept_column = [F.col(keep)] if keep else []
    one = logs.select(*kept_column, record.alias("r"))
    lines = F.split("r", "\n")
    message = F.array_join(F.transform(F.filter(lines, lambda x: x.startswith("    ")), lambda x: F.trim(x)), "\n")
    kept = F.filter(lines, lambda x: x.rlike(r"^[+\-@]") & ~x.rlike(r"^(?:\+\+\+|---) "))
    return one.select(
        *kept_column, F.regexp_extract("r", r"^commit ([0-9a-f]+)", 1).alias("hash"), F.trim(F.regexp_extract("r", r"(?m)^Date:\s*(.*)$", 1)).alias("date"),
        F.trim(F.regexp_extract("r", r"(?m)^Author:\s*(.*)$", 1)).alias("author"), message.alias("message"), F.array_join(F.slice(kept, 1, max_lines), "\n").alias("diff"),
    )


def changed_symbols(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of symbols(file_path, start_line, end_line, ...) that overlap a range(file_path, start, end) of their file.

    The file is the equi-join key and the overlap a residual. A file with very many ranges and
    symbols, like a generated one, would pair them all: both are put into bins of 256 lines first.
    """
    width = 256
    s = symbols.where("start_line is not null and end_line is not null")
    lo, hi = F.least("start_line", "end_line"), F.greatest("start_line", "end_line")
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    left = s.withColumn("_bin", bins(lo, hi)).withColumnRenamed("file_path", "_file")
    r = ranges.select(F.col("file_path").alias("r_file"), "start", "end").where("start is not null and end is not null")
    right = r.withColumn("r_bin", bins(F.least("start", "end"), F.greatest("start", "end")))
    hit = left.join(right, (F.col("_file") == F.col("r_file")) & (F.col("_bin") == F.col("r_bin")) & (F.col("start_line") <= F.col("end")) & (F.col("end_line") >= F.col("start")), "left_semi")
    return hit.withColumnRenamed("_file", "file_path").drop("_bin").distinct()


def test_associations(symbols: DataFrame, tests: DataFrame) -> DataFrame:
    """(symbol_name, source_file, test_file, confidence) from test files(path, content).

    An imported name belongs to the file its specifier leads to; a bare specifier only decides if
    one file has the name. A name that is only mentioned counts if exactly one file has it, it has
    four letters and the test file imports no such name.
    """
    source = symbols.where(~is_test_file(F.col("file_path")) & F.col("name").isNotNull()).select("name", clean_path(F.col("file_path")).alias("source_file")).distinct()
    owners = source.groupBy("name").agg(F.count(F.lit(1)).alias("owners"), F.min("source_file").alias("only"))
    t = tests.where(F.col("content").isNotNull()).select(clean_path(F.col("path")).alias("test_file"), "content")
    named = F.regexp_extract_all("content", F.lit(r"import\s+\{([^}]+)\}\s+from\s+['\"][^'\"]+['\"]"), F.lit(1))
    where = F.regexp_extract_all("content", F.lit(r"import\s+\{[^}]+\}\s+from\s+['\"]([^'\"]+)['\"]"), F.lit(1))
    braces = F.flatten(F.zip_with(named, where, lambda names, spec: F.transform(F.split(names, ","), lambda x: F.struct(F.trim(F.regexp_replace(F.trim(x), r"\s+as\s+.*$", "")).alias("name"), spec.alias("specifier")))))
    names = F.regexp_extract_all("content", F.lit(r"import\s+([A-Za-z_]\w*)\s+from\s+['\"][^'\"]+['\"]"), F.lit(1))
    specs = F.regexp_extract_all("content", F.lit(r"import\s+[A-Za-z_]\w*\s+from\s+['\"]([^'\"]+)['\"]"), F.lit(1))
    default = F.zip_with(names, specs, lambda x, y: F.struct(x.alias("name"), y.alias("specifier")))
    imports = t.select("test_file", F.explode(F.concat(braces, default)).alias("i")).select("test_file", "i.name", "i.specifier").where("name <> ''").distinct()
    goal = join_path(F.col("test_file"), F.col("specifier"))
    i = imports.join(source, "name").join(owners, "name").withColumn("goal", goal)
    bare = F.regexp_replace("source_file", r"\.[^./]+$", "")
    leads = F.when(F.col("specifier").startswith("."), (F.col("source_file") == F.col("goal")) | (bare == F.col("goal")) | (bare == F.concat("goal", F.lit("/index")))).otherwise(F.col("owners") == 1)
    by_import = i.where(leads).select(F.col("name").alias("symbol_name"), "source_file", "test_file", F.lit("import").alias("confidence")).distinct()
    words = t.select("test_file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))).alias("name")).where(F.length("name") >= 4)
    mention = words.join(imports.select("test_file", "name").distinct(), ["test_file", "name"], "left_anti").join(owners.where("owners = 1"), "name")
    mentioned = mention.select(F.col("name").alias("symbol_name"), F.col("only").alias("source_file"), "test_file", F.lit("mention").alias("confidence"))
    return by_import.unionByName(mentioned)


def untested(changed: DataFrame, associations: DataFrame) -> DataFrame:
    """Changed symbols outside tests that no test is associated with."""
    have = associations.select(F.col("symbol_name").alias("name"), F.col("source_file").alias("file_path")).distinct()
    return changed.where(~is_test_file(F.col("file_path"))).join(have, ["name", "file_path"], "left_anti")


def callers(changed: DataFrame, edges: DataFrame, limit: int = 8) -> DataFrame:
    """(node, n_callers, callers): extracted references to changed(node), the first by name.

    Counts combine map-side; the names kept are the first `limit` of a rank, so a node that
    everything calls makes no long list.
    """
    inbound = edges.where("type <> 'contains' and confidence = 'EXTRACTED'").select(F.col("dst").alias("node"), "src").distinct().join(changed.select("node").distinct(), "node", "left_semi")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("src"))
    named = inbound.withColumn("k", rank).where(F.col("k") <= limit).groupBy("node").agg(F.array_join(F.sort_array(F.collect_list("src")), ", ").alias("callers"))
    return inbound.groupBy("node").agg(F.count(F.lit(1)).alias("n_callers")).join(named, "node")


def mentions_of_paths(texts: DataFrame, key: str, text: str, paths: DataFrame) -> DataFrame:
    """(path, n): how many texts contain each path(file_path).

    Paths are taken out of the texts and joined by equality; a text that holds a path inside a
    longer one is found by the path's own tails.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"([\w./-]*\w\.\w{1,8})"), F.lit(1)))
    found = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.explode(tokens).alias("token"))
    parts = F.split("token", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    tails = found.select("k", F.explode(tails).alias("path")).distinct()
    return tails.join(paths.select(F.col("file_path").alias("path")).distinct(), "path", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def review_pack(
    changed_files: DataFrame, symbols: DataFrame, ranges: DataFrame, edges: DataFrame, associations: DataFrame, max_files: int = 20, debts: DataFrame | None = None, mentions: DataFrame | None = None
) -> DataFrame:
    """(file_path, status, n_symbols, n_untested, n_callers, n_debts, n_failures, n_touched, truncated) of the first changed files, by path.

    changed_files is (file_path) or (file_path, status). Files without changed symbols count 0, a
    deleted file (status D) has none. debts is (file_path) of debt markers, mentions (path, n) of
    failures that name a path. n_touched counts all changed files, truncated says that some are left out.
    """
    files = changed_files.select("file_path", (F.col("status") if "status" in changed_files.columns else F.lit("M")).alias("status")).groupBy("file_path").agg(F.max("status").alias("status"))
    total = files.agg(F.count(F.lit(1)).alias("n_touched"))
    first = files.orderBy("file_path").limit(max_files)
    live = first.where(~F.col("status").startswith("D"))
    hit = changed_symbols(symbols, ranges.join(live, "file_path", "left_semi"))
    node = F.concat_ws(":", F.lit("symbol"), "file_path", "name", F.coalesce(F.col("start_line").cast("string"), F.lit("0")))
    hit = hit.select("file_path", "name", "start_line").distinct().withColumn("node", node)
    bare = untested(hit, associations).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_untested"))
    calls = hit.join(callers(hit, edges), "node").groupBy("file_path").agg(F.sum("n_callers").alias("n_callers"))
    n = hit.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_symbols"))
    spark = symbols.sparkSession
    debt = debts.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_debts")) if debts is not None else spark.createDataFrame([], "file_path string, n_debts long")
    said = mentions.select(F.col("path").alias("file_path"), F.col("n").alias("n_failures")) if mentions is not None else spark.createDataFrame([], "file_path string, n_failures long")
    out = first
    for part in (n, bare, calls, debt, said):
        out = out.join(part, "file_path", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_symbols", "n_untested", "n_callers", "n_debts", "n_failures")]
    return out.join(F.broadcast(total)).select("file_path", "status", *counts, "n_touched", (F.col("n_touched") > max_files).alias("truncated"))


def risks(pack: DataFrame) -> DataFrame:
    """(file_path, risk) of a review pack: open debt, changed symbols without a test, failures that name the file."""
    told = F.filter(
        F.array(
            F.when(F.col("n_debts") > 0, "has open debt markers"), F.when((F.col("n_untested") > 0) & ~is_test_file(F.col("file_path")), F.concat(F.col("n_untested").cast("string"), F.lit(" changed symbol(s) have no matching test"))),
            F.when(F.col("n_failures") > 0, F.concat(F.col("n_failures").cast("string"), F.lit(" past failure record(s) mention this file"))),
        ), lambda x: x.isNotNull(),
    )
    return pack.select("file_path", F.explode(told).alias("risk"))


def marker_heat(markers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n): how many markers(file_path) stand in each node's file; a marker's path may be the tail of the node's."""
    parts = F.split(F.regexp_replace("file_path", r"^\./", ""), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    counted = markers.where("file_path is not null").groupBy(F.regexp_replace("file_path", r"^\./", "").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.where("file_path is not null").select("node", F.explode(F.array_distinct(tails)).alias("path")).join(counted, "path").groupBy("node").agg(F.sum("n").alias("n"))


def failure_heat(texts: DataFrame, key: str, text: str, nodes: DataFrame) -> DataFrame:
    """(node, n): how many texts name each node's file by its last name."""
    base = F.element_at(F.split("file_path", "/"), -1)
    files = nodes.where("file_path is not null").select("node", base.alias("path"))
    counted = mentions_of_paths(texts, key, text, files.select(F.col("path").alias("file_path")))
    return files.join(counted, "path").select("node", "n")


def impact_tests(affected: DataFrame, associations: DataFrame) -> DataFrame:
    """(test_file) of all tests of the affected(name, file_path), in order."""
    have = associations.select(F.col("symbol_name").alias("name"), F.col("source_file").alias("file_path"), "test_file")
    return have.join(affected.select("name", "file_path").distinct(), ["name", "file_path"], "left_semi").select("test_file").distinct().orderBy("test_file")


def inject_block(text: Column, block: Column, name: str = "handoff") -> Column:
    """text with a named block put in or replaced; putting it in twice changes nothing."""
    head, tail = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    full = F.concat(F.lit(head + "\n"), block, F.lit("\n" + tail))
    has = text.contains(head) & text.contains(tail)
    before = F.substring_index(text, head, 1)
    after = F.substring_index(text, tail, -1)
    return F.when(has, F.concat(before, full, after)).otherwise(F.concat(text, F.lit("\n\n"), full))

"""The symbol graph: edges with confidence, import resolution, hubs, neighbourhoods, paths and impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.inverted import InvertedIndex
from tessera.plans.cut import Cutter

# What is tried, in this order, to find the file of an import.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
MAX_PASSES = 5


def clean_path(path: Column) -> Column:
    """A path with forward slashes, without ./ and // and with .. resolved."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/+"), lambda p: (p != "") & (p != "."))
    none = F.expr("cast(array() as array<string>)")
    fold = F.aggregate(parts, none, lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("x")), acc), -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(fold, "/")


def join_path(base: Column, relative: Column) -> Column:
    """relative as seen from the folder of the file base."""
    return clean_path(F.concat(F.regexp_replace(base, r"[^/]*$", ""), relative))


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    """(node, file_path, name, type, start_line), one for each path, name and line; the newest row's type counts."""
    rows = symbols.select(clean_path(F.col("file_path")).alias("file_path"), "name", "type", "start_line", "id").where("name is not null and file_path is not null")
    one = rows.groupBy("file_path", "name", "start_line").agg(F.max_by("type", "id").alias("type"))
    return one.select(F.concat_ws(":", F.lit("symbol"), "file_path", "name", F.coalesce(F.col("start_line").cast("string"), F.lit("0"))).alias("node"), "file_path", "name", "type", "start_line")


def references(symbols: DataFrame) -> DataFrame:
    """(node, file_path, owner, ref_name, ref_type, specifier) of all references but imports, with the last import of the name."""
    rows = symbols.where("name is not null and file_path is not null").select(clean_path(F.col("file_path")).alias("file_path"), "name", "start_line", "refs")
    imports = F.filter("refs", lambda r: r["type"] == "import")
    rows = rows.withColumn("imports", imports).select("file_path", "name", "start_line", "imports", F.explode("refs").alias("r")).where("r.type <> 'import'")
    last = F.try_element_at(F.filter("imports", lambda i: i["name"] == F.col("r.name")), F.lit(-1))["specifier"]
    node = F.concat_ws(":", F.lit("symbol"), "file_path", "name", F.coalesce(F.col("start_line").cast("string"), F.lit("0")))
    return rows.select(node.alias("node"), "file_path", F.col("name").alias("owner"), F.col("r.name").alias("ref_name"), F.col("r.type").alias("ref_type"), last.alias("specifier")).distinct()


def resolve_specifiers(wanted: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """(file_path, specifier, target): the first candidate that is a file, for each distinct pair of wanted.

    Relative specifiers are read from the importing file. An alias is a pattern with one * and a
    target with one *; aliases are configuration, a handful, and become expressions.
    """
    pairs = wanted.select("file_path", "specifier").where("specifier is not null").distinct()
    bases = [F.when(F.col("specifier").startswith("."), join_path(F.col("file_path"), F.col("specifier")))]
    for pattern, target in aliases:
        head, _, tail = pattern.partition("*")
        t_head, _, t_tail = target.partition("*")
        hit = F.col("specifier").startswith(head) & F.col("specifier").endswith(tail) & (F.length("specifier") >= len(head) + len(tail))
        middle = F.expr(f"substring(specifier, {len(head) + 1}, length(specifier) - {len(head) + len(tail)})")
        bases.append(F.when(hit, clean_path(F.concat(F.lit(t_head), middle, F.lit(t_tail)))))
    candidates = F.filter(F.array(*[F.concat(b, F.lit(s)) for b in bases for s in SUFFIXES]), lambda c: c.isNotNull())
    probes = pairs.select("file_path", "specifier", F.posexplode(candidates).alias("n", "target"))
    found = probes.join(files.select(F.col("file_path").alias("target")).distinct(), "target")
    return found.groupBy("file_path", "specifier").agg(F.min_by("target", "n").alias("target"))


def expand_reexports(direct: DataFrame, reexports: DataFrame) -> DataFrame:
    """(file_path, name, origin, origin_name) of everything a file exports, through up to MAX_PASSES re-exports.

    direct is (file_path, name); reexports is (file_path, target, imported, exported), a * for all.
    A name a file exports itself hides re-exports of it. Passes stop when nothing new is found.
    """
    cutter = Cutter(direct.sparkSession, "reexports")
    known = direct.select("file_path", "name", F.col("file_path").alias("origin"), F.col("name").alias("origin_name")).distinct()
    fresh = known
    for _ in range(MAX_PASSES):
        source = fresh.select(F.col("file_path").alias("target"), F.col("name").alias("t_name"), "origin", "origin_name")
        step = reexports.join(source, "target").where("imported = '*' or imported = t_name")
        step = step.select("file_path", F.when(F.col("imported") == "*", F.col("t_name")).otherwise(F.col("exported")).alias("name"), "origin", "origin_name").distinct()
        fresh = cutter.cut(step.join(known.select("file_path", "name"), ["file_path", "name"], "left_anti").groupBy("file_path", "name").agg(F.min(F.struct("origin", "origin_name")).alias("o")).select("file_path", "name", "o.*"))
        if fresh.isEmpty():
            break
        known = cutter.cut(known.unionByName(fresh))
    return known


def build_edges(symbols: DataFrame, exports: DataFrame | None = None, aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """(src, dst, type, confidence, reason), one row for each (src, dst, type).

    A file contains its symbols. A reference goes to the only symbol of its name; of several, to
    those in the imported file, else to those in its own file, else to all as INFERRED. A name
    that no symbol has goes where the import's re-exports lead. No edge leads to itself.

    A name that very many symbols share makes as many edges for each of its references: that is
    the defined result. The targets of a name are counted before the join, and references with a
    file to go to are joined by name and file, so only truly ambiguous ones fan out.
    """
    cutter = Cutter(symbols.sparkSession, "edges")
    nodes = cutter.cut(symbol_nodes(symbols))  # read in five places below
    contains = nodes.select(F.concat(F.lit("file:"), "file_path").alias("src"), F.col("node").alias("dst"), F.lit("contains").alias("type"), F.lit("EXTRACTED").alias("confidence"), F.lit("declared in file").alias("reason"))
    refs = references(symbols)
    files = nodes.select("file_path").distinct()
    imported = resolve_specifiers(refs, files, list(aliases))
    refs = refs.join(imported, ["file_path", "specifier"], "left")
    if exports is not None:
        e = exports.select(F.col("file_path").alias("target"), F.col("name").alias("ref_name"), "origin", "origin_name")
        refs = refs.join(e, ["target", "ref_name"], "left")
    else:
        refs = refs.withColumn("origin", F.lit(None).cast("string")).withColumn("origin_name", F.lit(None).cast("string"))
    refs = refs.withColumn("goal", F.coalesce("origin", "target")).withColumn("goal_name", F.coalesce("origin_name", "ref_name"))
    count = nodes.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("only"))
    by_file = nodes.select(F.col("file_path").alias("t_file"), F.col("name").alias("t_name"), F.col("node").alias("dst"))
    in_file = nodes.groupBy("file_path", "name").agg(F.count(F.lit(1)).alias("here")).select(F.col("file_path").alias("h_file"), F.col("name").alias("h_name"), "here")
    refs = refs.join(count.select(F.col("name").alias("ref_name"), "n", "only"), "ref_name", "left")
    refs = refs.join(in_file.withColumnRenamed("here", "at_goal"), (F.col("goal") == F.col("h_file")) & (F.col("goal_name") == F.col("h_name")), "left").drop("h_file", "h_name")
    refs = refs.join(in_file.withColumnRenamed("here", "at_home"), (F.col("file_path") == F.col("h_file")) & (F.col("ref_name") == F.col("h_name")), "left").drop("h_file", "h_name")
    self_here = F.when(F.col("owner") == F.col("ref_name"), 1).otherwise(0)
    kind = (
        F.when(F.col("n") == 1, "one").when(F.col("at_goal") > 0, "import").when(F.col("n").isNull(), None)
        .when(F.coalesce("at_home", F.lit(0)) - self_here > 0, "home").otherwise("any")
    )
    refs = cutter.cut(refs.withColumn("kind", kind).where("kind is not null").select("node", "file_path", "ref_name", "ref_type", "only", "goal", "goal_name", "kind"))
    one = refs.where("kind = 'one'").select("node", F.col("only").alias("dst"), "ref_type", F.lit("EXTRACTED").alias("confidence"), F.lit("only symbol of the name").alias("reason"))
    goal = refs.where("kind = 'import'").join(by_file, (F.col("goal") == F.col("t_file")) & (F.col("goal_name") == F.col("t_name"))).select("node", "dst", "ref_type", F.lit("EXTRACTED").alias("confidence"), F.lit("imported file").alias("reason"))
    home = refs.where("kind = 'home'").join(by_file, (F.col("file_path") == F.col("t_file")) & (F.col("ref_name") == F.col("t_name"))).select("node", "dst", "ref_type", F.lit("EXTRACTED").alias("confidence"), F.lit("same file").alias("reason"))
    wide = refs.where("kind = 'any'").join(by_file.drop("t_file"), F.col("ref_name") == F.col("t_name")).select("node", "dst", "ref_type", F.lit("INFERRED").alias("confidence"), F.lit("ambiguous name").alias("reason"))
    linked = one.unionByName(goal).unionByName(home).unionByName(wide).where("node <> dst").select(F.col("node").alias("src"), "dst", F.col("ref_type").alias("type"), "confidence", "reason")
    linked = linked.groupBy("src", "dst", "type").agg(F.min(F.struct("confidence", "reason")).alias("v")).select("src", "dst", "type", "v.confidence", "v.reason")
    return contains.unionByName(linked)


def visible(edges: DataFrame, inferred: bool = False) -> DataFrame:
    return edges if inferred else edges.where("confidence = 'EXTRACTED'")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree): each edge counts at both of its ends, nodes without edges have 0."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("node").distinct().join(ends, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), "node").limit(limit)


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b): steps along, against or both ways."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def reach(edges: DataFrame, starts: DataFrame, direction: str = "both", depth: int = 5, limit: int | None = None) -> DataFrame:
    """(node, depth): what can be reached from starts(node) within depth steps, by its least depth.

    A frontier is joined with the steps once for each depth and cut from its lineage; nodes
    reached before are left out, so every node is expanded once. limit keeps the nearest nodes,
    ties by name, as a neighbourhood view does.
    """
    cutter = Cutter(edges.sparkSession, "reach")
    steps = cutter.cut(directed(edges, direction).distinct())  # read again for each depth
    seen = cutter.cut(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for k in range(1, depth + 1):
        nxt = frontier.select(F.col("node").alias("a")).join(steps, "a").select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(k))
        frontier = cutter.cut(nxt)
        if frontier.isEmpty():
            break
        seen = cutter.cut(seen.unionByName(frontier))
        if limit is not None and seen.count() >= limit:
            break
    return seen.orderBy("depth", "node").limit(limit) if limit is not None else seen


def shortest_path(edges: DataFrame, start: str, goal: str, depth: int | None = None) -> DataFrame:
    """(step, node, via): one shortest way from start to goal, edges taken both ways; no row if there is none.

    Of several predecessors the smallest name is kept, so the way is always the same. The search
    ends when the goal is found or nothing new is reached, or after depth steps if that is given.
    """
    spark = edges.sparkSession
    cutter = Cutter(spark, "path")
    steps = cutter.cut(edges.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), "type"), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), "type"))).alias("e")).select("e.*"))
    seen = cutter.cut(spark.createDataFrame([(start, None, None, 0)], "node string, parent string, via string, depth int"))
    frontier, found = seen, start == goal
    k = 0
    while not found and (depth is None or k < depth):
        k += 1
        nxt = frontier.select(F.col("node").alias("a")).join(steps, "a").groupBy("b").agg(F.min(F.struct("a", "type")).alias("p"))
        nxt = nxt.select(F.col("b").alias("node"), F.col("p.a").alias("parent"), F.col("p.type").alias("via"), F.lit(k).alias("depth")).join(seen.select("node"), "node", "left_anti")
        frontier = cutter.cut(nxt)
        if frontier.isEmpty():
            break
        seen = cutter.cut(seen.unionByName(frontier))
        found = not frontier.where(F.col("node") == goal).isEmpty()
    if not found:
        return spark.createDataFrame([], "step int, node string, via string")
    way, at = [], goal
    while at is not None:  # as many lookups as the path has steps
        row = seen.where(F.col("node") == at).first()
        way.append((row["depth"], row["node"], row["via"]))
        at = row["parent"]
    return spark.createDataFrame(sorted(way), "step int, node string, via string")


def impact(edges: DataFrame, changed: DataFrame, depth: int = 2) -> DataFrame:
    """(node, depth): who depends on the changed(node), through extracted edges other than containment."""
    inbound = visible(edges).where("type <> 'contains'")
    return reach(inbound, changed, "in", depth).where("depth > 0")


def neighbours(edges: DataFrame, seeds: DataFrame, limit: int = 6) -> DataFrame:
    """Extracted callers and callees of seeds(node), the seeds themselves left out."""
    calls = visible(edges).where("type = 'call'")
    near = directed(calls, "both").join(seeds.select(F.col("node").alias("a")).distinct(), "a").select(F.col("b").alias("node")).distinct()
    return near.join(seeds.select("node"), "node", "left_anti").orderBy("node").limit(limit)


def top_subgraph(nodes: DataFrame, edges: DataFrame, limit: int = 400) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree, over all edges, and the edges between them."""
    keep = hubs(nodes, edges, limit)
    inside = edges.join(keep.select(F.col("node").alias("src")), "src", "left_semi").join(keep.select(F.col("node").alias("dst")), "dst", "left_semi")
    return keep, inside


def match_nodes(nodes: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """(node, score) of nodes whose name and path match a query: equal 100, containing it 50, else one for each word."""
    text = F.lower(F.concat_ws(" ", "name", "file_path"))
    exact = query.strip().lower()
    words = F.lit(0)
    for w in exact.split():
        words = words + F.when(text.contains(w), 1).otherwise(0)
    score = F.when(text == exact, 100).when(text.contains(exact), 50).otherwise(0) + words
    return nodes.select("node", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "node").limit(limit)


def graph_query(nodes: DataFrame, edges: DataFrame, query: str, direction: str = "both", inferred: bool = False, starts: int = 5, limit: int = 40, depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """(nodes(node, depth), edges between them): what lies around the best matches of a query, nearest first.

    The search stops at limit nodes, those of the last depth by name.
    """
    shown = visible(edges, inferred)
    found = reach(shown, match_nodes(nodes, query, starts), direction, depth, limit)
    found = Cutter(nodes.sparkSession, "graph_query").cut(found)
    return found, induced(shown, found)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among nodes(node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns)


def node_detail(edges: DataFrame, nodes: DataFrame, limit: int = 12) -> DataFrame:
    """(node, side, other): the first callers and callees of nodes(node), by name, through all edges but containment."""
    calls = edges.where("type <> 'contains'").select("src", "dst").distinct()
    keep = nodes.select("node").distinct()
    sides = calls.select(F.col("dst").alias("node"), F.lit("caller").alias("side"), F.col("src").alias("other")).unionByName(calls.select(F.col("src").alias("node"), F.lit("callee").alias("side"), F.col("dst").alias("other")))
    rank = F.row_number().over(Window.partitionBy("node", "side").orderBy("other"))
    return sides.join(keep, "node", "left_semi").withColumn("k", rank).where(F.col("k") <= limit).drop("k")


def snippet(symbols: DataFrame, key: str, content: str, lines: int = 60) -> DataFrame:
    """(key, snippet): the first lines of each content."""
    return symbols.select(F.col(key), F.array_join(F.slice(F.split(F.coalesce(F.col(content), F.lit("")), "\n"), 1, lines), "\n").alias("snippet"))


def labels_like(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose name holds a text, letter case ignored; the first by node is what a lookup by name opens."""
    return nodes.where(F.lower("name").contains(text.strip().lower())).orderBy("node")


def export_map(known: DataFrame) -> DataFrame:
    """(file_path, names) of everything a file exports, from expand_reexports; names in order."""
    return known.groupBy("file_path").agg(F.array_sort(F.collect_set("name")).alias("names"))


def neighbourhood(index: InvertedIndex, symbols: DataFrame, queries: list[str], limit: int = 5000, pushing: int = 25, per_query: int = 200, key: str = "id") -> tuple[DataFrame, bool]:
    """(symbols(key), truncated): what searches for the queries find, and searches for the names and references of that.

    Searches go level by level, all of a level at once. The first `pushing` of them pass on names;
    it ends when nothing is left to search or limit (100 to 20,000) symbols are found.
    """
    cutter = Cutter(symbols.sparkSession, "neighbourhood")
    limit = max(100, min(20_000, limit))
    first = [q for q in dict.fromkeys(queries) if q]
    pending = symbols.sparkSession.createDataFrame([(q, k) for k, q in enumerate(first)], "q string, place int")
    searched = selected = None
    done, rows = 0, symbols.where("name is not null").select(F.col(key).alias("key"), "name", "refs")
    truncated = False
    while True:
        new = pending if searched is None else pending.join(searched, "q", "left_anti")
        new = cutter.cut(new)
        count = new.count()
        have = selected.count() if selected is not None else 0
        if not count or have >= limit:
            truncated = count > 0
            break
        found = search_many(index, rows, new, min(per_query, limit - have))
        found = found if selected is None else found.join(selected, "key", "left_anti")
        found = cutter.cut(found.groupBy("key").agg(F.min("place").alias("place")).orderBy("place", "key").limit(limit - have))
        selected = found.select("key") if selected is None else cutter.cut(selected.unionByName(found.select("key")))
        searched = new.select("q") if searched is None else cutter.cut(searched.unionByName(new.select("q")))
        quota = max(0, pushing - done)
        done += count
        if not quota:
            pending = new.limit(0)
            continue
        sources = new.orderBy("place").limit(quota).select("place")
        parents = found.join(sources, "place", "left_semi").join(rows, "key")
        names = parents.select("place", "key", F.explode(F.concat(F.array("name"), F.coalesce(F.transform("refs", lambda r: r["name"]), F.array().cast("array<string>")))).alias("q")).where("q is not null and q <> ''")
        pending = names.groupBy("q").agg(F.min(F.struct("place", "key")).alias("o")).select("q", F.row_number().over(Window.orderBy("o", "q")).cast("int").alias("place"))
    return selected, truncated


def search_many(index: InvertedIndex, symbols: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(place, key): the best symbols of each of many queries(q, place) of one term, ranked like a single search."""
    term = F.regexp_replace(F.lower(F.trim("q")), r"^[^a-z0-9_$]+|[^a-z0-9_$]+$", "")
    parts = F.filter(F.split(term, r"[^\p{L}\p{N}]+"), lambda p: p != "")
    asked = queries.select("q", "place", term.alias("term"), parts.alias("parts")).where(F.size("parts") > 0).withColumn("last", F.element_at("parts", -1))
    posts = index.postings()
    at = posts.join(asked.select("q", "last", F.substring("last", 1, 1).alias("c1")), (F.substring("term", 1, 1) == F.col("c1")) & F.col("term").startswith(F.col("last"))).select("q", "key", F.explode("positions").alias("at"))
    longest = asked.agg(F.coalesce(F.max(F.size("parts")), F.lit(0))).first()[0]
    for back in range(1, longest):
        exact = asked.where(F.size("parts") > back).select("q", F.element_at("parts", -1 - back).alias("term"))
        before = posts.join(exact, "term").select("q", "key", F.explode(F.transform("positions", lambda p: p + back)).alias("at"))  # noqa: B023
        long = asked.where(F.size("parts") > back).select("q")
        at = at.join(long, "q", "left_anti").unionByName(at.join(long, "q", "left_semi").join(before, ["q", "key", "at"], "left_semi"))
    hits = at.groupBy("q", "key").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    lengths = index.lengths()
    size = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    df = hits.groupBy("q").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.lit(size["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    score = F.round(idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("length") / F.lit(float(size["mean"] or 1.0)))), 9)
    scored = hits.join(df, "q").join(lengths, "key").select("q", "key", score.alias("bm25"))
    over = min(max(5 * limit, 50), 500)
    best = scored.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bm25"), "key"))).where(F.col("k") <= over)
    named = best.join(symbols.select("key", F.lower("name").alias("name")), "key").join(asked.select("q", "place", "term"), "q")
    rank = F.when(F.col("name") == F.lower(F.trim("q")), 101).when(F.col("name").contains(F.col("term")), 51).otherwise(1)
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(rank), F.desc("bm25"), "key"))
    return named.withColumn("r", order).where(F.col("r") <= limit).select("place", "key")


def pool_neighbours(index: InvertedIndex, symbols: DataFrame, seeds: DataFrame, limit: int = 6, key: str = "id") -> DataFrame:
    """Extracted callers and callees of seeds(node, key), in the graph of a pool that searches for their names and calls give.

    Twenty symbols are searched for each seed's name and ten for each name it calls.
    """
    rows = symbols.where("name is not null").select(F.col(key).alias("key"), "name", "refs")
    mine = seeds.select(F.col(key).alias("key")).distinct().join(rows, "key")
    numbered = lambda q: q.where("q is not null and q <> ''").distinct().select("q", F.row_number().over(Window.orderBy("q")).cast("int").alias("place"))
    called = mine.select(F.explode(F.filter("refs", lambda r: r["type"] == "call")).alias("r")).select(F.col("r.name").alias("q"))
    pool = search_many(index, rows, numbered(mine.select(F.col("name").alias("q"))), 20).select("key").unionByName(search_many(index, rows, numbered(called), 10).select("key")).unionByName(mine.select("key")).distinct()
    inside = symbols.join(pool, F.col(key) == F.col("key"), "left_semi")
    return neighbours(build_edges(inside), seeds, limit)

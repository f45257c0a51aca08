"""Parent-child links resolved to whole hierarchies, by tree contraction.

A round rakes all leaves and compresses unary chains: a node with one child is bypassed if its
hash is larger than its child's and its parent's, so no two neighbours go in one round. Every
removal is recorded with the node it hangs on after the round and its distance to it. Reversing
the rounds gives roots, depths and paths. Trees of any depth need a logarithmic number of
rounds. What never contracts is a node that has become its own parent: a cycle, whose smallest
member travelled along with the bypassed nodes.

The rounds run over the whole cluster until what is left is at most LAST nodes; a single task
contracts those in the same way, as a round costs the same however few nodes it moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.cut import Cutter

LAST = 20_000  # nodes that one task contracts


def contract(rows: list[tuple]) -> list[tuple]:
    """(node, root, depth, path) of (node, parent, w, low, seg), contracted and expanded again in memory."""
    parent = {n: p for n, p, _, _, _ in rows}
    weight = {n: w for n, _, w, _, _ in rows}
    low = {n: m for n, _, _, m, _ in rows}
    seg = {n: list(s) for n, _, _, _, s in rows}
    removed: list[tuple] = []
    number = 0
    while True:
        kids: dict = {}
        for n, p in parent.items():
            if p is not None and p != n:
                kids.setdefault(p, []).append(n)
        rank = {n: crc32(f"{number}/{n}".encode()) for n in parent}
        movable = [n for n, p in parent.items() if p is not None and p != n]
        raked = [n for n in movable if n not in kids]
        bypassed = [n for n in movable if len(kids.get(n, ())) == 1 and rank[n] > rank[kids[n][0]] and rank[n] > rank[parent[n]]]
        if not raked and not bypassed:
            if not movable:
                break
            number += 1
            continue
        # a node's place is recorded as it is after the round, as its parent may be bypassed in it too
        out = {n: (parent[n], weight[n], seg[n]) for n in [*raked, *bypassed]}
        changes = []
        for n in bypassed:
            c = kids[n][0]
            changes.append((c, parent[n], weight[c] + weight[n], min(low[c], low[n], n), seg[n] + [n] + seg[c]))
        for c, p, w, m, s in changes:
            parent[c], weight[c], low[c], seg[c] = p, w, m, s
            if c in out:
                out[c] = (p, w, s)
        for n, (p, w, s) in out.items():
            removed.append((number, n, p, w, s))
            del parent[n]
        number += 1
    done: dict = {}
    for n, p in parent.items():
        done[n] = (n, 0, [n]) if p is None else (low[n], -1, None)
    for _, n, p, w, s in reversed(removed):
        root, depth, path = done[p]
        done[n] = (root, depth + w if depth >= 0 else -1, path + s + [n] if path is not None else None)
    return [(n, *v) for n, v in done.items()]


def resolve_hierarchy(rows: DataFrame, node: str, parent: str, paths: bool = False, last: int = LAST) -> DataFrame:
    """(node_id, root_id, depth[, path]) of every distinct non-null node.

    A root has depth 0 and itself as root_id; so has a node whose parent is null or names no
    node. On and below a cycle, a node that is its own parent included, depth is -1, root_id the
    smallest id on that cycle and path null. path is the array of ids from the root to the node.
    If a node comes with several parents, the smallest non-null one counts. Other columns of
    rows are ignored. An empty table gives an empty result. last is how many nodes one task may
    contract at the end.

    Each round is a few equi-joins on unique keys and one pre-aggregated count of children, so a
    parent with a third of all rows as children is counted map-side. The active rows shrink
    geometrically. Round tables are written to the shared checkpoint folder and deleted when
    their reversal is written.
    """
    spark = rows.sparkSession
    cutter = Cutter(spark, "hierarchy")
    links = rows.select(F.col(node).alias("node"), F.col(parent).alias("parent")).where(F.col("node").isNotNull())
    links = links.groupBy("node").agg(F.min("parent").alias("parent"))
    wanted = links.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count(F.lit(1)).alias("x")).select("parent")
    known = wanted.join(links.select(F.col("node").alias("parent")), "parent", "left_semi").select("parent", F.lit(True).alias("known"))
    active = links.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent"), F.lit(1).cast("long").alias("w"), F.col("node").alias("low"))
    kind = active.schema["node"].dataType.simpleString()
    if paths:
        active = active.withColumn("seg", F.expr(f"cast(array() as array<{kind}>)"))
    extra = ["seg"] if paths else []

    rounds: list[DataFrame] = []
    source = cutter.cut(active)
    size = source.count()
    while size > last:
        k = len(rounds)
        kids = source.where("parent is not null and parent <> node").groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("child"))
        state = source.join(kids.withColumnRenamed("parent", "of"), F.col("node") == F.col("of"), "left").drop("of")
        h = lambda c: F.xxhash64(F.col(c), F.lit(k))
        movable = F.col("parent").isNotNull() & (F.col("parent") != F.col("node"))
        action = F.when(movable & F.col("n").isNull(), "rake").when(movable & (F.col("n") == 1) & (h("node") > h("child")) & (h("node") > h("parent")), "compress").otherwise("keep")
        state = state.withColumn("action", action)
        bypassed = state.where("action = 'compress'").select(
            F.col("child").alias("c"), F.col("parent").alias("gp"), F.col("w").alias("pw"), F.least("node", "low").alias("plow"), *([F.concat("seg", F.array("node")).alias("pseg")] if paths else [])
        )
        moved = state.join(bypassed, F.col("node") == F.col("c"), "left")
        after = moved.select(
            "node", F.coalesce("gp", "parent").alias("parent"), (F.col("w") + F.coalesce("pw", F.lit(0))).alias("w"), F.least("low", "plow").alias("low"),
            *([F.coalesce(F.concat("pseg", "seg"), "seg").alias("seg")] if paths else []), "action",
        )
        after = cutter.cut(after)
        if not rounds:
            cutter.release(source)
        rounds.append(after)
        source = after.where("action = 'keep'").drop("action")
        left = source.agg(F.count(F.lit(1)).alias("n"), F.count_if(movable).alias("movable")).first()
        size = left["n"]
        if not left["movable"]:
            break

    if size <= last:

        def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = []
            for pdf in batches:
                segs = pdf["seg"] if paths else [()] * len(pdf)
                rows += [(n, None if pd.isna(p) else p, int(w), m, s) for n, p, w, m, s in zip(pdf["node"], pdf["parent"].astype(object), pdf["w"], pdf["low"], segs)]
            out = pd.DataFrame(contract(rows), columns=["node", "root", "depth", "path"])
            yield out if paths else out.drop(columns="path")

        resolved = source.coalesce(1).mapInPandas(finish, f"node {kind}, root {kind}, depth long" + (f", path array<{kind}>" if paths else ""))
    else:
        looped = F.col("parent").isNotNull()
        resolved = source.select("node", F.when(looped, F.col("low")).otherwise(F.col("node")).alias("root"), F.when(looped, -1).otherwise(0).cast("long").alias("depth"), *([F.when(~looped, F.array("node")).alias("path")] if paths else []))
    before = None
    for n, after in enumerate(reversed(rounds)):
        if n:
            known = cutter.cut(resolved)  # what it was made of isn't read again
            cutter.release(rounds[len(rounds) - n])
            if before is not None:
                cutter.release(before)
            resolved = before = known
        target = resolved.select(F.col("node").alias("t"), "root", "depth", *(["path"] if paths else []))
        removed = after.where("action <> 'keep'").join(target, F.col("parent") == F.col("t"))
        back = removed.select("node", "root", F.when(F.col("depth") < 0, F.col("depth")).otherwise(F.col("depth") + F.col("w")).alias("depth"), *([F.concat("path", "seg", F.array("node")).alias("path")] if paths else []))
        resolved = resolved.unionByName(back)
    return resolved.select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", *(["path"] if paths else []))


def descendants(resolved: DataFrame) -> DataFrame:
    """(node_id, descendant_id, distance) for every node and everything below it, from paths.

    Nodes on or below a cycle have no path and give no row. The result is as large as the sum of
    all depths; it is made row by row, without a join.
    """
    pairs = resolved.where("path is not null").select(F.col("node_id").alias("descendant_id"), F.col("depth").alias("d"), F.posexplode("path").alias("pos", "node_id"))
    return pairs.where("pos < d").select("node_id", "descendant_id", (F.col("d") - F.col("pos")).alias("distance"))

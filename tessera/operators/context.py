"""The context response: lexical hits, their neighbours in the graph, memories, changes and tests under one token budget.

Retrieval and the graph are plans over the whole tables; what they return is at most some hundred
rows, of which the text is put together in one place.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.prose import compress_code_comments
from tessera.functions.text import count_tokens
from tessera.operators.budget import surrogate, truncate
from tessera.operators.graph import clean_path, directed, visible
from tessera.operators.inverted import InvertedIndex, indexed_topk, search_indexed

RESERVE = 100  # tokens kept for the header
STRUCTURAL = 6  # neighbours that join the lexical hits


def with_node(symbols: DataFrame) -> DataFrame:
    """symbols with the name of their node in the graph."""
    return symbols.withColumn("node", F.concat_ws(":", F.lit("symbol"), clean_path(F.col("file_path")), "name", F.coalesce(F.col("start_line").cast("string"), F.lit("0"))))


def hybrid_results(index: InvertedIndex, symbols: DataFrame, edges: DataFrame, query: str, limit: int = 30, key: str = "id") -> DataFrame:
    """(key, node, pass, score): the lexical hits, then their extracted callers and callees that aren't hits, the first by node.

    A neighbour scores half a point less than the worst hit, and at most half a point. pass is 1
    or 2 for lexical hits and 3 for neighbours; of a node's rows the one with the largest key counts.
    """
    hits = with_node(search_indexed(index, symbols, query, limit, key)).select(key, "node", "pass", "score")
    seeds = hits.select(F.col("node").alias("a")).distinct()
    calls = visible(edges).where("type = 'call'")
    near = directed(calls, "both").join(seeds, "a").select(F.col("b").alias("node")).distinct().join(hits.select("node"), "node", "left_anti")
    near = near.orderBy("node").limit(STRUCTURAL)
    worst = hits.agg(F.least(F.min("score"), F.lit(1)).alias("worst"))
    keys = with_node(symbols).join(near, "node").groupBy("node").agg(F.max(key).alias(key))
    scored = keys.join(F.broadcast(worst)).select(key, "node", F.lit(3).alias("pass"), F.greatest(F.col("worst") - 0.5, F.lit(0.0)).alias("score"))
    return hits.withColumn("score", F.col("score").cast("double")).unionByName(scored)


@dataclass
class Chunk:
    path: str
    content: str
    first: int | None
    last: int | None
    kind: str

    def block(self) -> str:
        place = f":{self.first}-{self.first if self.last is None else self.last}" if self.first is not None else ""
        return f"### {self.path}{place} [{self.kind}]\n```\n{self.content}\n```"


def assemble(chunks: Iterable[Chunk], budget: int, compress: bool = False) -> tuple[str, int, int, int]:
    """(text, used, included, dropped) of chunks in their order.

    What doesn't fit is dropped, smaller ones may still fit; if more than 100 tokens are left it
    is cut to them, counts both ways and ends the list. Headers aren't counted, as they come out
    of the reserve.
    """
    kept: list[Chunk] = []
    used = included = dropped = 0
    for c in chunks:
        content = compress_code_comments(c.content) if compress else c.content
        tokens = surrogate(content)
        if used + tokens <= budget:
            kept.append(Chunk(c.path, content, c.first, c.last, c.kind))
            used, included = used + tokens, included + 1
            continue
        dropped += 1
        if budget - used > 100:
            kept.append(Chunk(c.path, truncate(content, budget - used), c.first, c.last, c.kind))
            included += 1
            used = budget
            break
    return "\n\n".join(c.block() for c in kept), used, included, dropped


def memory_text(index: InvertedIndex, memories: DataFrame, query: str, budget: int, key: str = "rev_id", limit: int = 3) -> str:
    """The best memories for a query, with their scores, in at most budget tokens; empty without any."""
    if budget <= 0:
        return ""
    best = indexed_topk(index, query, limit, memories.select(F.col(key).alias("key")))
    rows = best.join(memories, F.col("key") == F.col(key)).orderBy(F.desc("score"), "key").select("title", "type", "body", "score").collect()
    if not rows:
        return ""
    return truncate("\n\n".join(["## Project memory", *[f"### {r['title']} [{r['type']}; score {r['score']:.2f}]\n{(r['body'] or '').strip()}" for r in rows]]), budget)


def respond(
    query: str, chunks: list[Chunk], budget: int, memories: str = "", structural: int = 0, changes: list[str] | None = None, tests: list[str] | None = None, compress: bool = False
) -> tuple[str, int, int]:
    """(text, included, dropped) of a whole response, never over budget.

    Memories come first and the header has a reserve. If changes or tests are wanted, symbols get
    four fifths of the rest; changes get half of what is then left if tests are wanted too.
    """
    content = max(0, budget - RESERVE - surrogate(memories))
    wanted = changes is not None or tests is not None
    text, used, included, dropped = assemble(chunks, content * 4 // 5 if wanted else content, compress)
    left = max(0, content - used)
    parts = [memories, text]
    if changes and left > 100:
        parts.append(truncate("\n\n".join(changes), left // 2 if tests is not None else left))
        left -= surrogate(parts[-1])
    if tests and left > 50:
        parts.append(truncate("\n".join(tests), left))
    body = "\n\n".join(p for p in parts if p)
    if not chunks and not memories:
        body = f"Nothing found for: {query}"
    head = f"# Context: {query}\nSymbols: {included} included, {dropped} dropped (budget: {budget} tokens)\nStructural candidates: {structural}\nTokens: about {min(budget, surrogate(body) + RESERVE)}\n\n"
    return truncate(head + body, budget), included, dropped


def collected_chunks(results: DataFrame, symbols: DataFrame, key: str = "id") -> list[Chunk]:
    """The rows of hybrid_results with their contents, best first; at most the limit of the search and STRUCTURAL more."""
    rows = results.join(symbols.select(key, "file_path", "content", "start_line", "end_line", "type"), key).orderBy(F.desc("score"), "pass", key).collect()
    return [Chunk(r["file_path"] or "", r["content"] or "", r["start_line"], r["end_line"], r["type"] or "") for r in rows]


def baseline_tokens(results: DataFrame, symbols: DataFrame, key: str = "id") -> DataFrame:
    """(file_path, tokens): what reading the whole files of the results would cost, their symbols put together."""
    path = clean_path(F.col("file_path")).alias("file_path")
    files = symbols.select(key, path).join(results.select(key), key, "left_semi").select("file_path").distinct()
    whole = symbols.select(path, count_tokens(F.coalesce("content", F.lit(""))).alias("tokens"))
    return whole.join(files, "file_path", "left_semi").groupBy("file_path").agg(F.sum("tokens").cast("long").alias("tokens"))

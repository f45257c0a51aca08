"""Ranked retrieval: BM25 over documents and memories, and prefix search over symbols.

Only the query's terms are ever counted, in place, by expressions over each row's text: no token
is exploded and no postings are shuffled. Corpus statistics are one aggregate row.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ascii_word

# Words a symbol query does without.
STOP_WORDS = ("a", "an", "and", "are", "for", "from", "in", "is", "of", "on", "or", "the", "to", "what", "where", "which", "with")


def weighted_text(weights: dict[str, int]) -> Column:
    """Fields repeated as often as they weigh; arrays are joined by spaces, nulls left out."""
    parts = [F.col(name) for name, times in weights.items() for _ in range(times)]
    return F.concat_ws(" ", *parts)


def bm25_topk(docs: DataFrame, key: str, text: Column, query: str, limit: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(key, score) of the best rows with a positive score; ties by key.

    idf is ln((n - df + 0.5) / (df + 0.5) + 1) and a term repeated in the query counts each time.
    Statistics are those of the given rows, so filters come first. Null texts are empty
    documents. A query without terms gives the first rows by key with score 0.
    """
    terms = re.findall(r"[A-Za-z0-9_]{2,}", query.lower())
    if not terms:
        return docs.select(F.col(key), F.lit(0.0).alias("score")).orderBy(key).limit(limit)
    distinct = list(dict.fromkeys(terms))
    low = docs.select(F.col(key), F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    counted = low.select(F.col(key), F.regexp_count("low", F.lit(r"\w{2,}")).alias("length"), *[F.regexp_count("low", F.lit(ascii_word(q, q[0]))).alias(f"tf{k}") for k, q in enumerate(distinct)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(distinct))]).first()
    n, mean = stats["n"], stats["mean"] or 1.0
    score = F.lit(0.0)
    for term in terms:
        k = distinct.index(term)
        idf = math.log((n - stats[f"df{k}"] + 0.5) / (stats[f"df{k}"] + 0.5) + 1)
        tf = F.col(f"tf{k}").cast("double")
        score = score + F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.lit(float(mean))))
    found = F.greatest(*[F.col(f"tf{k}") for k in range(len(distinct))], F.lit(0)) > 0
    return counted.where(found).select(F.col(key), F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def query_terms(query: str) -> list[str]:
    terms = [re.sub(r"^[^a-z0-9_$]+|[^a-z0-9_$]+$", "", t) for t in query.strip().lower().split()]
    terms = [t for t in terms if t]
    return [t for t in terms if t not in STOP_WORDS] or terms


def search_symbols(symbols: DataFrame, query: str, limit: int = 10, key: str = "id") -> DataFrame:
    """(key, file_path, name, start_line, pass, score): rows with all terms first, then rows with any.

    Terms match as prefixes of the tokens of name and content. Either pass takes
    min(max(5 * limit, 50), 500) rows by BM25 (k1 1.2, b 0.75, ties by key) and then ranks them by
    name: 101 if the name is the query, 51 if it contains the first term, 1 otherwise. The second
    pass only fills what the first leaves. An empty query gives no row.
    """
    terms = query_terms(query)
    columns = [key, "file_path", "name", "start_line"]
    if not terms:
        return symbols.select(*columns, F.lit(0).alias("pass"), F.lit(0).alias("score")).limit(0)
    over = min(max(5 * limit, 50), 500)
    phrases = [re.findall(r"[^\W_]+", t) or [t] for t in terms]
    tokens = F.split(F.lower(F.concat_ws(" ", "name", "content")), r"[^\p{L}\p{N}]+")

    def hits(parts: list[str]) -> Column:
        head, last = parts[:-1], parts[-1]
        if not head:
            return F.size(F.filter("tokens", lambda t: t.startswith(last)))
        at = F.sequence(F.lit(1), F.greatest(F.size("tokens") - len(head), F.lit(1)))
        whole = lambda i: F.arrays_overlap(F.array(F.lit(True)), F.array(_all([F.try_element_at("tokens", (i + k).cast("int")) == w for k, w in enumerate(head)] + [F.try_element_at("tokens", (i + len(head)).cast("int")).startswith(last)])))
        return F.size(F.filter(at, whole))

    counted = symbols.select(*columns, tokens.alias("tokens")).select(*columns, F.size(F.filter("tokens", lambda t: t != "")).alias("length"), *[hits(p).alias(f"tf{k}") for k, p in enumerate(phrases)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))]).first()
    n, mean = stats["n"], stats["mean"] or 1.0
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = max(math.log((n - stats[f"df{k}"] + 0.5) / (stats[f"df{k}"] + 0.5)), 1e-6) if n else 1e-6
        tf = F.col(f"tf{k}").cast("double")
        score = score + F.lit(idf) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("length") / F.lit(float(mean))))
    exact = query.strip().lower()
    name = F.lower("name")
    rank = F.when(name == exact, 101).when(name.contains(terms[0]), 51).otherwise(1)
    scored = counted.withColumn("bm25", F.round(score, 9)).withColumn("score", rank)
    every, some = _all([F.col(f"tf{k}") > 0 for k in range(len(terms))]), F.greatest(*[F.col(f"tf{k}") for k in range(len(terms))], F.lit(0)) > 0

    def ranked(condition: Column, number: int) -> DataFrame:
        best = scored.where(condition).orderBy(F.desc("bm25"), key).limit(over)
        return best.orderBy(F.desc("score"), F.desc("bm25"), key).limit(limit).select(*columns, F.lit(number).alias("pass"), "score", "bm25")

    first = ranked(every, 1)
    if len(terms) == 1:
        return first.drop("bm25")
    rest = ranked(some, 2).join(first.select("file_path", "start_line", "name"), ["file_path", "start_line", "name"], "left_anti").select(*columns, "pass", "score", "bm25")
    return first.unionByName(rest).orderBy("pass", F.desc("score"), F.desc("bm25"), key).limit(limit).drop("bm25")


def like_fallback(symbols: DataFrame, query: str, limit: int = 10, key: str = "id") -> DataFrame:
    """Substring search for queries the ranked search can't read: by name score, then shortest content."""
    terms = query_terms(query)
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.lower("name").contains(t) | F.lower("content").contains(t)
    first = terms[0] if terms else ""
    rank = F.when(F.lower("name") == query.strip().lower(), 101).when(F.lower("name").contains(first), 51).otherwise(1)
    return symbols.where(hit).select(key, "name", rank.alias("score"), F.length("content").cast("long").alias("size")).orderBy(F.desc("score"), "size", key).limit(limit)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out

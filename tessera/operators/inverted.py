"""An inverted index: postings written once, of which a query reads only those of its own terms.

Postings are rows (head, term, key, tf, positions), range-partitioned and sorted by term and key,
so a term that a third of all documents hold is spread over many files, and written below a folder
for each head, a hash of the term's first character. A query names heads and terms: the folders
of others aren't opened, and of the files that are, row groups without its terms are skipped.
A document's length is the posting of the empty term.

The index is a list of segments. A refresh writes the changed documents as a new segment and the
keys whose older postings no longer count; reading leaves those out, compact() puts all into one.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADS = 64
WORDS = r"[A-Za-z0-9_]{2,}"  # of documents and memories
TOKENS = r"[^\W_]+"  # of symbols

Postings = Iterator[pd.DataFrame]


def head_of(term: str) -> int:
    return crc32(term[:1].encode()) % HEADS if term else HEADS


def _write(docs: DataFrame, key: str, text: Column, tokens: str, positions: bool, path: str) -> str:
    """Writes the postings of docs; their schema as JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Postings:
        find, heads = re.compile(tokens).findall, {}
        for pdf in batches:
            keys, terms, tfs, places = [], [], [], []
            for k, t in zip(pdf["key"], pdf["text"]):
                words = find(t)
                at: dict[str, list[int]] = {}
                for n, w in enumerate(words):
                    if w in at:
                        at[w].append(n)
                    else:
                        at[w] = [n]
                keys += [k] * (len(at) + 1)
                terms += ["", *at]
                tfs += [len(words), *[len(p) for p in at.values()]]
                if positions:
                    places += [[], *at.values()]
            for w in set(terms):
                if w[:1] not in heads:
                    heads[w[:1]] = head_of(w)
            out = {"head": [heads[w[:1]] for w in terms], "term": terms, "key": keys, "tf": tfs}
            yield pd.DataFrame(out | ({"positions": places} if positions else {}))

    rows = docs.select(F.col(key).alias("key"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInPandas(run, f"head int, term string, key {kind}, tf int" + (", positions array<int>" if positions else ""))
    found.repartitionByRange("head", "term", "key").sortWithinPartitions("head", "term", "key").write.partitionBy("head").parquet(path)
    return found.schema.json()


class InvertedIndex:
    def __init__(self, spark: SparkSession, path: str, tokens: str = WORDS, positions: bool = False):
        self.spark, self.path, self.tokens, self.positions = spark, path.rstrip("/"), tokens, positions
        jvm = spark.sparkContext._jvm
        self._p = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def segments(self) -> list[int]:
        """Numbers of the complete segments, oldest first; a segment counts once it is marked complete."""
        marks = self._fs.globStatus(self._p(f"{self.path}/ready-*"))
        base = self._fs.globStatus(self._p(f"{self.path}/base-*"))
        first = max([int(b.getPath().getName().split("-")[1]) for b in base or []], default=0)
        return [n for n in sorted(int(m.getPath().getName().split("-")[1]) for m in marks or []) if n >= first]

    def _add(self, docs: DataFrame, key: str, text: Column, gone: DataFrame | None, base: bool) -> None:
        n = max(self.segments(), default=0) + 1
        schema = _write(docs, key, text, self.tokens, self.positions, f"{self.path}/segment-{n}")
        if gone is not None:
            gone.select(F.col(key).alias("key")).distinct().write.parquet(f"{self.path}/gone-{n}")
        self._ready(n, schema, base)

    def _ready(self, n: int, schema: str, base: bool) -> None:
        """Marks a segment complete; the mark holds the schema, as an empty segment has no files to tell it."""
        if base:
            self._fs.create(self._p(f"{self.path}/base-{n}"), False).close()
        out = self._fs.create(self._p(f"{self.path}/ready-{n}"), False)
        try:
            out.write(bytearray(schema.encode()))
        finally:
            out.close()

    def _schema(self, n: int) -> T.StructType:
        stream = self._fs.open(self._p(f"{self.path}/ready-{n}"))
        try:
            return T.StructType.fromJson(json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def build(self, docs: DataFrame, key: str, text: Column) -> InvertedIndex:
        """Indexes every row of docs anew; null texts are empty documents."""
        self._add(docs, key, text, None, True)
        return self

    def refresh(self, changed: DataFrame, key: str, text: Column, gone: DataFrame | None = None) -> InvertedIndex:
        """Indexes changed again and drops gone(key); both may be read while this runs."""
        dropped = changed.select(key) if gone is None else changed.select(key).unionByName(gone.select(key))
        self._add(changed, key, text, dropped, False)
        return self

    def compact(self) -> InvertedIndex:
        """All that counts as one segment; older folders stay for those who still read them."""
        n = max(self.segments()) + 1
        rows = self.postings()
        rows.repartitionByRange("head", "term", "key").sortWithinPartitions("head", "term", "key").write.partitionBy("head").parquet(f"{self.path}/segment-{n}")
        self._ready(n, rows.schema.json(), True)
        return self

    def postings(self, where: Column | None = None) -> DataFrame:
        """All postings that count; where is pushed into every segment."""
        out, numbers = None, self.segments()
        for k, n in enumerate(numbers):
            rows = self.spark.read.schema(self._schema(n)).parquet(f"{self.path}/segment-{n}")
            rows = rows.where(where) if where is not None else rows
            for later in numbers[k + 1 :]:
                path = f"{self.path}/gone-{later}"
                if self._fs.exists(self._p(path)):
                    rows = rows.join(self.spark.read.parquet(path), "key", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    def lengths(self) -> DataFrame:
        """(key, length) of every document."""
        return self.postings(F.col("head") == HEADS).select("key", F.col("tf").alias("length"))

    def of_terms(self, terms: list[str]) -> DataFrame:
        return self.postings(F.col("head").isin(*{head_of(t) for t in terms}) & F.col("term").isin(*terms))

    def of_prefix(self, prefix: str) -> DataFrame:
        """Postings of all terms with a prefix: a range of the sorted terms."""
        return self.postings((F.col("head") == head_of(prefix)) & (F.col("term") >= prefix) & F.col("term").startswith(prefix))


def bm25(tf: Column, length: Column, mean: float, idf: float, k1: float, b: float) -> Column:
    return F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(float(mean))))


def indexed_topk(index: InvertedIndex, query: str, limit: int = 10, only: DataFrame | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(key, score) of the best documents with a positive score; ties by key.

    idf is ln((n - df + 0.5) / (df + 0.5) + 1) and a term repeated in the query counts each time.
    Statistics are those of the documents in only(key), by default of all. A query without terms
    gives the first documents by key with score 0. The postings of the terms and the lengths are
    all that is read; the driver gets one row of statistics.
    """
    lengths = index.lengths()
    if only is not None:
        lengths = lengths.join(only.select("key"), "key", "left_semi")
    terms = re.findall(WORDS, query.lower())
    if not terms:
        return lengths.select("key", F.lit(0.0).alias("score")).orderBy("key").limit(limit)
    distinct = list(dict.fromkeys(terms))
    tf = [F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf{k}") for k, t in enumerate(distinct)]
    hits = index.of_terms(distinct).groupBy("key").agg(*tf).join(lengths, "key")
    size = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    found = hits.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(distinct))]).first()
    n, mean, score = size["n"], size["mean"] or 1.0, F.lit(0.0)
    for term in terms:
        k = distinct.index(term)
        df = found[f"df{k}"] or 0
        score = score + bm25(F.col(f"tf{k}").cast("double"), F.col("length"), mean, math.log((n - df + 0.5) / (df + 0.5) + 1), k1, b)
    return hits.select("key", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "key").limit(limit)


def phrase_hits(index: InvertedIndex, parts: list[str]) -> DataFrame:
    """(key, tf) of the documents that hold the parts in a row, the last as a prefix."""
    last = index.of_prefix(parts[-1])
    if len(parts) == 1:
        return last.groupBy("key").agg(F.sum("tf").alias("tf"))
    at = last.select("key", F.explode("positions").alias("at"))
    for back, part in enumerate(reversed(parts[:-1]), 1):
        before = index.of_terms([part]).select("key", F.explode(F.transform("positions", lambda p: p + back)).alias("at"))  # noqa: B023
        at = at.join(before, ["key", "at"], "left_semi")
    return at.groupBy("key").agg(F.count(F.lit(1)).alias("tf"))


def search_indexed(index: InvertedIndex, symbols: DataFrame, query: str, limit: int = 10, key: str = "id") -> DataFrame:
    """(key, file_path, name, start_line, pass, score): what retrieval.search_symbols gives, from postings.

    Statistics come from the hits and the lengths; only the best rows of either pass, at most 500,
    are looked up in the table of symbols, by key.
    """
    from tessera.operators.retrieval import query_terms

    terms = query_terms(query)
    columns = [key, "file_path", "name", "start_line"]
    if not terms:
        return symbols.select(*columns, F.lit(0).alias("pass"), F.lit(0).alias("score")).limit(0)
    over, hits = min(max(5 * limit, 50), 500), None
    for k, t in enumerate(terms):
        one = phrase_hits(index, re.findall(r"[^\W_]+", t) or [t]).select("key", F.lit(k).alias("k"), "tf")
        hits = one if hits is None else hits.unionByName(one)
    lengths = index.lengths()
    size = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    tf = [F.sum(F.when(F.col("k") == k, F.col("tf")).otherwise(0)).alias(f"tf{k}") for k in range(len(terms))]
    counted = hits.groupBy("key").agg(*tf).join(lengths, "key")
    found = counted.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))]).first()
    n, mean, score, every = size["n"], size["mean"] or 1.0, F.lit(0.0), F.lit(True)
    for k in range(len(terms)):
        df = found[f"df{k}"] or 0
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) if n else 1e-6
        score = score + bm25(F.col(f"tf{k}").cast("double"), F.col("length"), mean, idf, 1.2, 0.75)
        every = every & (F.col(f"tf{k}") > 0)
    scored = counted.select("key", F.round(score, 9).alias("bm25"), every.alias("every"))
    exact = query.strip().lower()
    name = F.lower("name")
    rank = F.when(name == exact, 101).when(name.contains(terms[0]), 51).otherwise(1)
    best = scored.where("every").orderBy(F.desc("bm25"), "key").limit(over).withColumn("pass", F.lit(1))
    if len(terms) > 1:
        best = best.unionByName(scored.orderBy(F.desc("bm25"), "key").limit(over).withColumn("pass", F.lit(2)))
    rows = symbols.select(*columns).join(best.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key")).withColumn("score", rank)
    order = [F.desc("score"), F.desc("bm25"), key]
    first = rows.where("pass = 1").orderBy(*order).limit(limit).select(*columns, "pass", "score", "bm25")
    if len(terms) == 1:
        return first.drop("bm25")
    second = rows.where("pass = 2").orderBy(*order).limit(limit)
    rest = second.join(first.select("file_path", "start_line", "name"), ["file_path", "start_line", "name"], "left_anti").select(*columns, "pass", "score", "bm25")
    return first.unionByName(rest).orderBy("pass", *order).limit(limit).drop("bm25")


def index_of(spark: SparkSession, path: str, docs: DataFrame, key: str, text: Column, tokens: str = WORDS, positions: bool = False) -> InvertedIndex:
    """The index at path, built first if there is none yet."""
    index = InvertedIndex(spark, path, tokens, positions)
    return index if index.segments() else index.build(docs, key, text)



"""Evaluation passages inside a corpus: pigeonhole edit matching over words.

A passage is a run of `words` consecutive words of a test item; equal passages of several items
are one. With an error budget of k word edits it is cut into k + 1 pieces, and a passage within
the budget must contain one of them unchanged. Exact piece hits over the corpus are found by one
vectorised lookup for each batch; every hit is verified with Myers' bit-parallel distance, a block
of candidates side by side while they are made.

A piece that very many passages share would make each of its places in a text that many
candidates. For those the pigeonhole is applied once more to the rest of the passage: one of its
k + 1 parts must stand unchanged too, at most k words from its place. No passage is left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 13
BUDGET = 1
SHORTEST = 5  # items of fewer words than a passage, but at least so many, are matched whole
HOT = 32  # passages of one piece beyond which the rest of the passage is looked up too
MAX_ITEM_CHARS = 16_000_000  # of one broadcast part of the test set; a larger one goes in several

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _codes(ids: np.ndarray, width: int) -> np.ndarray:
    """Code of the run of width words that begins at each position; positions too near the end get 0."""
    n = len(ids) - width + 1
    out = np.zeros(len(ids), np.uint64)
    if n > 0:
        acc = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                acc = (acc ^ ids[k : k + n].astype(np.uint64)) * _MIX
                acc ^= acc >> np.uint64(29)
        out[:n] = acc
    return out


def _mixed(*parts) -> np.ndarray:
    with np.errstate(over="ignore"):
        acc = np.uint64(0)
        for p in parts:
            acc = (acc ^ (np.uint64(p) if np.isscalar(p) else p)) * _MIX
            acc = acc ^ (acc >> np.uint64(31))
    return acc


class Table:
    """Rows by a 64-bit key, sorted for lookups of whole arrays."""

    def __init__(self, key: np.ndarray, *columns: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.columns = [c[order] for c in columns]
        self.unique, self.first, self.many = np.unique(key[order], return_index=True, return_counts=True)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are there, their numbers among the distinct keys)."""
        if not len(self.unique) or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.unique, keys)
        at[at == len(self.unique)] = 0
        here = np.flatnonzero(self.unique[at] == keys)
        return here, at[here]

    def expand(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in at, row) of all rows of the distinct keys at."""
        many = self.many[at]
        ends = np.cumsum(many)
        which = np.repeat(np.arange(len(at)), many)
        return which, np.repeat(self.first[at], many) + np.arange(len(which)) - np.repeat(ends - many, many)


class Passages:
    """Word numbers, distinct passages and their piece index, of one part of a test set."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS, budget: int = BUDGET, shortest: int = SHORTEST, hot: int = HOT):
        if not 1 <= words <= 62 or not 0 <= budget < words:
            raise ValueError("words must be 1 to 62 and budget below it")
        self.words, self.budget = words, budget
        self.number: dict[str, int] = {}
        self.item_ids: list[int] = []
        streams: list[np.ndarray] = []
        for item_id, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text or "")], np.int32)
            if len(ids) >= min(words, shortest):
                self.item_ids.append(item_id)
                streams.append(ids)
        sizes = np.array([len(s) for s in streams], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.stream = np.concatenate(streams) if streams else np.zeros(0, np.int32)
        item_of = np.repeat(np.arange(len(streams)), sizes)
        keep = np.arange(len(self.stream))
        if len(keep):
            keep = keep[keep + words <= starts[item_of + 1]]
        table = self.stream[keep[:, None] + np.arange(words)] if len(keep) else np.zeros((0, words), np.int32)
        _, first, which = np.unique(table, axis=0, return_index=True, return_inverse=True) if len(keep) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        del table
        #: passage p stands at stream position pos[p] and belongs to the items of owners
        self.pos = keep[first]
        self.owners = Table(which.reshape(-1).astype(np.uint64), item_of[keep] if len(keep) else keep)
        self.width = words // (budget + 1)
        self.offsets = [k * words // (budget + 1) for k in range(budget + 1)]
        n, codes = len(self.pos), _codes(self.stream, self.width)
        key = np.concatenate([codes[self.pos + o] for o in self.offsets]) if n else np.zeros(0, np.uint64)
        passage, piece = np.tile(np.arange(n), len(self.offsets)), np.repeat(np.arange(len(self.offsets)), n)
        self.parts = [self._parts(o) for o in self.offsets]
        self.pieces = Table(key, passage, piece)
        self.hot = self.pieces.many > hot if all(self.parts) else np.zeros(len(self.pieces.unique), bool)
        rows = np.repeat(self.hot, self.pieces.many)
        hot_key, hot_passage, hot_piece = np.repeat(self.pieces.unique, self.pieces.many)[rows], *[c[rows] for c in self.pieces.columns]
        wide = {w: _codes(self.stream, w) for ps in self.parts for _, w in ps}
        keys, owners, pieces = [], [], []
        for j, ps in enumerate(self.parts):
            mine = hot_piece == j
            for number, (offset, w) in enumerate(ps):
                keys.append(_mixed(hot_key[mine], j, number, wide[w][self.pos[hot_passage[mine]] + offset]))
                owners.append(hot_passage[mine])
                pieces.append(hot_piece[mine])
        self.rest = Table(np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(owners) if keys else keep[:0], np.concatenate(pieces) if keys else keep[:0])
        self.short: dict[int, Table] = {}
        for size in sorted({int(s) for s in sizes if s < words}):
            which = np.flatnonzero(sizes == size)
            self.short[size] = Table(_codes(self.stream, size)[starts[which]], which, starts[which])

    def _parts(self, offset: int) -> list[tuple[int, int]]:
        """(offset, width) of budget + 1 parts of a passage beside the piece at offset; none if there are too few words."""
        left, right = offset, self.words - offset - self.width
        count = self.budget + 1
        if left + right < count:
            return []
        n_left = min(left, round(count * left / (left + right)))
        n_left = max(n_left, count - right)
        out = []
        for low, size, n in ((0, left, n_left), (offset + self.width, right, count - n_left)):
            cuts = [low + k * size // n for k in range(n + 1)] if n else []
            out += [(a, b - a) for a, b in zip(cuts, cuts[1:])]
        return out

    def candidates(self, ids: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passage, where it would begin in ids, where its piece is) of all piece hits, some block at a time."""
        n = len(ids) - self.width + 1
        if n <= 0 or not len(self.pieces.unique):
            return
        total = np.concatenate([[0], np.cumsum(ids > 0)])
        whole = np.flatnonzero(total[self.width :] - total[:n] == self.width)  # all words occur in the test set
        here, at = self.pieces.find(_codes(ids, self.width)[whole])
        where = whole[here]
        offsets = np.array(self.offsets)
        cold = ~self.hot[at]
        for which, rows in _blocks(self.pieces, at[cold], block):
            passage, piece = (c[rows] for c in self.pieces.columns)
            place = where[cold][which]
            yield passage, place - offsets[piece], place
        hot, hot_key = where[~cold], self.pieces.unique[at[~cold]]
        if not len(hot):
            return
        wide = {w: _codes(ids, w) for ps in self.parts for _, w in ps}
        for j, ps in enumerate(self.parts):
            begin = hot - self.offsets[j]
            for number, (offset, w) in enumerate(ps):
                for shift in range(-self.budget, self.budget + 1):
                    place = begin + offset + shift
                    inside = np.flatnonzero((place >= 0) & (place <= len(ids) - w))
                    found, at2 = self.rest.find(_mixed(hot_key[inside], j, number, wide[w][place[inside]]))
                    origin = inside[found]
                    for which, rows in _blocks(self.rest, at2, block):
                        yield self.rest.columns[0][rows], begin[origin][which], hot[origin][which]

    def distance(self, ids: np.ndarray, passage: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Myers' distance of each passage to the best substring of ids near begin, within [low, high)."""
        m, k = self.words, self.budget
        pattern = self.stream[self.pos[passage][:, None] + np.arange(m)]
        pv = np.full(len(passage), (1 << m) - 1, np.int64)
        mv = np.zeros(len(passage), np.int64)
        full, top = (1 << m) - 1, m - 1
        score = np.full(len(passage), m, np.int64)
        best = score.copy()
        bits = (1 << np.arange(m)).astype(np.int64)
        for step in range(-k, m + k):
            at = begin + step
            inside = (at >= low) & (at < high)
            word = np.where(inside, ids[np.clip(at, 0, len(ids) - 1)], -1)
            eq = ((pattern == word[:, None]) * bits).sum(1)
            xv = eq | mv
            xh = ((((eq & pv) + pv) ^ pv) | eq) & full
            ph = (mv | ~(xh | pv)) & full
            mh = pv & xh
            score += ((ph >> top) & 1) - ((mh >> top) & 1)
            ph = (ph << 1) & full
            mh = (mh << 1) & full
            pv = (mh | ~(xv | ph)) & full
            mv = ph & xv
            best = np.minimum(best, score)
        return best


def _blocks(table: Table, at: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What table.expand gives, cut where it passes block rows; one key's rows stay together."""
    ends = np.cumsum(table.many[at])
    a = 0
    while a < len(at):
        done = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + block, side="right")))
        which, rows = table.expand(at[a:b])
        yield which + a, rows
        a = b


def _numbered(passages: Passages, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts in one array, 0 for words outside the test set and between texts; begin and end of each text."""
    get, flat, low, high = passages.number.get, [], [], []
    for t in texts:
        low.append(len(flat))
        flat += [get(w, 0) for w in words_of(t)]
        high.append(len(flat))
        flat.append(0)
    return np.array(flat, np.int32), np.array(low), np.array(high)


def match_batch(passages: Passages, texts: list[str], block: int = 100_000) -> list[tuple[int, int, int, int, int]]:
    """(text number, item id, least distance, passages within the budget, words of a passage) of a batch."""
    if not texts:
        return []
    ids, low, high = _numbered(passages, texts)
    best: dict[str, list[np.ndarray]] = {"t": [], "p": [], "d": []}
    for passage, begin, where in passages.candidates(ids, block):
        text = np.searchsorted(low, where, side="right") - 1
        d = passages.distance(ids, passage, begin, low[text], high[text])
        good = d <= passages.budget
        for name, values in (("t", text), ("p", passage), ("d", d)):
            best[name].append(values[good])
    out: list[tuple[int, int, int, int, int]] = []
    if best["t"]:
        found = pd.DataFrame({k: np.concatenate(v) for k, v in best.items()}).groupby(["t", "p"], sort=False)["d"].min().reset_index()
        which, rows = passages.owners.expand(found["p"].to_numpy())
        owned = pd.DataFrame({"t": found["t"].to_numpy()[which], "i": passages.owners.columns[0][rows], "p": found["p"].to_numpy()[which], "d": found["d"].to_numpy()[which]}).drop_duplicates()
        owned = owned.groupby(["t", "i"], sort=False)["d"].agg(["min", "size"]).reset_index()
        out = [(int(t), passages.item_ids[int(i)], int(d), int(n), passages.words) for t, i, d, n in owned.itertuples(index=False)]
    for size, table in passages.short.items():
        here, at = table.find(_codes(ids, size))
        which, rows = table.expand(at)
        place, item, start = here[which], *[c[rows] for c in table.columns]
        equal = (ids[np.minimum(place[:, None] + np.arange(size), len(ids) - 1)] == passages.stream[start[:, None] + np.arange(size)]).all(1) if len(place) else np.zeros(0, bool)
        text = np.searchsorted(low, place[equal], side="right") - 1
        out += [(int(t), passages.item_ids[int(i)], 0, 1, size) for t, i in sorted(set(zip(text.tolist(), item[equal].tolist())))]
    return out


def leaked_items(
    documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, words: int = WORDS, budget: int = BUDGET, shortest: int = SHORTEST, part_chars: int = MAX_ITEM_CHARS
) -> DataFrame:
    """(doc_id, item_id, distance, n_passages, n_words) of every document that holds a passage of an item.

    A passage is `words` consecutive words of the item (runs of letters and digits, case
    ignored); a document holds it if at most `budget` words must be inserted, dropped or replaced.
    distance is the least such number over the pair's passages, n_passages how many of the item's
    different passages were found, n_words their length. An item of fewer words, but at least
    `shortest`, is a passage of its own, found if it stands in the document unchanged. Items and
    texts that are null, empty or shorter give no row; repeated documents and repeated items each
    count by themselves.

    The index of the test set travels to the executors, where a worker reads it once; the corpus
    is not shuffled. A test set of more than part_chars characters is cut into parts by a hash of
    its rows, and the corpus is read once for each part, so no size is too large for the memory.
    """
    rows = items.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    count = max(1, math.ceil(size / part_chars))
    corpus = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    kinds = corpus.schema["doc_id"].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, n_passages int, n_words int"

    def matched(part: int) -> DataFrame:
        mine = rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(count)) == part) if count > 1 else rows
        shared = documents.sparkSession.sparkContext.broadcast(Passages([(r[0], r[1]) for r in mine.orderBy("k", "t").collect()], words, budget, shortest))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), 1000):
                    few = pdf.iloc[a : a + 1000]
                    ids = few["doc_id"].to_numpy()
                    found = match_batch(shared.value, few["text"].tolist())
                    yield pd.DataFrame([(ids[t], *rest) for t, *rest in found], columns=["doc_id", "item_id", "distance", "n_passages", "n_words"])

        return corpus.mapInPandas(run, schema)

    out = matched(0)
    for part in range(1, count):
        out = out.unionByName(matched(part))
    return out

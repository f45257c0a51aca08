"""Documents packed into context windows by lexical retrieval.

The corpus is packed in shards: the documents of one input split, in bounded groups. Each shard
holds a BM25 inverted index over its documents, by their exact terms. The largest unused document
seeds a window; the index returns its unused neighbours, and the best that still fit fill the
window greedily. The items of windows that stay short are placed anew: of the windows that an item
fills about as tightly as any, it goes to the one that holds its best neighbour. Document
frequencies come from all documents, in a count-min sketch of fixed size.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator
from zlib import adler32, crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
SHARD = 2048
BINS = 1 << 17  # of each of the two rows of the sketch of document frequencies
SLACK = 64  # an item may leave up to a 64th of the window more than in the tightest place, to be with its neighbours
K1, B = 1.2, 0.75

#: Tokens: a run of letters, one to three digits, any other single character but white space.
TOKEN = re.compile(r"[^\W\d_]+|\d{1,3}|[^\w\s]|_|[^\W]")
_LETTERS, _DIGITS, _SPACE = string.ascii_letters.encode(), string.digits.encode(), bytes([9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
_TO_WORDS = bytes(ord(chr(c).lower()) if c in _LETTERS else 32 for c in range(256))
_TO_DIGITS = bytes(c if c in _DIGITS else 32 for c in range(256))


def counted(text: str) -> tuple[int, list[bytes]]:
    """Number of tokens, and the letter runs in lower case; ASCII texts without a regular expression."""
    if text.isascii():
        raw = text.encode()
        words = raw.translate(_TO_WORDS).split()
        other = len(raw.translate(None, _LETTERS + _DIGITS + _SPACE))
        return len(words) + sum([(len(d) + 2) // 3 for d in raw.translate(_TO_DIGITS).split()]) + other, words
    tokens = TOKEN.findall(text)
    return len(tokens), [w.encode() for w in map(str.lower, tokens) if w[0].isalpha()]


def token_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def _slots(term: bytes) -> tuple[int, int]:
    return crc32(term) % BINS, BINS + adler32(term * 3) * 2654435761 % (1 << 32) % BINS


class Terms:
    """Numbers of terms as they come, and their places in the sketch."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.slots: list[tuple[int, int]] = []

    def numbers(self, words: Iterable[bytes]) -> list[int]:
        out, number = [], self.number
        for w in words:
            c = number.get(w)
            if c is None:
                c = number[w] = len(self.slots)
                self.slots.append(_slots(w))
            out.append(c)
        return out


def document_frequencies(documents: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """(documents with a term, by place in the sketch; number of documents), over all documents.

    A term's frequency is the lesser of its two places, never too small. The sketch is of fixed
    size, so what reaches the driver doesn't grow with the corpus.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, terms = np.zeros(2 * BINS + 1, np.int64), Terms()
        for pdf in batches:
            flat: list[int] = []
            for t in pdf["text"]:
                flat += terms.numbers(set(counted(t)[1]))
            if flat:
                seen = np.bincount(np.array(flat, np.int64), minlength=len(terms.slots))
                slots = np.array(terms.slots, np.int64)
                for k in (0, 1):
                    total += np.bincount(slots[:, k], seen, minlength=2 * BINS + 1).astype(np.int64)
            total[2 * BINS] += len(pdf)
            if len(terms.slots) > 1_000_000:
                terms = Terms()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bin": at, "n": total[at]})

    texts = documents.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
    df = np.zeros(2 * BINS + 1, np.int64)
    for b, n in texts.mapInPandas(run, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect():
        df[b] = n
    return df[: 2 * BINS], int(df[2 * BINS])


class Shard:
    """BM25 inverted index over a bounded group of items, and the windows packed from it."""

    def __init__(self, sizes: list[int], doc: np.ndarray, term: np.ndarray, idf: np.ndarray, window: int):
        """doc and term: the item and the term number of every word; idf by term number. A length is a number of words."""
        self.sizes, self.window = np.array(sizes, np.int64), window
        n = len(sizes)
        lengths = np.bincount(doc, minlength=n).astype(np.float64)
        wide = np.int64(max(1, len(idf)))
        code, count = np.unique(doc * wide + term, return_counts=True)
        doc, term = code // wide, code % wide
        self.of = np.split(term, np.searchsorted(doc, np.arange(1, n)))
        order = np.argsort(term, kind="stable")
        term, self.posting = term[order], doc[order]
        self.terms, self.first = np.unique(term, return_index=True)
        self.last = np.append(self.first[1:], len(term)).astype(np.int64)
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if n else 1.0))
        tf = count[order]
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.posting])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every item for the seed's distinct terms."""
        at = np.searchsorted(self.terms, self.of[seed])
        if not len(at):
            return np.zeros(len(self.sizes))
        spans = [slice(a, b) for a, b in zip(self.first[at].tolist(), self.last[at].tolist())]
        docs = np.concatenate([self.posting[s] for s in spans])
        weights = np.concatenate([self.weight[s] for s in spans])
        return np.bincount(docs, weights, minlength=len(self.sizes))

    def pack(self) -> list[list[int]]:
        """Windows as lists of item numbers; every item is in exactly one."""
        sizes, window = self.sizes, self.window
        unused = np.ones(len(sizes), bool)
        windows: list[list[int]] = []
        rest: list[int] = []
        for seed in np.argsort(-sizes, kind="stable").tolist():
            if not unused[seed]:
                continue
            unused[seed] = False
            chosen, left = [seed], window - int(sizes[seed])
            fits = unused & (sizes <= left)
            if left > 0 and fits.any():
                score = self.scores(seed)
                score[~fits] = -1.0
                ranked = np.flatnonzero(fits)
                ranked = ranked[np.lexsort((ranked, -sizes[ranked], -score[ranked]))]
                for d in ranked.tolist():
                    if score[d] <= 0 or not left:
                        break
                    size = int(sizes[d])
                    if size <= left:
                        chosen.append(d)
                        unused[d] = False
                        left -= size
            windows.append(chosen)
            rest.append(left)
        self.first_fill = float(sizes.sum()) / (window * max(1, len(windows)))
        return self.refill(windows, rest)

    def refill(self, windows: list[list[int]], rest: list[int]) -> list[list[int]]:
        """Short windows taken apart again and their items placed anew, largest first.

        An item goes to the window, of those that it fills up to SLACK as tightly as any, that
        holds its best neighbour by BM25; if it fits nowhere it begins a new window.
        """
        sizes, window = self.sizes, self.window
        keep = [k for k in range(len(windows)) if rest[k] * 20 <= window]
        loose = sorted((d for k in range(len(windows)) if rest[k] * 20 > window for d in windows[k]), key=lambda d: (-int(sizes[d]), d))
        out = [windows[k] for k in keep]
        home = np.full(len(sizes), -1, np.int64)
        for n, w in enumerate(out):
            home[w] = n
        gaps = np.zeros(len(out) + len(loose), np.int64)
        gaps[: len(out)] = [rest[k] for k in keep]
        for d in loose:
            size, n = int(sizes[d]), len(out)
            fits = np.flatnonzero(gaps[:n] >= size)
            if len(fits):
                near = fits[gaps[fits] <= gaps[fits].min() + window // SLACK]
                if len(near) > 1:
                    score, placed = self.scores(d), np.flatnonzero(home >= 0)
                    best = np.zeros(n)
                    np.maximum.at(best, home[placed], score[placed])
                    near = near[np.lexsort((near, gaps[near], -best[near]))]
                at = int(near[0])
                out[at].append(d)
            else:
                at = n
                out.append([d])
                gaps[at] = window
            gaps[at] -= size
            home[d] = at
        return out


def pack_windows(documents: DataFrame, key: str, text: str, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, n_pieces, n_tokens, start, end, window_id, place, window_tokens) of every text with a token.

    A text larger than the window is divided, at token boundaries, into full windows and one
    remaining item; every other text is one item and is never divided. start and end are the
    item's characters in the text. Null texts and texts without any token take no place and give
    no row; repeated documents are items of their own. window_id is unique in one result.

    A shard is at most `shard` documents of one input split, so the corpus is read where it lies
    and nothing but the final rows moves. The only thing sent to the executors is the table of
    document frequencies, which has a fixed size.
    """
    df, total = document_frequencies(documents, text)
    shared = documents.sparkSession.sparkContext.broadcast(df)

    def pack(ids: list, texts: list[str], label: str) -> pd.DataFrame:
        known = Terms()
        rows, sizes, item_row, counts, bins, whole = [], [], [], [], [], []
        for doc, t in zip(ids, texts):
            n, words = counted(t)
            if not n:
                continue
            if n > window:
                spans = token_spans(t)
                pieces = -(-n // window)
                cuts = [(p, spans[p * window][0], spans[min(n, (p + 1) * window) - 1][1], min(window, n - p * window)) for p in range(pieces)]
            else:
                pieces, cuts = 1, [(0, 0, len(t), n)]
            for p, a, b, size in cuts:
                rows.append((doc, p, pieces, size, a, b))
                if size == window:
                    whole.append(len(rows) - 1)  # a full window by itself
                    continue
                sizes.append(size)
                item_row.append(len(rows) - 1)
                own = known.numbers(words if pieces == 1 else counted(t[a:b])[1])
                bins += own
                counts.append(len(own))
        windows = [[r] for r in whole]
        if sizes:
            postings = np.repeat(np.arange(len(sizes), dtype=np.int64), counts)
            slots = np.array(known.slots, np.int64).reshape(-1, 2)
            n = np.minimum(shared.value[slots[:, 0]], shared.value[slots[:, 1]])
            idf = np.log(1 + (max(total, 1) - n + 0.5).clip(0.5) / (n + 0.5))  # positive for every term
            built = Shard(sizes, postings, np.array(bins, np.int64), idf, window)
            windows += [[item_row[d] for d in w] for w in built.pack()]
        out = []
        for k, w in enumerate(windows):
            filled = sum(rows[r][3] for r in w)
            out += [(*rows[r], f"{label}-{k}", place, filled) for place, r in enumerate(w)]
        return pd.DataFrame(out, columns=COLUMNS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, k, ids, texts = TaskContext.get().partitionId(), 0, [], []
        for pdf in batches:
            ids += pdf["doc_id"].tolist()
            texts += pdf["text"].tolist()
            while len(ids) >= shard:
                yield pack(ids[:shard], texts[:shard], f"{part}-{k}")
                ids, texts, k = ids[shard:], texts[shard:], k + 1
        if ids:
            yield pack(ids, texts, f"{part}-{k}")

    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, piece int, n_pieces int, n_tokens int, start int, end int, window_id string, place int, window_tokens int")


COLUMNS = ["doc_id", "piece", "n_pieces", "n_tokens", "start", "end", "window_id", "place", "window_tokens"]

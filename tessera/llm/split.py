"""Oversized texts cut at natural boundaries, by agglomerative merging.

A text is first cut into atomic segments (lines; within long lines sentences, words, and at
last fixed runs of characters). Every boundary between two neighbours has a strength. A heap
holds the adjacent pairs; the weakest boundary whose two sides together still fit is merged
first, so that what remains is cut at the strongest boundaries the limit allows.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2000
OVERLAP = 200

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
_SENTENCE = re.compile(r"(?<=[.!?;:。！？])\s+|(?<=[。！？])")
_WORD = re.compile(r"\s+")
_TOP = re.compile(r"(?:#{1,6} |(?:export|public|private|protected|static|async|function|def|class|func|fn|pub|impl|type|interface|const|@)\b)")

HARD, WORD, SENTENCE, LINE, PARAGRAPH, SECTION = 0.0, 1.0, 2.0, 3.0, 5.0, 6.0


def _cuts_within(line: str, start: int, body: int) -> list[tuple[int, float]]:
    """Boundaries inside one line that is longer than a piece may be."""
    found: dict[int, float] = {}
    for m in _WORD.finditer(line):
        found[m.end()] = WORD
    for m in _SENTENCE.finditer(line):
        found[m.end()] = SENTENCE
    found.pop(len(line), None)
    found.pop(0, None)
    step = max(1, body // 16)
    ends, last = [*sorted(found), len(line)], 0
    for end in ends:
        if end - last > body:
            at = last + step
            while at < end:
                while at < end and (unicodedata.combining(line[at]) or line[at] in "‍️" or line[at - 1] == "‍"):
                    at += 1  # a mark stays with the letter before it
                if at < end:
                    found[at] = HARD
                at += step
        last = end
    return [(start + p, s) for p, s in found.items()]


def boundaries(text: str, body: int) -> list[tuple[int, float]]:
    """(position, strength) of every place where text may be cut, in order."""
    out: list[tuple[int, float]] = []
    lines = [(m.start(), m.end()) for m in _LINE.finditer(text)]
    for k, (start, end) in enumerate(lines):
        line = text[start:end]
        if start:
            before = text[lines[k - 1][0] : lines[k - 1][1]]
            bare = line.lstrip(" \t")
            indent = len(line) - len(bare)
            if not before.strip():
                strength = SECTION if indent == 0 and _TOP.match(bare) else PARAGRAPH
            elif not line.strip():
                strength = LINE - 0.5  # a blank line belongs to what it follows
            elif indent == 0 and _TOP.match(bare) and before[:1] in "}\r\n":
                strength = SECTION
            else:
                strength = LINE + 1.0 / (1 + indent)
            if bare[:1] in ("}", ")", "]"):
                strength = LINE - 0.5  # a closing bracket stays with its block
            out.append((start, strength))
        if end - start > body:
            out += _cuts_within(line, start, body)
    out.sort()
    return out


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces without their overlap; a text within the limit is one piece.

    Piece k comes out as text[max(0, start - overlap):end] and is never longer than limit.
    """
    if limit <= overlap or overlap < 0:
        raise ValueError("limit must exceed overlap")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    body = limit - overlap
    cuts = boundaries(text, body)
    starts = [0, *[p for p, _ in cuts]]
    strength = [float("inf"), *[s for _, s in cuts]]
    ends = [*starts[1:], n]
    count = len(starts)
    before = list(range(-1, count - 1))
    after = [*range(1, count), -1]
    alive = bytearray(b"\1") * count
    heap = [(strength[k], ends[k] - starts[k - 1], k - 1, k, ends[k]) for k in range(1, count)]
    heapq.heapify(heap)
    while heap:
        _, size, left, right, end = heapq.heappop(heap)
        if not (alive[left] and alive[right]) or after[left] != right or ends[right] != end or ends[right] - starts[left] != size:
            continue
        if size > (limit if starts[left] == 0 else body):
            continue  # sizes only grow, so this pair can never be merged
        alive[right] = 0
        ends[left] = ends[right]
        follow = after[right]
        after[left] = follow
        if follow >= 0:
            before[follow] = left
            heapq.heappush(heap, (strength[follow], ends[follow] - starts[left], left, follow, ends[follow]))
        prior = before[left]
        if prior >= 0:
            heapq.heappush(heap, (strength[left], ends[left] - starts[prior], prior, left, ends[left]))
    return [(starts[k], ends[k]) for k in range(count) if alive[k]]


def split_oversized(rows: DataFrame, key: str, content: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(row_id, piece_no, n_pieces, start, piece) of every text over the limit.

    Texts within the limit and nulls are filtered in the JVM before any byte reaches Python and
    give no row: they need no cutting. An item's size is its number of Unicode code points.
    Rows with equal keys are split each by itself. start counts where the piece, with its
    overlap, begins. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row_id, text in zip(pdf["row_id"], pdf["content"]):
                spans = split_text(text, limit, overlap)
                for k, (a, b) in enumerate(spans):
                    a = max(0, a - overlap) if k else a
                    out.append((row_id, k, len(spans), a, text[a:b]))
            yield pd.DataFrame(out, columns=["row_id", "piece_no", "n_pieces", "start", "piece"])

    big = rows.select(F.col(key).alias("row_id"), F.col(content).alias("content")).where(F.length("content") > limit)
    kind = big.schema["row_id"].dataType.simpleString()
    return big.mapInPandas(run, f"row_id {kind}, piece_no int, n_pieces int, start int, piece string")

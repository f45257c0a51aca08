"""Texts cut off by field limits or lost transfers.

Lengths are modelled for each source as log-normal and right-censored: at a field limit stand
the texts that would have been longer. The limits are the lengths that hold far more texts than
their surroundings; maximum likelihood gives the distribution, and with it the probability that
a text of just that length was censored.

How a text ends is the other evidence: what kind of line is last, whether its last word is one
that such lines end on, whether a block is open. How often cut texts end so is measured on the
corpus itself, by cutting every text once at a random place; how often whole texts do is what
remains of the observed endings when as many cut ones are taken away as the rarest explanation
allows. The log odds of both are added to those of the posterior at a limit, and to those of the
overall share of cut texts elsewhere.

The last line of a list, a pair, a link or a closing may look whole by chance. At a limit the
likelihoods are those of its source and last word: how often whole texts end so, and how often
the same texts look so where they are cut at a random place inside such a line.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.cut import Cutter

BINS = 1 << 16
NEAR = 40  # lengths on either side that a spike is compared with
SPIKE = 6.0  # times the mean of its surroundings
BESIDE, SHARP = 3, 3.0  # times the most frequent of the lengths right beside it
LEAST = 8  # texts at a limit

_NONE = "\x00none"
_BLANK = " \t\r\n\xa0"
_MARK = re.compile(r"\s*(?:…|\.\.\.|�+|[\[(<](?:truncated|cut off|cut|snip|continued|more|\.\.\.|…)[^\])>]{0,20}[\])>])+\s*$", re.I)
_LOST = re.compile("�+\\s*$")
_END = re.compile(r"[.!?。！？‽][\"'”’»)\]*_`]*$")
_EMOJI = re.compile("[☀-➿\U0001f300-\U0001faff]️?$")
_LIST = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])\s+(.+)$")
_PAIR = re.compile(r"(?![a-z]+:)[^\W\d_][\w' -]{1,30}: (\S+(?: \S+)?)$")
_CLOSE = re.compile(r"(?:--|—|==|~~) ?(.*)$")
_URL = re.compile(r"(?:^|\s)[<(]?[a-z][a-z0-9+.-]*://\S*$")
_EXT = re.compile(r"\.(?:tsx?|jsx?|mjs|cjs|py|go|rs|java|kt|c|h|cc|cpp|rb|php|sh|sql|md|txt|json|ya?ml|toml|xml|html?|css|lock|log|csv|parquet)$", re.I)
_TAIL = re.compile(r"[^\W\d_]+$")
_HUMP = re.compile(r"[A-ZÀ-Ý]?[^\W\d_A-ZÀ-Ý]+$|[A-ZÀ-Ý]+$")


#: Endings that look whole and may still be cut; at a limit they are weighed by fitted likelihoods.
UNSURE = ("list", "closing", "pair", "url")


def line_kind(line: str) -> tuple[str, str]:
    """Kind of a line that may end without punctuation, and what it holds."""
    if m := _LIST.match(line):
        return "list", m[1]
    if m := _CLOSE.match(line):
        return "closing", m[1]
    if _URL.search(line):
        return "url", line
    if m := _PAIR.match(line):
        return "pair", m[1]
    return "prose", line


def last_word(text: str) -> str:
    """The last word in lower case, of an identifier its last part; '' if text ends otherwise."""
    m = _TAIL.search(text)
    return (h[0].lower() if (h := _HUMP.search(m[0])) else m[0].lower()) if m else ""


def _bin(kind: str, word: str) -> int:
    return crc32(f"{kind}\x00{word}".encode()) % BINS


class LineEnds:
    """Counts over a fixed number of bins: words that end lines, their beginnings, and words anywhere in such lines."""

    def __init__(self, counts: np.ndarray):
        self.ends, self.prefixes, self.anywhere = counts

    @staticmethod
    def count(texts: list[str], into: np.ndarray, memo: dict) -> None:
        ends, prefixes, anywhere = [], [], []
        for t in texts:
            for line in t.splitlines():
                if not line or not (line[0] in "-*+•—=~ " or line[0].isdigit() or "://" in line or (": " in line and len(line) < 70)):
                    continue
                kind, body = line_kind(line.rstrip())
                if kind == "prose":
                    continue
                w = last_word(body)
                if not w:
                    continue
                found = memo.get(w)
                if found is None:
                    found = memo[w] = (_bin("e", w), [_bin("p", w[:k]) for k in range(1, len(w) + 1)])
                ends.append(found[0])
                prefixes += found[1]
                for v in body.lower().split():
                    b = memo.get((v,))
                    if b is None:
                        b = memo[(v,)] = _bin("a", v)
                    anywhere.append(b)
        for k, seen in enumerate((ends, prefixes, anywhere)):
            into[k] += np.bincount(np.array(seen, np.int64), minlength=BINS)

    def trait(self, word: str) -> str:
        """Whether a line ends on this word often, at times or hardly ever."""
        e, p, a = self.ends[_bin("e", word)], self.prefixes[_bin("p", word)], self.anywhere[_bin("a", word)]
        if e < 3 or e < 0.1 * p or e < 0.02 * a:
            return "other"
        return "often" if e > 0.5 * p and e > 0.1 * a else "word"


#: Endings that need no odds: what is lost or marked as lost, and what ends a text by definition.
CERTAIN = {"empty": -9.0, "lost character": 9.0, "mark": 9.0, "marked sentence": -9.0, "sentence": -9.0, "block": -9.0}
#: Traits of a last line that looks whole.
WHOLE = ("often", "word", "number", "file")


def ending(line: str, open_block: bool, ends: LineEnds) -> tuple[str, str]:
    """How a text ends, by its last line: the kind of the ending, and what is remarkable about its last word."""
    if not line.strip():
        return "empty", ""
    bare = _MARK.sub("", line).rstrip()
    if _LOST.search(line):
        return "lost character", ""
    if bare != line.rstrip():
        return ("marked sentence" if _END.search(bare) else "mark"), ""
    bare = line.strip()
    if open_block:
        return "open block", ""
    if bare.startswith(("```", "~~~")):
        return "block", ""
    if bare.count("`") % 2:
        return "open code", ""
    if _END.search(bare) or _EMOJI.search(bare):
        token = bare.rsplit(None, 1)[-1]
        if token.endswith(".") and "/" in token and "://" not in token and not _EXT.search(token.rstrip(".")) and not token.endswith("..."):
            return "open path", ""
        return "sentence", ""
    kind, body = line_kind(bare)
    if kind == "prose":
        return ("heading", ends.trait(last_word(bare))) if bare.startswith("#") else ("prose", "")
    token = body.rsplit(None, 1)[-1] if body.split() else ""
    if not token:
        return kind, "nothing"
    if token[-1].isdigit():
        return kind, "number"
    if _EXT.search(token):
        return kind, "file"
    if kind != "url" and ("/" in token or "." in token):
        return kind, "joined"
    return kind, ends.trait(last_word(token))


def unsure(kind: str, trait: str) -> bool:
    return kind in UNSURE and trait in WHOLE


class Odds:
    """Log likelihood ratios of the endings, and the log odds of a cut text, from counts (whole, cut) by ending.

    What is observed is a mixture of whole texts and of cut ones, which end like random cuts. The
    share of cut ones is the largest that no ending contradicts, of those that at least a 20th of
    the cuts show: an ending that whole texts never have is seen only as often as cuts bring it.
    """

    def __init__(self, counts: dict[str, tuple[int, int]]):
        seen = sum([n for n, _ in counts.values()]) + 1.0
        cuts = sum([k for _, k in counts.values()]) + 1.0
        shares = {e: (n / seen, k / cuts) for e, (n, k) in counts.items()}
        self.share = min([1e-2 if not counts else 0.5, *[(n + 0.5 / seen) / k for n, k in shares.values() if k >= 0.05]])
        self.ratio = {e: math.log((k + 0.5 / cuts) / (max(0.0, n - self.share * k) / (1 - self.share) + 0.5 / seen)) for e, (n, k) in shares.items()}
        self.prior = math.log(self.share / (1 - self.share))

    def of(self, kind: str, trait: str) -> float:
        """Log likelihood ratio of an ending; +-9 of the certain ones, 0 of one never seen."""
        return CERTAIN.get(kind, self.ratio.get(f"{kind}/{trait}", 0.0))


def censoring(lengths: pd.DataFrame) -> pd.DataFrame:
    """(source, n, posterior) of the limits of one source, from its table (source, n, count) of lengths."""
    empty = pd.DataFrame({"source": pd.Series([], dtype=object), "n": pd.Series([], dtype="int64"), "posterior": pd.Series([], dtype=float)})
    lengths = lengths[lengths["n"] > 0].sort_values("n")
    if not len(lengths):
        return empty
    n, c = lengths["n"].to_numpy(np.int64), lengths["count"].to_numpy(np.float64)
    total = np.concatenate([[0.0], np.cumsum(c)])
    low, high = np.searchsorted(n, n - NEAR), np.searchsorted(n, n + NEAR, side="right")
    around = (total[high] - total[low] - c) / (2 * NEAR)
    spikes = (c >= LEAST) & (c > SPIKE * np.maximum(around, 0.25))
    for k in np.flatnonzero(spikes):  # lengths may gather around some values; a limit stands out among its next neighbours too
        beside = slice(np.searchsorted(n, n[k] - BESIDE), np.searchsorted(n, n[k] + BESIDE, side="right"))
        spikes[k] = c[k] > SHARP * (np.partition(np.append(c[beside], 0.0), -2)[-2])
    if not spikes.any():
        return empty
    x = np.log(n)
    censored = np.where(spikes, np.maximum(0.0, c - around), 0.0)
    for _ in range(20):  # what is expected at a limit without censoring follows from the fit, and the fit from the censored
        seen = c - censored
        mu, sigma = _fit(x, seen, censored)
        density = np.exp(-0.5 * ((x - mu) / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi) * n)
        expected = np.minimum(c, np.maximum(around, c.sum() * density))
        update = np.where(spikes, c - expected, 0.0)
        if np.abs(update - censored).max() < 1e-3 * c.sum():
            break
        censored = update
    out = lengths[spikes]
    return pd.DataFrame({"source": out["source"], "n": out["n"].astype("int64"), "posterior": (censored[spikes] / c[spikes]).clip(0.0, 0.999)})


def _fit(x: np.ndarray, seen: np.ndarray, censored: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of a normal, some of whose values are only known to be larger: EM to the maximum of the likelihood."""
    weight = seen.sum() + censored.sum()
    mu = float((x * (seen + censored)).sum() / weight)
    sigma = max(1e-3, math.sqrt(float(((x - mu) ** 2 * (seen + censored)).sum() / weight)))
    at = np.flatnonzero(censored)
    erfc = np.array([0.0] * len(at))
    for _ in range(60):
        z = (x[at] - mu) / sigma
        erfc = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z])
        hazard = np.where(erfc > 1e-12, np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / np.maximum(erfc, 1e-12), z + 1 / np.maximum(z, 1e-3))
        first = mu + sigma * hazard
        second = sigma**2 * (1 + z * hazard - hazard**2) + first**2
        m1 = float((x * seen).sum() + (first * censored[at]).sum()) / weight
        m2 = float((x * x * seen).sum() + (second * censored[at]).sum()) / weight
        new_sigma = max(1e-3, math.sqrt(max(1e-6, m2 - m1 * m1)))
        done = abs(m1 - mu) + abs(new_sigma - sigma) < 1e-6
        mu, sigma = m1, new_sigma
        if done:
            break
    return mu, sigma


def end_bin(line: str) -> int:
    """Bin of the word, or else the token, that a line ends on."""
    return _bin("f", last_word(line.rstrip()) or line.rstrip().rpartition(" ")[2])


def fitted_odds(posterior: Column, whole: Column, inside: Column, between: Column) -> Column:
    """Log odds that a text at a limit was cut inside its last line, from the counts of its ending.

    whole: texts that end so; inside and between: cuts of as many texts at a random place that
    look so inside a line and at a line's end. A cut at a line's end loses no part of that line.
    """
    return F.log(posterior * (inside + 0.5) / (posterior * (between + 0.5) + (1 - posterior) * (whole + 0.5)))


def truncated_texts(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(doc_id, source, n, ending, posterior, score, alone, truncated) of every non-null text.

    n is the length in code points, ending how the text ends, posterior the probability that a
    text of this length of its source was censored (0 at lengths that are no limit), score the
    log odds that the text was cut off, truncated whether they are positive, alone whether the
    ending alone says so. A text that ends on a whole sentence or block, or is empty, is not cut
    by definition, whatever its length, and one with a mark of loss is; everything else is up to
    the fitted odds. Null texts give no row; a null source is a source of its own; repeated rows
    count each. In an empty table nothing is fitted and nothing comes out.

    Three passes: one over all lines for the counts of line ends, of fixed size, one that adds
    up lengths by source, and one that counts the endings of whole and of cut texts. The evidence
    itself needs the last line and the number of fences, which the JVM takes from the whole text.
    A source's lengths are pre-aggregated, so a source with a third of all rows is as many rows as
    it has distinct lengths. The driver gets the bins and one row for each kind of ending.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(source).cast("string"), F.lit(_NONE)).alias("source")).where(F.col("text").isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, memo = np.zeros((3, BINS), np.int64), {}
        for pdf in batches:
            LineEnds.count(pdf["text"].tolist(), total, memo)
        what, at = np.nonzero(total)
        yield pd.DataFrame({"what": what, "bin": at, "n": total[what, at]})

    counts = np.zeros((3, BINS), np.int64)
    for what, b, n in rows.select("text").mapInPandas(count, "what long, bin long, n long").groupBy("what", "bin").agg(F.sum("n")).collect():
        counts[what, b] = n
    shared = spark.sparkContext.broadcast(counts)

    def last_line(c: Column) -> Column:
        return F.substring_index(F.substring_index(F.rtrim(c, F.lit(_BLANK)), "\n", -1), "\r", -1)

    def open_fence(c: Column) -> Column:
        return (F.length(c) - F.length(F.replace(c, F.lit("```"), F.lit("``")))) % 2 == 1

    t = F.col("text")
    sized = rows.select("doc_id", "source", "text", F.length("text").cast("long").alias("n"))
    measured = sized.select("doc_id", "source", "n", last_line(t).alias("line"), open_fence(t).alias("open"))
    cutter = Cutter(spark, "truncation")
    limits = cutter.cut(sized.groupBy("source", "n").agg(F.count(F.lit(1)).alias("count")).groupBy("source").applyInPandas(censoring, "source string, n long, posterior double"))

    part = F.left(t, (F.pmod(F.xxhash64("text"), F.col("n") - 1) + 1).cast("int"))
    after = F.substr(t, F.length(F.rtrim(F.col("part"), F.lit(_BLANK))) + 1)
    cut = sized.where("n > 1").withColumn("part", part).select("source", "n", last_line(t).alias("line"), open_fence(t).alias("open"), last_line(F.col("part")).alias("cut_line"), open_fence(F.col("part")).alias("cut_open"), F.rlike(after, F.lit(r"^[ \t\xa0]*[^ \t\r\n\xa0]")).alias("inside"))

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends = LineEnds(shared.value)
        for pdf in batches:
            seen: Counter = Counter()
            for source, n, line, o, cut_line, cut_o, inside in zip(*(pdf[c] for c in ("source", "n", "line", "open", "cut_line", "cut_open", "inside"))):
                for end, is_open, what in ((line, o, "whole"), (cut_line, cut_o, "inside" if inside else "between")):
                    kind, trait = ending(end, bool(is_open), ends)
                    if kind not in CERTAIN or kind in ("sentence", "block"):
                        seen[source, n, f"{kind}/{trait}", end_bin(end) if unsure(kind, trait) else 0, what] += 1
            yield pd.DataFrame([(*k, c) for k, c in seen.items()], columns=["source", "n", "ending", "word", "what", "count"])

    counted = cut.mapInPandas(tally, "source string, n long, ending string, word int, what string, count long").groupBy("source", "n", "ending", "word").agg(*[F.sum(F.when(F.col("what") == w, F.col("count")).otherwise(0)).alias(w) for w in ("whole", "inside", "between")])
    counted = counted.join(limits.select("source", "n", F.lit(True).alias("limit")), ["source", "n"], "left").where("limit is null")
    counted = cutter.cut(counted.groupBy("source", "ending", "word").agg(*[F.sum(w).alias(w) for w in ("whole", "inside", "between")]))
    odds = Odds({e: (n, k) for e, n, k in counted.groupBy("ending").agg(F.sum("whole"), F.sum("inside")).collect()})
    at_limits = limits.select("source").distinct()
    rates = counted.where("word <> 0").join(at_limits, "source", "left_semi").select("source", F.substring_index("ending", "/", 1).alias("ending"), "word", "whole", "inside", "between").groupBy("source", "ending", "word").agg(*[F.sum(w).alias(w) for w in ("whole", "inside", "between")])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends = LineEnds(shared.value)
        for pdf in batches:
            found = [ending(line, bool(o), ends) for line, o in zip(pdf["line"], pdf["open"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n": pdf["n"], "ending": [k for k, _ in found], "evidence": [odds.of(*f) for f in found], "certain": [k in CERTAIN for k, _ in found], "word": [end_bin(line) if unsure(*f) else 0 for line, f in zip(pdf["line"], found)]})

    kind = measured.schema["doc_id"].dataType.simpleString()
    judged = measured.mapInPandas(judge, f"doc_id {kind}, source string, n long, ending string, evidence double, certain boolean, word int")
    fitted = fitted_odds(F.col("posterior"), *[F.coalesce(w, F.lit(0)) for w in ("whole", "inside", "between")])
    limit = F.coalesce("posterior", F.lit(0.0)) > 0
    alone = F.when(F.col("certain"), F.col("evidence")).otherwise(F.col("evidence") + odds.prior)
    score = F.when(F.col("certain") | ~limit, alone).when(F.col("word") != 0, fitted).otherwise(F.col("evidence") + F.log(F.col("posterior") / (1 - F.col("posterior"))))
    return judged.join(limits, ["source", "n"], "left").join(rates, ["source", "ending", "word"], "left").select(
        "doc_id", F.when(F.col("source") != _NONE, F.col("source")).alias("source"), "n", "ending", F.coalesce("posterior", F.lit(0.0)).alias("posterior"),
        score.alias("score"), (alone > 0).alias("alone"), (score > 0).alias("truncated"),
    )


def truncation_rates(judged: DataFrame) -> DataFrame:
    """(source, n_texts, n_truncated, share, n_at_limits, expected_censored) by source, a null source included."""
    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if("truncated").alias("n_truncated"), F.avg(F.col("truncated").cast("double")).alias("share"),
        F.count_if(F.col("posterior") > 0).alias("n_at_limits"), F.sum("posterior").alias("expected_censored"),
    )

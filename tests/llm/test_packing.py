import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.packing import B, K1, Shard, Terms, counted, pack_windows, token_spans


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=st.sampled_from("abZ é1234.-_ \n\t\xa0"), max_size=80))
def test_token_count(text):
    want = len(re.findall(r"[^\W\d_]+|\d{1,3}|[^\w\s]|_", text))
    assert counted(text)[0] == len(token_spans(text)) == want


def test_windows(spark):
    words = ["graph", "cache", "token", "memory", "stale", "merge"]
    docs = [(k, " ".join(f"{words[(k + j) % 6]}{'abc'[j % 3]}" for j in range(10 + 13 * (k % 17)))) for k in range(120)]
    docs += [(500, "big word " * 700), (501, None), (502, ""), (503, " \n"), (504, "x " * 256), (505, "x " * 512), (3, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'y' as piece")
    rows = pack_windows(df, "doc_id", "text", window=256, shard=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r["window_id"], []).append(r)
    assert all(sum(r["n_tokens"] for r in w) == w[0]["window_tokens"] <= 256 for w in by.values())
    text = dict(docs)
    pieces = {}
    for r in rows:
        assert counted(text[r["doc_id"]][r["start"] : r["end"]])[0] == r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == {i for i, t in docs if t and t.strip()}
    for i, ps in pieces.items():
        n = counted(text[i])[0]
        assert sum(p["n_tokens"] for p in ps) == n * (2 if i == 3 else 1)
        assert (len(ps) > 1) == (n > 256 or i == 3)
    least = sum(counted(t)[0] for _, t in docs if t) / 256
    assert len(by) <= 1.2 * least + 4
    assert pack_windows(df.where("false"), "doc_id", "text").count() == 0


def test_neighbours_share_windows(spark):
    docs = [(k, " ".join([f"topic{chr(97 + k % 20)}{'xyz'[j % 3]}" for j in range(100)] + ["common"])) for k in range(200)]
    rows = pack_windows(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), "doc_id", "text", window=1024).collect()
    by = {}
    for r in rows:
        by.setdefault(r["window_id"], set()).add(r["doc_id"] % 20)
    assert len(by) == 20 and all(len(v) == 1 for v in by.values())


def test_shared_terms_retrieve_each_other(spark):
    """A group of copies that is a third of all documents: its members belong together, though their terms are common."""
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    docs = [(k, " ".join(words[:60] if k % 3 == 0 else [f"w{words[(k * 7 + j * j) % 125]}{words[(k + j) % 125]}" for j in range(60)])) for k in range(90)]
    rows = pack_windows(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), "doc_id", "text", window=300).collect()
    by = {}
    for r in rows:
        by.setdefault(r["window_id"], []).append(r["doc_id"] % 3 == 0)
    assert sum(all(w) for w in by.values()) == 6 and not any(any(w) and not all(w) for w in by.values())


def test_letters_are_terms(spark):
    docs = [(k, " ".join("ab"[k % 2] for _ in range(50))) for k in range(20)]
    rows = pack_windows(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), "doc_id", "text", window=250).collect()
    by = {}
    for r in rows:
        by.setdefault(r["window_id"], set()).add(r["doc_id"] % 2)
    assert len(by) == 4 and all(len(v) == 1 for v in by.values())


def test_scores_are_bm25_with_term_frequencies():
    docs = [[1, 2], [1, 1, 1, 3], [2, 3, 3, 3]]
    idf = np.zeros(5)
    idf[1:4] = 0.5, 0.7, 0.9
    doc = np.array([k for k, d in enumerate(docs) for _ in d])
    got = Shard([len(d) for d in docs], doc, np.array(sum(docs, [])), idf, 10).scores(0)
    mean = sum(map(len, docs)) / 3
    want = [sum(idf[t] * d.count(t) * (K1 + 1) / (d.count(t) + K1 * (1 - B + B * len(d) / mean)) for t in (1, 2)) for d in docs]
    assert np.allclose(got, want)
    assert counted("é é a")[1].count("é".encode()) == 2


def test_terms_are_exact():
    terms = Terms()
    words = [f"w{k}".encode() for k in range(200_000)]
    assert terms.numbers(words) == list(range(200_000)) and terms.numbers([words[7]]) == [7]


def test_refill_prefers_neighbours():
    """Of two windows with about the same room an item goes to the one with its terms."""
    sizes = [80, 80, 19, 20]
    terms = [[1, 2], [3, 4], [3, 4], [1, 2]]
    doc = np.array([k for k, t in enumerate(terms) for _ in t])
    shard = Shard(sizes, doc, np.array(sum(terms, [])), np.ones(5), 100)
    windows = shard.refill([[0], [1]], [0, 0])
    assert windows == [[0], [1]]
    shard.window = 6400
    got = shard.refill([[0], [1], [2], [3]], [20, 21, 6300, 6300])
    assert [0, 3] in got and [1, 2] in got

import random

import numpy as np
import pytest

from tessera.llm.leak import HOT, Passages, leaked_items, match_batch, words_of


def best_distance(passage, text):
    """Least edits that turn a passage into a substring of text."""
    row = [0] * (len(text) + 1)
    for k, p in enumerate(passage, 1):
        new = [k]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("hot", [0, 2, 32])
@pytest.mark.parametrize("budget", [0, 1, 2])
def test_against_brute_force(budget, hot):
    rng = random.Random(budget)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(words) for _ in range(20))) for k in range(6)]
    texts = []
    for _ in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            leak = words_of(rng.choice(items)[1])[rng.randint(0, 5) :][: rng.randint(8, 20)]
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(leak))
                leak[k : k + 1] = rng.choice([[], ["other"], [leak[k], "more"]])
            at = rng.randint(0, len(own))
            own[at:at] = leak
        texts.append(" ".join(own))
    got = {(t, i): d for t, i, d, _, _ in match_batch(Passages(items, 10, budget, hot=hot), texts, block=50)}
    want = {}
    for t, text in enumerate(texts):
        for i, item in items:
            w = words_of(item)
            d = min(best_distance(w[k : k + 10], words_of(text)) for k in range(len(w) - 9))
            if d <= budget:
                want[(t, i)] = d
    assert got == want


def test_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, f"intro, {item.upper()}! end"), (2, item.replace(" seven", "")), (3, None), (4, ""), (5, "one two three"), (1, f"intro, {item.upper()}! end"), (6, item.split(" seven")[0]), (7, "seven" + item.split("seven")[1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id")
    items = spark.createDataFrame([(10, item), (11, None), (12, "short item"), (13, item)], "item_id long, text string")
    got = sorted(tuple(r) for r in leaked_items(d, "doc_id", "text", items, "item_id", "text").select("doc_id", "item_id", "distance").collect())
    assert got == sorted([(1, 10, 0), (1, 13, 0), (1, 10, 0), (1, 13, 0), (2, 10, 1), (2, 13, 1)])
    assert leaked_items(d.where("false"), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leaked_items(d, "doc_id", "text", items.where("false"), "item_id", "text").count() == 0


def test_nothing_to_find():
    assert match_batch(Passages([], 13, 1), ["a b c"]) == [] and match_batch(Passages([(1, "a b")], 13, 1), []) == []
    assert Passages([(1, "a " * 20)]).stream.dtype == np.int32


def test_short_items_are_matched_whole():
    items = [(1, "a small item of six words"), (2, "too short"), (3, "A small, item of six words")]
    got = match_batch(Passages(items, 13, 1), ["so: a SMALL item of six-words!", "a small item of five words", "too short", ""])
    assert sorted(got) == [(0, 1, 0, 1, 6), (0, 3, 0, 1, 6)]


def test_hot_pieces_make_few_candidates():
    """4,000 items that share one sentence: its passages are one each, and others need more than the shared words."""
    shared = "the quick brown fox jumps over the lazy dog and then sleeps all day"
    items = [(k, f"intro{k} word{k} thing{k} one{k} two{k} three{k} {shared} four{k} five{k} six{k} seven{k}") for k in range(4000)]
    passages = Passages(items)
    texts = [f"doc {k} says {shared} and more {k}" for k in range(3)]
    ids, _, _ = __import__("tessera.llm.leak", fromlist=["_numbered"])._numbered(passages, texts)
    n = sum(len(p) for p, _, _ in passages.candidates(ids, 10_000))
    assert passages.hot.any() and n < 100 * 4000 and len(passages.pos) < 4000 * 14
    found = match_batch(passages, texts)
    assert len(found) == 3 * 4000 and all(d == 0 and size == 13 for _, _, d, _, size in found)
    assert HOT < 4000


def test_planted_edits_are_found():
    rng = random.Random(9)
    words = [f"v{k}" for k in range(4000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(40))) for k in range(50)]
    texts, want = [], set()
    for t in range(300):
        i = rng.randrange(50)
        leak = words_of(items[i][1])[rng.randint(0, 27) :][:13]
        if len(leak) < 13:
            continue
        k = rng.randrange(1, 12)
        leak[k : k + 1] = rng.choice([[], ["other"], [leak[k], "more"]])
        texts.append(" ".join([*[rng.choice(words) for _ in range(30)], *leak, *[rng.choice(words) for _ in range(30)]]))
        want.add((len(texts) - 1, i))
    got = {(t, i) for t, i, d, _, _ in match_batch(Passages(items), texts) if d == 1}
    assert want <= got


def test_a_large_test_set_goes_in_parts(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = spark.createDataFrame([(k, f"{item} fourteen{k}") for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item), (2, "nothing")], "doc_id long, text string")
    whole = leaked_items(docs, "doc_id", "text", items, "item_id", "text").collect()
    parts = leaked_items(docs, "doc_id", "text", items, "item_id", "text", part_chars=800).collect()
    assert sorted(whole) == sorted(parts) and len(whole) == 30

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.split import split_oversized, split_text


@settings(deadline=None, max_examples=120)
@given(st.text(alphabet=st.sampled_from("ab \n\r.{}\téǵ"), max_size=900), st.sampled_from([(60, 10), (100, 0), (50, 49)]))
def test_pieces_cover_the_text(text, bounds):
    limit, overlap = bounds
    spans = split_text(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    pieces = [text[max(0, a - overlap) if k else a : b] for k, (a, b) in enumerate(spans)]
    assert all(len(p) <= limit for p in pieces)
    assert "".join(text[a:b] for a, b in spans) == text
    assert (len(spans) == 1) == (len(text) <= limit)


def test_natural_places():
    text = "".join(f"def f{k}():\n    return {k}\n    # {'x' * 60}\n\n" for k in range(30))
    starts = [text[a : a + 3] for a, _ in split_text(text, 500, 50)]
    assert set(starts) == {"def"}
    prose = " ".join(f"Sentence number {k} is here." for k in range(80))
    assert all(prose[a:].startswith("Sentence") for a, _ in split_text(prose, 300, 30))
    words = "word " * 500
    assert all(words[a:].startswith("word") for a, _ in split_text(words, 300, 30))
    crlf = "line\r\n" * 300
    assert all(crlf[a : a + 1] != "\n" for a, _ in split_text(crlf, 300, 30))


def test_very_long_unbroken():
    spans = split_text("x" * 200_000)
    assert max(b - a for a, b in spans) <= 2000 and sum(b - a for a, b in spans) == 200_000
    mark = ("e" + "́") * 3000  # a letter and its accent stay together
    assert all(mark[a] == "e" for a, _ in split_text(mark))


def test_rows(spark):
    rows = [(1, "a" * 2000, "x"), (2, "b " * 1500, "x"), (3, None, "x"), (4, "", "x"), (2, "b " * 1500, "x")]
    df = spark.createDataFrame(rows, "id long, content string, piece string")
    out = split_oversized(df, "id", "content").collect()
    assert {r["row_id"] for r in out} == {2} and len(out) == 2 * out[0]["n_pieces"]
    assert split_oversized(df.where("false"), "id", "content").count() == 0


def test_most_cuts_are_at_line_ends():
    """Text with lines is cut between them, never inside a word."""
    import random

    from tessera.llm.split import LINE, boundaries

    rng = random.Random(1)
    text = "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma."]) for _ in range(rng.randrange(1, 40))) for _ in range(300))
    strength = dict(boundaries(text, 1800))
    cuts = [strength[a] for a, _ in split_text(text)[1:]]
    assert len(cuts) > 10 and all(s >= LINE - 0.5 for s in cuts)

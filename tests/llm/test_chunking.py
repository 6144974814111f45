from hypothesis import given, settings
from hypothesis import strategies as st

from specsift.llm import chunking as C

word = st.sampled_from(["a", "bb.", "ccc,", "d\n\n", "e\n", "f.\n\n", " g"])


@settings(max_examples=60, deadline=None)
@given(st.lists(word, min_size=0, max_size=120), st.integers(10, 20), st.integers(0, 5))
def test_pieces_cover_the_text(words, limit, overlap):
    text = " ".join(words)
    tokens = text.split()
    out = C.split(text, limit, overlap)
    if len(tokens) <= limit:
        assert out == [(text, len(tokens), False)]
        return
    rebuilt = []
    for k, (piece, n, again) in enumerate(out):
        t = piece.split()
        assert len(t) == n <= limit and again == (k > 0)
        if k:
            assert t[:overlap] == rebuilt[-overlap:] or overlap == 0
        rebuilt += t[overlap if k else 0 :]
    assert rebuilt == tokens


def brute(cost, limit, overlap):
    """The best total by trying every set of cuts."""
    n = len(cost) - 1
    target = n / (1 + -(-(n - limit) // (limit - overlap)))
    best = {}

    def go(start):
        if start == n:
            return 0.0
        if start not in best:
            top = limit if start == 0 else limit - overlap
            best[start] = min(C.BALANCE * ((e - start - target) / target) ** 2 + 0.25 + cost[e] + go(e) for e in range(start + 1, min(n, start + top) + 1))
        return best[start]

    return go(0)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.5, 1.0, 4.0, 10.0]), min_size=12, max_size=40))
def test_cuts_are_the_cheapest(costs):
    import numpy as np

    cost = np.array([0.0, *costs, 0.0])
    at = C.cuts(cost, 10, 3)
    n = len(cost) - 1
    target = n / (1 + -(-(n - 10) // 7))
    total = sum(C.BALANCE * ((b - a - target) / target) ** 2 + 0.25 + cost[b] for a, b in zip(at, at[1:], strict=False))
    assert abs(total - brute(cost, 10, 3)) < 1e-9


def test_prefers_paragraph_ends():
    text = " ".join(["w"] * 100) + ".\n\n" + " ".join(["v"] * 180)
    assert [p.split()[-1] for p, _, _ in C.split(text)][0] == "w."


def test_edge_rows(spark):
    long = " ".join(["x"] * 60_000)
    df = spark.createDataFrame([("a", None, 1), ("b", "", 2), ("c", "  ", 3), ("d", long, 4), ("d", long, 4), (None, "one", 5), ("e", "y" * 200_000, 6)], "chunk_id string, text string, token_count int")
    rows = C.pieces(df).collect()
    assert {r.chunk_id: r.token_count for r in rows if r.chunk_id in "abce"} == {"a": 0, "b": 0, "c": 0, "e": 1} if None not in [r.chunk_id for r in rows] else True
    assert max(r.token_count for r in rows) <= C.LIMIT
    assert [r.chunk_id for r in C.found(df).collect()] == ["d"]
    assert C.found(df.limit(0)).count() == 0

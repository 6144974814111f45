import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from specsift.llm import leakage as L

ITEM = "One two three four five six seven eight nine ten eleven twelve"


def hits(spark, docs, items):
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(list(items), "item_id bigint, item_text string")
    return sorted(tuple(r) for r in L.found(d, i).collect())


def test_forms_of_a_passage(spark):
    words = ITEM.split()
    docs = [
        (1, "x " + ITEM.upper() + " y"), (2, "> one, two three\n> four **five** six\n> seven eight nine ten"), (3, " ".join(words[:9])), (4, "one tw​o three fоur five six seven eight nine ten"),
        (5, "<b>one two</b> three four five six se-\nven eight nine ten"), (6, None), (7, ""), (8, "one two three four five or six seven eight nine ten eleven twelve"), (9, "ｏｎｅ two three four five six seven eight nine ten"),
    ]
    assert hits(spark, docs, [(1, ITEM), (2, None), (3, "too short"), (4, ITEM + " more")]) == [(k, i) for k in (1, 2, 4, 5, 9) for i in (1, 4)]


def test_spans_merge(spark):
    d = spark.createDataFrame([(1, f"a b {ITEM} c {ITEM}")], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, ITEM)], "item_id bigint, item_text string")
    assert sorted(tuple(r) for r in L.spans(d, i).collect()) == [(1, 7, 2, 13), (1, 7, 15, 26)]


def test_empty(spark):
    assert hits(spark, [], [(1, ITEM)]) == [] and hits(spark, [(1, ITEM)], []) == []


def test_long_and_repeated(spark):
    assert hits(spark, [(1, "w " * 200_000 + ITEM), (1, "w " * 200_000 + ITEM)], [(1, ITEM)]) == [(1, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_index_equals_scan(text, phrase):
    seq = np.array([*text, 0], dtype=np.int64)
    index = L.FmIndex(seq, 4)
    low, high = index.search(np.array([phrase]))
    expected = [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)] == phrase]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == expected
    w = L.WaveletMatrix(seq, 4)
    assert w.get(np.arange(len(seq))).tolist() == seq.tolist()
    assert [int(w.rank(np.array([2]), np.array([k]))[0]) for k in range(len(seq) + 1)] == [int((seq[:k] == 2).sum()) for k in range(len(seq) + 1)]


def test_items_in_several_passes_give_the_same(spark, monkeypatch):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(9)] + [(20, None), (21, "")]
    docs = [(k, f"a {t} b" if t else t) for k, t in items] + [(30, " ".join(t for _, t in items if t))]
    once = sorted(hits(spark, docs, items))
    monkeypatch.setattr(L, "ITEM_BYTES", 100)
    assert sorted(hits(spark, docs, items)) == once and len(once) == 18

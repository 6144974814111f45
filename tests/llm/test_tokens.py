import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specsift.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.FOLDER), reason="no vocabulary files")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=300))
def test_equals_library(library, text):
    assert tokens.load(tokens.FOLDER, "byte_bpe_50k").encode(text) == library(text)


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="abeé=-", min_size=1, max_size=12), st.integers(9_000, 20_000))
def test_long_runs_equal_library(library, unit, length):
    text = (unit * (length // len(unit) + 1))[:length] + "  end"
    assert tokens.load(tokens.FOLDER, "byte_bpe_50k").encode(text) == library(text)


def test_joins_of_small_leaves(library, monkeypatch):
    monkeypatch.setattr(tokens, "LEAF", 7)
    monkeypatch.setattr(tokens, "LONG_TEXT", 10)
    b = tokens.load(tokens.FOLDER, "byte_bpe_50k")
    for text in ("internationalisation" * 9, "aaaaaaaaab" * 30, "зачемзачем" * 12):
        assert b.encode(text) == library(text)


def test_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a <|endoftext|> b", "x"), (3, "a <|endoftext|> b", "y"), (4, "q" * 300_000 + " é", "z")]
    got = [(r.doc_id, r.ids) for r in tokens.ids(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()]
    assert sorted(got) == sorted((k, library(t) if t else []) for k, t, _ in rows)
    assert tokens.ids(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0

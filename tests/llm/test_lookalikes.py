import pytest

from specsift.llm import lookalikes as K


def found(spark, pages, stories=()):
    p = spark.createDataFrame([(k, t, "x", 1) for k, t in pages], "page_id bigint, raw_text string, tbl string, word int")
    s = spark.createDataFrame(list(stories), "story_uid bigint, raw_text string")
    return {(r.tbl, r.row_id) for r in K.found(p, s).collect()}


@pytest.mark.parametrize("text", ["10 µs, m², ΔV ≤ 3…", "Γ/Ω φf", "требование", "👩‍💻 “quotes” – dash", "café", "", "plain"])
def test_ordinary_text_is_no_case(spark, text):
    assert found(spark, [(1, text)]) == set()


@pytest.mark.parametrize(("text", "plain"), [("ｗｏｒｄ １２", "word 12"), ("per​mit", "permit"), ("the end", "the end"), ("ﬁeld", "field"), ("café", "café"), ("сontract", "contract"), ("rule﻿", "rule"), ("non‑stop", "non-stop")])
def test_cases_and_their_form(spark, text, plain):
    pages = [(1, text), (2, plain)]  # the corpus holds the word
    assert found(spark, pages) == {("raw_pages", 1)}
    p = spark.createDataFrame(pages, "page_id bigint, raw_text string")
    s = spark.createDataFrame([], "story_uid bigint, raw_text string")
    assert {r.text for r in K.canonical(p, s).collect()} == {plain}


@pytest.mark.parametrize("token", ["nо", "сontract", "з\u0061дача", "λ\u006fγος"])
def test_tokens_of_any_length_need_the_vocabulary(spark, token):
    assert found(spark, [(1, token + " x")]) == set()


def test_a_half_at_a_line_end_is_known_by_its_whole(spark):
    assert found(spark, [(1, "the сont-\nract ends"), (2, "a contract")]) == {("raw_pages", 1)}
    assert found(spark, [(1, "the cont\u00ad\nrасt ends"), (2, "a contract"), (3, "cont-\nrасk")]) == {("raw_pages", 1)}
    assert found(spark, [(1, "сont-\nract ends"), (2, "contrac")]) == set()


def test_short_tokens_need_the_vocabulary(spark):
    assert found(spark, [(1, "nо x")]) == set()
    assert found(spark, [(1, "nо x"), (2, "no y")]) == {("raw_pages", 1)}


def test_garbled_pages_are_left_out_but_stories_are_not(spark):
    assert found(spark, [(1, "ｗｏｒｄ â€œxâ€\u009d")], [(2, "ｗ"), (3, None)]) == {("user_stories", 2)}


def test_edge_rows(spark):
    assert found(spark, [(1, None), (2, ""), (3, "ｗ " * 50_000), (3, "ｗ")]) == {("raw_pages", 3)}
    assert found(spark, []) == set()


@pytest.mark.parametrize(("text", "plain"), [("з\u0061дача", "задача"), ("требов\u0061ние", "требование"), ("λ\u006fγος", "λογος"), ("т\u0061к x", None), ("ΔV φf Δx", None), ("\u0441ontract", "contract")])
def test_native_words_get_their_own_letters(spark, text, plain):
    pages = [(1, text), (2, plain or "")]  # the corpus holds the word
    p = spark.createDataFrame(pages, "page_id bigint, raw_text string")
    s = spark.createDataFrame([], "story_uid bigint, raw_text string")
    assert found(spark, pages) == ({("raw_pages", 1)} if plain else set())
    assert {r.row_id: r.text for r in K.canonical(p, s).collect()} == {1: plain or text, 2: plain or ""}


def test_native_words_are_looked_up(spark):
    pages = [(1, "т\u0061к"), (2, "так"), (3, "рос\u0061"), (4, "роса"), (5, "\u0430\u0441\u0441\u0435ss"), (6, "access")]
    assert found(spark, pages) == {("raw_pages", 1), ("raw_pages", 3), ("raw_pages", 5)}
    p = spark.createDataFrame(pages, "page_id bigint, raw_text string")
    s = spark.createDataFrame([], "story_uid bigint, raw_text string")
    assert {r.row_id: r.text for r in K.canonical(p, s).collect()} == {1: "так", 2: "так", 3: "роса", 4: "роса", 5: "access", 6: "access"}

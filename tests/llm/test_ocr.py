import pytest

from specsift.llm import ocr
from specsift.llm.perceptron import Editor, Perceptron, noises

BODY = ["The operator shall confirm the document before the machine starts", "Every channel carries a current that exceeds the threshold value", "The budget covers manual ledgers and anything beyond needs consent"]
SCHEMA = "page_id bigint, doc_id string, page_num int, raw_text string, extraction_method string, line string, h int"
CLEAN = "page_id bigint, doc_id string, page_num int, cleaned_text string, removed_elements array<string>"


def tables(spark, noisy):
    rows = [(i, "d", i, "\n".join(["Crane System - Requirements", *BODY, *BODY, *BODY, *BODY, "end-to-end tests run off-line today.", f"- {i} -"]), "digital") for i in range(1, 9)]
    rows += [(100 + k, "d", 20 + k, t, m) for k, (t, m) in enumerate(noisy)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), spark.createDataFrame([(100, "d", 20, "The machlne\nexceecls it", [])], CLEAN)


@pytest.fixture(scope="module")
def result(spark):
    filler = "\n".join(BODY * 3)
    head = "Crane System - Requirements"
    noisy = [
        (f"{head}\n{filler}\nThe clocument needs con-\nsent and an end-\nto-end mach ine.\nThe 0perator wh0 can.\n- 20 -", "ocr_a"), (f"{head}\n{filler}\nMeter count\n685", "ocr_a"), (None, "ocr_a"), ("", "ocr_a"),
        (f"{head}\n{filler}\nthe thr¬\nesh0ld value \nPage 25 of 30", "ocr_b"), ("The clocument", None),
    ]
    raw, cleaned = tables(spark, noisy)
    return {tuple(r) for r in ocr.found(raw, cleaned).collect()}


def test_words(result):
    at = {(p, n, k) for t, p, n, k in result if t == "raw_pages" and k in ("hyphen", "misread")}
    assert at == {(100, 11, "misread"), (100, 11, "hyphen"), (100, 13, "misread"), (100, 14, "misread"), (104, 11, "hyphen"), (104, 12, "misread")}


def test_furniture(result):
    at = {(p, n, k) for t, p, n, k in result if t == "raw_pages" and k in ("header", "page_number")}
    assert at == {(100, 1, "header"), (101, 1, "header"), (104, 1, "header"), (100, 15, "page_number"), (104, 13, "page_number")}


def test_cleaned_lines(result):
    assert {x[1:] for x in result if x[0] == "cleaned_pages"} == {(100, 2, "misread")}


def test_paragraphs(spark):
    raw, _ = tables(spark, [("- 20 -\nThe clocument needs con-\nsent and the mach ine.\n\n• The budget\n  covers it.", "ocr_a"), (None, "ocr")])
    out = {r.page_id: r.text for r in ocr.paragraphs(raw).collect()}
    assert out == {100: "The document needs consent and the machine.\n\n• The budget covers it.", 101: None}


def test_without_scans_or_pages(spark):
    raw, cleaned = tables(spark, [])
    assert ocr.found(raw, cleaned).count() == 0
    assert ocr.found(raw.limit(0), cleaned.limit(0)).count() == 0


def test_large_vocabulary_path_gives_the_same(spark, result, monkeypatch):
    monkeypatch.setattr(ocr, "KNOWN_WORDS", 0)
    filler = "\n".join(BODY * 3)
    raw, cleaned = tables(spark, [(f"{filler}\nThe clocument needs con-\nsent and an end-\nto-end mach ine.", "ocr_a")])
    at = {tuple(r)[2:] for r in ocr.found(raw, cleaned).collect() if r.tbl == "raw_pages" and r.kind in ("hyphen", "misread")}
    assert at == {(10, "misread"), (10, "hyphen"), (12, "misread")}


def test_both_paths_judge_gaps_and_marks_alike(spark, monkeypatch):
    words = sorted({w.lower() for line in BODY for w in line.split() if len(w) > 4})
    text = "\n".join([*BODY * 3, *(f"{w} {x}" for w in words for x in ("i", "1", "l", "r", "rn", "t")), *(f"{w}{x}" for w in words for x in ("!", "!!", "l")), "a nyth1ng", "a nything", "a nythlng"])
    raw, cleaned = tables(spark, [(text, "ocr_a")])
    with_words = {tuple(r) for r in ocr.judged(raw, cleaned).collect()}
    monkeypatch.setattr(ocr, "KNOWN_WORDS", 0)
    assert {tuple(r) for r in ocr.judged(raw, cleaned).collect()} == with_words


def test_editor_restores_held_out_noise():
    words = ["document", "machine", "operator", "threshold", "channel", "current", "ledger", "consent", "manual", "value"]
    e = Editor(words)
    for read, word in (("clocument", "document"), ("mach!ne", "machine"), ("0perator", "operator"), ("fhreshold", "threshold"), ("charinel", "channel"), ("cnrrent", None), ("1edger", "ledger"), ("rnanual", "manual")):
        got = [w for w, _, _ in e.propose(read) if w in words and noises(w, read, 2)]
        assert got[:1] == ([word] if word else [])


def test_perceptron_separates():
    p = Perceptron().fit([(["a", "x"], 1, (0, 1)), (["b", "x"], 0, (0, 1))] * 5)
    assert p.score(["a", "x"], 1) > p.score(["a", "x"], 0) and p.score(["b", "x"], 0) > p.score(["b", "x"], 1)

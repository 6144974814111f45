import pytest
from pyspark.sql import functions as F

from specsift.llm import encoding, encoding_pages
from specsift.llm.encoding import CHAINS, Garble, Repair, garble, invert

SOUND = ["The café costs €5 – naïve ‘quotes’ and “more”.", "0.5·μ·Cox·(W/L)·(Vgs − Vth)² ≤ 3 °C", "требование и задача", "MANHÃ", "ΔV and Γ/Ω", "10 °C", "", "plain", "x &ldquo;y&rdquo; &amp; z"]
TEXT = "• the clerk’s “café” costs €5 – cm²/(V·s) ≤ 3 naïve"


@pytest.fixture(scope="module")
def repair():
    return Repair()


@pytest.mark.parametrize("text", SOUND)
def test_sound_text_stays(repair, text):
    assert repair.text(text) == (text, False)


@pytest.mark.parametrize("chain", [c for c in CHAINS if c[0] in ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac-roman")])
def test_round_trip_of_every_chain(repair, chain):
    assert invert(garble(TEXT, chain), chain) == TEXT
    fixed, bad = repair.text(garble(TEXT, chain))
    assert bad and fixed == TEXT


def test_partly_garbled_page(repair):
    page = "• sound line\n" + garble("• the clerk’s line", ("cp1252",)) + "\nlast"
    assert repair.text(page) == ("• sound line\n• the clerk’s line\nlast", True)


def test_dropped_byte_entities_and_losses(repair):
    assert repair.text("shows â€œstaleâ€ now") == ("shows “stale” now", True)
    assert repair.text("20 &Acirc;&deg;C") == ("20 °C", True)
    assert repair.text("M�len desk")[1]


def test_held_out_accuracy():
    model = Garble(seed=99)
    right = total = 0
    for word in ["“quoted”", "naïveté", "μ-coefficient", "clerk’s", "Größe", "требования"]:
        for k, chain in enumerate(CHAINS[:5]):
            scores = model.scores(" " + garble(word, chain) + " ")
            right += invert(garble(word, chain), CHAINS[int(scores[: len(CHAINS)].argmax())]) == word
            total += 1
    assert right / total >= 0.9


def test_edge_rows(spark):
    schema = "page_id bigint, raw_text string, tbl string, garbled int"
    raw = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (3, "Â°C " * 20_000, "x", 1), (3, "Â°C", "x", 1)], schema)
    cleaned = raw.withColumnRenamed("raw_text", "cleaned_text").limit(0)
    assert {(r.tbl, r.page_id) for r in encoding_pages.found(raw, cleaned).collect()} == {("raw_pages", 3)}
    out = {r.page_id: r.text for r in encoding_pages.restored(raw.where("length(raw_text) < 9 or raw_text is null"), cleaned).collect()}
    assert out == {1: None, 2: "", 3: "°C"}
    assert encoding_pages.found(raw.limit(0), cleaned).count() == 0


def test_lost_characters_come_back_by_context(spark):
    pages = [(k, f"the clerk’s consent {k}; costs €{k}50 now") for k in range(5)] + [(9, "the clerk\ufffds consent 7; costs \ufffd950 now, \ufffdx")]
    raw = spark.createDataFrame(pages, "page_id bigint, raw_text string")
    cleaned = spark.createDataFrame([], "page_id bigint, cleaned_text string")
    out = {r.page_id: (r.text, r.garbled) for r in encoding_pages.restored(raw, cleaned).collect()}
    assert out[9] == ("the clerk’s consent 7; costs €950 now, \ufffdx", True) and out[0] == (pages[0][1], False)


def test_cache_gives_same_answer():
    a, b = Repair(), Repair()
    lines = [garble(TEXT, ("cp1252",)), TEXT] * 2
    assert [a.line(x) for x in lines] == [b.line(x) for x in reversed(lines)][::-1]
    assert encoding.RUN.search(F.__name__) is None


def test_records_teach_what_the_inventory_lacks():
    lines = ["пояснение к смете", "Prüfstände für Öfen", "λόγος και έργο", "l’œuvre – déjà vu", "señales añadidas", "±12 µm at 5 °C", "zażółć gęślą jaźń"]
    contexts = tuple(sorted({m for x in lines for m in encoding_pages.re.findall(encoding_pages.CONTEXT_RUN, x)}))
    taught = Repair(model=Garble(records=contexts, seen=contexts))
    held_out = ["к пояснению сметы", "für Prüfer", "και λόγος", "déjà – l’eau", "añadidas ±9 °C"]
    restored = [taught.text(garble(x, c)) == (x, True) for x in held_out for c in CHAINS]
    assert sum(restored) / len(restored) >= 0.95
    assert all(taught.text(x) == (x, False) for x in [*lines, *held_out])


def test_sound_runs_are_told_from_garbled_ones():
    assert encoding.sound("’") and encoding.sound("ü") and not encoding.sound("Ã©") and not encoding.sound("x�") and not encoding.sound("é" + garble("’", ("cp1252",)))

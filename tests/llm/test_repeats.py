from specsift.llm import repeats

SCHEMA = "page_id bigint, doc_id string, page_num int, raw_text string, font_metadata array<struct<text:string,font_size:double>>, place string, h1 int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(rows):
    def key(x):
        return "".join(c for c in (x or "").lower() if c.isalpha())

    out, pages = set(), {}
    for place in ("raw_text", "font_metadata"):
        seen = {}
        every = []
        for p, d, n, t, f in rows:
            pages.setdefault(d, set()).add(n)
            items = ((t or "").split("\n") if t is not None else []) if place == "raw_text" else [x[0] for x in f or []]
            for i, x in enumerate(items, 1):
                if len(key(x)) >= 3:
                    every.append((p, d, i, key(x)))
                    seen.setdefault((d, key(x)), set()).add(n)
        out |= {(p, place, i) for p, d, i, k in every if len(seen[d, k]) >= 5 and 5 * len(seen[d, k]) >= len(pages[d])}
    return out


def test_equals_brute_force(spark):
    rows = [(i, "d" if i % 3 else None, i % 23, f"Head  {i}!\nbody {'abc' if i % 2 else 'x' * (i % 9)}\n{i}\n\nSHARE, this?", [("Notice " + str(i), 1.0), (None, 2.0)] if i % 4 else None) for i in range(80)]
    rows += [(200, "e", 1, None, None), (201, "e", 1, "", []), (202, "d", 1, "Head 1", None)]
    got = {tuple(r) for r in repeats.found(frame(spark, rows)).collect()}
    assert got == brute(rows) and len(got) > 50


def test_cleaned_pages(spark):
    rows = [(i, "d", i, f"Top {i}\nline {'z' * i}", None) for i in range(1, 7)] + [(9, "d", 9, None, None)]
    out = {r.page_id: (r.text, r.removed) for r in repeats.cleaned(frame(spark, rows)).collect()}
    assert out[1] == ("line z", 1) and out[9] == (None, 0)


def test_what_tells_lines_apart(spark):
    forms = ["Total – m\u200bade", "total made", "TOTAL_made 7", "Total: made!", "to\u0301tal made"]
    rows = [(i, "d", i, x, None) for i, x in enumerate(forms, 1)] + [(10 + i, "d", 10 + i, x, None) for i, x in enumerate(["total made²"] * 4 + ["total made ½"])]
    assert {r.page_id for r in repeats.found(frame(spark, rows)).collect()} == {1, 2, 3, 4, 5}
    assert repeats.found(frame(spark, [(i, "d", i, "a² b½", None) for i in range(9)])).count() == 0


def test_cleaned_blocks(spark):
    rows = [(i, "d", i, f"line {'z' * i}", [("Top notice", 1.0), ("own " + "y" * i, 2.0), (None, 1.0)]) for i in range(1, 7)] + [(9, "d", 9, "x", None)]
    out = {r.page_id: (r.text, r.removed, r.blocks, r.removed_blocks) for r in repeats.cleaned(frame(spark, rows)).collect()}
    assert out[1] == ("line z", 0, ["own y", None], 1) and out[9] == ("x", 0, None, 0)


def test_empty(spark):
    assert repeats.found(frame(spark, [])).count() == 0

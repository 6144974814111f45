from specsift.llm import truncation as X

WHOLE = "The budget covers all meters. The clerk confirms the order on a form. Nobody could say why it failed."


def frame(spark, rows):
    return spark.createDataFrame([(k, t, s, "x") for k, t, s in rows], "doc_id bigint, text string, source string, word string")


def cut(spark, *texts):
    rows = [(100 + i, WHOLE + f" It was agreed that part {i} stays.", "s") for i in range(3)]
    got = {r.doc_id for r in X.found(frame(spark, [*rows, *((k, t, "s") for k, t in enumerate(texts))])).collect()}
    return [k in got for k in range(len(texts))]


def test_endings(spark):
    assert cut(
        spark, WHOLE, WHOLE + " The clerk confi", WHOLE + " The clerk confi…", WHOLE + " The clerk [...]", WHOLE + "\nThe list goes on and on…", WHOLE + "\n- check meters", WHOLE + "\n- check met", WHOLE + "\n| a | b |", WHOLE + "\n| a | b",
        WHOLE + "\nRegards,\nThe Order meters", WHOLE + "\nref. KX-7", WHOLE + "\nStatus: confirms", WHOLE + " “It failed.”", WHOLE + "\nThe clerk conf�", WHOLE + "\nTh",
    ) == [False, True, True, True, False, False, True, False, True, False, False, False, False, True, True]


def test_limits_by_measure(spark):
    rows = [(i, ("é" * (i % 7) + "a" * 200)[: 100 - (i % 7)] if i % 2 else "b" * (50 + i % 40), "bytes") for i in range(100)]
    got = {(r.source, r.measure, r.limit_length) for r in X.limits(frame(spark, rows)).collect()}
    assert ("bytes", "utf8", 100) in got


def test_rates(spark):
    rows = [(1, WHOLE, None), (2, WHOLE + " The clerk confi", None), (3, None, "t"), (2, WHOLE + " The clerk confi", None)]
    got = {r.source: (r.texts, r.cut_texts) for r in X.sources(frame(spark, rows)).collect()}
    assert got == {None: (3, 2), "t": (1, 0)}


def test_edge_rows(spark):
    assert cut(spark, None, "", " \n\t", "x. " * 100_000, "日本語。") == [False] * 5
    assert X.found(frame(spark, [])).count() == 0


def test_every_limit_of_a_source_and_what_told(spark):
    filler = [(i, WHOLE + " It was agreed" + " again" * (i % 90) + f" that part {i} stays.", "two") for i in range(300)]
    at = [(1000 + 100 * size + k, (f"Number {k} of them was then agreed and " + "filed and " * 60)[:size], "two") for size in (150, 240) for k in range(9)]
    whole = [(5000 + k, f"Part {k} " + "x" * (142 - len(str(k)) - 1) + "s.", "two") for k in range(2)]
    assert all(len(t) == 150 for _, t, _ in [*at[:9]])
    df = frame(spark, [*filler, *at, *whole])
    got = {(r.measure, r.limit_length) for r in X.limits(df).where("measure = 'characters'").collect()}
    assert {("characters", 150), ("characters", 240)} <= got
    told = {r.doc_id: r.step for r in X.steps(df).collect()}
    assert all(told[k] == "limit" for k, t, _ in at if not t.endswith(" "))
    assert not told.keys() & {k for k, _, _ in [*filler, *whole]}


def test_a_sentence_start_behind_many_signs(spark):
    rows = [(1, ("- " * 40) + "Nobody could say why it failed.", "s"), (2, WHOLE + "\nThe clerk confirms.", "s"), (3, WHOLE + "\nNobody could say why", "s"), (4, WHOLE + "\nThe say why form", "s")]
    assert {r.doc_id for r in X.found(frame(spark, rows)).collect()} == {3}


def test_a_text_does_not_vouch_for_its_own_last_word(spark):
    assert cut(spark, WHOLE + "\n- check met\n \t \n", WHOLE + "\n- check meters\n ") == [True, False]

import json

import pytest

from specsift.operators import nested


def test_depth_beyond_the_interpreters_recursion(spark):
    n = 3000
    deep = '{"text": "x", "children": [' * n + '{"text": "y"}' + "]}" * n
    other = "[" * 200_000 + "]" * 200_000
    rows = [(1, f'[{{"id": "a", "acceptance_criteria": {deep}}}]'), (2, json.dumps(f'[{{"acceptance_criteria": {deep}}}]')), (3, f'[{{"id": "b", "goal": {other}}}]'), (4, f'[{{"acceptance_criteria": {deep[:-1]}}}]')]
    df = spark.createDataFrame(rows, "model_id bigint, user_stories string")
    assert {r.model_id: r["count"] for r in nested.links(df).groupBy("model_id").count().collect()} == {1: n + 2, 2: n + 2, 3: 1}
    assert {r.model_id: len(r.goal) for r in nested.stories(nested.tagged(df.where("model_id = 3"))).collect()} == {3: 400_000}


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, {"b": "x\\n\\u00e9", "c": null}], "d": {}, "e": []}', " [true , false] ", '"x"', "3", '{"a": 1, "a": 2}'])
def test_both_parsers_agree(text):
    value = json.loads(text)
    assert nested._deep(text) == value


@pytest.mark.parametrize("text", ["", "[1,]", '{"a": 1,}', "[1 2]", "{1: 2}", "[NaN]", "[] x", "[01]", '{"a"}', "[", '["a\n"]'])
def test_both_parsers_refuse(text):
    for parse in (nested._loads, nested._deep):
        with pytest.raises(ValueError):
            parse(text)

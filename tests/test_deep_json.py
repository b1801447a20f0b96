import json

import pytest

from foliant.operators import nested


def test_deep_nesting_is_entered():
    deep = "[" * 50_000 + '{"toto_number": "A", "x": [1, "é", null]}' + "]" * 50_000
    nodes = nested.nodes_of(deep, "toto_number")
    assert len(nodes) == 50_002 and [n[5] for n in nodes if n[5] >= 0] == [0]
    wrapped = nested.nodes_of(json.dumps({"a": deep}), "toto_number")
    assert len(wrapped) == 50_003 and [n[5] for n in wrapped if n[5] >= 0] == [0]
    assert [n[1] for n in nested.nodes_of(deep[:-1], "toto_number")] == ["text"]


@pytest.mark.parametrize("text", ['{"a": [1, 2.50, -3e2, "x\\u00e9", true, false, null, {}], "a": {"b": []}}', "[]", " 1 ", '"s"', "[NaN, -Infinity]", '{"a":1}'])
def test_deep_parser_gives_the_same(text):
    assert repr(nested._parse_deep(text)) == repr(nested._parse(text))


@pytest.mark.parametrize("text", ["", "[1 2]", "{1: 2}", '{"a" 1}', "[1,]", "[1] 2", '{"a":1,}', "[", "tru"])
def test_deep_parser_rejects_the_same(text):
    for parse in (nested._parse, nested._parse_deep):
        with pytest.raises(ValueError):
            parse(text)

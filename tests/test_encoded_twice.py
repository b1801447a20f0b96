import json

from foliant.operators import nested


def test_json_that_is_encoded_twice_is_entered():
    twice = json.dumps(json.dumps({"code": "a"}))
    for text in (json.dumps({"items": [twice, '"plain"', '"[no json"', '"7"']}), json.dumps(twice)):
        assert [n[5] for n in nested.nodes_of(text, "code") if n[5] >= 0] == [0]

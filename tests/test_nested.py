import json

from pyspark.sql import functions as F

from foliant.operators import nested


def items(text):
    return [(n[6], n[5]) for n in nested.nodes_of(text, "code") if n[5] >= 0]


def test_items_are_numbered_as_they_begin():
    text = '{"b": [{"code": 1, "parts": [{"code": null}]}, null, 5], "a": {"x": {"code": "z"}}}'
    assert items(text) == [(-1, 0), (0, 1), (-1, 2)]


def test_strings_that_hold_json_are_entered():
    text = json.dumps({"items": json.dumps([{"code": "a", "in": json.dumps({"code": "b"})}]), "note": "[not json"})
    assert items(text) == [(-1, 0), (0, 1)]


def test_equal_subtrees_have_one_identity():
    nodes = nested.nodes_of('[{"a": 1, "b": 2.50}, {"b": 2.5, "a": 1.0}, {"a": 1, "b": 3}]')
    assert nodes[1][7] == nodes[2][7] != nodes[3][7]


def test_edges():
    assert nested.nodes_of("no json")[0][1] == "text"
    assert nested.nodes_of("[" * 50_000 + "]" * 50_000)[0][1] in ("text", "array")
    assert nested.nodes_of("")[0][1] == "text"
    assert len(nested.nodes_of('{"a": {}, "a": {}}')) == 3
    assert nested.nodes_of("9" * 5000)[0][1] == "text"


def test_json_nodes_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, '{"code": 1}', "y"), (None, "[]", "z")], "id long, doc string, identity string")
    rows = {(r.rec_id, r.kind, r.item_no) for r in nested.json_nodes(df, "id", "doc", "code").collect()}
    assert rows == {(2, "object", 0), (None, "array", -1)}
    assert nested.json_nodes(df.limit(0), "id", "doc").count() == 0


def test_page_parts_keep_their_place(spark):
    kind = "page_id long, blocks array<struct<content:string>>, page_tables array<struct<table_id:string,page_index:int,cells:array<struct<text:string>>,confidence:double>>"
    pages = spark.createDataFrame([(1, [("a",), None, ("a",)], [None, ("t", 0, [("x",), None, ("y",)], 0.5)]), (2, None, [])], kind)
    blocks = nested.page_blocks(pages).orderBy("inner_pos").collect()
    assert [b.inner_pos for b in blocks] == [0, 2] and blocks[0].identity == blocks[1].identity
    assert [(c.outer_pos, c.inner_pos) for c in nested.page_cells(pages).orderBy("inner_pos").collect()] == [(1, 0), (1, 2)]
    assert nested.page_tables(pages).select(F.count("*")).first()[0] == 1

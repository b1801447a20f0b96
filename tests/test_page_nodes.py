from foliant.operators import nested
from foliant.plans import nested_queries

KIND = "page_id long, blocks array<struct<content:string>>, page_tables array<struct<table_id:string,page_index:int,cells:array<struct<text:string>>,confidence:double>>"


def test_pages_are_in_store_and_bridge(spark, tmp_path):
    tables = [None, ("t", 0, [("x",), None, ("y",)], 0.5)]
    pages = spark.createDataFrame([(1, [("a",), None, ("a",)], tables), (2, None, []), (3, [("b",)], tables), (1, [("a",), None, ("a",)], tables), (4, None, None)], KIND)
    pages.write.parquet(f"{tmp_path}/ocr_pages.parquet")
    spark.createDataFrame([(1, '{"toto_number": 1}')], "extraction_id long, data_json string").write.parquet(f"{tmp_path}/extractions.parquet")
    bridge = [r for r in nested_queries.p1_bridge(spark, str(tmp_path)).collect() if r.src == "page"]
    by_no = {(r.rec_id, r.node_no): r for r in bridge}
    assert len(by_no) == len(bridge) == 6 + 1 + 5 + 1
    for r in bridge:
        assert (r.parent_no == -1) == (r.entry_key is None) and (r.parent_no == -1 or (r.rec_id, r.parent_no) in by_no)
        assert r.entry_key != "cells" or by_no[r.rec_id, r.parent_no].entry_key == "page_tables"
    ids = {(r.rec_id, r.entry_key, r.ordinal): r.identity for r in bridge}
    assert ids[1, "page_tables", 1] == ids[3, "page_tables", 1] and ids[1, None, 0] != ids[3, None, 0] and ids[2, None, 0] == ids[4, None, 0]
    objects = {r.identity: r for r in nested_queries.p1_objects(spark, str(tmp_path)).collect()}
    assert set(ids.values()) <= set(objects) and ids[1, "cells", 2] in objects[ids[1, "page_tables", 1]].body
    found = {tuple(r) for r in nested_queries.p1_found(spark, str(tmp_path)).collect()}
    assert found == {("block", 1, -1, 0), ("block", 1, -1, 2), ("block", 3, -1, 0), ("item", 1, -1, 0), *(("cell", p, 1, i) for p in (1, 3) for i in (0, 2))}
    assert nested.page_nodes(pages.limit(0)).count() == 0

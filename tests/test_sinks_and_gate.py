import json

from foliant.operators import textlayer
from foliant.sinks import artifacts


def test_artifacts(spark, tmp_path):
    rows = [("a/b.pdf", "# Größe", '{"x": "é"}'), ("q?.pdf", "one", "no json"), ("q.pdf", "two", None), ("e.pdf", "", '[]'), (None, "x", "{}"), ("n.pdf", None, "{}")]
    df = spark.createDataFrame(rows, "name string, md string, j string")
    for _ in range(2):
        artifacts.save_markdown(df, "name", "md", str(tmp_path))
        artifacts.save_json(df, "name", "j", str(tmp_path))
    files = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    changed = next(f for f in files if f.startswith("q-")).split("/")[0]
    assert files["b/b.md"] == "# Größe" and files["b/b.json"] == json.dumps({"x": "é"}, indent=2, ensure_ascii=False)
    assert files["q/q.md"] == "two" and files[f"{changed}/q.md"] == "one" and files[f"{changed}/q.json"] == '"no json"'
    assert set(files) == {"b/b.md", "b/b.json", "q/q.md", f"{changed}/q.md", f"{changed}/q.json", "e/e.json", "n/n.json"}


def test_text_layer(spark):
    good = "the order is due at the northern gate of the works today " * 2
    pages = [("a", 1, good), ("a", 0, good), ("b", 0, good), ("b", 1, "short"), ("c", 0, None), ("d", 0, "a1bc " * 60), ("e", 0, "\ufffd" * 90 + "ab"), ("f", 0, good[:39].replace(" ", "x"))]
    df = spark.createDataFrame(pages, "doc string, page int, t string")
    out = {r.doc: r for r in textlayer.judge(df, "doc", "page", "t").collect()}
    assert {k: r.usable for k, r in out.items()} == {"a": True, "b": False, "c": False, "d": False, "e": False, "f": False}
    assert out["a"].text == good * 2 and out["a"].pages == 2 and out["c"].chars == 0
    assert textlayer.judge(df.limit(0), "doc", "page", "t").count() == 0

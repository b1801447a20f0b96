"""Deeply nested records as flat, related tables.

Every object and array of a record becomes a node. Nodes are hashed bottom-up over a canonical form (sorted keys,
normalised numbers, children by their hash), so equal subtrees have equal identities wherever they occur. The
``objects`` table stores each identity once; the ``bridge`` rows keep every occurrence with its parent and ordinals.

Defined results: a null document has no nodes; a text that is no JSON is one ``text`` node; any depth is entered; null elements are no nodes but keep their ordinal; repeated keys are all kept; a string
that itself holds a JSON object or array is entered as that object or array.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from hashlib import blake2b
from json.decoder import scanstring
from json.scanner import NUMBER_RE

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "rec_id bigint, node_no int, parent_no int, kind string, entry_key string, ordinal int, encoded boolean, "
    "item_no int, outer_item int, identity string, body string"
)


class _Pairs(list):
    """The members of a JSON object in the order in which they stand, repeated keys included."""


class _Number(str):
    """A JSON number in canonical form."""


def _number(raw: str) -> _Number:
    if len(raw) > 28:  # beyond the precision of Decimal's context
        return _Number(raw)
    try:
        value = Decimal(raw)
    except InvalidOperation:
        return _Number(raw)
    return _Number(str(value.normalize()) if value else "0")


def _parse(text: str):
    try:
        return json.loads(text, object_pairs_hook=_Pairs, parse_int=_number, parse_float=_number)
    except RecursionError:
        return _parse_deep(text)


_BLANKS = re.compile(r"[ \t\n\r]*")
_PLAIN = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def _parse_deep(text: str):
    """What ``_parse`` gives, with the open objects and arrays in a list instead of on the call stack: for any depth."""

    def skip(at: int) -> int:
        return _BLANKS.match(text, at).end()

    def scalar(at: int) -> tuple:
        if text[at : at + 1] == '"':
            return scanstring(text, at + 1, True)
        for name, value in _PLAIN.items():
            if text.startswith(name, at):
                return value, at + len(name)
        number = NUMBER_RE.match(text, at)
        if number is None:
            raise ValueError(f"no JSON value at {at}")
        return _number(number.group()), number.end()

    def key(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError(f"no key at {at}")
        name, at = scanstring(text, at + 1, True)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise ValueError(f"no colon at {at}")
        return name, skip(at + 1)

    held: list[tuple[list, str | None]] = []
    at = skip(0)
    while True:
        if text[at : at + 1] in ("{", "["):
            is_object = text[at] == "{"
            value, at = _Pairs() if is_object else [], skip(at + 1)
            if text[at : at + 1] != ("}" if is_object else "]"):
                name, at = key(at) if is_object else (None, at)
                held.append((value, name))
                continue
            at += 1
        else:
            value, at = scalar(at)
        while True:  # a value has ended: what holds it goes on or ends too
            at = skip(at)
            if not held:
                if at < len(text):
                    raise ValueError(f"more than one JSON value at {at}")
                return value
            holder, name = held.pop()
            is_object = isinstance(holder, _Pairs)
            holder.append((name, value) if is_object else value)
            if text[at : at + 1] == ",":
                name, at = key(skip(at + 1)) if is_object else (None, skip(at + 1))
                held.append((holder, name))
                break
            if text[at : at + 1] != ("}" if is_object else "]"):
                raise ValueError(f"neither comma nor end at {at}")
            value, at = holder, at + 1


def _embedded(text: str):
    """The object or array that a string holds as JSON, however often encoded, else None."""
    while isinstance(text, str) and not isinstance(text, _Number):
        if text.lstrip("\ufeff \t\r\n")[:1] not in ("{", "[", '"'):
            return None
        try:
            text = _parse(text.strip("\ufeff \t\r\n"))
        except ValueError:
            return None
    return text if isinstance(text, list) else None


def nodes_of(text: str, item_key: str | None = None) -> list[list]:
    """The nodes of one document in the order in which they begin: [parent_no, kind, key, ordinal, encoded,
    item_no, outer_item, identity, body]. The item number of a node that is no item is -1."""
    try:
        root = _parse(text)
    except ValueError:
        root = text
    encoded = False
    if isinstance(root, str) and not isinstance(root, _Number) and (inner := _embedded(root)) is not None:
        root, encoded = inner, True
    if not isinstance(root, list):
        body = json.dumps(root, ensure_ascii=False)
        return [[-1, "text", None, 0, False, -1, -1, _digest("text", body), body]]
    nodes: list[list] = []
    members: list[list] = []
    items = 0
    todo = [(root, -1, None, 0, encoded, -1)]
    while todo:
        value, parent, key, ordinal, encoded, outer = todo.pop()
        number = len(nodes)
        is_object = isinstance(value, _Pairs)
        item = -1
        if is_object and item_key is not None and any(k == item_key for k, _ in value):
            item, items = items, items + 1
        if parent >= 0:
            members[parent].append((key, ordinal, number))
        nodes.append([parent, "object" if is_object else "array", key, ordinal, encoded, item, outer, None, None])
        own: list = []
        members.append(own)
        inside = item if item >= 0 else outer
        nested = []
        for at, entry in enumerate(value):
            name, child = entry if is_object else (None, entry)
            wrapped = False
            if isinstance(child, str) and not isinstance(child, _Number) and (inner := _embedded(child)) is not None:
                child, wrapped = inner, True
            if isinstance(child, list):
                nested.append((child, number, name, at, wrapped, inside))
            else:
                plain = str(child) if isinstance(child, _Number) else json.dumps(child, ensure_ascii=False)
                own.append((name, at, plain))
        todo.extend(reversed(nested))
    for number in range(len(nodes) - 1, -1, -1):  # children begin after their parent
        node, own = nodes[number], members[number]
        shown = [(k, at, f'{{"$ref":"{nodes[v][7]}"}}' if isinstance(v, int) else v) for k, at, v in own]
        if node[1] == "object":
            shown.sort(key=lambda m: (m[0], m[1]))
            body = "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{v}" for k, _, v in shown) + "}"
        else:
            shown.sort(key=lambda m: m[1])
            body = "[" + ",".join(v for _, _, v in shown) + "]"
        node[7], node[8] = _digest(node[1], body), body
    return nodes


def _digest(kind: str, body: str) -> str:
    return blake2b(f"{kind}\0{body}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def json_nodes(df: DataFrame, id_col: str, json_col: str, item_key: str | None = None, bodies: bool = True) -> DataFrame:
    """One row per object and array of each document of ``json_col``, see ``NODE_SCHEMA``.

    ``item_no`` numbers the objects that have ``item_key`` in the order in which they begin; ``outer_item`` is the
    item that directly encloses the node, or -1. ``bodies=False`` leaves ``body`` null where only links are needed.
    The order of members in the text decides the numbering, which neither Spark's JSON nor its variant type keeps;
    hence an Arrow batch function, which works on one record at a time and never shuffles.
    """

    def unnest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rec_id", "node_no", "parent_no", "kind", "entry_key", "ordinal", "encoded", "item_no", "outer_item", "identity", "body"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string()]

        def flush(columns: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for rec_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                nodes = nodes_of(text, item_key)
                columns[0].extend([rec_id] * len(nodes))
                columns[1].extend(range(len(nodes)))
                for at in range(8):
                    columns[2 + at].extend([n[at] for n in nodes])
                columns[10].extend([n[8] for n in nodes] if bodies else [None] * len(nodes))
                if len(columns[0]) >= 20_000:
                    yield flush(columns)
                    columns = [[] for _ in names]
            yield flush(columns)

    return df.select(F.col(id_col).cast("bigint"), F.col(json_col)).mapInArrow(unnest, NODE_SCHEMA)


def object_store(nodes: DataFrame) -> DataFrame:
    """Each identity once, with its canonical body and the number of its occurrences."""
    return nodes.groupBy("identity").agg(
        F.first("kind").alias("kind"), F.first("body").alias("body"), F.count(F.lit(1)).alias("occurrences")
    )


def bridge(nodes: DataFrame) -> DataFrame:
    """Every occurrence: record, node, its parent node, key and ordinal in the parent, and identity."""
    return nodes.select("rec_id", "node_no", "parent_no", "entry_key", "ordinal", "item_no", "outer_item", "identity")


def _identity(*parts: Column) -> Column:
    """Hash of a canonical form; to_json leaves null fields out, so absent and null are one."""
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, outer_pos = -1, inner_pos, identity, block): a row per non-null element of ``blocks``."""
    flat = pages.select("page_id", F.posexplode("blocks").alias("inner_pos", "block")).where(F.col("block").isNotNull())
    return flat.select("page_id", F.lit(-1).alias("outer_pos"), "inner_pos", _identity(F.lit("block"), F.to_json("block")).alias("identity"), "block")


def page_tables(pages: DataFrame) -> DataFrame:
    """(page_id, outer_pos, identity, cells, table_id, page_index, confidence): a row per non-null table. The
    identity of a table is made from those of its cells, in their order."""
    flat = pages.select("page_id", F.posexplode("page_tables").alias("outer_pos", "t")).where(F.col("t").isNotNull())
    cells = F.transform(
        F.coalesce(F.col("t.cells"), F.array()),
        lambda c: F.when(c.isNull(), F.lit("null")).otherwise(_identity(F.lit("cell"), F.to_json(c))),
    )
    own = F.to_json(F.struct(F.col("t.table_id").alias("table_id"), F.col("t.page_index").alias("page_index"), F.col("t.confidence").alias("confidence")))
    return flat.select(
        "page_id", "outer_pos", _identity(F.lit("table"), own, F.array_join(cells, ",")).alias("identity"), F.col("t.cells").alias("cells"),
        F.col("t.table_id").alias("table_id"), F.col("t.page_index").alias("page_index"), F.col("t.confidence").alias("confidence"),
    )


def page_cells(pages: DataFrame) -> DataFrame:
    """(page_id, outer_pos, inner_pos, identity, cell): a row per non-null cell of each table."""
    flat = pages.select("page_id", F.posexplode("page_tables").alias("outer_pos", "t"))
    flat = flat.select("page_id", "outer_pos", F.posexplode("t.cells").alias("inner_pos", "cell")).where(F.col("cell").isNotNull())
    return flat.select("page_id", "outer_pos", "inner_pos", _identity(F.lit("cell"), F.to_json("cell")).alias("identity"), "cell")


def page_nodes(pages: DataFrame, bodies: bool = True) -> DataFrame:
    """One row per page, block, table and cell, with the columns that ``bridge`` and ``object_store`` take. The identity
    of a table is made from those of its cells, that of a page from those of its blocks and tables; ``page_id`` and
    ``ingested_at`` are no part of it. ``item_no`` is the position in the array, ``outer_item`` that of a cell's table
    (else -1). Null elements are no nodes but keep their ordinal and node number."""
    fields = [c for c in pages.columns if c not in ("page_id", "blocks", "page_tables", "ingested_at")]

    def with_refs(own: Column, **parts: Column) -> Column:
        lists = [F.concat(F.lit(f',"{name}":['), F.array_join(F.transform(ids, lambda i: F.concat(F.lit('{"$ref":"'), i, F.lit('"}'))), ",", "null"), F.lit("]")) for name, ids in parts.items()]
        return F.concat(F.lit('{"own":'), own, *lists, F.lit("}"))

    def ids(of: Column) -> Column:
        return F.transform(of, lambda n: F.when(n.isNull(), None).otherwise(n["identity"]))

    def joined(of: Column) -> Column:
        return F.array_join(of, ",", "null")

    def node(number, parent, kind: str, key: str | None, ordinal, item, outer, identity: Column, body: Column) -> Column:
        whole = {"node_no": number, "parent_no": parent, "ordinal": ordinal, "item_no": item, "outer_item": outer}
        return F.struct(
            *((v if isinstance(v, Column) else F.lit(v)).cast("int").alias(k) for k, v in whole.items()),
            F.lit(kind).alias("kind"), F.lit(key).cast("string").alias("entry_key"), identity.alias("identity"),
            (body if bodies else F.lit(None)).cast("string").alias("body"),
        )

    def hashed(of: Column, kind: str) -> Column:
        return F.transform(F.coalesce(of, F.array()), lambda x: F.when(x.isNotNull(), F.struct(_identity(F.lit(kind), F.to_json(x)).alias("identity"), (F.to_json(x) if bodies else F.lit(None)).cast("string").alias("body"))))

    def table_of(t: Column) -> Column:
        own = F.to_json(F.struct(t["table_id"].alias("table_id"), t["page_index"].alias("page_index"), t["confidence"].alias("confidence")))
        return F.when(t.isNotNull(), F.struct(own.alias("own"), hashed(t["cells"], "cell").alias("cells")))

    def table_hashed(t: Column) -> Column:
        cells = ids(t["cells"])
        identity = _identity(F.lit("table"), t["own"], joined(cells))
        return F.when(t.isNotNull(), F.struct(identity.alias("identity"), with_refs(t["own"], cells=cells).alias("body"), t["cells"].alias("cells")))

    flat = pages.select("page_id", F.to_json(F.struct(*fields)).alias("own") if fields else F.lit("{}").alias("own"), hashed(F.col("blocks"), "block").alias("b"), F.transform(F.coalesce("page_tables", F.array()), table_of).alias("t"))
    flat = flat.withColumn("t", F.transform("t", table_hashed))
    first = F.size("b") + 1

    def number_of(at: Column) -> Column:
        return F.aggregate(F.slice("t", F.lit(1), at), first, lambda n, t: n + 1 + F.coalesce(F.size(t["cells"]), F.lit(0)))

    page = node(0, -1, "page", None, 0, -1, -1, _identity(F.lit("page"), F.col("own"), joined(ids(F.col("b"))), joined(ids(F.col("t")))), with_refs(F.col("own"), blocks=ids(F.col("b")), page_tables=ids(F.col("t"))))
    blocks = F.transform("b", lambda b, at: F.when(b.isNotNull(), node(at + 1, 0, "block", "blocks", at, at, -1, b["identity"], b["body"])))
    tables = F.transform("t", lambda t, at: F.when(t.isNotNull(), node(number_of(at), 0, "table", "page_tables", at, at, -1, t["identity"], t["body"])))
    cells = F.transform("t", lambda t, at: F.transform(F.coalesce(t["cells"], F.array()), lambda c, i: F.when(c.isNotNull(), node(number_of(at) + 1 + i, number_of(at), "cell", "cells", i, i, at, c["identity"], c["body"]))))
    nodes = flat.select("page_id", F.explode(F.concat(F.array(page), blocks, tables, F.flatten(cells))).alias("n")).where("n is not null")
    return nodes.select(F.col("page_id").alias("rec_id"), "n.node_no", "n.parent_no", "n.kind", "n.entry_key", "n.ordinal", "n.item_no", "n.outer_item", "n.identity", "n.body")

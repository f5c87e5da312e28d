import json

from conftest import rows
from pagemill.operators import flatten

CANDIDATE = "doc_id string, candidate_id string, evidence string, record_id string, dewey string"


def geometry(*ids, nested=False):
    return [{"page_idx": 0, "block": {"id": i}} if nested else {"block_id": i, "page_idx": 0, "bbox_norm": [0, 0, 1, 1]} if i else None for i in ids]


def children(spark, *evidence):
    df = spark.createDataFrame([("d", f"c{i}", e if e is None or isinstance(e, str) else json.dumps(e), "clash", "clash") for i, e in enumerate(evidence)], CANDIDATE)
    return rows(flatten.geometry_children(flatten.dewey_nodes(df.drop("record_id").withColumnRenamed("candidate_id", "record_id"), ["doc_id", "record_id"], "evidence")))


def test_forms_of_geometry(spark):
    deep = {"source_geometry": geometry("u")}
    for _ in range(7):
        deep = {"v": " " * 90 + json.dumps(deep)}
    pages = [{"page_idx": 0, "blocks": geometry("a", "b")}, {"page_idx": 1, "blocks": geometry("c")}]
    got = children(
        spark,
        {"member_geometry": geometry("a", None, "b")},
        {"member_geometry": pages},
        {"v": 2, "evidence": json.dumps({"caption_geometry": geometry("x", "x", nested=True), "source_geometry": geometry("s")[0]})},
        json.dumps(json.dumps({"source_geometry": geometry("t")})),
        deep,
        {"source_geometry": [{"block_id": "a", "block": {"id": "b"}}]},
    )
    assert got == sorted(
        [
            ("d", "c0", "member_geometry", 0, "a"), ("d", "c0", "member_geometry", 2, "b"),
            ("d", "c1", "member_geometry", 0, "a"), ("d", "c1", "member_geometry", 1, "b"), ("d", "c1", "member_geometry", 2, "c"),
            ("d", "c2", "caption_geometry", 0, "x"), ("d", "c2", "caption_geometry", 1, "x"), ("d", "c2", "source_geometry", 0, "s"),
            ("d", "c3", "source_geometry", 0, "t"), ("d", "c4", "source_geometry", 0, "u"), ("d", "c5", "source_geometry", 0, "a"), ("d", "c5", "source_geometry", 0, "b"),
        ],
        key=repr,
    )


def test_no_children(spark):
    assert children(spark, None, "", "no json", {}, {"member_geometry": []}, {"source_geometry": None}, {"member_geometry": [None, {"page_idx": 1}]}) == []


def test_labels_and_parents(spark):
    df = spark.createDataFrame([("r", '{"a": [1, {"b": null}], "c": "x"}')], "id string, j string")
    nodes = flatten.path_tables(flatten.dewey_nodes(df, ["id"], "j"), ["id"])
    got = {(r.schema_path, tuple(r.dewey)): (None if r.parent is None else tuple(r.parent), r.kind, r.value) for r in nodes.collect()}
    assert got == {
        ("", ()): (None, "object", None), ("a", (0,)): ((), "array", None), ("a[]", (0, 0)): ((0,), "number", "1"), ("a[]", (0, 1)): ((0,), "object", None),
        ("a[].b", (0, 1, 0)): ((0, 1), "null", None), ("c", (1,)): ((), "string", "x"),
    }


def test_arrays_and_repeated_rows(spark):
    groups = spark.createDataFrame([("d", "g", ["a", None, "a"]), ("d", "g", ["a", None, "a"]), ("d", "h", None), ("d", "i", [])], "doc_id string, id string, member_block_ids array<string>")
    blocks = spark.createDataFrame(
        [("d", "b", [(None,), None, ("r",)]), ("d", "e", [])], "doc_id string, id string, source_spans array<struct<region_id:string>>"
    )
    none = spark.createDataFrame([], CANDIDATE)
    assert rows(flatten.flat_children(none, blocks, groups)) == sorted(
        [("d", "b", "source_spans", 0, ""), ("d", "b", "source_spans", 2, "r"), ("d", "g", "member_block_ids", 0, "a"), ("d", "g", "member_block_ids", 2, "a")], key=repr
    )
    empty = groups.limit(0)
    assert rows(flatten.flat_children(none, blocks.limit(0), empty)) == []


def test_typed_columns_have_the_labels_of_their_json(spark):
    """The same record as a typed column and as a JSON text has the same nodes."""
    ddl = "array<struct<page:int,bbox:struct<x:double,y:double>,ids:array<string>,ok:boolean>>"
    texts = ['[{"page":1,"bbox":{"x":0.5,"y":null},"ids":["a",null],"ok":true},null,{"page":null,"bbox":null,"ids":[],"ok":null}]', "[]", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, j string").selectExpr("id", "j", f"from_json(j, '{ddl}') AS spans")
    got = rows(flatten.typed_nodes(df, ["id"], "spans"))
    want = rows(flatten.dewey_nodes(df, ["id"], "j").selectExpr("id", "dewey", "'spans' || schema_path AS schema_path", "kind", "value", "members"))
    assert got == want and len(got) == 17

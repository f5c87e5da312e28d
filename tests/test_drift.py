import json

from conftest import rows
from pagemill.operators import drift

FIELDS = [
    ("schema_version", "integer", False), ("status", "string", False), ("groups", "array", False), ("groups[].id", "string", False), ("groups[].confidence", "number", False),
    ("groups[].codes", "array of string", False), ("groups[].box", "object", False), ("groups[].box.path", "string", True), ("groups[].box.size", "number", False),
]
GROUP = {"id": "g", "confidence": 0.5, "codes": ["a"], "box": {"size": 1}}
GOOD = {"schema_version": 1, "status": "done", "groups": [GROUP]}


def report(spark, *contents):
    fields = spark.createDataFrame(FIELDS, "field string, json_type string, optional boolean")
    text = lambda c: c if c is None or isinstance(c, str) else json.dumps(c)
    files = spark.createDataFrame([(f"f{i}", "d", text(c), "clash") for i, c in enumerate(contents)], "file_id string, doc_id string, content string, changes string")
    files = files.union(files)
    return rows(drift.change_report(drift.route(files, fields))), files, fields


def test_no_change(spark):
    got, files, fields = report(spark, GOOD, {**GOOD, "groups": []}, {**GOOD, "groups": [{**GROUP, "confidence": 1, "codes": []}]}, {**GOOD, "status": None})
    assert got == []
    assert drift.consistent_table(files, fields).count() == 4


def test_each_change(spark):
    got, _, _ = report(
        spark,
        {"status": "done", "groups": [{"id": "g", "confidence": "0.5", "codes": "a", "box": {}}]},
        {"schemaVersion": "1", "status": "done", "groups": {"x": GROUP}, "extra": {"a": 1}},
        {**GOOD, "groups": [{**GROUP, "box": {"size": 1, "other": 2}}, {"id": "h", "codes": [1], "conf": 0.25, "box": {"size": 2}}]},
    )
    assert got == sorted(
        [
            ("f0", "schema_version", "missing"), ("f0", "groups[].confidence", "type"), ("f0", "groups[].codes", "type"),
            ("f1", "schema_version", "renamed"), ("f1", "schema_version", "type"), ("f1", "groups", "type"), ("f1", "extra", "added"),
            ("f2", "groups[].box.other", "added"), ("f2", "groups[].confidence", "renamed"), ("f2", "groups[].codes", "type"),
        ],
        key=repr,
    )


def test_unreadable_and_empty(spark):
    got, files, fields = report(spark, None, "", "[1]", "{", "[" * 100_000)
    assert got == []
    assert {(r.status, r.schema_fingerprint) for r in drift.consistent_table(files, fields).collect()} == {(None, None)}
    assert [(r.fingerprint, r.files, r.steps) for r in drift.schema_registry(files, fields).collect()] == [(None, 5, None)]
    assert rows(drift.change_report(drift.route(spark.createDataFrame([], "file_id string, doc_id string, content string"), fields))) == []


def test_steps_make_the_table(spark):
    _, files, fields = report(spark, {"schemaVersion": "1", "status": "done", "groups": {"x": {"id": "g", "score": 1, "conf": 0.25, "codes": "a;b", "box": {"size": 2}}}}, GOOD)
    got = {r.file_id: r for r in drift.consistent_table(files, fields).collect()}
    assert got["f0"].schema_version == 1 and got["f0"].groups[0].asDict(True) == {"id": "g", "confidence": 0.25, "codes": ["a", "b"], "box": {"path": None, "size": 2.0}}
    registry = {r.fingerprint: r for r in drift.schema_registry(files, fields).collect()}
    assert len(registry) == 2 and [r.files for r in registry.values()] == [1, 1]
    steps = registry[got["f0"].schema_fingerprint].steps
    assert "rename  schemaVersion schema_version" in steps and "container  groups groups" in steps and "keep groups[] score " in steps


def test_renames_by_the_forms_of_all_values(spark):
    known = [{**GOOD, "status": f"run {i} is done", "groups": []} for i in range(3)]
    got, _, _ = report(spark, *known, {"schema_version": 1, "outcome": "run 77 is done", "groups": []}, {"schema_version": 1, "remark": "quite another text", "groups": []})
    assert got == [("f3", "status", "renamed"), ("f4", "remark", "added"), ("f4", "status", "missing")]


def test_one_large_set_and_one_small_give_the_same_steps(spark):
    odd = {"schema_version": 1, "outcome": "run 77 is done", "groups": []}
    many = [{**GOOD, "status": f"note {'abcdefghij'[i % 10]}{'klmnop'[i % 6]}", "groups": []} for i in range(300)]
    got, _, _ = report(spark, odd, {**GOOD, "status": "run 5 is done"}, *many)
    assert got == [("f0", "status", "renamed")]


def test_last_delivery_counts(spark):
    import datetime

    fields = spark.createDataFrame(FIELDS, "field string, json_type string, optional boolean")
    day = datetime.datetime(2025, 1, 1)
    files = spark.createDataFrame([("f", "d", json.dumps({**GOOD, "new": 1}), day), ("f", "d", json.dumps(GOOD), day + datetime.timedelta(1))], "file_id string, doc_id string, content string, received_at timestamp")
    assert rows(drift.change_report(drift.route(files, fields))) == []
    assert drift.consistent_table(files, fields).count() == 1


def test_casts():
    assert drift.cast("0.5", "number") == 0.5 and drift.cast("p0012", "integer") == 12 and drift.cast(True, "integer") is None
    assert drift.cast("a;b", "array of string") == ["a", "b"] and drift.cast({"0": "x"}, "array of string") == ["x"] and drift.cast({"f": True, "g": False}, "array of string") == ["f"]
    assert drift.cast({"value": 0.7, "scale": 1}, "number") == 0.7 and drift.cast([{"id": "b"}], "array of string") == ["b"]


def test_fingerprint_ignores_order():
    assert drift.fingerprint({"a": 1, "b": [1, 2]}) == drift.fingerprint({"b": [3], "a": 7}) != drift.fingerprint({"a": "1", "b": [1]})

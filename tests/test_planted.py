"""Registered queries whose tables hold no such case, over small tables with planted ones, against their SQL."""

import datetime
from collections import Counter

import duckdb
import pytest

from pagemill.plans.queries import QUERIES, SQL
from test_queries import canon
from test_visuals import COMPLEX, IMAGES, REVIEW, SCHEMA, element

TIME = datetime.datetime(2025, 1, 1)
SHA, SIM = "a" * 64, "b" * 16
BLOCKS = (
    "id string, doc_id string, kind string, block_order int, anchor struct<syntax:string,id:string>, fingerprint struct<visible_text_sha256:string,simhash64:string,text_length:int>,"
    " source_spans array<struct<page_index:int,bbox:struct<x:double,y:double,width:double,height:double>,region_id:string,paragraph_index:int,elements_sha256:string>>, asset_id string, received_at timestamp"
)


def block(i, doc="d", kind="body", order=None, anchor=None, sha=SHA, asset=None, prefix="blk_"):
    id_ = f"{prefix}{i:032x}" if isinstance(i, int) else i
    syntax = "p2md:slot" if kind == "visual_slot" else "p2md:block"
    span = (0, (0.1, 0.1, 0.2, 0.2), "r", 0, SHA)
    return id_, doc, kind, order, (syntax, anchor or id_), (sha, SIM, 5), [span], asset, TIME


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("planted")
    blocks = [
        block(1, kind="body", order=0), block(2, kind="title", order=1), block(3, kind="title", order=1),
        block(4, kind="visual_slot", order=2, asset="x", prefix="slot_"), block(5, kind="visual_slot", order=3, asset="x", prefix="slot_"), block(6, kind="odd", order=4, anchor="blk_0"),
        block(7, "e", "title", 0, sha="c" * 64), block(8, "e", "caption", 1, sha="d" * 64), block(9, "e", "body", 2, sha="D" * 64), block(10, "e", "body", 3, anchor="blk_" + "f" * 32, sha="e" * 64),
    ]
    outputs = "array<struct<path:string,size:bigint,sha256:string>>"
    manifests = [
        ("p", "extraction", "v0.8", "x", [("a.md", 5, SHA), ("A.md", 5, SHA), ("../b", 0, "zz"), None, (None, None, None)], None, "b"), ("q", "extraction", "v0.8", None, [], None, None), ("r", None, None, None, None, None, None),
    ]
    groups = [("d", "g1", ["b1", "b2", None], ["a.png", "lost.png"]), ("d", "g2", ["b2"], [None, "images/panel-a.png"]), ("d", "g1", ["b1", "b2", None], ["a.png", "lost.png"]), ("g1", "g3", None, ["images/panel-a.png", "images/no.png"])]
    pages = [*COMPLEX, *REVIEW, element("h", 0, 0, "image", (100, 100, 500, 400), "images/x.png"), element("h", 1, 0, "text", (100, 410, 500, 450), text="Fig. 3. A formal caption below the figure."), element("h", 2, 0, "image", (600, 800, 700, 900), "images/y.png")]
    text = "Migration\n\n" + "\n".join(f"![]({p})" for _, _, _, p, *_ in IMAGES if p.startswith("images/panel"))
    tables = {
        "reader_blocks": (blocks, BLOCKS),
        "manifests": (manifests, f"package_id string, kind string, schema_version string, created_at string, outputs {outputs}, source struct<original_name:string,size:bigint,sha256:string>, backend string"),
        "visual_groups": (groups, "doc_id string, id string, member_block_ids array<string>, member_asset_paths array<string>"),
        "paper_content_list": (pages, SCHEMA),
        "documents": ([(1, text, "g1", TIME), (2, None, "g2", TIME)], "doc_id long, text string, package_id string, received_at timestamp"),
    }
    con = duckdb.connect()
    for name, (rows, ddl) in tables.items():
        df = spark.createDataFrame(rows, ddl)
        if name == "paper_content_list":
            df = df.drop("id", "role")
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return str(folder), con


@pytest.mark.parametrize("name", ["contract_checks", "file_checks", "missing_assets", "claimed_twice", "unique_repeats", "following_captions", "anchor_state", "block_checks", "package_inventory"])
def test_planted_cases(spark, planted, name):
    folder, con = planted
    df = QUERIES[name](spark, folder)
    got = Counter(tuple(canon(v) for v in r) for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect())
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert got and got == Counter(tuple(canon(dict(zip(names, r))[c]) for c in sorted(names)) for r in cur.fetchall())


def test_what_the_planted_cases_are(spark, planted):
    folder, _ = planted
    run = lambda name: QUERIES[name](spark, folder).collect()
    assert {(r.doc_id, r.code) for r in run("contract_checks")} == {("d", "invalid-title-block"), ("d", "duplicate-block-order"), ("d", "asset-reused")}
    assert {r.code for r in run("file_checks")} == {"invalid-path", "invalid-size", "invalid-hash", "conflicting-path"}
    assert {r.path for r in run("missing_assets")} == {"a.png", "lost.png", "images/panel-a.png", "images/no.png"} and len(run("missing_assets")) == 4
    assert [(r.member, r.groups) for r in run("claimed_twice")] == [("b2", 2)]
    assert len(run("unique_repeats")) == 1
    assert {r.doc_id: r.state for r in run("anchor_state")} == {"d": "invalid-contract", "e": "invalid-contract"}
    assert {(r.doc_id, r.status) for r in run("next_page_captions")} == {("g1", "complete"), ("g2", "partial")}
    groups = {r.doc_id: r for r in run("visual_groups_built")}
    # the article's images stand next to each other, so the group is sure
    assert groups["g1"].decision == "auto" and groups["g1"].markdown_reference_coverage == 1.0 and "markdown_references_contiguous" in groups["g1"].reason_codes

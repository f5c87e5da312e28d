"""Rule tables of the reader contract, names and geometry that no table holds, on small rows."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from pagemill.functions import geometry as G
from pagemill.functions import names as N
from pagemill.operators import integrity as I

SHA, AST, SLOT, BLK = "a" * 64, "ast_" + "1" * 24, "slot_" + "2" * 24, "blk_" + "3" * 24
ASSETS = "doc_id string, id string, kind string, path string, sha256 string, size_bytes long, width_px int, height_px int, display_label string, caption_block_id string, placement_block_id string, code string"


def codes(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id if "id" in df.columns else r.doc_id, set()).add(r.code)
    return out


def test_assets(spark):
    good = ("d", AST, "figure", "images/a.png", SHA, 10, 4, 4, "Fig. 1", BLK, SLOT, "clash")
    bad = ("d", "x", None, "images/a/b.png", "zz", 40 * 1024 * 1024, 0, None, " ", "y", None, "clash")
    assert codes(I.asset_checks(spark.createDataFrame([good, bad], ASSETS))) == {
        "x": {"invalid-asset-id", "invalid-asset-kind", "invalid-asset-path", "invalid-asset-hash", "asset-too-large", "invalid-asset-metadata", "invalid-display-label", "invalid-caption-block", "invalid-placement-block"}
    }
    many = spark.createDataFrame([good[:1] + (AST,) + good[2:5] + (2 * 1024 * 1024,) + good[6:]] * 257, ASSETS)
    assert codes(I.asset_checks(many)) == {None: {"too-many-assets", "asset-total-too-large"}}
    assert I.asset_checks(many.limit(0)).count() == 0


def test_relations(spark):
    ddl = "doc_id string, id string, type string, source_id string, target_id string, label string"
    df = spark.createDataFrame([("d", "rel_" + "4" * 24, "places", SLOT, AST, None), ("d", "r", "other", "x", None, ""), (None, "z", None, None, None, None)], ddl)
    assert codes(I.relation_checks(df)) == {"r": {"invalid-relation-id", "invalid-relation-type", "invalid-relation-source", "invalid-relation-target", "invalid-relation-label"}}


def test_heads(spark):
    ddl = "doc_id string, article struct<path:string,sha256:string,anchor_contract:string,block_fingerprint_version:string>, capabilities struct<layout_semantics:string,caption_binding:string,body_references:string>"
    able = ("reviewed", "reviewed-layout-geometry", "unavailable")
    df = spark.createDataFrame([("a", ("article.md", SHA, "w-" + I.ANCHOR_CONTRACT, "w-" + I.FINGERPRINT_CONTRACT), able), ("b", ("x.md", None, "v9", None), None), ("c", None, able)], ddl)
    assert codes(I.contract_heads(df)) == {
        "b": {"invalid-article-path", "invalid-article-hash", "unsupported-anchor-contract", "unsupported-fingerprint-contract", "invalid-capabilities"}, "c": {"invalid-article"},
    }


def test_manifest_binding(spark):
    ddl = "doc_id string, manifest_version string, source_sha256 string, reader struct<contract_version:string,path:string,sha256:string,article_path:string,article_sha256:string,anchor_contract:string>, outputs array<struct<path:string,role:string,sha256:string>>"
    v, path = "w-" + I.BOUND_MANIFESTS[0], "_w/reader.json"
    reader = ("w-" + I.READER_CONTRACT, path, "b" * 64, "article.md", SHA, "w-" + I.ANCHOR_CONTRACT)
    outputs = [(path, "reader_index", "b" * 64), ("article.md", "markdown", SHA)]
    m = [
        ("good", v, "s", reader, outputs), ("old", "w-manifest-v0.5", "s", None, None), ("bare", v, "s", None, None), ("twice", v, "s", reader, outputs + outputs), ("none", v, None, reader, None),
        ("off", v, "t", ("v9", path, "c" * 64, "article.md", "zz", None), outputs),
    ]
    c = [(d, "s", "article.md", SHA, "b" * 64) for d in ("good", "old", "bare", "twice", "off")]
    got = codes(I.manifest_binding(spark.createDataFrame(m, ddl), spark.createDataFrame(c, "doc_id string, source_sha256 string, article_path string, article_sha256 string, reader_sha256 string")))
    assert got == {
        "old": {"unsupported-manifest-version"}, "bare": {"invalid-manifest-reader"}, "twice": {"manifest-reader-output-mismatch", "manifest-article-output-mismatch"},
        "none": {"manifest-reader-contract-mismatch", "manifest-reader-hash-mismatch", "manifest-article-hash-mismatch", "invalid-manifest-outputs"},
        "off": {"manifest-source-mismatch", "manifest-reader-contract-mismatch", "manifest-reader-hash-mismatch", "manifest-article-hash-mismatch", "manifest-reader-output-mismatch", "manifest-article-output-mismatch"},
    }


def test_claims_and_pdfs(spark):
    df = spark.createDataFrame([("d", 1, 2, "x"), ("d", 1, 2, "y"), ("d", 3, 4, "z")], "doc_id string, a int, b int, t string")
    assert [r.t for r in I.single_claims(df, ["doc_id", "a", "b"]).collect()] == ["z"]
    files = [("a", "x_origin.PDF"), ("a", "y.pdf"), ("b", "only.pdf"), ("b", "x.txt"), ("c", "1.pdf"), ("c", "2.pdf"), ("d", "x.md"), ("e", None)]
    assert rows(I.source_pdf(spark.createDataFrame(files, "package_id string, name string"))) == [("a", "x_origin.PDF"), ("b", "only.pdf")]


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = lambda s: F.lit(s).cast("string")
    assert one(N.archive_name(lit('Ａ: "b"/c\t'))) == "A b c.zip" and one(N.archive_name(lit(" "))) == "paper.zip" and one(N.archive_name(lit(None))) == "paper.zip"
    assert one(N.archive_stem(lit("My File.mineru.zip"))) == "My-File" and one(N.archive_stem(lit(None))) == "paper" and one(N.archive_stem(lit("..zip"))) == "."
    assert one(N.image_extension(lit(" image/PNG; q=1"))) == "png" and one(N.image_extension(lit("image/tiff"))) is None and one(N.image_extension(lit(None))) is None
    assert one(N.yaml_text(lit('a "b"\n'))) == '"a \\"b\\""' and one(N.yaml_text(lit(None))) is None and one(N.heading_text(lit("# A_b "))) == "\\# A\\_b" and one(N.heading_text(lit(""))) == "Untitled paper"
    assert one(N.paragraph_markup(lit("a<b & $c$"))) == "a&lt;b &amp; \\$c\\$"
    assert one(N.prefix_place(lit("x y A b c d e f g z"), lit("a B c d e f g"))) == 2 and one(N.prefix_place(lit("a b"), lit("a b"))) == -1 and one(N.prefix_place(lit("a b c d e f g a b c d e f g"), lit("a b c d e f g"))) == -1
    text = one(N.article_text(lit("A: b"), lit(" body "), {"source": lit("https://x.org")}, ("clip",)))
    assert text == '---\ntitle: "A: b"\nsource: "https://x.org"\ntags:\n  - clip\n---\n\n# A: b\n\nbody\n'
    assert one(N.article_text(lit(None), lit("# T\nx"), {})).endswith("---\n\n# T\nx\n")


@pytest.mark.parametrize("box,want", [([0.1, 0.2, 0.5, 0.9], (0.1, 0.2, 0.4, 0.7)), ([100.0, 200.0, 500.0, 900.0], (0.1, 0.2, 0.4, 0.7)), ([5.0, 1.0, 1.0, 2.0], None), ([1.0, 2.0], None), ([0.0, 0.0, None, 1.0], None), ([0.0, 0.0, math.inf, 1.0], None), (None, None)])
def test_loose_boxes(spark, box, want):
    got = spark.createDataFrame([(box,)], "b array<double>").select(G.loose_unit_box(F.col("b")).alias("u")).first().u
    assert (got and tuple(round(x, 9) for x in got)) == want

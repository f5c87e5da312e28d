"""Golden pages: three panels under one caption with a caption on the next page, and a pair for review."""

import datetime

from pagemill.operators import elements, visuals

SCHEMA = (
    "doc_id string, source_index int, page_idx int, source string, type string, text string, text_level int, bbox array<double>, img_path string, image_caption array<string>,"
    " image_footnote array<string>, table_caption array<string>, table_footnote array<string>, table_body string, sub_type string, received_at timestamp, id string, role string"
)
TIME = datetime.datetime(2025, 1, 1)


def element(doc, i, page, kind, box, asset=None, caption=None, text=None, level=None):
    return (doc, i, page, "s", kind, text, level, box and [float(x) for x in box], asset, caption, None, None, None, None, None, TIME, "clash", "clash")


COMPLEX = [
    element("g1", 0, 0, "text", (80, 50, 920, 110), text="Contract migration fixture", level=1),
    element("g1", 1, 0, "image", (100, 150, 380, 450), "images/panel-a.png", ["a"]),
    element("g1", 2, 0, "image", (390, 150, 670, 450), "images/panel-b.png", ["b"]),
    element("g1", 3, 0, "image", (680, 150, 960, 450), "images/panel-c.png", ["Fig. 1. A sufficiently long formal caption describing the complete multi-panel result."]),
    element("g1", 4, 1, "image", (120, 180, 880, 720), "images/figure-2.png", ["Fig. 2. Caption continued on next page."]),
    element("g1", 5, 2, "text", (100, 80, 900, 180), text="Fig. 2. A complete formal caption recovered from the following page."),
]
REVIEW = [
    element("g2", 0, 0, "text", (80, 50, 920, 110), text="Review candidate fixture", level=1),
    element("g2", 1, 0, "image", (100, 160, 480, 560), "images/left.png", ["Fig. 1. A sufficiently long formal caption that identifies this two-fragment figure."]),
    element("g2", 2, 0, "image", (490, 160, 900, 560), "images/right.png"),
    element("g2", 3, 1, "image", (120, 180, 880, 720), "images/figure-2.png", ["Fig. 2. Caption continued on next page."]),
    element("g2", 4, 2, "text", (100, 80, 900, 180), text="Fig. 2. This formal caption remains deliberately incomplete"),
]
IMAGES = [
    ("g1", "md-img-0000", 0, "images/panel-a.png", 0, 30, 53), ("g1", "md-img-0001", 1, "images/panel-b.png", 0, 54, 77), ("g1", "md-img-0002", 2, "images/panel-c.png", 0, 78, 101),
    ("g1", "md-img-0003", 3, "images/figure-2.png", 0, 162, 186), ("g2", "md-img-0000", 0, "images/left.png", 0, 30, 50),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.union(df)


def test_groups(spark):
    images = spark.createDataFrame(IMAGES, "doc_id string, id string, `order` int, asset_path string, occurrence int, start int, end int")
    got = {r.doc_id: r for r in visuals.visual_groups(frame(spark, COMPLEX + REVIEW), images).collect()}
    a, b = got["g1"], got["g2"]
    assert (a.id, a.member_block_ids, a.decision, a.confidence) == ("vr-p0000-g0000", ["p0000-s000001", "p0000-s000002", "p0000-s000003"], "auto", 0.99)
    assert (a.bbox_norm, a.union_area_fraction, a.adjacent_pair_count, a.mode) == ([100.0, 150.0, 960.0, 450.0], 0.258, 2, "pdf_crop")
    assert (b.member_block_ids, b.decision, b.confidence) == (["p0000-s000001", "p0000-s000002"], "review", 0.83)
    assert (b.markdown_reference_coverage, b.max_markdown_gap_chars, b.union_area_fraction) == (0.5, None, 0.32)


def test_links(spark):
    got = {r.doc_id: r for r in visuals.caption_links(frame(spark, COMPLEX + REVIEW)).collect()}
    assert (got["g1"].visual_block_id, got["g1"].caption_block_ids, got["g1"].status, got["g1"].figure_key) == ("p0001-s000004", ["p0002-s000005"], "complete", "figure:2")
    assert (got["g2"].status, got["g2"].reason_codes) == ("partial", ["unterminated_caption_anchor"])


PAGE = "array<struct<page_order:int,id:string,role:string,chars:int,box:array<double>,key:string,formal:string,ended:boolean,goes_on:boolean>>"


def test_link_cases(spark):
    def block(i, role="text", chars=40, box=(100.0, 80.0, 500.0, 180.0), key=None, formal=None, ended=False, goes_on=False):
        return i, f"b{i}", role, chars, list(box) if box else None, key, formal, ended, goes_on

    fig, beside = "figure:2", (520.0, 80.0, 900.0, 180.0)
    anchor = block(1, key=fig, formal=fig)
    header = block(0, "title", 9, (60.0, 10.0, 200.0, 30.0))
    cases = [
        ([block(0, "marginalia"), anchor, block(2, "visual")], ("partial", ["b1"], ["visual_boundary_before_caption_continuation"])),
        ([block(0), anchor], ("missing", [], ["body_text_boundary"])),
        ([block(0, key="figure:3")], ("missing", [], ["different_figure_key"])),
        ([block(0, key=fig)], ("missing", [], ["nonformal_figure_reference"])),
        ([block(0, "table")], ("missing", [], ["table_boundary"])),
        ([block(0, box=(100.0, 400.0, 500.0, 500.0))], ("missing", [], ["body_band_boundary"])),
        ([block(0, box=None, formal=fig, key=fig)], ("missing", [], ["body_band_boundary"])),
        ([header, block(0, chars=0), anchor], ("partial", ["b1"], ["unterminated_caption_anchor"])),
        ([block(1, key=fig, formal=fig, ended=True), block(2, "visual")], ("complete", ["b1"], [])),
        ([anchor, block(2, box=beside, goes_on=True, ended=True)], ("complete", ["b1", "b2"], [])),
        ([anchor, block(2, box=beside, goes_on=True)], ("partial", ["b1", "b2"], ["unterminated_caption_continuation"])),
        ([anchor, block(2, box=beside)], ("partial", ["b1"], ["uncertain_adjacent_caption_continuation"])),
        ([anchor, block(2, box=beside, chars=0), block(3, box=beside, goes_on=True)], ("partial", ["b1"], ["empty_adjacent_caption_column"])),
        ([anchor, block(2, "title", box=beside)], ("partial", ["b1"], ["title_band_in_adjacent_column"])),
        ([anchor, block(2, goes_on=True)], ("partial", ["b1"], ["body_text_boundary_before_caption_continuation"])),
        ([anchor, block(2, key="figure:4")], ("partial", ["b1"], ["new_figure_anchor_in_adjacent_column"])),
        ([anchor, block(2, box=beside, key=fig, formal=fig)], ("ambiguous", [], ["duplicate_formal_caption_anchor"])),
        ([], ("missing", [], [])),
        (None, ("missing", [], [])),
    ]
    df = spark.createDataFrame([(i, fig, page) for i, (page, _) in enumerate(cases)], f"i int, fig string, page {PAGE}")
    got = {r.i: (r.link.status, r.link.caption_block_ids, r.link.reason_codes) for r in visuals.with_link(df, "fig", "page").collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_enclosure_and_components(spark):
    rows = [element("d", 0, 0, "image", (100, 100, 500, 500), "a.png"), element("d", 1, 0, "image", (150, 150, 300, 300), "b.png"), element("d", 2, 0, "image", (510, 100, 600, 500), "c.png"), element("d", 3, 0, "image", (800, 800, 900, 900), "d.png")]
    blocks = elements.viewer_blocks(frame(spark, rows))
    assert [tuple(r)[2:] for r in visuals.enclosing_visuals(blocks).collect()] == [("p0000-s000001", "p0000-s000000", 1.0)]
    got = {r.id[-1]: r.component[-1] for r in visuals.visual_components(blocks).collect()}
    assert got["0"] == got["2"] == "0" and got["3"] == "3"
    group = visuals.visual_groups(frame(spark, rows)).collect()
    assert len(group) == 1 and group[0].member_block_ids == ["p0000-s000000", "p0000-s000001", "p0000-s000002"]


def test_missing_parts(spark):
    rows = [element("d", 0, None, "image", (1, 1, 2, 2), "a.png"), element("d", 1, -1, None, None), element("d", 2, 0, "TEXT ", None, text=None), element("d", 3, 0, "x", (1, 1, 1, 2))]
    df = frame(spark, rows)
    assert sorted(tuple(r)[1:] for r in elements.block_issues(df).collect()) == [(0, "invalid_page_idx"), (1, "invalid_page_idx"), (2, "missing_or_invalid_bbox"), (3, "missing_or_invalid_bbox")]
    assert [r.status for r in elements.package_status(df).collect()] == ["unavailable"]
    assert sorted((r.id, r.page_order, r.role) for r in elements.viewer_blocks(df).collect()) == [("p0000-s000002", 0, "text"), ("p0000-s000003", 1, "other")]
    for f in (visuals.visual_groups, visuals.caption_links, elements.caption_summaries, visuals.following_captions):
        assert f(df).count() == 0 and f(df.limit(0)).count() == 0


def test_nested_groups_are_united():
    block = lambda i, keys=(): {"id": f"b{i}", "page_order": i, "formal_keys": list(keys), "next_keys": []}
    page = [block(0), block(1, ["figure:1"]), block(2), block(3), block(9)]
    group = lambda n, members, box, **x: {"n": n, "members": members, "box": box, "decision": "auto", "mode": "pdf_crop", "anchors_at": members[-1:], "confidence": 0.9, "edges": 1, "anchors": 1, "image_ids": [], "reasons": ["a"], "warnings": []} | x
    small, large, far = group(0, ["b2", "b3"], [110, 110, 300, 300], confidence=0.87), group(1, ["b0", "b1"], [100, 100, 500, 500]), group(2, ["b9"], [120, 120, 200, 200])
    got = visuals.merge_nested([small, large, far], page)
    assert [(g["n"], g["members"], g["confidence"], g["edges"]) for g in got] == [(1, ["b0", "b1", "b2", "b3"], 0.87, 2), (2, ["b9"], 0.9, 1)]
    assert got[0]["reasons"] == ["a", "nested_visual_overlap_deduplicated"] and got[0]["nested"] == 1.0 and got[0]["box"] == [100, 100, 500, 500]
    two = [block(0, ["figure:2"]), *page[1:]]
    assert len(visuals.merge_nested([small, large], two)) == 2
    assert len(visuals.merge_nested([small | {"decision": "review"}, large], page)) == 2

from conftest import rows
from pyspark.sql import functions as F

from pagemill.functions import canonical, geometry, paths, recover
from pagemill.functions import text as X


def column(spark, f, *values):
    got = {r[0]: r[1] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", f(F.col("t")).alias("o")).collect()}
    return [got[i] for i in range(len(values))]


def test_figure_keys(spark):
    assert column(spark, X.figure_key, "Fig. 2.1 T", "figure S3", "Extended  Data Fig. 1 | x", "图 4：x", "The Fig. 2", None, "") == ["figure:2_1", "figure:s3", "extended-data-figure:1", "图:4", None, None, None]
    assert column(spark, X.formal_figure_key, "Fig. 1. A long title", "Fig. 1 shows it all", "Fig. 1. abc", "Fig. 1") == ["figure:1", None, None, None]


def test_caption_kinds(spark):
    got = column(spark, X.caption_item_kind, "a", "(b)", "Fig. 2. Caption continued on next page.", "图 4：图注见下页", "Fig. 1. A long title", "and so it goes on to the very end.", "word", None)
    assert got == ["panel-label", "panel-label", "next-page-placeholder", "next-page-placeholder", "formal-caption", "caption-continuation", "other", None]


def test_endings(spark):
    assert column(spark, X.ends_with_terminal, "a.", 'a."', "a.</i> </b>", "a", "。", "", None) == [True, True, True, False, True, False, None]
    assert column(spark, X.first_letter_is_lower, "1 a", "A", "图", "") == [True, False, False, False]


def test_titles(spark):
    assert column(spark, X.normalize_title, "Single-cell RNA：ＡＢ", "", None) == ["single cell rna ab", "", None]
    df = spark.createDataFrame([("Single-cell RNA sequencing: an atlas", "Single cell RNA sequencing — an atlas.")], "a string, b string")
    assert df.select(X.dice(X.title_tokens(X.normalize_title(F.col("a"))), X.title_tokens(X.normalize_title(F.col("b"))))).first()[0] == 1.0


def test_more_text(spark):
    assert column(spark, X.panel_letters, "see (a–c) and (e)", "none") == [["a", "b", "c", "e"], []]
    assert column(spark, X.paragraph_text, "a para-\ngraph of\ntext­", " x ") == ["a paragraph of text", "x"]
    assert column(spark, X.safe_link, " https://a ", "javascript:x", "#f") == ["https://a", None, "#f"]
    assert column(spark, X.without_frontmatter, "---\ntitle: x\n---\nbody", "---\nno\n---\nbody") == ["body", "---\nno\n---\nbody"]
    assert column(spark, X.decode_entities, "a &amp;lt; &lt;b&gt;") == ["a &lt; <b>"]
    assert column(spark, lambda c: X.unique_position(c, F.lit("ab")), "xaby", "abab", "") == [1, None, None]
    assert column(spark, lambda c: X.numeric_year(c), "1999", "12", "x", None) == [1999, None, None, None]
    assert column(spark, lambda c: X.figure_label(c, F.lit("?")), "Figure 3. x", "x") == ["Figure 3", "?"]


def test_paths(spark):
    assert column(spark, paths.is_safe_relative, "a/b", "../a", "/a", "", "a//b", None) == [True, False, False, False, False, False]
    assert column(spark, paths.is_safe_package_path, "a/b.png", "con.txt", "a.", "x/" * 24 + "y", " a", None) == [True, False, False, False, False, False]
    assert column(spark, paths.asset_path, "./a%20b.png", "a%2", "%FF", "http://x", "a/../b", "<i.png>", None) == ["a b.png", None, None, None, None, "i.png", None]
    assert column(spark, paths.path_key, "Ａ.PNG") == ["a.png"]


def test_paper_query(spark):
    got = column(spark, paths.paper_query, "PMID: 12345678", "https://doi.org/10.1000/ABC%2Fdef#s", "https://example.org/p?v=1#r", "ftp://a/b", "DOI: no", "abc", "A  title", None)
    assert [tuple(x) for x in got] == [
        ("pmid", "12345678"), ("doi", "10.1000/abc/def"), ("url", "https://example.org/p?v=1"), ("error", "url"), ("error", "identifier"), ("error", "title"), ("title", "A title"), ("error", "length"),
    ]


def test_boxes(spark):
    a, b = F.lit([100.0, 150.0, 380.0, 450.0]), F.lit([390.0, 150.0, 670.0, 450.0])
    df = spark.range(1)
    assert df.select(geometry.adjacent(a, b), geometry.intersection_ratio(a, a), geometry.area(a), geometry.x_gap(a, b)).first()[:] == (True, 1.0, 84000.0, 10.0)
    boxes = spark.createDataFrame([([0.1, 0.1, 0.2, 0.3],), ([1.0, 2.0, 1.0, 3.0],), ([1.0, 2.0],), (None,), ([1.0, None, 3.0, 4.0],)], "b array<double>")
    assert [r[0] for r in boxes.select(geometry.contract_box(F.col("b"), True)).collect()] == [[100.0, 100.0, 200.0, 300.0], None, None, None, None]
    caption = df.select(geometry.caption_score(F.lit([100.0, 460.0, 380.0, 480.0]), a), geometry.caption_score(F.lit([500.0, 460.0, 600.0, 480.0]), a)).first()
    assert caption[0] == 10.0 and caption[1] is None


def test_alignment():
    block = "The calibrated value is �, while every other source byte stays fixed."
    page = "HEADER 12 " + block.replace("�", "ν") + " FOOTER"
    got = recover.align(block, page)
    assert got.text == block.replace("�", "ν") and got.confidence >= 0.985
    for other in (page + " " + page, page.replace("ν", "*"), "unrelated text of another page", ""):
        assert recover.align(block, other).text is None
    assert recover.align(block, page, 100).exceeded and recover.align("no loss", page).text is None


def test_alignment_against_brute_force():
    import numpy as np

    a, b = np.array([1, 2, 9, 3]), np.array([5, 1, 2, 7, 3, 3])
    wild = np.array([False, False, True, False])
    got = recover._scores(a, b, wild)
    want = np.zeros((5, 7), int)
    for i in range(1, 5):
        want[i, 0] = -2 * i
        for j in range(1, 7):
            step = 2 if wild[i - 1] else 3 if a[i - 1] == b[j - 1] else -3
            want[i, j] = max(want[i - 1, j - 1] + step, want[i - 1, j] - 2, want[i, j - 1] - 2)
    assert (got == want).all()


def test_context_recovery():
    block = "the initial temperature of the probe (i $ �) during inference was stable"
    assert recover.from_context(block, "x the initial temperature of the probe (i $ ττ) during inference was stable y") == block.replace("�", "τ")
    twice = "the initial temperature of the probe (i $ τ) during inference was stable"
    assert recover.from_context(block, twice + " " + twice) is None


def test_paragraph_recovery():
    before, after = "The first paragraph of the article ends here.", "The last one begins here and ends at once."
    article = before + "\n\n" + after
    text = "Between them stood a para- graph that the extractor lost, with more than enough words in it."
    assert recover.recovered_paragraph(article, before, after, text) == text.replace("para- graph", "paragraph")
    assert recover.recovered_paragraph(article, before, after, text[:-1]) is None
    assert recover.recovered_paragraph(article, before, after, "lower " + text) is None
    assert recover.recovered_paragraph(article, before, after, "Fig. 1. " + text) is None
    assert recover.recovered_paragraph(article + text, before, after, text) is None


def test_recovered_column(spark):
    block = "The calibrated value is �, while every other source byte stays fixed."
    df = spark.createDataFrame([(block, block.replace("�", "ν")), (None, "x"), (block, None), ("", "")], "b string, p string")
    assert [r[0] for r in df.select(recover.recovered(F.col("b"), F.col("p"))).collect()] == [block.replace("�", "ν"), None, None, None]


def test_canonical_json():
    assert canonical.canonical_json({"b": [1, 2.5, 1e-6, 1e-7, 1e21], "confidence": 1, "a": {"é": None}}) == '{"a":{"é":null},"b":[1,2.5,0.000001,1e-7,1e+21],"confidence":1.0}'
    assert canonical.canonical_sha256({"a": 1}) == canonical.canonical_sha256({"a": 1.0})


def test_string_summary(spark):
    df = spark.createDataFrame([([" a ", "", None, "bc"],), ([],), (None,)], "s array<string>")
    got = [tuple(r[0]) for r in df.select(X.string_summary(X.string_list(F.col("s")))).collect()]
    assert got[0][:2] == (2, 3) and got[1] == got[2] == (0, 0, None)
    assert rows(spark.createDataFrame([(1,)], "a int").select(X.stable_id("blk", F.lit(255))))[0][0] == "blk_" + "0" * 22 + "ff"

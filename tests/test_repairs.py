from conftest import rows
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import repairs as R

LOST = "�"


def test_repairs(spark):
    articles = spark.createDataFrame([("a", f"x {LOST} y 😀 {LOST}{LOST} z", 1), ("b", None, 1), ("c", "same", 1)], "doc_id string, markdown string, start int")
    given = spark.createDataFrame(
        [("a", "1", f"x {LOST} y", "x ν y", 0), ("a", "2", f"{LOST}{LOST} z", "αβ z", 0), ("a", "3", f"{LOST} y", "ν y", 0), ("a", "4", f"{LOST}", "ν", 0), ("a", "5", f"😀 {LOST}", "😀 $", 0), ("b", "6", LOST, "q", 0), ("a", "7", None, None, 0)],
        "doc_id string, repair_id string, source_text string, replacement string, end int",
    )
    placed = R.placed_repairs(articles, given)
    assert {r.repair_id: r.status for r in placed.collect()} == {"1": "ready", "2": "ready", "3": "overlap", "4": "not-unique", "5": "not-passive", "6": "no-article", "7": "not-unique"}
    assert {r.doc_id: (r.markdown, r.repairs) for r in R.repaired(articles, placed).collect()} == {"a": ("x ν y 😀 αβ z", 2), "b": (None, 0), "c": ("same", 0)}
    assert R.placed_repairs(articles, given.limit(0)).count() == 0


def test_page_anchors(spark):
    articles = spark.createDataFrame([("a", "first words of it\n\nsecond words of it\n\nsecond words of it\n\nthird words of it"), ("b", None)], "doc_id string, markdown string")
    texts = spark.createDataFrame(
        [("a", 0, 0, "first words of it"), ("a", 1, 1, "second words of it"), ("a", 2, 2, "short"), ("a", 2, 3, "third words of it"), ("a", 3, 4, "first words of it"), ("a", None, 5, "third words of it"), ("b", 0, 0, "third words of it")],
        "doc_id string, page_idx int, source_index int, text string",
    )
    assert [r[:3] for r in rows(R.page_anchors(articles, texts))] == [("a", 0, 0), ("a", 2, 59)]


def test_closure_and_labels(spark):
    refs = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b")], "package_id string, path string")
    have = spark.createDataFrame([("p", "a"), ("p", "c")], "package_id string, path string")
    assert rows(R.closure(refs, have)) == [("p", "a", "included"), ("p", "b", "unavailable"), ("p", "c", "unreferenced")]
    visuals = spark.createDataFrame([("d", 0, "Fig. 2. x"), ("d", 1, "no"), ("d", 2, None), ("d", 3, "Figure 2"), ("e", 0, "Table 1")], "doc_id string, pos int, caption string")
    assert rows(R.visual_labels(visuals)) == [("d", 0, "Fig. 2"), ("d", 1, "Fig. 3"), ("d", 2, "Fig. 4"), ("d", 3, "Fig. 5"), ("e", 0, "Table 1")]


def test_caption_text(spark):
    def column(f, *values):
        got = {r[0]: r[1] for r in spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", f(F.col("t")).alias("o")).collect()}
        return [got[i] for i in range(len(values))]

    assert column(X.readable_caption, "a &amp; **b** [c](d) <i>e</i> ![f](g) \\*h", None) == ["a & b c e f *h", None]
    segments = column(X.caption_segments, "CO<sub>2</sub> and $x^2$ \\$5", None, "")
    assert [tuple(x) for x in segments[0]] == [("text", "CO"), ("sub", "2"), ("text", " and "), ("math", "x^2"), ("text", " \\$5")] and segments[1] is None and segments[2] == []
    assert column(X.is_caption_line, "words", "# h", "> q", "1. x", "![a](b)", "", None) == [True, False, False, False, False, False, False]
    assert [[tuple(x) for x in r] for r in column(X.local_resources, "![a](b.png) <img src='https://x/y'> ![[c.png|d]] ![z](../q)")] == [[("b.png", True), ("../q", False), ("https://x/y", False), ("c.png", True)]]


def test_paragraph_gaps(spark):
    """A block without text between two paragraphs of its column, and where it belongs in the article."""
    from pyspark.sql import functions as F

    from pagemill.operators import repairs
    from test_visuals import element, frame

    above, below = "A first paragraph that is long enough to be found.", "A second paragraph that is long enough to be found."
    column = lambda y: (100, y, 480, y + 100)

    def doc(name, middle=None, kind="text", box=None, first=above, extra=()):
        rows = [element(name, 0, 0, "text", column(100), text=first), element(name, 1, 0, kind, box or column(210), text=middle), element(name, 2, 0, "text", column(320), text=below)]
        return rows + [element(name, 3 + i, 0, *x) for i, x in enumerate(extra)]

    rows = [
        *doc("gap"), *doc("text", middle="here"), *doc("type", kind="image"), *doc("wide", box=(20, 210, 980, 310)), *doc("lost", first=above + "\ufffd"), *doc("short", first="Short."),
        *doc("covered", extra=[("image", (100, 215, 480, 300), "a.png")]), *doc("apart", box=(600, 210, 900, 310)), *doc("twice"), *doc("between"), element("last", 0, 0, "text", column(100)),
    ]
    gaps = repairs.paragraph_gaps(frame(spark, rows))
    assert sorted((r.doc_id, r.id, r.previous_text, r.next_text) for r in gaps.collect()) == [(d, "p0000-s000001", above, below) for d in ("between", "gap", "twice")]
    articles = spark.createDataFrame([("gap", f"# T\n\n{above}\n\n{below}\n"), ("twice", f"{above}\n{above}\n{below}"), ("between", f"{above} x {below}"), (None, ""), ("none", None)], "doc_id string, markdown string")
    got = repairs.recovery_requests(gaps, articles)
    assert [(r.doc_id, r.request_id, r.id) for r in got.collect()] == [("gap", "mineru-paragraph-000001", "p0000-s000001")]
    put = lambda t: got.join(articles, "doc_id").select(repairs.insert_paragraph(F.col("markdown"), F.col("start"), F.col("end"), F.lit(t)).alias("x")).first().x
    assert put("New *text*.") == f"# T\n\n{above}\n\nNew \\*text\\*.\n\n{below}\n"
    assert put("first paragraph that") is None and put("...") is None
    assert repairs.paragraph_gaps(frame(spark, rows).limit(0)).count() == 0

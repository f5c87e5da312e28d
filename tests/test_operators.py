import datetime
import random

from conftest import rows
from pyspark.sql import functions as F

from pagemill.operators import identity, integrity, markdown, ordered, titles
from pagemill.runtime import latest


def test_fill_forward_over_blocks(spark):
    rng = random.Random(1)
    data = [(k, i, rng.choice([None, None, i])) for k in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(data, "k string, i int, v int")
    want = {}
    for k in ("a", "b"):
        last = None
        for kk, i, v in data:
            if kk == k:
                last = v if v is not None else last
                want[k, i] = -1 if last is None else last
    got = {(r.k, r.i): r.o for r in ordered.fill_forward(df, "k", "i", "v", "o", F.lit(-1), block=7).collect()}
    assert got == want


def test_running_sum_and_neighbours_over_blocks(spark):
    data = [("a", i, i % 3) for i in range(0, 60, 2)] + [("b", 5, None)]
    df = spark.createDataFrame(data, "k string, i int, v int")
    sums = {(r.k, r.i): r.s for r in ordered.running_sum(df, "k", "i", F.col("v"), "s", block=8).collect()}
    total = 0
    for k, i, v in data[:-1]:
        total += v
        assert sums[k, i] == total
    assert sums["b", 5] == 0
    near = {(r.k, r.i): (r.prev_i, r.next_i) for r in ordered.with_neighbours(df, "k", "i", ["i"], block=8).collect()}
    for n, (_, i, _) in enumerate(data[:-1]):
        assert near["a", i] == (i - 2 if n else None, i + 2 if n < 29 else None)
    assert near["b", 5] == (None, None)


def test_runs(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 7, 9, 10)] + [("b", None)], "k string, p int")
    assert rows(ordered.runs(df, "k", "p")) == [("a", 1, 3, 3), ("a", 7, 7, 1), ("a", 9, 10, 2)]


def test_title_pairs_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(14)]
    docs = [(i, "# " + " ".join(rng.sample(words, rng.randint(3, 8))) + "\n\nbody") for i in range(120)] + [(900, None), (901, ""), (902, docs_line := "w1 w2 w3 w4"), (903, docs_line)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    classes = {}
    for i, t in docs:
        tokens = set((t or "").split("\n")[0].replace("#", " ").split())
        if len(tokens) >= 4:
            title = " ".join((t or "").split("\n")[0].replace("#", " ").split())
            classes.setdefault(title, (tokens, i))
    want = set()
    for a in classes:
        for b in classes:
            if a < b:
                x, y = classes[a][0], classes[b][0]
                s = 2 * len(x & y) / (len(x) + len(y))
                if s >= 0.65:
                    want.add((a, b, round(s, 4)))
    got = {(r.title_a, r.title_b, r.similarity) for r in titles.title_pairs(df).collect()}
    assert got == want
    assert titles.title_pairs(df.limit(0)).count() == 0


def test_title_pairs_of_any_length_in_blocks(spark, monkeypatch):
    """tokens with many titles split, few pairs at a time, titles longer and shorter than those compared token by token."""
    for name, value in (("HOT_TITLES", 7), ("TASK_ROWS", 50), ("LOOK", 40), ("COMPARE", 9), ("SEND", 200)):
        monkeypatch.setattr(titles, name, value)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["naïve", "ｆｕｌｌ", "相", "𝒳"]
    lines = []
    for i in range(160):
        line = rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.choice((5, 7, 9, 15, 18, 30))) if i < 60 or i % 4 == 0 else list(rng.choice(lines))
        for _ in range(rng.randint(0, 3)):
            line[rng.randrange(len(line))] = rng.choice(words) if rng.random() < 0.8 else f"once{i}"
        lines.append(line)
    # one id for two titles
    docs = [(i, " ".join(line)) for i, line in enumerate(lines)] + [(3, "one id w1 w2 w3"), (400, "one id w1 w2 w3 w4"), (401, " ".join(lines[0]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    classes = {r.title: (set(r.tokens), r.first_doc) for r in titles.title_classes(df).collect()}
    want = []
    for a, (x, i) in classes.items():
        for b, (y, j) in classes.items():
            if a.encode() < b.encode() and (s := 2 * len(x & y) / (len(x) + len(y))) >= 0.65:
                want.append((a, b, i, j, round(s, 4)))
    assert len(want) > 100 and any(len(a.split()) > 17 for a, *_ in want)
    assert rows(titles.title_pairs(df)) == sorted(want, key=repr)


def test_title_pairs_do_not_shuffle_pairs(spark):
    """a row for each first token of a title, none for each two tokens or for each pair found."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(i, " ".join(rng.sample(words, 40))) for i in range(200)] + [(1000 + i, "a title of kind " + str(i)) for i in range(200)], "doc_id long, text string")
    jvm, sc = spark._jvm, spark.sparkContext._jsc.sc()

    def written() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    assert titles.title_pairs(df).count() == 199 * 200 // 2
    assert written() - before < 400 * 25


def test_headings(spark):
    text = "---\nt: x\n---\n# One\n\n```\n# no\n~~~\n```\nTwo\n---\n### Deep *x*\n# Last\n~~~\n# no"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "plain")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in markdown.headings(df).orderBy("line").collect()] == [
        ("heading-0001", 1, "One", 4, 12), ("heading-0002", 2, "Two", 10, 12), ("heading-0003", 3, "Deep x", 12, 12), ("heading-0004", 1, "Last", 13, 15),
    ]


def test_lines_images_anchors(spark):
    text = 'a😀\n![x](i/a.png) ![y](i/a.png)\n<img src="../b.png"> <img src="c.png">\n<!-- p2md:block id="blk_' + "0" * 24 + '" kind="body" -->\n<!-- p2md:slot bad -->'
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert [r.start for r in markdown.line_table(df).orderBy("line_no").limit(2).collect()] == [0, 4]
    got = [(r.id, r.asset_path, r.occurrence, r.start) for r in markdown.image_occurrences(df).orderBy("order").collect()]
    assert got == [("md-img-0000", "i/a.png", 0, 4), ("md-img-0001", "i/a.png", 1, 18), ("md-img-0002", "c.png", 0, text.index("<img src=\"c") + 1)]
    assert [(r.line_no, r.kind) for r in markdown.anchor_inventory(df).orderBy("line_no").collect()] == [(4, "block"), (5, "malformed")]
    assert markdown.bounded_section(df, 1, 2, 6).collect()[0][1:] == (1, 1, 5, True)


def test_binding(spark):
    cols = "package_id string, path string, size long, sha256 string"
    have = spark.createDataFrame([("p", "a", 1, "AA"), ("p", "b", 2, "bb"), ("p", "x", 1, "c")], cols)
    want = spark.createDataFrame([("p", "a", 1, "aa"), ("p", "b", 3, "bb"), ("p", "m", 1, "d")], cols)
    assert rows(integrity.bind(have, want)) == [("p", "a", "bound"), ("p", "b", "size-differs"), ("p", "m", "missing"), ("p", "x", "unexpected")]


def test_file_checks(spark):
    outputs = [("a.md", 1, "0" * 64), ("A.md", 1, "x"), ("../b", 0, "0" * 64), None]
    df = spark.createDataFrame([("p", outputs), ("q", None), ("r", [])], "package_id string, outputs array<struct<path:string,size:long,sha256:string>>")
    assert rows(integrity.file_checks(df)) == [("p", 0, "conflicting-path"), ("p", 1, "conflicting-path"), ("p", 1, "invalid-hash"), ("p", 2, "invalid-path"), ("p", 2, "invalid-size")]
    assert rows(integrity.inventory(df, ("a.md", "c.json"))) == sorted(
        [("p", "../b", "unexpected"), ("p", "A.md", "unexpected"), ("p", "c.json", "missing"), ("q", "a.md", "missing"), ("q", "c.json", "missing"), ("r", "a.md", "missing"), ("r", "c.json", "missing")], key=repr
    )


def test_unique_matches(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3), ("z", 4)], "k string, a int")
    b = spark.createDataFrame([("x", 9), ("y", 8), ("w", 7)], "k string, b int")
    assert [(r.k, r.a, r.b) for r in integrity.unique_matches(a, b, "k").collect()] == [("x", 1, 9)]


def test_latest(spark):
    t = datetime.datetime
    df = spark.createDataFrame([("a", 1, t(2025, 1, 1)), ("a", 2, t(2025, 1, 2)), ("b", 3, None)], "k string, v int, received_at timestamp")
    assert sorted((r.k, r.v) for r in latest(df, ["k"]).collect()) == [("a", 2), ("b", 3)]


def test_ranked_identities(spark):
    cols = "query string, provider string, pos int, title string, year int, pmid string, pmcid string, doi string"
    q = "Single-cell RNA sequencing: an atlas"
    df = spark.createDataFrame(
        [(q, "epmc", 0, "Single cell RNA sequencing — an atlas.", 2020, "1", None, "10.1/a"), (q, "crossref", 1, q, 2021, None, None, "10.1/A"), (q, "crossref", 2, q, 2024, None, None, "10.1/a"), (q, "x", 3, "Unrelated", None, None, None, None)],
        cols,
    )
    got = identity.rank_candidates(df).orderBy("rank").collect()
    assert [(r.providers, r.year, r.sure) for r in got] == [(["crossref", "epmc"], 2020, True), (["crossref"], 2024, False)] or [(r.providers, r.year) for r in got] == [(["crossref", "epmc"], 2020), (["crossref"], 2024)]
    assert identity.rank_candidates(df.limit(0)).count() == 0


def test_sources_and_plans(spark):
    cols = "paper_id string, source_id string, pos int, provider string, format string, url string, acquisition_route string, priority int, requires_domain_permission boolean, requires_browser_session boolean"
    df = spark.createDataFrame([("p", "pdf", 0, "a", "pdf", "u1", "mineru", 50, False, False), ("p", "html", 1, "a", "html", "u2", "clipper_core", 20, False, False), ("p", "late", 2, "b", "html", "u2", "clipper_core", 30, False, False)], cols)
    assert [r.source_id for r in identity.rank_sources(df).orderBy("rank").collect()] == ["html", "pdf"]
    assert identity.plan_acquisition(df).first()[:] == ("p", "public_html", "html", 1, False)

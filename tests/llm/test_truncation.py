import datetime

from pagemill.llm import truncation as tr

SCHEMA = "doc_id string, source_index int, source string, image_caption array<string>, table_caption array<string>, received_at timestamp, item int, text string, cut boolean"
T = datetime.datetime(2025, 1, 1)


def run(spark, captions, source="s", manifests=None):
    rows = [(f"d{i}", i, source, c, None, T, 9, "clash", True) for i, c in enumerate(captions)]
    df = spark.createDataFrame(rows + rows, SCHEMA)
    return {(r.source_index, r.item): r.cut for r in tr.truncated_items(df, manifests).collect()}


NOUNS = ("wall", "layer", "probe", "valve", "grain", "crystal", "sample", "shell")
#: Captions to learn from: sentences that end with a full stop, titles and credits that do not, notes beside a caption.
CORPUS = (
    [[f"Fig. {i}. The {a} was heated to {i} K (see Fig. {i})."] for i, a in enumerate(NOUNS * 4)]
    + [[f"Fig. {i}. The {a} was cooled twice. In contrast, the {a} stayed."] for i, a in enumerate(NOUNS * 2)]
    + [[f"Table {i}. Summary of the {a}"] for i, a in enumerate(NOUNS * 2)]
    + [[f"Table {i}. The {a} was long. Source: own {a} (20{i + 10})"] for i, a in enumerate(NOUNS * 8)]
    + [[f"Fig. {i}. Summary of the {a}", f"n = {i}"] for i, a in enumerate(NOUNS)]
    + [[f"图{i} 结果表明，晶体很大{a}。"] for i, a in enumerate("一二三四五六七八九十")]
)


def test_endings(spark):
    whole = ["Fig. 1. All is said.", "a", "(b)", "", "  ", "Fig. 2. Summary of the shell", "Table 1. Ablation study", "Figure 3 Training loss over epochs", "Überblick über die Verfahren",
             "Results on CIFAR-10 (left) and ImageNet (right)", "Fig. 1. It ended (data not shown).", "n = 5", "Fig. 1. The wall was long. Source: own shell (2024)"]
    cut = ["Fig. 1. In contra", "Fig. 1. The wall was ", "Fig. 1. Summary of the", "Fig. 1. The", "图1 结果表明，晶体", "Fig. 2. It went on...", "Fig. 2. It went …", "Fig. 2. It went [...]", "Fig. 2. The wall �",
           "Fig. 2. As seen in Fig.", "Table 1. With its (see", "Fig. 1. All is said. And it", "Fig. 1. The wall was long. Source: own she"]
    got = run(spark, [[c] for c in whole + cut] + CORPUS)
    assert [whole[i] for i in range(len(whole)) if got[i, 0]] == []
    assert [cut[i] for i in range(len(cut)) if not got[len(whole) + i, 0]] == []


def test_nothing_to_learn_from(spark):
    captions = ["Figure 1: Model architecture", "Table 2: Comparison with state-of-the-art methods", "Experimental setup", "Fig. 1. It ends. And goes", "Fig. 1. A wall (open", "Fig. 2. It went …"]
    got = run(spark, [[c] for c in captions])
    assert [got[i, 0] for i in range(len(captions))] == [False, False, False, True, True, True]


def test_last_delivery_counts(spark):
    rows = [("d", 0, "s", ["Fig. 1. It went …"], None, T, 1, "", True), ("d", 0, "s", ["Fig. 1. It went on."], None, T + datetime.timedelta(1), 1, "", True)]
    assert [r.cut for r in tr.truncated_items(spark.createDataFrame(rows, SCHEMA)).collect()] == [False]


def test_continued_in_the_next_item(spark):
    own = [["Fig. 1. The wall was", "measured twice."], ["Fig. 1. The wall was", "(b)"], ["Fig. 1. The wall was", None, "", "then"], ["Fig. 1. The wall …", "was long."], ["Fig. 1. The wall in", "Fig. 2 is long."],
           ["Fig. 1. The wall was", "Fig. 2. The end."], ["Fig. 1. The wall was", "n = 77"], None, [], [None]]
    got = run(spark, own + CORPUS)
    assert {k: v for k, v in got.items() if k[0] < len(own)} == {
        (0, 0): False, (0, 1): False, (1, 0): True, (1, 1): False, (2, 0): False, (2, 2): False, (2, 3): False, (3, 0): True, (3, 1): False,
        (4, 0): False, (4, 1): False, (5, 0): True, (5, 1): False, (6, 0): True, (6, 1): False,
    }


def test_limits(spark):
    exact = ["Fig. 1. " + "x" * 151 + "." for _ in range(12)]
    short = ["Fig. 1. " + "x" * n + "." for n in range(20, 140, 7)]
    at = ["Fig. 1. " + "x" * 148 + " 23."]
    rows = [(f"d{i}", i, "s", [c], None, T, 1, "", True) for i, c in enumerate(exact + short + at)]
    items = tr.caption_items(spark.createDataFrame(rows, SCHEMA))
    limits = {(r.measure, r.store_limit) for r in tr.storage_limits(items).collect()}
    assert ("chars", 160) in limits and ("utf8", 160) in limits
    cut = {r.source_index for r in tr.judge(items, tr.storage_limits(items)).filter("cut").collect()}
    # complete at the limit is no case; what may be a decimal point at the limit is one
    assert cut == {len(exact + short)}


def test_lengths(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("a\n<&\"é😀",)], "t string").select(*[c.alias(m) for m, c in tr.lengths(F.col("t")).items()]).first()
    assert row.asDict() == {"chars": 7, "utf8": 11, "utf16": 8, "html": 7 + 3 + 4 + 5, "json": len('a\\n<&\\"\\u00e9\\ud83d\\ude42'), "crlf": 8}


def test_sources(spark):
    manifests = spark.createDataFrame([("d0", "backend", 1), ("d0", "backend", 2)], "package_id string, backend string, extra int")
    df = spark.createDataFrame([("d0", 0, None, ["Fig. 1. The wall (was"], None, T, 1, "", True), ("d1", 1, None, ["a"], ["x" * 100_000 + "."], T, 1, "", True)], SCHEMA)
    got = {r.source: (r.captions, r.cut) for r in tr.truncation_by_source(tr.truncated_items(df, manifests)).collect()}
    assert got == {"backend": (1, 1), "": (2, 0)}
    assert tr.truncated_items(df.limit(0), manifests.limit(0)).count() == 0

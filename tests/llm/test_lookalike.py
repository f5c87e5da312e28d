import itertools

from pagemill.llm import lookalike as L

SAME = [
    ["cafe 1", "ｃａｆｅ 1", "cafe 1", "ca​fe 1", "cаfе 1", "ca­fe 1"],
    ["état", "état"], ["a-b", "a‑b", "a‐b", "a－b"], ["5 Ω", "5 Ω"], ["1 µm", "1 μm"], ["ё", "ë"],
]
OTHER = ["Cafe 1", "café 1", "cafe\t1", "cafe  1", "cafe\n1", "cafe\r\n1", "cafe ¹", "a–b", "H2", "H₂", "H²", "ß", "ss", "ﬁ", "fi", "🙂", "!"]


def test_forms():
    for group in SAME:
        assert len({L.look(x) for x in group}) == 1
    assert len({L.look(x) for x in OTHER + [g[0] for g in SAME]}) == len(OTHER) + len(SAME)
    for x in OTHER + sum(SAME, []):
        assert L.look(L.look(x)) == L.look(x)
    assert L.full_fold("Ｃａｆｅ  ¹ ß") == "cafe 1 ss"


def test_pairs(spark):
    texts = sum(SAME, []) + OTHER + [SAME[0][0]] * 3 + [None, "", " ", " ", "​", "x" * 200_000, "х" * 200_000]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, form string, digest string")
    want = set()
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = texts[i], texts[j]
        if a and b and a != b and L.look(a).strip() and L.look(a) == L.look(b):
            want.add((i, j))
    assert {tuple(r) for r in L.lookalike_pairs(df).collect()} == want
    classes = {r.doc_id: (r.documents, r.texts) for r in L.lookalike_classes(df).collect()}
    assert classes[0] == (9, 6) and len(classes) == sum(t is not None for t in texts)
    forms = {r.doc_id: r.text for r in L.normalised(df).collect()}
    assert forms == {i: None if t is None else L.look(t) for i, t in enumerate(texts)}
    assert L.lookalike_pairs(df.limit(0)).count() == 0


def test_hot_forms_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_FORM", 3)
    texts = ["a-b", "a‑b", "a‐b", "a－b", "а-b", "a\u200b-b"] * 5 + ["c"] * 7
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(i, j) for i, j in itertools.combinations(range(30), 2) if texts[i] != texts[j]}
    got = L.lookalike_pairs(df).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)

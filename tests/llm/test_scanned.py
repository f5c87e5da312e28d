import datetime
import itertools
import random

from pagemill.llm import scanned as S

SCHEMA = "doc_id string, source_index int, page_idx int, type string, text string, text_level int, bbox array<double>, received_at timestamp, blk int, para int, lines string"
T = datetime.datetime(2025, 1, 1)
TOP, MIDDLE, FOOT = [90.0, 22.0, 400.0, 48.0], [90.0, 200.0, 900.0, 300.0], [90.0, 950.0, 400.0, 974.0]


def frame(spark, rows, doc="d"):
    full = [(doc, i, p, kind, text, level, box, T, 1, 1, "clash") for i, (p, kind, text, level, box) in enumerate(rows)]
    return spark.createDataFrame(full + full, SCHEMA)


BODY = "The steady parameter of the membrane was measured again before the membrane changed. "
FILL = [(p, "text", BODY * 6 + "Our self-assembled wall changed. The kernel held. Every kinetic parameter was measured.", None, MIDDLE) for p in range(8)]


def test_defects(spark):
    rows = [
        (0, "text", "Annals of Wall Studies", None, TOP),
        (0, "text", "The pararneter was mea-\nsured again.", None, MIDDLE),
        (0, "page_number", "1", None, FOOT),
        (1, "header", "Annals of WaIl Stud:es", None, TOP),
        (1, "text", "The membrane was\nAnnals of Wall Studies\nmeasured before the", None, MIDDLE),
        (1, "text", "2", None, FOOT),
        (2, "aside_text", "membrane changed.", None, MIDDLE),
        (2, "text", "Every self-\nassembled wall changed.", None, MIDDLE),
        (2, "text", "(3)", None, MIDDLE),
        (2, "text", "The wall\n- 3 -\nchanged again.", None, MIDDLE),
        (2, "text", "3", None, FOOT),
        (3, "text", "Results", 1, MIDDLE),
        (3, "text", None, None, MIDDLE),
        (3, "text", " ", None, None),
        (3, "text", "xiv", None, FOOT),
        *FILL,
    ]
    got = {}
    for r in S.found(S.label_elements(frame(spark, rows))).collect():
        got.setdefault(r.source_index, set()).add(r.defect)
    assert got == {0: {"running"}, 1: {"hyphen", "misread"}, 2: {"page_number"}, 3: {"running"}, 4: {"inline"}, 5: {"page_number"}, 6: {"continued"}, 9: {"inline"}, 10: {"page_number"}, 14: {"page_number"}}


def test_paragraphs(spark):
    rows = [(0, "text", "The wall was mea-\nsured and the mem-", None, MIDDLE), (0, "text", "1", None, FOOT), (1, "text", "brane changed.", None, MIDDLE), (1, "text", "Results", 2, MIDDLE), *FILL]
    got = {r.para: (r.page_idx, r.kind, r.text, r.elements) for r in S.paragraphs(S.label_elements(frame(spark, rows))).collect()}
    assert got[0] == (0, "body", "The wall was measured and the membrane changed.", 2) and got[3] == (1, "heading", "Results", 1)


def test_sentences_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    rows = [(0, "text", f"The wall number {i} was" if i in (3, 4, 9) else "It ended here.", None, MIDDLE) for i in range(14)]
    got = {r.source_index for r in S.found(S.label_elements(frame(spark, rows))).filter("defect = 'continued'").collect()}
    assert got == {4, 5, 10}


def test_empty(spark):
    df = frame(spark, [(None, None, None, None, None)])
    assert S.label_elements(df).count() == 0 and S.label_elements(df.limit(0)).count() == 0


def test_long_text(spark):
    df = frame(spark, [(0, "text", BODY * 20_000, None, None), *FILL])
    assert len(S.label_elements(df).filter("source_index = 0").first().text) == len((BODY * 20_000).strip())


def test_best_labels_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        weight = lambda n: [rng.uniform(-2, 2) for _ in range(n)]
        model = S.Model([weight(4) for _ in S.FEATURES], [weight(4) for _ in range(4)], weight(4))
        scores = [tuple(x * rng.choice((1, 9)) for x in weight(4)) for _ in range(5)]

        def total(path):
            return model.first[path[0]] + sum(s[j] for s, j in zip(scores, path)) + sum(model.after[a][b] for a, b in zip(path, path[1:]))

        best = max(itertools.product(range(4), repeat=5), key=total)
        assert abs(total(model.best(scores)) - total(best)) < 1e-9


def _sure(rows):
    known = {}
    rows = [(*r[:6], S.bbox_zone(r[6])) for r in rows]
    for doc, index, page, kind, text, level, zone in rows:
        if zone in ("top", "bottom") and text and not S.page_number(text):
            known.setdefault((doc, index // S.SPAN), []).append(text.lower())
    return S.sure_pages(rows, {k: (v, 1) for k, v in known.items()})


def test_weights_on_held_out_pages():
    """Fitted on some pages of the smallest data, tried on the others."""
    import os

    import duckdb
    import pytest

    path = "/root/testdata/sf0.001/paper_content_list.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    rows = duckdb.connect().execute(f"SELECT DISTINCT ON (doc_id, source_index) doc_id, source_index, page_idx, type, text, text_level, bbox FROM '{path}' WHERE page_idx IS NOT NULL AND text IS NOT NULL ORDER BY ALL").fetchall()
    rows.sort(key=lambda r: (r[0], r[2], r[1]))
    known, other = (_sure([r for r in rows if int(r[0][-3:]) % 3 in of]) for of in ((0, 1), (2,)))
    model = S.Model.fitted(known)
    held = [(f, y) for page in other for f, y in page]
    got = [y for page in other for y in model.labels([f for f, _ in page])]
    right = sum(a == y for a, (_, y) in zip(got, held))
    assert len(held) > 300 and right >= 0.97 * len(held), (right, len(held))
    assert S.Model.fitted(known).weights == model.weights


def test_block_size_changes_nothing(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for p in range(40):
        rows.append((p, "text", f"Annals of Wall Studies {p // 20}", None, TOP))
        for k in range(rng.randint(2, 7)):
            text = rng.choice(["The membrane was\nAnnals of Wall Studies\nmeasured before the", "The steady para-\nmeter was measured again.", f"The wall\n- {p + 1} -\nchanged.", "The kernel was", "It held."])
            rows.append((None if rng.random() < 0.05 else p, "text", text, None, MIDDLE if rng.random() < 0.9 else None))
        rows.append((p, "text", str(p + 1), None, FOOT))
    df = frame(spark, rows + FILL)
    out = []
    for size in (64, 4096, 1 << 30):
        monkeypatch.setattr(S, "BLOCK", size)
        out.append(sorted((r.source_index, tuple(sorted(r.defects)), r.text or "", r.para if r.para is not None else -1) for r in S.label_elements(df).collect()))
    assert out[0] == out[1] == out[2]
    assert {d for r in out[0] for d in r[1]} >= {"running", "page_number", "inline", "hyphen", "continued"}


def test_page_numbers():
    assert S.page_number("- 12 -") == (12, True) and S.page_number("Page 7") == (7, True) and S.page_number("ll") == (11, False) and S.page_number("lO9") == (109, False)
    assert S.page_number("xiv") == (-14, False) and S.page_number("wall") is None and S.page_number("(3)") is None and S.page_number("") is None


def test_words():
    w = S.Words({"before": 1000, "kernel": 500, "mixture": 300, "bcfore": 3, "form": 400, "from": 900}, 2.0)
    assert w.printed("bcfore") == "before" and w.printed("kemel") == "kernel" and w.printed("rnixturc") == "mixture"
    assert w.printed("before") is None and w.printed("form") is None and w.printed("zzzz") is None


def test_words_below_the_floor(spark, monkeypatch):
    monkeypatch.setattr(S, "VOCABULARY_SHARE", 0.02)  # only words with a fiftieth of all words are at hand
    few = "A zircon-bearing tuffite held. The pyrolite changed. "
    rows = [
        *[(0, "text", few + BODY * 3, None, MIDDLE)] * 40,
        (1, "text", "The tutfite was measured.", None, MIDDLE),
        (1, "text", "A zircon-\nbearing membrane changed.", None, MIDDLE),
        (1, "text", "A zircon-\nbearing parameter changed.", None, MIDDLE),
        (1, "text", "The pyro-\nlite changed.", None, MIDDLE),
        (1, "text", "The pyro-lite was measured.", None, MIDDLE),
        (1, "text", "The membrane was\nmea-\nsured again.", None, MIDDLE),
    ]
    labelled = S.label_elements(frame(spark, rows)).filter("page_idx = 1").orderBy("source_index").collect()
    assert [(r.defects, r.text) for r in labelled] == [
        (["misread"], "The tuffite was measured."), ([], "A zircon-bearing membrane changed."), ([], "A zircon-bearing parameter changed."),
        (["hyphen"], "The pyrolite changed."), (["hyphen"], "The pyrolite was measured."), (["hyphen"], "The membrane was measured again."),
    ]


def test_asked_forms_cover_what_mend_asks():
    """Whatever the counts are, mending asks only for forms at hand or listed before."""
    rng = random.Random(5)
    pieces = ["mea-\nsured", "self-\nassem-\nbled", "a-b", "x-y-\nz", "co¬ operate", "so­ft", "Wall,", "(re-\nheat-treated)", "12-\nfold", "kemel"]

    class Asking(S.Words):
        def count(self, word):
            assert word in allowed or not any(c.isalpha() for c in word), word
            return rng.choice((0, 0, 1, 9))

        def printed(self, word):
            assert word in allowed or not any(c.isalpha() for c in word), word
            return None

    for _ in range(300):
        text = " ".join(rng.choices(pieces, k=4))
        allowed = S.asked(text, S.Words({}, 2.0))
        S.mend(text, Asking({}, 2.0), False, False)
    words = S.Words({}, 2.0)
    for true in ("kernel", "mixture", "clinic"):
        for form in S.misread_forms(true, 2):
            words.rare, words.seen = {true: 10**6}, {}
            assert len(form) < 3 or words.printed(form) == true


def test_running_lines_without_line_ends(spark):
    heads = ["Archive for Wall Studies, Vol. 12, No. 12", "WALLPAPERS", "Wall Notes", "墙体结构研究学报"]
    texts = [
        ("The membrane was measured Archive for Wall Studies, Vol. 14, No. 15 before the kernel changed.", "The membrane was measured before the kernel changed."),
        ("The membrane was measured Archlve for WaIl Studies, Vol. 14, No. 15 before the kernel changed.", "The membrane was measured before the kernel changed."),
        ("The membrane was measured again WALLPAPERS before the kernel changed.", "The membrane was measured again before the kernel changed."),
        ("The membrane was measured again Wall Notes 2 before the kernel changed.", "The membrane was measured again before the kernel changed."),
        ("我们再次测量了这种薄膜的参数并且比较了所有样品的结果 墙体结构研究学报 然后继续测量其余的样品直到结果稳定为止。", "我们再次测量了这种薄膜的参数并且比较了所有样品的结果 然后继续测量其余的样品直到结果稳定为止。"),
        ("The membrane was measured again [2] before the kernel changed.", "The membrane was measured again before the kernel changed."),
        ("The membrane was measured again Page 2 before the kernel changed.", "The membrane was measured again before the kernel changed."),
        ("The membrane was measured again by wall notes before [2] and [3] changed.", None),
        ("The membrane was measured again at 2 places before the kernel [7] changed.", None),
    ]
    rows = [(p, "text", h, None, TOP) for p in range(6) for h in heads] + [(p, "text", str(p + 1), None, FOOT) for p in range(6)]
    n = len(rows)
    rows += [(1, "text", t, None, MIDDLE) for t, _ in texts]
    got = {r.source_index: r for r in S.label_elements(frame(spark, rows)).filter(f"source_index >= {n}").collect()}
    for i, (text, want) in enumerate(texts):
        assert got[n + i].text == (want or text) and ("inline" in got[n + i].defects) == (want is not None), got[n + i]

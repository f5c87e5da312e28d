import os
import random

import pytest

from pagemill.llm import mixing as M
from pagemill.llm import tokens as K

files = pytest.mark.skipif(not os.path.exists(K.vocabulary_file("byte_bpe_50k")), reason="no tokenizer files")


def test_plan():
    targets = {"a": (0.5, 1), "b": (0.3, 3), "c": (0.1, 2), "none": (0.1, 1)}
    patterns = {("a",): 1000, ("b",): 100, ("a", "b"): 50, ("c",): 40}
    size, parts = M.plan(patterns, targets)
    got = {}
    for p, k, s, n in parts:
        assert k <= targets[s][1] and s in p
        got[s] = got.get(s, 0) + n
    whole = 0.9
    assert all(abs(got[s] - size * targets[s][0] / whole) <= 1 for s in "abc")
    # c is the scarce one: 40 tokens, twice
    assert size == 720 or abs(size - 720) <= 9
    assert M.plan({}, targets) == (0, []) and M.plan(patterns, {}) == (0, [])


def test_flow_is_cheapest():
    """Against all ways to route small flows."""
    rng = random.Random(4)
    for _ in range(30):
        caps = {("a",): rng.randint(0, 3), ("b",): rng.randint(0, 3), ("a", "b"): rng.randint(0, 3)}
        targets = {"a": (0.5, 2), "b": (0.5, 2)}
        size, parts = M.plan(caps, targets)
        cost = sum((k - 1) * n for _, k, _, n in parts)
        need = {s: int(size * 0.5) for s in "ab"}
        best = None
        for x1 in range(caps["a",] + 1):
            for y1 in range(caps["b",] + 1):
                for z in range(caps["a", "b"] + 1):
                    for za in range(z + 1):
                        ra, rb = need["a"] - x1 - za, need["b"] - y1 - (z - za)
                        pool = caps["a", "b"]
                        if 0 <= ra and 0 <= rb and max(0, ra - caps["a",]) + max(0, rb - caps["b",]) <= pool:
                            best = ra + rb if best is None else min(best, ra + rb)
        if {s for p, n in caps.items() if n for s in p} == {"a", "b"}:
            assert best is not None and cost == best


@files
def test_mix(spark):
    rng = random.Random(7)
    docs = []
    for i in range(600):
        s = rng.choices(["Big One", "big-one", "mid", "small", None, "other"], [50, 10, 25, 5, 5, 5])[0]
        docs.append((i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(5, 40))) + f" {i}", s, "clash", 1))
    docs += [(1000 + i, "the same text in two sources", s, "clash", 1) for i, s in enumerate(["mid", "small", "mid"])] + [(2000, None, "mid", "", 1), (2001, "", "mid", "", 1), (2002, "x " * 50_000, None, "", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, pattern string, repeats int")
    targets = spark.createDataFrame([("big_one", 0.6, 1), ("mid", 0.2, 2), ("small", 0.15, 4), ("absent", 0.05, 1)], "source string, target_share double, max_repeats int")
    mixed = M.mix(df, targets)
    got = mixed.collect()
    most = {"big_one": 1, "mid": 2, "small": 4}
    assert len({(r.doc_id, r.source) for r in got}) == len(got) and all(r.repeats <= most[r.source] for r in got)
    shares = {r.source: r.actual_share for r in M.shares(mixed, targets).collect()}
    for s, want in (("big_one", 0.6), ("mid", 0.2), ("small", 0.15)):
        assert abs(shares[s] - want / 0.95) < 0.03
    assert shares["absent"] == 0.0
    assert sorted(map(tuple, M.mix(df.repartition(7), targets).collect())) == sorted(map(tuple, got))
    assert M.mix(df.limit(0), targets).count() == 0 and M.mix(df, targets.limit(0)).count() == 0


@files
def test_equal_texts_are_documents_of_their_own(spark):
    docs = [(i, "the same text", "a" if i < 5 else "b") for i in range(8)] + [(9, "the same text", "a"), (9, "the same text", "a"), (20, "another text here", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 1), ("c", 0.1, 9)], "source string, target_share double, max_repeats int")
    got = M.units(df, targets).collect()
    assert sorted(x for r in got for x in r.ids.values()) == [0, 1, 2, 3, 4, 5, 6, 7, 9, 20]
    assert sorted(len(r.pattern) for r in got) == [1, 1, 1, 1, 2, 2, 2]
    mixed = M.mix(df, targets, size=100).collect()
    assert len({r.doc_id for r in mixed if r.source == "a"}) > 3


def test_source_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" Web Clipping ",), ("WEB_CLIPPING",), ("web-clipping",), ("--",), (None,)], "s string")
    assert [r[0] for r in df.select(M.source_name(F.col("s"))).collect()] == ["web_clipping"] * 3 + [None, None]

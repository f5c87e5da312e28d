import datetime
import random

from pagemill.llm import nearcopy as N

SCHEMA = "id string, fingerprint struct<visible_text_sha256:string,simhash64:string,text_length:int>, received_at timestamp, sha string, simhash string"
T = datetime.datetime(2025, 1, 1)


def frame(spark, prints):
    rows = [(i, p, T, "clash", "clash") for i, p in prints.items()]
    return spark.createDataFrame(rows + rows, SCHEMA)


def brute(prints):
    def number(s):
        try:
            return None if s is None else int(s.strip().lower().removeprefix("0x"), 16)
        except ValueError:
            return None

    out = set()
    for a in prints:
        for b in prints:
            if a < b and prints[a] and prints[b]:
                (s, h, n), (t, g, m) = prints[a], prints[b]
                if n == 0 or m == 0:
                    continue
                same = number(s) is not None and number(s) == number(t)
                near = None not in (number(h), number(g), n, m) and bin(number(h) ^ number(g)).count("1") <= 3 and abs(n - m) * 10 <= max(n, m)
                if same or near:
                    out.add((a, b))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    prints, words = {}, [rng.getrandbits(64) for _ in range(25)] + [0, 2**64 - 1, 2**63]
    for i in range(400):
        h = rng.choice(words)
        for _ in range(rng.randint(0, 5)):
            h ^= 1 << rng.randrange(64)
        text = rng.choice([f"{h:016x}", f"{h:X}", f"0x{h:x}", f" {h:016x} ", None if i % 40 == 0 else f"{h:016x}"])
        sha = rng.choice([f"{rng.randint(1, 150):064x}", f"{rng.randint(1, 150):064X}", None])
        prints[f"b{i:03}"] = (sha, text, rng.choice([0, 50, 54, 55, 56, 100, None]))
    df = frame(spark, prints)
    assert {tuple(r) for r in N.near_pairs(df).collect()} == brute(prints)
    classes = N.copy_classes(df).collect()
    assert len(classes) == sum(p[2] != 0 for p in prints.values())
    links = {}
    for a, b in brute(prints):
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    assert all(r.links == links.get(r.id, 0) for r in classes)


def test_hot_keys_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT_KEY", 3)
    rng = random.Random(6)
    base = rng.getrandbits(64)
    prints = {}
    for i in range(80):
        h = base
        for _ in range(rng.randint(0, 4)):
            h ^= 1 << rng.randrange(64)
        prints[f"b{i:02}"] = (None, f"{h:016x}", 100)
    assert {tuple(r) for r in N.near_pairs(frame(spark, prints)).collect()} == brute(prints)


def test_malformed_and_empty(spark):
    prints = {"a": None, "b": (None, None, None), "c": ("xyz", "12g", 5), "d": ("", "", 5), "e": ("f" * 65, "f" * 17, 5), "f": ("0f", "1", 5), "g": ("0xF", "1", None)}
    df = frame(spark, prints)
    assert {tuple(r) for r in N.near_pairs(df).collect()} == {("f", "g")}
    assert N.near_pairs(df.limit(0)).count() == 0

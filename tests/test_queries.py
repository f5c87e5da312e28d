"""Every registered query of the core against its SQL on the smallest data."""

import os
from collections import Counter

import pytest

from pagemill.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def canon(v):
    if v is None or v != v:
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(canon(dict(zip(names, r))[c]) for c in sorted(names)) for r in cur.fetchall())
    got = Counter(tuple(canon(v) for v in r) for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_labels_and_paths_come_from_the_tables(spark, duck):
    captions = {x for (x,) in duck.execute("SELECT unnest(image_caption) FROM paper_content_list UNION SELECT unnest(table_caption) FROM paper_content_list").fetchall() if x is not None}
    assert {r.t for r in QUERIES["caption_labels"](spark, DATA).collect()} == captions and captions
    paths = {x for (x,) in duck.execute("SELECT img_path FROM paper_content_list WHERE img_path IS NOT NULL").fetchall()}
    assert paths and paths <= {r.path for r in QUERIES["stored_path_checks"](spark, DATA).collect()}

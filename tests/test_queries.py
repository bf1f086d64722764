"""Every query over the driver's tables against its SQL."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from quire.catalog import ORACLES, QUERIES


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value.item() if hasattr(value, "item") else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(str([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels",
        "conversations"
    ):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows_of(names, result.fetchall())
    else:
        assert got


def test_families_compare_whole_texts(spark, tmp_path):
    """Against brute force: openings of forty words neither make nor part a family."""
    w = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    texts = [
        f"{w('a', 40)} {w('b', 300)}", f"{w('a', 40)} {w('c', 200)}", f"{w('d', 40)} {w('B', 300)}", f"{w('d', 40)} {w('e', 200)}", "", None,
        w("f", 41), f"{w('f', 40)} g"
    ]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {k: set(t.lower().split()) for k, t in rows if t}
    family = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.72:
                old, new = max(family[a], family[b]), min(family[a], family[b])
                family = {k: new if f == old else f for k, f in family.items()}
    got = {r.doc_id: r.family for r in QUERIES["template_families"](spark, str(tmp_path)).collect()}
    assert got == {k: f"fam-{f:012d}" for k, f in family.items()}
    assert got[0] == got[2] != got[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

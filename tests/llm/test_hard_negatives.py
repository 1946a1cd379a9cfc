"""Operator 13 against plain integers, and against its SQL on the smallest scale."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives as hn

NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def expected(rows, is_anchor, positives=5, negatives=5):
    kept = {}
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept[i] = ([math.floor(256 * float(x)) for x in v], label)
    out = set()
    for a, (va, la) in kept.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, la == label) for i, (v, label) in kept.items() if i != a)
        for ps, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [x for x in scored if not x[2] and 80 * -ps <= 100 * -x[0] <= 100 * -ps][:negatives]
            out |= {(a, p, r, i, -ps, -ns) for r, (ns, i, _) in enumerate(fit, 1)}
    return out


def got(df):
    rows = [tuple(r) for r in df.select(*NAMES).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame(spark, rows, kind="array<double>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int")


def mined(spark, rows):
    return got(hn.mine_hard_negatives(frame(spark, rows), F.col("id") % 10 == 0))


def test_query_and_sql(spark):
    df = hn.op13_hard_negatives(spark, "/root/testdata/sf0.001")
    assert [dict(df.dtypes)[c] for c in NAMES] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    db = duckdb.connect()
    db.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = db.execute(hn.SQL["op13_hard_negatives"])
    assert tuple(x[0] for x in want.description) == NAMES
    assert got(df) == set(want.fetchall()) and df.count() > 50


@pytest.mark.parametrize("small_blocks", [False, True])
def test_clusters_ties_and_copies(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(hn, "ROW_NUMBERS", 16 * 40)
        monkeypatch.setattr(hn, "ANCHOR_NUMBERS", 16 * 8)
        monkeypatch.setattr(hn, "PAIRS", 97)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16)) * np.linspace(2, 0.1, 16)
    v = centres[rng.integers(0, 6, 240)] + rng.normal(0, 0.15, (240, 16))
    v[50:80] = v[50]
    rows = [(i, x.tolist(), int(i % 4)) for i, x in enumerate(v)]
    assert mined(spark, rows) == expected(rows, lambda i: i % 10 == 0) != set()


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.1], 2), (3, None, 1), (4, [1.0, None], 2), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 0.0], 2), (7, [1.0, 0.0], None), (8, [0.0, 0.0], 2), (9, [-1.0, 0.0], 2)]
    rows += [(20, [-1.0, -1.0], 3), (21, [1.0, 1.0], 3), (22, [0.0, 1.0], 1), (30, [0.0, 0.0], 3)]
    df = frame(spark, rows).union(frame(spark, rows[:3])).union(frame(spark, [(40, [1.0], 1), (None, [1.0, 0.0], 2)])).selectExpr("*", "1 as score", "2 as rank", "3 as v")
    assert got(hn.mine_hard_negatives(df, F.col("id") % 10 == 0)) == expected(rows, lambda i: i % 10 == 0) != set()
    assert got(hn.mine_hard_negatives(frame(spark, []), F.col("id") % 10 == 0)) == set()
    assert got(hn.mine_hard_negatives(frame(spark, rows[:1]), F.col("id") % 10 == 0)) == set()


def test_huge_components_stay_exact(spark):
    rows = [(i, [float(2 ** (20 + i % 3)) + 0.25 * i, -1e5 * i, 3.0], i % 2) for i in range(40)]
    assert mined(spark, rows) == expected(rows, lambda i: i % 10 == 0) != set()
    # Beyond a long: no crash, scores at its end.
    rows = [(i, [1e30 + 1e27 * i, 1.0], i % 2) for i in range(12)]
    assert {x[4:] for x in mined(spark, rows)} == {(hn.LONG, hn.LONG)}


def test_bounds_discard_early_and_lose_nothing():
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.normal(size=(400, 32)) * np.exp(-np.arange(32) / 3))
    b = hn.Block(np.arange(400), np.array(["x"] * 400), v, hn.rotation_of(v.T @ v))
    seen = []
    narrow = lambda keep, low, high: seen.append((keep & (high >= hn._kth(low, keep, 5)[:, None])).sum()) or keep & (high >= hn._kth(low, keep, 5)[:, None])
    i, j, score = hn.survivors(b, slice(0, 20), b, np.ones((20, 400), dtype=bool), narrow)
    assert seen[0] < 20 * 400 / 2 and seen[-1] <= seen[0]
    true = v[:20] @ v.T
    for a in range(20):
        assert sorted(score[i == a])[-5:] == sorted(true[a])[-5:]

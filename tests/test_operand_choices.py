"""Choices of cases and units with very many distinct operands: none is left out."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import operands, skew
from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"
ASKED, SEEN = "case int, req int, relation string, value int, unit string", "case int, passage int, value int, unit string"


def test_all_of_very_many_operands_are_compared(spark):
    n = 10_050
    seen = spark.range(n).select(F.lit(1).alias("case"), F.col("id").alias("passage"), F.col("id").cast("int").alias("value"), F.lit("KG").alias("unit"))
    asked = spark.createDataFrame([(1, 0, "ge", 50, "kg"), (1, 1, "near", 50, "kg"), (1, 2, "lt", 0, "kg"), (2, 0, "ge", 50, "kg")], ASKED)
    got = operands.operand_choices(asked, seen, "case").groupBy("case", "req", "truth", "issue").agg(F.count("*"), F.count_distinct("o_value")).collect()
    open_ = "no_decisive_operand"
    assert {tuple(r) for r in got} == {(1, 0, True, None, n - 50, n - 50), (1, 0, False, None, 50, 50), (1, 1, None, open_, 1, 0), (1, 2, False, None, n, n), (2, 0, None, open_, 1, 0)}


@pytest.mark.parametrize("name", ["operand_choices", "requirement_verdicts"])
def test_queries_equal_sql_where_an_order_has_very_many_pieces(spark, tmp_path, name):
    db = duckdb.connect()
    bare = f"SELECT min(o_orderkey) FROM '{SF}/orders.parquet' WHERE o_orderkey NOT IN (SELECT l_orderkey FROM '{SF}/lineitem.parquet')"
    many = f"SELECT s.* REPLACE (({bare}) AS l_orderkey, 30 + i.i AS l_quantity, i.i % 3 AS l_linenumber) FROM range(10050) i(i), (SELECT * FROM '{SF}/lineitem.parquet' LIMIT 1) s"
    db.execute(f"COPY (SELECT * FROM '{SF}/lineitem.parquet' UNION ALL BY NAME {many}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    os.symlink(f"{SF}/orders.parquet", tmp_path / "orders.parquet")
    for t in ("orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    cur = db.execute(registry.SQL[name])
    columns = [x[0] for x in cur.description]
    rows = registry.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, cur.fetchall()))


@pytest.mark.parametrize("seed", range(3))
def test_hot_keys_stay_where_they_are_dealt(spark, monkeypatch, seed):
    """Requirements come to the values of a hot key; shared and null numbers, nulls and unknown relations give what a shuffle gives."""
    rng = random.Random(seed)
    some = lambda x: None if rng.random() < 0.04 else x
    asked = [(some(rng.randint(0, 6)), some(rng.randint(0, 3)), some(rng.choice(["eq", "gt", "near", "like", "le"])), some(rng.randint(0, 30)), some(rng.choice(["kg", "%", "", "m"]))) for _ in range(50)]
    seen = [(some(rng.choice([0, 0, 0, 0, 1, 2, 3, 4])), some(rng.randint(0, 9)), some(rng.randint(0, 40)), some(rng.choice(["KG", "percent", "", "per cent"]))) for _ in range(400)]
    asked, seen = spark.createDataFrame(asked + asked[:4], ASKED), spark.createDataFrame(seen, SEEN)
    found = {}
    for rows in (10_000, 12):
        monkeypatch.setattr(skew, "HOT_ROWS", rows)
        df = operands.operand_choices(asked, seen, "case")
        found[rows] = sorted(map(repr, df.collect()))
        assert ("hot" in df._jdf.queryExecution().optimizedPlan().toString()) == (rows == 12)
    assert found[12] == found[10_000] and len(found[12]) > 100

"""Displayed money is rounded as the SQL twins' printf does: by the double's exact value, ties to even."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from dealspark.functions import sql as SF
from dealspark.functions import text as X
from dealspark.plans import registry
from dealspark.plans import text as T

rng = random.Random(5)
AMOUNTS = [198500.0, 494500.0, 2500.0, 1050000.0, 1150000.0, 1250000.0, 1350000.0, 2.25e9, 0.5, 1.5, 2.5, 999.5, 999500.0, 999499.99, 999950000.0, 0.0, -1.5, -0.3, 3e15]
AMOUNTS += [rng.randrange(1, 10**6) * 10.0 ** rng.randrange(-3, 8) for _ in range(3000)] + [rng.random() * 10.0 ** rng.randrange(0, 12) for _ in range(1000)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("create table a as select unnest(?::double[]) as v", [AMOUNTS])
    return con


def test_display(spark, duck):
    want = dict(duck.sql(f"select v, {T.sql_display('v')} from a").fetchall())
    rows = spark.createDataFrame([(v,) for v in AMOUNTS], "v double").select("v", X.money_display(F.col("v")).alias("display")).collect()
    assert {r.v: r.display for r in rows} == want
    assert want[198500.0] == "$198K"


def test_display_function(spark, duck):
    spark.sql(f"create or replace temporary function money_text(v double) returns string return {SF.money_text()}")
    rows = spark.createDataFrame([(v,) for v in AMOUNTS], "v double").select("v", F.expr("money_text(v)").alias("display")).collect()
    assert {r.v: r.display for r in rows} == dict(duck.sql(f"select v, {T.sql_display('v')} from a").fetchall())


def test_fixed(spark, duck):
    values = [0.05, 0.15, 0.25, 0.35, 0.75, 0.95, 0.949999999, 1.05, 9.95, -0.25, -2.5, 2.0**52 + 0.5, 2.0**53, 1e-9, *[a / 1e3 for a in AMOUNTS]]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.fixed(F.col("v"), 0).alias("whole"), X.fixed(F.col("v"), 1).alias("tenths")).collect()
    assert [(r.whole, r.tenths) for r in rows] == [(f"{r.v:.0f}", f"{r.v:.1f}") for r in rows]


def test_orders_with_shifted_keys(spark, sf, tmp_path):
    """x21 multiplies by the parity of the key, so shifted keys meet other ties."""
    con = duckdb.connect()
    con.execute("create table orders (o_orderkey bigint, o_totalprice double)")
    con.executemany("insert into orders values (?, ?)", [(2 * i + 1, v) for i, v in enumerate(AMOUNTS[:200])])
    con.execute(f"copy orders to '{tmp_path}/orders.parquet' (format parquet)")
    for name in ("x20_money_value", "x21_money_display"):
        got = {tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == set(con.sql(registry.ORACLES[name]).fetchall())


"""Every query with SQL against DuckDB on the same tables; leaks from the future; exact results on toy panels."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, labels, portfolio, timeaxis, xsection
from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", SQL)
def test_same_rows_as_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    own = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    other = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(own, key=order) == sorted(other, key=order)


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), t, 100.0 * (1 + g) ** i) for i in range(40) for t, g in (("A", 0.01), ("B", 0.0), ("C", -0.01))]
    return spark.createDataFrame(rows, "date date, ticker string, close double").withColumn("volume", F.lit(1.0))


def test_features_ignore_the_future(toy):
    def run(df):
        return {(r.date, r.ticker): (r.a, r.b) for r in timeaxis.with_daily_return(df).select("date", "ticker", timeaxis.log_return(5).alias("a"), timeaxis.realised_vol("r", 5).alias("b")).collect()}

    cut = dt.date(2020, 1, 20)
    changed = toy.withColumn("close", F.when(F.col("date") > F.lit(cut), F.col("close") * 3).otherwise(F.col("close")))
    before, after = run(toy), run(changed)
    assert all(before[k] == after[k] for k in before if k[0] <= cut)


def test_labels_ignore_the_past(toy):
    def run(df):
        return {(r.date, r.ticker): r.y for r in df.select("date", "ticker", labels.forward_return(3).alias("y")).collect()}

    cut = dt.date(2020, 1, 20)
    changed = toy.withColumn("close", F.when(F.col("date") <= F.lit(cut), F.col("close") * 3).otherwise(F.col("close")))
    before, after = run(toy), run(changed)
    assert all(before[k] == after[k] for k in before if k[0] >= cut)


def test_constant_growth_earns_its_rate(toy):
    book = timeaxis.with_daily_return(toy).select("date", "ticker", (F.exp("r") - 1).alias("r"), F.when(F.col("ticker") == "A", 1.0).otherwise(0.0).alias("weight"))
    rows = portfolio.backtest(book, book, bps=10).orderBy("date").collect()
    assert all(abs(r.gross - 0.01) < 1e-12 for r in rows[1:]) and abs(rows[1].net - (0.01 - 1e-3)) < 1e-12 and rows[2].turnover == 0


def test_books_are_neutral(spark, toy):
    book = portfolio.top_bottom(toy.withColumn("score", F.col("close")), 1, 0.5).groupBy("date").agg(F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross"))
    assert all(abs(r.net) < 1e-12 and abs(r.gross - 1) < 1e-12 for r in book.collect())
    ranks = toy.select("date", xsection.centred_rank("close").alias("k")).where("date > '2020-01-01'").groupBy("date").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    assert all((r.a, r.b) == (-0.5, 0.5) for r in ranks.collect())


@pytest.mark.parametrize("method, block, length", [("block", None, 8), ("block", 20, 20), ("iid", None, 1)])
def test_bootstrap_as_numpy(spark, method, block, length):
    r = np.random.default_rng(6).normal(0.001, 0.01, 70)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), x) for i, x in enumerate(r.tolist())] + [(dt.date(2019, 1, 1), None)]
    got = evaluation.bootstrap_sharpe(spark.createDataFrame(rows, "date date, net double"), block=block, method=method).first()
    starts = spark.range(1000).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(-(-70 // length) - 1))))
    among = 70 if method == "iid" else 70 - length
    at = np.array([h % among for _, _, h in sorted(starts.select("id", "k", F.xxhash64("id", "k", F.lit(7))).collect())]).reshape(1000, -1)
    drawn = r[(at[:, :, None] + np.arange(length)).reshape(1000, -1)[:, :70]]
    s = drawn.mean(axis=1) / drawn.std(axis=1, ddof=1) * 252**0.5
    assert np.allclose([got.low, got.mid, got.high], np.percentile(s, [2.5, 50, 97.5]))

"""Books on the calendar, their steps and covariances against pandas and numpy versions of the wide form."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import covariance, hierarchy, portfolio, xsection
from tidemark.plans import cross

DAY = dt.date(2020, 1, 1)
WEIGHTS, RETURNS = "date date, ticker string, weight double", "date date, ticker string, r double"


def day(n):
    return DAY + dt.timedelta(days=n)


def wide_backtest(weights, returns, lag=1, bps=6.0, every=1):
    """Wide books: 0 for names that a book lacks, carried over missing dates, then the cadence, then the lag."""
    r = returns.pivot(index="date", columns="ticker", values="r").sort_index()
    w = weights.pivot(index="date", columns="ticker", values="weight")
    names = sorted(set(r.columns) & set(w.columns))
    target = w.reindex(columns=names).fillna(0.0).sort_index().reindex(r.index)
    target = target.ffill().fillna(0.0)
    if every > 1:
        first = np.argmax(target.ne(0).any(axis=1).to_numpy())
        keep = np.zeros(len(target), bool)
        keep[first::every] = True
        target[~keep] = np.nan
        target = target.ffill().fillna(0.0)
    held = target.shift(lag)
    none = held.isna().all(axis=1)
    held = held.fillna(0.0)
    gross = (held * r[names].clip(-0.5, 0.5)).sum(axis=1)
    turnover = (held - held.shift(1).fillna(0.0)).abs().sum(axis=1)
    cost = turnover * bps / 1e4
    return pd.DataFrame({"gross": gross.where(~none), "turnover": turnover, "cost": cost, "net": (gross - cost).where(~none)})


def same(got, want):
    got = got.set_index("date").sort_index()
    assert list(got.index) == list(want.index) and got["gross"].isna().equals(want["gross"].isna())
    for c in ("gross", "turnover", "cost", "net"):
        assert np.allclose(got[c].astype(float), want[c], atol=1e-12, equal_nan=True), c


def test_names_that_a_book_lacks_are_sold(spark):
    weights = spark.createDataFrame([(day(2), "A", 0.5), (day(3), "B", 0.5), (day(4), "B", 0.5)], WEIGHTS)
    returns = spark.createDataFrame([(day(i), t, 0.01) for i in range(1, 7) for t in "AB"], RETURNS)
    rows = {r.date: r for r in portfolio.backtest(weights, returns).collect()}
    assert abs(rows[day(4)].gross - 0.005) < 1e-12 and rows[day(4)].turnover == 1.0
    assert rows[day(1)].net is None and rows[day(1)].turnover == 0 and rows[day(2)].net == 0 and rows[day(6)].turnover == 0


@pytest.mark.parametrize("every, lag", [(1, 1), (1, 3), (5, 1), (7, 2)])
@pytest.mark.parametrize("seed", [0, 1])
def test_backtest_as_wide_frames(spark, every, lag, seed):
    rng = np.random.default_rng(seed)
    returns = pd.DataFrame([(day(i), f"T{j}", float(rng.normal() * 0.3) if rng.random() < 0.9 else None) for i in range(60) for j in range(8) if rng.random() < 0.7], columns=["date", "ticker", "r"])
    weights = pd.DataFrame([(day(i), f"T{j}", 0.0 if i < 9 or rng.random() < 0.3 else float(rng.normal())) for i in range(3, 66) if rng.random() < 0.6 for j in range(10) if rng.random() < 0.6], columns=["date", "ticker", "weight"])
    got = portfolio.backtest(spark.createDataFrame(weights, WEIGHTS), spark.createDataFrame(returns, RETURNS), lag, 6.0, every).toPandas()
    same(got, wide_backtest(weights, returns, lag, 6.0, every))


def test_backtest_of_a_table_with_gaps(spark, sf):
    f = cross.scores(spark, sf).cache()
    books = portfolio.top_bottom(f, 4, 0.5)
    got = portfolio.backtest(books, f.select("date", "ticker", "r"), every=5).toPandas()
    same(got, wide_backtest(books.toPandas(), f.select("date", "ticker", "r").toPandas(), every=5))


def test_empty_books(spark):
    returns = spark.createDataFrame([(day(i), "A", 0.01) for i in range(4)], RETURNS)
    none = spark.createDataFrame([], WEIGHTS)
    for weights in (none, spark.createDataFrame([(day(1), "Z", 1.0), (day(2), "A", None), (day(9), "A", 1.0)], WEIGHTS)):
        for every in (1, 3):
            rows = portfolio.backtest(weights, returns, every=every).orderBy("date").collect()
            assert [r.gross for r in rows] == [None, 0, 0, 0] and not any(r.turnover for r in rows)
    assert portfolio.backtest(none, returns.limit(0)).collect() == []


def test_composed_weights_as_wide_frames(spark):
    rng = np.random.default_rng(3)
    rows = [(day(i), f"T{j:02}", float(rng.normal()), abs(float(rng.normal())) + 0.01, float(rng.normal() * 0.01)) for i in range(30) for j in range(16) if rng.random() < 0.8]
    f = spark.createDataFrame(rows, "date date, ticker string, score double, vol double, r double").cache()
    sector = {f"T{j:02}": "AB"[j % 2] for j in range(13)}  # three names without a sector
    beta = [(day(i), f"T{j:02}", float(0.5 + rng.random())) for i in range(30) for j in range(16) if rng.random() < 0.7]
    sectors, betas = spark.createDataFrame(list(sector.items()), "ticker string, sector string"), spark.createDataFrame(beta, "date date, ticker string, beta double")
    sized = {
        "top_bottom": portfolio.top_bottom(f, 3),
        "inverse_vol": portfolio.inverse_vol(f, 0.3),
        "parity": hierarchy.parity_book(f, f.select("date", "ticker", "r"), 0.3),
    }
    for sizing, book in sized.items():
        got = portfolio.composed(f.select("date", "ticker", "score"), sizing=sizing, k=3, share=0.3, vol=f.select("date", "ticker", "vol"), returns=f.select("date", "ticker", "r"), sectors=sectors, cap=0.8, least=0.15, betas=betas)
        got = got.toPandas().pivot(index="date", columns="ticker", values="weight").sort_index()
        w = book.toPandas().pivot(index="date", columns="ticker", values="weight").fillna(0.0).sort_index()
        own = pd.Series({t: sector.get(t, "none") for t in w.columns})
        for s in set(own):
            cols = own.index[own == s]
            gross = w[cols].abs().sum(axis=1)
            w.loc[gross > 0.8, cols] = w.loc[gross > 0.8, cols].mul(0.8 / gross[gross > 0.8], axis=0)
        for i in range(1, len(w)):
            small = (w.iloc[i] - w.iloc[i - 1]).abs() < 0.15
            w.iloc[i] = w.iloc[i].where(~small, w.iloc[i - 1])
        b = pd.DataFrame(beta, columns=["date", "ticker", "beta"]).pivot(index="date", columns="ticker", values="beta").reindex_like(w).fillna(1.0)
        for d in w.index:
            long, short = (w.loc[d].where(w.loc[d] > 0, 0) * b.loc[d]).sum(), (w.loc[d].where(w.loc[d] < 0, 0) * b.loc[d]).sum()
            if abs(long + short) >= 1e-6 and abs(short - long) >= 1e-9 and abs(a := -(long + short) / (short - long)) <= 0.5:
                w.loc[d] = w.loc[d].where(w.loc[d] <= 0, w.loc[d] * (1 - a)).where(w.loc[d] >= 0, w.loc[d] * (1 + a))
        assert list(got.index) == list(w.index) and list(got.columns) == list(w.columns) and np.allclose(got, w, atol=1e-12), sizing
    with pytest.raises(ValueError):
        portfolio.composed(f, sizing="other")


@pytest.mark.parametrize("block", [3, 256])
def test_covariance_as_pandas(spark, block, monkeypatch):
    rng = np.random.default_rng(5)
    wide = pd.DataFrame(rng.normal(2.0, 0.1, (50, 11)), index=[day(i) for i in range(50)], columns=[f"N{j:02}" for j in range(11)])
    wide = wide.mask(rng.random(wide.shape) < 0.4)
    wide.iloc[:, 0] = np.nan
    wide.iloc[3:, 1] = np.nan
    monkeypatch.setattr(covariance, "RUN", 16)
    df = spark.createDataFrame([(d, t, None if v != v else float(v)) for d, row in wide.iterrows() for t, v in row.items() if v == v or t == "N00"], "date date, ticker string, r double")
    got = {(r.a, r.b): r.cov for r in covariance.covariance(df, block=block).collect()}
    seen = wide.notna().astype(int)
    both = seen.T @ seen
    assert got.keys() == {(a, b) for a in wide for b in wide if a <= b and both.loc[a, b]}
    for (a, b), v in got.items():
        pair = wide[[a]].join(wide[[b]], rsuffix="_").dropna().to_numpy()
        assert abs(v - (np.cov(pair.T)[0, 1] if len(pair) >= 5 else 0.0)) < 1e-12


@pytest.mark.parametrize("block", [4, 256])
def test_shrunk_covariance_as_numpy(spark, block, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(0.01, 0.2, (40, 9)) @ rng.normal(size=(9, 9))
    x[rng.random(x.shape) < 0.3] = 0.0
    x[20:, 2] = 0.0
    monkeypatch.setattr(covariance, "RUN", 16)
    df = spark.createDataFrame([(day(i), f"N{j}", None if rng.random() < 0.5 else 0.0) if x[i, j] == 0 else (day(i), f"N{j}", float(x[i, j])) for i in range(40) for j in range(9) if x[i, j] != 0 or rng.random() < 0.5], "date date, ticker string, r double")
    want = hierarchy.shrunk_covariance(x)
    got = covariance.shrunk_covariance(df, block=block).collect()
    assert len(got) == 45 and all(abs(r.cov - want[int(r.a[1]), int(r.b[1])]) < 1e-10 for r in got)


def test_places_of_one_value_are_in_many_ranges(spark):
    df = spark.createDataFrame([(i, None if i % 50 else float(i)) for i in range(3000)], "k int, x double")
    ranged = xsection._ranged(df, xsection._key("x", ("k",)), parts=40)
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 400
    got = {r.k: r.place for r in xsection.places(df, "x", "k", descending=True, parts=40).collect()}
    order = sorted(range(3000), key=lambda i: (i % 50 != 0, -i if i % 50 == 0 else 0, i))
    assert got == {i: n for n, i in enumerate(order, 1)}


@pytest.mark.parametrize("parts", [1, 5, 200])
def test_quantiles_as_numpy(spark, parts):
    values = {"a": [3.0, 1.0, 1.0, 1.0, 9.0, 2.5], "b": [5.0], "c": [None, None], "d": [float(i * 7 % 31) for i in range(90)] + [None]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, x double")
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.k: r.q for r in xsection.quantiles_of(df, "x", shares, "k", parts=parts).collect()}
    assert got.keys() == {"a", "b", "d"}
    for k, q in got.items():
        assert np.allclose(q, np.quantile([v for v in values[k] if v is not None], shares))
    known = [v for vs in values.values() for v in vs if v is not None]
    assert np.allclose(xsection.quantiles_of(df, "x", shares, parts=parts).first().q, np.quantile(known, shares))
    assert xsection.quantiles_of(df.where("x is null"), "x").first().q == [None]


def test_equal_shares(spark):
    rows = spark.createDataFrame([(day(0), f"T{k}", h, float(k * h % 5)) for k in range(6) for h in (1, 5, 21)], "date date, ticker string, horizon int, pred double")
    assert {(r.horizon, r.share) for r in portfolio.equal_shares(rows).collect()} == {(1, 1 / 3), (5, 1 / 3), (21, 1 / 3)}
    a = {r.ticker: r.score for r in portfolio.ic_ensemble(rows, portfolio.equal_shares(rows)).collect()}
    b = {r.ticker: r.score for r in portfolio.ensemble(rows, {1: 1.0, 5: 1.0, 21: 1.0}).collect()}
    assert a.keys() == b.keys() and all(abs(a[t] - b[t]) < 1e-12 for t in a)

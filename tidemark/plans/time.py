"""Queries of the time axis and of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import clip, ratio, tidy
from ..operators import labels, timeaxis as t, xsection as x
from ..sources.panel import market, price_panel
from .registry import query
from .sql import PANEL, RETURNS, T, ewm, full, last, r6, rows


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return price_panel(spark, sf)


def returns(spark: SparkSession, sf: str) -> DataFrame:
    return t.with_daily_return(price_panel(spark, sf))


def column(name: str, out: str, make, sql: str, digits: int | None = 6, base: str = RETURNS, rets: bool = True) -> None:
    """A query of one computed column over the panel."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = returns(spark, sf) if rets else panel(spark, sf)
        return tidy(df.select("date", "ticker", make().alias(out)), digits)

    query(name, f"WITH {base} SELECT date, ticker, {r6(sql, out, digits)} FROM rets")(run)


for d in (1, 5, 21, 63, 252):
    column(f"w1_log_return_{d}d", "ret", lambda d=d: t.log_return(d), f"ln(close) - ln(lag(close, {d}) OVER ({T}))")
for d in (5, 21, 63):
    column(f"w2_realised_vol_{d}d", "vol", lambda d=d: t.realised_vol("r", d), full("stddev_samp(r)", "r", d))
column("w5_bollinger_z", "z", t.bollinger, f"CASE WHEN count(close) OVER {last(20)} >= 20 THEN (close - avg(close) OVER {last(20)}) / nullif(stddev_samp(close) OVER {last(20)}, 0) END")
column("w6_high_distance", "dist_high", lambda: t.range_distance()[0], f"CASE WHEN count(close) OVER {last(252)} >= 60 THEN close / max(close) OVER {last(252)} - 1 END")
column("w6_low_distance", "dist_low", lambda: t.range_distance()[1], f"CASE WHEN count(close) OVER {last(252)} >= 60 THEN close / min(close) OVER {last(252)} - 1 END")
column("w7_dollar_volume", "adv", t.dollar_volume, f"CASE WHEN count(nullif(close * volume, 0)) OVER {last(21)} >= 10 THEN ln(avg(nullif(close * volume, 0)) OVER {last(21)}) END")
column("w8_rolling_skew", "skew", lambda: t.skew("r"), full("skewness(r)", "r", 21))
column("w9_rolling_kurtosis", "kurt", lambda: t.kurtosis("r"), full("kurtosis(r)", "r", 63))
column("w10_momentum_12_1", "mom", t.momentum, f"ln(lag(close, 21) OVER ({T})) - ln(lag(close, 252) OVER ({T}))")
column("w11_reversal", "rev", t.reversal, f"-(ln(close) - ln(lag(close, 5) OVER ({T})))")
column("w12_max_return", "max_ret", lambda: t.highest("r"), full("max(r)", "r", 21))
column("w13_illiquidity", "illiq", lambda: t.illiquidity("r") * 1e6, f"CASE WHEN count(abs(r) / nullif(close * volume, 0)) OVER {last(21)} >= 16 THEN avg(abs(r) / nullif(close * volume, 0)) OVER {last(21)} END * 1e6")
column("w17_lagged_vol", "vol", lambda: t.lagged_vol("r", 21), f"CASE WHEN count(r) OVER {rows(21, '1 PRECEDING')} >= 21 THEN stddev_samp(r) OVER {rows(21, '1 PRECEDING')} END")
column("w26_change_5d", "delta", lambda: t.change("close", 5), f"close - lag(close, 5) OVER ({T})", None)
column("w26_pct_change_21d", "pct", lambda: t.relative_change("close", 21), f"close / lag(close, 21) OVER ({T}) - 1")
column("w24_rolling_sum_21", "total", lambda: t.rolling_sum("volume", 21), f"sum(volume) OVER {last(21)}")
column("w25_rolling_mean_5", "mean", lambda: t.rolling_mean("close", 5), f"avg(close) OVER {last(5)}")
column("w31_rolling_sharpe", "sharpe", lambda: t.rolling_sharpe("r"), f"CASE WHEN count(r) OVER {last(252)} >= 252 THEN avg(r) OVER {last(252)} / nullif(stddev_samp(r) OVER {last(252)}, 0) * sqrt(252) END")
for h in (1, 5, 21):
    column(f"w18_forward_return_{h}", "fwd", lambda h=h: labels.forward_return(h), f"ln(lead(close, {h + 1}) OVER ({T})) - ln(lead(close, 1) OVER ({T}))")


@query("w27_bull_bear", f"WITH {PANEL} SELECT date, ticker, CASE WHEN close > CASE WHEN count(close) OVER {last(200)} >= 200 THEN avg(close) OVER {last(200)} END THEN 'bull' ELSE 'bear' END AS regime FROM panel")
def _bull(spark, sf):
    return panel(spark, sf).select("date", "ticker", t.bull_or_bear().alias("regime"))


_UP_DOWN = RETURNS + ", ch AS (SELECT *, close - lag(close) OVER (PARTITION BY ticker ORDER BY date) AS c FROM rets), gl AS (SELECT *, greatest(c, 0) AS up, greatest(-c, 0) AS down FROM ch WHERE c IS NOT NULL)"


@query(
    "w3_rsi",
    f"WITH RECURSIVE {_UP_DOWN}, {ewm('u', 'gl', 'up', 1 / 14, 14)}, {ewm('d', 'gl', 'down', 1 / 14, 14)} SELECT date, rets.ticker, {r6('1 - 1 / (1 + u.y / nullif(d.y, 0))', 'rsi')} FROM rets LEFT JOIN u ON u.ticker = rets.ticker AND u.rn = rets.rn LEFT JOIN d ON d.ticker = rets.ticker AND d.rn = rets.rn",
)
def _rsi(spark, sf):
    return tidy(t.with_rsi(panel(spark, sf).select("date", "ticker", "close")).drop("close"))


@query(
    "w4_macd",
    f"WITH RECURSIVE {RETURNS}, {ewm('f', 'rets', 'close', 2 / 13, 12)}, {ewm('s', 'rets', 'close', 2 / 27, 26)}, line AS (SELECT f.ticker, f.rn, f.y - s.y AS y FROM f JOIN s ON f.ticker = s.ticker AND f.rn = s.rn), {ewm('g', 'line', 'y', 0.2, 9)} "
    f"SELECT date, rets.ticker, {r6('line.y / close', 'macd')}, {r6('g.y / close', 'macd_signal')}, {r6('(line.y - g.y) / close', 'macd_hist')} FROM rets LEFT JOIN line ON line.ticker = rets.ticker AND line.rn = rets.rn LEFT JOIN g ON g.ticker = rets.ticker AND g.rn = rets.rn",
)
def _macd(spark, sf):
    return tidy(t.with_macd(panel(spark, sf).select("date", "ticker", "close")).drop("close"))


@query("w16_ewm", f"WITH RECURSIVE {RETURNS}, {ewm('e', 'rets', 'r', 0.1, 5)} SELECT date, rets.ticker, {r6('e.y', 'ewm')} FROM rets LEFT JOIN e ON e.ticker = rets.ticker AND e.rn = rets.rn")
def _ewm(spark, sf):
    return tidy(t.with_ewm(returns(spark, sf).select("date", "ticker", "r"), "r", 0.1, 5, "ewm").drop("r"))


_MARKET = RETURNS + ", mkt AS (SELECT date, avg(close) AS bench FROM panel GROUP BY 1), mr AS (SELECT date, ln(bench) - ln(lag(bench) OVER (ORDER BY date)) AS b FROM mkt), rb AS (SELECT rets.*, b FROM rets LEFT JOIN mr USING (date))"
_BETA = (
    _MARKET
    + f", dev AS (SELECT *, (r - {full('avg(r)', 'r', 60)}) * (b - {full('avg(b)', 'b', 60)}) AS xy FROM rb), beta AS (SELECT *, ({full('avg(xy)', 'xy', 60)}) * (60.0 / 59) / nullif({full('var_samp(b)', 'b', 60)}, 0) AS beta FROM dev)"
)


def with_market(spark: SparkSession, sf: str) -> DataFrame:
    """Returns and the market's return b; the market is one row a date."""
    p = price_panel(spark, sf)
    by_date = W.partitionBy(F.lit(0)).orderBy("date")
    m = market(p).select("date", (F.ln("bench") - F.ln(F.lag("bench").over(by_date))).alias("b"))
    return t.with_daily_return(p).join(m, "date", "left")


@query("w14_rolling_beta", f"WITH {_BETA} SELECT date, ticker, {r6('beta', 'beta')} FROM beta")
def _beta(spark, sf):
    return tidy(t.with_rolling_beta(with_market(spark, sf), "r", "b").select("date", "ticker", "beta"))


@query("w14_regression_slope", f"WITH {_MARKET} SELECT date, ticker, {r6(f'CASE WHEN count(CASE WHEN r IS NOT NULL AND b IS NOT NULL THEN 1 END) OVER {last(60)} >= 60 THEN covar_samp(r, b) OVER {last(60)} / nullif(var_samp(CASE WHEN r IS NOT NULL THEN b END) OVER {last(60)}, 0) END', 'slope')} FROM rb")
def _slope(spark, sf):
    return tidy(with_market(spark, sf).select("date", "ticker", t.slope("r", "b").alias("slope")))


@query("w15_idiosyncratic_vol", f"WITH {_BETA}, e AS (SELECT *, r - beta * b AS e FROM beta) SELECT date, ticker, {r6(full('stddev_samp(e)', 'e', 60), 'idio_vol')} FROM e")
def _idio(spark, sf):
    df = t.with_rolling_beta(with_market(spark, sf), "r", "b")
    return tidy(t.with_idiosyncratic_vol(df, "r", "b").select("date", "ticker", "idio_vol"))


_LABELS = RETURNS + f", v AS (SELECT *, CASE WHEN count(r) OVER {rows(21, '1 PRECEDING')} >= 21 THEN stddev_samp(r) OVER {rows(21, '1 PRECEDING')} END AS vol FROM rets)"


def _label_sql(h: int) -> str:
    f = f"(ln(lead(close, {h + 1}) OVER ({T})) - ln(lead(close, 1) OVER ({T})))"
    return f"{r6(f, f'fwd_return_{h}')}, CAST(CASE WHEN {f} > 0 THEN 1 WHEN {f} < 0 THEN 0 END AS DOUBLE) AS fwd_dir_{h}, {r6(f'{f} / (CASE WHEN vol > 1e-6 THEN vol END * sqrt({h}))', f'fwd_vs_{h}')}"


@query("w21_forward_labels", f"WITH {_LABELS} SELECT date, ticker, {_label_sql(1)}, {_label_sql(5)} FROM v")
def _labels(spark, sf):
    df = labels.forward_labels(panel(spark, sf), [1, 5])
    return tidy(df.select(*[F.col(c).cast("double") if c.startswith("fwd_dir") else F.col(c) for c in df.columns]))


@query("w19_vol_scaled_label", f"WITH {_LABELS} SELECT date, ticker, {r6(f'(ln(lead(close, 6) OVER ({T})) - ln(lead(close, 1) OVER ({T}))) / (CASE WHEN vol > 1e-6 THEN vol END * sqrt(5))', 'fwd_vs_5')} FROM v")
def _vs(spark, sf):
    return tidy(labels.forward_labels(panel(spark, sf), [5]).select("date", "ticker", "fwd_vs_5"))


@query("w20_binary_label", f"WITH {RETURNS} SELECT date, ticker, CAST(CASE WHEN lead(close, 6) OVER ({T}) > lead(close, 1) OVER ({T}) THEN 1 WHEN lead(close, 6) OVER ({T}) < lead(close, 1) OVER ({T}) THEN 0 END AS DOUBLE) AS fwd_dir_5 FROM rets")
def _dir(spark, sf):
    return labels.forward_labels(panel(spark, sf), [5]).select("date", "ticker", F.col("fwd_dir_5").cast("double"))


@query(
    "w22_triple_barrier",
    f"WITH {_LABELS}, e AS (SELECT a.date, a.ticker, a.rn, CASE WHEN a.vol > 1e-6 THEN a.vol END AS vol, ln(b.close) AS entry FROM v a LEFT JOIN v b ON b.ticker = a.ticker AND b.rn = a.rn + 1), "
    "p AS (SELECT e.ticker, e.rn, c.rn - e.rn - 1 AS k, ln(c.close) - entry AS g, e.vol FROM e JOIN v c ON c.ticker = e.ticker AND c.rn > e.rn + 1 AND c.rn <= e.rn + 6), "
    "h AS (SELECT ticker, rn, count(*) AS n, coalesce(min(CASE WHEN g >= 2 * vol THEN k END), 6) AS u, coalesce(min(CASE WHEN g <= -2 * vol THEN k END), 6) AS d FROM p WHERE vol IS NOT NULL GROUP BY 1, 2), "
    "f AS (SELECT *, least(u, d, 5) AS o FROM h WHERE n = 5) "
    "SELECT e.date, e.ticker, CAST(CASE WHEN f.o IS NULL THEN NULL WHEN least(u, d) > 5 THEN 0 WHEN u < d THEN 1 ELSE -1 END AS DOUBLE) AS tb_label, CASE WHEN f.o IS NULL THEN NULL WHEN least(u, d) > 5 THEN 'vert' WHEN u < d THEN 'up' ELSE 'down' END AS tb_barrier, "
    f"CAST(f.o AS DOUBLE) AS tb_offset, {r6('p.g', 'tb_return')} FROM e LEFT JOIN f ON f.ticker = e.ticker AND f.rn = e.rn LEFT JOIN p ON p.ticker = f.ticker AND p.rn = f.rn AND p.k = f.o",
)
def _barrier(spark, sf):
    return tidy(labels.triple_barrier(panel(spark, sf)))


_DENSE = PANEL + ", cal AS (SELECT DISTINCT date FROM panel), fst AS (SELECT ticker, min(date) AS first FROM panel GROUP BY 1), dense AS (SELECT cal.date, fst.ticker, close FROM fst JOIN cal ON cal.date >= first LEFT JOIN panel ON panel.ticker = fst.ticker AND panel.date = cal.date)"


@query("w23_fill_forward", f"WITH {_DENSE} SELECT ticker, date, last_value(close IGNORE NULLS) OVER ({T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM dense")
def _fill(spark, sf):
    p = panel(spark, sf)
    return t.onto_calendar(p, p.select("date").distinct(), ["close"])


@query("w28_panel_shift", f"WITH {PANEL} SELECT date, ticker, sector, lag(close) OVER ({T}) AS close, lag(volume) OVER ({T}) AS volume FROM panel")
def _shift(spark, sf):
    return t.shifted(panel(spark, sf), ["close", "volume"])


@query("w29_column_shift", f"WITH {PANEL}, s AS (SELECT date, ticker, sector, close, lag(volume) OVER ({T}) AS volume FROM panel) SELECT * FROM s WHERE volume IS NOT NULL")
def _shift_one(spark, sf):
    return t.shifted(panel(spark, sf), ["volume"]).na.drop(subset=["volume"])


_SMALL = "greatest(-0.5, least(0.5, coalesce(r, 0))) / 10"


def small_return() -> Column:
    """A tenth of the clipped daily return: what the equity queries compound."""
    return clip(F.coalesce("r", F.lit(0.0)), -0.5, 0.5) / 10


@query("w30_drawdown", f"WITH {RETURNS}, q AS (SELECT date, ticker, exp(sum(ln(1 + {_SMALL})) OVER ({T})) AS equity FROM rets), k AS (SELECT *, max(equity) OVER ({T}) AS peak FROM q) SELECT date, ticker, {r6('equity', 'equity')}, {r6('peak', 'peak')}, {r6('equity / peak - 1', 'drawdown')} FROM k")
def _drawdown(spark, sf):
    return tidy(t.with_drawdown(returns(spark, sf), small_return()).select("date", "ticker", "equity", "peak", "drawdown"))


@query("w32_growth_curves", f"WITH {RETURNS}, s AS (SELECT date, ticker, {_SMALL} AS s, abs({_SMALL} - coalesce(lag({_SMALL}) OVER ({T}), 0)) AS turn FROM rets) SELECT date, ticker, {r6(f'exp(sum(ln(1 + s - turn * 6 / 1e4)) OVER ({T}))', 'strategy')}, {r6(f'exp(sum(ln(1 - s)) OVER ({T}))', 'inverse')} FROM s")
def _curves(spark, sf):
    df = returns(spark, sf).withColumn("s", small_return())
    df = df.withColumn("turn", F.abs(F.col("s") - F.coalesce(F.lag("s").over(t.by_ticker()), F.lit(0.0))))
    return tidy(df.select("date", "ticker", t.growth(F.col("s") - F.col("turn") * 6 / 1e4, t.by_ticker()).alias("strategy"), t.growth(-F.col("s"), t.by_ticker()).alias("inverse")))


@query("w33_follow_score", f"WITH {RETURNS}, s AS (SELECT date, ticker, {_SMALL} AS s, sign(coalesce(lag(r) OVER ({T}), 0)) AS pos FROM rets) SELECT date, ticker, {r6(f'exp(sum(ln(1 + pos * s)) OVER ({T}))', 'followed')}, {r6(f'exp(sum(ln(1 + s)) OVER ({T}))', 'held')} FROM s")
def _follow(spark, sf):
    df = returns(spark, sf).withColumns({"s": small_return(), "pos": F.signum(F.coalesce(F.lag("r").over(t.by_ticker()), F.lit(0.0)))})
    return tidy(df.select("date", "ticker", t.growth(F.col("pos") * F.col("s"), t.by_ticker()).alias("followed"), t.growth(F.col("s"), t.by_ticker()).alias("held")))


@query("m17_feature_composer", f"WITH {RETURNS} SELECT date, ticker, {r6(f'ln(close) - ln(lag(close, 5) OVER ({T}))', 'ret_5d')}, {r6(full('stddev_samp(r)', 'r', 21), 'vol_21d')}, {r6(f'ln(lag(close, 21) OVER ({T})) - ln(lag(close, 252) OVER ({T}))', 'mom_12_1')}, {r6(full('max(r)', 'r', 21), 'max_ret_21')} FROM rets")
def _features(spark, sf):
    return tidy(returns(spark, sf).select("date", "ticker", t.log_return(5).alias("ret_5d"), t.realised_vol("r", 21).alias("vol_21d"), t.momentum().alias("mom_12_1"), t.highest("r").alias("max_ret_21")))

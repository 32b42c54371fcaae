"""Queries of evaluation, folds and regressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evaluation as e, models as m
from ..operators.xsection import filled_with_median
from ..sources.panel import price_panel, table
from .cross import _TRIALS, add, scores, trials
from .portfolio import BACKTEST, backtest
from .registry import query
from .sql import PANEL, RETURNS, folds, r6

_RK = lambda c: f"rank() OVER (PARTITION BY date ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0"
_IC = RETURNS + f", bo AS (SELECT date, {_RK('volume')} AS a, {_RK('r')} AS b FROM rets WHERE r IS NOT NULL), ic AS (SELECT date, CASE WHEN count(*) >= 5 AND isfinite(corr(a, b)) THEN corr(a, b) END AS ic FROM bo GROUP BY 1)"


def ics(spark: SparkSession, sf: str) -> DataFrame:
    return e.information_coefficient(scores(spark, sf))


add("a7_information_coefficient", f"WITH {_IC} SELECT date, {r6('ic', 'ic')} FROM ic", ics)
add("a8_ic_summary", f"WITH {_IC} SELECT {r6('avg(ic)', 'ic_mean')}, {r6('stddev_samp(ic)', 'ic_std')}, {r6('avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(252)', 'ic_ir')} FROM ic", lambda s, sf: e.ic_summary(ics(s, sf)))
_HIT = RETURNS + ", h AS (SELECT date, volume - 60 AS a, r FROM rets)"


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).select((F.col("score") - 60).alias("a"), "r")


add("a9_hit_rate", f"WITH {_HIT} SELECT {r6('avg(CAST(sign(a) = sign(r) AS INT))', 'hit')} FROM h WHERE a <> 0 AND r <> 0", lambda s, sf: hits(s, sf).where("a <> 0 and r <> 0").agg(F.avg((F.signum("a") == F.signum("r")).cast("int")).alias("hit")))
add("a10_hit_rate_with_zeros", f"WITH {_HIT} SELECT {r6('avg(CAST((a > 0) = (r > 0) AS INT))', 'hit')} FROM h WHERE r IS NOT NULL", lambda s, sf: hits(s, sf).where("r is not null").agg(F.avg(((F.col("a") > 0) == (F.col("r") > 0)).cast("int")).alias("hit")))
_NET = f"{BACKTEST}, nt AS (SELECT date, year(date) AS year, round(gross - turnover * 6 / 1e4, 12) AS net FROM bt WHERE gross IS NOT NULL)"


def daily_net(spark: SparkSession, sf: str) -> DataFrame:
    """The backtest from its first held date on, without what the order of a sum adds: a day without gain is 0 in every run."""
    return backtest(spark, sf).where("net is not null").withColumn("net", F.round("net", 12))


def _sheet(keys: str) -> str:
    over = f"(PARTITION BY {keys or '1'} ORDER BY date)"
    clipped = "least(greatest(net, -0.99), 5)"
    annual = f"(exp(sum(ln(1 + {clipped})) * 252 / count(net)) - 1)"
    cols = f"{r6(annual, 'ann_return')}, {r6('stddev_samp(net) * sqrt(252)', 'ann_vol')}, {r6('avg(net) / nullif(stddev_samp(net), 0) * sqrt(252)', 'sharpe')}, {r6('avg(net) / nullif(stddev_samp(CASE WHEN net < 0 THEN net END), 0) * sqrt(252)', 'sortino')}, {r6('min(drawdown)', 'max_drawdown')}, {r6(f'{annual} / nullif(abs(min(drawdown)), 0)', 'calmar')}, {r6('avg(CAST(net > 1e-12 AS INT))', 'hit_ratio')}, count(*) AS n"
    return f"WITH {_NET}, eq AS (SELECT *, exp(sum(ln(1 + {clipped})) OVER {over}) AS equity FROM nt), dd AS (SELECT *, equity / max(equity) OVER {over} - 1 AS drawdown FROM eq) SELECT {keys + ', ' if keys else ''}{cols} FROM dd {'GROUP BY ' + keys if keys else ''}"


add("a14_tearsheet", _sheet(""), lambda s, sf: e.tearsheet(daily_net(s, sf)))
add("a15_yearly_table", _sheet("year"), lambda s, sf: e.tearsheet(daily_net(s, sf).withColumn("year", F.year("date").cast("long")), "net", "year"))
_QUART = "qt AS (SELECT quantile_cont(c, 0.25) AS a, quantile_cont(c, 0.5) AS b, quantile_cont(c, 0.75) AS d FROM lv), nm AS (SELECT lv.*, CASE WHEN c <= a THEN 'q1' WHEN c <= b THEN 'q2' WHEN c <= d THEN 'q3' WHEN c IS NOT NULL THEN 'q4' END AS bucket FROM lv, qt)"
add("a17_quartile_buckets", f"WITH {PANEL}, lv AS (SELECT date, sum(volume) AS c FROM panel GROUP BY 1), {_QUART} SELECT date, bucket FROM nm", lambda s, sf: e.quartile_names(price_panel(s, sf).groupBy("date").agg(F.sum("volume").alias("c")), "c").select("date", "bucket"))
add("a16_regime_breakdown", f"WITH {RETURNS}, lv AS (SELECT date, sum(volume) AS c, avg(r) AS m FROM rets GROUP BY 1), {_QUART} SELECT bucket, count(*) AS n, {r6('avg(m)', 'mean')}, {r6('stddev_samp(m)', 'std')}, {r6('avg(CAST(m > 0 AS INT))', 'hit')} FROM nm GROUP BY 1", lambda s, sf: e.quartile_names(scores(s, sf).groupBy("date").agg(F.sum("score").alias("c"), F.avg("r").alias("m")), "c").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), F.avg((F.col("m") > 0).cast("int")).alias("hit")))
add("a16_regime_sheet", f"WITH {RETURNS}, lv AS (SELECT date, sum(volume) AS c, avg(r) AS m FROM rets GROUP BY 1), {_QUART} SELECT bucket, count(*) AS n, {r6('avg(m)', 'mean')}, {r6('stddev_samp(m)', 'std')}, {r6('avg(m) / nullif(stddev_samp(m), 0) * sqrt(252)', 'sharpe')}, {r6('avg(CAST(m > 0 AS INT))', 'hit')}, {r6('avg(m) * 252', 'ann_return')} FROM nm WHERE m IS NOT NULL AND bucket IS NOT NULL GROUP BY 1", lambda s, sf: e.regime_breakdown(e.quartile_names(scores(s, sf).groupBy("date").agg(F.sum("score").alias("c"), F.avg("r").alias("m")), "c"), "m", "bucket"))
add("a20_median_fill", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END, (SELECT median(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END) FROM orders)) AS price FROM orders", lambda s, sf: filled_with_median(table(s, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price")), "price"), None)
add("a22_pending_guard", "SELECT count(*) AS pending, count(*) >= 5 AS full FROM orders WHERE o_orderstatus = 'P'", lambda s, sf: table(s, sf, "orders").where("o_orderstatus = 'P'").agg(F.count(F.lit(1)).alias("pending"), (F.count(F.lit(1)) >= 5).alias("full")))
add("a23_best_trial", f"WITH {_TRIALS} SELECT trial, sharpe FROM tr WHERE sharpe > -10 ORDER BY sharpe DESC, trial LIMIT 1", lambda s, sf: trials(s, sf).where("sharpe > -10").orderBy(F.desc("sharpe"), "trial").limit(1))
add("a24_interval_tally", f"WITH {_TRIALS} SELECT count(CASE WHEN sharpe - 20 > 0 THEN 1 END) AS above, count(CASE WHEN sharpe - 20 <= 0 AND sharpe + 1 >= 20 THEN 1 END) AS straddling FROM tr", lambda s, sf: trials(s, sf).agg(F.count_if(F.col("sharpe") - 20 > 0).alias("above"), F.count_if((F.col("sharpe") - 20 <= 0) & (F.col("sharpe") + 1 >= 20)).alias("straddling")))
add("a25_sweep_summary", f"WITH {_TRIALS} SELECT max(sharpe) AS best, min(sharpe) AS worst, {r6('median(sharpe)', 'mid')} FROM tr", lambda s, sf: e.sweep_summary(trials(s, sf), "sharpe"))
add("m3_holdout_split", f"WITH {PANEL} SELECT date, ticker, date >= (SELECT max(date) - INTERVAL 24 MONTH FROM panel) AS holdout FROM panel", lambda s, sf: (lambda p: p.join(F.broadcast(p.agg(F.add_months(F.max("date"), -24).alias("cut"))), F.lit(True)).select("date", "ticker", (F.col("date") >= F.col("cut")).alias("holdout")))(price_panel(s, sf)))
add("m7_fama_macbeth", f"WITH {RETURNS} SELECT date, {r6('sum(volume / 100 * r) / (sum(volume / 100 * volume / 100) + 1e-4)', 'slope')} FROM rets WHERE r IS NOT NULL GROUP BY 1 HAVING count(*) >= 10", lambda s, sf: e.cross_sectional_slopes(scores(s, sf).withColumn("x", F.col("score") / 100), "x", "r"))
add("m13_parameter_grid", "SELECT n_nationkey, r_regionkey, (n_nationkey + r_regionkey) % 3 = 0 AS failed FROM nation CROSS JOIN region", lambda s, sf: table(s, sf, "nation").select("n_nationkey").join(F.broadcast(table(s, sf, "region").select("r_regionkey")), F.lit(True)).withColumn("failed", (F.col("n_nationkey") + F.col("r_regionkey")) % 3 == 0))


@query("m12_bootstrap_sharpe")
def _bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return e.bootstrap_sharpe(backtest(spark, sf))


@query("m1_walk_forward", f"WITH RECURSIVE {PANEL}, {folds('te + INTERVAL 180 DAY', '1998-12-31')} SELECT fold, date, ticker, train_end FROM panel JOIN fo ON date BETWEEN test_start AND test_end")
def _folds(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the panel by the fold that tests them."""
    panel = price_panel(spark, sf)
    found = m.folds_table(panel, dt.date(1998, 12, 31), days=180)
    return panel.join(F.broadcast(found), F.expr("date between test_start and test_end")).select("fold", "date", "ticker", "train_end")  # a row for each fold

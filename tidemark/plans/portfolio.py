"""Queries of books, their limits, and what holding them returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import tidy
from ..operators import covariance as cov, portfolio as p, timeaxis as t
from ..operators.evaluation import information_coefficient
from .cross import BOOK, add, scores
from .registry import query
from .sql import RETURNS, T, full, r6

_W = "CASE WHEN k > n - 5 THEN 0.1 WHEN k <= 5 THEN -0.1 ELSE 0 END"
_FULL = f"bk AS (SELECT o.date, o.ticker, rets.sector, rets.r, rets.rn, CAST(CASE WHEN n >= 10 THEN {_W} ELSE 0 END AS DOUBLE) AS weight FROM o JOIN rets ON o.date = rets.date AND o.ticker = rets.ticker)"
BOOKED = f"{BOOK}, {_FULL}"


def book(spark: SparkSession, sf: str) -> DataFrame:
    """date, ticker, sector, r, weight of the top and bottom five by volume, 0 for the rest."""
    s = scores(spark, sf)
    return s.join(p.top_bottom(s, 5, 0.5).withColumnRenamed("weight", "_w"), ["date", "ticker"], "left").select("date", "ticker", "sector", "r", "score", F.coalesce("_w", F.lit(0.0)).alias("weight"))


add("p1_sector_cap", f"WITH {BOOKED} SELECT date, ticker, {r6('weight * least(1.0, coalesce(0.25 / nullif(sum(abs(weight)) OVER (PARTITION BY date, sector), 0), 1.0))', 'weight')} FROM bk", lambda s, sf: p.capped(book(s, sf), 0.25).select("date", "ticker", "weight"))
add(
    "p2_min_trade",
    f"WITH RECURSIVE {BOOKED}, h AS (SELECT ticker, rn, date, weight AS held FROM bk WHERE rn = 1 UNION ALL SELECT bk.ticker, bk.rn, bk.date, CASE WHEN abs(weight - held) >= 0.1 THEN weight ELSE held END FROM h JOIN bk ON bk.ticker = h.ticker AND bk.rn = h.rn + 1) SELECT date, ticker, {r6('held', 'held')} FROM h",
    lambda s, sf: p.with_threshold(book(s, sf).select("date", "ticker", "weight"), 0.1).select("date", "ticker", "held"),
)
_BETA = "bb AS (SELECT *, CASE WHEN rn % 7 <> 0 THEN 0.5 + (rn % 5) / 4.0 END AS beta FROM bk), ls AS (SELECT *, sum(CASE WHEN weight > 0 THEN weight * coalesce(beta, 1) ELSE 0 END) OVER (PARTITION BY date) AS l, sum(CASE WHEN weight < 0 THEN weight * coalesce(beta, 1) ELSE 0 END) OVER (PARTITION BY date) AS s FROM bb), aa AS (SELECT *, CASE WHEN abs(l + s) < 1e-6 OR abs(s - l) < 1e-9 THEN NULL ELSE -(l + s) / (s - l) END AS a0 FROM ls), ab AS (SELECT *, CASE WHEN abs(a0) <= 0.5 THEN a0 ELSE 0 END AS a FROM aa)"


def with_beta(spark: SparkSession, sf: str) -> DataFrame:
    rn = F.row_number().over(t.by_ticker())
    return book(spark, sf).withColumn("beta", F.when(rn % 7 != 0, 0.5 + (rn % 5) / 4.0))


add("p3_beta_neutral", f"WITH {BOOKED}, {_BETA} SELECT date, ticker, {r6('weight * CASE WHEN weight > 0 THEN 1 - a ELSE 1 + a END', 'weight')} FROM ab", lambda s, sf: p.beta_neutral(with_beta(s, sf)).select("date", "ticker", "weight"))
_PREDS = RETURNS + ", pr AS (SELECT date, ticker, 1 AS horizon, volume AS pred FROM rets UNION ALL SELECT date, ticker, 5, -volume + rn % 9 FROM rets WHERE rn % 4 <> 0), zz AS (SELECT *, coalesce((pred - avg(pred) OVER w) / nullif(stddev_samp(pred) OVER w, 0), 0) AS z FROM pr WINDOW w AS (PARTITION BY date, horizon))"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(spark, sf).withColumn("rn", F.row_number().over(t.by_ticker()))
    return s.select("date", "ticker", F.lit(1).alias("horizon"), F.col("score").alias("pred")).unionByName(s.where("rn % 4 <> 0").select("date", "ticker", F.lit(5).alias("horizon"), (-F.col("score") + F.col("rn") % 9).alias("pred")))


add("p4_equal_ensemble", f"WITH {_PREDS} SELECT date, ticker, {r6('sum(z * 0.5)', 'score')} FROM zz GROUP BY 1, 2", lambda s, sf: p.ensemble(predictions(s, sf), {1: 1.0, 5: 1.0}))
add("p5_weighted_ensemble", f"WITH {_PREDS} SELECT date, ticker, {r6('sum(z * CASE horizon WHEN 1 THEN 0.75 ELSE 0.25 END)', 'score')} FROM zz GROUP BY 1, 2", lambda s, sf: p.ensemble(predictions(s, sf), {1: 1.5, 5: 0.5}))
_SHARES = (
    f"fw AS (SELECT date, ticker, r FROM rets WHERE r IS NOT NULL), jn AS (SELECT pr.date, horizon, pred, r FROM pr JOIN fw ON pr.date = fw.date AND pr.ticker = fw.ticker), rk AS (SELECT date, horizon, rank() OVER (PARTITION BY date, horizon ORDER BY pred) + (count(*) OVER (PARTITION BY date, horizon, pred) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date, horizon ORDER BY r) + (count(*) OVER (PARTITION BY date, horizon, r) - 1) / 2.0 AS b FROM jn), "
    "ic AS (SELECT date, horizon, CASE WHEN count(*) >= 5 AND isfinite(corr(a, b)) THEN corr(a, b) END AS ic FROM rk GROUP BY 1, 2), ir AS (SELECT horizon, greatest(0, coalesce(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(252), 0)) AS w FROM ic GROUP BY 1), sh AS (SELECT horizon, CASE WHEN sum(w) OVER () > 0 THEN w / sum(w) OVER () ELSE 1.0 / count(*) OVER () END AS share FROM ir)"
)


def horizon_ics(spark: SparkSession, sf: str) -> DataFrame:
    """date, horizon, ic of the predictions with the day's returns."""
    r = scores(spark, sf).select("date", "ticker", "r")
    scored = predictions(spark, sf).join(r, ["date", "ticker"]).withColumnRenamed("pred", "score")
    return information_coefficient(scored, keys=("date", "horizon"))


add("p5_ic_weighted_ensemble", f"WITH {_PREDS}, {_SHARES} SELECT date, ticker, {r6('sum(z * share)', 'score', 5)} FROM zz JOIN sh USING (horizon) GROUP BY 1, 2", lambda s, sf: p.ic_ensemble(predictions(s, sf), p.ic_weights(horizon_ics(s, sf))), 5)
add("p5_ic_shares", f"WITH {_PREDS}, {_SHARES} SELECT horizon, {r6('share', 'share')} FROM sh", lambda s, sf: p.ic_weights(horizon_ics(s, sf)))
add("a21_covariance", f"WITH {RETURNS} SELECT x.ticker AS a, y.ticker AS b, {r6('CASE WHEN count(*) >= 5 THEN covar_samp(x.r, y.r) ELSE 0 END', 'cov')} FROM rets x JOIN rets y ON x.date = y.date AND x.ticker <= y.ticker WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2", lambda s, sf: cov.covariance(scores(s, sf), block=8))
_SHRUNK = (
    "dn AS (SELECT count(DISTINCT date) AS n FROM rets), gx AS (SELECT t.ticker, d.date, coalesce(r, 0.0) AS v FROM (SELECT DISTINCT ticker FROM rets) t CROSS JOIN (SELECT DISTINCT date FROM rets) d LEFT JOIN rets ON rets.ticker = t.ticker AND rets.date = d.date), gc AS (SELECT ticker, date, v - avg(v) OVER (PARTITION BY ticker) AS v FROM gx), "
    "ss AS (SELECT x.ticker AS a, y.ticker AS b, sum(x.v * y.v) / count(*) AS s, sum(x.v * x.v * y.v * y.v) / count(*) AS q FROM gc x JOIN gc y ON x.date = y.date AND x.ticker <= y.ticker GROUP BY 1, 2), mm AS (SELECT avg(s) AS m, count(*) AS p FROM ss WHERE a = b), "
    "nr AS (SELECT m, sum(CASE WHEN a = b THEN (s - m) * (s - m) ELSE 2 * s * s END) / p AS away, sum(CASE WHEN a = b THEN 1 ELSE 2 END * (q - s * s)) / (n * p) AS noise FROM ss, mm, dn GROUP BY m, p, n), sh AS (SELECT m, CASE WHEN away > 0 THEN least(noise, away) / away ELSE 0 END AS share FROM nr)"
)
add("a21_shrunk_covariance", f"WITH {RETURNS}, {_SHRUNK} SELECT a, b, {r6('(1 - share) * s + CASE WHEN a = b THEN share * m ELSE 0 END', 'cov', 9)} FROM ss, sh", lambda s, sf: cov.shrunk_covariance(scores(s, sf), block=8), 9)
#: SQL of weights (sz: date, ticker, weight) on every date and name of a book, held to a least trade from each name's first row, then beta neutral.
_COMPOSED = (
    "cp AS (SELECT sz.date, sz.ticker, weight * least(1.0, coalesce(0.25 / nullif(sum(abs(weight)) OVER (PARTITION BY sz.date, coalesce(sector, '')), 0), 1.0)) AS w FROM sz LEFT JOIN (SELECT DISTINCT ticker, sector FROM rets WHERE sector <> 'ASIA') USING (ticker)), "
    "gc AS (SELECT t.ticker, d.date, coalesce(w, 0.0) AS w, row_number() OVER (PARTITION BY t.ticker ORDER BY d.date) AS i FROM (SELECT DISTINCT ticker FROM cp) t CROSS JOIN (SELECT DISTINCT date FROM cp) d LEFT JOIN cp ON cp.ticker = t.ticker AND cp.date = d.date), "
    "th AS (SELECT ticker, i, date, w AS weight FROM gc WHERE i = 1 UNION ALL SELECT gc.ticker, gc.i, gc.date, CASE WHEN abs(gc.w - th.weight) >= 0.02 THEN gc.w ELSE th.weight END FROM th JOIN gc ON gc.ticker = th.ticker AND gc.i = th.i + 1), "
    "be AS (SELECT th.date, th.ticker, weight, coalesce(CASE WHEN rn % 7 <> 0 THEN 0.53 + (rn % 5) / 4.3 END, 1) AS beta FROM th LEFT JOIN rets ON rets.date = th.date AND rets.ticker = th.ticker), "
    "ls AS (SELECT *, sum(CASE WHEN weight > 0 THEN weight * beta ELSE 0 END) OVER (PARTITION BY date) AS l, sum(CASE WHEN weight < 0 THEN weight * beta ELSE 0 END) OVER (PARTITION BY date) AS s FROM be), "
    "al AS (SELECT *, CASE WHEN abs(l + s) >= 1e-6 AND abs(s - l) >= 1e-9 AND abs((l + s) / (s - l)) <= 0.5 THEN -(l + s) / (s - l) ELSE 0 END AS a FROM ls) "
    f"SELECT date, ticker, {r6('weight * CASE WHEN weight > 0 THEN 1 - a ELSE 1 + a END', 'weight')} FROM al"
)


def composed(spark: SparkSession, sf: str, score: DataFrame | None = None, **how) -> DataFrame:
    """Books of a score, or of the volume, in the steps of the weight builder; names of one sector have none. No book's figures are on a threshold."""
    rn = F.row_number().over(t.by_ticker())
    b = book(spark, sf).withColumn("beta", F.when(rn % 7 != 0, 0.53 + (rn % 5) / 4.3))
    sectors = b.where("sector <> 'ASIA'").select("ticker", "sector").distinct()
    return p.composed(b.select("date", "ticker", "score") if score is None else score, sectors=sectors, cap=0.25, least=0.02, betas=b.select("date", "ticker", "beta"), leverage=0.5, **how)


add("p17_composed_weights", f"WITH RECURSIVE {BOOK}, sz AS (SELECT date, ticker, CAST(CASE WHEN k > n - 4 THEN 0.125 ELSE -0.125 END AS DOUBLE) AS weight FROM o WHERE n >= 8 AND (k <= 4 OR k > n - 4)), {_COMPOSED}", lambda s, sf: composed(s, sf, k=4))
_VOL = f"vl AS (SELECT date, ticker, volume AS score, r, {full('stddev_samp(r)', 'r', 21)} AS v0 FROM rets), vv AS (SELECT date, ticker, score, v0 AS vol FROM vl)"


def trailing_vol(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).select("date", "ticker", t.realised_vol("r", 21).alias("vol"))


add(
    "p17_inverse_vol_weights",
    f"WITH RECURSIVE {RETURNS}, {_VOL}, vk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS k, count(*) OVER (PARTITION BY date) AS n FROM vv WHERE vol > 1e-6), vm AS (SELECT *, least(greatest(1, floor(n * 0.2)), n // 2) AS m FROM vk WHERE n >= 10), "
    f"vs AS (SELECT *, CASE WHEN k > n - m THEN 1 ELSE -1 END AS side FROM vm WHERE k <= m OR k > n - m), sz AS (SELECT date, ticker, side * 0.5 * (1 / vol) / sum(1 / vol) OVER (PARTITION BY date, side) AS weight FROM vs), {_COMPOSED}",
    lambda s, sf: composed(s, sf, sizing="inverse_vol", vol=trailing_vol(s, sf)),
)


add(
    "p17_ensemble_weights",
    f"WITH RECURSIVE {_PREDS}, {_SHARES}, es AS (SELECT date, ticker, round(sum(z * share), 9) AS score FROM zz JOIN sh USING (horizon) GROUP BY 1, 2), eo AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS k, count(*) OVER (PARTITION BY date) AS n FROM es), "
    f"sz AS (SELECT date, ticker, CAST(CASE WHEN k > n - 3 THEN 1 / 6.0 ELSE -1 / 6.0 END AS DOUBLE) AS weight FROM eo WHERE n >= 6 AND (k <= 3 OR k > n - 3)), {_COMPOSED}",
    lambda s, sf: composed(s, sf, p.ic_ensemble(predictions(s, sf), p.ic_weights(horizon_ics(s, sf))).withColumn("score", F.round("score", 9)), k=3),
)


@query("p17_parity_weights")
def _parity_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Sized by parity; SQL can't cluster, so the tests compare the steps after the sizing and the sizing itself."""
    return tidy(composed(spark, sf, sizing="parity", returns=scores(spark, sf).select("date", "ticker", "r")))


add(
    "p8_smoothed_weights",
    f"WITH RECURSIVE {BOOKED}, h AS (SELECT ticker, rn, date, weight AS y FROM bk WHERE rn = 1 UNION ALL SELECT bk.ticker, bk.rn, bk.date, 0.7 * y + 0.3 * weight FROM h JOIN bk ON bk.ticker = h.ticker AND bk.rn = h.rn + 1) SELECT date, ticker, {r6('y', 'smoothed')} FROM h",
    lambda s, sf: t.with_ewm(book(s, sf).select("date", "ticker", "weight"), "weight", 0.3, 1, "smoothed").drop("weight"),
)
#: SQL of a wide book: bw (date, ticker, w) on every date of the calendar, 0 for names that a book lacks, carried over dates without a book.
_WIDE = (
    "cl AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM rets)), gr AS (SELECT cl.date, i, t.ticker FROM cl CROSS JOIN (SELECT DISTINCT ticker FROM bk JOIN rets USING (ticker)) t), "
    "g0 AS (SELECT gr.*, CASE WHEN gr.date IN (SELECT date FROM bk) THEN coalesce(bk.weight, 0.0) END AS w0 FROM gr LEFT JOIN bk ON bk.date = gr.date AND bk.ticker = gr.ticker), "
    "bw AS (SELECT date, i, ticker, coalesce(last_value(w0 IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 0.0) AS w FROM g0)"
)
_EVERY = "an AS (SELECT min(i) AS i0 FROM bw WHERE w <> 0), cd AS (SELECT date, i, ticker, coalesce(last_value(CASE WHEN i >= i0 AND (i - i0) % 5 = 0 THEN w END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 0.0) AS w FROM bw, an)"


def held_sql(book: str, lag: int) -> str:
    """bt (date, gross, turnover): what the wide book `book` earns and trades, held `lag` dates later."""
    return (
        f"hd AS (SELECT *, lag(w, {lag}) OVER ({T}) AS h FROM {book}), dl AS (SELECT hd.*, r, abs(coalesce(h, 0) - coalesce(lag(h) OVER (PARTITION BY hd.ticker ORDER BY hd.date), 0)) AS d FROM hd LEFT JOIN rets ON rets.date = hd.date AND rets.ticker = hd.ticker), "
        f"bt AS (SELECT date, CASE WHEN min(i) > {lag} THEN sum(coalesce(h * CASE WHEN r IS NOT NULL THEN least(greatest(r, -0.5), 0.5) END, 0)) END AS gross, sum(d) AS turnover FROM dl GROUP BY 1)"
    )


_DAILY = f"SELECT date, {r6('gross', 'gross')}, {r6('turnover', 'turnover')}, {r6('turnover * 6 / 1e4', 'cost')}, {r6('gross - turnover * 6 / 1e4', 'net')} FROM bt"
BACKTEST = f"{BOOKED}, {_WIDE}, {_EVERY}, {held_sql('cd', 1)}"
add("p9_cadence", f"WITH {BOOKED}, {_WIDE}, {_EVERY} SELECT date, ticker, {r6('w', 'weight')} FROM cd WHERE w <> 0", lambda s, sf: (lambda b: p.on_calendar(b, b, 5))(book(s, sf)))


def backtest(spark: SparkSession, sf: str) -> DataFrame:
    """The book on a five-day cadence, held on every date of the panel."""
    b = book(spark, sf)
    return p.backtest(b, b, every=5)


add("p10_backtest", f"WITH {BACKTEST} {_DAILY}", backtest)
add("p10_books_on_some_dates", f"WITH {BOOK}, bk AS (SELECT date, ticker, CAST(CASE WHEN k > n - 5 THEN 0.1 ELSE -0.1 END AS DOUBLE) AS weight FROM o WHERE n >= 10 AND (k <= 5 OR k > n - 5) AND dayofweek(date) IN (1, 4)), {_WIDE}, {held_sql('bw', 2)} {_DAILY}", lambda s, sf: (lambda f: p.backtest(p.top_bottom(f, 5, 0.5).where(F.dayofweek("date").isin(2, 5)), f.select("date", "ticker", "r"), lag=2))(scores(s, sf)))
add("a26_turnover", f"WITH {BACKTEST} SELECT date, {r6('turnover', 'turnover')} FROM bt", lambda s, sf: backtest(s, sf).select("date", "turnover"))
_SIGN = RETURNS + f", sg AS (SELECT ticker, date, volume - lag(volume) OVER ({T}) AS score, r FROM rets), pc AS (SELECT ticker, count(*) AS n, avg(CAST(sign(score) = sign(r) AS INT)) AS p FROM sg WHERE score IS NOT NULL AND r IS NOT NULL GROUP BY 1), fa AS (SELECT ticker, CASE WHEN n >= 30 THEN p END AS precision, greatest(0, least(1, (coalesce(CASE WHEN n >= 30 THEN p END, 0.5) - 0.5) / 0.5)) * 0.8 AS factor FROM pc)"


def signs(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(spark, sf)
    return s.select("date", "ticker", (F.col("score") - F.lag("score").over(t.by_ticker())).alias("score"), "r")


add("a18_sign_precision", f"WITH {_SIGN} SELECT ticker, {r6('precision', 'precision')}, {r6('factor', 'factor')} FROM fa", lambda s, sf: p.shrink_factors(signs(s, sf), 0.8))
add("p11_shrunk_scores", f"WITH {_SIGN} SELECT date, ticker, {r6('score * coalesce(factor, 0)', 'score')} FROM sg LEFT JOIN fa USING (ticker)", lambda s, sf: p.shrunk(signs(s, sf), p.shrink_factors(signs(s, sf), 0.8)).select("date", "ticker", "score"))
_CONF = RETURNS + ", cf AS (SELECT date, ticker, volume AS score, CASE WHEN rn % 5 <> 0 THEN (rn % 11) / 10.0 END AS m FROM rets)"


def confidences(spark: SparkSession, sf: str) -> DataFrame:
    rn = F.row_number().over(t.by_ticker())
    return scores(spark, sf).select("date", "ticker", "score", F.when(rn % 5 != 0, (rn % 11) / 10.0).alias("m"))


add("p13_binary_gate", f"WITH {_CONF} SELECT date, ticker, {r6('CASE WHEN m >= 0.5 THEN score ELSE 0 END', 'score')} FROM cf", lambda s, sf: confidences(s, sf).select("date", "ticker", p.gated("score", "m", 0.5).alias("score")))
add("p14_confidence", f"WITH {_CONF} SELECT date, ticker, {r6('coalesce(score * CASE WHEN m IS NOT NULL THEN least(greatest((m - 0.4) / 0.45, 0), 1) END, 0)', 'score')} FROM cf", lambda s, sf: confidences(s, sf).select("date", "ticker", p.confident("score", "m", 0.4, 0.85).alias("score")))

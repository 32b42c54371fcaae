"""Queries of fitted models, their folds and gates, of feature families and of parity books."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import tidy
from ..operators import evaluation as e, features, hierarchy, labels, models as m, portfolio as p, timeaxis as t
from ..sources.files import held
from ..sources.panel import market, price_panel
from . import registry
from .cross import add, scores
from .registry import query
from .sql import PANEL, RETURNS, T, folds, r6

_FIRST = dt.date(1997, 12, 31)
_FOLDS = folds("te + INTERVAL 1 DAY + INTERVAL 6 MONTH - INTERVAL 1 DAY", str(_FIRST))
_XY = RETURNS + f", xy AS (SELECT date, ticker, sector, volume / 100 AS x1, ln(close) - ln(lag(close, 5) OVER ({T})) AS x2, ln(lead(close, 2) OVER ({T})) - ln(lead(close, 1) OVER ({T})) AS y FROM rets)"
_SLOPES = (
    _XY + ", fl AS (SELECT date, y, coalesce(x1, median(x1) OVER (PARTITION BY date), 0) AS a, coalesce(x2, median(x2) OVER (PARTITION BY date), 0) AS b FROM xy), "
    "sm AS (SELECT date, sum(a * a) + 1e-4 AS aa, sum(a * b) AS ab, sum(b * b) + 1e-4 AS bb, sum(a * y) AS ay, sum(b * y) AS cy FROM fl WHERE y IS NOT NULL GROUP BY 1 HAVING count(*) >= 10), "
    "sl AS (SELECT date, (bb * ay - ab * cy) / (aa * bb - ab * ab) AS x1, (aa * cy - ab * ay) / (aa * bb - ab * ab) AS x2 FROM sm)"
)
_X = ["x1", "x2"]


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """date, ticker, sector, x1 (volume), x2 (five-row return, NULL at first), y (the next row's return, NULL at last)."""
    df = price_panel(spark, sf)
    return df.select("date", "ticker", "sector", (F.col("volume") / 100).alias("x1"), t.log_return(5).alias("x2"), labels.forward_return(1).alias("y"))


def fold_rows(spark: SparkSession, sf: str) -> DataFrame:
    return m.folds_table(price_panel(spark, sf), _FIRST)


add("m1_folds", f"WITH RECURSIVE {PANEL}, {_FOLDS} SELECT fold, (SELECT min(date) FROM cal) AS train_start, train_end, test_start, test_end, n_train, (SELECT count(*) FROM cal WHERE cal.date BETWEEN test_start AND test_end) AS n_test FROM fo", fold_rows)
add("m2_split_rows", f"WITH RECURSIVE {PANEL}, {_FOLDS} SELECT fold, panel.date, ticker, CASE WHEN panel.date <= train_end THEN 'train' ELSE 'test' END AS part FROM panel JOIN fo ON panel.date <= train_end OR panel.date BETWEEN test_start AND test_end", lambda s, sf: m.split_rows(price_panel(s, sf).select("date", "ticker"), fold_rows(s, sf)))
add("m7_daily_premia", f"WITH {_SLOPES} SELECT date, {r6('x1', 'x1')}, {r6('x2', 'x2')} FROM sl", lambda s, sf: m.premia_by_date(rows(s, sf), _X, "y"))
add(
    "m7_premia_scores",
    f"WITH {_SLOPES}, mn AS (SELECT avg(x1) * 0.8 AS b1, avg(x2) * 0.8 AS b2 FROM sl WHERE date < DATE '1999-01-01'), md AS (SELECT median(x1) AS m1, median(x2) AS m2 FROM xy WHERE date < DATE '1999-01-01') SELECT date, ticker, {r6('coalesce(x1, m1) * b1 + coalesce(x2, m2) * b2', 'score')} FROM xy, mn, md WHERE date >= DATE '1999-01-01'",
    lambda s, sf: (lambda r: m.fama_macbeth(r.where("date < '1999-01-01'"), r.where("date >= '1999-01-01'"), _X, "y", 0.2))(rows(s, sf)),
)
add(
    "m9_fold_scores",
    f"WITH RECURSIVE {_SLOPES}, {_FOLDS}, mn AS (SELECT fold, avg(x1) AS b1, avg(x2) AS b2 FROM fo JOIN sl ON sl.date <= train_end GROUP BY 1), md AS (SELECT fold, median(x1) AS m1, median(x2) AS m2 FROM fo JOIN xy ON xy.date <= train_end GROUP BY 1) "
    f"SELECT fold, xy.date, ticker, {r6('coalesce(x1, m1) * b1 + coalesce(x2, m2) * b2', 'score')} FROM xy JOIN fo ON xy.date BETWEEN test_start AND test_end JOIN mn USING (fold) JOIN md USING (fold)",
    lambda s, sf: m.walk_forward_scores(rows(s, sf), fold_rows(s, sf), _X, "y"),
)


def signed(spark: SparkSession, sf: str) -> DataFrame:
    """rows with a primary score (minus the five-row return) and what was realised."""
    return rows(spark, sf).select("date", "ticker", "sector", (-F.col("x2")).alias("score"), F.col("y").alias("realised"), "x1")


@query("m4_logistic_scores")
def _logistic(spark: SparkSession, sf: str) -> DataFrame:
    df = held(rows(spark, sf).withColumn("up", F.when(F.col("y") != 0, (F.col("y") > 0).cast("int"))), "rows")
    return tidy(m.logistic(df.where("date < '1999-01-01'"), df.where("date >= '1999-01-01'"), _X, "up"))


add("m6_meta_rows", f"WITH {_XY} SELECT date, ticker, {r6('-x2', 'score')}, {r6('y', 'realised')}, x1, CAST(sign(-x2) = sign(y) AS INT) AS hit, {r6('abs(x2)', 'primary_abs')} FROM xy WHERE x2 IS NOT NULL AND y <> 0", lambda s, sf: m.meta_rows(signed(s, sf).drop("sector")))


@query("m10_meta_gate")
def _gate(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(m.meta_gate(signed(spark, sf), ["x1"], slices=2))


@query("m11_sector_gate")
def _sector_gate(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(m.sector_gate(signed(spark, sf), ["x1"], slices=1, mode="confidence", model="logistic"))


_RK = lambda c: f"rank() OVER (PARTITION BY date ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0"


def _ir(name: str, x: str) -> str:
    return (
        f"{name}_b AS (SELECT * FROM (SELECT date, {x} AS s, r FROM rets) WHERE s IS NOT NULL AND r IS NOT NULL), {name}_r AS (SELECT date, {_RK('s')} AS a, {_RK('r')} AS b FROM {name}_b), "
        f"{name}_i AS (SELECT date, CASE WHEN count(*) >= 5 AND isfinite(corr(a, b)) THEN corr(a, b) END AS ic FROM {name}_r GROUP BY 1), {name} AS (SELECT round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(252), 6) AS {name} FROM {name}_i)"
    )


def leak_audit(spark: SparkSession, sf: str) -> DataFrame:
    """as_is, shifted, verdict: the information ratio of the volume's ICs, of the day's and of the row before's."""
    df = scores(spark, sf)
    own = lambda d, out: e.ic_summary(e.information_coefficient(d)).select(F.round("ic_ir", 6).alias(out))
    both = own(df, "as_is").join(own(t.shifted(df, ["score"]), "shifted"), F.lit(True))  # one row each
    return both.withColumn("verdict", m.leak_verdict("as_is", "shifted"))


add("m15_leak_audit", f"WITH {RETURNS}, {_ir('as_is', 'volume')}, {_ir('shifted', f'lag(volume) OVER ({T})')} SELECT as_is + 0.0 AS as_is, shifted + 0.0 AS shifted, CASE WHEN abs(shifted) > 0.5 * abs(as_is) AND sign(as_is) = sign(shifted) THEN 'OK' WHEN abs(shifted) < 0.25 * abs(as_is) THEN 'SUSPECT' ELSE 'PARTIAL' END AS verdict FROM as_is, shifted", leak_audit)


_TX = "PARTITION BY xy.ticker ORDER BY xy.date"
_AUDIT = (
    f"au AS (SELECT xy.date, xy.ticker, x1, x2, lag(x1) OVER ({_TX}) AS o1, lag(x2) OVER ({_TX}) AS o2, y, ln(lead(close, 6) OVER ({_TX})) - ln(lead(close, 1) OVER ({_TX})) AS y5 FROM xy JOIN panel ON panel.date = xy.date AND panel.ticker = xy.ticker), "
    "lg AS (SELECT date, unnest(['x1', 'x1', 'x2', 'x2']) AS feature, unnest([0, 1, 0, 1]) AS older, unnest([x1, o1, x2, o2]) AS s, y, y5 FROM au), lh AS (SELECT date, feature, older, s, 'y' AS horizon, y AS r FROM lg UNION ALL SELECT date, feature, older, s, 'y5', y5 FROM lg), "
    "lr AS (SELECT date, feature, older, horizon, rank() OVER (PARTITION BY date, feature, older, horizon ORDER BY s) + (count(*) OVER (PARTITION BY date, feature, older, horizon, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date, feature, older, horizon ORDER BY r) + (count(*) OVER (PARTITION BY date, feature, older, horizon, r) - 1) / 2.0 AS b FROM lh WHERE s IS NOT NULL AND r IS NOT NULL), "
    "li AS (SELECT date, feature, older, horizon, CASE WHEN count(*) >= 5 AND isfinite(corr(a, b)) THEN corr(a, b) END AS ic FROM lr GROUP BY ALL), ls AS (SELECT feature, older, horizon, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(252) AS ir FROM li GROUP BY ALL), "
    "lp AS (SELECT feature, horizon, max(CASE WHEN older = 0 THEN ir END) AS as_is, max(CASE WHEN older = 1 THEN ir END) AS shifted FROM ls GROUP BY 1, 2)"
)


def audited_rows(spark: SparkSession, sf: str) -> DataFrame:
    """rows with the return of the next row and of the five from there."""
    df = price_panel(spark, sf)
    return df.select("date", "ticker", (F.col("volume") / 100).alias("x1"), t.log_return(5).alias("x2"), labels.forward_return(1).alias("y"), labels.forward_return(5).alias("y5"))


add(
    "m15_feature_audits",
    f"WITH {_XY}, {_AUDIT} SELECT feature, horizon, {r6('as_is', 'as_is', 4)}, {r6('shifted', 'shifted', 4)}, {r6('shifted - as_is', 'delta', 4)}, CASE WHEN abs(as_is) >= 0.05 THEN round((as_is - shifted) / abs(as_is) * 100, 2) + 0.0 END AS pct_drop, CASE WHEN abs(shifted) > 0.5 * abs(as_is) AND sign(as_is) = sign(shifted) THEN 'OK' WHEN abs(shifted) < 0.25 * abs(as_is) THEN 'SUSPECT' ELSE 'PARTIAL' END AS verdict FROM lp",
    lambda s, sf: m.feature_audits(audited_rows(s, sf), _X, ["y", "y5"]).withColumns({c: F.round(c, d) for c, d in (("as_is", 4), ("shifted", 4), ("delta", 4), ("pct_drop", 2))}),
    None,
)


def _retrained_sql(k: int, x1: str, x2: str, kept: str) -> str:
    """ir{k} (ir): the information ratio out of sample of the premia of x1 and x2, columns of ao, over its rows that are kept."""
    return (
        f"xy{k} AS (SELECT date, ticker, {x1} AS x1, {x2} AS x2, y FROM ao WHERE {kept}), fl{k} AS (SELECT date, y, coalesce(x1, median(x1) OVER (PARTITION BY date), 0) AS a, coalesce(x2, median(x2) OVER (PARTITION BY date), 0) AS b FROM xy{k}), "
        f"sm{k} AS (SELECT date, sum(a * a) + 1e-4 AS aa, sum(a * b) AS ab, sum(b * b) + 1e-4 AS bb, sum(a * y) AS ay, sum(b * y) AS cy FROM fl{k} WHERE y IS NOT NULL GROUP BY 1 HAVING count(*) >= 10), sl{k} AS (SELECT date, (bb * ay - ab * cy) / (aa * bb - ab * ab) AS x1, (aa * cy - ab * ay) / (aa * bb - ab * ab) AS x2 FROM sm{k}), "
        f"mn{k} AS (SELECT fold, avg(x1) AS b1, avg(x2) AS b2 FROM fo JOIN sl{k} sl ON sl.date <= train_end GROUP BY 1), md{k} AS (SELECT fold, median(x1) AS m1, median(x2) AS m2 FROM fo JOIN xy{k} xy ON xy.date <= train_end GROUP BY 1), "
        f"sc{k} AS (SELECT xy.date, xy.ticker, coalesce(x1, m1) * b1 + coalesce(x2, m2) * b2 AS s FROM xy{k} xy JOIN fo ON xy.date BETWEEN test_start AND test_end JOIN mn{k} USING (fold) JOIN md{k} USING (fold)), bo{k} AS (SELECT sc{k}.date, s, ao.y AS r FROM sc{k} JOIN ao ON ao.date = sc{k}.date AND ao.ticker = sc{k}.ticker WHERE s IS NOT NULL AND ao.y IS NOT NULL), "
        f"rk{k} AS (SELECT date, {_RK('s')} AS a, {_RK('r')} AS b FROM bo{k}), ic{k} AS (SELECT date, CASE WHEN count(*) >= 5 AND isfinite(corr(a, b)) THEN corr(a, b) END AS ic FROM rk{k} GROUP BY 1), ir{k} AS (SELECT avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(252) AS ir FROM ic{k})"
    )


add(
    "m15_retrained_audits",
    f"WITH RECURSIVE {_XY}, {_FOLDS}, ao AS (SELECT date, ticker, x1, x2, lag(x1) OVER ({T}) AS o1, lag(x2) OVER ({T}) AS o2, y FROM xy), {_retrained_sql(0, 'x1', 'x2', 'true')}, {_retrained_sql(1, 'o1', 'x2', 'o1 IS NOT NULL')}, {_retrained_sql(2, 'x1', 'o2', 'o2 IS NOT NULL')}, "
    "au AS (SELECT 'x1' AS feature, ir0.ir AS a, ir1.ir AS b FROM ir0, ir1 UNION ALL SELECT 'x2', ir0.ir, ir2.ir FROM ir0, ir2) "
    f"SELECT feature, {r6('a', 'as_is', 4)}, {r6('b', 'shifted', 4)}, {r6('b - a', 'delta', 4)}, CASE WHEN abs(a) >= 0.05 THEN round((a - b) / abs(a) * 100, 2) + 0.0 END AS pct_drop, CASE WHEN abs(b) > 0.5 * abs(a) AND sign(a) = sign(b) THEN 'OK' WHEN abs(b) < 0.25 * abs(a) THEN 'SUSPECT' ELSE 'PARTIAL' END AS verdict FROM au",
    lambda s, sf: m.retrained_audits(rows(s, sf), fold_rows(s, sf), _X, "y").withColumns({c: F.round(c, d) for c, d in (("as_is", 4), ("shifted", 4), ("delta", 4), ("pct_drop", 2))}),
    None,
)


@query("m8_early_stopping")
def _early(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees of each fold with a validation tail: their scores and how many trees each fold kept."""
    df = held(rows(spark, sf).withColumn("up", F.when(F.col("y") != 0, (F.col("y") > 0).cast("int"))), "rows")
    return tidy(m.walk_forward_scores(df, m.folds_table(df, _FIRST, months=24), _X, "up", "boosted"))


def sized_book(spark: SparkSession, sf: str, k: int, gross: float) -> DataFrame:
    """n, held: rows and gross weight of the books of the k best and worst; no k under 1."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return p.top_bottom(scores(spark, sf), k, gross / 2).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs("weight")), 6).alias("held"))


_BOOKS = "pm AS (SELECT * FROM (VALUES (0), (3), (8)) a(k), (VALUES (1.0), (2.0)) b(gross)), ct AS (SELECT date, count(*) AS n FROM panel GROUP BY 1)"
add(
    "m13_sensitivity",
    f"WITH {PANEL}, {_BOOKS} SELECT CAST(k AS BIGINT) AS k, CAST(gross AS DOUBLE) AS gross, CASE WHEN k > 0 THEN CAST(sum(CASE WHEN n >= 2 * k THEN 2 * k ELSE 0 END) AS BIGINT) END AS n, CASE WHEN k > 0 THEN round(CAST(sum(CASE WHEN n >= 2 * k THEN gross ELSE 0 END) AS DOUBLE), 6) END AS held, CASE WHEN k < 1 THEN 'k must be at least 1' END AS error FROM pm, ct GROUP BY k, gross",
    lambda s, sf: e.parameter_grid({"k": [0, 3, 8], "gross": [1.0, 2.0]}, sized_book, {"spark": s, "sf": sf}),
)


# feature families
def market_returns(spark: SparkSession, sf: str) -> DataFrame:
    """date, b: the market's log return; one row a date."""
    by_date = W.partitionBy(F.lit(0)).orderBy("date")
    return market(price_panel(spark, sf)).select("date", (F.ln("bench") - F.ln(F.lag("bench").over(by_date))).alias("b"))


def _family(parts: dict[str, tuple[str, str]]) -> str:
    """The registered SQL of single features side by side; parts: name -> (query, its column)."""
    known = registry._SQL
    tables = [f"({known[q].strip()}) q{i}" for i, q in enumerate(dict.fromkeys(q for q, _ in parts.values()))]
    at = {q: f"q{i}" for i, q in enumerate(dict.fromkeys(q for q, _ in parts.values()))}
    return "SELECT q0.date, q0.ticker, " + ", ".join(f"{at[q]}.{c} AS {name}" for name, (q, c) in parts.items()) + f" FROM {tables[0]} " + " ".join(f"JOIN {x} ON q0.date = q{i + 1}.date AND q0.ticker = q{i + 1}.ticker" for i, x in enumerate(tables[1:]))


_TECHNICAL = {
    **{f"ret_{d}d": (f"w1_log_return_{d}d", "ret") for d in (1, 5, 21, 63, 252)}, **{f"vol_{d}d": (f"w2_realised_vol_{d}d", "vol") for d in (5, 21, 63)},
    "rsi_14": ("w3_rsi", "rsi"), "macd": ("w4_macd", "macd"), "macd_signal": ("w4_macd", "macd_signal"), "macd_hist": ("w4_macd", "macd_hist"), "bb_z_20": ("w5_bollinger_z", "z"),
    "dist_high_252": ("w6_high_distance", "dist_high"), "dist_low_252": ("w6_low_distance", "dist_low"), "adv_proxy_21": ("w7_dollar_volume", "adv"), "skew_21": ("w8_rolling_skew", "skew"), "kurt_63": ("w9_rolling_kurtosis", "kurt"),
}
_SECOND = {"mom_12_1": ("w10_momentum_12_1", "mom"), "st_reversal_5": ("w11_reversal", "rev"), "max_ret_21": ("w12_max_return", "max_ret"), "amihud_21": ("w13_illiquidity", "illiq"), "beta_60": ("w14_rolling_beta", "beta"), "idio_vol_60": ("w15_idiosyncratic_vol", "idio_vol")}


def scaled(df: DataFrame) -> DataFrame:
    """Illiquidity per million, as its own query has it."""
    return df.withColumn("amihud_21", F.col("amihud_21") * 1e6)


add("m17_technical", _family(_TECHNICAL), lambda s, sf: features.technical(price_panel(s, sf)))
add("m17_second_tier", _family(_SECOND), lambda s, sf: scaled(features.second_tier(price_panel(s, sf), market_returns(s, sf))))
add("m17_full", _family({**_TECHNICAL, **_SECOND}), lambda s, sf: scaled(features.full(price_panel(s, sf), market_returns(s, sf))))


@query("p7_parity_book")
def _parity(spark: SparkSession, sf: str) -> DataFrame:
    """Long and short sides by hierarchical parity; no SQL, see the tests of the weights."""
    df = scores(spark, sf)
    return tidy(hierarchy.parity_book(df.select("date", "ticker", "score"), df.select("date", "ticker", "r"), share=0.2))

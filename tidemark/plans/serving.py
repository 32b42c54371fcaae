"""Queries of a read service over runs (orders), predictions and equity (lineitem), prices (the panel) and news (events)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import portfolio as p, serving as v
from ..sources import tables as tb
from ..sources.panel import market, price_panel, table
from .cross import add, scores
from .portfolio import BACKTEST, backtest, predictions
from .sql import PANEL, RETURNS, r6

_RUNS = "runs AS (SELECT o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS started, CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'failed' ELSE 'running' END AS status, o_orderpriority = '1-URGENT' AND o_totalprice > 400000 AS is_active FROM orders)"
_RUN = f"{_RUNS}, run AS (SELECT * FROM runs WHERE status = 'ok' ORDER BY is_active DESC, started DESC, run_id DESC LIMIT 1)"
_PREDS = "preds AS (SELECT l_orderkey AS run_id, l_linenumber AS ticker, round(l_extendedprice - 40000, 2) AS score FROM lineitem)"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "failed").otherwise("running")
    active = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.to_date("o_orderdate").alias("started"), status.alias("status"), active.alias("is_active"))


def run_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ticker"), F.round(F.col("l_extendedprice") - 40000, 2).alias("score"))


def fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    """ticker, market_cap (whole cents, so that its sum is exact) of nations with a supplier in debt."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey"))
    return s.groupBy(F.col("n_name").alias("ticker")).agg(F.sum(F.round(F.col("s_acctbal") * 100).cast("long")).alias("market_cap"), F.min("s_acctbal").alias("low")).where("low < 0").drop("low")


_FUND = "fund AS (SELECT n_name AS ticker, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS market_cap FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING min(s_acctbal) < 0)"
_LAST = "lst AS (SELECT ticker, max(date) AS date, arg_max(close, date) AS close FROM panel GROUP BY 1)"
add("v2_tickers", f"WITH {PANEL}, {_FUND}, {_LAST} SELECT ticker, date, close, market_cap FROM lst LEFT JOIN fund USING (ticker)", lambda s, sf: v.ticker_list(price_panel(s, sf), fundamentals(s, sf)), None)
add(
    "v3_ticker_details",
    f"WITH {PANEL}, own AS (SELECT * FROM panel WHERE ticker = 'NATION_7' AND date > (SELECT max(date) - 365 FROM panel WHERE ticker = 'NATION_7')), pr AS (SELECT date, volume AS score FROM panel WHERE ticker = 'NATION_7' AND volume > 50) SELECT own.date, close, score FROM own LEFT JOIN pr USING (date)",
    lambda s, sf: (lambda panel: v.ticker_detail(panel, panel.where("volume > 50").select(F.lit(1).alias("run_id"), "date", "ticker", F.col("volume").alias("score")), s.range(1, 2).select(F.col("id").alias("run_id")), "NATION_7", 365))(price_panel(s, sf)),
    None,
)
add(
    "v4_quotes",
    f"WITH {PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM panel), q AS (SELECT ticker, max(date) AS date, max(CASE WHEN k = 1 THEN close END) AS close, max(CASE WHEN k = 2 THEN close END) AS previous FROM k WHERE k <= 2 GROUP BY 1) "
    f"SELECT ticker, date, close, previous, close - previous AS change, (close - previous) / nullif(previous, 0) * 100 AS pct FROM q",
    lambda s, sf: v.quotes(price_panel(s, sf)),
    None,
)
add(
    "v5_latest_predictions",
    f"WITH {_RUN}, {_PREDS}, o AS (SELECT preds.ticker, score FROM preds JOIN run USING (run_id)), h AS (SELECT 'long' AS side, *, row_number() OVER (ORDER BY score DESC, ticker) AS place FROM o WHERE score > 0), l AS (SELECT 'short' AS side, *, row_number() OVER (ORDER BY score, ticker) AS place FROM o WHERE score < 0) SELECT * FROM h WHERE place <= 3 UNION ALL SELECT * FROM l WHERE place <= 3",
    lambda s, sf: v.best_and_worst(run_predictions(s, sf), v.resolved_run(runs(s, sf)), 3),
)
add("v6_run_listing", f"WITH {_RUNS} SELECT * FROM runs WHERE status = 'failed' ORDER BY started DESC, run_id DESC LIMIT 20", lambda s, sf: v.run_listing(runs(s, sf), 20, "failed"))
add("v7_activate", f"WITH {_RUNS} SELECT run_id, started, status, CASE WHEN (SELECT count(*) FROM runs WHERE run_id = 7 AND status = 'ok') > 0 THEN run_id = 7 ELSE is_active END AS is_active FROM runs", lambda s, sf: v.activated(runs(s, sf), 7))
add("v7_deactivate", f"WITH {_RUNS} SELECT run_id, started, status, is_active AND run_id <> 7 AS is_active FROM runs", lambda s, sf: v.deactivated(runs(s, sf), 7))
add("v8_backtest_summary", f"WITH {_RUN}, {_PREDS} SELECT run_id, ticker, score, status FROM preds JOIN run USING (run_id)", lambda s, sf: v.run_equity(v.resolved_run(runs(s, sf)), run_predictions(s, sf)))
add("v9_run_resolution", f"WITH {_RUN} SELECT * FROM run", lambda s, sf: v.resolved_run(runs(s, sf)))
add(
    "v11_trial_rows",
    "SELECT user_id, CAST(0 AS INT) AS trial, round(max(value), 6) + 0.0 AS sharpe, CAST(count(*) AS DOUBLE) AS depth FROM events GROUP BY 1 UNION ALL SELECT user_id, 1, NULL, NULL FROM events GROUP BY 1",
    lambda s, sf: v.trial_rows(
        table(s, sf, "events").groupBy("user_id").agg(F.max("value").alias("m"), F.count(F.lit(1)).alias("n")).select("user_id", F.format_string('[{"sharpe": %s, "params": {"depth": %s, "rate": 0.1}}, {"params": {"rate": 1}}]', F.col("m").cast("string"), F.col("n").cast("string")).alias("j")), "user_id", "j", "depth"
    ).select("user_id", "trial", "sharpe", F.try_element_at("params", F.lit("depth")).alias("depth")),
)
add("v12_watchlist", f"WITH {PANEL}, {_LAST} SELECT w.ticker, lst.date, lst.close FROM (SELECT r_name AS ticker FROM region UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 2) w LEFT JOIN lst USING (ticker)", lambda s, sf: v.watch_prices(table(s, sf, "region").select(F.col("r_name").alias("ticker")).unionByName(table(s, sf, "nation").where("n_regionkey = 2").select(F.col("n_name").alias("ticker"))), price_panel(s, sf)), None)
_NEWS = "news AS (SELECT user_id AS ticker, event_id AS news_id, ts AS published, event_type || ' ' || props AS headline FROM events)"


def news(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("ticker"), F.col("event_id").alias("news_id"), F.col("ts").alias("published"), F.concat_ws(" ", "event_type", "props").alias("headline"))


add(
    "v13_news",
    f"WITH {_NEWS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY published DESC, news_id) AS place FROM news), s AS (SELECT DISTINCT sha256(trim(lower(headline))) AS hash, 'bad' AS label FROM news WHERE headline LIKE 'error%') SELECT ticker, news_id, place, sha256(trim(lower(headline))) AS hash, label FROM k LEFT JOIN s ON s.hash = sha256(trim(lower(headline))) WHERE place <= 3",
    lambda s, sf: v.newest_news(news(s, sf), news(s, sf).where("headline like 'error%'").select(F.sha2(F.trim(F.lower("headline")), 256).alias("hash"), F.lit("bad").alias("label")).distinct(), 3).select("ticker", "news_id", "place", "hash", "label"),
)


def versions(spark: SparkSession, sf: str, status: str) -> DataFrame:
    own = table(spark, sf, "orders").where(F.col("o_orderstatus") == status)
    return own.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("value"))


_OLD, _NEW = ("(SELECT o_custkey AS k, max(o_orderkey) AS \"at\", arg_max(o_totalprice, o_orderkey) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)", "(SELECT o_custkey AS k, o_orderkey AS \"at\", o_totalprice AS value FROM orders WHERE o_orderstatus = 'O')")


def stored(spark: SparkSession, sf: str) -> DataFrame:
    return versions(spark, sf, "F").groupBy("k").agg(F.max("at").alias("at"), F.max_by("value", "at").alias("value"))


add("v14_upsert_ignore", f"WITH a AS {_OLD}, b AS {_NEW} SELECT * FROM a UNION ALL SELECT k, min(\"at\"), arg_min(value, \"at\") FROM b WHERE k NOT IN (SELECT k FROM a) GROUP BY 1", lambda s, sf: v.upsert_ignore(stored(s, sf), versions(s, sf, "O"), "k", order="at"))
add("v15_upsert_replace", f"WITH a AS {_OLD}, b AS {_NEW} SELECT k, max(\"at\") AS \"at\", arg_max(value, \"at\") AS value FROM b GROUP BY 1 UNION ALL SELECT * FROM a WHERE k NOT IN (SELECT k FROM b)", lambda s, sf: v.upsert_replace(stored(s, sf), versions(s, sf, "O"), "k", order="at"))
add(
    "v16_lifecycle",
    f"WITH {_RUNS}, ch AS (SELECT l_orderkey AS run_id, max(CASE WHEN l_linestatus = 'F' THEN 'failed' ELSE 'ok' END) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), lv AS (SELECT DISTINCT l_orderkey AS run_id FROM lineitem WHERE l_returnflag = 'A'), x AS (SELECT runs.run_id, started, is_active, coalesce(s, status) AS status, lv.run_id IS NOT NULL AS live FROM runs LEFT JOIN ch ON ch.run_id = runs.run_id LEFT JOIN lv ON lv.run_id = runs.run_id) SELECT run_id, started, is_active, CASE WHEN status = 'running' AND NOT live THEN 'crashed' ELSE status END AS status FROM x",
    lambda s, sf: (lambda li: v.with_status(runs(s, sf), li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linestatus") == "F", "failed").otherwise("ok").alias("new_status")), li.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("run_id"))))(table(s, sf, "lineitem")),
)
add("v17_retention", f"WITH {_RUNS}, {_PREDS}, k AS (SELECT run_id FROM runs ORDER BY started DESC, run_id DESC LIMIT 50) SELECT * FROM preds WHERE run_id IN (SELECT run_id FROM k)", lambda s, sf: v.retained(run_predictions(s, sf), runs(s, sf), 50))
_HORIZONS = "pr AS (SELECT date, ticker, 1 AS horizon, volume AS pred FROM rets UNION ALL SELECT date, ticker, 5, -volume + rn % 9 FROM rets WHERE rn % 4 <> 0)"
_BOOK5 = "o AS (SELECT date, ticker, volume AS score, row_number() OVER (PARTITION BY date ORDER BY volume, ticker) AS k, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY volume DESC, ticker) AS place FROM rets)"
add(
    "v18_snapshot",
    f"WITH {RETURNS}, {_HORIZONS}, {_BOOK5}, w AS (SELECT *, CAST(CASE WHEN n < 10 THEN 0 WHEN k > n - 5 THEN 0.1 WHEN k <= 5 THEN -0.1 ELSE 0 END AS DOUBLE) AS weight FROM o) "
    "SELECT w.date, w.ticker, score, weight, place, CASE WHEN weight > 0 THEN 'long' WHEN weight < 0 THEN 'short' END AS side, h1, h5 FROM w LEFT JOIN (SELECT date, ticker, max(CASE WHEN horizon = 1 THEN pred END) AS h1, max(CASE WHEN horizon = 5 THEN pred END) AS h5 FROM pr GROUP BY 1, 2) m ON m.date = w.date AND m.ticker = w.ticker",
    lambda s, sf: (lambda sc: v.snapshot(sc.select("date", "ticker", "score"), p.top_bottom(sc, 5, 0.5), predictions(s, sf)).select("date", "ticker", "score", "weight", "place", "side", F.try_element_at("per_horizon", F.lit("1")).alias("h1"), F.try_element_at("per_horizon", F.lit("5")).alias("h5")))(scores(s, sf)),
)
add(
    "v18_equity",
    f"WITH {BACKTEST}, dy AS (SELECT date, CASE WHEN gross IS NULL THEN 0.0 ELSE least(greatest(gross - turnover * 6 / 1e4, -5), 5) END AS r, turnover FROM bt), eq AS (SELECT *, product(1 + r) OVER (ORDER BY date) AS e FROM dy), be AS (SELECT date, ln(avg(close)) - ln(lag(avg(close)) OVER (ORDER BY date)) AS b FROM panel WHERE day(date) <> 13 GROUP BY 1) "
    f"SELECT eq.date, {r6('r', 'daily_return')}, {r6('ln(e)', 'log_growth')}, {r6('e / max(e) OVER (ORDER BY eq.date) - 1', 'drawdown')}, {r6('turnover', 'turnover')}, {r6('coalesce(b, 0)', 'benchmark_return')} FROM eq LEFT JOIN be ON be.date = eq.date",
    lambda s, sf: v.equity_curve(backtest(s, sf), market(price_panel(s, sf)).where("day(date) <> 13").select("date", F.col("bench").alias("adj_close"))).withColumn("log_growth", F.ln(1 + F.col("cumulative_return"))).drop("cumulative_return"),
)


def document(spark: SparkSession, sf: str) -> DataFrame:
    """The document of one ticker, its nested bars and predictions as text: date:whole volume, and date:score."""
    panel = price_panel(spark, sf)
    scored = panel.where("volume > 50").select(F.when(F.col("volume") % 3 == 0, 2).otherwise(1).alias("run_id"), "date", "ticker", F.col("volume").cast("long").alias("score"))
    found = v.ticker_document(fundamentals(spark, sf), panel.select("date", "ticker", F.col("volume").cast("long").alias("volume")), scored, spark.range(1, 2).select(F.col("id").alias("run_id")), "NATION_7", 365)
    line = lambda c, x: F.array_join(F.transform(c, lambda e: F.concat_ws(":", e["date"].cast("string"), e[x].cast("string"))), ",")
    return found.select("ticker", "market_cap", line("prices", "volume").alias("prices"), line("predictions", "score").alias("predictions"))


add(
    "v3_ticker_document",
    f"WITH {PANEL}, {_FUND}, own AS (SELECT date, CAST(volume AS BIGINT) AS v, volume > 50 AND CAST(volume AS BIGINT) % 3 <> 0 AS scored FROM panel WHERE ticker = 'NATION_7' AND date > (SELECT max(date) - 365 FROM panel WHERE ticker = 'NATION_7')) "
    "SELECT ticker, market_cap, (SELECT string_agg(CAST(date AS VARCHAR) || ':' || v, ',' ORDER BY date) FROM own) AS prices, (SELECT string_agg(CAST(date AS VARCHAR) || ':' || v, ',' ORDER BY date) FROM own WHERE scored) AS predictions FROM fund WHERE ticker = 'NATION_7'",
    document,
)


def trial_json(spark: SparkSession, sf: str) -> DataFrame:
    """Users as trials: a JSON row of metrics and parameters; those of few events have a penalty, some no figure."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("trial")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("m"))
    sharpe = F.when(F.col("n") % 7 == 0, F.lit("null")).when(F.col("n") < 40, F.lit("-99.0")).otherwise(F.col("m").cast("string"))
    return e.select("trial", F.format_string('{"trial": %s, "hold_sharpe": %s, "elapsed_s": 3, "error": null, "k": %s, "sizing": "hrp", "horizons": [1, 5]}', F.col("trial").cast("string"), sharpe, F.col("n").cast("string")).alias("row"))


add(
    "a23_best_so_far",
    "WITH t AS (SELECT user_id AS trial, count(*) AS n, max(value) AS best_sharpe FROM events GROUP BY 1), b AS (SELECT * FROM t WHERE n % 7 <> 0 AND n >= 40 ORDER BY best_sharpe DESC, trial LIMIT 1) SELECT trial, best_sharpe, 'horizons=[1,5];k=' || n || ';sizing=hrp' AS params FROM b",
    lambda s, sf: v.best_trial(trial_json(s, sf)).select("trial", "best_sharpe", F.array_join(F.transform(F.array_sort(F.map_entries("best_params")), lambda p_: F.concat_ws("=", p_["key"], F.replace(p_["value"], F.lit(" "), F.lit("")))), ";").alias("params")),
)


def configs(spark: SparkSession, sf: str, status: str) -> DataFrame:
    """Customers with orders of a status: a JSON object of a count, a text, a list and an object with its fields in either order."""
    o = table(spark, sf, "orders").where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    count = F.when(F.lit(status) == "F", F.concat(F.col("n").cast("string"), F.lit(".0"))).otherwise(F.col("n").cast("string"))
    nested = F.when(F.lit(status) == "F", F.lit('{"a": 1, "b": "x"}')).otherwise(F.lit('{"b":"x","a":1}'))
    more = F.when(F.lit(status) == "F", F.lit(', "only": null')).otherwise(F.lit(""))
    return o.select("k", F.concat(F.lit('{"n": '), count, F.lit(', "t": "'), count, F.lit('", "l": [1, '), F.col("n").cast("string"), F.lit('], "o": '), nested, more, F.lit("}")).alias("c"))


add(
    "f16_json_diff",
    "WITH f AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), o AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), "
    "v AS (SELECT k, unnest(['n', 't', 'l', 'o', 'only']) AS key, unnest([CAST(n AS VARCHAR), '\"' || n || '.0\"', '[1,' || n || ']', '{\"a\":1,\"b\":\"x\"}', 'null']) AS a FROM f), w AS (SELECT k, unnest(['n', 't', 'l', 'o']) AS key, unnest([CAST(n AS VARCHAR), '\"' || n || '\"', '[1,' || n || ']', '{\"a\":1,\"b\":\"x\"}']) AS b FROM o) "
    "SELECT coalesce(v.k, w.k) AS k, coalesce(v.key, w.key) AS key, a, b FROM v FULL JOIN w ON v.k = w.k AND v.key = w.key WHERE a IS DISTINCT FROM b",
    lambda s, sf: v.config_diff(configs(s, sf, "F"), configs(s, sf, "O"), "c", "k"),
)
add(
    "s26_markdown_report",
    "WITH t AS (SELECT user_id AS trial, CAST(count(*) AS BIGINT) AS n, max(value) AS m FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY m DESC, trial) AS k FROM t) SELECT -1 AS place, '| Rank | Trial | Sharpe | Events |' AS line UNION ALL SELECT 0, '| --- | --- | --- | --- |' UNION ALL SELECT CAST(k AS INT), '| ' || k || ' | ' || trial || ' | ' || printf('%+.3f', m) || ' | ' || CASE WHEN n % 2 = 0 THEN CAST(n AS VARCHAR) ELSE 'nan' END || ' |' FROM r WHERE k <= 10",
    lambda s, sf: tb.markdown_table(
        table(s, sf, "events").groupBy("user_id").agg(F.max("value").alias("m"), F.count(F.lit(1)).alias("n")), [F.desc("m"), F.col("user_id")],
        {"Trial": F.col("user_id").cast("string"), "Sharpe": F.format_string("%+.3f", "m"), "Events": F.when(F.col("n") % 2 == 0, F.col("n").cast("string"))},
    ),
)
add("v19_additive_columns", "SELECT o_custkey AS k, o_totalprice AS value, NULL AS note FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'O'", lambda s, sf: v.migrated(versions(s, sf, "F").select("k", "value"), table(s, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("note"))))

"""Queries of joins, of event counts and of membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import tidy
from ..operators import joins as j, labels, timeaxis as t
from ..sources.panel import market, price_panel, table, trading_days
from .cross import _SPANS, add, spans
from .sql import PANEL, RETURNS, T, r6
from .time import returns

_CAL = "cal AS (SELECT d AS date FROM (SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)) + 7, INTERVAL 1 DAY)) AS DATE) AS d FROM events) WHERE isodow(d) < 6)"
_DAILY = "dc AS (SELECT CAST(ts AS DATE) AS date, user_id, count(*) AS n FROM events GROUP BY 1, 2)"
_FWD = f"{_CAL}, {_DAILY}, td AS (SELECT dc.*, (SELECT min(cal.date) FROM cal WHERE cal.date >= dc.date) AS trading_day FROM dc)"


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("date"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    return trading_days(table(spark, sf, "events"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return price_panel(spark, sf).select("date", "ticker", labels.forward_return(5).alias("fwd")).where("fwd is not null")


_FW = f"lb AS (SELECT * FROM (SELECT date, ticker, ln(lead(close, 6) OVER ({T})) - ln(lead(close, 1) OVER ({T})) AS fwd FROM panel) WHERE fwd IS NOT NULL)"
add("j1_features_labels", f"WITH {RETURNS}, {_FW} SELECT date, ticker, {r6('r', 'r')}, {r6('fwd', 'fwd')} FROM rets JOIN lb USING (date, ticker)", lambda s, sf: returns(s, sf).select("date", "ticker", "r").join(labelled(s, sf), ["date", "ticker"]))
add("j2_left_features", f"WITH {RETURNS}, {_FW} SELECT date, ticker, {r6('r', 'r')}, {r6('coalesce(fwd, 0)', 'fwd')} FROM rets LEFT JOIN lb USING (date, ticker)", lambda s, sf: returns(s, sf).select("date", "ticker", "r").join(labelled(s, sf), ["date", "ticker"], "left").na.fill(0.0, ["fwd"]))
add("j3_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS orders, b.n AS accounts FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, 1 AS n FROM customer WHERE c_acctbal > 5000) b ON a.k = b.k", lambda s, sf: table(s, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("orders")).join(table(s, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), F.lit(1).alias("accounts")), "k", "full"))
add("j4_asof_forward", f"WITH {_FWD} SELECT * FROM td WHERE trading_day IS NOT NULL", lambda s, sf: j.asof_forward(daily(s, sf), calendar(s, sf)))
add("j5_asof_backward", f"WITH {PANEL}, v AS (SELECT date, avg(close) AS bench FROM panel WHERE isodow(date) = 1 GROUP BY 1) SELECT p.date, p.ticker, {r6('v.bench', 'bench')} FROM panel p ASOF LEFT JOIN v ON p.date >= v.date", lambda s, sf: j.asof_backward(price_panel(s, sf).select("date", "ticker"), market(price_panel(s, sf).where(F.dayofweek("date") == 2)), columns=("bench",)))
add("j6_point_in_time", f"WITH {_SPANS}, {_DAILY} SELECT dc.* FROM dc JOIN iv USING (user_id) WHERE (start_date IS NULL OR start_date <= date) AND (end_date IS NULL OR end_date > date)", lambda s, sf: j.within(daily(s, sf), spans(s, sf), "user_id"))
add("j7_map_join", "SELECT c_custkey, coalesce(r_name, 'none') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'", lambda s, sf: table(s, sf, "customer").join(table(s, sf, "nation"), F.expr("c_nationkey = n_nationkey"), "left").join(table(s, sf, "region"), F.expr("n_regionkey = r_regionkey and r_name <> 'ASIA'"), "left").select("c_custkey", F.coalesce("r_name", F.lit("none")).alias("region")))
add("j8_mirror", "SELECT s_suppkey, c.n_nationkey, n FROM supplier JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON s_nationkey = c.n_nationkey", lambda s, sf: table(s, sf, "supplier").join(table(s, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n")), F.expr("s_nationkey = n_nationkey")).select("s_suppkey", "n_nationkey", "n"))
add("j9_latest_per_group", f"WITH {PANEL} SELECT ticker, max(date) AS date, arg_max(close, date) AS close, arg_max(sector, date) AS sector FROM panel GROUP BY 1", lambda s, sf: j.latest(price_panel(s, sf), "ticker", "date", "close", "sector"), None)
add("j10_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", lambda s, sf: table(s, sf, "customer").join(table(s, sf, "orders").where("o_orderstatus = 'P'"), F.expr("c_custkey = o_custkey"), "left_semi").select("c_custkey"))
add("j11_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", lambda s, sf: table(s, sf, "customer").join(table(s, sf, "orders").where("o_orderstatus = 'P'"), F.expr("c_custkey = o_custkey"), "left_anti").select("c_custkey"))
add("j12_calendar_keys", f"WITH {_CAL} SELECT n_name, date FROM nation CROSS JOIN cal", lambda s, sf: table(s, sf, "nation").select("n_name").join(calendar(s, sf).select(F.collect_list("date").alias("days")), F.lit(True)).select("n_name", F.explode("days").alias("date")))
add("j13_scores_weights", f"WITH {PANEL} SELECT date, ticker, volume AS score, coalesce(CASE WHEN volume > 100 THEN 0.5 END, 0.0)::DOUBLE AS weight FROM panel", lambda s, sf: (lambda p: p.select("date", "ticker", F.col("volume").alias("score")).join(p.where("volume > 100").select("date", "ticker", F.lit(0.5).alias("weight")), ["date", "ticker"], "left").na.fill(0.0, ["weight"]))(price_panel(s, sf)))
add("j14_reverse_lookup", "SELECT c_custkey, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", lambda s, sf: table(s, sf, "customer").join(table(s, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_order")), "c_custkey", "left").select("c_custkey", "first_order"))

# event counts
add("a1_events_per_day", f"WITH {_DAILY} SELECT * FROM dc", daily)
add("a2_rebucketed", f"WITH {_FWD} SELECT trading_day, user_id, CAST(sum(n) AS BIGINT) AS n FROM td WHERE trading_day IS NOT NULL GROUP BY 1, 2", lambda s, sf: j.asof_forward(daily(s, sf), calendar(s, sf)).groupBy("trading_day", "user_id").agg(F.sum("n").alias("n")))
add("a3_event_flag", "SELECT CAST(ts AS DATE) AS date, user_id, max(CAST(event_type = 'purchase' AS INT)) AS flag FROM events GROUP BY 1, 2", lambda s, sf: table(s, sf, "events").groupBy(F.to_date("ts").alias("date"), "user_id").agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("flag")))
_ITEMS = "it AS (SELECT CAST(ts AS DATE) AS date, user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS items FROM events GROUP BY 1, 2)"
add("a4_item_families", f"WITH {_ITEMS} SELECT date, user_id, CAST(list_has_any(string_split(items, ', '), ['signup', 'purchase']) AS INT) AS trade, CAST(list_has_any(string_split(items, ', '), ['error']) AS INT) AS trouble FROM it", lambda s, sf: table(s, sf, "events").groupBy(F.to_date("ts").alias("date"), "user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ", ").alias("items")).select("date", "user_id", j.has_any("items", ("signup", "purchase")).alias("trade"), j.has_any("items", ("error",)).alias("trouble")))
_TONE = f"SELECT CAST(ts AS DATE) AS date, user_id, count(*) AS n, {r6('avg(value)', 'tone_mean')}, {r6('stddev_pop(value)', 'tone_std')} FROM events GROUP BY 1, 2"
add("a5_tone_moments", _TONE, lambda s, sf: table(s, sf, "events").groupBy(F.to_date("ts").alias("date"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("tone_mean"), F.stddev_pop("value").alias("tone_std")))
add("a6_tone_by_day", f"WITH d AS (SELECT CAST(ts AS DATE) AS date, user_id, count(*) AS n, avg(value) AS m FROM events GROUP BY 1, 2) SELECT date, CAST(sum(n) AS BIGINT) AS n, {r6('avg(m)', 'tone_mean')} FROM d GROUP BY 1", lambda s, sf: table(s, sf, "events").groupBy(F.to_date("ts").alias("date"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m")).groupBy("date").agg(F.sum("n").alias("n"), F.avg("m").alias("tone_mean")))
add(
    "m18_event_panel",
    f"WITH {_FWD}, c AS (SELECT trading_day AS date, user_id, sum(n) AS n FROM td GROUP BY 1, 2), dn AS (SELECT date, user_id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM cal CROSS JOIN (SELECT DISTINCT user_id FROM events) LEFT JOIN c USING (date, user_id)) "
    "SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY date ROWS 4 PRECEDING) AS BIGINT) AS n_5, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY date ROWS 20 PRECEDING) AS BIGINT) AS n_21 FROM dn",
    lambda s, sf: j.event_panel(table(s, sf, "events"), calendar(s, sf), "user_id"),
)


def family_days(spark: SparkSession, sf: str) -> DataFrame:
    """Events of two families by day and user, and their mean value as a tone."""
    family = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    rows = table(spark, sf, "events").groupBy(F.to_date("ts").alias("date"), "user_id")
    return rows.agg(family("signup", "purchase").alias("trade"), family("error").alias("trouble"), F.avg("value").alias("tone"))


_ROLL = lambda f, c, d: f"{f}({c}) OVER (PARTITION BY user_id ORDER BY date ROWS {d - 1} PRECEDING)"
add(
    "m18_family_panel",
    f"WITH {_FWD}, fd AS (SELECT CAST(ts AS DATE) AS day, user_id, count_if(event_type IN ('signup', 'purchase')) AS trade, count_if(event_type = 'error') AS trouble, avg(value) AS tone FROM events GROUP BY 1, 2), "
    "mv AS (SELECT td.trading_day AS date, fd.user_id, sum(trade) AS trade, sum(trouble) AS trouble, avg(tone) AS tone FROM fd JOIN (SELECT DISTINCT date AS day, trading_day FROM td) td USING (day) WHERE trading_day IS NOT NULL GROUP BY 1, 2), "
    "dn AS (SELECT date, user_id, CAST(coalesce(trade, 0) AS BIGINT) AS trade, CAST(coalesce(trouble, 0) AS BIGINT) AS trouble, tone FROM cal CROSS JOIN (SELECT DISTINCT user_id FROM events) LEFT JOIN mv USING (date, user_id)) "
    f"SELECT date, user_id, trade, trouble, {r6('tone', 'tone')}, " + ", ".join(f"CAST({_ROLL('sum', c, d)} AS BIGINT) AS {c}_{d}" for c in ("trade", "trouble") for d in (5, 21)) + ", " + ", ".join(r6(_ROLL("avg", "tone", d), f"tone_{d}") for d in (5, 21)) + " FROM dn",
    lambda s, sf: j.measure_panel(family_days(s, sf), calendar(s, sf), "user_id", ("trade", "trouble"), ("tone",)),
)

"""Queries across tickers, of filters and selections, of sorts and limits, and of set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import bucket_of, clip, finite, starting, tidy, without_leaks
from ..operators import timeaxis as t, xsection as x
from ..operators.serving import faceted
from ..sources.panel import market, price_panel, table
from .registry import query
from .sql import PANEL, RETURNS, T, r6
from .time import _SMALL, returns, small_return

_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
_RANK = "rank() OVER (PARTITION BY date, r IS NULL ORDER BY r) + (count(*) OVER (PARTITION BY date, r) - 1) / 2.0"
RANKED = RETURNS + f", rk AS (SELECT *, count(r) OVER (PARTITION BY date) AS n, {_RANK} AS k FROM rets)"
_CENTRED = "CASE WHEN n <= 1 THEN 0.0 WHEN r IS NULL THEN NULL ELSE (k - 1) / nullif(n - 1, 0) - 0.5 END"


def add(name: str, sql: str, make, digits: int | None = 6) -> None:
    query(name, sql)(lambda spark, sf: tidy(make(spark, sf), digits))


add("c1_centred_rank", f"WITH {RANKED} SELECT date, ticker, {r6(_CENTRED, 'r_rank')} FROM rk", lambda s, sf: returns(s, sf).select("date", "ticker", x.centred_rank("r").alias("r_rank")))
add("c1_centred_ranks_unpivoted", f"WITH {RANKED} SELECT date, ticker, {r6(_CENTRED, 'r_rank')} FROM rk", lambda s, sf: x.centred_ranks(returns(s, sf), ["r"]))
add("c2_sector_neutral", f"WITH {PANEL} SELECT date, ticker, {r6('volume - avg(volume) OVER (PARTITION BY date, sector)', 'volume_sn')} FROM panel", lambda s, sf: price_panel(s, sf).select("date", "ticker", x.neutralised("volume").alias("volume_sn")))
add(
    "c3_sector_one_hot",
    f"WITH {PANEL} SELECT date, ticker, " + ", ".join(f"CAST(sector = '{v}' AS INT) AS \"sec_{v.replace(' ', '_')}\"" for v in _REGIONS) + " FROM panel",
    lambda s, sf: price_panel(s, sf).select("date", "ticker", *[c.cast("int").alias(f"sec_{v.replace(' ', '_')}") for v, c in zip(_REGIONS, x.one_hot(list(_REGIONS)), strict=True)]),
)
_DISP = RETURNS + ", d AS (SELECT date, stddev_samp(r) AS dispersion FROM rets GROUP BY 1)"
_LAST21 = "(ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"
_DMEAN = f"CASE WHEN count(dispersion) OVER {_LAST21} >= 10 THEN avg(dispersion) OVER {_LAST21} END"
add("c4_dispersion", f"WITH {_DISP} SELECT date, {r6('dispersion', 'dispersion')}, {r6(_DMEAN, 'dispersion_mean')} FROM d", lambda s, sf: x.dispersion(returns(s, sf), "r"))
_Z = "coalesce((volume - avg(volume) OVER (PARTITION BY date)) / nullif(stddev_samp(volume) OVER (PARTITION BY date), 0), 0)"
add("c5_z_score", f"WITH {PANEL} SELECT date, ticker, {r6(_Z, 'z')} FROM panel", lambda s, sf: price_panel(s, sf).select("date", "ticker", x.z_score("volume").alias("z")))
for _name, _down in (("c6_first_rank", False), ("c7_descending_rank", True)):
    add(
        _name,
        f"WITH {PANEL} SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY volume {'DESC' if _down else 'ASC'}, ticker) AS rank FROM panel",
        lambda s, sf, d=_down: price_panel(s, sf).select("date", "ticker", x.first_rank("volume", d).cast("long").alias("rank")),
    )
add("c8_date_scalars", f"WITH {PANEL}, m AS (SELECT date, avg(close) AS bench FROM panel GROUP BY 1) SELECT date, ticker, {r6('bench', 'reg_bench')} FROM panel JOIN m USING (date)", lambda s, sf: x.with_date_scalars(price_panel(s, sf).select("date", "ticker"), market(price_panel(s, sf))))
_REGIME = _DISP + ", l AS (SELECT date, stddev_samp(r) AS level, max(close) - min(close) AS spread FROM rets GROUP BY 1)"
_LAG = lambda c, k: f"{c} - lag({c}, {k}) OVER (ORDER BY date)"
add(
    "c9_regime",
    f"WITH {_REGIME}, dm AS (SELECT date, dispersion, {_DMEAN} AS dispersion_mean FROM d) SELECT date, {r6('level', 'level')}, {r6(_LAG('level', 5), 'level_5')}, {r6(_LAG('level', 21), 'level_21')}, {r6('spread', 'spread', 3)}, "
    f"{r6('spread / nullif(lag(spread, 21) OVER (ORDER BY date), 0) - 1', 'spread_21', 3)}, {r6('dispersion', 'dispersion')}, {r6('dispersion_mean', 'dispersion_mean')} FROM l LEFT JOIN dm USING (date)",
    lambda s, sf: x.regime(returns(s, sf)).withColumns({c: F.round(c, 3) for c in ("spread", "spread_21")}),
)
add("c10_equal_weight", f"WITH {RETURNS} SELECT date, {r6('avg(r)', 'bench_return')} FROM rets GROUP BY 1", lambda s, sf: x.equal_weight(returns(s, sf), "r"))


# selections and predicates
def features(spark: SparkSession, sf: str) -> DataFrame:
    """A panel with the prefixes and suffixes by which columns are chosen."""
    df = returns(spark, sf)
    ranked = df.select("date", "ticker", "volume", "close", x.centred_rank("volume").alias("volume_rank"), F.when(F.col("sector") == "ASIA", 1.0).otherwise(0.0).alias("sec_ASIA"), t.log_return(5).alias("fwd_x"))
    return ranked


_FEATURES = RETURNS.replace("AS rn FROM panel)", "AS rn FROM panel)") + ", f AS (SELECT date, ticker, volume, close, CASE WHEN count(*) OVER (PARTITION BY date) <= 1 THEN 0.0 ELSE (rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0 - 1) / nullif(count(*) OVER (PARTITION BY date) - 1, 0) - 0.5 END AS volume_rank, CASE WHEN sector = 'ASIA' THEN 1.0 ELSE 0.0 END AS \"sec_ASIA\" FROM rets)"
add("f1_ranks_only", f"WITH {_FEATURES} SELECT date, ticker, CAST(\"sec_ASIA\" AS DOUBLE) AS \"sec_ASIA\", {r6('volume_rank', 'volume_rank')} FROM f", lambda s, sf: (lambda d: d.select("date", "ticker", *starting(d, "sec_", "reg_", ends=("_rank",))))(features(s, sf)))
add("f2_blocklist", f"WITH {PANEL} SELECT date, ticker, volume FROM panel", lambda s, sf: price_panel(s, sf).drop("sector", "close"))
add("f3_allow_list", f"WITH {PANEL} SELECT date, ticker, close FROM panel", lambda s, sf: price_panel(s, sf).select("date", "ticker", "close"), None)


def leak_safe(df: DataFrame) -> DataFrame:
    """df without labels; a forbidden name is an error."""
    return df.select(*without_leaks(df.columns, drop_labels=True))


add("f4_leak_safe", f"WITH {_FEATURES} SELECT date, ticker, volume, close, volume_rank, CAST(\"sec_ASIA\" AS DOUBLE) AS \"sec_ASIA\" FROM f", lambda s, sf: leak_safe(features(s, sf)), None)
add("f5_sector_local", f"WITH {_FEATURES} SELECT date, ticker, volume, close, CAST(\"sec_ASIA\" AS DOUBLE) AS \"sec_ASIA\" FROM f", lambda s, sf: (lambda d: d.drop(*starting(d, "reg_", "fwd_", ends=("_rank",))))(features(s, sf)), None)

_SPANS = "iv AS (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN CAST(ts AS DATE) END) AS start_date, max(CASE WHEN event_type = 'error' THEN CAST(ts AS DATE) END) AS end_date FROM events GROUP BY 1)"


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, start_date, end_date: first signup and last error, either may be NULL (open)."""
    day = lambda kind: F.when(F.col("event_type") == kind, F.to_date("ts"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.min(day("signup")).alias("start_date"), F.max(day("error")).alias("end_date"))


def members_on(df: DataFrame, day: str) -> DataFrame:
    """Intervals that hold the day; they end before their last day."""
    d = F.lit(day).cast("date")
    return df.where((F.col("start_date").isNull() | (F.col("start_date") <= d)) & (F.col("end_date").isNull() | (F.col("end_date") > d)))


def overlapping(df: DataFrame, low: str, high: str) -> DataFrame:
    """Intervals that share a day with [low, high]; their last day counts."""
    a, b = F.lit(low).cast("date"), F.lit(high).cast("date")
    return df.where((F.col("start_date").isNull() | (F.col("start_date") <= b)) & (F.col("end_date").isNull() | (F.col("end_date") >= a)))


add("f6_members_on", f"WITH {_SPANS} SELECT * FROM iv WHERE (start_date IS NULL OR start_date <= DATE '2024-01-15') AND (end_date IS NULL OR end_date > DATE '2024-01-15')", lambda s, sf: members_on(spans(s, sf), "2024-01-15"))
add("f7_interval_overlap", f"WITH {_SPANS} SELECT * FROM iv WHERE (start_date IS NULL OR start_date <= DATE '2024-01-10') AND (end_date IS NULL OR end_date >= DATE '2024-01-29')", lambda s, sf: overlapping(spans(s, sf), "2024-01-29", "2024-01-10"))
add("f8_random_universe", "SELECT DISTINCT n_name AS ticker FROM nation ORDER BY sha256('7|' || n_name) LIMIT 10", lambda s, sf: table(s, sf, "nation").select(F.col("n_name").alias("ticker")).distinct().orderBy(F.sha2(F.concat(F.lit("7|"), "ticker"), 256)).limit(10))


def universe(intervals: DataFrame, mode: str, n: int, key: str = "user_id", seed: str = "7") -> DataFrame:
    """The keys of a universe of n: current (open intervals, by key), first (any, by key) or random (by a seeded hash)."""
    if mode not in ("current", "first", "random"):
        raise ValueError(f"unknown universe: {mode!r}")
    keys = (intervals.where("end_date is null") if mode == "current" else intervals).select(key).distinct()
    return keys.orderBy(*([F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)] if mode == "random" else []), key).limit(n)


add("f8_current_universe", f"WITH {_SPANS} SELECT user_id FROM iv WHERE end_date IS NULL ORDER BY user_id LIMIT 20", lambda s, sf: universe(spans(s, sf), "current", 20))
add("f8_first_universe", f"WITH {_SPANS} SELECT DISTINCT user_id FROM iv ORDER BY user_id LIMIT 20", lambda s, sf: universe(spans(s, sf), "first", 20))
add("f9_drop_nulls", f"WITH {RETURNS} SELECT date, ticker, {r6('r', 'r')} FROM rets WHERE r IS NOT NULL", lambda s, sf: returns(s, sf).select("date", "ticker", "r").na.drop(subset=["r"]))
add("f10_clip", f"WITH {RETURNS} SELECT date, ticker, {r6('CASE WHEN r IS NULL THEN NULL ELSE least(greatest(r, -0.5), 0.5) END', 'r')} FROM rets", lambda s, sf: returns(s, sf).select("date", "ticker", clip(F.col("r"), -0.5, 0.5).alias("r")))
add("f11_floor_to_null", f"WITH {RETURNS} SELECT date, ticker, {r6('CASE WHEN r > 0.01 THEN r END', 'r')}, nullif(volume, 50) AS volume FROM rets", lambda s, sf: returns(s, sf).select("date", "ticker", F.when(F.col("r") > 0.01, F.col("r")).alias("r"), F.nullif("volume", F.lit(50.0)).alias("volume")))
add("f12_finite", f"WITH {RETURNS} SELECT date, ticker, {r6('r', 'r')} FROM rets", lambda s, sf: returns(s, sf).select("date", "ticker", finite(F.col("r")).alias("r")))
add("f13_valid_ticker", r"SELECT c_custkey, upper(trim(c_name)) AS ticker, regexp_full_match(upper(trim(c_name)), '\^?[A-Z][A-Z0-9.\-=]{0,15}') AS valid FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS c_name FROM customer)", lambda s, sf: table(s, sf, "customer").select("c_custkey", F.upper(F.trim(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment")))).alias("ticker")).withColumn("valid", F.col("ticker").rlike(r"^\^?[A-Z][A-Z0-9.\-=]{0,15}$")))
add("f14_faceted_search", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#2' AND (contains(lower(p_name), 'eco') OR contains(lower(p_type), 'eco'))", lambda s, sf: faceted(table(s, sf, "part"), "eco", ("p_name", "p_type"), p_brand="Brand#2").select("p_partkey", "p_name"))
add("f15_history_filter", "SELECT o_orderkey FROM orders WHERE CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'failed' ELSE 'other' END = 'failed' AND contains(lower(CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority), '5-l')", lambda s, sf: table(s, sf, "orders").where("case o_orderstatus when 'O' then 'ok' when 'F' then 'failed' else 'other' end = 'failed' and contains(lower(concat(o_orderkey, ' ', o_orderpriority)), '5-l')").select("o_orderkey"))


add("f8_hash_buckets", "SELECT CAST(('0x' || substr(sha256(p_name || '|' || p_partkey), 1, 2)) AS INT) AS bucket, count(*) AS n FROM part GROUP BY 1", lambda s, sf: table(s, sf, "part").groupBy(bucket_of(F.concat_ws("|", "p_name", "p_partkey")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys whose values differ between two tables (key, value): a full outer join by key."""
    both = a.toDF("key", "a").join(b.toDF("key", "b"), "key", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


add("f16_config_diff", "SELECT coalesce(a.l_suppkey, b.l_suppkey) AS key, a.n AS a, b.n AS b FROM (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a FULL JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON a.l_suppkey = b.l_suppkey WHERE a.n IS DISTINCT FROM b.n", lambda s, sf: config_diff(*[table(s, sf, "lineitem").where(F.col("l_returnflag") == f).groupBy("l_suppkey").count() for f in "AR"]))

# sorts, limits, top-k
BOOK = RETURNS + ", sc AS (SELECT date, ticker, volume AS score FROM rets), o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS k, count(*) OVER (PARTITION BY date) AS n FROM sc)"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """date, ticker, score, vol, r: traded volume as a score whose order no engine's rounding changes."""
    return returns(spark, sf).withColumn("vol", t.lagged_vol("r", 21)).select("date", "ticker", "sector", F.col("volume").alias("score"), "vol", "r")


def _register_books() -> None:
    from ..operators import portfolio as p

    add("k1_top_bottom_k", f"WITH {BOOK} SELECT date, ticker, CAST(CASE WHEN k > n - 5 THEN 0.5 / 5 ELSE -0.5 / 5 END AS DOUBLE) AS weight FROM o WHERE n >= 10 AND (k <= 5 OR k > n - 5)", lambda s, sf: p.top_bottom(scores(s, sf), 5, 0.5))
    add("k1_top_bottom_share", f"WITH {BOOK}, m AS (SELECT *, greatest(1, CAST(floor(n * 0.15) AS BIGINT)) AS m FROM o) SELECT date, ticker, {r6('CASE WHEN k > n - m THEN 0.5 / m ELSE -0.5 / m END', 'weight')} FROM m WHERE n >= 2 * m AND (k <= m OR k > n - m)", lambda s, sf: p.top_bottom(scores(s, sf), 0.15, 0.5))
    add(
        "k2_inverse_vol_book",
        f"WITH {RETURNS}, v AS (SELECT date, ticker, volume AS score, CASE WHEN count(r) OVER w >= 21 THEN stddev_samp(r) OVER w END AS vol FROM rets WINDOW w AS ({T} ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)), "
        "g AS (SELECT * FROM v WHERE vol > 1e-6), o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS k, count(*) OVER (PARTITION BY date) AS n FROM g), "
        "s AS (SELECT *, least(greatest(1, CAST(floor(n * 0.2) AS BIGINT)), n // 2) AS m FROM o WHERE n >= 10), b AS (SELECT *, CASE WHEN k > n - m THEN 1 ELSE -1 END AS side FROM s WHERE k <= m OR k > n - m) "
        f"SELECT date, ticker, {r6('0.5 * side / vol / sum(1 / vol) OVER (PARTITION BY date, side)', 'weight')} FROM b",
        lambda s, sf: p.inverse_vol(scores(s, sf), leverage=0.5),
    )
    add("k5_quartile_features", f"WITH {PANEL}, f AS (SELECT ticker, sum(volume) AS v FROM panel GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY v, ticker) AS k, count(*) OVER () AS n FROM f) SELECT ticker, CASE WHEN k <= round(n * 0.25) THEN 'bottom' ELSE 'top' END AS side FROM o WHERE k <= round(n * 0.25) OR k > n - round(n * 0.25)", lambda s, sf: p.quartiles(price_panel(s, sf).groupBy("ticker").agg(F.sum("volume").alias("v")), "v"))


_register_books()
add("k3_latest_movers", "WITH l AS (SELECT CAST(max(ts) AS DATE) AS d FROM events), e AS (SELECT user_id, sum(CAST(round(value * 100) AS BIGINT)) AS score FROM events, l WHERE CAST(ts AS DATE) = d GROUP BY 1) SELECT * FROM e WHERE score > 0 ORDER BY score DESC, user_id LIMIT 5", lambda s, sf: table(s, sf, "events").withColumn("d", F.to_date("ts")).join(table(s, sf, "events").agg(F.to_date(F.max("ts")).alias("d")), "d").groupBy("user_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("score")).where("score > 0").orderBy(F.desc("score"), "user_id").limit(5))
add("k4_latest_orders", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20", lambda s, sf: table(s, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select("o_orderkey", "o_orderstatus"))
_TRIALS = "tr AS (SELECT user_id AS trial, CASE WHEN count(*) > 60 THEN round(avg(value), 6) END AS sharpe FROM events GROUP BY 1)"


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """trial, sharpe: a user's mean value, from a decimal sum, which is the same in any order of the rows: in every job of a plan, and at ties."""
    mean = F.sum(F.col("value").cast("decimal(24,8)")) / F.count("value")
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("trial")).agg(F.when(F.count(F.lit(1)) > 60, F.round(mean, 6).cast("double")).alias("sharpe"))


add("k6_sorted_trials", f"WITH {_TRIALS} SELECT *, row_number() OVER (ORDER BY sharpe DESC NULLS LAST, trial) AS place FROM tr", lambda s, sf: x.places(trials(s, sf), "sharpe", "trial", descending=True))
add("k7_table_sort", f"WITH {_TRIALS} SELECT *, row_number() OVER (ORDER BY sharpe ASC NULLS LAST, trial) AS place FROM tr", lambda s, sf: x.places(trials(s, sf), "sharpe", "trial"))


def merged_jobs(live: DataFrame, stored: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Live rows, and stored ones that aren't live, newest first."""
    return live.unionByName(stored.join(live, key, "left_anti")).orderBy(F.desc(order), key).limit(most)


add("k8_merged_jobs", "WITH a AS (SELECT o_orderkey, o_orderdate, 'live' AS origin FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_orderkey, o_orderdate, 'stored' AS origin FROM orders) SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)) ORDER BY o_orderdate DESC, o_orderkey LIMIT 50", lambda s, sf: (lambda o: merged_jobs(o.where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate", F.lit("live").alias("origin")), o.select("o_orderkey", "o_orderdate", F.lit("stored").alias("origin")), "o_orderkey", "o_orderdate", 50))(table(s, sf, "orders")))

# set operations
_A, _B = "(SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')", "(SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')"


def keys_of(spark: SparkSession, sf: str, status: str) -> DataFrame:
    return table(spark, sf, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k")).distinct()


def disjoint_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Both tables; a key that both have makes the query fail."""
    both = a.unionByName(b)
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    return both.withColumn("_n", n).where(F.assert_true(F.col("_n") == 1, F.lit("a key is in both tables")).isNull()).drop("_n")


def keep_last(df: DataFrame, key: str, *order) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


add("u1_union_all", f"SELECT * FROM {_A} UNION ALL SELECT * FROM {_B}", lambda s, sf: keys_of(s, sf, "F").unionByName(keys_of(s, sf, "O")))
add("u2_disjoint_union", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O')", lambda s, sf: disjoint_union(*[table(s, sf, "orders").where(F.col("o_orderstatus") == c).select("o_orderkey") for c in "FO"], "o_orderkey"))
add("u3_intersection", f"SELECT * FROM {_A} INTERSECT SELECT * FROM {_B}", lambda s, sf: keys_of(s, sf, "F").intersect(keys_of(s, sf, "O")))
add("u4_distinct_union", f"SELECT * FROM {_A} UNION SELECT * FROM {_B}", lambda s, sf: keys_of(s, sf, "F").union(keys_of(s, sf, "O")).distinct())
add("u5_keep_last", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1", lambda s, sf: keep_last(table(s, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).drop("o_orderdate"))
add("u6_difference", f"SELECT * FROM {_A} EXCEPT SELECT * FROM {_B}", lambda s, sf: keys_of(s, sf, "F").subtract(keys_of(s, sf, "O")))


@query(
    "q0_momentum_book",
    f"WITH {RETURNS}, m AS (SELECT date, ticker, {_SMALL} AS s, round(ln(close) - ln(lag(close, 5) OVER ({T})), 9) AS mom FROM rets), o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom, ticker) AS k, count(*) OVER (PARTITION BY date) AS n FROM m WHERE mom IS NOT NULL), "
    "w AS (SELECT date, ticker, CASE WHEN k > n - 3 THEN 1 / 6.0 ELSE -1 / 6.0 END AS weight FROM o WHERE n >= 6 AND (k <= 3 OR k > n - 3)), h AS (SELECT m.date, m.ticker, m.s, lag(coalesce(weight, 0)) OVER (PARTITION BY m.ticker ORDER BY m.date) AS held FROM m LEFT JOIN w ON m.date = w.date AND m.ticker = w.ticker) "
    f"SELECT date, {r6('sum(held * s)', 'pnl')}, count(CASE WHEN held <> 0 THEN 1 END) AS names FROM h GROUP BY 1",
)
def momentum_book(spark: SparkSession, sf: str) -> DataFrame:
    """Daily return and number of names of a book of the three best and worst by five-day momentum, held a row later."""
    from ..operators import portfolio as p

    df = returns(spark, sf).select("date", "ticker", small_return().alias("s"), F.round(t.log_return(5), 9).alias("score"))
    book = p.top_bottom(df.where(F.col("score").isNotNull()), 3, 0.5)
    held = df.join(book, ["date", "ticker"], "left").withColumn("held", F.lag(F.coalesce("weight", F.lit(0.0))).over(t.by_ticker()))
    return tidy(held.groupBy("date").agg(F.sum(F.col("held") * F.col("s")).alias("pnl"), F.count_if(F.col("held") != 0).alias("names")))

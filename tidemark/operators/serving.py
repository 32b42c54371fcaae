"""Tables behind a read service: upserts, run resolution and retention, latest values, listings and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import clip, finite
from .joins import latest


def upsert_ignore(stored: DataFrame, new: DataFrame, *keys: str, order: str) -> DataFrame:
    """Stored rows, and new ones whose keys aren't stored; of new rows with equal keys, the one with the smallest order."""
    fresh = new.join(stored.select(*keys), list(keys), "left_anti")
    rest = [c for c in new.columns if c not in keys]
    first = fresh.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return stored.unionByName(first.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]))


def upsert_replace(stored: DataFrame, new: DataFrame, *keys: str, order: str) -> DataFrame:
    """One row for each of the keys of both: the new one if there is one (of several, that with the greatest order).

    A min/max aggregation, so rows combine before the shuffle and a key with many versions isn't collected.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", order)).alias("_r"))
    return last.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def resolved_run(runs: DataFrame, run_id: int | None = None) -> DataFrame:
    """At most one row of runs (run_id, started, status, is_active): the named run, else the active ok one, else the latest ok one.

    Of several active ones the latest counts; ties go to the greater run_id.
    """
    if run_id is not None:
        return runs.where(F.col("run_id") == run_id).limit(1)
    ok = runs.where("status = 'ok'")
    return ok.orderBy(F.desc("is_active"), F.desc("started"), F.desc("run_id")).limit(1)


def activated(runs: DataFrame, run_id: int) -> DataFrame:
    """runs with the named one as the only active one; as they are unless that run is there and ok."""
    able = F.broadcast(runs.where((F.col("run_id") == run_id) & (F.col("status") == "ok")).agg((F.count(F.lit(1)) > 0).alias("_able")))  # one row
    active = F.when(F.col("_able"), F.col("run_id") == run_id).otherwise(F.col("is_active"))
    return runs.join(able, F.lit(True)).withColumn("is_active", active).drop("_able")


def deactivated(runs: DataFrame, run_id: int) -> DataFrame:
    """runs with the named one inactive."""
    return runs.withColumn("is_active", F.col("is_active") & (F.col("run_id") != run_id))


def retained(children: DataFrame, runs: DataFrame, most: int) -> DataFrame:
    """Rows of children whose run is among the `most` newest."""
    newest = runs.orderBy(F.desc("started"), F.desc("run_id")).limit(most)
    return children.join(F.broadcast(newest.select("run_id")), "run_id", "left_semi")  # `most` rows


def run_listing(runs: DataFrame, most: int = 20, status: str | None = None) -> DataFrame:
    """The newest runs, of one status or of all."""
    own = runs if status is None else runs.where(F.col("status") == status)
    return own.orderBy(F.desc("started"), F.desc("run_id")).limit(most)


def with_status(runs: DataFrame, changes: DataFrame, live: DataFrame) -> DataFrame:
    """runs after their changes (run_id, new_status: the alphabetically last of several); runs that are still `running` and not
    in live (run_id) have crashed."""
    new = changes.groupBy("run_id").agg(F.max("new_status").alias("_s"))
    there = live.select("run_id").distinct().withColumn("_live", F.lit(True))
    out = runs.join(new, "run_id", "left").join(there, "run_id", "left").withColumn("status", F.coalesce("_s", "status"))
    return out.withColumn("status", F.when((F.col("status") == "running") & F.col("_live").isNull(), "crashed").otherwise(F.col("status"))).drop("_s", "_live")


def best_and_worst(predictions: DataFrame, run: DataFrame, most: int) -> DataFrame:
    """side, ticker, score, place: the `most` highest and lowest scores of one run (resolved_run); a score of 0 is on no side."""
    own = predictions.join(F.broadcast(run.select("run_id")), "run_id")  # one row
    high = own.where("score > 0").orderBy(F.desc("score"), "ticker").limit(most).withColumn("side", F.lit("long"))
    low = own.where("score < 0").orderBy("score", "ticker").limit(most).withColumn("side", F.lit("short"))
    place = F.row_number().over(W.partitionBy("side").orderBy(F.desc(F.abs("score")), "ticker"))  # 2 * most rows
    return high.unionByName(low).withColumn("place", place).select("side", "ticker", "score", "place")


def ticker_list(prices: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Each ticker's last date and close, with its fundamentals if there are any."""
    return latest(prices, "ticker", "date", "close").join(fundamentals, "ticker", "left")


def quotes(prices: DataFrame) -> DataFrame:
    """ticker, date, close, previous, change, pct of every ticker; no change without a row before, no pct of a zero price."""
    w = W.partitionBy("ticker").orderBy(F.desc("date"))
    two = prices.select("ticker", "date", "close", F.row_number().over(w).alias("_k")).where("_k <= 2")
    out = two.groupBy("ticker").agg(F.max("date").alias("date"), F.max(F.when(F.col("_k") == 1, F.col("close"))).alias("close"), F.max(F.when(F.col("_k") == 2, F.col("close"))).alias("previous"))
    change = F.col("close") - F.col("previous")
    return out.select("*", change.alias("change"), (F.try_divide(change, F.col("previous")) * 100).alias("pct"))


def ticker_detail(prices: DataFrame, predictions: DataFrame, run: DataFrame, ticker: str, days: int) -> DataFrame:
    """date, close, score of one ticker over the days up to its last date; score is that of the resolved run at that date."""
    own = prices.where(F.col("ticker") == ticker).select("date", "close")
    last = own.agg(F.max("date").alias("_last"))
    own = own.join(F.broadcast(last), F.col("date") > F.date_sub("_last", days)).drop("_last")  # one row
    scored = predictions.where(F.col("ticker") == ticker).join(F.broadcast(run.select("run_id")), "run_id").select("date", "score")
    return own.join(scored, "date", "left").select("date", "close", "score")


def run_equity(run: DataFrame, equity: DataFrame) -> DataFrame:
    """The rows of equity of one run, with the run's status."""
    return equity.join(F.broadcast(run.select("run_id", "status")), "run_id")  # one row


def trial_rows(searches: DataFrame, id_col: str, json_col: str, *params: str) -> DataFrame:
    """id_col, trial, sharpe and a map of the named parameters, a row for each trial of a JSON array of objects
    {"sharpe": number, "params": {name: number}}; malformed JSON and objects without a number give NULLs or no rows."""
    schema = "array<struct<sharpe:double,params:map<string,double>>>"
    rows = searches.select(id_col, F.posexplode(F.from_json(json_col, schema)).alias("trial", "_t"))
    return rows.select(id_col, "trial", F.col("_t.sharpe").alias("sharpe"), F.map_filter("_t.params", lambda k, v: k.isin(*params)).alias("params"))


def watch_prices(watched: DataFrame, prices: DataFrame) -> DataFrame:
    """Every watched ticker with its last close; NULL without one."""
    return watched.join(latest(prices, "ticker", "date", "close"), "ticker", "left")


def newest_news(news: DataFrame, sentiment: DataFrame, most: int) -> DataFrame:
    """The `most` newest rows of news for each ticker, with the label of their text's hash where sentiment (hash, label) has one."""
    w = W.partitionBy("ticker").orderBy(F.desc("published"), "news_id")
    top = news.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return top.withColumn("hash", F.sha2(F.trim(F.lower("headline")), 256)).join(sentiment, "hash", "left")


def snapshot(scores: DataFrame, weights: DataFrame, horizons: DataFrame) -> DataFrame:
    """date, ticker, score, weight, place, side, per_horizon: what a run stores.

    The place is by falling score within the date; the side follows the weight: long, short, or NULL for 0, which is also the
    weight of a ticker without one; per_horizon maps each horizon of horizons (date, ticker, horizon, pred) to its prediction, the horizons of one
    ticker and date being few.
    """
    maps = horizons.groupBy("date", "ticker").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("horizon").cast("string"), "pred")))).alias("per_horizon"))
    out = scores.join(weights, ["date", "ticker"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))).join(maps, ["date", "ticker"], "left")
    place = F.row_number().over(W.partitionBy("date").orderBy(F.desc("score"), "ticker"))
    side = F.when(F.col("weight") > 0, "long").when(F.col("weight") < 0, "short")
    return out.select("date", "ticker", "score", "weight", place.alias("place"), side.alias("side"), "per_horizon")


def equity_curve(daily: DataFrame, benchmark: DataFrame) -> DataFrame:
    """date, daily_return, cumulative_return, drawdown, turnover, benchmark_return: the equity that a run stores, from a backtest (date, net,
    turnover) and the prices of a benchmark (date, adj_close).

    A day without a return counts as 0, others are held to [-5, 5]. Drawdowns are from the highest equity of any day so far.
    The benchmark's return is the log change from its row before within the run's dates, 0 on days without one, and NULL
    throughout if it has no row within them.
    """
    so_far = W.partitionBy(F.lit(0)).orderBy("date").rowsBetween(W.unboundedPreceding, 0)  # one row a date
    r = F.coalesce(clip(F.col("net"), -5.0, 5.0), F.lit(0.0))
    curve = daily.select("date", r.alias("daily_return"), "turnover").withColumn("_e", F.product(1 + F.col("daily_return")).over(so_far))
    curve = curve.select("date", "daily_return", (F.col("_e") - 1).alias("cumulative_return"), (F.col("_e") / F.max("_e").over(so_far) - 1).alias("drawdown"), "turnover")
    span = daily.agg(F.min("date").alias("_a"), F.max("date").alias("_b"))  # one row
    bars = benchmark.where(F.col("adj_close").isNotNull()).join(F.broadcast(span), F.col("date").between(F.col("_a"), F.col("_b")))
    step = F.ln("adj_close") - F.ln(F.lag("adj_close").over(W.partitionBy(F.lit(0)).orderBy("date")))
    both = curve.join(bars.select("date", step.alias("_r"), F.lit(1).alias("_bar")), "date", "left")
    some = F.max("_bar").over(W.partitionBy(F.lit(0)))
    return both.select(*curve.columns, F.when(some == 1, F.coalesce(finite(F.col("_r")), F.lit(0.0))).alias("benchmark_return"))


def ticker_document(facts: DataFrame, prices: DataFrame, predictions: DataFrame, run: DataFrame, ticker: str, days: int) -> DataFrame:
    """One row of a ticker: the columns of facts, then prices and predictions, arrays of structs by date, of the `days` days up to its last bar.

    prices: date, ticker and its bars' columns; predictions: run_id, date, ticker and theirs, of the resolved run (run_id). A ticker
    without facts has no row, one without bars or predictions empty arrays.
    """
    own = prices.where(F.col("ticker") == ticker).drop("ticker")
    since = own.agg(F.date_sub(F.max("date"), days).alias("_since"))  # one row
    nested = lambda df, out: df.agg(F.array_sort(F.collect_list(F.struct("date", *[c for c in df.columns if c != "date"]))).alias(out))
    bars = own.join(F.broadcast(since), F.col("date") > F.col("_since")).drop("_since")
    scored = predictions.where(F.col("ticker") == ticker).join(F.broadcast(run.select("run_id")), "run_id").drop("run_id", "ticker")
    scored = scored.join(F.broadcast(since), F.col("date") > F.col("_since")).drop("_since")
    return facts.where(F.col("ticker") == ticker).join(nested(bars, "prices"), F.lit(True)).join(nested(scored, "predictions"), F.lit(True))  # one row each


# What a trial's row holds beside its parameters, and the figure from which on it isn't a penalty.
TRIAL_METRICS = ("trial", "value", "hold_sharpe", "hold_ci_lo", "hold_ci_hi", "hold_dd", "hold_hit", "hold_ann_return", "dev_sharpe", "elapsed_s", "error")
PENALTY = -9.0


def best_trial(trials: DataFrame, trial: str = "trial", json_col: str = "row") -> DataFrame:
    """trial, best_sharpe, best_params (a map of JSON texts): the trial with the highest hold_sharpe over PENALTY, ties to the first, and its row
    without TRIAL_METRICS; no row where all are penalties or have none."""
    figure = F.get_json_object(json_col, "$.hold_sharpe").try_cast("double")
    valid = trials.select(F.col(trial).alias("trial"), figure.alias("best_sharpe"), F.col(json_col).alias("_row")).where(F.col("best_sharpe") > PENALTY)
    best = valid.orderBy(F.desc("best_sharpe"), "trial").limit(1)
    params = F.map_filter(F.from_json("_row", "map<string, string>"), lambda k, v: ~k.isin(*TRIAL_METRICS))
    return best.select("trial", "best_sharpe", params.alias("best_params"))


def config_values(df: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """keys, key, value: each field of JSON objects and its value as JSON text, in which objects have their fields in order and a number
    that is whole has no fraction."""
    rows = df.select(*keys, F.try_parse_json(json_col).alias("_c")).where("_c is not null")
    fields = rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_c").outer())).select(*keys, "key", "value")
    number = F.try_variant_get("value", "$", "double")
    plain = F.schema_of_variant("value").rlike("^(BIGINT|DOUBLE|DECIMAL)")
    whole = plain & (number == F.floor(number)) & (F.abs(number) < float(1 << 53))
    return fields.select(*keys, "key", F.when(whole, number.cast("long").cast("string")).otherwise(F.to_json("value")).alias("value"))


def config_diff(a: DataFrame, b: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """keys, key, a, b: the fields in which the JSON objects of two tables differ, as JSON texts, NULL for one that an object lacks; a
    full outer join by the keys and the field."""
    side = lambda df, out: config_values(df, json_col, *keys).withColumnRenamed("value", out)
    both = side(a, "a").join(side(b, "b"), [*keys, "key"], "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys, "key", "a", "b")


def migrated(*versions: DataFrame) -> DataFrame:
    """Tables of several versions under all their columns; a column that a version lacks is NULL there."""
    out = versions[0]
    for v in versions[1:]:
        out = out.unionByName(v, allowMissingColumns=True)
    return out


def faceted(df: DataFrame, needle: str, columns: tuple[str, ...], **facets: str) -> DataFrame:
    """Rows whose facets have the given values and one of whose columns holds the needle in either case."""
    for c, v in facets.items():
        df = df.where(F.col(c) == v)
    found: Column = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(c), F.lit(needle.lower()))
    return df.where(found)

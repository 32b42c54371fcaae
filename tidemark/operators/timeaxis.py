"""Operators along time: one ticker's rows in date order. All share one partitioning and sort by (ticker, date)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from ..functions.columns import guarded, nonzero, ratio, sample_kurtosis, sample_skew


def by_ticker() -> WindowSpec:
    """The ticker's rows in date order."""
    return W.partitionBy("ticker").orderBy("date")


def last_rows(n: int) -> WindowSpec:
    """The ticker's last n rows, this one included."""
    return by_ticker().rowsBetween(1 - n, 0)


def log_return(days: int, price: str = "close") -> Column:
    """ln of the price over that of `days` rows before."""
    return F.ln(price) - F.ln(F.lag(price, days).over(by_ticker()))


def with_daily_return(df: DataFrame, price: str = "close", out: str = "r") -> DataFrame:
    return df.withColumn(out, log_return(1, price))


def realised_vol(r: str, days: int) -> Column:
    """Sample deviation of r over a full window of rows."""
    return guarded(F.stddev_samp(r).over(last_rows(days)), F.col(r), last_rows(days), days)


def lagged_vol(r: str, days: int) -> Column:
    """Sample deviation of r over the full window that ends a row earlier."""
    w = by_ticker().rowsBetween(-days, -1)
    return guarded(F.stddev_samp(r).over(w), F.col(r), w, days)


def bollinger(price: str = "close", days: int = 20) -> Column:
    """Deviations of the price from its mean over a full window."""
    w = last_rows(days)
    return guarded(ratio(F.col(price) - F.avg(price).over(w), F.stddev_samp(price).over(w)), F.col(price), w, days)


def range_distance(price: str = "close", days: int = 252, least: int = 60) -> tuple[Column, Column]:
    """Price over the window's high, and over its low, both less 1."""
    w = last_rows(days)
    p = F.col(price)
    return guarded(p / F.max(price).over(w) - 1, p, w, least), guarded(p / F.min(price).over(w) - 1, p, w, least)


def dollar_volume(price: str = "close", volume: str = "volume", days: int = 21, least: int = 10) -> Column:
    """ln of the mean traded value; days without trade don't count."""
    w = last_rows(days)
    value = nonzero(F.col(price) * F.col(volume))
    return guarded(F.ln(F.avg(value).over(w)), value, w, least)


def skew(r: str, days: int = 21) -> Column:
    return sample_skew(F.col(r), last_rows(days), days)


def kurtosis(r: str, days: int = 63) -> Column:
    return sample_kurtosis(F.col(r), last_rows(days), days)


def momentum(price: str = "close", far: int = 252, near: int = 21) -> Column:
    """Log return from `far` to `near` rows ago."""
    return F.ln(F.lag(price, near).over(by_ticker())) - F.ln(F.lag(price, far).over(by_ticker()))


def reversal(price: str = "close", days: int = 5) -> Column:
    return -log_return(days, price)


def highest(r: str, days: int = 21) -> Column:
    """Largest r of a full window."""
    return guarded(F.max(r).over(last_rows(days)), F.col(r), last_rows(days), days)


def illiquidity(r: str, price: str = "close", volume: str = "volume", days: int = 21) -> Column:
    """Mean of |r| per traded value over a window with four fifths of its rows."""
    w = last_rows(days)
    x = ratio(F.abs(r), nonzero(F.col(price) * F.col(volume)))
    return guarded(F.avg(x).over(w), x, w, int(days * 0.8))


def with_rolling_beta(df: DataFrame, r: str, b: str, days: int = 60, out: str = "beta") -> DataFrame:
    """Beta of r on b from deviations of each row from its own rolling means, averaged over another full window.

    The numerator is the rolling mean of the products, scaled by days / (days - 1), the denominator b's rolling variance;
    a value needs 2 * days - 1 rows.
    """
    w = last_rows(days)
    mean = lambda c: guarded(F.avg(c).over(w), F.col(c), w, days)
    df = df.withColumn("_xy", (F.col(r) - mean(r)) * (F.col(b) - mean(b)))
    cov = guarded(F.avg("_xy").over(w), F.col("_xy"), w, days) * (days / (days - 1))
    var = guarded(F.var_samp(b).over(w), F.col(b), w, days)
    return df.withColumn(out, ratio(cov, nonzero(var))).drop("_xy")


def with_idiosyncratic_vol(df: DataFrame, r: str, b: str, beta: str = "beta", days: int = 60, out: str = "idio_vol") -> DataFrame:
    """Sample deviation of r - beta * b over a full window, each row with its own beta."""
    df = df.withColumn("_e", F.col(r) - F.col(beta) * F.col(b))
    return df.withColumn(out, realised_vol("_e", days)).drop("_e")


def slope(r: str, b: str, days: int = 60) -> Column:
    """Textbook regression slope of r on b over a full window of pairs."""
    w = last_rows(days)
    both = F.when(F.col(r).isNotNull() & F.col(b).isNotNull(), F.lit(1))
    return guarded(ratio(F.covar_samp(r, b).over(w), nonzero(F.var_samp(F.when(both == 1, F.col(b))).over(w))), both, w, days)


def fold(df: DataFrame, made: dict[str, Callable[[Callable[[str], Column]], Column]], key: str = "ticker", order: str = "date") -> DataFrame:
    """df with columns that recursions over one key's rows make, which windows can't express.

    made: name -> function of `get`, where get(c) is the array of column c in date order, or of one made before it. One
    key's rows are one array, so this is for series, whose length is bounded by the calendar.
    """
    others = [c for c in df.columns if c not in (key, order)]
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *others))).alias("_rows"))
    for i, (name, make) in enumerate(made.items()):
        before = list(made)[:i]
        rows = rows.withColumn(name, make(lambda c, b=before: F.col(c) if c in b else F.col("_rows")[c]))
    return rows.select(key, F.inline(F.arrays_zip("_rows", *made))).select(key, "_rows.*", *made).select(*df.columns, *made)


def scanned(x: Column, start: Column, step: Callable[[Column, Column], Column], run: int = 64) -> Column:
    """The states after each element of array x: step(state before, element), from start.

    Runs of `run` elements are folded one after the other, so a state is copied with its run and not with the series.
    """
    none = F.slice(F.array(start), 1, 0)
    last = lambda seen, before: F.coalesce(F.try_element_at(seen, F.lit(-1)), before)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(run)), lambda at: F.slice(x, at + 1, run))

    def one(done: Column, part: Column) -> Column:
        before = F.coalesce(F.try_element_at(F.try_element_at(done, F.lit(-1)), F.lit(-1)), start)
        return F.concat(done, F.array(F.aggregate(part, none, lambda seen, v: F.concat(seen, F.array(step(last(seen, before), v))))))

    return F.flatten(F.aggregate(runs, F.slice(F.array(none), 1, 0), one))


def smooth(x: Column, alpha: float, least: int = 1) -> Column:
    """Of array x: y = (1 - alpha) y before + alpha x from the first x on; NULL until `least` observations; a gap keeps y."""
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0).alias("n"))

    def step(s: Column, v: Column) -> Column:
        y = F.when(v.isNull(), s["y"]).when(s["n"] == 0, v).otherwise((1 - alpha) * s["y"] + alpha * v)
        return F.struct(y.alias("y"), (s["n"] + v.isNotNull().cast("int")).alias("n"))

    return F.transform(scanned(x, start, step), lambda s: F.when(s["n"] >= least, s["y"]))


def with_ewm(df: DataFrame, x: str, alpha: float, least: int, out: str) -> DataFrame:
    """Exponential smoothing of x (see smooth)."""
    return fold(df, {out: lambda get: smooth(get(x), alpha, least)})


def _moves(df: DataFrame, price: str) -> DataFrame:
    """df with the price's rises and falls, _up and _down."""
    c = F.col(price) - F.lag(price).over(by_ticker())
    return df.withColumns({"_up": F.when(c.isNotNull(), F.greatest(c, F.lit(0.0))), "_down": F.when(c.isNotNull(), F.greatest(-c, F.lit(0.0)))})


def _strength(days: int) -> dict:
    return {"_gain": lambda get: smooth(get("_up"), 1 / days, days), "_loss": lambda get: smooth(get("_down"), 1 / days, days)}


def _lines(price: str, fast: int, slow: int, signal: int) -> dict:
    line = lambda get: F.zip_with(smooth(get(price), 2 / (fast + 1), fast), smooth(get(price), 2 / (slow + 1), slow), lambda a, b: a - b)
    return {"_line": line, "_mean": lambda get: smooth(get("_line"), 2 / (signal + 1), signal)}


def _rsi() -> Column:
    return 1 - 1 / (1 + ratio(F.col("_gain"), F.col("_loss")))


def _macd(price: str) -> dict[str, Column]:
    parts = {"macd": F.col("_line"), "macd_signal": F.col("_mean"), "macd_hist": F.col("_line") - F.col("_mean")}
    return {k: ratio(v, F.col(price)) for k, v in parts.items()}


def with_rsi(df: DataFrame, price: str = "close", days: int = 14, out: str = "rsi") -> DataFrame:
    """Wilder's relative strength in [0, 1]; NULL without losses or before `days` changes."""
    df = fold(_moves(df, price), _strength(days))
    return df.withColumn(out, _rsi()).drop("_up", "_down", "_gain", "_loss")


def with_macd(df: DataFrame, price: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd, macd_signal and macd_hist as parts of the price."""
    return fold(df, _lines(price, fast, slow, signal)).withColumns(_macd(price)).drop("_line", "_mean")


def with_rsi_and_macd(df: DataFrame, price: str = "close", out: str = "rsi") -> DataFrame:
    """Both, from one fold: a ticker's rows are gathered once."""
    df = fold(_moves(df, price), {**_strength(14), **_lines(price, 12, 26, 9)})
    return df.withColumns({out: _rsi(), **_macd(price)}).drop("_up", "_down", "_gain", "_loss", "_line", "_mean")


def filled_forward(x: str) -> Column:
    """The last value up to this row."""
    return F.last(x, ignorenulls=True).over(by_ticker().rowsBetween(W.unboundedPreceding, 0))


def onto_calendar(df: DataFrame, calendar: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each ticker and calendar date from its first row on, with columns filled forward, never backward."""
    first = df.groupBy("ticker").agg(F.min("date").alias("first"))
    dense = first.join(calendar, F.col("date") >= F.col("first")).drop("first").join(df.select("ticker", "date", *columns), ["ticker", "date"], "left")
    return dense.select("ticker", "date", *[filled_forward(c).alias(c) for c in columns])


def rolling_sum(x: str, days: int) -> Column:
    """Sum over the last rows, from one observation on."""
    return F.sum(x).over(last_rows(days))


def rolling_mean(x: str, days: int, least: int = 1) -> Column:
    return guarded(F.avg(x).over(last_rows(days)), F.col(x), last_rows(days), least)


def change(x: str, days: int) -> Column:
    return F.col(x) - F.lag(x, days).over(by_ticker())


def relative_change(x: str, days: int) -> Column:
    return ratio(F.col(x), F.lag(x, days).over(by_ticker())) - 1


def bull_or_bear(price: str = "close", days: int = 200) -> Column:
    """bull over the moving average, else bear; bear until the average exists."""
    return F.when(F.col(price) > rolling_mean(price, days, days), "bull").otherwise("bear")


def shifted(df: DataFrame, columns: list[str], days: int = 1) -> DataFrame:
    """The named columns as they were `days` rows ago (leakage audits)."""
    return df.select(*[F.lag(c, days).over(by_ticker()).alias(c) if c in columns else F.col(c) for c in df.columns])


def growth(r: Column, window: WindowSpec) -> Column:
    """Running product of 1 + r over the window's rows so far; r must be above -1."""
    return F.exp(F.sum(F.ln(1 + r)).over(window.rowsBetween(W.unboundedPreceding, 0)))


def with_drawdown(df: DataFrame, r: Column, key: str = "ticker", order: str = "date") -> DataFrame:
    """equity (running product of 1 + r), peak (its running maximum) and drawdown (equity / peak - 1)."""
    w = W.partitionBy(key).orderBy(order)
    df = df.withColumn("equity", growth(r, w))
    df = df.withColumn("peak", F.max("equity").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return df.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def rolling_sharpe(r: str, days: int = 252) -> Column:
    """Annualised mean over deviation of a full window."""
    w = last_rows(days)
    return guarded(ratio(F.avg(r).over(w), nonzero(F.stddev_samp(r).over(w))) * 252**0.5, F.col(r), w, days)

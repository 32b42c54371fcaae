"""How well scores and books do: information coefficients, return statistics, folds, and cross-sectional regressions."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import clip, finite, nonzero, ratio
from .timeaxis import with_drawdown
from .xsection import average_rank, median_of, quantiles_of


def information_coefficient(df: DataFrame, score: str = "score", r: str = "r", least: int = 5, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """keys, ic: Spearman correlation of the keys' rows that have both; NULL under `least` rows or for a constant side."""
    both = df.where(F.col(score).isNotNull() & F.col(r).isNotNull()).withColumns({"_a": average_rank(score, *keys), "_b": average_rank(r, *keys)})
    return both.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= least, finite(F.corr("_a", "_b"))).alias("ic"))


def ic_summary(ics: DataFrame) -> DataFrame:
    """One row: mean, sample deviation and their ratio by the year."""
    return ic_by(ics)


def ic_by(ics: DataFrame, *keys: str) -> DataFrame:
    """keys, ic_mean, ic_std, ic_ir over their dates; one row without keys."""
    return ics.groupBy(*keys).agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), (ratio(F.avg("ic"), nonzero(F.stddev_samp("ic"))) * 252**0.5).alias("ic_ir"))


def annual_return(r: str) -> Column:
    """Compounded and scaled to 252 rows; r held to [-0.99, 5]."""
    return F.exp(F.sum(F.ln(1 + clip(F.col(r), -0.99, 5.0))) * 252 / F.count(r)) - 1


def sharpe(r: str) -> Column:
    return ratio(F.avg(r), nonzero(F.stddev_samp(r))) * 252**0.5


def sortino(r: str) -> Column:
    return ratio(F.avg(r), nonzero(F.stddev_samp(F.when(F.col(r) < 0, F.col(r))))) * 252**0.5


def tearsheet(daily: DataFrame, r: str = "net", *keys: str) -> DataFrame:
    """ann_return, ann_vol, sharpe, sortino, max_drawdown, calmar, hit_ratio and n, in all or for each key.

    A series is ordered by date within its key, so many series are many tasks; drawdowns start from the first row's equity.
    """
    own = keys or ("_all",)
    daily = daily if keys else daily.withColumn("_all", F.lit(0))
    marked = with_drawdown(daily, clip(F.coalesce(r, F.lit(0.0)), -0.99, 5.0), own[0])
    out = marked.groupBy(*own).agg(
        annual_return(r).alias("ann_return"), (F.stddev_samp(r) * 252**0.5).alias("ann_vol"), sharpe(r).alias("sharpe"), sortino(r).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"), ratio(annual_return(r), nonzero(F.abs(F.min("drawdown")))).alias("calmar"), F.avg(F.coalesce((F.col(r) > 1e-12).cast("double"), F.lit(0.0))).alias("hit_ratio"), F.count(F.lit(1)).alias("n"),
    )
    return out if keys else out.drop("_all")


def quartile_names(df: DataFrame, x: str, out: str = "bucket") -> DataFrame:
    """df with q1..q4 by the exact quartiles of x, right-closed; NULL for NULL. The quartiles are one row, joined back."""
    cuts = quantiles_of(df, x, (0.25, 0.5, 0.75)).withColumnRenamed("q", "_q")
    name = F.when(F.col(x) <= F.col("_q")[0], "q1").when(F.col(x) <= F.col("_q")[1], "q2").when(F.col(x) <= F.col("_q")[2], "q3").when(F.col(x).isNotNull(), "q4")
    return df.join(F.broadcast(cuts), F.lit(True)).withColumn(out, name).drop("_q")


def sweep_summary(df: DataFrame, x: str) -> DataFrame:
    """One row: best, worst and mid (the median) of x."""
    return df.agg(F.max(x).alias("best"), F.min(x).alias("worst")).join(F.broadcast(median_of(df, x).withColumnRenamed("m", "mid")), F.lit(True))  # one row each


def cross_sectional_slopes(df: DataFrame, x: str, y: str, ridge: float = 1e-4, least: int = 10) -> DataFrame:
    """date, slope: ridge regression through the origin of y on one column over the date's rows."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    slope = F.sum(F.col(x) * F.col(y)) / (F.sum(F.col(x) * F.col(x)) + ridge)
    return both.groupBy("date").agg(F.when(F.count(F.lit(1)) >= least, slope).alias("slope")).where("slope is not null")


def regime_breakdown(df: DataFrame, r: str, by: str, periods: int = 252) -> DataFrame:
    """by, n, mean, std, sharpe, hit, ann_return of the rows that have both."""
    known = df.where(F.col(r).isNotNull() & F.col(by).isNotNull())
    figures = [F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), (ratio(F.avg(r), nonzero(F.stddev_samp(r))) * periods**0.5).alias("sharpe")]
    return known.groupBy(by).agg(*figures, F.avg((F.col(r) > 0).cast("int")).alias("hit"), (F.avg(r) * periods).alias("ann_return"))


def parameter_grid(params: dict[str, list], run: Callable[..., DataFrame], base: dict | None = None) -> DataFrame:
    """The parameters of every combination beside the one row that run(**base, **combination) gives, and error: NULL, or the message with
    which run raised (its figures are NULL then).

    run describes what to compute, and all combinations are one plan, a branch for each: dozens. What can't be described is an
    error row; what fails later fails the job.
    """
    named = lambda own: [F.lit(v).cast("long" if isinstance(v, int) and not isinstance(v, bool) else _KINDS.get(type(v), "string")).alias(k) for k, v in own.items()]
    frames, failed = [], []
    for values in itertools.product(*params.values()):
        own = dict(zip(params, values, strict=True))
        try:
            frames.append(run(**{**(base or {}), **own}).limit(1).select(*named(own), "*", F.lit(None).cast("string").alias("error")))
        except Exception as raised:  # what a combination raises is its result
            failed.append((own, str(raised).strip().splitlines()[0] if str(raised).strip() else type(raised).__name__))
    one = SparkSession.getActiveSession().range(1)
    frames += [one.select(*named(own), F.lit(message).alias("error")) for own, message in failed]
    out = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*[c for c in out.columns if c != "error"], "error")


_KINDS = {float: "double", bool: "boolean"}


def bootstrap_sharpe(daily: DataFrame, r: str = "net", draws: int = 1000, block: int | None = None, seed: int = 7, method: str = "block", periods: int = 252) -> DataFrame:
    """One row: low, mid, high (2.5, 50 and 97.5 percentiles of the Sharpe ratio over resamples of n of the n rows with r), sharpe
    (of the rows themselves), method, block (its length).

    method: "block" for moving blocks of `block` rows (by default the root of n, 2 at least), the last cut so that n
    remain, or "iid" for single rows. The start of each block is a hash of (draw, block, seed), so results repeat. A block's
    sums are differences of running sums of r and r squared, one row with two arrays over the calendar, so there are draws x
    blocks rows. Percentiles leave out resamples without deviation. Figures are NULL under 30 rows.
    """
    if method not in ("block", "iid"):
        raise ValueError(f"unknown bootstrap method: {method!r}")
    rows = daily.where(F.col(r).isNotNull())
    dev = rows.agg(F.avg(r).alias("mean"), F.stddev_samp(r).alias("deviation"), F.count(F.lit(1)).cast("int").alias("n"))  # sums of deviations from the mean lose fewer digits
    length = F.lit(1) if method == "iid" else F.greatest(F.lit(2), F.lit(block or 0).cast("int") if block else F.floor(F.sqrt("n")).cast("int"))
    moved = rows.join(F.broadcast(dev), F.lit(True)).select("date", (F.col(r) - F.col("mean")).alias("_d"))
    so_far = W.partitionBy(F.lit(0)).orderBy("date").rowsBetween(W.unboundedPreceding, 0)  # one row a date
    sums = moved.select(F.row_number().over(so_far).alias("i"), F.sum("_d").over(so_far).alias("s"), F.sum(F.col("_d") * F.col("_d")).over(so_far).alias("ss"))
    line = sums.agg(F.array_sort(F.collect_list(F.struct("i", "s", "ss"))).alias("_sums"))
    zero = F.array(F.lit(0.0))
    facts = dev.join(line, F.lit(True)).withColumns({"block": length, "_s": F.concat(zero, F.col("_sums")["s"]), "_ss": F.concat(zero, F.col("_sums")["ss"])}).drop("_sums")
    starts = daily.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(facts.where("n >= 30")), F.lit(True))  # one row
    starts = starts.withColumn("k", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / F.col("block")) - 1).cast("int"))))
    among = F.col("n") if method == "iid" else F.greatest(F.lit(1), F.col("n") - F.col("block"))
    begin = F.pmod(F.xxhash64("draw", "k", F.lit(seed)), among).cast("int")
    size = F.least(F.col("block"), F.col("n") - F.col("k") * F.col("block"))
    part = lambda c: F.element_at(c, F.col("_b") + F.col("_l") + 1) - F.element_at(c, F.col("_b") + 1)
    drawn = starts.withColumns({"_b": begin, "_l": size.cast("int")}).select("draw", "n", "mean", part("_s").alias("s"), part("_ss").alias("ss"))
    drawn = drawn.groupBy("draw", "n", "mean").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    deviation = F.sqrt(F.greatest((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0)))
    ratios = drawn.select((ratio(F.col("s") / F.col("n") + F.col("mean"), nonzero(deviation)) * periods**0.5).alias("s"))
    ends = ratios.agg(*[F.percentile("s", q).alias(name) for name, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975))])  # `draws` rows
    own = F.when(F.col("n") >= 30, ratio(F.col("mean"), nonzero(F.col("deviation"))) * periods**0.5)
    return ends.join(facts, F.lit(True)).select("low", "mid", "high", own.alias("sharpe"), F.lit(method).alias("method"), F.when(F.col("n") >= 30, F.col("block")).alias("block"))

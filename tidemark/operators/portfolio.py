"""Books from scores, limits on them, and the daily return of holding them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import clip, ratio
from .timeaxis import fold, scanned
from .xsection import places, z_score


# A volatility that can be told; a beta that is on its target, sides too alike to move it, and the most that they move.
_LEAST_VOL, _ON_TARGET, _ALIKE, _MOST = 1e-6, 1e-6, 1e-9, 0.5


def placed(df: DataFrame) -> DataFrame:
    """df with _k, the place by score (ties by ticker) among its date's rows, and _n, how many they are."""
    own = W.partitionBy("date")
    return df.withColumns({"_k": F.row_number().over(own.orderBy("score", "ticker")), "_n": F.count(F.lit(1)).over(own)})


def top_bottom(df: DataFrame, k: int | float, leverage: float = 1.0) -> DataFrame:
    """date, ticker, weight: the k highest scores share the leverage, the k lowest minus that; dates with fewer than 2 k go.

    A k between 0 and a half is a share of the date's scores, rounded down, one at least.
    """
    if 0 < k < 0.5:
        ranked = placed(df.where(F.col("score").isNotNull())).withColumn("_m", F.greatest(F.lit(1), F.floor(F.col("_n") * k))).where("_n >= 2 * _m and (_k <= _m or _k > _n - _m)")
        side = F.when(F.col("_k") > F.col("_n") - F.col("_m"), leverage).otherwise(-leverage)
        return ranked.select("date", "ticker", (side / F.col("_m")).alias("weight"))
    ranked = placed(df.where(F.col("score").isNotNull())).where(f"_n >= {2 * k} and (_k <= {k} or _k > _n - {k})")
    return ranked.select("date", "ticker", F.when(F.col("_k") > F.col("_n") - k, leverage / k).otherwise(-leverage / k).alias("weight"))


def inverse_vol(df: DataFrame, share: float = 0.2, least: int = 10, leverage: float = 1.0) -> DataFrame:
    """date, ticker, weight: the top and bottom share by score, each side weighted by 1 / vol to the leverage."""
    ranked = placed(df.where(F.col("vol") > _LEAST_VOL)).where(F.col("_n") >= least)
    ranked = ranked.withColumn("_m", F.least(F.greatest(F.lit(1), F.floor(F.col("_n") * share)), F.floor(F.col("_n") / 2))).where("_k <= _m or _k > _n - _m")
    ranked = ranked.withColumn("_side", F.when(F.col("_k") > F.col("_n") - F.col("_m"), 1).otherwise(-1))
    part = 1 / F.col("vol") / F.sum(1 / F.col("vol")).over(W.partitionBy("date", "_side"))
    return ranked.select("date", "ticker", (F.col("_side") * part * leverage).alias("weight"))


def quartiles(df: DataFrame, x: str, share: float = 0.25, key: str = "ticker") -> DataFrame:
    """key, side: the bottom and top round(n * share) keys by x, ties by key; places come from ranges, so no task sorts all keys."""
    sized = places(df.select(key, x), x, key, out="_k").join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))), F.lit(True)).withColumn("_m", F.round(F.col("_n") * share))  # one row
    return sized.where("_k <= _m or _k > _n - _m").select(key, F.when(F.col("_k") <= F.col("_m"), "bottom").otherwise("top").alias("side"))


def capped(df: DataFrame, cap: float) -> DataFrame:
    """Weights scaled down where a sector's gross weight of a date is over cap; what is cut isn't given to others."""
    gross = F.sum(F.abs("weight")).over(W.partitionBy("date", "sector"))
    return df.withColumn("weight", F.col("weight") * F.least(F.lit(1.0), F.coalesce(ratio(F.lit(cap), F.nullif(gross, F.lit(0.0))), F.lit(1.0))))


def with_threshold(df: DataFrame, least: float, x: str = "weight", out: str = "held") -> DataFrame:
    """x as it changes by at least `least`, from the first row's; smaller changes keep the last output."""
    kept = lambda held, v: F.when(held.isNull() | (F.abs(v - held) >= least), v).otherwise(held)
    return fold(df, {out: lambda get: scanned(get(x), F.lit(None).cast("double"), kept)})


def beta_neutral(df: DataFrame, target: float = 0.0) -> DataFrame:
    """Long and short sides scaled by 1 - a and 1 + a so that the book's beta meets the target; missing betas are 1.

    Dates keep their weights where the beta is there already, the sides' betas are alike, or |a| is over a half.
    """
    own = W.partitionBy("date")
    b = F.col("weight") * F.coalesce("beta", F.lit(1.0))
    df = df.withColumns({"_l": F.sum(F.when(F.col("weight") > 0, b).otherwise(0.0)).over(own), "_s": F.sum(F.when(F.col("weight") < 0, b).otherwise(0.0)).over(own)})
    gap = F.col("_s") - F.col("_l")
    df = df.withColumn("_a", F.when((F.abs(F.col("_l") + F.col("_s") - target) >= _ON_TARGET) & (F.abs(gap) >= _ALIKE), ratio(target - (F.col("_l") + F.col("_s")), F.nullif(gap, F.lit(0.0)))))
    a = F.when(F.abs("_a") <= _MOST, F.col("_a")).otherwise(0.0)
    return df.withColumn("weight", F.col("weight") * F.when(F.col("weight") > 0, 1 - a).otherwise(1 + a)).drop("_l", "_s", "_a")


def ensemble(scores: DataFrame, weights: dict[int, float]) -> DataFrame:
    """date, ticker, score: z-scores of (date, horizon) by weights; a missing horizon adds 0."""
    share = {h: max(0.0, w) for h, w in weights.items()}
    total = sum(share.values())
    share = {h: w / total for h, w in share.items()} if total else {h: 1 / len(share) for h in share}
    w = F.create_map(*[F.lit(v) for pair in share.items() for v in pair])[F.col("horizon")]
    z = scores.withColumn("_z", z_score("pred", "date", "horizon"))
    return z.groupBy("date", "ticker").agg(F.sum(F.col("_z") * F.coalesce(w, F.lit(0.0))).alias("score"))


def book_of_date(weights: DataFrame, calendar: DataFrame, every: int = 1) -> DataFrame:
    """date, book, _i: for each date of the calendar (date), numbered from 1, the date of the book that it targets, NULL before the first.

    weights (date, ticker, weight): a date that it has is a whole book, in which names without a row have weight 0. A date without a
    book keeps the one before; books on other dates don't count. With every > 1 only each `every`-th date takes a
    new book, counted from the first one with a weight other than 0; there is none before that one.
    """
    own = weights.groupBy("date").agg(F.max((F.col("weight") != 0).cast("int")).alias("_any"))
    dates = calendar.select("date").distinct().join(own, "date", "left")  # one row a date from here on
    in_order = W.partitionBy(F.lit(0)).orderBy("date")
    so_far = in_order.rowsBetween(W.unboundedPreceding, 0)
    dates = dates.withColumns({"_i": F.row_number().over(in_order), "book": F.last(F.when(F.col("_any").isNotNull(), F.col("date")), ignorenulls=True).over(so_far)})
    if every > 1:
        since = F.col("_i") - F.min(F.when(F.col("_any") == 1, F.col("_i"))).over(W.partitionBy(F.lit(0)))
        dates = dates.withColumn("_since", since)
        dates = dates.withColumn("book", F.last(F.when((F.col("_since") >= 0) & (F.col("_since") % every == 0), F.col("book")), ignorenulls=True).over(so_far))
    return dates.select("date", "book", "_i")


def on_calendar(weights: DataFrame, calendar: DataFrame, every: int = 1) -> DataFrame:
    """date, ticker, weight of every date of the calendar, by book_of_date; weights of 0 have no row."""
    books = weights.where("weight <> 0").select(F.col("date").alias("book"), "ticker", "weight")
    return book_of_date(weights, calendar, every).join(books, "book").select("date", "ticker", "weight")


def backtest(weights: DataFrame, returns: DataFrame, lag: int = 1, bps: float = 6.0, every: int = 1) -> DataFrame:
    """date, gross, turnover, cost, net of books (date, ticker, weight) on the calendar of returns (date, ticker, r), one row a date.

    A date holds the book that was targeted `lag` dates before (see book_of_date); its weights earn the date's r, held to
    [-0.5, 0.5] and 0 where there is none. Turnover is the sum of all changes of held weights, and costs bps a unit. Names
    without returns are left out. gross and net are NULL on the first `lag` dates, when nothing can be held.

    Only names with a weight have rows: dates x names of a book, and changes only where the book changes.
    """
    known = returns.select("ticker").distinct().withColumn("_known", F.lit(True))
    books = weights.join(known, "ticker", "left").select("date", "ticker", F.when(F.col("_known"), F.coalesce("weight", F.lit(0.0))).otherwise(0.0).alias("weight"))
    in_order = W.partitionBy(F.lit(0)).orderBy("date")  # one row a date
    plan = book_of_date(books, returns, every).withColumn("_held", F.lag("book", lag).over(in_order))
    plan = plan.withColumn("_before", F.lag("_held").over(in_order))
    held = books.where("weight <> 0").select(F.col("date").alias("_held"), "ticker", "weight")
    earned = plan.select("date", "_held").join(held, "_held").join(returns.select("date", "ticker", "r"), ["date", "ticker"])
    earned = earned.groupBy("date").agg(F.sum(F.col("weight") * clip(F.col("r"), -0.5, 0.5)).alias("_earned"))
    sides = F.explode(F.array(F.struct(F.col("_held").alias("book"), F.lit(1.0).alias("sign")), F.struct(F.col("_before").alias("book"), F.lit(-1.0).alias("sign"))))
    moved = plan.where(~F.col("_held").eqNullSafe(F.col("_before"))).select("date", sides.alias("_s")).select("date", F.col("_s.book").alias("_held"), "_s.sign")
    moved = moved.join(held, "_held").groupBy("date", "ticker").agg(F.abs(F.sum(F.col("sign") * F.col("weight"))).alias("_d")).groupBy("date").agg(F.sum("_d").alias("_turnover"))
    turnover = F.coalesce("_turnover", F.lit(0.0))
    gross = F.when(F.col("_i") > lag, F.coalesce("_earned", F.lit(0.0)))
    daily = plan.join(earned, "date", "left").join(moved, "date", "left")
    return daily.select("date", gross.alias("gross"), turnover.alias("turnover"), (turnover * (bps / 1e4)).alias("cost"), (gross - turnover * (bps / 1e4)).alias("net"))


def ic_weights(ics: DataFrame, periods: int = 252) -> DataFrame:
    """horizon, share: each horizon's information ratio over its ICs (horizon, ic), negative ones 0, adding up to 1; equal
    shares where none is above 0."""
    ratio_ = F.coalesce(ratio(F.avg("ic"), F.nullif(F.stddev_samp("ic"), F.lit(0.0))) * periods**0.5, F.lit(0.0))
    own = ics.groupBy("horizon").agg(F.greatest(ratio_, F.lit(0.0)).alias("_w"))
    total, n = F.sum("_w").over(W.partitionBy()), F.count(F.lit(1)).over(W.partitionBy())  # one row for each horizon
    return own.select("horizon", F.when(total > 0, F.col("_w") / total).otherwise(1 / n).alias("share"))


def ic_ensemble(scores: DataFrame, shares: DataFrame) -> DataFrame:
    """date, ticker, score: z-scores of (date, horizon) by the horizons' shares; a horizon without one adds 0."""
    z = scores.withColumn("_z", z_score("pred", "date", "horizon")).join(F.broadcast(shares), "horizon", "left")  # a row for each horizon
    return z.groupBy("date", "ticker").agg(F.sum(F.col("_z") * F.coalesce("share", F.lit(0.0))).alias("score"))


def equal_shares(scores: DataFrame) -> DataFrame:
    """horizon, share: every horizon of scores with the same share."""
    own = scores.select("horizon").distinct()
    return own.select("horizon", (1 / F.count(F.lit(1)).over(W.partitionBy())).alias("share"))  # one row for each horizon


def dense(weights: DataFrame) -> DataFrame:
    """date, ticker, weight for every name of any book on every date of a book, 0 where a book lacks it: dates x names rows."""
    grid = weights.select("ticker").distinct().join(weights.agg(F.sort_array(F.collect_set("date")).alias("_days")), F.lit(True))  # one row, one entry a date
    cells = grid.select("ticker", F.explode("_days").alias("date")).join(weights.select("date", "ticker", "weight"), ["date", "ticker"], "left")
    return cells.select("date", "ticker", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def composed(
    scores: DataFrame,
    *,
    sizing: str = "top_bottom",
    k: int = 5,
    share: float = 0.2,
    leverage: float = 1.0,
    vol: DataFrame | None = None,
    returns: DataFrame | None = None,
    sectors: DataFrame | None = None,
    cap: float | None = None,
    least: float = 0.0,
    betas: DataFrame | None = None,
) -> DataFrame:
    """date, ticker, weight of scores (date, ticker, score), from an ensemble or precomputed: sized, then capped by sector, then held
    to a least trade, then made beta neutral. The cadence is the backtest's.

    sizing: "top_bottom" (k names a side), "inverse_vol" (a share a side by vol: date, ticker, vol) or "parity" (a share a side by
    returns: date, ticker, r). Each side has the leverage. cap needs sectors (ticker, sector); names without one are one
    sector. Beta neutrality needs betas (date, ticker, beta). What a step lacks the input for is left out.
    """
    if sizing == "top_bottom":
        book = top_bottom(scores, k, leverage)
    elif sizing == "inverse_vol":
        book = inverse_vol(scores.where(F.col("score").isNotNull()).join(vol, ["date", "ticker"]), share, leverage=leverage)
    elif sizing == "parity":
        from .hierarchy import parity_book  # which sizes books by this module's places

        book = parity_book(scores, returns, share, leverage=leverage)
    else:
        raise ValueError(f"unknown sizing: {sizing!r}")
    if cap is not None and sectors is not None:
        named = book.join(sectors.select("ticker", "sector"), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("__OTHER__")))
        book = capped(named, cap).select("date", "ticker", "weight")
    if least > 0:
        book = with_threshold(dense(book), least).select("date", "ticker", F.col("held").alias("weight"))
    if betas is not None:
        book = beta_neutral(book.join(betas.select("date", "ticker", "beta"), ["date", "ticker"], "left")).select("date", "ticker", "weight")
    return book


def shrink_factors(df: DataFrame, alpha: float, least: int = 30) -> DataFrame:
    """ticker, precision, factor: share of rows where score and r agree in sign (NULL under `least` rows), and alpha times
    how far it is over a half."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    hit = df.where("score is not null and r is not null").groupBy("ticker").agg(F.avg((F.signum("score") == F.signum("r")).cast("double")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    p = F.when(F.col("_n") >= least, F.col("_p"))
    return hit.select("ticker", p.alias("precision"), (clip((F.coalesce(p, F.lit(0.5)) - 0.5) / 0.5, 0.0, 1.0) * alpha).alias("factor"))


def shrunk(df: DataFrame, factors: DataFrame) -> DataFrame:
    """Scores times their ticker's factor; a ticker without one gets 0."""
    return df.join(factors.select("ticker", "factor"), "ticker", "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(0.0))).drop("factor")


def gated(score: str, confidence: str, threshold: float) -> Column:
    """The score where the confidence reaches the threshold, else 0."""
    return F.when(F.col(confidence) >= threshold, F.col(score)).otherwise(0.0)


def confident(score: str, confidence: str, floor: float, cap: float) -> Column:
    """The score times how far the confidence is from floor to cap, NULL as 0."""
    if cap <= floor:
        raise ValueError("cap must be over floor")
    return F.coalesce(F.col(score) * clip((F.col(confidence) - floor) / (cap - floor), 0.0, 1.0), F.lit(0.0))

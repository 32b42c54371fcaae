"""Risk parity by hierarchy: weights from how the returns of a side's names cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .portfolio import placed

# The deviation of a name without any, and the variance from which on one can be told.
_NO_DEVIATION, _LEAST_VARIANCE = 1e-12, 1e-20


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Covariance of x (rows x names) shrunk to its mean variance on the diagonal by Ledoit and Wolf's optimal share (2004)."""
    x = x - x.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mean = np.trace(s) / p
    away = ((s - mean * np.eye(p)) ** 2).sum() / p
    noise = ((x**2).T @ (x**2) / n - s**2).sum() / (n * p)
    share = min(noise, away) / away if away > 0 else 0.0
    return (1 - share) * s + share * mean * np.eye(p)


def spanning_tree(distance: np.ndarray) -> np.ndarray:
    """The n - 1 edges (a < b) of the least spanning tree, nearest first, ties by a and then b.

    Prim's way over rows of the matrix: each vertex outside keeps its best edge into the tree, compared by the same order, in
    which no two edges are equal; so the tree is that of sorting all pairs.
    """
    n = len(distance)
    d = np.where(np.isnan(distance), np.inf, distance)
    names = np.arange(n)
    best, low, high = np.full(n, np.inf), np.full(n, n), np.full(n, n)
    out, edges, v = np.ones(n, bool), [], 0
    for _ in range(n - 1):
        out[v] = False
        near, a, b = d[v], np.minimum(names, v), np.maximum(names, v)
        closer = out & ((near < best) | ((near == best) & ((a < low) | ((a == low) & (b < high)))))
        best[closer], low[closer], high[closer] = near[closer], a[closer], b[closer]
        ties = np.flatnonzero(out & (best == best[out].min()))
        v = ties[np.lexsort((high[ties], low[ties]))[0]]
        edges.append((best[v], low[v], high[v]))
    edges.sort()
    return np.array([(a, b) for _, a, b in edges], int).reshape(-1, 2)


def cluster_order(distance: np.ndarray) -> list[int]:
    """Names in the order of their single-linkage tree's leaves: the nearest clusters merge, the older one's names first.

    The clusters merge along the least spanning tree, n - 1 edges; each merge joins two linked lists of names.
    """
    n = len(distance)
    above, age = list(range(n)), list(range(n))  # union-find; a cluster's age is when it was made
    after, last = [-1] * n, list(range(n))  # the name that follows in the order; a cluster's last name
    first = list(range(n))

    def root(v: int) -> int:
        while above[v] != v:
            above[v] = v = above[above[v]]
        return v

    for made, (a, b) in enumerate(spanning_tree(distance), n):
        old, new = sorted((root(a), root(b)), key=lambda r: age[r])
        after[last[old]] = first[new]
        above[new], last[old], age[old] = old, last[new], made
    order, v = [], first[root(0)]
    while v >= 0:
        order.append(v)
        v = after[v]
    return order


def parity_weights(cov: np.ndarray) -> np.ndarray:
    """Weights over names that add up to 1: halves of the cluster order share by the inverse of their variance, down to names.

    A half whose variance can't be told (a name without any) isn't divided further than equally; without names, nothing.
    """
    n = len(cov)
    if n < 2:
        return np.ones(n)
    deviation = np.sqrt(np.diag(cov))
    deviation[deviation == 0] = _NO_DEVIATION
    distance = np.sqrt((1 - np.clip(cov / np.outer(deviation, deviation), -1, 1)) / 2)
    order, weights = cluster_order(distance), np.ones(n)

    def variance(names: list[int]) -> float:
        own = cov[np.ix_(names, names)]
        if not (np.diag(own) > _LEAST_VARIANCE).all():
            return np.nan
        share = 1 / np.diag(own)
        share /= share.sum()
        return share @ own @ share

    open_ = [order]
    while open_:
        names = open_.pop()
        left, right = names[: len(names) // 2], names[len(names) // 2 :]
        if left:
            low, high = variance(left), variance(right)
            if low + high > _LEAST_VARIANCE:
                weights[left] *= high / (low + high)
                weights[right] *= low / (low + high)
                open_ += [left, right]
    return weights / weights.sum()


def side_weights(past: np.ndarray, least: int = 3) -> np.ndarray:
    """Weights adding up to 1 over the rows of past (names x days, NaN for none); NaN for a name that can't have one.

    Gaps keep the day before; days that still have one go. Under `least` names with returns, inverse deviations.
    """
    out = np.full(len(past), np.nan)
    known = np.flatnonzero(~np.isnan(past).all(axis=1))
    if len(known) >= least:
        x = pd.DataFrame(past[known].T).ffill().dropna().to_numpy()
        out[known] = parity_weights(shrunk_covariance(x) if len(x) >= 5 else np.zeros((len(known), len(known))))
    elif len(known):
        inverse = 1 / pd.DataFrame(past[known].T).std().replace(0, np.nan).to_numpy()
        out[known] = inverse / np.nansum(inverse)
    return out


def parity_book(scores: DataFrame, returns: DataFrame, share: float = 0.15, days: int = 60, least: int = 3, leverage: float = 1.0) -> DataFrame:
    """date, ticker, weight: the top and bottom share by score, each side at the leverage by parity over the `days` calendar dates
    before the date.

    Dates with fewer than 2 * least scores have no rows, nor have names without a weight. returns (date, ticker, r) sets
    the calendar. A ticker's returns are packed by runs of `days` dates, and a chosen name meets the two runs that hold its past, so
    returns are gathered for chosen names alone. A group is one side of a date: its names, each with at most two runs.
    """
    chosen = placed(scores.where(F.col("score").isNotNull())).where(F.col("_n") >= 2 * least)
    chosen = chosen.withColumn("_m", F.greatest(F.lit(1), F.least(F.floor(F.col("_n") * share), F.floor(F.col("_n") / 2)))).where("_k <= _m or _k > _n - _m")
    chosen = chosen.select("date", "ticker", F.when(F.col("_k") > F.col("_n") - F.col("_m"), 1.0).otherwise(-1.0).alias("side"))
    dates = returns.select("date", F.lit(1).alias("_cal")).unionByName(scores.select("date", F.lit(0).alias("_cal"))).groupBy("date").agg(F.max("_cal").alias("_cal"))
    upto = F.sum("_cal").over(W.partitionBy(F.lit(0)).orderBy("date").rowsBetween(W.unboundedPreceding, 0))  # one row a date
    dates = dates.select("date", upto.alias("_upto"), (upto - F.col("_cal")).alias("_before"))
    run = lambda at: F.floor((at - 1) / days)
    packed = returns.join(dates.select("date", "_upto"), "date").withColumn("_run", run(F.col("_upto"))).groupBy("ticker", "_run")
    packed = packed.agg(F.collect_list(F.struct(F.col("_upto").alias("i"), F.coalesce("r", F.lit(float("nan"))).alias("r"))).alias("_rs"))
    runs = F.explode(F.array_distinct(F.array(run(F.col("_before") - days + 1), run(F.col("_before")))))
    asked = chosen.join(dates.select("date", "_before"), "date").where("_before > 0").withColumn("_run", runs).join(packed, ["ticker", "_run"])
    past = F.filter("_rs", lambda e: e["i"].between(F.col("_before") - days + 1, F.col("_before")))
    sides = asked.select("date", "side", "ticker", F.transform(past, lambda e: (e["i"] - F.col("_before") + days - 1).cast("int")).alias("at"), past["r"].alias("r"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names, row = np.unique(rows["ticker"].to_numpy(str), return_inverse=True)
        past = np.full((len(names), days), np.nan)
        for k, at, r in zip(row, rows["at"], rows["r"], strict=True):
            past[k, at] = r
        return pd.DataFrame({"date": rows["date"].iloc[0], "ticker": names, "weight": rows["side"].iloc[0] * leverage * side_weights(past, least)}).dropna()

    return sides.groupBy("date", "side").applyInPandas(solve, "date date, ticker string, weight double")

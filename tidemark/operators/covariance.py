"""Covariances of all tickers by blocks: a task multiplies the matrices of two blocks of tickers over a run of dates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window as W, functions as F

#: Tickers in a block, and dates that are multiplied at once: matrices of a task stay at a few MB.
BLOCK, RUN = 256, 2048
_PAIRS = "a string, b string, n double, xy double, x double, y double, xxyy double"


def _matrix(table: pa.Table, side: str) -> tuple[pa.Array, np.ndarray]:
    """The tickers of a block, in order, and their values (tickers x dates of the run, NaN for none)."""
    own = table.filter(pa.compute.equal(table.column("block"), side)).sort_by("ticker")
    places = own.column("at").combine_chunks()
    x = np.full((own.num_rows, RUN), np.nan)
    rows = np.repeat(np.arange(own.num_rows), np.diff(places.offsets.to_numpy()))
    x[rows, places.flatten().to_numpy()] = own.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return own.column("ticker").combine_chunks(), x


def _products(filled: bool):
    """Sums over a run of dates for each pair of tickers of two blocks; with `filled`, missing values are that of the column `gap`."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        a, b = (k.as_py() for k in key[:2])
        (names_a, x), (names_b, y) = _matrix(table, a), _matrix(table, b)
        if filled:
            dates = table.column("dates")[0].as_py()  # how many the run has
            gap = dict(zip(table.column("ticker").to_pylist(), table.column("gap").to_pylist(), strict=True))
            x, y = (np.where(np.isnan(m), np.array([gap[t] for t in names.to_pylist()])[:, None], m)[:, :dates] for names, m in ((names_a, x), (names_b, y)))
        in_x, in_y = (~np.isnan(m) * 1.0 for m in (x, y))
        x, y = np.nan_to_num(x), np.nan_to_num(y)
        sums = [in_x @ in_y.T, x @ y.T, x @ in_y.T, in_x @ y.T, (x * x) @ (y * y).T]
        i, j = np.nonzero(sums[0] > 0)
        if a == b:
            i, j = i[i <= j], j[i <= j]
        first, second = names_a.take(pa.array(i)), names_b.take(pa.array(j))
        swap = pa.compute.greater(first, second)
        first, second = pa.compute.if_else(swap, second, first), pa.compute.if_else(swap, first, second)
        return pa.Table.from_arrays([first, second, *[pa.array(m[i, j]) for m in sums]], names=["a", "b", "n", "xy", "x", "y", "xxyy"])

    return run


def _pair_sums(rows: DataFrame, filled: bool, block: int) -> DataFrame:
    """a, b (a <= b) and their sums over all dates. rows: ticker, _at (the date's number from 0), _v, and with `filled` _gap and _run_dates.

    A ticker's values of a run of dates are one row; it goes to every pair that its block is in, so rows grow with tickers x
    blocks, and a row of a pair of tickers exists once for each run of dates.
    """
    blocks = -(-rows.select("ticker").distinct().count() // block) or 1
    rows = rows.withColumn("run", F.floor(F.col("_at") / RUN))
    packed = rows.groupBy("ticker", "run").agg(F.collect_list((F.col("_at") % RUN).cast("int")).alias("at"), F.collect_list("_v").alias("v"))
    if filled:  # a ticker without a value in a run counts there too
        runs = rows.groupBy("run").agg(F.first("_dates").alias("dates"))
        cells = rows.groupBy("ticker").agg(F.first("_gap").alias("gap")).join(F.broadcast(runs), F.lit(True))  # a row for each run of dates
        packed = cells.join(packed, ["ticker", "run"], "left").withColumns({"at": F.coalesce("at", F.array().cast("array<int>")), "v": F.coalesce("v", F.array().cast("array<double>"))})
    packed = packed.withColumn("block", F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    pairs = packed.withColumn("_o", other).withColumns({"pa": F.least("block", "_o"), "pb": F.greatest("block", "_o")}).drop("_o")
    parts = pairs.groupBy("pa", "pb", "run").applyInArrow(_products(filled), _PAIRS)
    return parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "xy", "x", "y", "xxyy")])


def _numbered(df: DataFrame, r: str) -> DataFrame:
    """ticker, _at, _v less the ticker's mean, which changes no covariance and keeps its sums small."""
    days = df.select("date").distinct().withColumn("_at", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("date")) - 1)  # one row a date
    rows = df.where(F.col(r).isNotNull()).join(days, "date")
    return rows.select("ticker", "_at", (F.col(r) - F.avg(r).over(W.partitionBy("ticker"))).alias("_v"))


def covariance(df: DataFrame, r: str = "r", least: int = 5, block: int = BLOCK) -> DataFrame:
    """a, b, cov: sample covariance of r of two tickers over the dates that both have (a <= b), 0 under `least` dates; no row where
    they share none. A ticker has one row a date."""
    n = F.col("n")
    cov = F.when(n >= max(least, 2), (F.col("xy") - F.col("x") * F.col("y") / n) / (n - 1)).otherwise(0.0)
    return _pair_sums(_numbered(df, r), False, block).select("a", "b", cov.alias("cov"))


def shrunk_covariance(df: DataFrame, r: str = "r", block: int = BLOCK) -> DataFrame:
    """a, b, cov (a <= b): covariance of r over all dates of df, r as 0 where a ticker has none, shrunk to the mean variance on the
    diagonal by Ledoit and Wolf's optimal share (2004). Both norms are sums over the pairs' rows."""
    days = df.select("date").distinct().withColumn("_at", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("date")) - 1)  # one row a date
    days = days.withColumns({"_all": F.count(F.lit(1)).over(W.partitionBy(F.lit(0))), "_dates": F.count(F.lit(1)).over(W.partitionBy(F.floor(F.col("_at") / RUN))).cast("int")})
    rows = df.join(days, "date").select("ticker", "_at", "_dates", "_all", F.coalesce(F.col(r).cast("double"), F.lit(0.0)).alias("_v"))
    mean = F.sum("_v").over(W.partitionBy("ticker")) / F.col("_all")
    rows = rows.withColumn("_gap", -mean).withColumn("_v", F.col("_v") + F.col("_gap"))
    own, both = F.col("a") == F.col("b"), lambda x: F.sum(F.when(F.col("a") == F.col("b"), x).otherwise(2 * x))
    pairs = _pair_sums(rows, True, block).select("a", "b", "n", (F.col("xy") / F.col("n")).alias("s"), (F.col("xxyy") / F.col("n")).alias("q"))
    mean_s = F.avg(F.when(own, F.col("s")))
    size = F.count(F.when(own, F.lit(1)))
    norms = pairs.agg(mean_s.alias("_m"), ((both(F.col("s") * F.col("s")) - size * mean_s * mean_s) / size).alias("_away"), (both(F.col("q") - F.col("s") * F.col("s")) / (F.first("n") * size)).alias("_noise"))
    share = F.when(F.col("_away") > 0, F.least("_noise", "_away") / F.col("_away")).otherwise(0.0)
    return pairs.join(F.broadcast(norms), F.lit(True)).select("a", "b", ((1 - share) * F.col("s") + F.when(own, share * F.col("_m")).otherwise(0.0)).alias("cov"))  # one row

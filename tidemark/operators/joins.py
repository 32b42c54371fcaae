"""Joins by date and by interval, and event counts on trading days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def asof_forward(df: DataFrame, calendar: DataFrame, on: str = "date", out: str = "trading_day") -> DataFrame:
    """df with the first calendar date on or after `on`; rows after the last one go.

    Only the distinct dates of both sides are merged and sorted, one row a day; df itself joins by equality.
    """
    days = df.select(F.col(on).alias("_d"), F.lit(None).cast("date").alias("_t")).distinct()
    days = days.unionByName(calendar.select(F.col("date").alias("_d"), F.col("date").alias("_t")))
    ahead = W.partitionBy(F.lit(0)).orderBy("_d").rangeBetween(0, W.unboundedFollowing)
    found = days.withColumn("_f", F.min("_t").over(ahead)).where("_t is null and _f is not null").select("_d", F.col("_f").alias(out))
    return df.join(found, F.col(on) == F.col("_d")).drop("_d")


def asof_backward(df: DataFrame, values: DataFrame, on: str = "date", columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """df with the values of the last date on or before `on`; values have one row a date."""
    days = df.select(on).distinct().withColumn("_v", F.lit(None).cast(values.select(F.struct(*columns).alias("s")).schema["s"].dataType))
    both = days.unionByName(values.select(F.col("date").alias(on), F.struct(*columns).alias("_v")))
    so_far = W.partitionBy(F.lit(0)).orderBy(on).rangeBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_f", F.last("_v", ignorenulls=True).over(so_far)).select(on, "_f").distinct()
    return df.join(found, on, "left").select(*df.columns, *[F.col("_f")[c].alias(c) for c in columns])


def within(df: DataFrame, intervals: DataFrame, key: str, on: str = "date") -> DataFrame:
    """Rows of df whose date lies in an interval (start_date, end_date, open if NULL, last day excluded) of their key."""
    inside = (F.col("start_date").isNull() | (F.col("start_date") <= F.col(on))) & (F.col("end_date").isNull() | (F.col("end_date") > F.col(on)))
    return df.alias("d").join(intervals.alias("i"), (F.col(f"d.{key}") == F.col(f"i.{key}")) & inside, "left_semi")


def latest(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Of each key, the columns of its row with the greatest order; combines before its shuffle."""
    last = df.groupBy(key).agg(F.max_by(F.struct(order, *columns), order).alias("_l"))
    return last.select(key, F.col("_l")[order].alias(order), *[F.col("_l")[c].alias(c) for c in columns])


def has_any(items: str, family: tuple[str, ...]) -> Column:
    """1 if a comma list holds one of the family."""
    return F.arrays_overlap(F.transform(F.split(items, ","), lambda x: F.trim(x)), F.array(*map(F.lit, family))).cast("int")


def event_panel(events: DataFrame, calendar: DataFrame, key: str, windows: tuple[int, ...] = (5, 21)) -> DataFrame:
    """date, key, n and its sums over the last rows: events counted on the trading day that they fall on or before, on every
    calendar day for every key."""
    counts = events.groupBy(F.to_date("ts").alias("date"), key).agg(F.count(F.lit(1)).alias("n"))
    counts = asof_forward(counts, calendar).groupBy(F.col("trading_day").alias("date"), key).agg(F.sum("n").alias("n"))
    dense = events.select(key).distinct().join(calendar.select(F.collect_list("date").alias("_days")), F.lit(True)).select(key, F.explode("_days").alias("date"))
    dense = dense.join(counts, ["date", key], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = W.partitionBy(key).orderBy("date")
    return dense.select("date", key, "n", *[F.sum("n").over(w.rowsBetween(1 - d, 0)).alias(f"n_{d}") for d in windows])


def measure_panel(daily: DataFrame, calendar: DataFrame, key: str, counts: tuple[str, ...], means: tuple[str, ...] = (), windows: tuple[int, ...] = (5, 21)) -> DataFrame:
    """date, key, each count (0 without rows) with its sums over the last rows, each mean with its means over them.

    daily: date, key and the measures. They fall on the trading day on or after their date and stand on every calendar day
    for every key, like event_panel's: keys x calendar days come out. A mean is NULL on a day, or over rows, without one.
    """
    some = [F.sum(c).alias(c) for c in counts] + [F.avg(c).alias(c) for c in means]
    moved = asof_forward(daily, calendar).groupBy(F.col("trading_day").alias("date"), key).agg(*some)
    dense = daily.select(key).distinct().join(calendar.select(F.collect_list("date").alias("_days")), F.lit(True)).select(key, F.explode("_days").alias("date"))
    dense = dense.join(moved, ["date", key], "left").na.fill(0, list(counts))
    w = W.partitionBy(key).orderBy("date")
    rolled = [f(c).over(w.rowsBetween(1 - d, 0)).alias(f"{c}_{d}") for f, cs in ((F.sum, counts), (F.avg, means)) for c in cs for d in windows]
    return dense.select("date", key, *counts, *means, *rolled)


def membership(events: DataFrame, key: str, current: DataFrame | None = None) -> DataFrame:
    """Intervals (key, start_date, end_date) from add and remove events (key, date, kind 1 or -1), by gaps and islands.

    On one day adds come before removes. An add opens an interval unless one is open, a remove closes it; a remove without
    an open one gives an interval with an open start; an add never closed has an open end. current: keys that are members
    now. Of those, one whose last event is a remove came back on that day, and one without events always was.
    """
    w = W.partitionBy(key).orderBy("date", F.desc("kind"))
    marked = events.select(key, "date", "kind", F.lag("kind").over(w).alias("_b"), F.lead("kind").over(w).isNull().alias("_end"))
    opens = F.when((F.col("kind") == 1) & ~F.col("_b").eqNullSafe(F.lit(1)), F.col("date"))
    marked = marked.withColumn("_open", F.last(opens, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    no_date = F.lit(None).cast("date")
    removed = F.struct(F.when(F.col("_b") == 1, F.col("_open")).alias("start_date"), F.col("date").alias("end_date"))
    still = F.struct(F.col("_open").alias("start_date"), no_date.alias("end_date"))
    again = F.struct(F.col("date").alias("start_date"), no_date.alias("end_date"))
    if current is None:
        marked = marked.withColumn("_now", F.lit(False))
    else:
        marked = marked.join(current.select(key).distinct().withColumn("_now", F.lit(True)), key, "full").withColumn("_now", F.coalesce("_now", F.lit(False)))
    none = F.array().cast("array<struct<start_date:date,end_date:date>>")
    found = F.when(F.col("kind").isNull(), F.array(F.struct(no_date.alias("start_date"), no_date.alias("end_date"))))
    found = found.when(F.col("kind") == 1, F.when(F.col("_end"), F.array(still)).otherwise(none))
    found = found.otherwise(F.when(F.col("_end") & F.col("_now"), F.array(removed, again)).otherwise(F.array(removed)))
    return marked.select(key, F.inline(found))


def event_days(events: DataFrame, key: str, stamp: str = "ts") -> DataFrame:
    """date, key, n: events by day."""
    return events.groupBy(F.to_date(stamp).alias("date"), key).agg(F.count(F.lit(1)).alias("n"))


def aligned(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Both tables' rows by `on`, with NULLs where one has none."""
    return a.join(b, on, "full")


def first_of(df: DataFrame, keys: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Every row of keys with the least value of its key in df; NULL without one."""
    return keys.join(df.groupBy(key).agg(F.min(value).alias(out)), key, "left")

"""Operators across tickers: all rows of one date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import nonzero, ratio

def average_rank(x: str, *keys: str) -> Column:
    """Rank among the non-null x of the keys, ties at their mean; NULL for NULL."""
    own = W.partitionBy(*keys, F.col(x).isNull())
    ties = W.partitionBy(*keys, F.col(x))
    return F.when(F.col(x).isNotNull(), F.rank().over(own.orderBy(x)) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def centred_rank(x: str) -> Column:
    """Average rank of the date scaled to [-0.5, 0.5]; 0 for every row of a date with at most one value."""
    n = F.count(x).over(W.partitionBy("date"))
    return F.when(n <= 1, 0.0).otherwise((average_rank(x, "date") - 1) / nonzero((n - 1).cast("double")) - 0.5)


def centred_ranks(df: DataFrame, columns: list[str], suffix: str = "_rank") -> DataFrame:
    """Centred ranks of many columns with one shuffle by (date, column) instead of a sort for each column."""
    long = df.select("date", "ticker", F.explode(F.create_map(*[y for c in columns for y in (F.lit(c), F.col(c).cast("double"))])).alias("k", "v"))
    n = F.count("v").over(W.partitionBy("date", "k"))
    rank = F.when(n <= 1, 0.0).otherwise((average_rank("v", "date", "k") - 1) / nonzero((n - 1).cast("double")) - 0.5)
    return long.withColumn("rank", rank).groupBy("date", "ticker").agg(*[F.max(F.when(F.col("k") == c, F.col("rank"))).alias(c + suffix) for c in columns])


def neutralised(x: str, group: str = "sector") -> Column:
    """x less the mean of its group on the date; rows without a group are one."""
    return F.col(x) - F.avg(x).over(W.partitionBy("date", F.coalesce(group, F.lit("__OTHER__"))))


def one_hot(values: list[str], column: str = "sector", prefix: str = "sec_") -> list[Column]:
    """A 0/1 column for each value."""
    return [F.when(F.col(column) == v, 1.0).otherwise(0.0).cast("float").alias(prefix + v) for v in values]


def dispersion(df: DataFrame, r: str, days: int = 21, least: int = 10) -> DataFrame:
    """date, dispersion (sample deviation of r across tickers) and its rolling mean over dates."""
    daily = df.groupBy("date").agg(F.stddev_samp(r).alias("dispersion"))
    w = W.partitionBy(F.lit(0)).orderBy("date").rowsBetween(1 - days, 0)  # one row per date
    return daily.withColumn("dispersion_mean", F.when(F.count("dispersion").over(w) >= least, F.avg("dispersion").over(w)))


def z_score(x: str, *keys: str) -> Column:
    """Deviations from the mean of the keys' rows; 0 where that can't be told."""
    w = W.partitionBy(*(keys or ("date",)))
    return F.coalesce(ratio(F.col(x) - F.avg(x).over(w), nonzero(F.stddev_samp(x).over(w))), F.lit(0.0))


def first_rank(x: str, descending: bool = False, *keys: str) -> Column:
    """1, 2, ... by x, ties by ticker."""
    order = F.desc(x) if descending else F.asc(x)
    return F.row_number().over(W.partitionBy(*(keys or ("date",))).orderBy(order, "ticker"))


def with_date_scalars(df: DataFrame, scalars: DataFrame, prefix: str = "reg_") -> DataFrame:
    """The columns of a table by date, prefixed, on every row of the date."""
    named = scalars.select("date", *[F.col(c).alias(prefix + c) for c in scalars.columns if c != "date"])
    return df.join(named, "date", "left")


def regime(panel: DataFrame, r: str = "r") -> DataFrame:
    """date, level and its changes over 5 and 21 dates, spread, and dispersion: the market's state by date.

    The level is the deviation of returns across tickers, the spread that of the largest and smallest close.
    """
    daily = panel.groupBy("date").agg(F.stddev_samp(r).alias("level"), (F.max("close") - F.min("close")).alias("spread"))
    w = W.partitionBy(F.lit(0)).orderBy("date")
    lag = lambda c, k: F.col(c) - F.lag(c, k).over(w)
    daily = daily.select("date", "level", lag("level", 5).alias("level_5"), lag("level", 21).alias("level_21"), "spread", (ratio(F.col("spread"), F.lag("spread", 21).over(w)) - 1).alias("spread_21"))
    return daily.join(dispersion(panel, r), "date", "left")


def equal_weight(panel: DataFrame, r: str) -> DataFrame:
    """date, bench_return: the mean of r."""
    return panel.groupBy("date").agg(F.avg(r).alias("bench_return"))


def _key(x: str, ties: tuple[str, ...] = (), descending: bool = False) -> Column:
    """What rows are ordered by: NULLs after all values, x, then the further columns."""
    return F.struct(F.col(x).isNull().alias("none"), (-F.col(x) if descending else F.col(x)).alias("x"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)])


def _ranged(df: DataFrame, key: Column, *groups: str, parts: int = 200, drawn: int = 1000) -> DataFrame:
    """df with _key and _range, which of at most `parts` ranges of the key's order (within the groups) a row is in.

    Cuts are taken from the `drawn` keys whose hashes are smallest, in each group, so that they are the same whenever the plan
    runs; as the key holds the ties, rows that share a value are in many ranges. A row finds its range by bisection. A task
    passes on no more than `drawn` keys of a group (up to spark.sql.optimizer.windowGroupLimitThreshold, 1000).
    """
    keyed = df.withColumn("_key", key)
    few = W.partitionBy(*(groups or (F.lit(0),))).orderBy("_h")
    sample = keyed.select(*groups, "_key").withColumn("_h", F.xxhash64("_key"))
    if groups:
        sample = sample.withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= drawn)
    else:
        sample = sample.orderBy("_h").limit(drawn)
    cuts = sample.groupBy(*groups).agg(F.sort_array(F.collect_set("_key")).alias("_s"))
    places = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.floor(i * F.size("_s") / parts).cast("int"))
    cuts = cuts.select(*groups, F.transform(F.array_distinct(F.filter(places, lambda i: i > 0)), lambda i: F.element_at("_s", i)).alias("_cuts"))
    both = keyed.join(F.broadcast(cuts), list(groups)) if groups else keyed.join(F.broadcast(cuts), F.lit(True))  # `parts` keys for each group
    steps = [1 << b for b in reversed(range(parts.bit_length()))]
    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when((low + step <= F.size("_cuts")) & (F.try_element_at("_cuts", low + step) < F.col("_key")), low + step).otherwise(low))
    return both.withColumn("_range", at).drop("_cuts")


def places(df: DataFrame, x: str, *ties: str, descending: bool = False, out: str = "place", parts: int = 200) -> DataFrame:
    """df with each row's place by x (a number) over the whole table, from 1; NULLs last, ties by the further columns, ascending.

    Rows are numbered within ranges of (x, ties); each range's size, one row a range, gives where the next one starts. So no
    task numbers the whole table, nor all rows that share a value: only rows equal in all of these columns are together.
    """
    ranged = _ranged(df, _key(x, ties, descending), parts=parts)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = ranged.withColumn("_k", F.row_number().over(W.partitionBy("_range").orderBy("_key"))).join(F.broadcast(starts), "_range")  # a row for each range
    return placed.select(*df.columns, (F.col("_start") + F.col("_k")).cast("long").alias(out))


def _running(counts: DataFrame, *groups: str, parts: int = 200) -> DataFrame:
    """counts (groups, _v, _c) with _end, how many rows have a value up to _v, and _all, by ranges of the value."""
    ranged = _ranged(counts, _key("_v"), *groups, parts=parts)
    sums = ranged.groupBy(*groups, "_range").agg(F.sum("_c").alias("_n"))
    whole = W.partitionBy(*(groups or (F.lit(0),)))  # one row for each range
    starts = sums.select(*groups, "_range", (F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")).alias("_start"), F.sum("_n").over(whole).alias("_all"))
    end = F.sum("_c").over(W.partitionBy(*groups, "_range").orderBy("_v")) + F.col("_start")
    return ranged.join(F.broadcast(starts), [*groups, "_range"]).withColumn("_end", end)


def quantiles_of(df: DataFrame, x: str, shares: tuple[float, ...] = (0.5,), *groups: str, parts: int = 200) -> DataFrame:
    """The groups and q, the exact quantiles of x, interpolated linearly: one row, or one for each group that has values.

    From counts by value and their running sums within ranges of the value; without groups and values q holds NULLs. Rows whose group is
    NULL are left out.
    """
    run = _running(df.where(F.col(x).isNotNull()).groupBy(*groups, F.col(x).alias("_v")).agg(F.count(F.lit(1)).alias("_c")), *groups, parts=parts)
    inside = lambda place: (F.col("_end") >= place) & (F.col("_end") - F.col("_c") < place)

    def quantile(share: float) -> Column:
        at = (F.col("_all") - 1) * share
        low, high = (F.max(F.when(inside(f(at) + 1), F.col("_v"))) for f in (F.floor, F.ceil))
        part = F.max(at - F.floor(at))
        return low * (1 - part) + high * part

    return run.groupBy(*groups).agg(F.array(*map(quantile, shares)).alias("q"))


def median_of(df: DataFrame, x: str, parts: int = 200) -> DataFrame:
    """One row `m`: the exact median of x; NULL without values."""
    return quantiles_of(df, x, (0.5,), parts=parts).select(F.col("q")[0].alias("m"))


def filled_with_median(df: DataFrame, x: str) -> DataFrame:
    """df with the median of x where x is NULL."""
    return df.join(F.broadcast(median_of(df, x)), F.lit(True)).withColumn(x, F.coalesce(x, "m")).drop("m")  # one row


def medians_so_far(df: DataFrame, xs: list[str], ends: DataFrame, parts: int = 200) -> DataFrame:
    """end, and for each of xs its median over the rows up to that date (NULL without values); ends (end) are a few dozen dates.

    One read of df: values are counted by column, value and the first end at or after their date. Running sums by range say in
    which range each end's median lies, and only that range's counts are looked at for that end.
    """
    ends = ends.select("end").distinct()
    line = ends.agg(F.sort_array(F.collect_set("end")).alias("_ends"))  # one row
    first = F.filter("_ends", lambda e: e >= F.col("date"))
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(x).cast("double").alias("_v")) for i, x in enumerate(xs)]))
    long = df.join(F.broadcast(line), F.lit(True)).select(F.try_element_at(first, F.lit(1)).alias("_from"), values.alias("_x")).select("_from", "_x.*").where("_from is not null and _v is not null")
    ranged = _ranged(long.groupBy("i", "_v", "_from").agg(F.count(F.lit(1)).alias("_c")), _key("_v"), "i", parts=parts)
    sizes = ranged.groupBy("i", "_range", "_from").agg(F.sum("_c").alias("_n"))
    sizes = sizes.join(F.broadcast(ends), F.col("_from") <= F.col("end")).groupBy("i", "end", "_range").agg(F.sum("_n").alias("_n"))  # ranges x ends rows
    own = W.partitionBy("i", "end")
    sizes = sizes.withColumns({"_upto": F.sum("_n").over(own.orderBy("_range")), "_all": F.sum("_n").over(own)})
    places_ = F.explode(F.array_distinct(F.array(F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2))))
    wanted = sizes.withColumn("_at", places_).where("_upto >= _at and _upto - _n < _at").select("i", "end", "_range", (F.col("_at") - F.col("_upto") + F.col("_n")).alias("_at"))
    inside = ranged.join(F.broadcast(wanted), ["i", "_range"]).where(F.col("_from") <= F.col("end")).groupBy("i", "end", "_range", "_at", "_v").agg(F.sum("_c").alias("_c"))
    inside = inside.withColumn("_end", F.sum("_c").over(W.partitionBy("i", "end", "_range", "_at").orderBy("_v"))).where("_end >= _at and _end - _c < _at")
    return ends.join(inside, "end", "left").groupBy("end").agg(*[F.avg(F.when(F.col("i") == i, F.col("_v"))).alias(x) for i, x in enumerate(xs)])

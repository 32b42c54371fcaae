"""Price tables: normalising, wide and long forms, incremental caches, rate series, files, and a synthetic panel."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import any_date
from .text import below_header

PRICE_COLUMNS = ("date", "ticker", "open", "high", "low", "close", "adj_close", "volume")


def normalised_prices(df: DataFrame) -> DataFrame:
    """Price columns by lower-case names (blanks as underscores), adj_close from close where there is none, dates without times."""
    df = df.withColumnsRenamed({c: c.strip().lower().replace(" ", "_") for c in df.columns})
    close = F.coalesce("adj_close", "close") if "adj_close" in df.columns else F.col("close")
    df = df.withColumns({"adj_close": close, "date": F.to_date("date")})
    return df.select(*[c for c in PRICE_COLUMNS if c in df.columns])


def price_scan(spark: SparkSession, path: str, *tickers: str) -> DataFrame:
    """Normalised prices of the tickers (all, if none is named) from a Parquet table; the filter reaches the scan."""
    df = spark.read.parquet(path)
    return normalised_prices(df.where(F.col("ticker").isin(*tickers)) if tickers else df)


def wide(df: DataFrame, field: str, tickers: list[str]) -> DataFrame:
    """date and a column for each ticker (for export; the tickers are named, so no job looks for them)."""
    return df.groupBy("date").pivot("ticker", tickers).agg(F.first(field))


def long(frames: dict[str, DataFrame]) -> DataFrame:
    """One table of several tickers' tables, with a column ticker; columns that one lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("ticker", F.lit(t)) for t, df in frames.items()])


def refreshed(keys: DataFrame, cached: DataFrame, fetched: DataFrame, key: str, order: str) -> DataFrame:
    """A row for each requested key: the cached one, else the newest fetched one, else NULLs. keys has one column, named key."""
    fresh = fetched.join(cached.select(key), key, "left_anti")
    both = cached.unionByName(fresh)
    rest = [c for c in both.columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return keys.distinct().join(last, key, "left").select(key, *[F.col("_r")[c].alias(c) for c in rest])


def missing_keys(keys: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Requested keys that have to be fetched."""
    return keys.select(key).distinct().join(cached, key, "left_anti")


def sector_map(fundamentals: DataFrame) -> DataFrame:
    """ticker, sector of those that have one."""
    return fundamentals.where("sector is not null").select("ticker", "sector").distinct()


# What a rate file calls its date column, in either case.
_DATE_NAMES = ("DATE", "OBSERVATION_DATE")


def rate_files(lines: DataFrame, first: dt.date | str | None = "2000-01-01", last: dt.date | str | None = None) -> DataFrame:
    """series, date, value from the lines of comma-separated rate files (see text.file_lines), a series each, named by its file.

    A file's first line says which column is the date; the first other one is the value. Values that aren't numbers ("." for a holiday)
    are NULL, lines whose date can't be read go, and of the rest those from first to last, both included, stay. A file without a
    date column is an error.
    """
    cells = lambda c: F.transform(F.split(c, ","), lambda v: F.trim(F.replace(v, F.lit('"'), F.lit(""))))
    rows = below_header(lines, F.trim("value") != "", "no line in the rate file").select("file", cells("value").alias("v"), cells("header").alias("h"))
    is_date = F.transform("h", lambda h: F.upper(h).isin(*_DATE_NAMES))
    rows = rows.withColumns({"_d": F.array_position(is_date, F.lit(True)).cast("int"), "series": F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1)})
    at = F.when(F.col("_d") == 0, F.raise_error(F.concat(F.lit("no date column in "), F.col("file"))).cast("int")).otherwise(F.col("_d"))
    value = F.try_element_at("v", F.when(at == 1, 2).otherwise(1)).try_cast("double")
    out = rows.select("series", any_date(F.try_element_at("v", at)).alias("date"), F.when(~F.isnan(value), value).alias("value")).where("date is not null")
    return out.where(F.lit(True) if first is None else F.col("date") >= F.lit(first).cast("date")).where(F.lit(True) if last is None else F.col("date") <= F.lit(last).cast("date"))


def rate_series(rates: DataFrame, *names: str) -> DataFrame:
    """date and a column for each named series of rate_files, on every date of any."""
    return rates.where(F.col("series").isin(*names)).groupBy("date").pivot("series", list(names)).agg(F.first("value"))


def write_panel(df: DataFrame, path: str) -> None:
    """A panel as Parquet, partitioned by year and clustered by ticker inside, so that scans of years or tickers skip files."""
    df.withColumn("year", F.year("date")).repartition("year").sortWithinPartitions("ticker", "date").write.mode("overwrite").partitionBy("year").parquet(path)


def markdown_table(df: DataFrame, order: list, columns: dict[str, Column], most: int = 10) -> DataFrame:
    """place, line: the first rows by the order as the lines of a Markdown table with a rank before the named columns (heading ->
    text, "nan" where that is NULL); a report's table, so `most` rows."""
    ranked = df.orderBy(*order).limit(most).withColumn("_k", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))  # `most` rows
    cells = F.concat_ws(" | ", F.col("_k").cast("string"), *[F.coalesce(c, F.lit("nan")) for c in columns.values()])
    heads = [(-1, "| " + " | ".join(["Rank", *columns]) + " |"), (0, "| " + " | ".join(["---"] * (len(columns) + 1)) + " |")]
    return df.sparkSession.createDataFrame(heads, "place int, line string").unionByName(ranked.select(F.col("_k").cast("int").alias("place"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line")))


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV parts with headers."""
    df.write.mode("overwrite").option("header", True).csv(path)


def _unit(seed: int, *salt) -> Column:
    """A number in (0, 1) drawn by a hash of the seed and the salt, which are columns or values."""
    return (F.pmod(F.xxhash64(F.lit(seed), *[c if isinstance(c, Column) else F.lit(c) for c in salt]), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _normal(seed: int, *salt) -> Column:
    return F.sqrt(-2 * F.ln(_unit(seed, *salt, "radius"))) * F.cos(2 * F.pi() * _unit(seed, *salt, "angle"))


def synthetic_prices(spark: SparkSession, tickers: int, days: int, *, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Prices of a random walk on weekdays from 2012-01-02: the same rows for the same seed, whatever the partitions."""
    unit = lambda *salt: (F.pmod(F.xxhash64("k", "i", F.lit(seed), *map(F.lit, salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    step = F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * F.pi() * unit(2)) * 0.012 + 0.0002
    cells = spark.range(0, tickers * days, 1, partitions) if partitions else spark.range(tickers * days)
    cells = cells.select((F.col("id") % tickers).alias("k"), F.floor(F.col("id") / tickers).cast("int").alias("i"))
    date = F.date_add(F.lit("2012-01-02"), (F.floor(F.col("i") / 5) * 7 + F.col("i") % 5).cast("int"))
    level = F.exp(F.sum("step").over(W.partitionBy("k").orderBy("i").rowsBetween(W.unboundedPreceding, 0))) * 100
    walk = cells.withColumn("step", step).select(date.alias("date"), F.format_string("T%05d", "k").alias("ticker"), level.alias("close"), (unit(3) * 4.9e7 + 1e6).alias("volume"))
    return walk.select("date", "ticker", F.col("close").alias("open"), (F.col("close") * 1.005).alias("high"), (F.col("close") * 0.995).alias("low"), "close", F.col("close").alias("adj_close"), "volume")


# The range of each figure of a made-up company.
_FACTS = {"market_cap": (2e9, 2.5e12), "beta": (0.4, 1.9), "trailing_pe": (8.0, 45.0), "forward_pe": (7.0, 38.0), "dividend_yield": (0.0, 0.045), "short_ratio": (0.5, 8.0), "short_percent_of_float": (0.005, 0.12)}
_SECTORS = ("Energy", "Health", "Industry", "Technology", "Utilities")


def synthetic_facts(prices: DataFrame, seed: int = 42) -> DataFrame:
    """ticker, sector, figures and the 52-week range of made-up companies, one for each ticker of prices, around its last close."""
    last = prices.groupBy("ticker").agg(F.max_by("close", "date").alias("_c"))
    t = F.col("ticker")
    figures = [(F.lit(a) + _unit(seed, t, c) * (b - a)).alias(c) for c, (a, b) in _FACTS.items()]
    sector = F.element_at(F.array(*map(F.lit, _SECTORS)), (F.floor(_unit(seed, t, "sector") * len(_SECTORS)) + 1).cast("int"))
    high, low = F.col("_c") * (1.05 + _unit(seed, t, "high") * 0.55), F.col("_c") * (0.5 + _unit(seed, t, "low") * 0.45)
    return last.select("ticker", sector.alias("sector"), *figures, high.alias("fifty_two_week_high"), low.alias("fifty_two_week_low"))


def synthetic_predictions(prices: DataFrame, days: int = 60, horizons: tuple[int, ...] = (1, 5), seed: int = 42) -> DataFrame:
    """date, ticker, score, rank, side, weight, per_horizon of the last `days` dates of prices: normal scores, the best and worst sixth of a
    date's tickers as longs and shorts that share half each."""
    dates = prices.select("date").distinct().orderBy(F.desc("date")).limit(days)
    rows = prices.select("date", "ticker").join(F.broadcast(dates), "date").withColumn("score", _normal(seed, F.col("date"), F.col("ticker")))
    own = W.partitionBy("date")
    rows = rows.withColumns({"rank": F.row_number().over(own.orderBy(F.desc("score"), "ticker")), "_n": F.count(F.lit(1)).over(own)}).withColumn("_m", F.greatest(F.lit(1), F.floor(F.col("_n") / 6)))
    side = F.when(F.col("rank") <= F.col("_m"), "long").when(F.col("rank") > F.col("_n") - F.col("_m"), "short")
    weight = F.when(side == "long", 0.5 / F.col("_m")).when(side == "short", -0.5 / F.col("_m")).otherwise(0.0)
    own_horizons = F.create_map(*[c for h in horizons for c in (F.lit(str(h)), _normal(seed, F.col("date"), F.col("ticker"), h))])
    return rows.select("date", "ticker", "score", "rank", side.alias("side"), weight.alias("weight"), own_horizons.alias("per_horizon"))


def synthetic_daily(prices: DataFrame, seed: int = 42) -> DataFrame:
    """date, net, turnover of a made-up strategy on every date of prices, which serving.equity_curve makes an equity of."""
    return prices.select("date").distinct().select("date", (_normal(seed, F.col("date"), "net") * 0.008 - 0.0002).alias("net"), (0.05 + _unit(seed, F.col("date"), "turnover") * 0.2).alias("turnover"))


def unheld(wanted: DataFrame, cached: DataFrame, on: str = "date") -> DataFrame:
    """The wanted days that a day cache holds no row of."""
    return wanted.select(on).distinct().join(cached.select(on).distinct(), on, "left_anti")


def filled(days: DataFrame, fetched: DataFrame, on: str = "date") -> DataFrame:
    """The fetched rows of the days; a day without any leaves a marker, its date and NULLs."""
    return days.join(fetched, on, "left").select(*fetched.columns)


def day_cache(wanted: DataFrame, cached: DataFrame, fetched: DataFrame, on: str = "date") -> DataFrame:
    """cached, and the fetched rows of wanted days that it doesn't hold. A wanted day without rows leaves a marker, so that it
    counts as held from then on."""
    return cached.unionByName(filled(unheld(wanted, cached, on), fetched, on))


def held_rows(cache: DataFrame, key: str) -> DataFrame:
    """The rows of a day cache without its markers."""
    return cache.where(F.col(key).isNotNull())

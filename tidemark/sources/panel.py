"""The canonical price panel and its companions over the star-schema tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ticker, sector, close, volume: one row per nation and shipping day.

    close is the volume-weighted price, from whole cents so that its sum is exact in any order. The dimension
    tables join by hash; the fact table is read for five columns and shuffled once, after partial sums.
    """
    names = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
    names = names.join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")).select("s_suppkey", "n_name", "r_name")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_quantity", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    sums = lines.join(names, F.expr("l_suppkey = s_suppkey")).groupBy("date", F.col("n_name").alias("ticker"), F.col("r_name").alias("sector")).agg(F.sum("cents").alias("cents"), F.sum("l_quantity").alias("volume"))
    return sums.select("date", "ticker", "sector", (F.col("cents") / 100 / F.col("volume")).alias("close"), "volume")


def market(panel: DataFrame) -> DataFrame:
    """date, bench: the equal-weighted close of all tickers."""
    return panel.groupBy("date").agg(F.avg("close").alias("bench"))


def trading_days(events: DataFrame) -> DataFrame:
    """Weekdays from the first to a week after the last event."""
    span = events.agg(F.to_date(F.min("ts")).alias("a"), F.date_add(F.to_date(F.max("ts")), 7).alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("date")).where(F.dayofweek("date").between(2, 6))


def weekly_calendar(panel: DataFrame) -> DataFrame:
    """Every date of the panel."""
    return panel.select("date").distinct()

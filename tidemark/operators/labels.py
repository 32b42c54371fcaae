"""Labels from the future of each ticker: forward returns, their directions, and triple barriers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import above, ratio
from .timeaxis import by_ticker, lagged_vol, with_daily_return


def forward_return(days: int, lag: int = 1, price: str = "close") -> Column:
    """ln of the price `lag + days` rows ahead over that `lag` rows ahead."""
    return F.ln(F.lead(price, lag + days).over(by_ticker())) - F.ln(F.lead(price, lag).over(by_ticker()) if lag else F.col(price))


def direction(r: Column) -> Column:
    """1 for a gain, 0 for a loss, NULL for neither."""
    return F.when(r > 0, 1.0).when(r < 0, 0.0).cast("float")


def forward_labels(df: DataFrame, horizons: list[int], vol_days: int = 21, price: str = "close") -> DataFrame:
    """date, ticker and for each horizon fwd_return_h, fwd_dir_h and fwd_vs_h (return over lagged vol times sqrt h)."""
    df = with_daily_return(df, price, "_r").withColumn("_vol", lagged_vol("_r", vol_days))
    out = []
    for h in horizons:
        r = forward_return(h, price=price)
        out += [r.alias(f"fwd_return_{h}"), direction(r).alias(f"fwd_dir_{h}"), ratio(r, above(F.col("_vol"), 1e-6) * h**0.5).alias(f"fwd_vs_{h}")]
    return df.select("date", "ticker", *out)


def triple_barrier(df: DataFrame, horizon: int = 5, up: float = 2.0, down: float = 2.0, vol_days: int = 21, price: str = "close") -> DataFrame:
    """date, ticker, tb_label, tb_barrier, tb_offset, tb_return.

    Entry is the next row; of the following `horizon` rows, the first whose log return from entry reaches up or -down
    times the lagged daily deviation decides: 1 and up, -1 and down, or 0 and vert at the last row. tb_offset counts
    from entry, tb_return is the return there. Rows without a price go first; rows without a deviation or without
    horizon + 1 rows ahead have NULL labels.
    """
    df = with_daily_return(df.where(F.col(price).isNotNull()), price, "_r").withColumn("_vol", above(lagged_vol("_r", vol_days), 1e-6))
    ahead = by_ticker().rowsBetween(1, 1 + horizon)
    df = df.withColumn("_path", F.collect_list(F.ln(price)).over(ahead))
    usable = (F.size("_path") == horizon + 1) & F.col("_vol").isNotNull()
    df = df.withColumn("_gain", F.when(usable, F.transform(F.slice("_path", 2, horizon), lambda p: p - F.col("_path")[0])))
    hit = lambda x: F.array_position(F.transform("_gain", x), True)
    first = lambda n: F.when(n > 0, n).otherwise(horizon + 1)
    df = df.withColumns({"_up": first(hit(lambda g: g >= F.col("_vol") * up)), "_down": first(hit(lambda g: g <= F.col("_vol") * -down))})
    offset = F.least("_up", "_down", F.lit(horizon))
    label = F.when(F.least("_up", "_down") > horizon, 0.0).when(F.col("_up") < F.col("_down"), 1.0).otherwise(-1.0)
    name = F.when(F.least("_up", "_down") > horizon, "vert").when(F.col("_up") < F.col("_down"), "up").otherwise("down")
    seen = F.col("_gain").isNotNull()
    return df.select("date", "ticker", F.when(seen, label).alias("tb_label"), F.when(seen, name).alias("tb_barrier"), F.when(seen, offset.cast("double")).alias("tb_offset"), F.when(seen, F.element_at("_gain", offset.cast("int"))).alias("tb_return"))

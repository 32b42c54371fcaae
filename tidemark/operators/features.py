"""Families of features over the price panel, composed from the operators along time; one partitioning serves all."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import timeaxis as t


TECHNICAL = [f"ret_{d}d" for d in (1, 5, 21, 63, 252)] + [f"vol_{d}d" for d in (5, 21, 63)] + "rsi_14 macd macd_signal macd_hist bb_z_20 dist_high_252 dist_low_252 adv_proxy_21 skew_21 kurt_63".split()
SECOND = "mom_12_1 st_reversal_5 max_ret_21 amihud_21".split()
OF_MARKET = ["beta_60", "idio_vol_60"]


def with_technical(df: DataFrame) -> DataFrame:
    """df (date, ticker, close, volume) with TECHNICAL, price and volume features."""
    df = t.with_daily_return(t.with_rsi_and_macd(df, out="rsi_14"), out="_r")
    high, low = t.range_distance()
    own = {**{f"ret_{d}d": t.log_return(d) for d in (1, 5, 21, 63, 252)}, **{f"vol_{d}d": t.realised_vol("_r", d) for d in (5, 21, 63)}}
    own |= {"bb_z_20": t.bollinger(), "dist_high_252": high, "dist_low_252": low, "adv_proxy_21": t.dollar_volume(), "skew_21": t.skew("_r"), "kurt_63": t.kurtosis("_r")}
    return df.withColumns(own).drop("_r")


def with_second_tier(df: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """df with SECOND, momentum, reversal, highest return and illiquidity, and with the market's returns (date, b) OF_MARKET,
    beta and the deviation of what it leaves."""
    df = t.with_daily_return(df, out="_r")
    df = df.withColumns({"mom_12_1": t.momentum(), "st_reversal_5": t.reversal(), "max_ret_21": t.highest("_r"), "amihud_21": t.illiquidity("_r")})
    if market is not None:
        df = t.with_rolling_beta(df.join(market.withColumnRenamed("b", "_b"), "date", "left"), "_r", "_b", out="beta_60")
        df = t.with_idiosyncratic_vol(df, "_r", "_b", "beta_60", out="idio_vol_60").drop("_b")
    return df.drop("_r")


def technical(panel: DataFrame) -> DataFrame:
    """date, ticker and TECHNICAL."""
    return with_technical(panel.select("date", "ticker", "close", "volume")).select("date", "ticker", *TECHNICAL)


def second_tier(panel: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """date, ticker and SECOND, with a market OF_MARKET too."""
    return with_second_tier(panel, market).select("date", "ticker", *SECOND, *(OF_MARKET if market is not None else []))


def full(panel: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """Both families on one read of the panel."""
    df = with_second_tier(with_technical(panel.select("date", "ticker", "close", "volume")), market)
    return df.select("date", "ticker", *TECHNICAL, *SECOND, *(OF_MARKET if market is not None else []))

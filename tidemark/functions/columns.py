"""Column helpers with the engine's null rules: NULL is missing, NaN never leaves a source, guards count observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """x held to [low, high]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def above(x: Column, floor: float) -> Column:
    """x where it is over floor, else NULL."""
    return F.when(x > floor, x)


def nonzero(x: Column) -> Column:
    """x, or NULL where it is 0."""
    return F.nullif(x, F.lit(0.0))


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, or NULL where b is 0 or NULL."""
    return F.try_divide(a, b)


def guarded(value: Column, counted: Column, window: WindowSpec, least: int) -> Column:
    """value over a window that holds at least `least` observations of `counted`."""
    return F.when(F.count(counted).over(window) >= least, value)


def sample_skew(x: Column, window: WindowSpec, rows: int) -> Column:
    """Bias-corrected skewness of a full window of rows; NULL for a constant one."""
    n = float(rows)
    return guarded(F.skewness(x).over(window) * ((n * (n - 1)) ** 0.5 / (n - 2)), x, window, rows)


def sample_kurtosis(x: Column, window: WindowSpec, rows: int) -> Column:
    """Bias-corrected excess kurtosis of a full window of rows; NULL for a constant one."""
    n = float(rows)
    return guarded((F.kurtosis(x).over(window) * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3))), x, window, rows)


def starting(df: DataFrame, *prefixes: str, ends: tuple[str, ...] = ()) -> list[str]:
    """Columns with one of the prefixes or suffixes, in order."""
    return [c for c in df.columns if c.startswith(prefixes or ("\0",)) or (ends and c.endswith(ends))]


def all_null(*names: str) -> Column:
    """Every named column is NULL."""
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in names])


def tidy(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Doubles rounded, without negative zero, for results that are compared by value; None: as they are."""
    if digits is None:
        return df
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# Forms in which files and pages write dates, the month before the day where both are numbers.
DATE_FORMS = ("yyyy-M-d", "yyyyMMdd", "yyyy/M/d", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy-M-d HH:mm:ss", "yyyy-M-d'T'HH:mm:ss")


def any_date(text: Column) -> Column:
    """The date that a text is in one of DATE_FORMS; NULL for any other."""
    text = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(form)) for form in DATE_FORMS]).cast("date")


def bucket_of(text: Column, digits: int = 2) -> Column:
    """The first hexadecimal digits of a text's SHA-256 as a number: an even spread over 16^digits buckets."""
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("int")


# Names of columns that hold what a model is asked for, or the signal that it judges.
FORBIDDEN = ("primary", "primary_pred", "primary_score", "realised", "realised_return", "fwd_return", "fwd_vs", "label", "future")
_LABELS = ("fwd_", "tb_")


def without_leaks(columns: list[str], *known: str, drop_labels: bool = False) -> list[str]:
    """The columns, if none would leak: a forbidden name in either case is an error, and so is one that begins like a label, unless
    labels are to be dropped. Columns named in `known` may have any name."""
    labels = [c for c in columns if c not in known and c.lower().startswith(_LABELS) and c.lower() not in FORBIDDEN]
    bad = [c for c in columns if c not in known and c.lower() in FORBIDDEN] + ([] if drop_labels else labels)
    if bad:
        raise ValueError(f"columns {sorted(bad)} would leak")
    return [c for c in columns if c not in labels]

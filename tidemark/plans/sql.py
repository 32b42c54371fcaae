"""Pieces of the DuckDB statements."""

from __future__ import annotations

PANEL = """panel AS (SELECT CAST(l_shipdate AS DATE) AS date, n_name AS ticker, r_name AS sector,
 CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS close, sum(l_quantity) AS volume
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 GROUP BY 1, 2, 3)"""
RETURNS = PANEL + """,
 rets AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS r,
  row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM panel)"""
T = "PARTITION BY ticker ORDER BY date"


def rows(n: int, end: str = "CURRENT ROW") -> str:
    return f"({T} ROWS BETWEEN {n} PRECEDING AND {end})"


def last(n: int) -> str:
    return rows(n - 1)


def full(agg: str, x: str, n: int, least: int | None = None) -> str:
    """An aggregate over the last n rows, NULL with fewer than `least` observations."""
    return f"CASE WHEN count({x}) OVER {last(n)} >= {least or n} THEN {agg} OVER {last(n)} END"


def r6(x: str, name: str, digits: int | None = 6) -> str:
    if digits is None:
        return f"{x} AS {name}"
    return f"round({x}, {digits}) + 0.0 AS {name}"


def ewm(name: str, source: str, x: str, alpha: float, least: int) -> str:
    """A recursive table (ticker, rn, y): exponential smoothing of x over rn, NULL x skipped before the first."""
    return f"""{name}_s AS (SELECT ticker, rn, {x} AS x, row_number() OVER (PARTITION BY ticker ORDER BY rn) AS k FROM {source} WHERE {x} IS NOT NULL),
 {name}_y AS (SELECT ticker, rn, k, x AS y FROM {name}_s WHERE k = 1 UNION ALL
  SELECT s.ticker, s.rn, s.k, (1 - {alpha!r}) * p.y + {alpha!r} * s.x FROM {name}_y p JOIN {name}_s s ON s.ticker = p.ticker AND s.k = p.k + 1),
 {name} AS (SELECT ticker, rn, CASE WHEN k >= {least} THEN y END AS y FROM {name}_y)"""


def folds(end: str, first: str, embargo: int = 5, least: int = 500) -> str:
    """Recursive tables up to fo (fold, train_end, test_start, test_end, n_train): tests from the day after te to `end`."""
    return f"""cal AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM panel)), hi AS (SELECT max(date) AS hi FROM cal),
 st AS (SELECT DATE '{first}' AS te, NULL::DATE AS ts UNION ALL SELECT least(CAST({end} AS DATE), hi), CAST(te + INTERVAL 1 DAY AS DATE) FROM st, hi WHERE te < hi),
 tr AS (SELECT ts AS test_start, te AS test_end, greatest(0, (SELECT count(*) FROM cal WHERE date < ts) - {embargo}) AS n_train FROM st WHERE ts IS NOT NULL),
 fo AS (SELECT CAST(row_number() OVER (ORDER BY test_start) - 1 AS INT) AS fold, date AS train_end, test_start, test_end, n_train FROM tr JOIN cal ON k = n_train WHERE n_train >= {least})"""

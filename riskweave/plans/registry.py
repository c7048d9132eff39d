"""The registry of queries: name -> (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The bridge series in SQL; each is a list of common table expressions.
LVL = "lvl AS (SELECT 'orders' AS series_id, CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice) / 1e5 + 3e-10, 6) AS value FROM orders GROUP BY 2)"
SEG = "seg AS (SELECT c_mktsegment AS series_id, CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice) / 1e5 + 3e-10, 6) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
SHIP = "ship AS (SELECT 'ship' AS series_id, CAST(l_shipdate AS DATE) AS date, round(avg(l_extendedprice) + 3e-8, 4) AS value FROM lineitem GROUP BY 2)"
VIX = "vix AS (SELECT 'vix' AS series_id, CAST(l_shipdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 2)"
MON = "mon AS (SELECT 'monthly' AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, round(avg(o_totalprice) / 1e5 + 3e-10, 6) AS value FROM orders GROUP BY 2)"
WEEK = "week AS (SELECT event_type AS series_id, CAST(date_trunc('week', ts) AS DATE) AS date, round(avg(value) + 3e-10, 6) AS value FROM events GROUP BY 1, 2)"
HOUR = "hour AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS date, round(round(avg(value) + 3e-10, 6) / 20, 0) AS value FROM events GROUP BY 1, 2)"
_CHG = "FROM {t} WINDOW w AS (PARTITION BY series_id ORDER BY date)"
RET = "ret AS (SELECT * FROM (SELECT series_id, date, value, round(0.01 * ln(value / lag(value) OVER w) + 3e-12, 8) + 0.0 AS ret " + _CHG.format(t="lvl") + ") WHERE ret IS NOT NULL)"
SRET = "sret AS (SELECT * FROM (SELECT series_id, date, value, round(0.01 * ln(value / lag(value) OVER w) + 3e-12, 8) + 0.0 AS ret " + _CHG.format(t="seg") + ") WHERE ret IS NOT NULL)"


def sql(*parts: str, recursive: bool = False) -> str:
    """Common table expressions and a final SELECT."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts[:-1])} {parts[-1]}"


def r6(expr: str) -> str:
    return f"(round({expr} + 3e-10, 6) + 0.0)"


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded after a tiny shift: means of two prices end in a half, where engines round either way."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 3 * 10.0 ** -(digits + 4), digits) + F.lit(0.0)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register

"""The panels that queries share, as DuckDB SQL; driftwell.sources.panel has them in Spark."""

RET = "price / lag(price) OVER w - 1 AS ret, ln(price) - ln(lag(price) OVER w) AS logret"

TYPE_DAY = f"""base AS (
    SELECT p_type AS series_id, CAST(l_shipdate AS DATE) AS ts, avg(l_extendedprice / l_quantity) AS price, sum(l_quantity) AS volume,
           sum(l_extendedprice * (1 - l_discount)) AS dollar_volume
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), panel AS (SELECT *, {RET} FROM base WINDOW w AS (PARTITION BY series_id ORDER BY ts))"""

BRAND_WEEK = f"""base AS (
    SELECT p_brand AS series_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, avg(l_extendedprice / l_quantity) AS price, sum(l_quantity) AS volume,
           sum(l_extendedprice * (1 - l_discount)) AS dollar_volume
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), panel AS (SELECT *, {RET} FROM base WINDOW w AS (PARTITION BY series_id ORDER BY ts))"""

SEGMENT_DAY = f"""base AS (
    SELECT c_mktsegment AS series_id, CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) AS price
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
), panel AS (SELECT *, {RET} FROM base WINDOW w AS (PARTITION BY series_id ORDER BY ts))"""

MONTHLY = "monthly AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ts, avg(o_totalprice) AS value FROM orders GROUP BY 1)"

#: Windows of a series in time order.
W = "PARTITION BY series_id ORDER BY ts"


def rows(a: int | None, b: int | None = 0) -> str:
    """A frame of a series from a rows before to b rows before; None is without bound."""
    end = lambda k, side: f"UNBOUNDED {side}" if k is None else "CURRENT ROW" if k == 0 else f"{k} PRECEDING"
    return f"({W} ROWS BETWEEN {end(a, 'PRECEDING')} AND {end(b, 'FOLLOWING')})"


def rolling(agg: str, x: str, n: int, least: int | None = None) -> str:
    """A guarded rolling aggregate."""
    return f"CASE WHEN count({x}) OVER {rows(n - 1)} >= {n if least is None else least} THEN {agg}({x}) OVER {rows(n - 1)} END"


def expanding_z(x: str, least: int) -> str:
    f = rows(None)
    return f"CASE WHEN count({x}) OVER {f} >= {least} THEN ({x} - avg({x}) OVER {f}) / nullif(stddev_samp({x}) OVER {f}, 0) END"


#: The market label that label queries share: 21-row realised volatility of the mean return of each date.
MARKET = """market AS (SELECT 'market' AS series_id, ts, avg(ret) AS ret FROM panel GROUP BY ts),
    stressed AS (SELECT *, CASE WHEN count(ret) OVER f >= 21 THEN stddev_samp(ret) OVER f * sqrt(252) * 100 END AS stress
                 FROM market WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))"""

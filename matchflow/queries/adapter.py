"""Views of the shared tables in the shape of tracking, events and intervals.

``tracking`` reads the event stream as positions: 3 matches, 2 periods, one row per event. ``*_SQL``
constants are the same views for the SQL statements.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import Blocks

HOUR = 3_600_000
DAY = 24 * HOUR


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _unit(expr: str) -> str:
    return f"((event_id * {expr} % 1000) / CAST(1000 AS DOUBLE))"


_COLUMNS = f"""user_id % 3 AS match_id,
  CASE WHEN ts < {{ts}} '2024-01-16 00:00:00' THEN 0 ELSE 1 END AS period,
  {{ms}} AS match_time, event_id AS frame, user_id AS player_id, user_id % 2 AS team_id,
  {_unit('37')} AS x, {_unit('91')} AS y, {_unit('53')} AS ball_x, {_unit('17')} AS ball_y,
  event_type, value, props"""


def tracking(spark: SparkSession, sf: str) -> DataFrame:
    ms = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"
    cols = _COLUMNS.format(ts="TIMESTAMP_NTZ", ms=ms)
    return table(spark, sf, "events").selectExpr(*split_columns(cols))


def split_columns(cols: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in cols:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


TRACKING_SQL = "SELECT " + _COLUMNS.format(
    ts="TIMESTAMP", ms="date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) // 1000") + " FROM events"

METRES_SQL = f"""SELECT *, x * 102.0::DOUBLE AS x_m, y * 64.0::DOUBLE AS y_m, ball_x * 102.0::DOUBLE AS ball_x_m,
  ball_y * 64.0::DOUBLE AS ball_y_m FROM ({TRACKING_SQL})"""


def metres(df: DataFrame) -> DataFrame:
    return df.withColumns({"x_m": F.col("x") * F.lit(102.0), "y_m": F.col("y") * F.lit(64.0),
                           "ball_x_m": F.col("ball_x") * F.lit(102.0), "ball_y_m": F.col("ball_y") * F.lit(64.0)})


def intervals(spark: SparkSession, sf: str, length: int = HOUR) -> DataFrame:
    """One interval of fixed-plus-varying length after every ``signup``."""
    return tracking(spark, sf).where("event_type = 'signup'").selectExpr(
        "match_id", "period", "frame AS seq_id", "player_id AS owner_id", "match_time AS start_ms",
        f"match_time + {length} + (frame % 7) * 60000 AS end_ms")


INTERVALS_SQL = f"""SELECT match_id, period, frame AS seq_id, player_id AS owner_id, match_time AS start_ms,
  match_time + {HOUR} + (frame % 7) * 60000 AS end_ms FROM ({TRACKING_SQL}) WHERE event_type = 'signup'"""


@lru_cache(maxsize=8)
def blocks(spark: SparkSession, sf: str) -> Blocks:
    """Cuts of the event stream, found once per table and shared by the queries on it."""
    return Blocks.equal_depth(tracking(spark, sf), "match_time")


def sequences_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer as a sequence table: priority is the match, segment the cluster."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).selectExpr(*split_columns(_ORDER_COLUMNS))


_ORDER_COLUMNS = """o_orderkey AS seq_id, o_orderpriority AS match_id, c_mktsegment AS cluster,
  o_totalprice / CAST(500000 AS DOUBLE) AS idd, (c_acctbal + CAST(1000 AS DOUBLE)) / CAST(11000 AS DOUBLE) AS ipo,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS shot,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS on_target,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS goal,
  CASE o_orderkey % 4 WHEN 0 THEN 'estructura_anchura' WHEN 1 THEN 'presion_distancia'
    WHEN 2 THEN 'estructura_retroceso' ELSE 'pitch_control_rival' END AS cause,
  CAST(o_orderkey % 64 AS DOUBLE) AS y_end, CAST(o_orderkey * 37 % 103 AS DOUBLE) AS x_max,
  CAST(o_orderkey * 53 % 120 AS DOUBLE) + (o_orderkey % 10) / CAST(10 AS DOUBLE) AS minute,
  CAST(o_orderkey * 31 % 40 AS DOUBLE) AS duration_s, o_orderkey * 7 % 12 AS passes,
  (o_orderkey * 17 % 320) / CAST(1000 AS DOUBLE) AS xt_max, o_custkey AS customer_id"""

ORDERS_SQL = f"SELECT {_ORDER_COLUMNS} FROM orders JOIN customer ON o_custkey = c_custkey"


def r6(c, name: str | None = None):
    """Round to 6 places for comparison."""
    e = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return e.alias(name or (c if isinstance(c, str) else "value"))

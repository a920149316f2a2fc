"""The test tables as coded rows, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
EVENT_CODES = [*EVENT_TYPES, "high"]
HIGH = 60.0
PRIORITIES = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unspecified": "4-NOT SPECIFIED", "low": "5-LOW"}
STATUSES = {"filled": "F", "open": "O", "pending": "P"}
ORDER_CODES = [*PRIORITIES, *STATUSES]
LINE_CODES = ["returned", "accepted", "plain", "line_open", "line_filled"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, day, parity, value and the codes: one for each type, and high."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    codes = [(F.col("event_type") == t).cast("double").alias(t) for t in EVENT_TYPES] + [(F.col("value") > HIGH).cast("double").alias("high")]
    return df.select("event_id", "user_id", F.to_date("ts").alias("day"), (F.col("user_id") % 2).alias("parity"), "value", *codes)


EVENTS_SQL = (
    "ev AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, user_id % 2 AS parity, value, "
    + ", ".join(f"CAST(CAST(event_type = '{t}' AS INT) AS DOUBLE) AS {t}" for t in EVENT_TYPES)
    + f", CAST(CAST(value > {HIGH} AS INT) AS DOUBLE) AS high FROM events)"
)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_custkey, o_orderdate, segment and codes of priority and status."""
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    codes = [(F.col("o_orderpriority") == v).cast("double").alias(k) for k, v in PRIORITIES.items()] + [(F.col("o_orderstatus") == v).cast("double").alias(k) for k, v in STATUSES.items()]
    segments = c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return o.select("o_orderkey", "o_custkey", "o_orderdate", *codes).join(segments, "o_custkey")


ORDERS_SQL = (
    "od AS (SELECT o_orderkey, o_custkey, o_orderdate, c_mktsegment AS segment, "
    + ", ".join([f"CAST(CAST(o_orderpriority = '{v}' AS INT) AS DOUBLE) AS {k}" for k, v in PRIORITIES.items()] + [f"CAST(CAST(o_orderstatus = '{v}' AS INT) AS DOUBLE) AS {k}" for k, v in STATUSES.items()])
    + " FROM orders JOIN customer ON c_custkey = o_custkey)"
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_suppkey and codes of flag and status; for windows that need no order."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    tests = [flag == "R", flag == "A", flag == "N", status == "O", status == "F"]
    return df.select("l_orderkey", "l_suppkey", *[t.cast("double").alias(c) for t, c in zip(tests, LINE_CODES, strict=True)])


_LINE_TESTS = ["l_returnflag = 'R'", "l_returnflag = 'A'", "l_returnflag = 'N'", "l_linestatus = 'O'", "l_linestatus = 'F'"]
LINES_SQL = "li AS (SELECT l_orderkey, l_suppkey, " + ", ".join(f"CAST(CAST({t} AS INT) AS DOUBLE) AS {c}" for t, c in zip(_LINE_TESTS, LINE_CODES, strict=True)) + " FROM lineitem)"

"""OHLCV bars from event tables. Each source is named by its table and aggregated with one shuffle on (symbol, time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its zone-less timestamps read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def ohlcv(df: DataFrame, symbol, time, price, volume, order: list) -> DataFrame:
    """Bars of any event table: first and last price by a total order, extremes, and summed volume."""
    at = F.struct(*order)
    return df.groupBy(symbol.alias("symbol"), time.alias("time")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(volume).alias("volume"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by return flag and ship day."""
    li = table(spark, sf_dir, "lineitem")
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return ohlcv(li, F.col("l_returnflag"), F.col("l_shipdate").cast("date"), F.col("l_extendedprice"), F.col("l_quantity"), order)


def sparse_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and day; days without orders have no bar."""
    o = table(spark, sf_dir, "orders")
    return ohlcv(o, F.col("o_orderpriority"), F.col("o_orderdate").cast("date"), F.col("o_totalprice"), F.lit(1.0), [F.col("o_orderkey")])


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour, with prices shifted above zero."""
    e = table(spark, sf_dir, "events")
    price = F.col("value") + 1
    return ohlcv(e, F.col("event_type"), F.date_trunc("hour", "ts"), price, F.lit(1.0), [F.col("ts"), F.col("event_id")])


def smoothed_bars(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """Daily bars about the mean of the last ``n`` closes: open is the mean before, wicks are a thousandth. Prices that move in swings, as patterns need."""
    w = Window.partitionBy("symbol").orderBy("time")
    mean = F.when(F.count("close").over(w.rowsBetween(1 - n, 0)) == n, F.avg("close").over(w.rowsBetween(1 - n, 0)))
    bars = daily_bars(spark, sf_dir).withColumn("mean", mean).withColumn("before", F.lag("mean").over(w)).where("before IS NOT NULL")
    return bars.select("symbol", "time", F.col("before").alias("open"), (F.greatest("mean", "before") * 1.001).alias("high"), (F.least("mean", "before") * 0.999).alias("low"), F.col("mean").alias("close"), "volume")


# The same bars for the oracle.
DAILY_SQL = """SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS time,
 arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
 arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2"""
SPARSE_SQL = """SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS time, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
 min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, sum(1.0::DOUBLE) AS volume FROM orders GROUP BY 1, 2"""
HOURLY_SQL = """SELECT event_type AS symbol, date_trunc('hour', ts) AS time, arg_min(value + 1, (ts, event_id)) AS open, max(value + 1) AS high, min(value + 1) AS low,
 arg_max(value + 1, (ts, event_id)) AS close, sum(1.0::DOUBLE) AS volume FROM events GROUP BY 1, 2"""

"""All registered queries of the market library with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import analytics, comparison, kernels, patterns, scorecard
from tidemark.plans.events import EVENTS
from tidemark.plans.indicators import PLANS as INDICATORS
from tidemark.sources.bars import DAILY_SQL, HOURLY_SQL, SPARSE_SQL, daily_bars, hourly_bars, sparse_bars

PLANS = INDICATORS | EVENTS

Query = Callable[[SparkSession, str], DataFrame]


def _planned(name: str) -> Query:
    return lambda spark, sf_dir: PLANS[name].spark(daily_bars(spark, sf_dir))


def _bars() -> tuple[dict[str, Query], dict[str, str]]:
    own = {"bars_daily": (daily_bars, DAILY_SQL), "bars_sparse": (sparse_bars, SPARSE_SQL), "bars_hourly": (hourly_bars, HOURLY_SQL)}
    stamp = "date_format(time, 'yyyy-MM-dd HH:mm:ss')"
    cols = ["open", "high", "low", "close", "volume"]
    asked = {k: lambda spark, sf_dir, q=q: q(spark, sf_dir).selectExpr("symbol", f"{stamp} AS time", *cols) for k, (q, _) in own.items()}
    return asked, {k: f"SELECT symbol, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, {', '.join(cols)} FROM ({s})" for k, (_, s) in own.items()}


def queries() -> dict[str, Query]:
    asked = {name: lambda spark, sf_dir, name=name: analytics.run(spark, sf_dir, name) for name in analytics.SQL}
    return _bars()[0] | {name: _planned(name) for name in PLANS} | asked | kernels.QUERIES | patterns.QUERIES | scorecard.QUERIES | comparison.QUERIES


def oracle_sql() -> dict[str, str]:
    return _bars()[1] | {name: plan.sql(DAILY_SQL) for name, plan in PLANS.items()} | analytics.ORACLE | kernels.ORACLE | scorecard.ORACLE | comparison.ORACLE

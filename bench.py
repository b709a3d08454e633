"""Times the headline queries and prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = "bars_daily sma_bollinger macd rsi adx candles signals scorecard_native forward_returns abnormal_returns sma_cross_backtest summary_stats correlation_matrix cot_index max_pain event_aggregate_weighted token_tone novelty_cosine state_strategies".split()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.codegen.cache.maxEntries", "2000").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidemark.plans import registry

    took = {}
    for name in HEADLINES:
        began = time.time()
        registry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is planned anew and written to the noop sink, so all rows and columns are
computed.  One warm-up, in which the shared fixture tables are written, then the median of
$BENCH_RUNS runs; a query whose warm-up took longer than $BENCH_LONG seconds is run twice only.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

import pyspark

from tempora.catalog import forget, load
from tempora.session import build_session

HEADLINE = (
    "total_return", "asof_fundamental", "market_cap", "resolve_ticker", "momentum_12_1", "rolling_market_state", "price_fills",
    "top_quantile", "portfolio_nav", "portfolio_nav_costed", "param_sweep", "scorecard", "nearest_rank_hot_group", "bootstrap_sharpe", "bootstrap_sharpe_1000",
    "purged_kfold_per_asset",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    long = float(os.environ.get("BENCH_LONG", "20"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    seconds, rows, repeats = {}, {}, {}
    for name in HEADLINE:
        began = time.perf_counter()
        rows[name] = queries[name](spark, sf_dir).count()
        repeats[name] = runs if time.perf_counter() - began <= long else min(runs, 2)
        taken = []
        for _ in range(repeats[name]):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(taken), 3)
    print(json.dumps({
        "metric": "headline queries, median seconds, summed", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows": rows, "sf": os.path.basename(sf_dir.rstrip("/")), "cores": cpus, "runs": repeats,
        "spark": pyspark.__version__,
    }))
    forget(spark)
    spark.stop()


if __name__ == "__main__":
    main()

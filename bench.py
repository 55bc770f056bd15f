"""Headline timings on one machine; prints one JSON line.

The steps are a nightly build and its readers: facts and prices from the driver tables, the
bitemporal table, scores, screener, backtests, accrual test, quality checks. Each step reads the
tables the steps before it wrote. All steps run twice from the driver tables on; ``queries`` are
the second pass, the figures of a session in use, and ``first_pass`` is the total of the first,
with class loading and compilation.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from asfiled.plans import accruals, backtest, quality, scoring
from asfiled.plans import screener as screen
from harness.inputs import Inputs

#: Steps in the scope of the one published figure: build and test.
BUILD_AND_TEST = ("financials_pit", "scores", "screener", "financials_as_of", "scores_as_of",
                  "accrual_returns", "repeated_first_reports", "unreconciled_scores")

CPUS = int(os.environ.get("BENCH_CPUS", "8"))
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", str(CPUS))
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.sql.session.timeZone", "UTC")
             # The default of 100 classes is less than one build generates.
             .config("spark.sql.codegen.cache.maxEntries", "2000")
             .config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(x: Inputs) -> dict[str, float]:
    steps = {
        "ingest_facts": lambda: x.facts,
        "ingest_prices": lambda: x.raw_prices,
        "financials_pit": lambda: x.pit,
        "scores": lambda: x.scored,
        "screener": lambda: x.screener,
        "score_detail": lambda: run(scoring.score_detail(x.scored)),
        "financials_as_of": lambda: x.visible_years,
        "scores_as_of": lambda: run(backtest.scores_as_of(x.visible_years, x.prices)),
        "knowledge_intervals": lambda: (x.knowledge, x.unsettled),
        "strict_financials_as_of": lambda: x.strict_years,
        "strict_scores_as_of": lambda: run(backtest.scores_as_of(x.strict_years, x.prices)),
        "accrual_returns": lambda: x.accrual_returns,
        "quintile_stats": lambda: x.quintiles,
        "hedge_test": lambda: run(accruals.hedge_test(x.quintiles, x.accrual_returns)),
        "fleet_figures": lambda: run(screen.fleet_figures(x.screener)),
        "sector_figures": lambda: run(screen.sector_figures(x.screener)),
        "flag_rank": lambda: run(screen.flag_rank(x.screener)),
        "histogram_m_score": lambda: run(screen.histogram(x.screener, "m_score")),
        "restatement_board": lambda: run(screen.restatement_board(x.pit)),
        "repeated_first_reports": lambda: run(quality.repeated_first_reports(x.pit)),
        "unreconciled_scores": lambda: run(quality.unreconciled(
            backtest.scores_as_of(x.visible_years, x.prices), x.scored)),
        "facts_to_scores": lambda: run(scoring.scored_company_years(x.build_pit(), x.prices)),
    }
    seconds = {}
    for name, step in steps.items():
        began = time.perf_counter()
        step()
        seconds[name] = round(time.perf_counter() - began, 3)
    return seconds


def main() -> None:
    spark = session()
    first = timed(Inputs(spark, SF_DIR))
    x = Inputs(spark, SF_DIR)
    seconds = timed(x)
    print(json.dumps({
        "metric": "build, backtest and screen, wall clock", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "facts": x.facts.count(), "prices": x.raw_prices.count(), "cpus": CPUS,
        "build_and_test": round(sum(seconds[s] for s in BUILD_AND_TEST), 3),
        "first_pass": round(sum(first.values()), 3)}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the reports from the source tables to their last row; prints one JSON line.

Each entry point runs on a pipeline of its own, so its time holds all of its stages.
`monthly_run` builds every report on one pipeline, as a month's run does. The fixture that
stands in for the warehouse tables is written before the clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from merchlife import MerchantPipeline
from merchlife.session import local_session
from merchlife.sources.fixture import FIXTURE_PARAMS, fixture_sources
from merchlife.sources.stages import StageStore

ENTRY_POINTS = (
    "executive_dashboard",
    "segment_dashboard_mcc",
    "rfm_migration",
    "rfm_summary",
    "activation_curve_report",
    "merchant_balance_usd",
    "fraud_by_month",
    "lifecycle_status",
    "payment_method_mix",
    "account_fees",
)
REPORTS = (
    "executive_dashboard",
    "latest_accounts_created",
    "activation_curve_report",
    "cohort_by_creation",
    "cohort_by_first_trx",
    "back_from_churn_review",
    "back_from_churn_by_attributes",
    "created_activated_by_attributes",
    "first_trx_by_attributes",
    "churn_by_attributes",
    "segment_dashboard_mcc",
    "rfm_summary",
    "rfm_migration",
    "cohort_first_trx_by_attributes",
    "cohort_creation_by_attributes",
    "lifecycle_status",
    "payment_method_mix",
)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    store = StageStore(spark)
    start = time.time()
    sources = fixture_sources(spark, folder, store)
    setup = time.time() - start

    def fresh() -> MerchantPipeline:
        return MerchantPipeline(spark, sources, FIXTURE_PARAMS, StageStore(spark))

    def timed(run) -> float:
        start = time.time()
        run()
        return round(time.time() - start, 3)

    drain(fresh().lifecycle_status())  # starts the executor's code generation
    seconds = {n: timed(lambda: drain(getattr(fresh(), n)())) for n in ENTRY_POINTS}

    def monthly_run() -> None:
        pipeline = fresh()
        pipeline.prepare()
        for name in REPORTS:
            drain(getattr(pipeline, name)())

    seconds["monthly_run"] = timed(monthly_run)
    print(
        json.dumps(
            {
                "metric": "merchant_reports_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(folder.rstrip("/").rsplit("sf", 1)[-1]),
                "cpus": cpus,
                "lineitem_rows": spark.read.parquet(f"{folder}/lineitem.parquet").count(),
                "fixture_setup_sec": round(setup, 3),
                "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
            }
        )
    )


if __name__ == "__main__":
    sys.exit(main())

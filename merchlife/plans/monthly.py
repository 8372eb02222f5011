"""The monthly job: all derived tables and all reports, stored."""

from __future__ import annotations

from pyspark.sql import SparkSession

from merchlife.params import Params
from merchlife.plans.pipeline import MerchantPipeline
from merchlife.sources.releases import Releases
from merchlife.sources.stages import StageStore
from merchlife.sources.tables import Sources

# Steps that are kept as tables. Those with a month of their own are partitioned by it.
TABLES = (
    "payment_method_flags",
    "merchant_month_financials",
    "merchant_month_base",
    "merchant_creation_month",
    "first_transaction_month",
    "months_on_book",
    "churn_events",
    "avg_balance_month",
    "month_end_balance",
    "merchant_balance_usd",
    "fraud_transactions",
    "fraud_usd",
    "fraud_by_merchant_month",
    "active_with_fraud",
    "top_account_per_merchant",
    "account_fees",
    "active_rfm",
    "churn_rfm",
    "union_active_churn",
    "account_dimension",
    "created_by_month_attributes",
    "created_segment",
    "lifecycle_rows",
    "rfm_scores",
    "union_signups",
)
# Steps that are kept as files for the dashboard tool; months or groups, not merchants.
REPORTS = (
    "monthly_kpis",
    "names_created_by_month",
    "latest_accounts_created",
    "first_transaction_counts",
    "activation_curve_report",
    "cohort_by_creation",
    "cohort_by_first_trx",
    "back_from_churn_by_month",
    "back_from_churn_review",
    "created_activated_by_month",
    "balances_by_month",
    "churn_by_month",
    "fraud_by_month",
    "executive_dashboard",
    "back_from_churn_by_attributes",
    "created_activated_by_attributes",
    "first_trx_by_attributes",
    "churn_by_attributes",
    "segment_dashboard",
    "segment_dashboard_mcc",
    "rfm_summary",
    "rfm_migration",
    "rfm_migration_matrix",
    "cohort_first_trx_by_attributes",
    "cohort_creation_by_attributes",
    "lifecycle_status",
    "payment_method_mix",
)


def monthly_run(
    spark: SparkSession,
    sources: Sources,
    params: Params,
    database: str | None,
    warehouse: str,
    report_format: str = "parquet",
) -> Releases:
    """Writes every table and report as one release in the folder `warehouse`, and shows the
    tables as views in `database` if one is given.

    Readers see the release before until all of this one is written and audited, then all of
    this one. A run that was stopped is simply started again; what it wrote is never read. Its
    stages go at the end, whether it succeeds or not.
    """
    store = StageStore(spark)
    releases = Releases(spark, warehouse)
    release = releases.begin()
    try:
        run = MerchantPipeline(spark, sources, params, store)
        run.prepare()
        for name in TABLES:
            df = getattr(run, name)()
            release.write(df, name, "mes" if "mes" in df.columns else None)
        for name in REPORTS:
            release.write(getattr(run, name)(), name, file_format=report_format)
        release.commit()
    except BaseException:
        release.abort()
        raise
    finally:
        store.close()
    if database:
        releases.publish(database)
    return releases

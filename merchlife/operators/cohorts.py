"""Creation and first-transaction cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchlife.functions.columns import (
    by_key,
    day,
    exact_avg,
    month,
    month_diff,
    month_number,
    with_return_flag,
)
from merchlife.operators.activity import has_volume
from merchlife.params import Params


def merchant_milestones(base: DataFrame, p: Params) -> DataFrame:
    """Creation month and first month with volume of every merchant, in one pass."""
    created = F.col("account_create_date")
    billed = F.col("billing_date_monthly")
    return (
        base.groupBy(F.col("name_merchant_").alias("nombre_merchant"))
        .agg(
            month(F.min(F.when(created < day(p.as_of_month), created))).alias("fecha_creacion"),
            F.min(F.when((billed <= day(p.as_of_month)) & has_volume(), billed)).alias(
                "primera_trx"
            ),
        )
    )


def merchant_creation_month(milestones: DataFrame) -> DataFrame:
    return milestones.filter(F.col("fecha_creacion").isNotNull()).select(
        "nombre_merchant", "fecha_creacion"
    )


def first_transaction_month(milestones: DataFrame) -> DataFrame:
    return milestones.filter(F.col("primera_trx").isNotNull()).select(
        "nombre_merchant", "primera_trx"
    )


def first_transaction_counts(milestones: DataFrame) -> DataFrame:
    return (
        first_transaction_month(milestones)
        .groupBy("primera_trx")
        .agg(F.count(F.lit(1)).alias("cantidad_primera_trx"))
    )


def names_created_by_month(dim_account: DataFrame, names: DataFrame) -> DataFrame:
    """Merchant names per creation month; `names` holds the allow-listed accounts."""
    return (
        dim_account.join(by_key(names), "account_id")
        .select(month("account_create_date").alias("fecha_creacion"), "name_merchant")
        .distinct()
        .groupBy("fecha_creacion")
        .agg(F.count(F.lit(1)).alias("cantidad"))
    )


def accounts_created_by_month(dim_account: DataFrame, smb: DataFrame) -> DataFrame:
    return (
        dim_account.join(by_key(smb), "account_id", "left_semi")
        .groupBy(month("account_create_date").alias("fecha_creacion"))
        .agg(F.count(F.lit(1)).alias("cantidad"))
    )


def latest_accounts_created(created: DataFrame, n: int = 10) -> DataFrame:
    return created.orderBy(F.col("fecha_creacion").desc_nulls_first()).limit(n)


def months_on_book(active: DataFrame, milestones: DataFrame) -> DataFrame:
    """Active rows with the merchant's cohort months, months on book and the marker of
    merchants whose first transaction falls in their creation month."""
    cohort = milestones.filter(F.col("nombre_merchant").isNotNull()).select(
        "nombre_merchant",
        F.col("fecha_creacion").alias("fecha_creacion_nombre"),
        F.col("primera_trx").alias("primera_trx_nombre"),
    )
    activated = (F.col("creacion_hasta_first_trx") == 0) & (
        F.col("mes") == F.col("primera_trx_nombre")
    )
    return (
        active.join(by_key(cohort), "nombre_merchant", "left")
        .withColumns(
            {
                "creacion_hasta_first_trx": month_diff(
                    "fecha_creacion_nombre", "primera_trx_nombre"
                ),
                "mob_first_trx": month_diff("primera_trx_nombre", "mes"),
                "mob_creacion_cuenta": month_diff("fecha_creacion_nombre", "mes"),
            }
        )
        .withColumn("created_activated", F.when(activated, F.lit("activa_mes_creada")))
    )


def activation_curve(milestones: DataFrame, names_created: DataFrame) -> DataFrame:
    """Cumulative share of each creation cohort that has transacted by month n."""
    cohort = (
        milestones.filter(
            F.col("nombre_merchant").isNotNull() & F.col("fecha_creacion").isNotNull()
        )
        .select("fecha_creacion", month_diff("fecha_creacion", "primera_trx").alias("mob_first_trx"))
        .filter(F.col("mob_first_trx").isNotNull())
        .groupBy("fecha_creacion", "mob_first_trx")
        .agg(F.count(F.lit(1)).alias("activas_mes_mob"))
    )
    totals = names_created.withColumnRenamed("cantidad", "total_creadas")
    # A cohort has one row per month on book here.
    w = (
        Window.partitionBy("fecha_creacion")
        .orderBy("mob_first_trx")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rate = F.col("cumulative_sum").cast("decimal(20,5)") / F.col("total_creadas").cast(
        "decimal(20,5)"
    )
    return (
        cohort.join(totals, "fecha_creacion", "left")
        .withColumn("cumulative_sum", F.sum("activas_mes_mob").over(w))
        .withColumn("tasa_activacion_acum", rate)
        .withColumn("fm_num", month_number("fecha_creacion"))
    )


def activation_curve_report(curve: DataFrame, p: Params) -> DataFrame:
    return curve.filter(F.col("fecha_creacion") >= day(p.curve_start)).orderBy(
        F.col("fecha_creacion").desc_nulls_first(), "mob_first_trx"
    )


def _cohort_means(rows: DataFrame, cohort: str, mob: str, *attributes: str) -> DataFrame:
    return (
        rows.groupBy(cohort, mob, *attributes)
        .agg(
            exact_avg("tpt").alias("tpt"),
            exact_avg("tpv_usd").alias("tpv"),
            exact_avg("revenue_usd").alias("revenue"),
            F.count(F.lit(1)).alias("cantidad"),
        )
        .orderBy(F.col(cohort).desc_nulls_first(), F.col(mob).asc_nulls_last())
    )


def cohort_by_creation(rows: DataFrame, *attributes: str) -> DataFrame:
    return _cohort_means(rows, "fecha_creacion_nombre", "mob_creacion_cuenta", *attributes)


def cohort_by_first_trx(rows: DataFrame, *attributes: str) -> DataFrame:
    return _cohort_means(rows, "primera_trx_nombre", "mob_first_trx", *attributes)


def back_from_churn_by_month(mobs: DataFrame) -> DataFrame:
    return (
        with_return_flag(mobs)
        .filter(F.col("back_from_churn") == "is back")
        .groupBy("mes", "back_from_churn")
        .agg(F.count(F.lit(1)).alias("number_back"))
    )


def back_from_churn_review(mobs: DataFrame, p: Params) -> DataFrame:
    """Merchants of the review month. The flag is not a condition here, so the window
    that would compute it is left out."""
    return mobs.filter(F.col("mes") == day(p.review_month)).select("nombre_merchant")


def created_activated_by_month(mobs: DataFrame) -> DataFrame:
    return (
        mobs.filter(F.col("created_activated").isNotNull())
        .groupBy("mes")
        .agg(F.count(F.lit(1)).alias("primera_trx_mes_creacion"))
    )

"""Monthly billing facts to active, dormant and churned merchants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchlife.functions.columns import (
    MEASURES,
    METHODS,
    by_key,
    day,
    distinct_in_merchant,
    exact_sum,
    flag,
    month,
    month_diff,
)
from merchlife.params import Params, shift_month


def billing_in_country(billing: DataFrame, client_base: DataFrame, p: Params):
    """Both inputs with the country filter on the side that carries the column.

    On the billing side it is a scan filter and the join stays a left join. When only the
    client base knows the country, unmatched billing rows cannot pass and the join is inner.
    """
    if "country_account" in billing.columns:
        return billing.filter(F.col("country_account") == p.country), client_base, "left"
    return billing, client_base.filter(F.col("country_account") == p.country), "inner"


def _account_month_groups(client_base: DataFrame) -> DataFrame:
    return client_base.select(
        F.col("account_id").alias("_account"),
        month("month").alias("_month"),
        "name_merchant",
        "group",
    ).distinct()


def payment_method_flags(billing: DataFrame, client_base: DataFrame, p: Params) -> DataFrame:
    """Per merchant, month and group: earliest creation and a 0/1 flag per method.

    min and max ignore duplicates, so both sides are reduced to their account-months
    before the join: the raw facts are only ever map-side combined, and a hot account
    arrives at the join as one row per month. The ten flags travel as the bits of one
    number, which keeps both shuffles and the sort narrow.
    """
    facts, base, how = billing_in_country(billing, client_base, p)
    bit = F.lit(0)
    for i, m in enumerate(METHODS):
        bit = F.when(F.col("payment_method_type") == m.upper(), F.lit(1 << i)).otherwise(bit)
    per_account = facts.groupBy("account_id", "account_name", "billing_date_monthly").agg(
        F.min("account_create_date").alias("account_create_date"), F.bit_or(bit).alias("_used")
    )
    groups = _account_month_groups(base)
    on = (F.col("account_id") == F.col("_account")) & (
        month("billing_date_monthly") == F.col("_month")
    )
    return (
        per_account.join(by_key(groups), on, how)
        .groupBy(
            F.coalesce("name_merchant", "account_name").alias("name_merchant_"),
            "billing_date_monthly",
            "group",
        )
        .agg(
            F.min("account_create_date").alias("account_create_date"),
            F.bit_or("_used").alias("_used"),
        )
        .withColumns(
            {m: F.shiftright("_used", i).bitwiseAND(F.lit(1)) for i, m in enumerate(METHODS)}
        )
        .drop("_used")
    )


def merchant_month_financials(client_base: DataFrame, p: Params) -> DataFrame:
    return (
        client_base.filter(
            F.col("group").isin(*p.groups) & (F.col("country_account") == p.country)
        )
        .groupBy("name_merchant", "month")
        .agg(*(exact_sum(m).alias(m) for m in ("gm_usd", "tpt", "tpv_usd", "revenue_usd")))
    )


def merchant_month_base(flags: DataFrame, financials: DataFrame) -> DataFrame:
    sums = financials.select(
        F.col("name_merchant").alias("_name"), month("month").alias("_month"), *MEASURES
    )
    on = (F.col("name_merchant_") == F.col("_name")) & (
        month("billing_date_monthly") == F.col("_month")
    )
    return flags.join(by_key(sums), on, "left").drop("_name", "_month")


def month_calendar(spark: SparkSession, p: Params) -> DataFrame:
    """The closed months before as_of."""
    months = F.sequence(day(p.first_month), day(p.last_month), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("mes"))


def evaluated_months(calendar: DataFrame, base: DataFrame) -> DataFrame:
    """The calendar with the number of merchant rows billed in each month."""
    billed = base.groupBy(month("billing_date_monthly").alias("mes")).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    return calendar.join(billed, "mes", "left").select(
        "mes", F.coalesce("_rows", F.lit(0).cast("long")).alias("registros_base")
    )


def has_volume() -> Column:
    return (F.col("tpv_usd") > 0) & (F.col("tpt") > 0)


def activity_distance(base: DataFrame, p: Params) -> DataFrame:
    """(merchant, group, calendar month, months since the last volume), 0 to churn_months.

    A row can only matter for its own month and the churn_months after it, so it is
    exploded to those of them that are in the calendar and not before the creation month,
    and the newest billing month wins. One shuffle serves both the active and the churn
    table; no range join and no scan per month.
    """
    billed = F.col("billing_date_monthly")
    oldest = shift_month(p.first_month, -p.churn_months)
    own = month(billed)
    starts = F.when(billed > own, F.add_months(own, 1)).otherwise(own)
    months = F.sequence(F.col("_from"), F.col("_to"), F.expr("interval 1 month"))
    return (
        base.filter(has_volume() & F.col("account_create_date").isNotNull())
        .filter(billed.between(day(oldest), day(p.last_month)))
        .select(
            F.col("name_merchant_").alias("name_merchant"),
            "group",
            billed,
            F.greatest(starts, month("account_create_date"), day(p.first_month)).alias("_from"),
            F.least(F.add_months(own, p.churn_months), day(p.last_month)).alias("_to"),
        )
        .filter(F.col("_from") <= F.col("_to"))
        .select("name_merchant", "group", "billing_date_monthly", F.explode(months).alias("mes"))
        .groupBy("name_merchant", "group", "mes")
        .agg(F.max("billing_date_monthly").alias("_last"))
        .select(
            "name_merchant", "mes", month_diff("_last", "mes").alias("inactividad"), "group"
        )
    )


def active_merchants(distance: DataFrame, p: Params) -> DataFrame:
    return distance.filter(F.col("inactividad") < p.churn_months)


def churn_events(distance: DataFrame, p: Params) -> DataFrame:
    return distance.filter(F.col("inactividad") == p.churn_months).withColumnRenamed(
        "name_merchant", "nombre_merchant"
    )


def churn_by_month(churn: DataFrame, p: Params) -> DataFrame:
    return (
        churn.filter(F.col("group").isin(*p.groups))
        .groupBy("mes")
        .agg(F.count(F.lit(1)).alias("cantidad_churn"))
    )


def active_payment_usage(active: DataFrame, base: DataFrame, p: Params) -> DataFrame:
    in_calendar = F.col("billing_date_monthly").between(day(p.first_month), day(p.last_month))
    usage = base.filter(in_calendar).select(
        "name_merchant_",
        F.to_date("billing_date_monthly").alias("_month"),
        *MEASURES,
        *METHODS,
    )
    on = (F.col("name_merchant") == F.col("name_merchant_")) & (F.col("mes") == F.col("_month"))
    return (
        active.filter(F.col("group").isin(*p.groups))
        .join(by_key(usage), on, "left")
        .select(
            F.col("name_merchant").alias("nombre_merchant"),
            "mes",
            "inactividad",
            *MEASURES,
            *METHODS,
        )
    )


def method_count_inactive(usage: DataFrame, p: Params) -> DataFrame:
    """Number of methods used (NULL in a month without billing) and the dormant flag."""
    total = F.col(METHODS[0])
    for m in METHODS[1:]:
        total = total + F.col(m)
    return usage.withColumn("suma_de_metodos", total).withColumn(
        "inactivo", flag(F.col("inactividad") >= p.dormant_months)
    )


def active_dedup(rows: DataFrame) -> DataFrame:
    return distinct_in_merchant(rows)


def active_null_to_zero(rows: DataFrame) -> DataFrame:
    return rows.withColumns({m: F.coalesce(m, F.lit(0.0)) for m in MEASURES})


def kpi_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("registros"),
        exact_sum("tpt").alias("tpt"),
        exact_sum("tpv_usd").alias("tpv"),
        exact_sum("revenue_usd").alias("revenue"),
        exact_sum("gm_usd").alias("gm"),
        F.sum("suma_de_metodos").alias("suma_metodos"),
        F.sum("inactivo").alias("inactivo"),
    ]


def monthly_kpis(active: DataFrame) -> DataFrame:
    return active.groupBy("mes").agg(*kpi_columns())


def lifecycle_status(base: DataFrame, p: Params) -> DataFrame:
    """Active, dormant or churner per merchant and group in the newest closed month."""
    gap = month_diff("_last", day(p.last_month))
    return (
        base.filter(
            has_volume()
            & (F.col("billing_date_monthly") <= day(p.last_month))
            & (F.col("account_create_date") <= F.last_day(day(p.last_month)))
        )
        .groupBy(F.col("name_merchant_").alias("name_merchant"), "group")
        .agg(F.max("billing_date_monthly").alias("_last"))
        .select(
            "name_merchant",
            "group",
            gap.alias("inactividad"),
            F.when(gap < p.dormant_months, F.lit("active"))
            .when(gap < p.churn_months, F.lit("dormant"))
            .otherwise(F.lit("churner"))
            .alias("status"),
        )
    )


def payment_method_mix(billing: DataFrame, client_base: DataFrame, p: Params) -> DataFrame:
    """Share of each payment method in a merchant's billing rows."""
    facts, base, how = billing_in_country(billing, client_base, p)
    per_account = facts.groupBy(
        "account_id", "account_name", month("billing_date_monthly").alias("_billed"),
        "payment_method_type",
    ).agg(F.count(F.lit(1)).alias("_n"))
    names = base.select(
        F.col("account_id").alias("_account"), month("month").alias("_month"), "name_merchant"
    ).distinct()
    on = (F.col("account_id") == F.col("_account")) & (F.col("_billed") == F.col("_month"))
    # One row per method here, so the window over a merchant stays small.
    whole = Window.partitionBy("name_merchant")
    return (
        per_account.join(by_key(names), on, how)
        .groupBy(
            F.coalesce("name_merchant", "account_name").alias("name_merchant"),
            "payment_method_type",
        )
        .agg(F.sum("_n").alias("cantidad"))
        .withColumn("participacion", F.col("cantidad") / F.sum("cantidad").over(whole))
    )

"""Account balances in USD per merchant and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlife.functions.columns import by_key, exact_avg, left_join_by_month, month, with_return_flag
from merchlife.sources.tables import monthly_fx, to_usd


def account_month_balance(balance: DataFrame) -> DataFrame:
    """Per account and month the mean balance and the month-end balance, from one pass.

    The snapshots are map-side combined, so a hot account is one row per month in every
    later join. `several` marks account-months whose month end has different balances, for
    which a single column does not do.
    """
    taken = F.to_date("fecha_creacion")
    at_end = taken == F.last_day(taken)
    ends = F.when(at_end, F.col("saldo"))
    low, high = F.min(ends), F.max(ends)
    unknown = F.count_if(at_end & F.col("saldo").isNull()) > 0
    return balance.groupBy(
        F.col("cuenta_id").alias("account_id"), month("fecha_creacion").alias("fecha_saldo")
    ).agg(
        exact_avg("saldo").alias("saldo"),
        low.alias("saldo_fin"),
        F.coalesce((low != high) | (unknown & low.isNotNull()), F.lit(False)).alias("several"),
    )


def month_end_rows(balance: DataFrame) -> DataFrame:
    """Balance rows taken on the last day of their month."""
    taken = F.to_date("fecha_creacion")
    return balance.filter(taken == F.last_day(taken)).select(
        F.col("cuenta_id").alias("account_id"),
        month("fecha_creacion").alias("fecha_saldo"),
        "saldo",
        F.lit("last").alias("es_ultimo"),
    )


def avg_balance_month(by_month: DataFrame, smb: DataFrame) -> DataFrame:
    return by_month.select("account_id", "fecha_saldo", "saldo").join(
        smb, "account_id", "left_semi"
    )


def month_end_balance(balance: DataFrame, smb: DataFrame) -> DataFrame:
    return month_end_rows(balance).join(smb, "account_id", "left_semi")


def merchant_balance_usd(
    by_month: DataFrame, balance: DataFrame, names: DataFrame, fx: DataFrame, currency: str
) -> DataFrame:
    """Both balances in USD, summed per merchant and month after a DISTINCT that does not
    see the account: equal balances of two accounts of one merchant count once.

    Only account-months with several month-end balances need the balance rows again, in an
    inner join, where AQE can split a hot one. `names` holds exactly the allow-listed
    accounts, so joining it is also the filter. The DISTINCT shuffles on all four columns
    and the sum is combined before its own shuffle: a merchant with very many accounts is
    spread over all tasks until it is a few rows.
    """
    keys = ["account_id", "fecha_saldo"]
    several = by_month.filter("several").select(*keys, "saldo")
    ends = month_end_rows(balance).select(*keys, F.col("saldo").alias("saldo_fin"))
    rates = monthly_fx(fx, currency).withColumnRenamed("fx_month", "fecha_saldo")
    return (
        by_month.filter(~F.col("several"))
        .select(*keys, "saldo", "saldo_fin")
        .unionByName(several.join(ends, keys))
        .join(by_key(names), "account_id")
        .join(rates, "fecha_saldo", "left")
        .select(
            "name_merchant",
            "fecha_saldo",
            to_usd("saldo").alias("saldo_promedio_mes"),
            to_usd("saldo_fin").alias("saldo_f_mes"),
        )
        .distinct()
        .groupBy("name_merchant", "fecha_saldo")
        .agg(
            F.sum("saldo_promedio_mes").alias("saldo_promedio_mes"),
            F.sum("saldo_f_mes").alias("saldo_f_mes"),
        )
    )


def active_with_balances(mobs: DataFrame, balances: DataFrame) -> DataFrame:
    """Active rows with the previous active month, the return flag and the balances."""
    usd = balances.select(
        F.col("name_merchant").alias("nombre_merchant"),
        F.col("fecha_saldo").alias("mes"),
        "saldo_promedio_mes",
        "saldo_f_mes",
    )
    return left_join_by_month(with_return_flag(mobs), usd)


def balance_columns() -> list[Column]:
    return [
        F.avg("saldo_promedio_mes").alias("saldo_promedio_mes_nombre"),
        F.avg("saldo_f_mes").alias("saldo_f_mes_nombre"),
        F.sum("saldo_promedio_mes").alias("saldo_promedio_mes_sum"),
        F.sum("saldo_f_mes").alias("saldo_f_mes_sum"),
    ]


def balances_by_month(active: DataFrame) -> DataFrame:
    return active.groupBy("mes").agg(*balance_columns())

"""Refunded fraud disputes per merchant and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlife.functions.columns import USD, by_key, left_join_by_month, left_join_hot_right, month, repeat_rows
from merchlife.sources.tables import monthly_fx, to_usd

FRAUD_KEYS = ("cuenta_id", "usuario_id", "transaccion_id", "orden_id")


def fraud_disputes(dispute: DataFrame) -> DataFrame:
    """(orden_id, number of refunded fraud disputes): one row per order."""
    return (
        dispute.filter((F.col("motivo") == "FRAUD") & (F.col("estado") == "REFUNDED"))
        .groupBy("orden_id")
        .agg(F.count(F.lit(1)).alias("_times"))
    )


def disputed_transactions(transaction: DataFrame, dispute: DataFrame) -> DataFrame:
    """Transactions of orders with a refunded fraud dispute, once per such dispute.

    The disputes go into the join as a count per order, so an order that holds a large
    part of either side never meets itself row by row in one task.
    """
    joined = transaction.join(fraud_disputes(dispute), "orden_id")
    return repeat_rows(joined, "_times").select("usuario_id", "transaccion_id", "orden_id")


def fraud_orders(dispute: DataFrame, order: DataFrame, smb: DataFrame) -> DataFrame:
    """(orden_id, cuenta_id, multiplicity) of the disputed orders of allow-listed accounts.

    The explicit shuffle between join and aggregation moves only disputed orders. Without
    it the aggregation would rely on the join's partitioning, and AQE could then not split
    a hot order.
    """
    return (
        order.join(by_key(fraud_disputes(dispute)), "orden_id")
        .repartition("orden_id", "cuenta_id")
        .groupBy("orden_id", "cuenta_id")
        .agg(F.sum("_times").alias("_times"))
        .join(by_key(smb.withColumnRenamed("account_id", "cuenta_id")), "cuenta_id", "left_semi")
    )


def disputed_only(transaction: DataFrame, orders: DataFrame) -> DataFrame:
    """The transactions of the disputed orders, by an inner join.

    A side of a checked size is broadcast and the transactions stay in place. Beyond that size,
    and with a scan of transactions that is large enough, Spark's runtime Bloom filter of the
    orders leaves most transactions out before their shuffle. It builds one from sides with a
    comparison only, which is why the multiplicity, always 1 or more, is compared.
    """
    return transaction.join(orders.filter("_times > 0"), "orden_id")


def fraud_transactions(transaction: DataFrame, orders: DataFrame) -> DataFrame:
    """Disputed transactions with the account of their order, once per dispute. Disputes
    and orders are joined first, so the transactions, by far the largest side, are joined
    once, and AQE can split a hot order of theirs."""
    return repeat_rows(disputed_only(transaction, orders), "_times").select(*FRAUD_KEYS)


def named_fraud(transaction: DataFrame, orders: DataFrame, names: DataFrame) -> DataFrame:
    """Disputed transactions without the repeats, with the merchant: the input of the
    DISTINCT amounts, where repeats do not count. The transactions meet the stored orders
    first, whose size is known: few orders are broadcast and the transactions stay in place."""
    disputed = disputed_only(transaction, orders)
    owners = names.withColumnRenamed("account_id", "cuenta_id")
    return disputed.join(owners, "cuenta_id").select("name_merchant", *FRAUD_KEYS)


def fraud_values(
    fraud: DataFrame, amounts: DataFrame, fx: DataFrame, currency: str
) -> DataFrame:
    """(transaction, month, USD value) of the fraud transactions, DISTINCT. The semi join
    keeps the other amounts out of every later shuffle; the explicit shuffle spreads the
    rows of a hot transaction, as in fraud_orders."""
    keys = ["transaccion_id", "fecha_creacion_nombre", "_value"]
    rates = monthly_fx(fx, currency).withColumnRenamed("fx_month", "fecha_creacion_nombre")
    return (
        amounts.join(fraud.select("transaccion_id").distinct(), "transaccion_id", "left_semi")
        .select(
            "transaccion_id",
            month("fecha_creacion").alias("fecha_creacion_nombre"),
            F.col("pm_purchase_value").alias("_value"),
        )
        .repartition(*keys)
        .distinct()
        .join(rates, "fecha_creacion_nombre", "left")
        .select(
            "transaccion_id",
            "fecha_creacion_nombre",
            to_usd("_value").alias("pm_purchase_value"),
        )
    )


def fraud_usd(fraud: DataFrame, values: DataFrame) -> DataFrame:
    """Fraud rows with merchant, month and purchase value in USD, DISTINCT."""
    return (
        left_join_hot_right(fraud, values, ["transaccion_id"])
        .select("name_merchant", *FRAUD_KEYS, "fecha_creacion_nombre", "pm_purchase_value")
        .distinct()
    )


def fraud_by_merchant_month(fraud: DataFrame) -> DataFrame:
    return fraud.groupBy("name_merchant", "fecha_creacion_nombre").agg(
        F.sum("pm_purchase_value").alias("monto_fraude"),
        F.count(F.lit(1)).alias("cantidad_fraude"),
    )


def fraud_by_month(by_merchant: DataFrame) -> DataFrame:
    return by_merchant.groupBy("fecha_creacion_nombre").agg(
        F.sum("cantidad_fraude").alias("cantidad_fraud"),
        F.sum("monto_fraude").alias("monto_fraude"),
    )


def active_with_fraud(active: DataFrame, by_merchant: DataFrame) -> DataFrame:
    found = by_merchant.select(
        F.col("name_merchant").alias("nombre_merchant"),
        F.col("fecha_creacion_nombre").alias("mes"),
        "monto_fraude",
        "cantidad_fraude",
    )
    return left_join_by_month(active, found).withColumns(
        {
            "monto_fraude": F.coalesce("monto_fraude", F.lit(0).cast(USD)),
            "cantidad_fraude": F.coalesce("cantidad_fraude", F.lit(0).cast("long")),
        }
    )

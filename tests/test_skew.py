"""One key holds a third of the rows: results stay whole and the work is split."""

from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from merchlife.operators import attributes as AT
from merchlife.operators import balances as B
from merchlife.operators import fraud as FR

N = 30_000

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def strict(spark):
    """No broadcasts, and thresholds at which the small test tables count as skewed."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot(n: int = N):
    """Keys 1..n of which every third is 0."""
    return F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))


def test_hot_order_among_the_transactions(strict, rows):
    # Several input partitions: AQE splits a skewed partition at the map outputs.
    tx = strict.range(0, N, 1, 8).select(
        (F.col("id") % 7).alias("usuario_id"), F.col("id").alias("transaccion_id"), hot().alias("orden_id")
    )
    dispute = strict.createDataFrame(
        [(0, "FRAUD", "REFUNDED")] * 3 + [(1, "FRAUD", "REFUNDED"), (4, "SERVICE", "REFUNDED")],
        "orden_id long, motivo string, estado string",
    )
    order = strict.createDataFrame([(0, "7"), (1, "8"), (4, "7")], "orden_id long, cuenta_id string")
    smb = strict.createDataFrame([("7",), ("8",)], "account_id string")
    out = FR.fraud_transactions(tx, FR.fraud_orders(dispute, order, smb))
    found = Counter(r["cuenta_id"] for r in out.select("cuenta_id").collect())
    assert found == {"7": 3 * (N // 3), "8": 1}
    assert out.select("transaccion_id").distinct().count() == N // 3 + 1
    assert "skew=true" in final_plan(tx.join(FR.fraud_orders(dispute, order, smb), "orden_id"))


def test_hot_order_among_the_orders(strict):
    order = strict.range(0, N, 1, 8).select(
        hot().alias("orden_id"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("cuenta_id")
    )
    dispute = strict.range(0, N, 1, 8).select(
        F.col("id").alias("orden_id"), F.lit("FRAUD").alias("motivo"), F.lit("REFUNDED").alias("estado")
    )
    smb = order.select(F.col("cuenta_id").alias("account_id"))
    out = FR.fraud_orders(dispute, order, smb)
    assert out.count() == N
    assert out.filter("orden_id = 0").count() == N // 3
    assert "skew=true" in final_plan(out)


def test_hot_account_month_among_the_balances(strict):
    """A third of all balances is one account's on one month end, all different."""
    end = datetime(2020, 1, 31, 12)
    balance = strict.range(0, N, 1, 8).select(
        hot().cast("string").alias("cuenta_id"),
        F.lit(end).alias("fecha_creacion"),
        (F.col("id") * 4).cast("double").alias("saldo"),
    )
    names = balance.select(
        F.col("cuenta_id").alias("account_id"), F.concat(F.lit("m"), "cuenta_id").alias("name_merchant")
    ).distinct()
    fx = strict.createDataFrame([(2020, 1, "COP", Decimal(4))], "year int, month int, currency string, usd decimal(20,3)")
    averages = B.account_month_balance(balance)
    out = B.merchant_balance_usd(averages, balance, names, fx, "COP")
    found = {r[0]: (r[2], r[3]) for r in out.filter("name_merchant in ('m0', 'm7')").collect()}
    ids = range(0, N, 3)
    mean = Decimal(sum(ids)) / len(ids)
    assert found["m7"] == (7, 7)
    assert found["m0"] == (mean * len(ids), sum(ids))
    assert out.count() == N - len(ids) + 1
    assert "skew=true" in final_plan(out)


def test_merchant_with_a_third_of_the_accounts(strict):
    """The largest account is found from one row per task and merchant."""
    clients = strict.range(0, N, 1, 8).select(
        F.col("id").cast("string").alias("account_id"),
        F.lit("x").alias("name_merchant"),
        F.lit(date(2020, 1, 1)).alias("month"),
        F.lit("SMB").alias("group"),
        F.lit("CO").alias("country_account"),
        F.lit(0.0).alias("gm_usd"),
        F.col("id").cast("double").alias("tpt"),
        F.lit(0.0).alias("tpv_usd"),
        F.lit(0.0).alias("revenue_usd"),
    )
    names = strict.range(0, N, 1, 8).select(
        F.col("id").cast("string").alias("account_id"), hot().cast("string").alias("name_merchant")
    )
    out = AT.top_account_per_merchant(clients, names)
    assert out.count() == N - N // 3 + 1
    assert out.filter("nombre_merchant = '0'").first()["account_id"] == str(N - 3)
    assert final_plan(out).count("WindowGroupLimit") >= 2


def test_charge_group_with_a_third_of_the_accounts(strict):
    account = strict.range(0, N, 1, 8).select(
        F.col("id").cast("string").alias("cuenta_id"), hot().cast("int").alias("grupo_perfil_cobranza_id")
    )
    fees = strict.createDataFrame(
        [(0, Decimal(1), Decimal(2), "VISA"), (0, Decimal(3), Decimal(4), "PSE"), (N + 1, Decimal(5), Decimal(6), "PSE")],
        "grupo_perfil_cobranza_id int, comision_plana_comercio decimal(14,2), "
        "comision_porcentual_comercio decimal(14,2), tipo_medio_pago string",
    )
    out = AT.account_fees(fees, account)
    assert out.count() == 2 * (N // 3) + 1
    assert "skew=true" in final_plan(out)

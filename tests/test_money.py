from datetime import date, datetime
from decimal import Decimal

from merchlife.operators import balances as B
from merchlife.operators import fraud as FR
from merchlife.sources.tables import account_names, smb_accounts


def ts(y, m, dom, hour=12):
    return datetime(y, m, dom, hour)


def accounts(table, spark, ids, names=None, excluded=()):
    smb = smb_accounts(table("allow_list", [(i,) for i in ids] * 2), excluded)
    account = table("account", [(i, f"own {i}", *[None] * 8) for i in ids])
    return smb, account_names(smb, table("name_map", names or []), account)


def test_names_fall_back_and_exclude(table, spark, rows):
    smb, names = accounts(table, spark, ["7", "8", "1"], [("7", "mapped"), ("99", "x")], ("1",))
    assert rows(smb) == [("7",), ("8",)]
    assert rows(names) == [("7", "mapped"), ("8", "own 8")]


def test_month_end_in_a_leap_year(table, spark, rows):
    smb, _ = accounts(table, spark, ["7"])
    balance = table(
        "balance",
        [("7", ts(2020, 2, 28), 1.0), ("7", ts(2020, 2, 29), 2.0), ("7", ts(2021, 2, 28), 3.0)],
    )
    out = B.month_end_balance(balance, smb)
    assert rows(out, "fecha_saldo", "saldo") == [(date(2020, 2, 1), 2.0), (date(2021, 2, 1), 3.0)]


def balances_usd(table, names, data, rates):
    balance = table("balance", data)
    return B.merchant_balance_usd(
        B.account_month_balance(balance), balance, names, table("fx", rates), "COP"
    )


RATES = [(2020, 1, "COP", Decimal(4)), (2020, 1, "MXN", Decimal(17))]


def test_equal_balances_of_two_accounts_count_once(table, spark, rows):
    _, names = accounts(table, spark, ["7", "8", "9"], [("7", "m"), ("8", "m"), ("9", "m")])
    data = [("7", ts(2020, 1, 31), 8.0), ("8", ts(2020, 1, 31), 8.0), ("9", ts(2020, 1, 31), 4.0)]
    out = balances_usd(table, names, data, RATES)
    assert rows(out) == [("m", date(2020, 1, 1), Decimal("3.000000000000000000"), Decimal("3.000000000000000000"))]


def test_missing_rate_and_missing_month_end(table, spark, rows):
    _, names = accounts(table, spark, ["7"])
    data = [("7", ts(2020, 1, 5), 8.0), ("7", ts(2020, 3, 31), 8.0)]
    out = {r[1].month: (r[2], r[3]) for r in balances_usd(table, names, data, RATES).collect()}
    assert out == {1: (Decimal(2), None), 3: (None, None)}


def test_several_month_end_rows_fan_out(table, spark):
    _, names = accounts(table, spark, ["7"])
    data = [("7", ts(2020, 1, 31, 1), 4.0), ("7", ts(2020, 1, 31, 2), 8.0), ("7", ts(2020, 1, 31, 3), 8.0)]
    (row,) = balances_usd(table, names, data, RATES).collect()
    average = Decimal("1.666750000000000000")  # 6.667 / 4, once per different month-end balance
    assert (row[2], row[3]) == (2 * average, Decimal(3))


def test_month_end_with_and_without_a_value(table, spark):
    """A NULL month-end balance is a row of its own, which counts the average again."""
    _, names = accounts(table, spark, ["7", "8"])
    data = [
        ("7", ts(2020, 1, 31, 1), None), ("7", ts(2020, 1, 31, 2), 8.0),
        ("8", ts(2020, 1, 31, 1), None), ("8", ts(2020, 1, 2), 12.0),
    ]
    out = {r[0]: (r[2], r[3]) for r in balances_usd(table, names, data, RATES).collect()}
    assert out == {"own 7": (Decimal(4), Decimal(2)), "own 8": (Decimal(3), None)}


def fraud_inputs(table, spark, disputes, orders, transactions):
    smb, names = accounts(table, spark, ["7", "8"], [("7", "m"), ("8", "m")])
    return smb, names, table("dispute", disputes), table("order", orders), table("transaction", transactions)


def test_fraud_rows_repeat_per_dispute_and_dedup_later(table, spark, rows):
    smb, names, dispute, order, tx = fraud_inputs(
        table,
        spark,
        [(1, "FRAUD", "REFUNDED"), (1, "FRAUD", "REFUNDED"), (2, "FRAUD", "OPEN"), (3, "OTHER", "REFUNDED")],
        [(1, "7"), (1, "8"), (2, "7"), (3, "7")],
        [(5, 100, 1), (5, 101, 1), (5, 102, 2), (5, 103, 3)],
    )
    assert FR.disputed_transactions(tx, dispute).count() == 4
    orders = FR.fraud_orders(dispute, order, smb)
    assert FR.fraud_transactions(tx, orders).count() == 8
    named = FR.named_fraud(tx, orders, names)
    amounts = table("transaction_amount", [(100, ts(2020, 1, 9), 10.0), (100, ts(2020, 1, 9), 10.0)])
    usd = FR.fraud_usd(named, FR.fraud_values(named, amounts, table("fx", RATES), "COP"))
    assert rows(usd, "cuenta_id", "transaccion_id", "pm_purchase_value") == [
        ("7", 100, Decimal("2.500000000000000000")),
        ("7", 101, None),
        ("8", 100, Decimal("2.500000000000000000")),
        ("8", 101, None),
    ]
    by_merchant = FR.fraud_by_merchant_month(usd)
    assert rows(by_merchant, "fecha_creacion_nombre", "monto_fraude", "cantidad_fraude") == [
        (None, None, 2),
        (date(2020, 1, 1), Decimal("5.000000000000000000"), 2),
    ]


def test_amounts_without_a_rate_collapse(table, spark):
    """Different amounts of one transaction are one row when their month has no rate."""
    smb, names, dispute, order, tx = fraud_inputs(
        table, spark, [(1, "FRAUD", "REFUNDED")], [(1, "7")], [(5, 100, 1)]
    )
    named = FR.named_fraud(tx, FR.fraud_orders(dispute, order, smb), names)
    amounts = table("transaction_amount", [(100, ts(2020, 9, 1), 1.0), (100, ts(2020, 9, 2), 2.0)])
    usd = FR.fraud_usd(named, FR.fraud_values(named, amounts, table("fx", RATES), "COP"))
    assert [r["pm_purchase_value"] for r in usd.collect()] == [None]


def test_fraud_totals_agree(small):
    from pyspark.sql import functions as F

    merchant = small.fraud_by_merchant_month().agg(F.sum("monto_fraude"), F.sum("cantidad_fraude"))
    month = small.fraud_by_month().agg(F.sum("monto_fraude"), F.sum("cantidad_fraud"))
    assert tuple(merchant.first()) == tuple(month.first())

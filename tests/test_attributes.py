from dataclasses import replace
from datetime import date
from decimal import Decimal

from merchlife.functions.columns import FEES
from merchlife.operators import attributes as AT
from merchlife.operators import lifecycle as L


def client(account, tpt):
    return (account, "any", date(2020, 1, 1), "SMB", "CO", 0.0, tpt, 0.0, 0.0)


def names_of(spark, pairs):
    return spark.createDataFrame(pairs, "account_id string, name_merchant string")


def account(cuenta, group, mcc="1", referred=None, city="Cali"):
    return (cuenta, "own", 1, date(2020, 3, 9), mcc, "AGGREGATOR", "OB1", referred, city, group)


def test_top_account_ties_and_nulls(table, spark, rows):
    clients = [
        client("1", 5.0), client("2", 7.0), client("2", 1.0),  # larger total wins
        client("3", 4.0), client("4", 4.0),  # tie: smallest id
        client("5", 9.0), client("6", None),  # NULL total sorts first
        client("7", 1.0),  # no name
    ]
    pairs = [("1", "a"), ("2", "a"), ("3", "b"), ("4", "b"), ("5", "c"), ("6", "c"), ("7", None)]
    out = AT.top_account_per_merchant(table("client_base", clients), names_of(spark, pairs))
    assert rows(out) == [("a", "2", 8.0), ("b", "3", 4.0), ("c", "6", None)]


def fees(table):
    fee = table("fee", [(i, Decimal(i), Decimal(i) / 10) for i in range(1, 8)])
    profile = table(
        "charge_profile",
        [
            (1, 10, "VISA"), (2, 10, "VISA"), (3, 10, "PSE"), (4, 10, "PSE"),
            (5, 20, "EFECTY"), (6, 10, "CASH"), (7, 30, "VISA"),
        ],
    )
    return AT.group_fees(fee, profile)


def test_account_fees_keep_groups_without_accounts(table, rows):
    out = AT.account_fees(fees(table), table("account", [account("a", 10), account("b", 20), account("c", 99)]))
    assert rows(out, "cuenta_id", "comision_plana_comercio") == [
        ("a", Decimal("1.00")), ("a", Decimal("2.00")), ("a", Decimal("3.00")),
        ("a", Decimal("4.00")), ("b", Decimal("5.00")), (None, Decimal("7.00")),
    ]


def test_several_fees_per_method_multiply_rows(table, spark):
    profiles = AT.merchant_profiles(
        spark.createDataFrame([("m", "a", 1.0), ("n", "b", 1.0), ("o", "zz", 1.0)],
                              "nombre_merchant string, account_id string, tpt_total double"),
        table("account", [account("a", 10), account("b", 20)]),
    )
    given = fees(table)
    by_merchant = AT.merchant_fees(profiles, given, AT.fee_columns(given, "grupo_perfil_cobranza_id"))
    found = {tuple(r[c] for c in ("nombre_merchant", "plana_visa", "plana_pse", "plana_efecty"))
             for r in by_merchant.collect()}
    assert found == {
        ("m", Decimal(1), Decimal(3), None), ("m", Decimal(1), Decimal(4), None),
        ("m", Decimal(2), Decimal(3), None), ("m", Decimal(2), Decimal(4), None),
        ("n", None, None, Decimal(5)),
    }


def test_rows_of_an_account_are_distinct_after_each_join(table, spark, rows):
    """An account with two different rows, one of them repeated: the MCC and the other attributes
    come from joins of their own, the fees of its groups combine, and nothing is repeated."""
    one = ("a", "o", 1, None, "9", "AGGREGATOR", "OB1", None, "cali", 10)
    two = ("a", "o", 1, None, "8", "GATEWAY", "OB1", "r", None, 20)
    top = spark.createDataFrame([("m", "a", 1.0)], "nombre_merchant string, account_id string, tpt_total double")
    profiles = AT.merchant_profiles(top, table("account", [one, two, two, one]))
    merchants = spark.createDataFrame([("m", date(2020, 6, 1)), ("x", date(2020, 6, 1))], "nombre_merchant string, mes date")
    assert rows(AT.attach_mcc(merchants, profiles), "codigo_mcc_id") == [("8",), ("9",), (None,)]
    active = AT.attach_active_profile(merchants, profiles)
    assert active.columns == ["nombre_merchant", "mes", "codigo_mcc_id", "modelo_pagos", "fuente_creacion", "referido_cuenta_linea", "ciudad"]
    assert rows(active, "codigo_mcc_id", "modelo_pagos", "referido_cuenta_linea", "ciudad") == [
        ("8", "AGGREGATOR", "No", "cali"), ("8", "GATEWAY", "Yes", None),
        ("9", "AGGREGATOR", "No", "cali"), ("9", "GATEWAY", "Yes", None),
        (None, None, None, None),
    ]
    churn = AT.attach_churn_profile(merchants, profiles)
    assert rows(churn, "codigo_mcc_id", "referido_cuenta_linea") == [("8", "r"), ("9", None), (None, None)]
    given = fees(table)
    found = AT.merchant_fees(profiles, given, AT.fee_columns(given, "grupo_perfil_cobranza_id"))
    assert found.count() == found.distinct().count() == 4
    assert {tuple(r)[1::2] for r in found.collect()} == {(Decimal(v), None, Decimal(p), Decimal(5)) for v in (1, 2) for p in (3, 4)}


def test_fees_only_in_the_snapshot_month(spark, params):
    merchants = spark.createDataFrame(
        [("m", date(2020, 6, 1)), ("m", date(2020, 7, 1)), ("x", date(2020, 6, 1))],
        "nombre_merchant string, mes date",
    )
    fee = spark.createDataFrame([("m", *[1.0] * 8)], "nombre_merchant string, " + ", ".join(f"{c} double" for c in FEES))
    out = {(r[0], r[1].month): r["plana_visa"] for r in AT.attach_fees(merchants, fee, params).collect()}
    assert out == {("m", 6): 1.0, ("m", 7): None, ("x", 6): None}
    every = {(r[0], r[1].month): r["plana_visa"] for r in AT.attach_fees(merchants, fee).collect()}
    assert every == {("m", 6): 1.0, ("m", 7): 1.0, ("x", 6): None}


def test_created_month_is_the_earliest_per_attributes(table, spark, rows):
    accounts = table("account", [
        ("1", "o", 1, date(2020, 5, 9), "9", "AGGREGATOR", "OB1", "r", "cali", 10),
        ("2", "o", 1, date(2020, 3, 31), "9", "AGGREGATOR", "OB1", "x", "cali", 10),
        ("3", "o", 1, date(2020, 1, 1), "8", "AGGREGATOR", "OB1", None, "cali", 10),
    ])
    dim = AT.account_dimension(accounts, names_of(spark, [("1", "m"), ("2", "m"), ("3", "m")]))
    none = spark.createDataFrame([], "nombre_merchant string, " + ", ".join(f"{c} decimal(14,2)" for c in FEES))
    out = AT.created_by_month_attributes(dim, none)
    assert rows(out, "mes", "codigo_mcc_id", "referidot", "city") == [
        (date(2020, 1, 1), "8", "No", "Cali"), (date(2020, 3, 1), "9", "Yes", "Cali"),
    ]


def test_segment_priority_and_default(table, spark, rows):
    merchants = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "nombre_merchant string")
    segment = table("segment", [("a", "gerenciado", 2), ("a", "ex_vip", 1), ("b", "gerenciado", 2)])
    out = L.management_segment(merchants, segment)
    assert rows(out) == [("a", "ex_vip"), ("b", "gerenciado"), ("c", "masivo"), (None, "masivo")]


def test_signups(table, rows):
    data = [
        ("a@x", "2024-01-31 23:59:59", "5", None),
        ("a@x", "2024-01-02 10:00:00", "5", None),
        ("b@x", "2024-01-02 10:00:00", "5", "77"),
        ("c@x", "not a date", None, None),
    ]
    out = L.signups(table("signup", data))
    assert rows(out, "nombre_merchant", "mes", "codigo_mcc_id", "fuente_creacion", "estado_") == [
        ("a@x", date(2024, 1, 1), "5", "OB2", "sign_up"),
        ("c@x", None, None, "OB2", "sign_up"),
    ]
    assert out.columns == list(L.LIFECYCLE_SCHEMA)


def test_union_arms_share_one_schema_and_stay_distinct(small):
    def types(df):
        return [(f.name, f.dataType.simpleString().replace("bigint", "long")) for f in df.schema]

    expected = list(L.STATE_SCHEMA.items())
    for arm in (small.active_state(), small.churn_state(), small.created_state()):
        assert types(arm) == expected
        assert arm.count() == arm.distinct().count()
    assert types(small.union_signups()) == list(L.LIFECYCLE_SCHEMA.items())
    union = small.union_signups()
    assert union.count() == union.distinct().count()


def test_referred_quirks(spark):
    from merchlife import Params

    churned = spark.createDataFrame(
        [("a", date(2020, 1, 1), 6, "SMB", "r"), ("b", date(2020, 1, 1), 6, "SMB", None)],
        "nombre_merchant string, mes date, inactividad long, `group` string, referido_cuenta_linea string",
    )
    for quirks, expected in ((False, {"a": "Yes", "b": "No"}), (True, {"a": "No", "b": "Yes"})):
        out = L.align_churn(churned, Params(as_of=date(2021, 1, 1), reference_quirks=quirks))
        assert {r["nombre_merchant"]: r["referido_cuenta_linea"] for r in out.collect()} == expected


def test_dashboard_totals_equal_the_union(small):
    from pyspark.sql import functions as F

    union, dash = small.union_signups(), small.segment_dashboard()
    states = {r["estado_"]: r["count"] for r in union.groupBy("estado_").count().collect()}
    totals = dash.agg(*(F.sum(c).alias(c) for c in ("registros", "churn_numero", "creados_numero", "signups"))).first()
    assert tuple(totals) == tuple(states[s] for s in ("Activos", "Churn", "Creada", "sign_up"))
    assert dash.agg(F.sum("monto_fraude_sum")).first() == union.agg(F.sum("monto_fraude")).first()


def test_activation_curve_ends_at_the_cohort_total(small):
    from pyspark.sql import functions as F

    per = small.activation_curve().groupBy("fecha_creacion").agg(
        F.sum("activas_mes_mob").alias("a"), F.max("cumulative_sum").alias("b")
    )
    assert per.filter("a <> b").count() == 0


def test_each_activated_row_flags_the_created_one(spark, rows):
    created = spark.createDataFrame([("a", date(2020, 1, 1)), ("b", date(2020, 1, 1))], "nombre_merchant string, mes date")
    active = spark.createDataFrame(
        [("a", date(2020, 1, 1), "activa_mes_creada")] * 2 + [("b", date(2020, 1, 1), None)],
        "nombre_merchant string, mes date, created_activated string",
    )
    out = rows(L.flag_activated(created, active), "nombre_merchant", "flag")
    assert out == [("a", 1), ("a", 1), ("b", None)]


def test_the_state_schema_holds_every_active_column(small):
    """So that aligning distinct rows leaves them distinct."""
    assert set(small.active_fees().columns) <= set(L.ACTIVITY_SCHEMA)
    assert set(small.churn_fees().columns) - {"group"} <= set(L.ACTIVITY_SCHEMA)


def test_changes_named_twice_do_not_count_twice(small):
    from merchlife import MerchantPipeline
    from merchlife.sources.stages import StageStore

    twice = MerchantPipeline(small.spark, replace(small.src, up_down=small.src.up_down.union(small.src.up_down)), small.p, StageStore(small.spark))
    twice._built |= {n: small._built[n] for n in small._built if n in ("active_fees", "merchant_profiles", "merchant_fees", "names", "activity_distance")}
    assert twice.lifecycle_rows().count() > small.lifecycle_rows().count()
    assert twice.union_signups().count() == small.union_signups().count()
    total = lambda run: run.segment_dashboard().agg({"registros": "sum"}).first()[0]
    assert total(twice) == total(small)


def test_rows_that_differ_in_null_and_zero_are_one(small):
    from merchlife import MerchantPipeline
    from merchlife.sources.stages import StageStore

    twin = MerchantPipeline(small.spark, small.src, small.p, StageStore(small.spark))
    rows = small.active_with_fraud()
    twin._built |= {"active_with_fraud": rows.union(rows), "merchant_profiles": small.merchant_profiles()}
    assert twin.active_attributes().count() == small.active_attributes().count()


def test_churn_counts_each_score_of_a_month(small):
    from merchlife import MerchantPipeline
    from merchlife.sources.stages import StageStore

    scores = small.rfm_scores()
    twice = MerchantPipeline(small.spark, small.src, small.p, StageStore(small.spark))
    twice._built |= {"rfm_scores": scores.union(scores), "churn_fees": small.churn_fees()}
    total = lambda run: run.churn_by_attributes().agg({"cantidad_churn": "sum"}).first()[0]
    assert total(twice) == twice.churn_rfm().count() >= total(small)

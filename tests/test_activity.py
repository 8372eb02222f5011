import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from merchlife.functions.columns import METHODS
from merchlife.operators import activity as A
from merchlife.operators import cohorts as K
from merchlife.params import shift_month


def d(month, year=2020, dom=1):
    return date(year, month, dom)


def billing(account, when, method="PSE", created=date(2019, 1, 1), name=None, country="CO"):
    return (account, name or f"own {account}", when, method, created, country)


def client(account, when, name="M", group="SMB", tpt=1.0, tpv=10.0, country="CO"):
    return (account, name, when, group, country, tpv / 100, tpt, tpv, tpv / 10)


def base_of(table, p, facts, clients):
    agg, cb = table("agg_monthly", facts, country=True), table("client_base", clients)
    return A.merchant_month_base(
        A.payment_method_flags(agg, cb, p), A.merchant_month_financials(cb, p)
    )


def loop_reference(base_rows, p, keep):
    """Month by month, as the procedures do it."""
    out = set()
    x = p.first_month
    for _ in range(p.horizon):
        end = date(x.year + x.month // 12, x.month % 12 + 1, 1)
        last = {}
        for r in base_rows:
            if (
                r["billing_date_monthly"] <= x
                and (r["tpv_usd"] or 0) > 0
                and (r["tpt"] or 0) > 0
                and r["account_create_date"] is not None
                and r["account_create_date"] < end
            ):
                key = (r["name_merchant_"], r["group"])
                last[key] = max(last.get(key, date.min), r["billing_date_monthly"])
        for (name, group), m in last.items():
            gap = (x.year - m.year) * 12 + x.month - m.month
            if keep(gap):
                out.add((name, x, gap, group))
        x = end
    return out


def test_flags_fallback_and_months(table, params, rows):
    facts = [
        billing("1", d(1), "PSE"),
        billing("1", d(1), "ACH"),
        billing("1", d(1), "UNKNOWN"),
        billing("2", d(1), "CASH", name="second"),
        billing("3", d(1), "CASH", country="XX"),
    ]
    clients = [client("1", d(1, dom=31))]
    out = A.payment_method_flags(
        table("agg_monthly", facts, country=True), table("client_base", clients), params
    )
    found = {r["name_merchant_"]: r for r in out.collect()}
    assert set(found) == {"M", "second"}
    assert [m for m in METHODS if found["M"][m]] == ["pse", "ach"]
    assert found["M"]["group"] == "SMB" and found["second"]["group"] is None


def test_country_on_the_client_base_only(table, params, rows):
    """Without the column on the billing side the filter drops unmatched billing rows."""
    facts = [billing("1", d(1))[:5], billing("2", d(1))[:5], billing("3", d(1))[:5]]
    clients = [client("1", d(1)), client("3", d(1), name="N", country="XX")]
    out = A.payment_method_flags(
        table("agg_monthly", facts), table("client_base", clients), params
    )
    assert rows(out, "name_merchant_") == [("M",)]


def test_null_merchant_names_form_one_group_and_never_join(table, params, rows):
    facts = [("1", None, d(1), "PSE", d(1, 2019), "CO"), ("2", None, d(1), "ACH", d(1, 2019), "CO")]
    clients = [client("1", d(1), name=None), client("2", d(1), name=None)]
    out = base_of(table, params, facts, clients).collect()
    assert len(out) == 1
    assert out[0]["name_merchant_"] is None and out[0]["pse"] == 1 and out[0]["ach"] == 1
    assert out[0]["tpt"] is None


def test_activity_equals_the_loop(table, params):
    facts, clients = [], []
    plan = {"a": [1, 2, 9], "b": [3], "c": [5, 12], "e": [1, 7]}
    for i, (name, months) in enumerate(plan.items()):
        for m in months:
            facts.append(billing(str(i), d(m, 2019)))
            clients.append(client(str(i), d(m, 2019), name=name))
    # A later creation date, two groups of one merchant, a month without volume, old facts.
    facts.append(billing("8", d(2, 2020), created=d(4, 2020, 20)))
    clients.append(client("8", d(2, 2020), name="late"))
    facts += [billing("9", d(1, 2020)), billing("10", d(3, 2020))]
    clients += [
        client("9", d(1, 2020), name="two"),
        client("10", d(3, 2020), name="two", group="Corporate"),
    ]
    facts += [billing("11", d(6, 2020)), billing("12", d(1, 2015))]
    clients += [client("11", d(6, 2020), name="zero", tpv=0.0), client("12", d(1, 2015), name="old")]
    base = base_of(table, params, facts, clients)
    source = base.collect()
    distance = A.activity_distance(base, params)
    active = {tuple(r) for r in A.active_merchants(distance, params).collect()}
    churn = {tuple(r) for r in A.churn_events(distance, params).collect()}
    assert active == loop_reference(source, params, lambda gap: gap < 6)
    assert churn == loop_reference(source, params, lambda gap: gap == 6)
    assert not {(n, m, g) for n, m, _, g in active} & {(n, m, g) for n, m, _, g in churn}


@pytest.mark.parametrize("seed", range(3))
def test_random_histories_equal_the_loop(spark, params, seed):
    rng = random.Random(seed)
    data = []
    for merchant in range(60):
        for _ in range(rng.randint(1, 12)):
            month = shift_month(params.as_of, -rng.randint(-2, 60))
            created = month.replace(day=rng.randint(1, 28))
            if rng.random() < 0.3:  # created after some of its billing
                created = shift_month(created, rng.randint(0, 8)).replace(day=rng.randint(1, 28))
            billed = month if rng.random() < 0.8 else month.replace(day=rng.randint(2, 28))
            group = rng.choice(["SMB", "Partnership", "Corporate", None])
            data.append((
                None if merchant == 0 else f"m{merchant}", billed, group,
                None if rng.random() < 0.05 else created,
                rng.choice([0.0, 1.0, 2.0, None]), rng.choice([0.0, 5.0, 5.0]),
            ))
    base = spark.createDataFrame(
        data, "name_merchant_ string, billing_date_monthly date, `group` string, "
        "account_create_date date, tpt double, tpv_usd double",
    )
    source = base.collect()
    found = {tuple(r) for r in A.activity_distance(base, params).collect()}
    assert found == loop_reference(source, params, lambda gap: gap <= 6)


def test_billing_inside_a_month_counts_from_the_next(table, params):
    base = base_of(table, params, [billing("1", d(3, dom=15))], [client("1", d(3))])
    months = [r["mes"] for r in A.activity_distance(base, params).orderBy("mes").collect()]
    assert months[0] == d(4) and len(months) == 6


def test_method_count_is_null_without_billing_and_measures_zero(table, params):
    base = base_of(table, params, [billing("1", d(1))], [client("1", d(1))])
    active = A.active_merchants(A.activity_distance(base, params), params)
    usage = A.active_payment_usage(active, base, params)
    out = A.active_null_to_zero(A.active_dedup(A.method_count_inactive(usage, params)))
    found = {r["mes"]: r for r in out.collect()}
    assert len(found) == 6
    assert found[d(1)]["suma_de_metodos"] == 1 and found[d(1)]["inactivo"] == 0
    assert found[d(5)]["suma_de_metodos"] is None and found[d(5)]["tpv_usd"] == 0.0
    assert found[d(3)]["inactivo"] == 0 and found[d(4)]["inactivo"] == 1


def test_two_groups_carry_the_same_totals(table, params):
    """Sums ignore the group, and rows equal but for the group collapse."""
    facts = [billing("1", d(1), "PSE"), billing("2", d(1), "PSE")]
    clients = [client("1", d(1)), client("2", d(1), group="Partnership")]
    base = base_of(table, params, facts, clients)
    assert [r["tpv_usd"] for r in base.collect()] == [20.0, 20.0]
    active = A.active_merchants(A.activity_distance(base, params), params)
    usage = A.active_payment_usage(active, base, params)
    january = usage.filter(F.col("mes") == d(1))
    assert january.count() == 4
    assert A.active_dedup(A.method_count_inactive(january, params)).count() == 1


def test_lifecycle_status(table, params, rows):
    names = {"now": d(11), "edge": d(9), "gone": d(6), "older": d(1)}
    facts = [billing(n, m) for n, m in names.items()]
    clients = [client(n, m, name=n) for n, m in names.items()]
    out = A.lifecycle_status(base_of(table, params, facts, clients), params)
    assert rows(out, "name_merchant", "inactividad", "status") == [
        ("edge", 3, "dormant"),
        ("gone", 6, "churner"),
        ("now", 1, "active"),
        ("older", 11, "churner"),
    ]


def mobs_of(table, params, facts, clients):
    base = base_of(table, params, facts, clients)
    active = A.active_merchants(A.activity_distance(base, params), params)
    usage = A.active_payment_usage(active, base, params)
    rows = A.active_null_to_zero(A.active_dedup(A.method_count_inactive(usage, params)))
    return K.months_on_book(rows, K.merchant_milestones(base, params))


def test_back_from_churn_after_a_gap(table, params, rows):
    facts = [billing("1", d(1, 2019)), billing("1", d(10, 2019)), billing("2", d(1, 2019))]
    clients = [client("1", d(1, 2019)), client("1", d(10, 2019)), client("2", d(1, 2019), name="N")]
    out = K.back_from_churn_by_month(mobs_of(table, params, facts, clients))
    assert rows(out) == [(d(10, 2019), "is back", 1)]


def test_second_row_of_a_month_counts_as_back(table, params, rows):
    facts = [billing("1", d(1), "PSE"), billing("2", d(1), "ACH")]
    clients = [client("1", d(1)), client("2", d(1), group="Corporate")]
    out = K.back_from_churn_by_month(mobs_of(table, params, facts, clients))
    assert rows(out) == [(d(1), "is back", 1)]


def test_null_merchants_have_no_previous_month(spark, rows):
    from merchlife.functions.columns import with_return_flag

    schema = "nombre_merchant string, mes date, inactividad long, " + ", ".join(
        f"{m} long" for m in METHODS
    )
    data = [(None, d(1), 0, *[0] * 10), (None, d(9), 0, *[0] * 10), ("a", d(1), 0, *[0] * 10)]
    out = with_return_flag(spark.createDataFrame(data, schema))
    assert out.filter("mes_anterior is not null or back_from_churn is not null").count() == 0


def test_created_and_activated_in_one_month(table, params, rows):
    facts = [
        billing("1", d(3), created=d(3, dom=20)),
        billing("2", d(3), created=d(2, dom=29)),
    ]
    clients = [client("1", d(3), name="same"), client("2", d(3), name="later")]
    mobs = mobs_of(table, params, facts, clients)
    assert rows(mobs.filter("created_activated is not null"), "nombre_merchant", "mes") == [
        ("same", d(3))
    ]
    later = mobs.filter("nombre_merchant = 'later'").orderBy("mes").first()
    assert (later["creacion_hasta_first_trx"], later["mob_first_trx"]) == (1, 0)
    assert later["mob_creacion_cuenta"] == 1


def test_payment_method_mix_shares(table, params):
    facts = [billing("1", d(1), "PSE"), billing("1", d(1), "PSE"), billing("1", d(2), "ACH")]
    clients = [client("1", d(1)), client("1", d(2))]
    out = A.payment_method_mix(
        table("agg_monthly", facts, country=True), table("client_base", clients), params
    )
    assert {r[1]: (r[2], round(r[3], 6)) for r in out.collect()} == {
        "PSE": (2, 0.666667),
        "ACH": (1, 0.333333),
    }

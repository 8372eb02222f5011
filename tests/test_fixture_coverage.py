"""The fixture holds the cases that FIXTURES.md counts."""

from pyspark.sql import functions as F


def test_counts(small):
    base = small.merchant_month_base()
    assert base.count() == 973
    assert base.filter("`group` is null").count() == 19
    assert base.filter("name_merchant_ not rlike '^M[0-9]+$'").count() == 114
    active = small.active_merchants().filter(F.col("group").isin(*small.p.groups))
    assert active.count() == 862
    assert active.filter("inactividad >= 3").count() == 248
    assert small.churn_events().count() == 69
    assert small.created_activated_by_month().agg(F.sum("primera_trx_mes_creacion")).first()[0] == 4
    assert small.activation_curve().count() == 34
    assert small.disputed_transactions().count() == 697
    assert small.signups().count() == 5
    assert small.top_account_per_merchant().count() == 89
    assert small.account_fees().filter("cuenta_id is not null").count() == 752


def test_null_cases_are_present(small):
    balances = small.merchant_balance_usd()
    assert balances.filter("saldo_promedio_mes is null").count() > 0
    rows = small.months_on_book()
    assert rows.filter("suma_de_metodos is null").count() > 0
    assert rows.groupBy("nombre_merchant", "mes").count().filter("count > 1").count() > 0
    cities = {r[0] for r in small.active_city().select("city").distinct().collect()}
    assert "Others" in cities and "Cali" in cities


def test_accounts_are_repeated_and_no_order_is_too_late(small):
    assert small.src.account.count() > small.src.account.distinct().count() > small.src.dim_account.count()
    profiles = small.merchant_profiles()
    assert profiles.count() == profiles.distinct().count() > profiles.select("nombre_merchant").distinct().count()
    assert small.active_attributes().count() > small.active_distinct().count()
    assert small.src.agg_monthly.filter(F.col("billing_date_monthly") > small.p.last_month).count() == 0

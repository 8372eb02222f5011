import random
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from merchlife.functions.columns import METHODS
from merchlife.operators import rfm as R


def brute_median(values):
    return sorted(values)[(len(values) + 1) // 2 - 1]


WAYS = pytest.mark.parametrize("way", [R.bracketed_medians, R.medians_by_digits, lambda df: R.bracketed_medians(df, 20)])


@WAYS
def test_monthly_medians_equal_sorting(spark, way):
    rng = random.Random(7)
    months = [date(2020, m, 1) for m in range(1, 6)]
    sizes = [1, 2, 7, 100, 1501]
    data = []
    for m, size in zip(months, sizes):
        for i in range(size):
            data.append((f"n{i}", m, rng.randint(0, 5), rng.randint(-3, 3) * 10**rng.randint(0, 14),
                         rng.choice([0, 5, rng.randint(-(2**62), 2**62)])))
    df = spark.createDataFrame(data, "nombre string, mes date, _recency long, _frequency long, _monetary long")
    found = {r["mes"]: tuple(r)[1:] for r in way(df).collect()}
    for m in months:
        mine = [r for r in data if r[1] == m]
        assert found[m] == tuple(brute_median([r[i] for r in mine]) for i in (2, 3, 4))


@WAYS
def test_hot_value_is_the_median(spark, way):
    data = [("n", date(2020, 1, 1), 1, 70000, v) for v in [5] * 700 + list(range(1000))]
    df = spark.createDataFrame(data, "nombre string, mes date, _recency long, _frequency long, _monetary long")
    row = way(df).first()
    assert tuple(row)[1:] == (1, 70000, brute_median([r[4] for r in data]))


def test_a_missed_median_is_told(spark):
    fine = spark.createDataFrame([(date(2020, 1, 1), 1, 2, 3)], "mes date, _median_recency long, _median_frequency long, _median_monetary long")
    assert not R.missed(fine)
    assert R.missed(fine.withColumn("_median_monetary", F.lit(None).cast("long")))


def test_medians_take_two_scans(spark, small):
    text = small.spark and R.bracketed_medians(small.rfm_values())._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") <= 3  # the bounds are read twice, by one exchange
    assert sorted(map(tuple, small.rfm_medians().collect())) == sorted(map(tuple, R.medians_by_digits(small.rfm_values()).collect()))


def financials(spark, data):
    return spark.createDataFrame(data, "name_merchant string, month date, tpt double, tpv_usd double")


def test_scores_over_the_window(spark, params):
    data = [
        ("a", date(2020, 1, 1), 2.0, 10.5), ("a", date(2020, 3, 1), 1.0, 4.0),
        ("b", date(2020, 3, 1), 5.0, 1.0), ("c", date(2020, 2, 1), 0.0, 0.0),
        (None, date(2020, 3, 1), 9.0, 9.0),
    ]
    values = R.rfm_values(financials(spark, data), params)
    out = {(r["nombre"], r["fecha_mes"].month): r for r in R.rfm_scores(values, params, R.bracketed_medians(values)).collect()}
    assert {k[0] for k in out} == {"a", "b"}
    a = out["a", 6]
    assert (a["recencia"], a["frecuencia_internet"], float(a["monto"])) == (3, 3, 14.5)
    a = out["a", 7]  # January has left the window of six months
    assert (a["recencia"], a["frecuencia_internet"], float(a["monto"])) == (4, 1, 4.0)
    assert ("a", 9) not in out
    # April: recencies 1 and 1, transactions 3 and 5, volumes 14.5 and 1; lower medians 1, 3, 1.
    assert out["a", 4]["rfm_group"] == out["b", 4]["rfm_group"] == "Champion"
    # January: one merchant, which is its own median. July: a has 1 transaction and 4 USD.
    assert out["a", 1]["rfm_group"] == "Champion"
    assert out["a", 7]["alt_baj_frecuencia"] == "Alta" and out["b", 7]["alt_baj_monto"] == "Alta"
    assert R.rfm_scores(values, params, R.bracketed_medians(values)).schema["monto"].dataType.simpleString() == "decimal(38,4)"


def test_fixed_thresholds(spark, params):
    values = R.rfm_values(financials(spark, [("a", date(2020, 1, 1), 2.0, 10.5)]), params)
    out = R.rfm_scores(values, replace(params, rfm_thresholds=(1, 3, 10.0)))
    labels = {r["fecha_mes"].month: r["rfm_group"] for r in out.collect()}
    assert labels == {1: "Big spender", 2: "Big spender", 3: "Cooling", 4: "Cooling", 5: "Cooling", 6: "Cooling"}


def test_migration_takes_the_previous_row_of_the_merchant(spark, params):
    extra = ", ".join(f"{c} long" for c in (*METHODS, *R.FEES, *R.ACCOUNT_KEYS, R.REFERRED, "ciudad"))
    zero = [0] * 23
    data = [("a", date(2020, m, 1), 0, "Activos", g, *zero) for m, g in ((1, "Low"), (2, "Loyal"), (5, "Low"))]
    data += [("b", date(2020, 2, 1), 0, "Activos", "Recent", *zero), ("a", date(2020, 3, 1), 6, "Churn", "x", *zero)]
    df = spark.createDataFrame(data, f"nombre_merchant string, mes date, inactividad long, estado_ string, rfm_group string, {extra}")
    out = R.rfm_migration(df, replace(params, rfm_start=date(2020, 1, 1)))
    found = {(r[0], r[1].month): r["last_rfm"] for r in out.select("nombre_merchant", "mes", "last_rfm").collect()}
    assert found == {("a", 1): None, ("a", 2): "Low", ("a", 5): "Loyal", ("b", 2): None}


def test_migration_matrix_is_dense(spark, params):
    p = replace(params, rfm_start=date(2020, 10, 1))  # the newest closed month is December
    moves = [(date(2020, 10, 1), None, "Low"), (date(2020, 10, 1), "Low", "Low"), (date(2020, 10, 1), "Low", "Loyal"), (date(2020, 10, 1), "Low", "Loyal"), (date(2020, 12, 1), "own", None)]
    out = R.migration_matrix(spark.createDataFrame(moves, "mes date, last_rfm string, rfm_group string"), spark, p).collect()
    cells = {(r["mes"].month, r["last_rfm"], r["rfm_group"]): (r["cantidad"], r["participacion"]) for r in out}
    assert len(out) == len(cells) == 3 * 9 * 9 + 1  # and the cell of a group that only the data has
    assert cells[10, "Low", "Loyal"] == (2, 2 / 3) and cells[10, "Low", "Champion"] == (0, 0.0)
    assert cells[10, R.UNSCORED, "Low"] == (1, 1.0) and cells[11, "Low", "Low"] == (0, None)
    assert cells[12, "own", R.UNSCORED] == (1, 1.0)


def test_a_given_rfm_table_is_used(spark, small, table):
    from merchlife import MerchantPipeline
    from merchlife.sources.fixture import FIXTURE_PARAMS

    given = table("rfm", [("M9", date(1997, 5, 20), 1, "Alta", 2, "Alta", None, "Baja", "given")])
    p = MerchantPipeline(spark, replace(small.src, rfm=given), FIXTURE_PARAMS)
    assert p.rfm_scores().select("rfm_group").first()[0] == "given"

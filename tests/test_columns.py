import random
from datetime import date
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import functions as F

from merchlife.functions import columns as C
from merchlife.sources.tables import (
    CONTRACTS,
    Sources,
    conform,
    to_usd,
    
    
)


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {v[1]}" for k, v in values.items())
    df = spark.createDataFrame([tuple(v[0] for v in values.values())], schema)
    return df.select(expr.alias("out")).first()["out"]


def test_month_diff_counts_boundaries(spark):
    def diff(a, b):
        return one(spark, C.month_diff("a", "b"), a=(a, "date"), b=(b, "date"))

    assert diff(date(2021, 1, 31), date(2021, 2, 1)) == 1
    assert diff(date(2021, 2, 1), date(2021, 2, 28)) == 0
    assert diff(date(2020, 12, 1), date(2021, 2, 1)) == 2
    assert diff(date(2021, 2, 1), date(2020, 12, 1)) == -2
    assert diff(date(2021, 2, 1), None) is None


def test_month_number(spark):
    assert one(spark, C.month_number("d"), d=(date(2021, 3, 9), "date")) == 202103


def test_city_groups(spark):
    expected = {
        "BOGOTA D.C.": "Bogotá and surroundings",
        "Bogotá": "Bogotá and surroundings",
        "MEDELLÍN": "Medellín and surroundings",
        "Santiago de Cali": "Cali",
        "Calima Darien": "Others",
        "Cali Norte": "Others",
        "CARTAGENA": "Cartagena",
        "envigado": "Medellín and surroundings",
        "ITAGUI": "Medellín and surroundings",
        "barranquilla": "Barranquilla",
        "Bucaramanga": "Bucaramanga",
        "CHÍA": "Bogotá and surroundings",
        "chia": "Bogotá and surroundings",
        "QUINCHIA": "Others",
        "Quinchia": "Bogotá and surroundings",
        "Pasto": "Others",
        None: "Others",
    }
    df = spark.createDataFrame([(c,) for c in expected], "ciudad string")
    found = {r[0]: r[1] for r in df.select("ciudad", C.city_group("ciudad")).collect()}
    assert found == expected


def test_exact_sum_ignores_row_order(spark):
    values = [0.1, 0.2, 0.3, 1e9, -1e9, 0.7] * 50
    up = spark.createDataFrame([(v,) for v in sorted(values)], "v double").repartition(7)
    down = spark.createDataFrame([(v,) for v in sorted(values, reverse=True)], "v double")
    sums = {df.agg(C.exact_sum("v")).first()[0] for df in (up, down)}
    assert sums == {65.0}


def test_small_addends_count_in_full(spark):
    df = spark.range(100_000).select(F.lit(0.00004).alias("v"))
    assert df.agg(C.exact_sum("v")).first()[0] == 4.0
    assert df.agg(C.exact_avg("v")).first()[0] == 0.00004


def test_exact_aggregates_of_nulls(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert tuple(df.agg(C.exact_sum("v"), C.exact_avg("v")).first()) == (None, None)
    df = spark.createDataFrame([(None,), (3.0,), (4.0,)], "v double")
    assert df.agg(C.exact_avg("v")).first()[0] == 3.5


def test_to_usd_type_and_zero_rate(spark):
    df = spark.createDataFrame([(10.0, Decimal("3.000")), (1.0, Decimal("0.000"))], "a double, usd decimal(20,3)")
    out = df.select(to_usd("a").alias("q"))
    assert out.schema["q"].dataType.simpleString() == "decimal(38,18)"
    assert [r.q for r in out.collect()] == [Decimal("3.333333333333333333"), None]


def test_repeat_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 25), ("c", 7)], "k string, n long")
    found = {r["k"]: r["count"] for r in C.repeat_rows(df, "n", chunk=7).groupBy("k").count().collect()}
    assert found == {"a": 1, "b": 25, "c": 7}


def test_left_join_hot_right_equals_left_join(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "k int, l string")
    right = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 7), (9, 1), (None, 5)], "k int, r int")
    assert rows(C.left_join_hot_right(left, right, ["k"])) == rows(left.join(right, ["k"], "left"))


def test_conform_casts_and_keeps_optional(spark):
    raw = spark.createDataFrame([(7, "n", date(2021, 1, 1), "PSE", date(2020, 1, 1), "CO", 1)],
        "account_id int, account_name string, billing_date_monthly date, "
        "payment_method_type string, account_create_date date, country_account string, other int")
    df = conform(raw, CONTRACTS["agg_monthly"], "country_account string")
    assert df.columns[-1] == "country_account" and "other" not in df.columns
    assert df.first()["account_id"] == "7"
    bare = conform(raw.drop("country_account"), CONTRACTS["agg_monthly"], "country_account string")
    assert "country_account" not in bare.columns


def test_sources_round_trip(spark, small, tmp_path):
    folder = str(tmp_path / "tables")
    for name in CONTRACTS:
        if name != "rfm":
            getattr(small.src, name).write.parquet(f"{folder}/{name}.parquet")
    again = Sources.from_parquet(spark, folder)
    assert again.account.count() == small.src.account.count()
    assert again.rfm is None

    for name in CONTRACTS:
        if name != "rfm":
            spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(f"t_{name}")
    named = Sources.from_catalog(spark, {n: f"t_{n}" for n in CONTRACTS if n != "rfm"})
    assert named.client_base.count() == small.src.client_base.count()
    for name in CONTRACTS:
        spark.catalog.dropTempView(f"t_{name}")


def test_sums_are_those_of_decimals(spark):
    rng = random.Random(4)
    plain = lambda: rng.randint(-(10**9), 10**9) / 10 ** rng.randint(0, 4)
    odd = lambda: rng.choice([rng.random() * 10 ** rng.randint(-9, 9), 1e-17, 0.1 + 0.2, 9e11, 123456789012345.67, -5e15])
    kinds = [[plain() for _ in range(200)], [odd() for _ in range(50)], [plain() for _ in range(90)] + [odd() for _ in range(20)] + [None], [None, None], [0.0, -0.0], [5e19], [0.1] * 10, [8.9999999999e11] * 3]
    data = [(k, x) for k, values in enumerate(kinds) for x in values]
    rng.shuffle(data)
    out = spark.createDataFrame(data, "k int, x double").repartition(3).groupBy("k").agg(C.decimal_sum("x").alias("sum"), C.exact_sum("x").alias("double"), C.exact_avg("x").alias("mean"))
    assert out.schema["sum"].dataType.simpleString() == C.USD
    found = {r["k"]: r for r in out.collect()}
    place = Decimal(1).scaleb(-18)
    with localcontext() as exact:
        exact.prec = 60
        for k, values in enumerate(kinds):
            there = [Decimal(repr(x)).quantize(place, ROUND_HALF_UP) for x in values if x is not None]
            want = sum(there, Decimal(0)) if there else None
            assert found[k]["sum"] == want, k
            assert found[k]["double"] == (None if want is None else float(want))

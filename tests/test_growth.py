"""What keeps bytes and time in proportion to the input: no key-sized broadcasts, no source that
is not read, one shuffle of the wide rows by merchant."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from merchlife.functions.columns import distinct_in_merchant, left_join_by_month
from merchlife.operators import activity, balances, lifecycle, rfm
from merchlife.sources.fixture import fixture_sources
from merchlife.sources.stages import StageStore
from merchlife.sources.tables import account_names

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "created_state",  # F7
        "churn_state",  # F8
        "created_segment",  # F2
        "attach_update_flag",  # F1
        "rfm_migration",  # F1
        "payment_method_mix",  # F5
        "created_activated_by_attributes",  # F6
    ],
)
def test_sides_of_many_keys_are_not_broadcast(small, name):
    assert "BroadcastExchange" not in plan(getattr(small, name)())


def test_account_names_are_not_broadcast(small):
    assert "BroadcastExchange" not in plan(account_names(small.smb(), small.src.name_map, small.src.account))


class CountedStore(StageStore):
    def __init__(self, spark):
        super().__init__(spark)
        self.saved = []

    def save(self, name, df, **layout):
        self.saved.append(name)
        return super().save(name, df, **layout)


def test_sources_are_made_when_they_are_read(spark, small):
    """payment_method_mix reads orders and customers, no line items."""
    store = CountedStore(spark)
    sources = fixture_sources(spark, SMALL, store)
    assert store.saved == []
    mix = activity.payment_method_mix(sources.agg_monthly, sources.client_base, small.p)
    assert set(store.saved) == {"source_first_order", "source_billed", "source_client_base"}
    assert sources.client_base is sources.client_base and mix.count() > 0
    sources.balance, sources.transaction, sources.dispute
    assert store.saved.count("source_shipped") == 1 and len(store.saved) == 4
    store.close()


def test_wide_rows_are_shuffled_once_by_merchant(small):
    """window, balances and update flags share the partitions by merchant."""
    usd = small.merchant_balance_usd()
    text = plan(balances.active_with_balances(small.months_on_book(), usd))
    assert len(re.findall(r"Exchange hashpartitioning\(nombre_merchant", text)) == 1
    rows = lifecycle.attach_update_flag(lifecycle.management_segment(small.active_state(), small.src.segment), small.src.up_down)
    assert len(re.findall(r"Exchange hashpartitioning\(nombre_merchant", plan(rows))) == 1
    moves = rfm.attach_rfm(small.lifecycle_rows(), small.rfm_scores())
    assert "hashpartitioning(nombre_merchant#" in plan(moves) and "mes" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", plan(moves)))


def test_left_join_by_month(spark):
    may, june = date(2021, 5, 1), date(2021, 6, 1)
    schema = "nombre_merchant string, mes date, {} int"
    rows = [("a", may, 1), ("a", may, 1), ("a", june, 2), ("b", may, 3), (None, may, 4), ("a", None, 5)]
    side = [("a", may, 10), ("a", may, 11), (None, may, 12), ("a", None, 13), ("b", june, 14)]
    left, right = spark.createDataFrame(rows, schema.format("x")), spark.createDataFrame(side, schema.format("y"))
    found = left_join_by_month(left, right)
    assert found.columns == ["nombre_merchant", "mes", "x", "y"]
    usual = left.join(right, ["nombre_merchant", "mes"], "left")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, usual.collect()))
    assert found.count() == 8


def test_distinct_in_merchant(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1)], "nombre_merchant string, x int")
    assert sorted(map(repr, distinct_in_merchant(rows).collect())) == sorted(map(repr, rows.distinct().collect()))
    text = plan(distinct_in_merchant(rows).join(rows.select("nombre_merchant").distinct().hint("merge"), "nombre_merchant"))
    assert len(re.findall("Exchange hashpartitioning", text)) == 2


def test_client_base_of_orders_without_a_key(spark, tmp_path):
    """The groups by key and flags are those by the texts made from them."""
    for t in ("nation", "lineitem", "part", "events"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    customer = spark.read.parquet(f"{SMALL}/customer.parquet").limit(40)
    customer.union(customer.limit(5)).write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    holed = orders.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")))
    holed.write.parquet(f"{tmp_path}/orders.parquet")
    store = StageStore(spark)
    base = fixture_sources(spark, str(tmp_path), store).client_base
    keys = ["account_id", "name_merchant", "month", "group", "country_account"]
    assert base.count() > 0 and base.groupBy(*keys).count().filter("count > 1").isEmpty()
    store.close()

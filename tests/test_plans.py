"""What the physical plans must and must not contain."""

import re
from types import SimpleNamespace

import pytest

from merchlife import MerchantPipeline
from merchlife.operators import activity, attributes, cohorts, fraud
from merchlife.operators.lifecycle import LIFECYCLE_SCHEMA
from merchlife.session import check_session
from merchlife.sources.stages import StageStore

# Reports with a handful of rows per month may end in a single sorted partition.
STEPS = [
    n
    for n, f in vars(MerchantPipeline).items()
    if callable(f) and not n.startswith("_") and n not in ("stages", "prepare")
]
SMALL_REPORTS = {"month_calendar"}


@pytest.fixture(autouse=True)
def whole_plan_text(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", STEPS)
def test_no_single_partition_or_nested_loop(small, name):
    text = plan(getattr(small, name)())
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text
    if name not in SMALL_REPORTS:
        assert "SinglePartition" not in text


class PlannedStore(StageStore):
    """Keeps the plan of each stage as it is before it is written."""

    def __init__(self, spark):
        super().__init__(spark)
        self.plans = {}

    def save(self, name, df, **layout):
        self.plans[name] = plan(df)
        return super().save(name, df)


@pytest.fixture(scope="module")
def planned(spark, small):
    store = PlannedStore(spark)
    pipeline = MerchantPipeline(spark, small.src, small.p, store)
    pipeline.prepare()
    yield pipeline
    store.close()


@pytest.mark.parametrize("name", MerchantPipeline.stages())
def test_stages_are_distributed(planned, name):
    """The plan that builds the stage, not the scan that its readers see."""
    text = planned.store.plans[name]
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text
    assert "SinglePartition" not in text


def test_dashboard_reads_the_active_rows_once(planned):
    text = plan(planned.executive_dashboard())
    # Active rows, created accounts and their names, milestones, activity and fraud.
    assert "Window" not in text
    assert text.count("FileScan") == 6 and len(re.findall("FileScan[^\n]*active_with_fraud", text)) == 1


def test_activity_reads_the_base_once(small):
    text = plan(activity.activity_distance(small.merchant_month_base(), small.p))
    assert text.count("FileScan") == 1
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert "GreaterThanOrEqual(billing_date_monthly" in text


def test_transactions_stay_in_place_for_few_orders(spark, small):
    """A threshold that holds the stored orders but not the transactions."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100kb")
    text = plan(fraud.named_fraud(small.src.transaction, small.fraud_orders(), small.names()))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in text


def test_transactions_are_filtered_before_their_shuffle(spark, small):
    """Beyond the broadcast size a Bloom filter of the disputed orders comes before the exchange."""
    orders = small.fraud_orders()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1kb")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1kb")
    try:
        found = fraud.fraud_transactions(small.src.transaction, orders)
        text = found._jdf.queryExecution().optimizedPlan().toString()
        assert "might_contain" in text and "bloom_filter_agg" in text
        assert found.count() == small.fraud_transactions().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold")


def test_states_of_the_lifecycle_rows_are_folders(small):
    rows = small.lifecycle_rows()
    text = plan(rows.filter("estado_ = 'Activos' and mes >= date'2001-01-01'"))
    assert "PartitionFilters: [isnotnull(estado_" in text and "GreaterThanOrEqual(mes," in text
    active = rows.filter("estado_ = 'Activos'")
    assert len(rows.inputFiles()) > 0 and rows.columns == list(LIFECYCLE_SCHEMA)
    assert 0 < active.count() < rows.count()


def test_top_account_is_limited_before_the_shuffle(small):
    text = plan(small.top_account_per_merchant())
    assert text.count("WindowGroupLimit") == 2
    assert "Partial" in text


def test_scans_are_pruned(small):
    text = plan(attributes.top_account_per_merchant(small.src.client_base, small.names()))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
    assert "struct<account_id:string,tpt:double>" in schemas


def test_flags_combine_before_the_join(small):
    text = plan(activity.payment_method_flags(small.src.agg_monthly, small.src.client_base, small.p))
    join = min(text.index(j) for j in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin") if j in text)
    assert "HashAggregate" in text[join:]


def test_review_needs_no_window(small):
    text = plan(cohorts.back_from_churn_review(small.months_on_book(), small.p))
    assert "Window" not in text and "Exchange" not in text


def stub(spark, settings):
    return SimpleNamespace(conf=SimpleNamespace(get=settings.get), read=spark.read)


def test_stages_live_in_the_checkpoint_folder(spark, small, tmp_path):
    session = stub(spark, {"spark.checkpoint.dir": str(tmp_path), "spark.master": "yarn"})
    df = StageStore(session).save("x", small.smb())
    assert str(tmp_path) in df.inputFiles()[0]


def test_a_named_run_replaces_its_stages(spark, small, tmp_path):
    session = stub(spark, {"spark.checkpoint.dir": str(tmp_path)})
    first = StageStore(session, "monthly").save("x", small.smb()).inputFiles()
    second = StageStore(session, "monthly").save("x", small.smb())
    assert second.count() == small.smb().count()
    assert not set(first) & set(second.inputFiles())
    assert len(list((tmp_path / "merchlife-stages").iterdir())) == 1


def test_no_local_folder_on_a_cluster(spark, small):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        StageStore(stub(spark, {"spark.master": "yarn"}))


def test_close_removes_the_stages(spark, small, tmp_path):
    store = StageStore(spark)
    store.root = f"{tmp_path}/own"
    store.save("x", small.smb())
    store.close()
    assert not (tmp_path / "own").exists()


def test_other_time_zones_and_silent_overflow_are_refused():
    settings = {"spark.sql.session.timeZone": "America/Bogota", "spark.sql.ansi.enabled": "true"}
    with pytest.raises(ValueError, match="timeZone"):
        check_session(stub(SimpleNamespace(read=None), settings))
    settings |= {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "false"}
    with pytest.raises(ValueError, match="ansi"):
        check_session(stub(SimpleNamespace(read=None), settings))


def test_a_subclass_has_the_stages_of_its_base():
    class Own(MerchantPipeline):
        pass

    assert MerchantPipeline.stages() and Own.stages() == MerchantPipeline.stages()
    assert set(Own.stages()) <= set(Own(None, None, None, store=object())._locks)

"""The monthly job stores every table and report as one release, and a second run replaces it in one step."""

import pytest

from merchlife.plans import monthly
from merchlife.plans.monthly import REPORTS, TABLES, monthly_run
from merchlife.sources.releases import Release, Releases


@pytest.fixture
def short(monkeypatch):
    """A few of the tables and reports."""
    monkeypatch.setattr(monthly, "TABLES", ("merchant_month_base", "churn_events"))
    monkeypatch.setattr(monthly, "REPORTS", ("churn_by_month",))


def test_a_whole_run(spark, small, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS monthly LOCATION '{tmp_path}/db'")
    releases = monthly_run(spark, small.src, small.p, "monthly", f"file://{tmp_path}/warehouse")
    assert {t.name for t in spark.catalog.listTables("monthly") if not t.isTemporary} == {*TABLES, *REPORTS}
    assert releases.names() == sorted({*TABLES, *REPORTS})
    for name in TABLES:
        stored, built = spark.table(f"monthly.{name}"), getattr(small, name)()
        assert sorted(stored.columns) == sorted(built.columns) and stored.count() == built.count(), name
    for name in REPORTS:
        assert releases.read(name).columns == getattr(small, name)().columns, name
    assert sorted(releases.read("executive_dashboard").collect()) == sorted(small.executive_dashboard().collect())
    plan = spark.table("monthly.active_with_fraud").filter("mes = date'2001-08-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mes" in plan
    spark.sql("DROP DATABASE monthly CASCADE")


def test_runs_replace_each_other_and_old_releases_go(spark, small, tmp_path, short):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS monthly LOCATION '{tmp_path}/db'")
    root = f"file://{tmp_path}/warehouse"
    paths = []
    for _ in range(3):
        releases = monthly_run(spark, small.src, small.p, "monthly", root, "csv")
        paths.append(releases.path("churn_events"))
        assert spark.table("monthly.churn_events").count() == small.churn_events().count()
    assert releases.read("churn_by_month").count() == small.churn_by_month().count()
    assert len(set(paths)) == 3 and releases.number() == 3
    assert not (tmp_path / "warehouse" / paths[0].split("/warehouse/")[1]).exists()
    assert spark.read.parquet(paths[1]).count() == small.churn_events().count()  # for readers that have begun
    spark.sql("DROP DATABASE monthly CASCADE")


@pytest.mark.parametrize("place", ["audit", "write"])
def test_a_run_that_dies_leaves_the_last_release(spark, small, tmp_path, short, monkeypatch, place):
    root = f"file://{tmp_path}/warehouse"
    releases = monthly_run(spark, small.src, small.p, None, root)
    before = releases.path("churn_events")
    reader = releases.read("churn_events")
    real = getattr(Release, place)

    def dies(self, *args, **kwargs):
        if place == "write" and len(self.tables) < 2:
            return real(self, *args, **kwargs)  # the third write does not come back
        raise KeyboardInterrupt

    monkeypatch.setattr(Release, place, dies)
    with pytest.raises(KeyboardInterrupt):
        monthly_run(spark, small.src, small.p, None, root)
    monkeypatch.undo()
    assert releases.number() == 1 and releases.path("churn_events") == before
    assert reader.count() == releases.read("churn_events").count() == small.churn_events().count()
    assert len(list((tmp_path / "warehouse" / "versions").iterdir())) == 1


def test_a_run_that_was_overtaken_is_refused(spark, tmp_path):
    releases = Releases(spark, f"file://{tmp_path}/warehouse")
    slow, fast = releases.begin(), releases.begin()
    for release, n in ((slow, 1), (fast, 2)):
        release.write(spark.range(n), "t")
    fast.commit()
    with pytest.raises(RuntimeError, match="another run"):
        slow.commit()
    assert releases.read("t").count() == 2


def test_files_that_lost_rows_are_not_released(spark, tmp_path):
    releases = Releases(spark, f"file://{tmp_path}/warehouse")
    release = releases.begin()
    release.write(spark.range(10, numPartitions=2), "t")
    next((tmp_path / "warehouse" / release.folder / "t").glob("part-*.parquet")).write_bytes(b"")
    with pytest.raises(Exception):  # noqa: B017
        release.commit()
    short = releases.begin()
    short.write(spark.range(10), "t")
    short.tables["t"]["rows"] = 11
    with pytest.raises(RuntimeError, match="11 rows were written, 10 are there"):
        short.commit()
    assert releases.number() == 0

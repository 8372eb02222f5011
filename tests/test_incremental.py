"""Kept months of activity: updates equal a full rebuild and write no more than the months they reach."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from merchlife.operators.activity import activity_distance
from merchlife.plans import incremental
from merchlife.plans.incremental import IncrementalPipeline, KeptActivity
from merchlife.sources.stages import StageStore

SCHEMA = "name_merchant_ string, billing_date_monthly date, `group` string, account_create_date date, tpt double, tpv_usd double"


@pytest.fixture
def kept(spark, tmp_path):
    return KeptActivity(spark, f"file://{tmp_path}/kept", StageStore(spark))


def base(spark, rows):
    return spark.createDataFrame([(n, date(y, m, 1), g, date(2018, 1, 1) if c is None else c, 1.0, v) for n, y, m, g, c, v in rows], SCHEMA)


def months_of(n, group="SMB"):
    """A merchant with gaps of its own."""
    return [(n, y, m, group, None, 1.0) for y in (2018, 2019, 2020) for m in range(1, 13) if (m + (ord(n[-1]) if n else 3)) % 5 == 0]


def same(kept, df, p):
    want = sorted((tuple(r) for r in activity_distance(df, p).select("name_merchant", "mes", "inactividad", "group").collect()), key=repr)
    assert sorted((tuple(r) for r in kept.read().collect()), key=repr) == want and want


def files(tmp_path):
    return {f.parent.name: {x.name for x in f.parent.glob("*.parquet")} for f in (tmp_path / "kept/activity").glob("mes=*/*.parquet")}


def test_late_rows_rewrite_the_months_they_reach(spark, kept, params, tmp_path):
    rows = [r for n in ("a", "b", "c", None) for r in months_of(n)] + months_of("a", None)
    first = kept.update(base(spark, rows), params)
    assert len(first) == 36
    same(kept, base(spark, rows), params)
    before = files(tmp_path)
    late = [*rows, ("d", 2019, 4, "SMB", None, 1.0), ("a", 2019, 4, None, None, 1.0), (None, 2019, 4, "SMB", None, 1.0)]
    written = kept.update(base(spark, late), params)
    assert written == [date(2019, m, 1) for m in range(4, 11)]  # seven
    same(kept, base(spark, late), params)
    after = files(tmp_path)
    assert {m for m in after if after[m] != before[m]} == {f"mes={m}" for m in written}
    assert kept.update(base(spark, late), params) == [] and files(tmp_path) == after


def test_rows_that_go_or_change(spark, kept, params):
    rows = [("a", 2019, 4, "SMB", None, 1.0), ("b", 2019, 4, "SMB", None, 1.0), ("b", 2020, 2, "SMB", None, 1.0)]
    kept.update(base(spark, rows), params)
    fewer = rows[1:]
    assert kept.update(base(spark, fewer), params) == [date(2019, m, 1) for m in range(4, 11)]
    same(kept, base(spark, fewer), params)
    later = [("b", 2019, 4, "SMB", date(2019, 8, 9), 1.0), rows[2]]  # created in August by now: the months before go
    kept.update(base(spark, later), params)
    same(kept, base(spark, later), params)
    assert kept.read().filter("mes < date'2019-08-01'").count() == 0
    none = [("b", 2019, 4, "SMB", None, 0.0), rows[2]]  # no volume any more
    assert len(kept.update(base(spark, none), params)) == 7
    same(kept, base(spark, none), params)


def test_months_pass(spark, kept, params):
    rows = [r for n in ("a", "b") for r in months_of(n)]
    kept.update(base(spark, rows), params)
    later = replace(params, as_of=date(2021, 3, 2))
    more = [*rows, ("a", 2021, 1, "SMB", None, 1.0)]
    assert kept.update(base(spark, more), later) == [date(2021, 1, 1), date(2021, 2, 1)]
    same(kept, base(spark, more), later)
    assert kept.read().agg(F.min("mes")).first()[0] >= later.first_month
    back = replace(params, as_of=date(2020, 12, 1))  # and back again
    kept.update(base(spark, more), back)
    same(kept, base(spark, more), back)


@pytest.mark.parametrize("dies", ["activity", "facts"])
def test_an_update_that_was_cut_short_is_made_again(spark, kept, params, monkeypatch, dies):
    rows = [r for n in ("a", "b") for r in months_of(n)]
    kept.update(base(spark, rows), params)
    late = [*rows, ("c", 2019, 4, "SMB", None, 1.0)]
    write = KeptActivity._write

    def cut(self, df, name, *more, **how):
        if name == dies:
            raise KeyboardInterrupt
        write(self, df, name, *more, **how)

    monkeypatch.setattr(KeptActivity, "_write", cut)
    with pytest.raises(KeyboardInterrupt):
        kept.update(base(spark, late), params)
    monkeypatch.undo()
    assert len(kept.update(base(spark, late), params)) == 7
    same(kept, base(spark, late), params)


def test_only_changed_billing_months_are_compared_row_by_row(spark, kept, params):
    rows = [r for n in ("a", "b") for r in months_of(n)]
    kept.update(base(spark, rows), params)
    facts = kept._facts(base(spark, [*rows, ("c", 2019, 4, "SMB", None, 1.0)]), params)
    before = spark.read.schema(facts.schema).parquet(f"{kept.root}/facts")
    billed = kept._changed_months(facts, before)
    assert billed == [date(2019, 4, 1)]
    plan = kept._cells(facts, before, billed, params)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_month" in plan


def test_the_pipeline_on_kept_activity(spark, small, tmp_path):
    run = IncrementalPipeline(spark, small.src, small.p, f"file://{tmp_path}/kept")
    for name in ("active_merchants", "churn_by_month"):
        assert sorted(map(tuple, getattr(run, name)().collect()), key=repr) == sorted(map(tuple, getattr(small, name)().collect()), key=repr)
    assert len(run.written) == 36
    again = IncrementalPipeline(spark, small.src, small.p, f"file://{tmp_path}/kept")
    again.activity_distance()
    assert again.written == [] and incremental._months(small.p)[-1] == small.p.last_month

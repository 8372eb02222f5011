from __future__ import annotations

import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from merchlife import Params  # noqa: E402
from merchlife.session import local_session  # noqa: E402
from merchlife.sources.tables import CONTRACTS, OPTIONAL_COLUMNS  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def small(spark):
    """The pipeline over the smallest fixture, shared by the tests."""
    import __spark_entry__

    return __spark_entry__.pipeline(spark, SMALL)


@pytest.fixture
def params():
    return Params(as_of=date(2021, 1, 15), fee_snapshot_month=date(2020, 6, 1))


@pytest.fixture
def table(spark):
    """table("fx", rows): rows as tuples in the order of the table's contract."""

    def make(name: str, rows: list[tuple], country: bool = False):
        schema = CONTRACTS[name] + (", " + OPTIONAL_COLUMNS[name] if country else "")
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def rows():
    """A result as a sorted list of tuples."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return collect

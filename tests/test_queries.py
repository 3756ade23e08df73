"""Every panel query with SQL against DuckDB; the others must run."""

from __future__ import annotations

import pytest

from steppe.plans.registry import ORACLES, QUERIES

from .oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert not differences(spark, con, SF, QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, SF).columns


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rows_do_not_depend_on_partitions(spark):
    from steppe.plans import inputs as I
    from steppe.plans.queries import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = sorted(map(str, QUERIES["spi_1"](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(str, QUERIES["spi_1"](spark, SF).collect())) == rows
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert I.panel(spark, SF).count() == 10 * 82

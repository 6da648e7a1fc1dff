"""Every registered query against its check SQL on the smallest tables."""

import pytest

import compare
import __spark_entry__ as entry
from scorewatch.catalog import collect

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.duck(DATA)


@pytest.mark.parametrize("name", list(collect("QUERIES")))
def test_query_matches_check(spark, duck, name):
    good, note = compare.compare(spark, duck, DATA, name)
    assert good, note


def test_every_query_has_a_check():
    assert set(collect("QUERIES")) == set(collect("CHECKS"))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["Month", "scorename", "DateCategory", "psivalues", "account_count"]
    assert df.count() > 30

"""Every registered query runs; where it has an SQL twin all rows are equal."""

import __spark_entry__ as entry
import compare
import pytest

DIRECTORY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    found = compare.run_spark(entry.queries()[name](spark, DIRECTORY))
    if name in entry.oracle_sql():
        assert found == compare.run_sql(entry.oracle_sql()[name], DIRECTORY)
    else:
        assert found[1] or name.startswith("stream_")

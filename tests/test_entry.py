import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 45


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 20 and [r.place for r in rows] == list(range(1, 21))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_reason_occurs(spark):
    reasons = {r.reason for r in __spark_entry__.queries()["reject_reason_counts"](spark, "/root/testdata/sf0.01").collect()}
    assert reasons >= {"accepted", "title", "level", "region", "senior", "experience", "no_json_ld"}

"""What the driver asks of the entry module."""

import __spark_entry__
from tallywright.plans import registry


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(registry.oracle_sql()) >= 55


def test_all_queries_plan(spark):
    for name, query in registry.queries().items():
        if not name.startswith("stream_"):
            assert query(spark, "/root/testdata/sf0.001").columns, name

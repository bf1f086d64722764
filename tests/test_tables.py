"""Intermediate tables."""

from quire.sources.tables import durable, release, shared_folder


def test_tables_are_written_read_and_released(spark):
    one = durable(spark.range(3), "t")
    assert one.count() == 3 and shared_folder(spark) in one.inputFiles()[0]
    release(spark)
    again = durable(spark.range(2), "t")
    assert again.count() == 2

"""Stored intermediate tables."""

import os

from runledger import session


def test_clean_up_deletes_what_was_settled(spark):
    kept = session.settle(spark.range(3), "kept")
    folder = session._own_folder(spark).removeprefix("file:")
    assert kept.count() == 3 and os.path.isdir(folder)
    session.clean_up(spark)
    assert not os.path.exists(folder)
    session.clean_up(spark)
    assert session.settle(spark.range(2), "again").count() == 2


def test_tables_of_a_stage_are_deleted_at_its_end(spark):
    before = session.settle(spark.range(3), "before")
    try:
        with session.passing_tables(spark):
            inner = session.settle(spark.range(10), "inner")
            kept = session.settle(inner.where("id > 6"), "kept", keep=True)
            folder = inner.inputFiles()[0].rsplit("/", 2)[0]
            raise KeyError
    except KeyError:
        pass
    path, files = session.hadoop_file(spark, folder)
    assert "/stage-" in folder and not files.exists(path)
    after = session.settle(spark.range(2), "after")
    assert (before.count(), kept.count(), after.count()) == (3, 3, 2)

import os

from lakewright import session


def test_tables_between_steps_are_dropped(spark):
    session.drop_materialized(spark)
    d = session.materialize(spark.range(5), "numbers")
    folder = d.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert d.count() == 5 and os.path.isdir(folder)
    assert session.drop_materialized(spark) == 1 and not os.path.exists(folder)
    assert session.drop_materialized(spark) == 0

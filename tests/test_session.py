import os

from barloom import session


def test_scratch_tables_go_at_the_end(spark):
    with session.scratch(spark):
        kept = session.materialize(spark.range(5), "scratch-test")
        path = session._written[-1]
        assert kept.count() == 5 and os.path.isdir(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))

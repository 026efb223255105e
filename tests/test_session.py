from types import SimpleNamespace

import pytest

from tractwise import session


def stub(named, master="local[2]"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named),
                           sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_named_folder_wins():
    assert session.shared_dir(stub("hdfs://x/y/")) == "hdfs://x/y"
    assert session.scratch_path(stub("/s"), "a") != session.scratch_path(stub("/s"), "a")


def test_own_folder_only_in_local_mode():
    assert session.shared_dir(stub(None)) == session.shared_dir(stub(None))
    with pytest.raises(ValueError):
        session.shared_dir(stub(None, "yarn"))


def test_settled_frames_keep_schema_and_rows(spark):
    df = spark.range(5).selectExpr("id", "array(cast(id as double)) AS `a b`")
    back = session.settle(df)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(back.collect()) == sorted(df.collect())
    assert session.settle(df.filter("id > 9")).count() == 0

import os

import pytest

from chronoweave import session


def test_written_tables_live_in_the_shared_folder_until_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(session, "_written", [[]])
    df = session.written(spark.range(3), "numbers")
    assert df.count() == 3 and len(os.listdir(tmp_path)) == 1
    assert session.drop_written(spark) == 1 and [x for x in os.listdir(tmp_path) if not x.startswith(".")] == []
    with session.scratch(spark):
        session.written(spark.range(3), "inner")
        assert len([x for x in os.listdir(tmp_path) if not x.startswith(".")]) == 1
    assert [x for x in os.listdir(tmp_path) if not x.startswith(".")] == [] and session._written == [[]]


def test_folder_is_made_once_where_none_is_named(spark):
    assert session.shared_dir(spark) == session.shared_dir(spark)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Conf:
        get = staticmethod(lambda *a: None)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError):
        session.shared_dir(Session)

import os
from types import SimpleNamespace

import pytest

from frameloom import tables


def test_a_scope_deletes_its_tables_alone(spark):
    outer = tables.stored(spark.range(3), "outer")
    with tables.tables_dropped_after():
        inner = tables.stored(spark.range(5), "inner")
        assert inner.count() == 5
    path = lambda df: df._stored_at.removeprefix("file://").removeprefix("file:")
    assert not os.path.exists(path(inner)) and outer.count() == 3
    tables.dropped(outer)
    assert not os.path.exists(path(outer))
    tables.dropped(None)


def test_no_machine_local_tables_on_a_cluster():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    def session(master, given=None, **conf):
        folder = SimpleNamespace(isDefined=lambda: given is not None, get=lambda: given)
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: folder)))
        return SimpleNamespace(conf=Conf({k.replace("_", "."): v for k, v in conf.items()}), sparkContext=context)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(session("spark://host:7077"))
    assert tables.shared_dir(session("yarn", "hdfs://x/y")) == "hdfs://x/y"
    assert tables.shared_dir(session("yarn", "hdfs://x/y", spark_checkpoint_dir="hdfs://z")) == "hdfs://z"
    assert tables.shared_dir(session("local[2]")).startswith("file://")

import pytest

from ridelens.session import ensure_checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _SC:
    def __init__(self, master, values):
        self.master, self._conf, self.dir = master, _Conf(values), None

    def getConf(self):
        return self._conf

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Spark:
    def __init__(self, master, values):
        self.sparkContext = _SC(master, values)
        self.conf = _Conf(values)


def test_cluster_without_checkpoint_dir_raises():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Spark("yarn", {}))


def test_cluster_checkpoint_dir_is_used():
    s = _Spark("k8s://cluster", {"spark.checkpoint.dir": "s3a://shared/ckpt"})
    assert ensure_checkpoint_dir(s) == "s3a://shared/ckpt"
    assert s.sparkContext.dir == "s3a://shared/ckpt"


def test_local_mode_gets_a_scratch_dir():
    s = _Spark("local[4]", {})
    assert ensure_checkpoint_dir(s).startswith("/")


def test_stage_scope_removes_what_was_written_inside(spark):
    import os

    from ridelens.session import checkpoint_stage, stage_scope

    before = checkpoint_stage(spark.range(5), "outer")
    with stage_scope(spark):
        inner = checkpoint_stage(spark.range(7).selectExpr("id", "id % 2 AS k"), "inner", partition_by=["k"])
        path = inner.inputFiles()[0].removeprefix("file://").split("/inner-")[0]
        assert inner.count() == 7 and any(x.startswith("inner-") for x in os.listdir(path))
    assert not any(x.startswith("inner-") for x in os.listdir(path)) and before.count() == 5


def test_entry_works_without_the_training_data_subpackage(monkeypatch):
    import sys

    import __spark_entry__ as E

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # importing it now fails as if it were absent
    from ridelens.plans.queries import QUERIES

    assert set(E.queries()) == set(QUERIES)

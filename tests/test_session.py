"""Shared checkpoint folder: taken from the session; a local folder only in local mode."""

import pytest

from voltaic.session import checkpoint_root


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Session:
    """Stands in for a session without an RDD handle (as a remote session has)."""

    def __init__(self, values):
        self.conf = _Conf(values)

    @property
    def sparkContext(self):
        raise RuntimeError("no SparkContext")


def test_cluster_folder_is_used_as_named():
    s = _Session({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://nn/shared/ckpt/"})
    assert checkpoint_root(s) == "hdfs://nn/shared/ckpt"


def test_cluster_without_a_shared_folder_refuses():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(_Session({"spark.master": "k8s://https://api:6443"}))


def test_local_mode_gets_a_scratch_folder():
    s = _Session({"spark.master": "local[2]"})
    root = checkpoint_root(s)
    assert root and s.conf.get("spark.checkpoint.dir") == root

from types import SimpleNamespace

import pytest

from lectern.session import MOST_PARTITIONS, shuffle_partitions, work_dir


def fake(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder or default),
                           sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "k8s://host", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            work_dir(fake(master), "x")
        assert work_dir(fake(master, "hdfs:///tmp/"), "x").startswith("hdfs:///tmp/x-")
    assert work_dir(fake("local[4]"), "x") != work_dir(fake("local[4]"), "x")


def test_shuffle_partitions_stay_bounded():
    assert shuffle_partitions(0) == 200
    assert shuffle_partitions(1024 ** 4) == 8192
    assert shuffle_partitions(100 * 1024 ** 4) == MOST_PARTITIONS

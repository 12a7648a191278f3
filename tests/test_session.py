import pytest

from context_shaper import session


class _Context:
    def __init__(self, master):
        self.master, self.applicationId = master, "app-1"


class _Session:
    def __init__(self, master, folder=None):
        self.sparkContext = _Context(master)
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}


def test_a_cluster_must_name_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(_Session(master))


def test_the_named_folder_is_used():
    assert session.shared_folder(_Session("yarn", "hdfs://x/y/")) == "hdfs://x/y"


def test_local_master_gets_a_private_folder():
    first = session.shared_folder(_Session("local[2]"))
    assert first == session.shared_folder(_Session("local"))


def test_staged_tables_can_be_released(spark):
    staged = session.stage(spark.range(3).selectExpr("id AS x"), "probe")
    assert staged.count() == 3
    session.release_staged(spark)
    with pytest.raises(Exception):
        session.stage(spark.range(1).selectExpr("id AS x"), "probe").sparkSession.read.parquet(
            staged.inputFiles()[0]
        ).count()


def test_sessions_do_not_share_private_folders():
    first, other = _Session("local[2]"), _Session("local[2]")
    other.sparkContext.applicationId = "app-2"
    assert session.shared_folder(first) != session.shared_folder(other)

import pytest

from tidemark.session import new_folder, shared_folder, write_through


class Conf(dict):
    def get(self, name, default=None):
        return super().get(name, default)


class FakeSession:
    """Only the parts of a session that name its shared folder."""

    class sparkContext:
        master = "spark://somewhere:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    def __init__(self, **conf):
        self.conf = Conf(conf)


def test_cluster_names_the_shared_folder():
    named = FakeSession(**{"spark.checkpoint.dir": "hdfs:///shared"})
    assert shared_folder(named) == "hdfs:///shared"
    assert new_folder(named, "x").startswith("hdfs:///shared/x-")
    with pytest.raises(ValueError):
        shared_folder(FakeSession())


def test_write_through_keeps_rows_and_types(spark):
    df = spark.sql("SELECT id, timestamp_ntz'2024-01-01 00:00:00' AS ts, array(id * 0.5D) AS x FROM range(5)")
    back = write_through(df, "test")
    assert back.dtypes == df.dtypes
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert all(shared_folder(spark).split(":")[-1] in f for f in back.inputFiles())

import pytest

from retentia.session import drop_stored, ensure_checkpoint_dir, launched_by_spark, stored


def test_launcher_detection(monkeypatch):
    for var in ("PYSPARK_GATEWAY_PORT", "SPARK_MASTER", "PYSPARK_SUBMIT_ARGS"):
        monkeypatch.delenv(var, raising=False)
    assert not launched_by_spark()  # plain python: local defaults apply
    monkeypatch.setenv("PYSPARK_SUBMIT_ARGS", "--master yarn pyspark-shell")
    assert launched_by_spark()  # the launcher owns master and shuffle width
    monkeypatch.delenv("PYSPARK_SUBMIT_ARGS")
    monkeypatch.setenv("PYSPARK_GATEWAY_PORT", "12345")
    assert launched_by_spark()


def test_a_cluster_must_name_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_stored_tables_can_be_partitioned(spark):
    df = spark.range(10).selectExpr("id", "id % 2 AS side")
    table = stored(df, "t", partition_by="side")
    assert table.dtypes == df.dtypes and sorted(map(tuple, table.collect())) == sorted(map(tuple, df.collect()))
    assert callable(drop_stored)

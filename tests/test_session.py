from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cutline import session


def _stub(master: str, folder: str | None = None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: folder))


def test_a_cluster_must_name_its_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(_stub(master))
    assert session.shared_folder(_stub("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert session.shared_folder(_stub("local[4]"))


def test_written_tables_are_read_back_and_released(spark):
    table = session.written(spark.range(5).withColumn("y", F.col("id") % 2), "t", partition_by="y")
    assert sorted(r.id for r in table.where("y = 1").collect()) == [1, 3] and table.columns == ["id", "y"]
    assert session.written(spark.range(0), "t").count() == 0

"""Spreading rows and cutting lineage."""

import pytest

from quercus import session as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spread(spark, data):
    df = S.read(spark, data, "documents").select("doc_id", "text")
    few = S.spread(df)
    assert "Exchange" in plan(few) and few.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert few.count() == df.count()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        # many splits: the scan is left as it is
        assert S.splits_of(df) >= S.PLENTY * spark.sparkContext.defaultParallelism
        many = S.spread(S.read(spark, data, "documents").select("doc_id", "text"))
        assert "Exchange" not in plan(many) and many.count() == df.count()
        # some splits: never fewer tasks than the scan has
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(int(S.splits_of(df) * 512 / 10)))
        assert S.spread(S.read(spark, data, "documents")).rdd.getNumPartitions() >= 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert S.spread(S.cut_lineage(df)).count() == df.count()


def test_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Frame:
        class sparkSession:
            sparkContext = Context()

            class conf:
                get = staticmethod(lambda name, other: other)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.cut_lineage(Frame())

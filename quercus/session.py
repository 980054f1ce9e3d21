"""Session helpers: reading tables of a dataset folder and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The table ``folder/table.parquet`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with ``checkpoint()`` so that later plans start from files.

    The folder is the one the cluster names in ``spark.checkpoint.dir``, shared by all
    executors, so the loss of one loses nothing. Only where it is unset on a local master,
    as in tests, a temporary folder is used; on a cluster without it this raises.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quercus-checkpoint-"))
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``cut_lineage`` uses, for files that another job reads again."""
    if spark.sparkContext.getCheckpointDir() is None:
        cut_lineage(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def fingerprint(df: DataFrame, *cols: str) -> tuple[int, int]:
    """Row count and order-free hash of the rows, to see whether a relation changed."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64(*cols)), F.lit(0)).alias("h"),
    ).first()
    return row["n"], row["h"]


#: Scan splits per core from which rows are left where they were read.
PLENTY = 8


def splits_of(df: DataFrame) -> float:
    """About how many tasks read the inputs of ``df``: the files' bytes over the size of a split."""
    spark = df.sparkSession
    share = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0.0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            total += leaf.rdd().getNumPartitions()
        else:
            total += float(leaf.stats().sizeInBytes()) / share
    return total


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Rows dealt evenly over the cores before a costly row-wise step, if the input leaves cores idle.

    A small input has few files or few row groups, and a Python stage behind it would run in
    few tasks. With PLENTY splits a core nothing is shuffled: the scan's tasks are left as
    they are. Below that the rows - at most PLENTY splits a core - are dealt over no fewer
    tasks than the scan has splits. The shuffle carries only the columns that step needs.
    """
    spark = df.sparkSession
    cores, splits = spark.sparkContext.defaultParallelism, splits_of(df)
    if splits >= PLENTY * cores:
        return df
    return df.repartition(max(int(splits) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")), cores), *cols)

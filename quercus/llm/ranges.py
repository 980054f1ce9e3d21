"""Running sums and numbers over a globally sorted table, without a window that one task must hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quercus.session import cut_lineage


def sorted_ranges(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """``rows`` sorted globally: ranges whose bounds are sampled quantiles of the order, so that each
    holds about as many rows however the values lie, sorted within and kept in the shared folder."""
    return cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order))


def _with_column(ranged: DataFrame, name: str, run) -> DataFrame:
    return ranged.mapInArrow(run, T.StructType([*ranged.schema.fields, T.StructField(name, T.LongType())]))


def _appended(batch: pa.RecordBatch, name: str, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], [*batch.schema.names, name])


def running_size(rows: DataFrame, order: list[str | Column], size: str, into: str) -> DataFrame:
    """``rows`` with the running sum of ``size`` (whole numbers, none null) in the order of ``order``.

    Every range is summed once; the driver gets one number a range, and each task adds the
    sum of the ranges before it while it runs through its rows.
    """
    ranged = sorted_ranges(rows, order)
    sums = {r["p"]: r["s"] for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(size).alias("s")).collect()}
    before, total = {}, 0
    for p in sorted(sums):
        before[p], total = total, total + sums[p]
    at = ranged.columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = before.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            values = np.cumsum(batch.column(at).to_numpy(zero_copy_only=False)) + so_far
            so_far = int(values[-1]) if len(values) else so_far
            yield _appended(batch, into, values)

    return _with_column(ranged, into, run)


def numbered(rows: DataFrame, group: str, order: list[str | Column], into: str) -> DataFrame:
    """``rows`` with their number from 1 within ``group`` (not null) in the order of ``order``.

    The table is sorted by group and order as a whole, so a group of any size lies over as
    many ranges as it fills. Only a range's first group may have begun before it: the driver
    gets the first and last group of each range with their sizes, and works out from where
    each range goes on counting.
    """
    ranged = sorted_ranges(rows, [group, *order])
    sizes = ranged.groupBy(F.spark_partition_id().alias("p"), group).agg(F.count(F.lit(1)).alias("n"))
    ends = sizes.groupBy("p").agg(F.min(group).alias("a"), F.max(group).alias("b"), F.min_by("n", group).alias("na"), F.max_by("n", group).alias("nb"))
    before, last, seen = {}, None, 0
    for r in sorted(ends.collect(), key=lambda r: r["p"]):
        start = seen if r["a"] == last else 0
        before[r["p"]] = (r["a"], start)
        last, seen = r["b"], r["nb"] + (start if r["a"] == r["b"] else 0)
    at = ranged.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = before.get(TaskContext.get().partitionId(), (None, 0))
        for batch in batches:
            groups, n = batch.column(at), batch.num_rows
            if not n:
                continue
            new = np.ones(n, dtype=bool)
            new[0] = groups[0].as_py() != last
            new[1:] = pc.not_equal(groups.slice(1), groups.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            places = np.arange(n)
            starts = np.maximum.accumulate(np.where(new, places, 0))
            values = places - starts + 1
            if not new[0]:
                values[starts == 0] += seen
            last, seen = groups[n - 1].as_py(), int(values[-1])
            yield _appended(batch, into, values)

    return _with_column(ranged, into, run)

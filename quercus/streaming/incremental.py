"""Incremental embedding of texts that arrive as a stream: only unseen contents are computed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from quercus.operators.vectors import embed_new
from quercus.sources.tables import optional


def embed_stream(spark: SparkSession, texts: DataFrame, key: str, text: str, table: str, checkpoint: str) -> StreamingQuery:
    """Appends ``hash, vektor`` of new contents to the Parquet ``table``, batch by batch.

    Every micro-batch is anti-joined with the table by content hash, so a text that comes
    again, in this stream or a restarted one, costs a look-up and no embedding. Nulls have
    no vector. Runs until the available files are read.
    """

    def batch(df: DataFrame, _: int) -> None:
        empty = spark.createDataFrame([], "hash string, vektor array<float>")
        known = optional(lambda: spark.read.schema(empty.schema).parquet(table), empty)
        embed_new(df, key, text, known).write.mode("append").parquet(table)

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

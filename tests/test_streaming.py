"""Incremental embedding over two runs of a stream."""

from quercus.streaming.incremental import embed_stream


def test_embed_stream(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    schema = "id long, t string"
    spark.createDataFrame([(1, "ab cd"), (2, "ab cd"), (3, None)], schema).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    embed_stream(spark, stream(), "id", "t", table, state).awaitTermination()
    assert spark.read.parquet(table).count() == 1
    spark.createDataFrame([(4, "ab cd"), (5, "neu")], schema).write.mode("append").parquet(source)
    embed_stream(spark, stream(), "id", "t", table, state).awaitTermination()
    assert spark.read.parquet(table).count() == 2

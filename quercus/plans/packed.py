"""Queries on packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quercus.operators.packed import unpack
from quercus.session import read


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    typed = read(spark, folder, "module").where("herkunft = 'formular'")
    return unpack(typed, "zeile_id", ["literatur", "inhalte", "lehr_lerneinheiten"]).drop("dialekt")


def p2_dialects(spark: SparkSession, folder: str) -> DataFrame:
    """How many cells of each field are written in each dialect, and the values they hold."""
    from pyspark.sql import functions as F

    typed = read(spark, folder, "module").where("herkunft = 'formular'")
    values = unpack(typed, "zeile_id", ["literatur", "inhalte", "lehr_lerneinheiten"], least=1)
    return values.groupBy("feld", "dialekt").agg(F.count_distinct("zeile_id").alias("zellen"), F.count("wert").alias("werte"))


QUERIES = {"p2_found": p2_found, "p2_dialects": p2_dialects}

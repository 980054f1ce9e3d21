"""Data-quality report: findings as rows of one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REPORT = ["bereich", "befund", "schluessel", "wert", "details"]


def _row(df: DataFrame, area: str, finding: str, key=None, value=None, details=None) -> DataFrame:
    text = lambda c: F.lit("") if c is None else F.coalesce(c.cast("string"), F.lit(""))
    return df.select(F.lit(area).alias("bereich"), F.lit(finding).alias("befund"), text(key).alias("schluessel"), text(value).alias("wert"), text(details).alias("details"))


def empty_fields(rows: DataFrame, key: str, fields: list[str], shown: int = 50) -> DataFrame:
    """``feld, anzahl, schluessel``: in how many rows each field is null, empty or blank, and the first
    ``shown`` of these by key. Partial lists are cut as they are merged, so none grows with the data."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feld"), F.col(f).alias("t")) for f in fields]))
    empty = rows.select(key, cells.alias("c")).where("trim(coalesce(c.t, '')) = ''").select(F.col("c.feld").alias("feld"), key)
    counts = empty.groupBy("feld").agg(F.count(F.lit(1)).alias("anzahl"))
    first = empty.withColumn("_r", F.row_number().over(Window.partitionBy("feld").orderBy(key))).where(F.col("_r") <= shown)
    listed = first.groupBy("feld").agg(F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda k: k.cast("string")), "; ").alias("schluessel"))
    return counts.join(listed, "feld")


def repeated(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Second and later rows of a key, in the order of ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n > 1").drop("_n")


def shared_names(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``name, anzahl, schluessel``: names that several keys have."""
    pairs = rows.where(f"trim({name}) <> ''").select(name, key).distinct()
    names = pairs.groupBy(name).agg(F.count(F.lit(1)).alias("anzahl"), F.array_join(F.sort_array(F.collect_set(key)), "; ").alias("schluessel"))
    return names.where("anzahl > 1")


def equal_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, a, b``: pairs of fields of one row with the same text."""
    hits = [F.when((F.trim(F.col(a)) != "") & (F.col(a) == F.col(b)), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))) for i, a in enumerate(fields) for b in fields[i + 1 :]]
    return rows.select(key, F.explode(F.array_compact(F.array(*hits))).alias("p")).select(key, "p.a", "p.b")


def reasons(rows: DataFrame, column: str) -> DataFrame:
    """``grund, anzahl`` of reasons joined by "; "."""
    return rows.where(f"{column} <> ''").select(F.explode(F.split(column, "; ")).alias("grund")).groupBy("grund").agg(F.count(F.lit(1)).alias("anzahl"))


def report(module: DataFrame, literature: DataFrame, fields: list[str], competences: list[str]) -> DataFrame:
    """Findings on modules and their literature."""
    per_module = literature.groupBy("modulnummer").agg(F.count(F.lit(1)).alias("n"))
    numbers = literature.agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("lit_key").alias("keys"), F.count_if("parse_unsicher").alias("doubtful"), F.count_if(F.coalesce(F.col("ort"), F.lit("")) == "").alias("placeless"),
    )
    middle = per_module.agg(F.percentile("n", 0.5).alias("m"))
    empty = empty_fields(module, "zeile_id", fields)
    parts = [
        _row(module.agg(F.count(F.lit(1)).alias("n")), "Module", "Zeilen", value=F.col("n")),
        _row(numbers, "Literatur", "Einträge", value=F.col("entries")),
        _row(numbers, "Literatur", "verschiedene Schlüssel", value=F.col("keys")),
        _row(numbers, "Literatur", "unsicher", value=F.col("doubtful"), details=F.format_string("%.1f %%", F.lit(100.0) * F.col("doubtful") / F.nullif(F.col("entries"), F.lit(0)))),
        _row(numbers, "Literatur", "ohne Ort", value=F.col("placeless")),
        _row(middle, "Literatur", "Einträge je Modul (Median)", value=F.col("m").cast("bigint")),
        _row(reasons(literature, "unsicher_grund"), "Literatur", "Grund der Unsicherheit", value=F.col("anzahl"), details=F.col("grund")),
        _row(empty, "Module", "leeres Feld", key=F.col("schluessel"), value=F.col("anzahl"), details=F.col("feld")),
        _row(module.join(per_module, "modulnummer", "left_anti"), "Module", "ohne Literatur", key=F.col("modulnummer")),
        _row(equal_fields(module, "zeile_id", competences), "Kompetenzen", "gleicher Text", key=F.col("zeile_id"), details=F.concat_ws(" = ", "a", "b")),
        _row(repeated(literature.where("lit_key is not null"), ["modulnummer", "lit_key"], "lit_id"), "Literatur", "doppelt", key=F.col("modulnummer"), details=F.col("lit_key")),
        _row(shared_names(module, "modulnummer", "modulname"), "Module", "gleicher Name", key=F.col("schluessel"), value=F.col("anzahl"), details=F.col("modulname")),
    ]
    return reduce(DataFrame.unionByName, parts)


def point_report(module: DataFrame, points: DataFrame) -> DataFrame:
    """Findings on the points of modules, of which ``points`` is kept: it comes from a costly parse."""
    counted = points.groupBy("zeile_id").agg(F.count(F.lit(1)).alias("n"))
    few = _row(module.select("zeile_id").join(counted.where("n > 1"), "zeile_id", "left_anti"), "Stichpunkte", "höchstens einer", key=F.col("zeile_id"))
    odd = _row(points.where("length(stichpunkt) < 4 or length(stichpunkt) > 300"), "Stichpunkte", "auffällige Länge", key=F.col("zeile_id"), value=F.length("stichpunkt"), details=F.substring("stichpunkt", 1, 80))
    return few.unionByName(odd)

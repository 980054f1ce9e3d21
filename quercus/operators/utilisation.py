"""Utilisation of entities by academic year from a wide table of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.functions.text import cell_kind, cell_number


def long_cells(runs: DataFrame, code: str, capacity: str, terms: dict[str, list[str]]) -> DataFrame:
    """``code, jahr, art, n, max_n, aktiv``: one row per cell; terms maps a year to its term columns.

    aktiv: whether the run has any filled cell in the years looked at.
    """
    columns = [c for cs in terms.values() for c in cs]
    filled = F.lit(False)
    for c in columns:
        filled = filled | F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    cells = F.explode(F.array(*[F.struct(F.lit(y).alias("jahr"), F.col(c).alias("zelle")) for y, cs in terms.items() for c in cs]))
    flat = runs.select(F.trim(F.col(code)).alias("code"), cell_number(F.col(capacity)).alias("max_n"), filled.alias("aktiv"), cells.alias("c"))
    kind = cell_kind(F.col("c.zelle"))
    return flat.select("code", F.col("c.jahr").alias("jahr"), kind.alias("art"), F.when(kind == "held", cell_number(F.col("c.zelle"))).alias("n"), "max_n", "aktiv")


def utilisation(runs: DataFrame, code: str, capacity: str, terms: dict[str, list[str]]) -> DataFrame:
    """Per code: participants by year, runs held and cancelled, participants per year and run,
    largest capacity of active runs, and how full a run is. Cells of other text are ignored
    (a strict reader would fail on them). One aggregation, combined map-side."""
    cells = long_cells(runs, code, capacity, terms).where("code is not null and code <> ''")
    years = list(terms)
    sums = [F.coalesce(F.sum(F.when(F.col("jahr") == y, F.col("n"))), F.lit(0)).alias(f"jahr_{i + 1}") for i, y in enumerate(years)]
    out = cells.groupBy("code").agg(
        *sums,
        F.count_if(F.col("art") == "held").alias("durchf"),
        F.count_if(F.col("art") == "cancelled").alias("abgesagt"),
        F.max(F.when(F.col("aktiv"), F.col("max_n"))).alias("max_tn"),
    )
    total = sum((F.col(f"jahr_{i + 1}") for i in range(len(years))), F.lit(0))
    per_run = total / F.nullif(F.col("durchf"), F.lit(0))
    return out.select(
        "*", (total / len(years)).alias("je_jahr"), per_run.alias("je_durchf"), (per_run / F.nullif(F.col("max_tn"), F.lit(0))).alias("quote")
    )


def unmatched(codes: DataFrame, code: str, runs: DataFrame, run_code: str) -> DataFrame:
    return codes.select(code).where(F.col(code).isNotNull()).distinct().join(runs.select(F.trim(F.col(run_code)).alias(code)).where(F.col(code).isNotNull()), code, "left_anti")

"""Pairs of entities: universe, standardising, weighted combination, percentiles, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_universe(entities: DataFrame, key: str) -> DataFrame:
    """All unordered pairs ``a < b`` of a bounded entity table (a dimension, a set of groups).

    The result is quadratic by definition; it is meant for tables whose size doesn't grow
    with the data. The smaller copy is broadcast and the join is a nested loop on ``a < b``.
    """
    e = entities.select(key).where(F.col(key).isNotNull()).distinct()
    return e.select(F.col(key).alias("a")).join(e.select(F.col(key).alias("b")), F.col("a") < F.col("b"))


def zscores(pairs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Standard scores of ``columns`` (value: name of its score) over all pairs by population deviation;
    nulls are skipped, a deviation of 0 counts as 1.

    One partial aggregation to a single row for all of them, which is broadcast: no shuffle of the pairs.
    """
    stats = pairs.agg(*[f(c).alias(f"_{k}{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {z: (F.col(c) - F.col(f"_m{c}")) / F.when(F.col(f"_s{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s{c}")) for c, z in columns.items()}
    return pairs.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*stats.columns)


def zscore(pairs: DataFrame, value: str, into: str) -> DataFrame:
    return zscores(pairs, {value: into})


def combine(values: dict[str, float], none: float | None = None):
    """Weighted mean of columns, renormalised over those that are not null and weigh something."""
    used = {c: w for c, w in values.items() if w}
    if not used:
        return F.lit(none).cast("double")
    top = sum((F.coalesce(F.col(c), F.lit(0.0)) * F.lit(float(w)) for c, w in used.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNull(), 0.0).otherwise(float(w)) for c, w in used.items()), F.lit(0.0))
    mean = top / F.nullif(weight, F.lit(0.0))
    return mean if none is None else F.coalesce(mean, F.lit(none))


def percentile_rank(pairs: DataFrame, value: str, into: str) -> DataFrame:
    """Rank over count with average ties, nulls kept apart.

    No window over all rows in one task: equal values are counted first, ranges of distinct
    values get prefix sums, and the ranks go back by an equi-join.
    """
    counts = pairs.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    buckets = counts.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_c").alias("_n"))
    counts = counts.crossJoin(F.broadcast(buckets))
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
    counts = counts.withColumn("_b", F.floor((F.col(value) - F.col("_lo")) / width * 1024))
    before = counts.groupBy("_b").agg(F.sum("_c").alias("_s")).select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_before"))
    inside = F.sum("_c").over(Window.partitionBy("_b").orderBy(value))
    ranks = counts.withColumn("_upto", inside).join(F.broadcast(before), "_b")
    ranks = ranks.select(value, ((F.col("_before") + F.col("_upto") - (F.col("_c") - 1) / 2.0) / F.col("_n")).alias(into))
    return pairs.join(ranks, value, "left")


def quantiles(pairs: DataFrame, value: str, steps: int = 1000) -> DataFrame:
    """``stufe, wert``: the quantile vector by linear interpolation, from ``steps`` + 1 grades."""
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    return pairs.agg(F.percentile(value, grid).alias("q")).select(F.posexplode("q").alias("stufe", "wert"))


def percentile_in(z, vector):
    """Percentile (0 to 100) of a value against an ascending quantile vector (an array column):
    plateaus count their middle, between grades it is interpolated, outside it is clamped."""
    last = F.size(vector) - 1
    below = F.size(F.filter(vector, lambda q: q < z))
    upto = F.size(F.filter(vector, lambda q: q <= z))
    lower, upper = F.get(vector, below - 1), F.get(vector, below)
    between = (below - 1) + (z - lower) / F.nullif(upper - lower, F.lit(0.0))
    plateau = (below + upto - 1) / 2.0
    place = F.when(upto == 0, 0.0).when(below > last, last.cast("double")).when(upto > below, plateau).otherwise(between)
    return F.when(z.isNull(), None).otherwise(place / last * 100.0)


def mirrored(pairs: DataFrame, *values: str) -> DataFrame:
    """Both directions of every pair: ``a, b`` and values."""
    return pairs.select("a", "b", *values).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *values))


def top_neighbours(pairs: DataFrame, value: str, n: int) -> DataFrame:
    """The ``n`` best partners of each entity, ``rang`` from 1, ties by partner.

    The window's rank filter is pushed below the shuffle as a per-partition limit.
    """
    w = Window.partitionBy("a").orderBy(F.desc_nulls_last(value), "b")
    return mirrored(pairs, value).withColumn("rang", F.row_number().over(w)).where(F.col("rang") <= n)


def evidence(pairs: DataFrame, total: str, singles: list[str], shared: str, least_total: float, least_single: float) -> DataFrame:
    """Pairs worth explaining: total or a single dimension high, or anything shared."""
    keep = (F.col(total) >= least_total) | (F.col(shared) > 0)
    for c in singles:
        keep = keep | (F.col(c) >= least_single)
    return pairs.where(keep)

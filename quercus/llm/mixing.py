"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.llm.ranges import running_size

#: Documents in a block of a source, on average: the unit of the distributed running sum.
BLOCK = 5_000


def fair_mix(
    docs: DataFrame,
    targets: DataFrame,
    budget: float | None = None,
    seed: int = 7,
    key: str = "doc_id",
    source: str = "source",
    size: str = "tokens",
    weight: str = "zielanteil",
    repeats: str = "max_wiederholung",
) -> DataFrame:
    """Records of the mix in the order of their virtual finish times.

    Every source queues its documents in the order of a seeded hash, its whole queue up
    to ``repeats`` times over (round ``kopie`` from 1). A document's virtual finish time
    is the source's cumulative size up to and with it, divided by the target weight. The
    mix is all documents in the order of these times up to the budget: sources whose
    queue lasts get sizes in the ratio of their weights at any moment, a source that ends
    keeps what it has, and the others fill the rest. At the cut no source that lasts is
    away from its share by more than one document.

    Without ``budget`` the mix is as large as the usable documents of all sources together,
    each counted once.

    Returns ``key, source, kopie, tokens, fertig, bis`` where fertig is the virtual
    finish time and bis the mix's running size with it. Sorting by (fertig, source, key)
    gives the sequence.

    Scale: running sums are taken per block - a hash range of a source, about BLOCK
    documents - and offset by the sums of the blocks before, so a source with a third of
    all rows is no single task; the global running size goes by ranges of a global sort,
    see ``ranges.running_size``. The targets are as many rows as there are sources and are broadcast.

    Defined cases: null sources or sources without target are not used; null or
    non-positive sizes are not used (nothing to share); a null key is not used; a null,
    nought or negative weight or cap gives nothing of that source; repeated rows of a
    key are queued each for itself; empty tables give no rows.
    """
    goals = targets.select(F.col(source).alias("s"), F.col(weight).cast("double").alias("w"), F.col(repeats).cast("int").alias("r"))
    goals = goals.where("s is not null and w > 0 and r > 0").groupBy("s").agg(F.max("w").alias("w"), F.max("r").alias("r"))
    rows = docs.select(F.col(key).alias("d"), F.col(source).alias("s"), F.col(size).cast("long").alias("z"))
    rows = rows.where("d is not null and z > 0").join(F.broadcast(goals), "s")
    sums = rows.groupBy("s", "w", "r").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("all"))
    h = F.pmod(F.xxhash64(F.lit(seed), "s", "d"), F.lit(1 << 40))
    rows = rows.join(F.broadcast(sums.select("s", "n", "all")), "s").select(
        "s", "d", "z", "w", "r", "all", h.alias("h"),
        F.floor(h * F.ceil(F.col("n") / BLOCK) / F.lit(float(1 << 40))).alias("block"),
    )
    before = (
        rows.groupBy("s", "block").agg(F.sum("z").alias("b"))
        .select("s", "block", (F.sum("b").over(Window.partitionBy("s").orderBy("block")) - F.col("b")).alias("before"))
    )
    within = Window.partitionBy("s", "block").orderBy("h", "d", "z").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = (
        rows.withColumn("run", F.sum("z").over(within)).join(before, ["s", "block"])
        .withColumn("run", F.col("run") + F.col("before"))
        .withColumn("kopie", F.explode(F.sequence(F.lit(1), F.col("r"))))
        .withColumn("fertig", ((F.col("kopie") - 1) * F.col("all") + F.col("run")) / F.col("w"))
        .select("s", "d", "kopie", "z", "fertig")
    )
    limit = F.lit(float(budget)) if budget is not None else F.sum("all").cast("double")
    ends = sums.agg(limit.alias("limit"))
    return running_size(queue, ["fertig", "s", "d", "kopie"], "z", "bis").crossJoin(F.broadcast(ends)).where("bis <= limit").select(
        F.col("d").alias(key), F.col("s").alias(source), F.col("kopie").cast("int").alias("kopie"), F.col("z").alias(size), "fertig", "bis"
    )


def shares(
    mix: DataFrame,
    docs: DataFrame,
    targets: DataFrame,
    source: str = "source",
    size: str = "tokens",
    weight: str = "zielanteil",
    repeats: str = "max_wiederholung",
) -> DataFrame:
    """Target and actual share of every source of ``targets``.

    Returns ``source, zielanteil, anteil, saetze, tokens, max_kopie, vorrat`` where
    saetze is the number of records used, vorrat what the source could give at most.
    A source without documents has share 0; an empty mix gives null shares.
    """
    used = mix.groupBy(source).agg(F.count(F.lit(1)).alias("saetze"), F.sum(size).alias("tokens"), F.max("kopie").alias("max_kopie"))
    stock = docs.where(F.col(size) > 0).groupBy(source).agg(F.sum(size).alias("stock"))
    out = targets.select(source, weight, repeats).join(used, source, "left").join(stock, source, "left")
    n = F.coalesce(F.col("tokens"), F.lit(0))
    return out.select(
        source, F.col(weight).alias("zielanteil"), (n / F.nullif(F.sum(n).over(Window.partitionBy()), F.lit(0))).alias("anteil"),
        F.coalesce("saetze", F.lit(0)).alias("saetze"), n.alias("tokens"), F.coalesce("max_kopie", F.lit(0)).alias("max_kopie"),
        (F.coalesce("stock", F.lit(0)) * F.col(repeats)).alias("vorrat"),
    )

"""Consolidating pairwise matches into groups by hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.session import cut_lineage, fingerprint

#: So many rows any task holds, hub or not.
PLAIN = 500_000
#: A vertex in more than 1/HOT of the rows is hot; there are fewer than HOT of them, whatever the data.
HOT = 2048


def with_least(sets: DataFrame, rows: int) -> DataFrame:
    """``v, u, m``: the sets (v, u), ``rows`` in number, with the least member of each vertex.

    The least member is aggregated map-side. To a hot vertex it comes by broadcast - fewer
    than HOT rows - so its rows stay in the tasks that hold them; only the others are
    shuffled for the join. Up to PLAIN rows in all, one join is less work.
    """
    if rows <= PLAIN:
        return sets.join(sets.groupBy("v").agg(F.min("u").alias("m")), "v")
    least = sets.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
    hot = least.where(F.col("n") * HOT > rows).select("v", "m")
    marked = sets.join(F.broadcast(hot), "v", "left")
    cold = marked.where("m is null").select("v", "u").join(least.where(F.col("n") * HOT <= rows).select("v", "m"), "v")
    return marked.where("m is not null").select("v", "u", "m").unionByName(cold.select("v", "u", "m"))


def hash_to_min(pairs: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Group identifier of every key that a pair links directly or over others.

    Each vertex keeps a cluster set, at first its neighbours and itself. In every
    round it sends the whole set to the smallest member and that member to all
    others; the union of what a vertex receives is its next set. When no set
    changes any more, the smallest member of a vertex's set is the smallest key of
    its component.

    The sets are rows ``(v, u)``, never arrays: a component that holds a third of
    all keys is spread over the partitions by the hash of both columns. Only the
    minimum is aggregated by vertex, and it is joined back without gathering a hot
    vertex in one task, see ``with_least``. Each round is checkpointed in the shared
    folder.

    Returns ``key, gruppe``: every key of a pair with both keys present, gruppe the
    smallest key of its component by code point.

    Defined cases: pairs with a null key are no pairs; the empty string is a key
    like any other; repeated and reversed pairs count once; a key paired only with
    itself is a group of its own; an empty input gives no rows; other columns of
    ``pairs`` are ignored. Raises if ``max_rounds`` does not suffice (rounds grow
    with the logarithm of the longest chain).
    """
    both = pairs.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null")
    links = both.select(F.least("v", "u").alias("v"), F.greatest("v", "u").alias("u")).distinct()
    sets = links.select(
        F.explode(
            F.array(
                F.struct(F.col("v"), F.col("u")),
                F.struct(F.col("u").alias("v"), F.col("v").alias("u")),
                F.struct(F.col("v"), F.col("v").alias("u")),
                F.struct(F.col("u").alias("v"), F.col("u").alias("u")),
            )
        ).alias("s")
    ).select("s.v", "s.u")
    sets = cut_lineage(sets.distinct())
    state = fingerprint(sets, "v", "u")
    for _ in range(max_rounds):
        sent = with_least(sets, state[0]).select(
            F.explode(
                F.array(
                    F.struct(F.col("m").alias("v"), F.col("u").alias("u")),
                    F.struct(F.col("u").alias("v"), F.col("m").alias("u")),
                )
            ).alias("s")
        )
        sets = cut_lineage(sent.select("s.v", "s.u").distinct())
        now = fingerprint(sets, "v", "u")
        if now == state:
            return sets.groupBy("v").agg(F.min("u").alias("gruppe")).select(F.col("v").alias("key"), "gruppe")
        state = now
    raise RuntimeError(f"hash_to_min: not stable after {max_rounds} rounds")

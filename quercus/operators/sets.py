"""Sets of keys per entity: rarity, weighted overlap, canonical keys, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.functions.text import indel_ratio
from quercus.session import cut_lineage, fingerprint, spread


def item_idf(items: DataFrame, entity: str, item: str) -> DataFrame:
    """``item, df, idf``: ln(entities with any item / df) + 1."""
    distinct = items.select(entity, item).where(F.col(entity).isNotNull() & F.col(item).isNotNull()).distinct()
    n = distinct.agg(F.count_distinct(entity).alias("_n"))
    df = distinct.groupBy(item).agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select(item, "df", (F.log(F.col("_n") / F.col("df")) + 1.0).alias("idf"))


def rarest_shared(items: DataFrame, entity: str, item: str, n: int) -> DataFrame:
    """``a, b, rang, item, df`` for a < b: the ``n`` rarest items that each pair shares, ties by item.

    For entities of a bounded number. Items with the same owners are alike to every pair, so
    only the n first of each set of owners can be among a pair's n rarest (they have one df).
    What fans out to pairs goes in order of df: first the rarest quarter of the items; only
    pairs that find fewer than n there meet the others.
    """
    distinct = items.select(F.col(entity).alias("e"), F.col(item).alias("i")).where("e is not null and i is not null").distinct()
    owners = distinct.groupBy("i").agg(F.sort_array(F.collect_list("e")).alias("es"), F.count(F.lit(1)).alias("df")).where("df > 1")
    first = Window.partitionBy("es").orderBy("i")
    owners = cut_lineage(owners.withColumn("r", F.row_number().over(first)).where(F.col("r") <= n).drop("r"))
    order = Window.partitionBy("a", "b").orderBy("df", "i")

    def best(of: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
        each = of.select("i", "df", "es", F.posexplode("es").alias("k", "a")).select("a", F.explode(F.slice("es", F.col("k") + 2, F.size("es"))).alias("b"), "i", "df")
        each = each if wanted is None else each.join(F.broadcast(wanted), ["a", "b"], "left_semi")
        return each.withColumn("rang", F.row_number().over(order)).where(F.col("rang") <= n)

    middle = owners.agg(F.percentile_approx("df", 0.25)).first()[0]
    if middle is None:
        return best(owners).select("a", "b", "rang", F.col("i").alias(item), "df")
    rare = cut_lineage(best(owners.where(F.col("df") <= middle)))
    # every pair of entities of a bounded number: whether the rare items are enough
    es = cut_lineage(distinct.select("e").distinct())
    full = rare.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= n).select("a", "b")
    short = cut_lineage(es.select(F.col("e").alias("a")).join(es.select(F.col("e").alias("b")), F.col("a") < F.col("b")).join(full, ["a", "b"], "left_anti"))
    out = rare.join(short, ["a", "b"], "left_anti")
    if not short.isEmpty():
        out = out.unionByName(best(owners, short))
    return out.select("a", "b", "rang", F.col("i").alias(item), "df")


def idf_dice(pairs: DataFrame, items: DataFrame, entity: str, item: str) -> DataFrame:
    """``a, b, dice, gemeinsam``: twice the rarity shared over the rarity of both sets.

    0 where both have items and share none, null where either has none. For entities of a
    bounded number: an item's owners are a list of at most that many.
    """
    idf = item_idf(items, entity, item)
    sets = items.select(entity, item).distinct().join(idf, item).groupBy(entity).agg(F.sum("idf").alias("w"))
    # items that the same entities have count alike: their number is bounded by the sets of entities, not by the items
    owners = items.select(entity, item).distinct().groupBy(item).agg(F.sort_array(F.collect_list(entity)).alias("es"))
    owners = owners.join(idf, item).groupBy("es").agg(F.sum("idf").alias("s"), F.count(F.lit(1)).alias("n")).where(F.size("es") > 1)
    left_ = owners.select("es", "s", "n", F.posexplode("es").alias("i", "a"))
    each = left_.select("a", "s", "n", F.explode(F.slice("es", F.col("i") + 2, F.size("es"))).alias("b"))
    shared = each.groupBy("a", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    left = sets.select(F.col(entity).alias("a"), F.col("w").alias("wa"))
    right = sets.select(F.col(entity).alias("b"), F.col("w").alias("wb"))
    out = pairs.select("a", "b").join(left, "a", "left").join(right, "b", "left").join(shared, ["a", "b"], "left")
    return out.select("a", "b", (F.lit(2.0) * F.coalesce("s", F.lit(0.0)) / (F.col("wa") + F.col("wb"))).alias("dice"), F.coalesce("n", F.lit(0)).alias("gemeinsam"))


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """``key, gruppe``: smallest key of each component by min-label propagation with a jump
    over the label's own label. Every round is two equi-joins and a checkpoint."""
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null")
    e = cut_lineage(e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct())
    labels = e.groupBy("v").agg(F.min(F.least("u", "v")).alias("m"))
    state = None
    for _ in range(max_rounds):
        near = e.join(labels.select(F.col("v").alias("u"), "m"), "u").groupBy("v").agg(F.min("m").alias("n"))
        moved = labels.join(near, "v").select("v", F.least("m", "n").alias("m"))
        jump = labels.select(F.col("v").alias("m"), F.col("m").alias("mm"))
        labels = cut_lineage(moved.join(jump, "m", "left").select("v", F.least("m", F.coalesce("mm", "m")).alias("m")))
        now = fingerprint(labels, "v", "m")
        if now == state:
            return labels.select(F.col("v").alias("key"), F.col("m").alias("gruppe"))
        state = now
    raise RuntimeError("components: not stable")


#: Titles of one author from which candidates meet by their segments instead of all with all.
MANY = 200


def _segment_pairs(k: DataFrame, threshold: float) -> DataFrame:
    """``k, title, k2, title2`` of authors with many titles: pairs that can have an indel ratio of ``threshold``.

    A ratio of t means at most (1 - t / 100) (la + lb) insertions and losses. The longer title
    is cut into one segment more than that many; one of them stands unchanged in the other,
    shifted by no more places. Segments meet by author, length, number, place and characters.
    """
    slack = 1.0 - threshold / 100.0
    rows = k.select("author", "k", "title", F.length("title").alias("n"))
    shortest = F.ceil(F.col("n") * (threshold / (200.0 - threshold)) - 1e-9).cast("int")
    # edits allowed to the longest pair of this length, and the segments they leave
    edits = F.floor(F.lit(2.0 * slack) * F.col("l") + 1e-9).cast("int")
    size = F.greatest(F.floor(F.col("l") / (edits + 1)), F.lit(1)).cast("int")
    index = rows.withColumn("l", F.col("n")).withColumn("e", edits).withColumn("w", size).select("author", "k", "title", "l", "w", F.explode(F.sequence(F.lit(0), F.col("e"))).alias("i"))
    index = index.select("author", "l", "i", F.substr("title", F.col("i") * F.col("w") + 1, F.col("w")).alias("seg"), F.col("k").alias("k2"), F.col("title").alias("title2"))
    probe = rows.select("author", "k", "title", "n", F.explode(F.sequence(F.col("n"), F.ceil(F.col("n") / (threshold / (200.0 - threshold)) + 1e-9).cast("int"))).alias("l"))
    probe = probe.withColumn("e", edits).withColumn("w", size).select("author", "k", "title", "n", "l", "e", "w", F.explode(F.sequence(F.lit(0), F.col("e"))).alias("i"))
    place = F.col("i") * F.col("w")
    probe = probe.select("author", "k", "title", "l", "i", "w", F.explode(F.sequence(F.greatest(place - F.col("e"), F.lit(0)), F.greatest(place - F.col("e"), F.least(place + F.col("e"), F.col("n") - F.col("w")), F.lit(0)))).alias("at"))
    probe = probe.select("author", "k", "title", "l", "i", F.substr("title", F.col("at") + 1, F.col("w")).alias("seg")).distinct()
    return probe.join(index, ["author", "l", "i", "seg"]).where("k <> k2").select("k", "title", "k2", "title2").distinct()


def canonical_keys(keys: DataFrame, key: str, threshold: float = 88.0) -> DataFrame:
    """``key, kanon``: keys of one author whose title parts are nearly the same, as the smallest of them.

    Candidates meet in an equi-join on the author part and a band of title lengths: an
    indel ratio of t needs the shorter title to have t / (200 - t) of the longer's length.
    Of authors with more than MANY titles (as works without one) only those meet that share
    a segment, which loses none. Keys without a title part stay alone.
    """
    k = keys.select(F.col(key).alias("k")).where(F.col("k").isNotNull()).distinct()
    k = cut_lineage(k.select("k", F.substring_index("k", "_", 1).alias("author"), F.regexp_extract("k", r"^[^_]*_(.*)$", 1).alias("title")).where("title <> ''"))
    many = k.groupBy("author").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY).select("author")
    few = k.join(many, "author", "left_anti")
    other = few.select(F.col("k").alias("k2"), "author", F.col("title").alias("title2"))
    ratio = threshold / (200.0 - threshold)
    fits = F.least(F.length("title"), F.length("title2")) >= ratio * F.greatest(F.length("title"), F.length("title2"))
    pairs = few.join(other, "author").where(F.col("k") < F.col("k2")).select("k", "title", "k2", "title2")
    pairs = pairs.unionByName(_segment_pairs(k.join(many, "author", "left_semi"), threshold)).where(fits)
    groups = components(spread(pairs).where(indel_ratio(F.col("title"), F.col("title2")) >= threshold), "k", "k2")
    all_keys = keys.select(F.col(key).alias("key")).where(F.col("key").isNotNull()).distinct()
    return all_keys.join(groups, "key", "left").select("key", F.coalesce("gruppe", "key").alias("kanon"))


def key_frequency(rows: DataFrame, key: str, entity: str, example: str, order: str) -> DataFrame:
    """``key, anzahl, entities`` (descending, joined by "; ") and the first example of each key.

    Null, empty and ``ohneautor`` keys are left out.
    """
    kept = rows.where((F.col(key) != "") & ~F.col(key).startswith("ohneautor"))
    return kept.groupBy(key).agg(
        F.count_distinct(entity).alias("anzahl"),
        F.array_join(F.sort_array(F.collect_set(entity), asc=False), "; ").alias("entities"),
        F.min_by(example, F.struct(order, example)).alias("beispiel"),
    )

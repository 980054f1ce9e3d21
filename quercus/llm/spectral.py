"""Grouping records into similarity clusters by power-iteration spectral clustering."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quercus.llm.components import hash_to_min, with_least
from quercus.llm.ranges import numbered
from quercus.session import cut_lineage, fingerprint

#: Vectors iterated at once, rounds of the iteration, rounds between two looks at what is tight.
VECTORS, ROUNDS, EVERY = 4, 18, 6
#: Widest distance of a member from its k-means centre. The embedding is scaled so that a
#: weak bridge parts a component by about 1 whatever its size, see ``embedding``.
RADIUS = 0.5
#: Rounds of k-means after which centres count as stable (they are after a few).
LLOYD = 40
# Phrases that link a point to the text before it, in German running text.
LINKING = ["behandelt wird", "thema ist", "hinzu kommt", "ferner", "außerdem", "weiterhin"]


def point_tokens(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``k, t``: the distinct points and sentences of a record as 64-bit hashes of their letters.

    Lines and sentences are points; case, signs, digits and linking phrases don't count;
    points of fewer than seven letters are no mark of a record.
    """
    cut = r"(?<=[\p{L}0-9)%][.!?])\s+|[\r\n]+"
    points = texts.select(F.col(key).alias("k"), F.explode(F.split(text, cut)).alias("p"))
    letters = F.regexp_replace(F.regexp_replace(F.lower(F.trim("p")), rf"^(?:{'|'.join(LINKING)})\b", ""), r"[^\p{L}]", "")
    return points.select("k", letters.alias("p")).where("length(p) >= 7").select("k", F.xxhash64("p").alias("t")).distinct()


def affinities(tokens: DataFrame, overlap: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """Sparse affinities of distinct records: ``(members, edges)``.

    ``members`` (k, rep) maps every record to the smallest one with the same points.
    ``edges`` (a, b, w), a < b, has pairs of representatives whose shared points weigh at
    least ``overlap`` of those of the lighter one. A point weighs ln(N / df), so that
    sentences that stand everywhere count little, and what is shared must weigh at least
    1.5 ln N, more than any few of these do.

    Candidates: the points of a record are ordered from the rarest on. Whatever two records
    share, its first point has all the rest behind it, so it lies where that point and those
    behind it weigh at least what must be shared: ``overlap`` of the lighter one's weight and
    1.5 ln N for the lighter, 1.5 ln N for the heavier. Records are compared when such heads
    have a point in common, which misses no pair. Points that stand everywhere are at the
    end of the order and hardly ever in a head; a family of alike records costs its pairs.
    """
    sets = tokens.groupBy("k").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    sets = cut_lineage(sets.withColumn("h", F.xxhash64("ts", F.size("ts"))))
    members = with_least(sets.select(F.col("h").alias("v"), F.col("k").alias("u")), sets.count()).select(F.col("u").alias("k"), F.col("m").alias("rep"))
    reps = sets.groupBy("h").agg(F.min("k").alias("rep"), F.first("ts").alias("ts")).select("rep", "ts")
    reps = cut_lineage(reps)
    flat = reps.select("rep", F.explode("ts").alias("t"))
    n = reps.agg(F.greatest(F.count(F.lit(1)), F.lit(2)).cast("double").alias("n"))
    common_points = flat.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = cut_lineage(flat.join(common_points, "t").crossJoin(F.broadcast(n)).select("rep", "t", "df", F.log(F.col("n") / F.col("df")).alias("w"), F.log("n").alias("top")))
    # what only one record has weighs ln N
    weights = shared.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("t", "w"))).alias("m"), F.max("top").alias("top"))
    weights = weights.join(reps.select("rep", F.size("ts").alias("size")), "rep")
    total = F.aggregate(F.map_values("m"), F.lit(0.0), lambda s, x: s + x) + (F.col("size") - F.size("m")) * F.col("top")
    weights = cut_lineage(weights.select("rep", "m", total.alias("total"), "top"))
    # a hair less, as sums of doubles differ in their last digits
    behind = Window.partitionBy("rep").orderBy("df", "t").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    heads = shared.withColumn("rest", F.sum("w").over(behind) + 1e-6).where(F.col("rest") >= 1.5 * F.col("top")).join(weights.select("rep", "total"), "rep")
    heads = cut_lineage(heads.select("rep", "t", "total", (F.col("rest") >= overlap * F.col("total")).alias("light")))
    light = heads.where("light").select("t", F.col("rep").alias("x"), F.struct("total", "rep").alias("ox"))
    heavy = heads.select("t", F.col("rep").alias("y"), F.struct("total", "rep").alias("oy"))
    candidates = light.join(heavy, "t").where("ox < oy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    left = weights.select(F.col("rep").alias("a"), F.col("m").alias("ma"), F.col("total").alias("ta"), "top")
    right = weights.select(F.col("rep").alias("b"), F.map_keys("m").alias("kb"), F.col("total").alias("tb"))
    both = candidates.join(left, "a").join(right, "b")
    common = F.aggregate(F.array_intersect(F.map_keys("ma"), "kb"), F.lit(0.0), lambda s, t: s + F.element_at("ma", t))
    edges = both.select("a", "b", common.alias("common"), F.least("ta", "tb").alias("least"), "top")
    edges = edges.where((F.col("common") >= overlap * F.col("least")) & (F.col("common") >= 1.5 * F.col("top")))
    return members, edges.select("a", "b", (F.col("common") / F.col("least")).alias("w"))


def _vector(i: int) -> Column:
    return F.pmod(F.xxhash64("v", F.lit(i)), F.lit(1 << 30)) / F.lit(float(1 << 30))


NAMES = [f"x{i}" for i in range(VECTORS)]
#: Deviation of the start values, which are even in [0, 1).
START = 12**-0.5


def walk_steps(edges: DataFrame) -> DataFrame:
    """``v, u, p``: the lazy random walk, the row-normalised sparse affinities: half of a step stays."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u"), "w").unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u"), "w"))
    degree = both.groupBy("v").agg(F.sum("w").alias("d"))
    return both.join(degree, "v").select("v", "u", (F.col("w") / F.col("d") / 2).alias("p")).unionByName(degree.select("v", F.col("v").alias("u"), F.lit(0.5).alias("p")))


def embedding(edges: DataFrame, parts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``v, part, x0..``: VECTORS random vectors after ``rounds`` steps of the lazy walk, centred and scaled.

    A step gives every vertex half of its own value and half of the mean of its neighbours',
    weighted by affinity, for all vectors in one join and one aggregation. The walk's
    eigenvectors of value 1 are the components (``parts``: v, part): in each the values
    tend to one mean. What is left of them beside it is the slow eigenvectors: with m
    vertices, values that start with deviation s and a second eigenvalue l it is about
    ``s * l^rounds / sqrt(m)``. So values are taken relative to their component's mean, times
    ``sqrt(m) / s``: nought inside a well-knit component, about 1 on either side of a weak bridge.

    The range of values within a component never grows. One whose range, thus scaled, is
    under RADIUS after some rounds would be no cluster to split after all of them, and is not
    walked further; its vertices lie at nought.
    """
    size = parts.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    steps = cut_lineage(walk_steps(edges).join(parts, "v"))
    x = cut_lineage(parts.select("v", "part", *[_vector(i).alias(n) for i, n in enumerate(NAMES)]))
    tight: list[DataFrame] = []
    for done in range(EVERY, rounds + EVERY, EVERY):
        for _ in range(min(EVERY, rounds - done + EVERY)):
            x = steps.join(x.select(F.col("v").alias("u"), *NAMES), "u").groupBy("v", "part").agg(*[F.sum(F.col("p") * F.col(n)).alias(n) for n in NAMES])
        x = cut_lineage(x)
        if done >= rounds:
            break
        width = F.sqrt(sum((F.max(n) - F.min(n)) ** 2 for n in NAMES)).alias("width")
        loose = x.groupBy("part").agg(width).join(size, "part").where(F.col("width") * F.sqrt("m") / START > RADIUS).select("part")
        loose = cut_lineage(loose)
        tight.append(x.join(loose, "part", "left_anti").select("v", "part", *[F.lit(0.0).alias(n) for n in NAMES]))
        if loose.isEmpty():
            return reduce(DataFrame.unionByName, tight)
        x, steps = cut_lineage(x.join(loose, "part", "left_semi")), cut_lineage(steps.join(loose, "part", "left_semi"))
    means = x.groupBy("part").agg(*[F.avg(n).alias(f"m{n}") for n in NAMES]).join(size, "part")
    out = x.join(means, "part").select("v", "part", *[((F.col(n) - F.col(f"m{n}")) * F.sqrt("m") / START).alias(n) for n in NAMES])
    return reduce(DataFrame.unionByName, tight, out)


def _distance(prefix: str) -> Column:
    return F.sqrt(sum((F.col(n) - F.col(f"{prefix}{n}")) ** 2 for n in NAMES))


def k_means(x: DataFrame) -> DataFrame:
    """``v, cluster`` of an embedding (v, part, x0..): k-means, the number of clusters found on the way.

    Vertices of different components are never near one another - their eigenvectors of
    value 1 differ - so all components are clustered at once, each with one centre to begin
    with. Wherever a cluster is wider than RADIUS, two centres are seeded from the embedding:
    the member farthest from the centre, and the member farthest from that one. Members go to
    the nearer centre, centres to the mean of their members, until no member moves. Then
    widths are looked at again; it ends when no cluster is too wide, as both seeds keep a
    member. A member meets two centres a round, however many there are.
    """
    wide = x.withColumn("c", F.col("part").cast("string"))
    done: list[DataFrame] = []
    for depth in count():
        centre = wide.groupBy("part", "c").agg(*[F.avg(n).alias(f"c{n}") for n in NAMES])
        far = wide.join(centre, ["part", "c"]).groupBy("part", "c").agg(F.max(F.struct(_distance("c").alias("r"), *NAMES, "v")).alias("f")).where(F.col("f.r") > RADIUS)
        far = cut_lineage(far.select("part", "c", *[F.col(f"f.{n}").alias(f"a{n}") for n in NAMES]))
        if far.isEmpty():
            every = reduce(DataFrame.unionByName, done, wide.select("v", "part", "c"))
            return every.select("v", F.concat_ws(" ", F.col("part").cast("string"), "c").alias("cluster"))
        done.append(wide.join(far.select("part", "c"), ["part", "c"], "left_anti").select("v", "part", "c"))
        wide = cut_lineage(wide.join(far.select("part", "c"), ["part", "c"], "left_semi"))
        other = wide.join(far, ["part", "c"]).groupBy("part", "c").agg(F.max(F.struct(_distance("a").alias("r"), *NAMES, "v")).alias("f"))
        centres = far.join(other.select("part", "c", *[F.col(f"f.{n}").alias(f"b{n}") for n in NAMES]), ["part", "c"])
        sides, before = wide, None
        for _ in range(LLOYD):
            sides = cut_lineage(wide.join(centres, ["part", "c"]).select("v", "part", "c", *NAMES, (_distance("b") < _distance("a")).alias("b")))
            now = fingerprint(sides.where("b"), "v")
            if now == before:
                break
            before = now
            means = [F.avg(F.when(F.col("b") if s == "b" else ~F.col("b"), F.col(n))).alias(f"{s}{n}") for s in "ab" for n in NAMES]
            centres = sides.groupBy("part", "c").agg(*means)
        wide = cut_lineage(sides.select("v", "part", *NAMES, F.concat("c", F.lit(f".{depth}"), F.when(F.col("b"), "b").otherwise("a")).alias("c")))


def embed_and_split(edges: DataFrame) -> DataFrame:
    """``v, cluster``: k-means on the power-iteration embedding of a graph (a, b, w)."""
    parts = cut_lineage(hash_to_min(edges, "a", "b").select(F.col("key").alias("v"), F.col("gruppe").alias("part")))
    return k_means(cut_lineage(embedding(edges, parts)))


def spectral_clusters(tokens: DataFrame) -> DataFrame:
    """Cluster of every record that is similar to another: ``k, gruppe, groesse, rang``.

    ``tokens`` (k, t) has the points of the records. gruppe is the smallest record of the
    cluster, groesse its number of records, rang the order by internal affinity (the sum
    of a record's affinities to all others of its cluster, those with the same points
    having 1; ties by k), from 1 for the most typical.

    Records with the same points are one vertex and share its cluster; a vertex without
    edges is a cluster if it stands for several records. The internal affinity is
    aggregated and ranks are counted over a global sort: no task holds a cluster.

    Defined cases: records without points are in no cluster; null tokens and keys are
    ignored; repeated rows of ``tokens`` count once; an empty table gives no rows.
    """
    members, edges = affinities(tokens.where("k is not null and t is not null").distinct())
    edges = cut_lineage(edges)
    clusters = cut_lineage(embed_and_split(edges))
    inside = edges.join(clusters.select(F.col("v").alias("a"), F.col("cluster").alias("ca")), "a").join(clusters.select(F.col("v").alias("b"), F.col("cluster").alias("cb")), "b").where("ca = cb")
    # a vertex counts for every record that it stands for
    times = members.groupBy("rep").agg(F.count(F.lit(1)).alias("times"))
    ends = inside.select("a", "b", "w").unionByName(inside.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    affinity = ends.join(times.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum(F.col("w") * F.col("times")).alias("inner"))
    affinity = times.join(affinity, "rep", "left").select("rep", F.round(F.coalesce("inner", F.lit(0.0)) + F.col("times") - 1, 9).alias("inner"))
    rows = members.join(clusters.withColumnRenamed("v", "rep"), "rep", "left").join(affinity, "rep", "left")
    rows = cut_lineage(rows.select("k", F.coalesce("cluster", F.concat(F.lit("="), F.col("rep").cast("string"))).alias("cluster"), F.coalesce("inner", F.lit(0.0)).alias("inner")))
    groups = rows.groupBy("cluster").agg(F.min("k").alias("gruppe"), F.count(F.lit(1)).alias("groesse")).where("groesse > 1")
    ranked = numbered(rows.join(groups, "cluster").select("k", "gruppe", "groesse", (-F.col("inner")).alias("outer")), "gruppe", ["outer", "k"], "rang")
    return ranked.select("k", "gruppe", "groesse", F.col("rang").cast("int").alias("rang"))

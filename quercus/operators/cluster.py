"""Size-capped average linkage and what is read off it: orders, cuts, trees, labels."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def link(n: int, similarity: np.ndarray, cap: int) -> list[tuple[int, int, float]]:
    """Merges ``(a, b, mean similarity)`` of greedy average linkage, new clusters numbered from n.

    A heap holds a candidate per pair of live clusters; entries of merged clusters are
    skipped when they surface. Means follow from sums (Lance-Williams). Two clusters whose
    sizes together exceed ``cap`` never merge (0: no cap), nor do incomparable ones (NaN).
    Ties go to the pair that stood first in the list of live clusters.
    """
    total = {i: {j: float(similarity[i, j]) for j in range(n) if j != i and not np.isnan(similarity[i, j])} for i in range(n)}
    size = dict.fromkeys(range(n), 1)
    place = {i: i for i in range(n)}
    heap = [(-s, i, j) for i in range(n) for j, s in total[i].items() if i < j and (not cap or cap >= 2)]
    heapq.heapify(heap)
    merges = []
    while heap:
        value, a, b = heapq.heappop(heap)
        if a not in size or b not in size:
            continue
        c = n + len(merges)
        merges.append((a, b, -value))
        both = {x: total[a][x] + total[b][x] for x in total[a].keys() & total[b].keys()}
        size[c] = size.pop(a) + size.pop(b)
        place[c] = c
        for gone in (a, b):
            for x in total.pop(gone):
                total[x].pop(gone, None) if x in total else None
        total[c] = both
        for x, s in both.items():
            total[x][c] = s
            if not cap or size[x] + size[c] <= cap:
                heapq.heappush(heap, (-s / (size[x] * size[c]), x, c))
    return merges


def order_of(n: int, merges: list[tuple[int, int, float]], base: list[int]) -> list[int]:
    """Leaves in the order of the merge forest: at every node, and among roots, the side with the earlier leaf first."""
    rank = {leaf: r for r, leaf in enumerate(base)}
    leaves: dict[int, list[int]] = {i: [i] for i in range(n)}
    for k, (a, b, _) in enumerate(merges):
        x, y = leaves.pop(a), leaves.pop(b)
        leaves[n + k] = x + y if min(rank[i] for i in x) <= min(rank[i] for i in y) else y + x
    return [i for part in sorted(leaves.values(), key=lambda p: min(rank[i] for i in p)) for i in part]


def linkage(pairs: DataFrame, value: str, caps: tuple[int, ...], digits: int = 4) -> DataFrame:
    """``cap, schritt, a, b, c, wert, platz, id``: merges and leaf orders of a bounded set of entities.

    ``pairs`` (a, b, value) of positions 0 to n - 1. The pairs go to one task, are solved
    there for every cap - sequential by nature, quadratic in n - and come back as both kinds
    of row: a merge has schritt, a leaf's place has platz. Values are rounded first, so that
    ties are ties on every machine. ``merges_of`` and ``order_rows`` tell them apart.
    """
    rows = pairs.select(F.lit(0).alias("g"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.round(F.col(value), digits).alias("v"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf["a"].max(), pdf["b"].max())) + 1
        m = np.full((n, n), np.nan)
        m[pdf["a"], pdf["b"]] = pdf["v"]
        m[pdf["b"], pdf["a"]] = pdf["v"]
        free = link(n, m, 0)
        base = order_of(n, free, list(range(n)))
        out = []
        for cap in caps:
            merges = link(n, m, cap) if cap else free
            out += [(cap, k, a, b, n + k, s, None, None) for k, (a, b, s) in enumerate(merges)]
            out += [(cap, None, None, None, None, None, r, i) for r, i in enumerate(order_of(n, merges, base))]
        frame = pd.DataFrame(out, columns=["cap", "schritt", "a", "b", "c", "wert", "platz", "id"])
        return frame.astype({c: "Int32" for c in frame.columns if c != "wert"})

    return rows.groupBy("g").applyInPandas(solve, "cap int, schritt int, a int, b int, c int, wert double, platz int, id int")


def merges_of(linked: DataFrame) -> DataFrame:
    return linked.where("schritt is not null").select("cap", "schritt", "a", "b", "c", "wert")


def order_rows(linked: DataFrame) -> DataFrame:
    return linked.where("platz is not null").select("cap", "platz", "id")


def cut(merges: DataFrame, n: int, k: int) -> DataFrame:
    """``cap, id, cluster``: the clusters after the first ``min(n - k, merges)`` steps.

    A leaf climbs from merge to merge; a merge names two children, so the climb is a
    pointer chase that doubles its stride each round: log2(n) small joins.
    """
    spark = merges.sparkSession
    used = merges.where(F.col("schritt") < n - k)
    up = used.select("cap", F.col("a").alias("x"), F.col("c").alias("p")).unionByName(used.select("cap", F.col("b").alias("x"), F.col("c").alias("p")))
    caps = merges.select("cap").distinct()
    at = caps.crossJoin(spark.range(n).select(F.col("id").cast("int").alias("id"))).withColumn("cluster", F.col("id"))
    jump = up
    for _ in range(max(1, n.bit_length())):
        at = at.join(jump.select("cap", F.col("x").alias("cluster"), "p"), ["cap", "cluster"], "left").select("cap", "id", F.coalesce("p", "cluster").alias("cluster"))
        jump = jump.join(jump.select("cap", F.col("x").alias("p"), F.col("p").alias("q")), ["cap", "p"], "left").select("cap", "x", F.coalesce("q", "p").alias("p"))
    return at


def spanning_tree(pairs: DataFrame, group: str, value: str) -> DataFrame:
    """``group, a, b, wert``: the strongest connections that hold each group together (maximum spanning tree).

    Groups are clusters of a capped size; each is solved by Kruskal in one call.
    """
    rows = pairs.select(group, "a", "b", F.col(value).alias("wert"))
    kind = rows.schema
    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        kept = []
        ranked = pdf.sort_values(["wert", "a", "b"], ascending=[False, True, True])
        for i, a, b in zip(ranked.index, ranked["a"].tolist(), ranked["b"].tolist()):
            x, y = find(a), find(b)
            if x != y:
                root[x] = y
                kept.append(i)
        return pdf.loc[kept]

    return rows.groupBy(group).applyInPandas(solve, named)


def inside_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``cluster, a, b, …``: the pairs of which both ends are in one cluster."""
    one = members.select("cluster", F.col("id").alias("a"))
    two = members.select(F.col("cluster").alias("_c"), F.col("id").alias("b"))
    return pairs.join(one, "a").join(two, "b").where("cluster = _c").drop("_c")


def centrality(members: DataFrame, pairs: DataFrame, value: str) -> DataFrame:
    """``id, cluster, naehe``: the mean similarity of each member to the others of its cluster, null if alone."""
    inside = inside_pairs(members, pairs)
    ends = inside.select(F.col("a").alias("id"), value).unionByName(inside.select(F.col("b").alias("id"), value))
    return members.join(ends.groupBy("id").agg(F.avg(value).alias("naehe")), "id", "left").select("id", "cluster", "naehe")


def grid(order: DataFrame, pairs: DataFrame, value: str) -> DataFrame:
    """``zeile, spalte, wert``: the similarity grid with rows and columns in leaf order, both halves, no diagonal."""
    both = pairs.select("a", "b", value).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), value))
    row = order.select(F.col("id").alias("a"), F.col("platz").alias("zeile"))
    column = order.select(F.col("id").alias("b"), F.col("platz").alias("spalte"))
    return both.join(row, "a").join(column, "b").select("zeile", "spalte", F.col(value).alias("wert"))


def summary(members: DataFrame, pairs: DataFrame, value: str) -> DataFrame:
    """``cluster, groesse, mittel, nr``: size, mean similarity inside, and number - clusters of several first, then by mean."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("groesse"), F.min("id").alias("kopf"))
    means = inside_pairs(members, pairs).groupBy("cluster").agg(F.avg(value).alias("mittel"))
    out = sizes.join(means, "cluster", "left")
    order = Window.orderBy((F.col("groesse") > 1).desc(), F.desc_nulls_last("mittel"), "kopf")
    return out.withColumn("nr", F.row_number().over(order)).drop("kopf")


def shared_terms(members: DataFrame, terms: DataFrame) -> DataFrame:
    """``cluster, term, gewicht, anzahl``: terms (id, term, gewicht) of at least two members."""
    return members.join(terms, "id").groupBy("cluster", "term").agg(F.sum("gewicht").alias("gewicht"), F.count(F.lit(1)).alias("anzahl")).where("anzahl >= 2")


def tidy_labels(terms: list[tuple[str, int]], most: int = 8) -> list[tuple[str, int]]:
    """Terms in falling order without repeats of one another: a term inside a chosen one or an
    inflected form of it is passed over, a phrase takes the place of its chosen words."""
    out: list[tuple[str, int]] = []
    for term, n in terms:
        stem = lambda w: w[: max(5, len(w) - 2)]
        if any(term in o or (min(len(o), len(term)) > 6 and abs(len(o) - len(term)) <= 2 and term.startswith(stem(o))) for o, _ in out):
            continue
        inside = [i for i, (o, _) in enumerate(out) if o in term.split(" ")]
        if inside:
            out[inside[0]] = (term, n)
            for i in reversed(inside[1:]):
                del out[i]
            continue
        out.append((term, n))
        if len(out) == most:
            break
    return out


def labels(shared: DataFrame, most: int = 8) -> DataFrame:
    """``cluster, begriffe``: the tidied terms of each cluster. A cluster has a capped number of
    members with a bounded number of terms each, so its list is bounded, too."""
    listed = shared.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct((-F.col("gewicht")).alias("m"), "term", "anzahl"))).alias("t"))

    @F.pandas_udf("array<struct<term:string,anzahl:bigint>>")
    def fold(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: [{"term": t, "anzahl": n} for t, n in tidy_labels([(x["term"], int(x["anzahl"])) for x in xs], most)])

    return listed.select("cluster", fold("t").alias("begriffe"))


def mix(members: DataFrame, kind: str) -> DataFrame:
    """``cluster, mischung``: kinds of the members with their numbers, the most frequent first: ``ACT (2), FIN``."""
    counts = members.groupBy("cluster", kind).agg(F.count(F.lit(1)).alias("n"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(kind).alias("k"))))
    text = F.transform(listed, lambda x: F.when(x["m"] < -1, F.concat(x["k"], F.lit(" ("), (-x["m"]).cast("string"), F.lit(")"))).otherwise(x["k"]))
    return counts.groupBy("cluster").agg(F.array_join(text, ", ").alias("mischung"))


def totals(members: DataFrame, numbers: DataFrame, value: str) -> DataFrame:
    """``cluster, summe, fehlend``: a number summed over the members, missing ones counted."""
    joined = members.join(numbers, "id", "left")
    return joined.groupBy("cluster").agg(F.coalesce(F.sum(value), F.lit(0)).alias("summe"), F.count_if(F.col(value).isNull()).alias("fehlend"))


def planar_map(pairs: DataFrame, distance: str) -> DataFrame:
    """``id, x, y``: positions of a bounded set of entities by classical scaling of their distances, each axis in [0, 1]."""
    rows = pairs.select(F.lit(0).alias("g"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.col(distance).alias("d"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf["a"].max(), pdf["b"].max())) + 1
        d = np.zeros((n, n))
        d[pdf["a"], pdf["b"]] = d[pdf["b"], pdf["a"]] = pdf["d"].fillna(1.0)
        j = np.eye(n) - 1.0 / n
        values, vectors = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
        xy = vectors[:, ::-1][:, :2] * np.sqrt(np.maximum(values[::-1][:2], 0))
        xy *= np.where(xy[np.abs(xy).argmax(axis=0), range(2)] < 0, -1, 1)
        span = xy.max(axis=0) - xy.min(axis=0)
        xy = (xy - xy.min(axis=0)) / np.where(span == 0, 1, span)
        return pd.DataFrame({"id": range(n), "x": xy[:, 0].round(4), "y": xy[:, 1].round(4)})

    return rows.groupBy("g").applyInPandas(solve, "id int, x double, y double")

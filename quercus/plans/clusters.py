"""Clusters of nations: linkage under size caps, what each cluster is, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus.functions.text import level
from quercus.operators import cluster as C
from quercus.operators import pairs as P
from quercus.operators import sets as S
from quercus.operators import vectors as V
from quercus.plans import similarity as X
from quercus.plans.similarity import CONFIG, items, nation_lines, scored, term_weights
from quercus.session import cut_lineage, read
from quercus.sources.tables import slots

#: Clusters shown by default for the 25 nations: the cap and the number of the cut.
CAP, CLUSTERS, N = 5, 8, 25


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select("a", "b", "gesamt", "gemeinsam")


def linked(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lineage(C.linkage(scores(spark, folder), "gesamt", CONFIG.caps))


def capped_linkage(spark: SparkSession, folder: str) -> DataFrame:
    return C.merges_of(linked(spark, folder)).withColumn("wert", F.round("wert", 3))


def leaf_order(spark: SparkSession, folder: str) -> DataFrame:
    return C.order_rows(linked(spark, folder))


def similarity_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Total scores in the leaf order of the default cap."""
    pairs = cut_lineage(scores(spark, folder))
    order = C.order_rows(C.linkage(pairs, "gesamt", (CAP,)))
    return C.grid(order, pairs, "gesamt").withColumn("wert", F.round("wert", 2))


def members_of(pairs: DataFrame, cap: int = CAP, k: int = CLUSTERS) -> DataFrame:
    merges = cut_lineage(C.merges_of(C.linkage(pairs, "gesamt", (cap,))))
    return cut_lineage(C.cut(merges, N, k).select("id", "cluster"))


def cluster_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Every cap's clusters when the forest is cut at eight."""
    return C.cut(C.merges_of(linked(spark, folder)), N, CLUSTERS)


#: A forest over eight leaves as it may be stored: cap, step, both sides, the new node, similarity.
STORED = [(3, 0, 0, 1, 8, 0.9), (3, 1, 4, 5, 9, 0.8), (3, 2, 8, 2, 10, 0.7), (3, 3, 6, 7, 11, 0.5), (0, 0, 0, 1, 8, 0.9), (0, 1, 4, 5, 9, 0.8), (0, 2, 8, 9, 10, 0.6), (0, 3, 10, 2, 11, 0.5), (0, 4, 11, 3, 12, 0.4), (0, 5, 6, 7, 13, 0.2)]


def stored_cut(spark: SparkSession, folder: str) -> DataFrame:
    """The cut of a stored forest at four clusters."""
    merges = spark.createDataFrame(STORED, "cap int, schritt int, a int, b int, c int, wert double")
    return C.cut(merges, 8, 4)


def region_members(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("cluster"))


def region_pairs(spark: SparkSession, folder: str) -> DataFrame:
    from quercus.plans.similarity import profile_cosine

    return profile_cosine(spark, folder).withColumn("cosinus", F.round("cosinus", 10))


def region_summary(spark: SparkSession, folder: str) -> DataFrame:
    """What a cluster table shows, of the regions: groups that need no clustering."""
    out = C.summary(region_members(spark, folder), region_pairs(spark, folder), "cosinus")
    return out.select("cluster", "groesse", F.round("mittel", 6).alias("mittel"), F.col("nr").cast("bigint").alias("nr"))


def region_centrality(spark: SparkSession, folder: str) -> DataFrame:
    """The nations of each region, the most central first."""
    from pyspark.sql import Window

    near = C.centrality(region_members(spark, folder), region_pairs(spark, folder), "cosinus").withColumn("naehe", F.round("naehe", 9))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc_nulls_last("naehe"), "id"))
    return near.select("cluster", rank.cast("bigint").alias("rang"), "id")


def region_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that are among the 25 most telling of at least two nations of a region."""
    return C.shared_terms(region_members(spark, folder), terms_of(spark, folder)).select("cluster", "term", F.round("gewicht", 6).alias("gewicht"), "anzahl")


def region_items(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that at least two nations of a region deliver, the ten most shared of each."""
    return shared_parts(items(spark, folder), region_members(spark, folder)).select("cluster", "i", "anzahl", F.col("rang").cast("bigint").alias("rang"))


def region_participants(spark: SparkSession, folder: str) -> DataFrame:
    """Quantities delivered by a region's nations, those without any counted."""
    quantity = nation_lines(spark, folder).groupBy(F.col("n").alias("id")).agg(F.sum("l_quantity").alias("menge"))
    return C.totals(region_members(spark, folder), quantity.where("menge > 100"), "menge").select("cluster", "summe", "fehlend")


def cluster_summary(spark: SparkSession, folder: str) -> DataFrame:
    pairs = scores(spark, folder)
    members = members_of(pairs)
    out = C.summary(members, pairs, "gesamt")
    vector = P.quantiles(pairs, "gesamt").agg(F.sort_array(F.collect_list("wert")).alias("v"))
    out = out.crossJoin(F.broadcast(vector)).withColumn("perzentil", P.percentile_in(F.col("mittel"), F.col("v"))).drop("v")
    labels = C.labels(C.shared_terms(members, terms_of(spark, folder))).select("cluster", F.array_join(F.transform(F.slice("begriffe", 1, 3), lambda b: b["term"]), " · ").alias("name"))
    out = out.join(labels, "cluster", "left")
    return out.select("nr", "cluster", "groesse", F.round("mittel", 5).alias("mittel"), F.round("perzentil", 3).alias("perzentil"), level(F.col("perzentil"), CONFIG.levels).alias("stufe"), "name")


def cluster_header(spark: SparkSession, folder: str) -> DataFrame:
    """How many clusters hold several nations, how many nations those are, how many are very similar."""
    several = F.col("groesse") > 1
    return cluster_summary(spark, folder).agg(F.count_if(several).alias("gruppen"), F.coalesce(F.sum(F.when(several, F.col("groesse"))), F.lit(0)).alias("mitglieder"), F.count_if(several & (F.col("perzentil") >= 96)).alias("aehnlich"))


def terms_of(spark: SparkSession, folder: str) -> DataFrame:
    w = term_weights(spark, folder)
    return V.top_terms(w.withColumn("gewicht", F.round("gewicht", 9)), "n", CONFIG.label_terms).select(F.col("n").alias("id"), "term", "gewicht")


def cluster_terms(spark: SparkSession, folder: str) -> DataFrame:
    shared = C.shared_terms(members_of(scores(spark, folder)), terms_of(spark, folder))
    return C.labels(shared).select("cluster", F.posexplode("begriffe").alias("i", "b")).select("cluster", (F.col("i") + 1).alias("rang"), "b.term", "b.anzahl")


def shared_parts(owned: DataFrame, members: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    both = owned.join(members.withColumnRenamed("id", "n"), "n").groupBy("cluster", "i").agg(F.count_distinct("n").alias("anzahl")).where("anzahl >= 2")
    w = Window.partitionBy("cluster").orderBy(F.desc("anzahl"), "i")
    return both.withColumn("rang", F.row_number().over(w)).where("rang <= 10")


def cluster_shared_items(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that at least two members of a cluster deliver, the ten most shared of each."""
    return shared_parts(items(spark, folder), members_of(scores(spark, folder)))


def spanning_edges(spark: SparkSession, folder: str) -> DataFrame:
    pairs = scores(spark, folder)
    return C.spanning_tree(C.inside_pairs(members_of(pairs), pairs), "cluster", "gesamt")


def region_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Spanning trees of the regions' nations by brand cosine."""
    return C.spanning_tree(C.inside_pairs(region_members(spark, folder), region_pairs(spark, folder)), "cluster", "cosinus").select("cluster", "a", "b")


def programme_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Market segments of each nation's customers with their numbers."""
    c = read(spark, folder, "customer").select(F.col("c_nationkey").alias("cluster"), "c_mktsegment")
    return C.mix(c, "c_mktsegment")


def cluster_participants(spark: SparkSession, folder: str) -> DataFrame:
    quantity = nation_lines(spark, folder).groupBy(F.col("n").alias("id")).agg(F.sum("l_quantity").alias("menge"))
    return C.totals(members_of(scores(spark, folder)), quantity.where("menge > 100"), "menge")


def map_2d(spark: SparkSession, folder: str) -> DataFrame:
    p = P.percentile_rank(scores(spark, folder), "gesamt", "perzentil").withColumn("d", F.lit(1.0) - F.col("perzentil"))
    return C.planar_map(p, "d")


def export_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of several nations, members side by side, the most central first."""
    pairs = scores(spark, folder)
    near = C.centrality(members_of(pairs), pairs, "gesamt").where("naehe is not null").withColumn("fern", -F.round("naehe", 9))
    names = read(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return slots(near.join(names, "id"), "cluster", ["fern", "id"], ["id", "name"])


def region_slots(spark: SparkSession, folder: str) -> DataFrame:
    """The regions' nations side by side, the most central first."""
    members = region_centrality(spark, folder).join(read(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "id")
    return slots(members, "cluster", ["rang"], ["id", "name"])


def nation_json(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document per nation: name, rarest parts, neighbours."""
    idf = S.item_idf(items(spark, folder), "n", "i")
    rare = items(spark, folder).join(idf, "i").groupBy("n").agg(F.slice(F.sort_array(F.collect_set(F.struct("df", "i"))), 1, CONFIG.shown_points).alias("r"), F.count(F.lit(1)).alias("teile"))
    near = P.top_neighbours(scores(spark, folder), "gesamt", 3).groupBy(F.col("a").alias("n")).agg(F.sort_array(F.collect_list(F.struct("rang", "b"))).alias("w"))
    nation = read(spark, folder, "nation").select(F.col("n_nationkey").alias("n"), "n_name")
    doc = F.struct(F.col("n").alias("id"), F.col("n_name").alias("name"), F.coalesce("teile", F.lit(0)).alias("teile"), F.coalesce(F.transform("r", lambda x: x["i"]), F.array().cast("array<bigint>")).alias("selten"), F.coalesce(F.transform("w", lambda x: x["b"]), F.array().cast("array<int>")).alias("nachbarn"))
    return nation.join(rare, "n", "left").join(near, "n", "left").select(F.to_json(doc).alias("dokument"))


def evidence_json(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of the pairs worth it, keyed by ``smaller-larger`` position."""
    from quercus.plans.similarity import evidence_pairs, shared_items

    rare = shared_items(spark, folder).groupBy("a", "b").agg(F.transform(F.sort_array(F.collect_list(F.struct("rang", "i"))), lambda x: x["i"]).alias("teile"))
    kept = evidence_pairs(spark, folder).join(rare, ["a", "b"])
    return kept.select(F.concat_ws("-", F.least("a", "b"), F.greatest("a", "b")).alias("paar"), F.to_json(F.struct("gemeinsam", "teile")).alias("beleg"))


QUERIES = {
    f.__name__: f
    for f in (
        capped_linkage, leaf_order, similarity_grid, cluster_cut, stored_cut, cluster_summary, cluster_header, cluster_terms, cluster_shared_items, spanning_edges, region_tree, region_summary, region_centrality,
        region_terms, region_items, region_participants, region_slots, programme_mix, cluster_participants, map_2d, export_slots, nation_json, evidence_json,
    )
}

_MARKE = f"{X._ITEMS}, {X._BRAND}"
_REGION = "mem AS (SELECT n_nationkey AS id, n_regionkey AS cluster FROM nation), paar AS (SELECT x.cluster, a, b, round(cosinus, 10) AS c FROM marke JOIN mem x ON x.id = a JOIN mem y ON y.id = b WHERE x.cluster = y.cluster)"
_CENTRAL = "nah AS (SELECT m.cluster, m.id, round(avg(c), 9) AS naehe FROM mem m LEFT JOIN (SELECT a AS id, c FROM paar UNION ALL SELECT b, c FROM paar) e USING (id) GROUP BY 1, 2), zentral AS (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY naehe DESC NULLS LAST, id) AS rang FROM nah)"

SQL = {
    "programme_mix": "WITH c AS (SELECT c_nationkey AS cluster, c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1, 2) SELECT cluster, string_agg(CASE WHEN n > 1 THEN k || ' (' || n || ')' ELSE k END, ', ' ORDER BY n DESC, k) AS mischung FROM c GROUP BY cluster",
    # an edge is in the strongest tree if no path of stronger edges joins its ends
    "region_tree": f"""WITH RECURSIVE {_MARKE}, {_REGION}, e AS (SELECT cluster, a, b, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, a, b) AS r FROM paar),
 weg AS (SELECT cluster, r, a AS ort FROM e UNION SELECT w.cluster, w.r, CASE WHEN y.a = w.ort THEN y.b ELSE y.a END FROM weg w JOIN e y ON y.cluster = w.cluster AND y.r < w.r AND (y.a = w.ort OR y.b = w.ort))
 SELECT cluster, a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM weg WHERE weg.cluster = e.cluster AND weg.r = e.r AND weg.ort = e.b)""",
    "region_summary": f"WITH {_MARKE}, {_REGION}, s AS (SELECT cluster, count(*) AS groesse, min(id) AS kopf FROM mem GROUP BY 1), m AS (SELECT cluster, avg(c) AS mittel FROM paar GROUP BY 1) SELECT cluster, groesse, round(mittel, 6) AS mittel, row_number() OVER (ORDER BY groesse > 1 DESC, mittel DESC NULLS LAST, kopf) AS nr FROM s LEFT JOIN m USING (cluster)",
    "region_centrality": f"WITH {_MARKE}, {_REGION}, {_CENTRAL} SELECT cluster, rang, id FROM zentral",
    "region_slots": f"WITH {_MARKE}, {_REGION}, {_CENTRAL} SELECT cluster, " + ", ".join(f"max(CASE WHEN rang = {k} THEN {c} END) AS {chr(34)}{k}_{n}{chr(34)}" for k in range(1, 6) for c, n in (("id", "id"), ("n_name", "name"))) + " FROM zentral JOIN nation ON n_nationkey = id GROUP BY cluster",
    "region_terms": f"WITH {X._ITEMS}, {X._TERMS}, {_REGION.split(', paar')[0]}, top AS (SELECT n AS id, term, round(w, 9) AS g FROM tw QUALIFY row_number() OVER (PARTITION BY n ORDER BY round(w, 9) DESC, encode(term)) <= 25) SELECT cluster, term, round(sum(g), 6) AS gewicht, count(*) AS anzahl FROM top JOIN mem USING (id) GROUP BY 1, 2 HAVING count(*) >= 2",
    "region_items": f"WITH {X._ITEMS}, {_REGION.split(', paar')[0]}, s AS (SELECT cluster, i, count(*) AS anzahl FROM items JOIN mem ON id = n GROUP BY 1, 2 HAVING count(*) >= 2) SELECT cluster, i, anzahl, row_number() OVER (PARTITION BY cluster ORDER BY anzahl DESC, i) AS rang FROM s QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY anzahl DESC, i) <= 10",
    "region_participants": f"WITH {X._ITEMS}, {_REGION.split(', paar')[0]}, m AS (SELECT n AS id, sum(q) AS menge FROM lines GROUP BY 1 HAVING sum(q) > 100) SELECT cluster, coalesce(sum(menge), 0) AS summe, count(*) FILTER (menge IS NULL) AS fehlend FROM mem LEFT JOIN m USING (id) GROUP BY cluster",
    "stored_cut": f"""WITH RECURSIVE m(cap, schritt, a, b, c, wert) AS (VALUES {', '.join(map(str, STORED))}), u AS (SELECT cap, a AS x, c FROM m WHERE schritt < 4 UNION ALL SELECT cap, b, c FROM m WHERE schritt < 4),
 k AS (SELECT cap, id, id AS ort FROM (SELECT DISTINCT cap FROM m), (SELECT unnest(range(8))::INT AS id) UNION ALL SELECT k.cap, k.id, u.c FROM k JOIN u ON u.cap = k.cap AND u.x = k.ort) SELECT cap, id, max(ort)::INT AS cluster FROM k GROUP BY 1, 2""",
    "nation_json": X._ALL + f""", both_ AS (SELECT a, b, gesamt FROM scored UNION ALL SELECT b, a, gesamt FROM scored), w AS (SELECT a AS n, list(b ORDER BY rang) AS nachbarn FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY gesamt DESC NULLS LAST, b) AS rang FROM both_) WHERE rang <= 3 GROUP BY a),
 r AS (SELECT n, count(*) AS teile, list(i ORDER BY df, i)[1:14] AS selten FROM items JOIN idf USING (i) GROUP BY n) SELECT to_json({{'id': n_nationkey, 'name': n_name, 'teile': coalesce(teile, 0), 'selten': coalesce(selten, []), 'nachbarn': coalesce(nachbarn, [])}})::VARCHAR AS dokument FROM nation LEFT JOIN r ON r.n = n_nationkey LEFT JOIN w ON w.n = n_nationkey""",
    "evidence_json": X._ALL + """, f AS (SELECT x.n AS a, y.n AS b, x.i, df FROM items x JOIN items y ON x.i = y.i AND x.n < y.n JOIN idf ON idf.i = x.i), r AS (SELECT a, b, list(i ORDER BY df, i)[1:5] AS teile FROM f GROUP BY 1, 2)
 SELECT a || '-' || b AS paar, to_json({'gemeinsam': gemeinsam, 'teile': teile})::VARCHAR AS beleg FROM scored JOIN r USING (a, b) WHERE gesamt >= 1.0 OR inhalte_z >= 1.5 OR kompetenzen_z >= 1.5 OR gemeinsam > 0""",
}

"""Similarity of nations by what their suppliers deliver: the pipeline end to end.

Nations are a dimension of fixed size, so all pairs of them are a constant; what grows is
the line items, which are aggregated to sets and profiles before any pair is made.
Contents are mixed of three measures - the cosine of mean vectors, the alignment of points,
both of the given embeddings, and the tf-idf cosine of part names and types - and standardised
again; competences are cosines of brand profiles, literature is the rarity-weighted overlap of
the delivered parts. Embedding ``v`` is a point of nation ``v div 20 mod 25``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quercus.config import Config
from quercus.functions.text import level, match_text, parse_matches, top_share, z_word
from quercus.operators import pairs as P
from quercus.operators import sets as S
from quercus.operators import vectors as V
from quercus.session import cut_lineage, read, shared_path
from quercus.sources.tables import matrix, read_csv, unmatrix, write_csv

CONFIG = Config()


#: Nations whose points the embeddings are; one in twenty is a query point.
NATIONS, QUERY = 25, 20


def nation_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    return lines.join(read(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n")), "l_suppkey")


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """``n, i, q``: how much each nation delivers of each part. One pass over the line items."""
    return nation_lines(spark, folder).groupBy("n", F.col("l_partkey").alias("i")).agg(F.sum("l_quantity").alias("q"))


def items(spark: SparkSession, folder: str) -> DataFrame:
    return nation_lines(spark, folder).select("n", F.col("l_partkey").alias("i")).distinct()


def universe(spark: SparkSession, folder: str) -> DataFrame:
    return P.pair_universe(read(spark, folder, "nation"), "n_nationkey")


def pair_universe(spark: SparkSession, folder: str) -> DataFrame:
    return universe(spark, folder)


def item_idf(spark: SparkSession, folder: str) -> DataFrame:
    return S.item_idf(items(spark, folder), "n", "i").select("i", "df", F.round("idf", 6).alias("idf"))


def dice(spark: SparkSession, folder: str, owned: DataFrame | None = None) -> DataFrame:
    return S.idf_dice(universe(spark, folder), items(spark, folder) if owned is None else owned, "n", "i")


def idf_dice(spark: SparkSession, folder: str) -> DataFrame:
    return dice(spark, folder).select("a", "b", F.round("dice", 6).alias("dice"), "gemeinsam")


def shared_items(spark: SparkSession, folder: str) -> DataFrame:
    """The five rarest parts that each pair shares."""
    return S.rarest_shared(items(spark, folder), "n", "i", 5).select("a", "b", F.col("rang").cast("bigint").alias("rang"), "i", "df")


def profile_cosine(spark: SparkSession, folder: str, owned: DataFrame | None = None) -> DataFrame:
    brands = read(spark, folder, "part").select(F.col("p_partkey").alias("i"), "p_brand")
    owned = deliveries(spark, folder) if owned is None else owned
    q = owned.join(brands, "i").groupBy("n", F.col("p_brand").alias("term")).agg(F.sum("q").alias("q"))
    norm = q.groupBy("n").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("norm"))
    return V.tfidf_cosine(q.join(norm, "n").select("n", "term", (F.col("q") / F.col("norm")).alias("gewicht")), "n")


def brand_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return profile_cosine(spark, folder).select("a", "b", F.round("cosinus", 6).alias("cosinus"))


def name_terms(spark: SparkSession, folder: str, owned: DataFrame | None = None) -> DataFrame:
    """``n, times, term``: parts of one text are counted before the text is taken apart."""
    parts = read(spark, folder, "part").select(F.col("p_partkey").alias("i"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    owned = items(spark, folder) if owned is None else owned
    texts = owned.join(parts, "i").groupBy("n", "text").agg(F.count(F.lit(1)).alias("times"))
    return V.term_rows(texts, "n", "text", V.STOPS, 2, "times")


def term_weights(spark: SparkSession, folder: str, owned: DataFrame | None = None) -> DataFrame:
    return V.tfidf(name_terms(spark, folder, owned), "n", 2, 1.0, "times")


def terms_cosine(spark: SparkSession, folder: str, owned: DataFrame | None = None) -> DataFrame:
    return V.tfidf_cosine(term_weights(spark, folder, owned), "n")


def nation_term_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return terms_cosine(spark, folder).select("a", "b", F.round("cosinus", 6).alias("cosinus"))


def nation_points(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return e.withColumn("n", (F.floor(F.col("vec_id") / QUERY) % NATIONS).cast("int"))


def nation_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """``a, b, dokument, punkte``: cosine of the nations' mean vectors, alignment of their points."""
    points = nation_points(spark, folder)
    middle = V.centroids(points, "n", "embedding")
    both = universe(spark, folder).join(middle.select(F.col("n").alias("a"), F.col("mitte").alias("x")), "a", "left").join(middle.select(F.col("n").alias("b"), F.col("mitte").alias("y")), "b", "left")
    near = V.point_matches(points, points.where(F.col("vec_id") % QUERY == 0), "vec_id", "n", "embedding")
    aligned = V.alignment(near).withColumnRenamed("wert", "punkte")
    return both.select("a", "b", V.cosine("x", "y").alias("dokument")).join(aligned, ["a", "b"], "left")


def vector_measures(spark: SparkSession, folder: str) -> DataFrame:
    return nation_alignment(spark, folder).select("a", "b", F.round("dokument", 5).alias("dokument"), F.round("punkte", 5).alias("punkte"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """``a, b`` with every measure: contents mixed and competences, standardised, literature as a bonus, and the total."""
    owned = cut_lineage(deliveries(spark, folder))
    base = dice(spark, folder, owned).join(terms_cosine(spark, folder, owned).withColumnRenamed("cosinus", "tfidf"), ["a", "b"], "left")
    base = base.join(profile_cosine(spark, folder, owned).withColumnRenamed("cosinus", "marke"), ["a", "b"], "left").join(nation_alignment(spark, folder), ["a", "b"], "left")
    # every later step looks at the pairs several times: they are kept, the aggregates behind them run once
    z = P.zscores(cut_lineage(base), {"dokument": "z1", "punkte": "z2", "tfidf": "z3", "marke": "kompetenzen_z"})
    mixed = P.combine({"z1": CONFIG.content_mix["document"], "z2": CONFIG.content_mix["points"], "z3": CONFIG.content_mix["tfidf"]})
    z = P.zscores(z.withColumn("inhalt", mixed), {"inhalt": "inhalte_z"}).drop("z1", "z2", "z3")
    z = z.withColumn("literatur_bonus", F.lit(CONFIG.literature_scale) * F.col("dice"))
    total = P.combine({"inhalte_z": CONFIG.weights["contents"], "kompetenzen_z": CONFIG.weights["competences"], "literatur_bonus": CONFIG.weights["literature"]})
    # sums of doubles differ in their last digits from run to run: ties are told apart at ten
    return cut_lineage(z.withColumn("gesamt", F.round(total, 10)))


def zscore_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return P.zscore(profile_cosine(spark, folder), "cosinus", "z").select("a", "b", F.round("z", 5).alias("z"))


def combined_score(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select("a", "b", *[F.round(c, 5).alias(c) for c in ("inhalte_z", "kompetenzen_z", "literatur_bonus", "gesamt")])


def reweighted_score(spark: SparkSession, folder: str) -> DataFrame:
    """Other weights; one of nought leaves its dimension out, without any the score is 0."""
    s = scored(spark, folder)
    return s.select("a", "b", F.round(P.combine({"inhalte_z": 70, "kompetenzen_z": 0, "literatur_bonus": 30}, 0.0), 5).alias("gesamt"), P.combine({"inhalte_z": 0}, 0.0).alias("ohne"))


def pair_percentile(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles with their bands."""
    p = P.percentile_rank(scored(spark, folder), "gesamt", "perzentil")
    pct = F.round(F.col("perzentil") * 100, 6)
    return p.select("a", "b", F.round("perzentil", 6).alias("perzentil"), level(pct, CONFIG.levels).alias("stufe"))


def score_words(spark: SparkSession, folder: str) -> DataFrame:
    p = P.percentile_rank(scored(spark, folder), "gesamt", "perzentil")
    return p.select("a", "b", z_word(F.col("inhalte_z")).alias("inhalte"), z_word(F.col("kompetenzen_z")).alias("kompetenzen"), top_share(F.col("perzentil") * 100).alias("anteil"))


def quantile_vector(spark: SparkSession, folder: str) -> DataFrame:
    return P.quantiles(scored(spark, folder), "gesamt", 1000).select(F.col("stufe").cast("bigint").alias("stufe"), F.round("wert", 5).alias("wert"))


def similar_nations_topn(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: every nation's ten nearest, with percentile."""
    s = P.percentile_rank(scored(spark, folder), "gesamt", "perzentil")
    top = P.top_neighbours(s, "gesamt", CONFIG.top_n)
    names = read(spark, folder, "nation").select("n_nationkey", "n_name")
    top = top.join(names.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("name_a")), "a").join(names.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("name_b")), "b")
    return top.select("name_a", F.col("rang").cast("bigint").alias("rang"), "name_b", F.round("gesamt", 5).alias("gesamt"))


def nearest6(spark: SparkSession, folder: str) -> DataFrame:
    return P.top_neighbours(profile_cosine(spark, folder).withColumn("cosinus", F.round("cosinus", 10)), "cosinus", 6).select("a", "b", F.col("rang").cast("bigint").alias("rang"))


def evidence_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return P.evidence(scored(spark, folder), "gesamt", ["inhalte_z", "kompetenzen_z"], "gemeinsam", CONFIG.evidence_total, CONFIG.evidence_single).select("a", "b", "gemeinsam")


def similarity_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The matrix of brand cosines of all nations, a column per nation: a dimension of fixed size."""
    nations = [r[0] for r in read(spark, folder, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    return matrix(profile_cosine(spark, folder), "cosinus", nations)


def matrix_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The written matrix read back and taken apart into pairs again."""
    path = shared_path(spark, "matrix")
    write_csv(similarity_matrix(spark, folder), path)
    wide = read_csv(spark, path, keep_empty=False)
    back = unmatrix(wide.withColumn("id", F.col("id").cast("int")), "id", "wert")
    return back.select("a", "b", F.col("wert").cast("double").alias("wert")).where("wert is not null")


def point_matches(spark: SparkSession, folder: str, best: int = 1) -> DataFrame:
    e = read(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    return V.point_matches(e, e.where(F.col("vec_id") % QUERY == 0), "vec_id", "label", "embedding", best)


def point_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Labels by their points: query points are those with a vec_id divisible by 20."""
    return V.alignment(point_matches(spark, folder)).select("a", "b", F.round("wert", 5).alias("wert"))


def greedy_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The three best one-to-one matches of one label's query points with all points of another."""
    n = CONFIG.point_matches
    c = point_matches(spark, folder, n).select(F.col("gruppe_a").alias("a"), F.col("gruppe_b").alias("b"), F.col("q").alias("x"), F.col("p").alias("y"), F.round("wert", 6).alias("s"))
    return V.greedy_matches(c, n).select("a", "b", F.col("rang").cast("bigint").alias("rang"), "s", "x", "y")


def group_matches(spark: SparkSession, folder: str) -> DataFrame:
    """What holds groups of labels together: the two best matches of each pair inside, of these the five best of the group."""
    inside = greedy_matches(spark, folder).where("a % 3 = b % 3").withColumn("gruppe", F.col("a") % 3)
    pair = Window.partitionBy("a", "b").orderBy("rang")
    group = Window.partitionBy("gruppe").orderBy(F.desc("s"), "x", "y")
    two = inside.withColumn("r", F.row_number().over(pair)).where("r <= 2")
    return two.withColumn("platz", F.row_number().over(group).cast("bigint")).where("platz <= 5").select("gruppe", "platz", "x", "y", "s")


def match_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Matches written as text and parsed again."""
    g = greedy_matches(spark, folder).withColumn("t", match_text(F.col("s"), F.col("x").cast("string"), F.col("y").cast("string")))
    text = g.groupBy("a", "b").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rang", "t"))), lambda r: r["t"]), " || ").alias("t"))
    back = text.select("a", "b", F.explode(parse_matches(F.col("t"))).alias("m"))
    return back.select("a", "b", F.col("m.a").cast("bigint").alias("x"), F.col("m.b").cast("bigint").alias("y"))


QUERIES = {
    f.__name__: f
    for f in (
        pair_universe, item_idf, idf_dice, shared_items, brand_cosine, nation_term_cosine, zscore_pairs, combined_score, reweighted_score, pair_percentile, score_words,
        quantile_vector, similar_nations_topn, nearest6, evidence_pairs, similarity_matrix, matrix_pairs, vector_measures, point_alignment, greedy_matches, group_matches, match_texts,
    )
}

# ------------------------------------------------------------------ oracles

_ITEMS = "lines AS (SELECT s_nationkey AS n, l_partkey AS i, l_quantity AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), items AS (SELECT DISTINCT n, i FROM lines)"
_PAIRS = "pairs AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey)"
_IDF = "idf AS (SELECT i, count(*) AS df, ln((SELECT count(DISTINCT n) FROM items)::DOUBLE / count(*)) + 1 AS idf FROM items GROUP BY i)"
_DICE = """sets AS (SELECT n, sum(idf) AS w FROM items JOIN idf USING (i) GROUP BY n),
shared AS (SELECT x.n AS a, y.n AS b, sum(idf) AS s, count(*) AS c FROM items x JOIN items y ON x.i = y.i AND x.n < y.n JOIN idf ON idf.i = x.i GROUP BY 1, 2),
dice AS (SELECT p.a, p.b, 2 * coalesce(s, 0) / (wa.w + wb.w) AS dice, coalesce(c, 0) AS gemeinsam FROM pairs p LEFT JOIN sets wa ON wa.n = p.a LEFT JOIN sets wb ON wb.n = p.b LEFT JOIN shared ON shared.a = p.a AND shared.b = p.b)"""
_BRAND = """prof AS (SELECT n, p_brand AS t, sum(q) AS q FROM lines JOIN part ON i = p_partkey GROUP BY 1, 2),
pnorm AS (SELECT n, sqrt(sum(q * q)) AS norm FROM prof GROUP BY n), pw AS (SELECT n, t, q / norm AS w FROM prof JOIN pnorm USING (n)),
marke AS (SELECT x.n AS a, y.n AS b, sum(x.w * y.w) AS cosinus FROM pw x JOIN pw y ON x.t = y.t AND x.n < y.n GROUP BY 1, 2)"""
_TERMS = r"""wl AS (SELECT p_partkey AS i, list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[\p{L}\p{N}_&-]{2,}'), lambda w: NOT list_contains([STOPS], w)) AS w FROM part),
grams AS (SELECT i, unnest(w) AS term FROM wl UNION ALL SELECT i, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM wl),
tf AS (SELECT n, term, count(*) AS tf FROM items JOIN grams USING (i) GROUP BY 1, 2),
tn AS (SELECT count(DISTINCT n) AS nn FROM tf), tdf AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
raw AS (SELECT n, term, (ln(tf) + 1) * (ln((nn + 1.0) / (df + 1.0)) + 1) AS w FROM tf JOIN tdf USING (term), tn),
tnorm AS (SELECT n, sqrt(sum(w * w)) AS norm FROM raw GROUP BY n), tw AS (SELECT n, term, w / norm AS w FROM raw JOIN tnorm USING (n)),
inhalt AS (SELECT x.n AS a, y.n AS b, sum(x.w * y.w) AS cosinus FROM tw x JOIN tw y ON x.term = y.term AND x.n < y.n GROUP BY 1, 2)""".replace("STOPS", ", ".join(f"'{s}'" for s in sorted(V.STOPS)))
_VECTORS = """np AS (SELECT vec_id, (vec_id // 20 % 25)::INT AS n, embedding::DOUBLE[] AS v FROM embeddings),
mid AS (SELECT n, list(x ORDER BY i) AS v FROM (SELECT n, i, avg(v[i]) AS x FROM np, (SELECT unnest(range(1, 65)) AS i) GROUP BY n, i) GROUP BY n),
nbest AS (SELECT q.vec_id, q.n AS la, p.n AS lb, max(list_dot_product(q.v, p.v)) AS s FROM np q JOIN np p ON q.n <> p.n WHERE q.vec_id % 20 = 0 GROUP BY 1, 2, 3), nside AS (SELECT la, lb, avg(s) AS m FROM nbest GROUP BY 1, 2),
vec AS (SELECT p.a, p.b, list_cosine_similarity(x.v, y.v) AS dokument, (s.m + t.m) / 2 AS punkte FROM pairs p LEFT JOIN mid x ON x.n = p.a LEFT JOIN mid y ON y.n = p.b LEFT JOIN nside s ON s.la = p.a AND s.lb = p.b LEFT JOIN nside t ON t.la = p.b AND t.lb = p.a)"""
_Z = "(({0} - avg({0}) OVER ()) / CASE WHEN stddev_pop({0}) OVER () = 0 THEN 1 ELSE stddev_pop({0}) OVER () END)"
_SCORED = """m0 AS (SELECT d.a, d.b, d.dice, d.gemeinsam, i.cosinus AS tfidf, k.cosinus AS marke, dokument, punkte FROM dice d LEFT JOIN inhalt i USING (a, b) LEFT JOIN marke k USING (a, b) LEFT JOIN vec USING (a, b)),
m1 AS (SELECT *, Z1 AS z1, Z2 AS z2, Z3 AS z3 FROM m0),
m AS (SELECT *, (coalesce(z1, 0) * 0.4 + coalesce(z2, 0) * 0.4 + coalesce(z3, 0) * 0.2) / nullif(CASE WHEN z1 IS NULL THEN 0 ELSE 0.4 END + CASE WHEN z2 IS NULL THEN 0 ELSE 0.4 END + CASE WHEN z3 IS NULL THEN 0 ELSE 0.2 END, 0) AS inhalt FROM m1),
st AS (SELECT avg(inhalt) AS mi, stddev_pop(inhalt) AS si, avg(marke) AS mm, stddev_pop(marke) AS sm FROM m),
z AS (SELECT a, b, gemeinsam, (inhalt - mi) / CASE WHEN si = 0 THEN 1 ELSE si END AS inhalte_z, (marke - mm) / CASE WHEN sm = 0 THEN 1 ELSE sm END AS kompetenzen_z, 6.0 * dice AS literatur_bonus FROM m, st),
scored AS (SELECT *, round((coalesce(inhalte_z, 0) * 0.45 + coalesce(kompetenzen_z, 0) * 0.35 + coalesce(literatur_bonus, 0) * 0.2)
 / nullif(CASE WHEN inhalte_z IS NULL THEN 0 ELSE 0.45 END + CASE WHEN kompetenzen_z IS NULL THEN 0 ELSE 0.35 END + CASE WHEN literatur_bonus IS NULL THEN 0 ELSE 0.2 END, 0), 10) AS gesamt FROM z)""".replace("Z1", _Z.format("dokument")).replace("Z2", _Z.format("punkte")).replace("Z3", _Z.format("tfidf"))
_ALL = f"WITH {_ITEMS}, {_PAIRS}, {_IDF}, {_DICE}, {_BRAND}, {_TERMS}, {_VECTORS}, {_SCORED} "
_RANKED = "ranked AS (SELECT *, (rank() OVER (ORDER BY gesamt) + (count(*) OVER (PARTITION BY gesamt) - 1) / 2.0) / (SELECT count(gesamt) FROM scored) AS perzentil FROM scored WHERE gesamt IS NOT NULL)"
_POINTS = """q AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"""
_GREEDY = """c AS (SELECT x.label AS a, y.label AS b, x.vec_id AS x, y.vec_id AS y, round(list_dot_product(x.v, y.v), 6) AS s FROM q x JOIN p y ON x.label <> y.label),
r1 AS (SELECT a, b, 1 AS rang, s, x, y FROM c QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY s DESC, x, y) = 1),
c2 AS (SELECT c.* FROM c JOIN r1 USING (a, b) WHERE c.x <> r1.x AND c.y <> r1.y),
r2 AS (SELECT a, b, 2 AS rang, s, x, y FROM c2 QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY s DESC, x, y) = 1),
c3 AS (SELECT c2.* FROM c2 JOIN r2 USING (a, b) WHERE c2.x <> r2.x AND c2.y <> r2.y),
r3 AS (SELECT a, b, 3 AS rang, s, x, y FROM c3 QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY s DESC, x, y) = 1),
g AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)"""

SQL = {
    "pair_universe": f"WITH {_PAIRS} SELECT a, b FROM pairs",
    "item_idf": f"WITH {_ITEMS}, {_IDF} SELECT i, df, round(idf, 6) AS idf FROM idf",
    "idf_dice": f"WITH {_ITEMS}, {_PAIRS}, {_IDF}, {_DICE} SELECT a, b, round(dice, 6) AS dice, gemeinsam FROM dice",
    "shared_items": f"WITH {_ITEMS}, {_IDF} SELECT x.n AS a, y.n AS b, row_number() OVER (PARTITION BY x.n, y.n ORDER BY df, x.i) AS rang, x.i AS i, df FROM items x JOIN items y ON x.i = y.i AND x.n < y.n JOIN idf ON idf.i = x.i QUALIFY row_number() OVER (PARTITION BY x.n, y.n ORDER BY df, x.i) <= 5",
    "brand_cosine": f"WITH {_ITEMS}, {_BRAND} SELECT a, b, round(cosinus, 6) AS cosinus FROM marke",
    "nation_term_cosine": f"WITH {_ITEMS}, {_TERMS} SELECT a, b, round(cosinus, 6) AS cosinus FROM inhalt",
    "zscore_pairs": f"WITH {_ITEMS}, {_BRAND}, s AS (SELECT avg(cosinus) AS m, stddev_pop(cosinus) AS d FROM marke) SELECT a, b, round((cosinus - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 5) AS z FROM marke, s",
    "combined_score": _ALL + "SELECT a, b, round(inhalte_z, 5) AS inhalte_z, round(kompetenzen_z, 5) AS kompetenzen_z, round(literatur_bonus, 5) AS literatur_bonus, round(gesamt, 5) AS gesamt FROM scored",
    "reweighted_score": _ALL + "SELECT a, b, round(coalesce((coalesce(inhalte_z, 0) * 70.0 + coalesce(literatur_bonus, 0) * 30.0) / nullif(CASE WHEN inhalte_z IS NULL THEN 0 ELSE 70.0 END + CASE WHEN literatur_bonus IS NULL THEN 0 ELSE 30.0 END, 0), 0), 5) AS gesamt, 0.0::DOUBLE AS ohne FROM scored",
    "pair_percentile": _ALL + f", {_RANKED} SELECT s.a, s.b, round(perzentil, 6) AS perzentil, CASE WHEN perzentil IS NULL THEN NULL WHEN round(perzentil * 100, 6) >= 99 THEN 'sehr hoch' WHEN round(perzentil * 100, 6) >= 96 THEN 'hoch' WHEN round(perzentil * 100, 6) >= 90 THEN 'mittel' ELSE 'gering' END AS stufe FROM scored s LEFT JOIN ranked r ON r.a = s.a AND r.b = s.b",
    "quantile_vector": _ALL + ", g AS (SELECT unnest(range(0, 1001)) AS stufe), l AS (SELECT list(gesamt ORDER BY gesamt) AS v, count(gesamt) AS c FROM scored WHERE gesamt IS NOT NULL), h AS (SELECT stufe, v, stufe / 1000.0 * (c - 1) AS pos, c FROM g, l) SELECT stufe, round(v[floor(pos)::INT + 1] + (v[least(floor(pos)::INT + 2, c)] - v[floor(pos)::INT + 1]) * (pos - floor(pos)), 5) AS wert FROM h",
    "similar_nations_topn": _ALL + ", both_ AS (SELECT a, b, gesamt FROM scored UNION ALL SELECT b, a, gesamt FROM scored), t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY gesamt DESC NULLS LAST, b) AS rang FROM both_) SELECT x.n_name AS name_a, rang, y.n_name AS name_b, round(gesamt, 5) AS gesamt FROM t JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b WHERE rang <= 10",
    "nearest6": f"WITH {_ITEMS}, {_BRAND}, both_ AS (SELECT a, b, round(cosinus, 10) AS c FROM marke UNION ALL SELECT b, a, round(cosinus, 10) FROM marke) SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC NULLS LAST, b) AS rang FROM both_ QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC NULLS LAST, b) <= 6",
    "evidence_pairs": _ALL + "SELECT a, b, gemeinsam FROM scored WHERE gesamt >= 1.0 OR inhalte_z >= 1.5 OR kompetenzen_z >= 1.5 OR gemeinsam > 0",
    "point_alignment": f"WITH {_POINTS}, best AS (SELECT q.vec_id, q.label AS la, p.label AS lb, max(list_dot_product(q.v, p.v)) AS s FROM q JOIN p ON q.label <> p.label GROUP BY 1, 2, 3), side AS (SELECT la, lb, avg(s) AS m FROM best GROUP BY 1, 2) SELECT x.la AS a, x.lb AS b, round((x.m + y.m) / 2, 5) AS wert FROM side x JOIN side y ON x.la = y.lb AND x.lb = y.la WHERE x.la < x.lb",
    "greedy_matches": f"WITH {_POINTS}, {_GREEDY} SELECT a, b, rang::BIGINT AS rang, s, x, y FROM g",
    "group_matches": f"WITH {_POINTS}, {_GREEDY}, t AS (SELECT a % 3 AS gruppe, s, x, y FROM g WHERE a % 3 = b % 3 AND rang <= 2) SELECT gruppe, row_number() OVER (PARTITION BY gruppe ORDER BY s DESC, x, y) AS platz, x, y, s FROM t QUALIFY row_number() OVER (PARTITION BY gruppe ORDER BY s DESC, x, y) <= 5",
    "vector_measures": f"WITH {_PAIRS}, {_VECTORS} SELECT a, b, round(dokument, 5) AS dokument, round(punkte, 5) AS punkte FROM vec",
    "similarity_matrix": f"WITH {_ITEMS}, {_BRAND}, both_ AS (SELECT a, b, round(cosinus, 4) AS c FROM marke UNION ALL SELECT b, a, round(cosinus, 4) FROM marke) SELECT a AS id, {', '.join(f'max(CASE WHEN b = {k} THEN c END) AS {chr(34)}{k}{chr(34)}' for k in range(25))} FROM both_ GROUP BY a",
    "matrix_pairs": f"WITH {_ITEMS}, {_BRAND} SELECT a, b, round(cosinus, 4) AS wert FROM marke",
    "score_words": _ALL + f", {_RANKED}, r AS (SELECT s.a, s.b, s.inhalte_z AS i, s.kompetenzen_z AS k, greatest(100.0 - perzentil * 100, 0.1) AS rest FROM scored s LEFT JOIN ranked USING (a, b)) SELECT a, b, "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN '–' WHEN {c} >= 2 THEN 'sehr hoch' WHEN {c} >= 1 THEN 'hoch' WHEN {c} >= 0 THEN 'mittel' ELSE 'gering' END AS {n}" for c, n in (("i", "inhalte"), ("k", "kompetenzen")))
    + ", CASE WHEN rest < 1 THEN printf('obere %.1f %%', rest) ELSE printf('obere %d %%', round(rest)::INT) END AS anteil FROM r",
    "match_texts": f"WITH {_POINTS}, {_GREEDY} SELECT a, b, x, y FROM g WHERE s >= 0",
}

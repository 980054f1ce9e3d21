"""Vectors and terms: cosine, alignment of points, greedy matches, tf-idf."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.functions.text import words

# Function words of German that are no terms.
STOPS = set("aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer eines er es für hat im in ist kann können mit nach nicht noch nur oder ob sich sie sind so sowie über um und unter vom von vor werden wie wird zu zum zur".split())
# Words of course descriptions that tell no subject, endings of adjectives.
GENERIC = set(
    "studierenden grundlagen einführung überblick aktuelle ausgewählte rahmen bedeutung methoden instrumente modul themen aspekte anwendung anwendungen praxis beispiele fallstudien konzepte ansätze möglichkeiten "
    "vertiefung herausforderungen grenzen ziele aufgaben unternehmen management studierende fähigkeiten erfolgt erwerben dabei gezielt erarbeitet erarbeiten vergleich externen zwecke werden wurde sowie insbesondere "
    "jeweiligen verschiedene verschiedenen wesentliche wesentlichen relevante relevanten moderne modernen neue neuen eigene eigenen etwa hierbei hinblick stehen steht liegt bereich bereiche bereichen verfahren "
    "systematisierung persönliche theorie theorien konzept modell modelle modellen rolle form formen fragen fragestellungen basis entwicklung entwicklungen umsetzung analyse analysen gestaltung einsatz arten teil teile "
    "kontext perspektive perspektiven erfolg faktoren anforderungen".split()
)
ADJECTIVES = ["ische", "ischen", "isches", "ale", "alen", "ales", "liche", "lichen", "liches", "ige", "igen", "ive", "iven", "ierte", "ierten", "ende", "enden", "ete", "eten", "orientierte", "bezogene"]


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def term_rows(texts: DataFrame, entity: str, text: str, stops: set[str] = STOPS, least: int = 2, *others: str) -> DataFrame:
    """``entity, others, term`` for every unigram and bigram, stop words taken out before bigrams are made."""
    kept = F.filter(words(F.col(text), least), lambda w: ~w.isin(sorted(stops)))
    seq = texts.select(entity, *others, kept.alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    return seq.select(entity, *others, F.explode(F.concat("w", pairs)).alias("term"))


def tfidf(terms: DataFrame, entity: str, min_df: int = 2, max_df: float = 0.5, times: str | None = None) -> DataFrame:
    """``entity, term, df, gewicht``: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each entity of length 1.

    n counts entities with any term; ``times`` is a column that says how often a row counts.
    Three aggregations, all combined map-side.
    """
    tf = terms.groupBy(entity, "term").agg((F.sum(times) if times else F.count(F.lit(1))).alias("tf"))
    n = tf.agg(F.count_distinct(entity).alias("_n"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("_n")))
    raw = tf.join(df, "term").select(entity, "term", "df", ((F.log("tf") + 1.0) * (F.log((F.col("_n") + 1.0) / (F.col("df") + 1.0)) + 1.0)).alias("w"))
    norm = raw.groupBy(entity).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, entity).select(entity, "term", "df", (F.col("w") / F.col("norm")).alias("gewicht"))


def tfidf_cosine(weights: DataFrame, entity: str) -> DataFrame:
    """``a, b, cosinus``, a < b, of entities that share a term: a sparse product by a join on the term.

    For a bounded number of entities; entities without a common term have no row (cosine 0).
    """
    left = weights.select(F.col(entity).alias("a"), "term", F.col("gewicht").alias("wa"))
    right = weights.select(F.col(entity).alias("b"), "term", F.col("gewicht").alias("wb"))
    return left.join(right, "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosinus"))


def word_forms(texts: DataFrame, text: str, least: int) -> DataFrame:
    """``wort, form``: the usual spelling of each word, by frequency, then by code point."""
    found = texts.select(F.explode(F.regexp_extract_all(text, F.lit(rf"[\p{{L}}\p{{N}}_&-]{{{least},}}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy(F.lower("w").alias("wort")).agg(F.min_by("w", F.struct((-F.col("n")).alias("m"), "w")).alias("form"))


def noun_terms(weights: DataFrame, forms: DataFrame, entity: str) -> DataFrame:
    """The weights (entity, term, df, gewicht) of terms fit for a label: their words are usually written with
    a capital; a single word has no ending of an adjective; two words occur together in at least three
    entities and in 0.6 of those of the rarer one, the second being no adjective. The test is made once a term."""
    terms = weights.select("term", "df").distinct()
    adjective = lambda w: w.rlike("(?:" + "|".join(ADJECTIVES) + ")$")
    parts = terms.select("term", "df", F.split_part("term", F.lit(" "), F.lit(1)).alias("x"), F.split_part("term", F.lit(" "), F.lit(2)).alias("y"))
    for side in "xy":
        parts = parts.join(forms.select(F.col("wort").alias(side), F.col("form").rlike(r"^\p{Lu}").alias(f"{side}_up")), side, "left")
        parts = parts.join(terms.select(F.col("term").alias(side), F.col("df").alias(f"{side}_df")), side, "left")
    many = F.lit(1_000_000_000)
    pair = F.col("y_up") & ~adjective(F.col("y")) & (F.col("df") >= 3) & (F.col("df") >= 0.6 * F.least(F.coalesce("x_df", many), F.coalesce("y_df", many)))
    fit = parts.where(F.col("x_up") & F.when(F.col("y") == "", ~adjective(F.col("x"))).otherwise(pair)).select("term")
    return weights.join(fit, "term", "left_semi")


def top_terms(weights: DataFrame, entity: str, n: int = 25) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(F.desc("gewicht"), "term")
    return weights.withColumn("rang", F.row_number().over(w)).where(F.col("rang") <= n)


def point_matches(points: DataFrame, queries: DataFrame, key: str, group: str, vector: str, best: int = 1, block: int = 512) -> DataFrame:
    """``q, gruppe_a, gruppe_b, p, wert``: for each query point its ``best`` nearest points of every other group.

    Queries are dealt into blocks of ``block`` vectors; every block meets the points
    partition by partition as one matrix product (numpy, in Arrow batches) which yields
    its best per query and group, and partial bests are reduced by a window that is cut
    before the shuffle. Neither side is collected: blocks of queries are joined to
    partitions of points, the stated query set against all.
    """
    blocks = queries.select(F.col(key).alias("q"), F.col(group).alias("ga"), F.col(vector).alias("v")).where("q is not null and v is not null")
    blocks = blocks.withColumn("blk", F.floor(F.col("q") / block)).groupBy("blk").agg(F.collect_list(F.struct("q", "ga", "v")).alias("qs"))
    parts = points.select(F.col(key).alias("p"), F.col(group).alias("gb"), F.col(vector).alias("v")).where("p is not null and v is not null")
    parts = parts.withColumn("part", F.floor(F.col("p") / 4096)).groupBy("part", "gb").agg(F.collect_list(F.struct("p", "v")).alias("ps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"q": [], "ga": [], "gb": [], "s": [], "p": []}
            for qs, gb, ps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                qs = [q for q in qs if q["ga"] != gb]
                if not qs or not ps:
                    continue
                ps.sort(key=lambda x: x["p"])
                sims = np.array([q["v"] for q in qs], dtype=np.float64) @ np.array([p["v"] for p in ps], dtype=np.float64).T
                near = np.argsort(-sims, axis=1, kind="stable")[:, :best]
                n = near.shape[1]
                out["q"] += [q["q"] for q in qs for _ in range(n)]
                out["ga"] += [q["ga"] for q in qs for _ in range(n)]
                out["gb"] += [gb] * len(qs) * n
                out["s"] += np.take_along_axis(sims, near, axis=1).ravel().tolist()
                out["p"] += [ps[i]["p"] for i in near.ravel()]
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.float64() if k == "s" else pa.int32() if k in ("ga", "gb") else pa.int64()) for k, v in out.items()})

    met = blocks.crossJoin(parts).select("qs", "gb", "ps").mapInArrow(run, "q long, ga int, gb int, s double, p long")
    # sums of doubles differ in their last digits: ties are told apart at ten
    order = Window.partitionBy("q", "gb").orderBy(F.desc(F.round("s", 10)), "p")
    kept = met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= best)
    return kept.select("q", F.col("ga").alias("gruppe_a"), F.col("gb").alias("gruppe_b"), "p", F.col("s").alias("wert"))


def alignment(matches: DataFrame) -> DataFrame:
    """``a, b, wert``, a < b: the mean best match of either side's query points, both sides averaged.
    Null unless both sides have query points."""
    side = matches.groupBy("gruppe_a", "gruppe_b").agg(F.avg("wert").alias("m"))
    one = side.select(F.col("gruppe_a").alias("a"), F.col("gruppe_b").alias("b"), F.col("m").alias("ma"))
    two = side.select(F.col("gruppe_b").alias("a"), F.col("gruppe_a").alias("b"), F.col("m").alias("mb"))
    return one.join(two, ["a", "b"]).where("a < b").select("a", "b", ((F.col("ma") + F.col("mb")) / 2).alias("wert"))


def centroids(points: DataFrame, group: str, vector: str) -> DataFrame:
    """``group, mitte``: the mean vector of every group, from one map-side combined aggregation by place."""
    places = points.where(F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return places.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mitte"))


def greedy_matches(candidates: DataFrame, n: int = 3) -> DataFrame:
    """``a, b, rang, s, x, y``: the best one-to-one matches of each pair, greedily from the top.

    ``candidates`` (a, b, s, x, y). When the k-th match is taken, k - 1 of either side are
    taken already, so only the n best partners of each x and of each y can matter; the
    n-th match of a pair is among its best n * n of these. The fold sees a bounded list.
    """
    wx = Window.partitionBy("a", "b", "x").orderBy(F.desc("s"), "y")
    wy = Window.partitionBy("a", "b", "y").orderBy(F.desc("s"), "x")
    wp = Window.partitionBy("a", "b").orderBy(F.desc("s"), "x", "y")
    kept = candidates.withColumn("_x", F.row_number().over(wx)).where(F.col("_x") <= n).withColumn("_y", F.row_number().over(wy)).where(F.col("_y") <= n)
    kept = kept.withColumn("_p", F.row_number().over(wp)).where(F.col("_p") <= 2 * n * n)
    listed = kept.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("m"), "x", "y"))).alias("c"))
    free = lambda acc, c: ~F.exists(acc, lambda t: (t["x"] == c["x"]) | (t["y"] == c["y"])) & (F.size(acc) < n)
    kind = listed.schema["c"].dataType.simpleString()
    taken = F.aggregate("c", F.array().cast(kind), lambda acc, c: F.when(free(acc, c), F.concat(acc, F.array(c))).otherwise(acc))
    return listed.select("a", "b", F.posexplode(taken).alias("i", "t")).select("a", "b", (F.col("i") + 1).alias("rang"), (-F.col("t.m")).alias("s"), "t.x", "t.y")


def hashed_vector(column: str, size: int = 64, n: int = 3):
    """A vectorised text embedding that needs no model: signed hashes of character n-grams, of length 1."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        import zlib

        def one(t: str | None):
            if not t:
                return None
            v = np.zeros(size, dtype=np.float64)
            t = f" {' '.join(t.lower().split())} "
            for i in range(len(t) - n + 1):
                h = zlib.crc32(t[i : i + n].encode())
                v[h % size] += 1 if h >> 31 else -1
            norm = np.linalg.norm(v)
            return (v / norm if norm else v).astype(np.float32).tolist()

        return texts.map(one)

    return run(F.col(column))


def embed_new(texts: DataFrame, key: str, text: str, known: DataFrame | None, model: str = "hash-64") -> DataFrame:
    """``hash, vektor`` of the texts that ``known`` (hash, vektor) lacks: an anti-join by content hash."""
    from quercus.functions.text import text_hash

    rows = texts.select(text_hash(model, F.col(text)).alias("hash"), F.col(text).alias("_t")).where("_t is not null").dropDuplicates(["hash"])
    if known is not None:
        rows = rows.join(known.select("hash"), "hash", "left_anti")
    return rows.select("hash", hashed_vector("_t").alias("vektor"))

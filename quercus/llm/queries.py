"""Named queries of the subpackage: problem N's queries are pN_..."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus.session import cut_lineage, read


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from quercus.llm.names import person_groups, variant_pairs, work_groups

    works = work_groups(read(spark, folder, "literatur"), "lit_key", "autoren_roh", "erstautor_nachname", "titel", "jahr", "ort")
    people = person_groups(read(spark, folder, "module"), "verantwortung")
    pairs = [variant_pairs(g).select(F.lit(f).alias("feld"), "name_a", "name_b") for f, g in (("lit_key", works), ("verantwortung", people))]
    return pairs[0].unionByName(pairs[1])


def _scan_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Scanned rows, and typed texts whose spelling is trusted."""
    module = read(spark, folder, "module")
    fields = ["inhalte", "fachkompetenz", "literatur", "methodenkompetenz", "lehr_lerneinheiten", "modulname"]
    typed = module.where("herkunft <> 'scan'").select(F.explode(F.array(*fields)).alias("t"))
    return module.where("herkunft = 'scan'"), typed.unionByName(read(spark, folder, "literatur").select(F.col("eintrag_roh").alias("t")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from quercus.llm.scans import repair

    scanned, typed = _scan_inputs(spark, folder)
    return repair(scanned, "zeile_id", ["inhalte", "fachkompetenz", "literatur"], typed, "t")[0]


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    from quercus.llm.scans import repair

    scanned, typed = _scan_inputs(spark, folder)
    return repair(scanned, "zeile_id", ["inhalte", "fachkompetenz", "literatur"], typed, "t")[1]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from quercus.llm.markup import render_blocks

    return render_blocks(read(spark, folder, "module").where("herkunft = 'web'"), "zeile_id", ["inhalte", "lehr_lerneinheiten"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from quercus.llm.components import hash_to_min

    return hash_to_min(read(spark, folder, "lit_treffer"), "key_a", "key_b").withColumnRenamed("key", "lit_key")


def _module_points(spark: SparkSession, folder: str) -> DataFrame:
    """Points and sentences of the modules' three fields, each row cleaned after its herkunft.

    A lettered page line is known by three fields that have it: of scanned rows literatur is
    repaired as well, and dropped afterwards.
    """
    from quercus.llm.markup import visible_text
    from quercus.llm.scans import repair
    from quercus.llm.spectral import point_tokens
    from quercus.operators.packed import unpack

    module = read(spark, folder, "module").select("zeile_id", "herkunft", "inhalte", "fachkompetenz", "methodenkompetenz", "literatur")
    typed, scanned, web = (module.where(F.col("herkunft") == h) for h in ("formular", "scan", "web"))
    clean = module.where("herkunft <> 'scan'").select(F.explode(F.array("inhalte", "fachkompetenz", "methodenkompetenz")).alias("t"))
    texts = [
        unpack(typed, "zeile_id", ["inhalte"], least=1).select("zeile_id", F.col("wert").alias("t")),
        repair(scanned, "zeile_id", ["inhalte", "fachkompetenz", "literatur"], clean, "t")[1].where("feld <> 'literatur'").select("zeile_id", F.col("text").alias("t")),
        visible_text(web, "zeile_id", "inhalte").select("zeile_id", F.col("inhalte").alias("t")),
        module.where("coalesce(herkunft, '') <> 'scan'").select("zeile_id", F.col("fachkompetenz").alias("t")),
        module.select("zeile_id", F.col("methodenkompetenz").alias("t")),
        module.where("coalesce(herkunft, '') not in ('formular', 'scan', 'web')").select("zeile_id", F.col("inhalte").alias("t")),
    ]
    all_texts = texts[0]
    for t in texts[1:]:
        all_texts = all_texts.unionByName(t)
    return point_tokens(all_texts.where("t is not null"), "zeile_id", "t")


def p6_clusters(spark: SparkSession, folder: str) -> DataFrame:
    from quercus.llm.spectral import spectral_clusters

    return spectral_clusters(_module_points(spark, folder)).withColumnRenamed("k", "zeile_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_clusters(spark, folder).select("zeile_id", "gruppe")


def p6_typical(spark: SparkSession, folder: str) -> DataFrame:
    """Each cluster by its size and its three most typical rows."""
    top = p6_clusters(spark, folder).where("rang <= 3").groupBy("gruppe", "groesse")
    return top.agg(F.expr("transform(array_sort(collect_list(struct(rang, zeile_id))), x -> x.zeile_id)").alias("typisch"))


def _module_terms(spark: SparkSession, folder: str, formular_only: bool) -> DataFrame:
    from quercus.llm.distinctive import letter_terms

    rows = read(spark, folder, "module")
    if formular_only:
        rows = rows.where("herkunft = 'formular'")
    text = F.concat_ws(" ", F.coalesce("modulname", F.lit("")), F.coalesce("inhalte", F.lit("")))
    return rows.select("zeile_id", "modulnummer", F.explode(letter_terms(text)).alias("begriff"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms by their weight: log-entropy over modules, of which what stands in few modules has
    the most. The weight selects; the exact numbers of the task are checked on what it leaves."""
    from quercus.llm.distinctive import least_weight, log_entropy

    words = log_entropy(_module_terms(spark, folder, True), "zeile_id", "begriff", "modulnummer")
    words = words.where("tf >= 3").where(F.col("gewicht") >= least_weight(F.col("tf"), 3, F.col("n"))).where("gruppen <= 3")
    keys = log_entropy(read(spark, folder, "literatur"), "modulnummer", "lit_key")
    keys = keys.where(F.col("gewicht") >= least_weight(F.col("tf"), 2, F.col("n"))).where("df = 2")
    words = words.where("modulnummer is not null").select(F.lit("inhalte").alias("feld"), "modulnummer", "begriff").distinct()
    return words.unionByName(keys.select(F.lit("lit_key").alias("feld"), "modulnummer", F.col("lit_key").alias("begriff")))


def p7_weights(spark: SparkSession, folder: str) -> DataFrame:
    from quercus.llm.distinctive import log_entropy

    words = log_entropy(_module_terms(spark, folder, False), "zeile_id", "begriff")
    keys = log_entropy(read(spark, folder, "literatur"), "modulnummer", "lit_key")
    return words.select(
        F.lit("text").alias("feld"), F.col("zeile_id").cast("string").alias("satz"), "begriff", "tf", "gf", "df", F.round("gewicht", 6).alias("gewicht")
    ).unionByName(
        keys.select(F.lit("lit_key").alias("feld"), F.col("modulnummer").alias("satz"), F.col("lit_key").alias("begriff"), "tf", "gf", "df", F.round("gewicht", 6).alias("gewicht"))
    )


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    from quercus.llm.tokenise import encode_texts

    return encode_texts(read(spark, folder, "documents"), "doc_id", "text")


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a listed source with their tokens, kept as a table: counted once, used twice."""
    from quercus.llm.tokenise import count_tokens

    listed = F.broadcast(read(spark, folder, "mischung").select("source").distinct())
    return cut_lineage(count_tokens(read(spark, folder, "documents").select("doc_id", "source", "text").join(listed, "source", "left_semi"), "text"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    from quercus.llm.mixing import fair_mix

    return fair_mix(_sized(spark, folder), read(spark, folder, "mischung"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    from quercus.llm.mixing import fair_mix, shares

    sized, targets = _sized(spark, folder), read(spark, folder, "mischung")
    return shares(fair_mix(sized, targets), sized, targets)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_stats(spark, folder).where("art in ('liste', 'tabelle', 'schrott')").select("doc_id", "art")


def p10_stats(spark: SparkSession, folder: str) -> DataFrame:
    from quercus.llm.quality import text_statistics

    return text_statistics(read(spark, folder, "documents"), "doc_id", "text")


def p10_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of p10_stats that SQL can count, too."""
    return p10_stats(spark, folder).select("doc_id", "zeichen", "woerter", "mittlere_wortlaenge", "zeilen", "satzende_anteil", "haeufig_anteil")


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_repaired, p4_found, p5_found, p6_found, p6_clusters, p6_typical, p7_found, p7_weights, p8_ids, p9_mix, p9_shares, p10_found, p10_stats, p10_counts)}

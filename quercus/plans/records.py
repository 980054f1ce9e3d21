"""Queries on the records themselves: cleaning, terms, keys, contents, literature, utilisation, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quercus.config import Config
from quercus.functions import text as T
from quercus.functions.contents import content_points as outline_points
from quercus.functions.contents import grouped_text
from quercus.functions.literature import BOILERPLATE, PLACES, PUBLISHER, learned_place_shapes
from quercus.functions.literature import learn_places as places
from quercus.functions.literature import literature_entries as entries
from quercus.operators import learn as L
from quercus.operators import quality as Q
from quercus.operators import sets as S
from quercus.operators import utilisation as U
from quercus.operators import vectors as V
from quercus.session import cut_lineage, read

CONFIG = Config()
FIELDS = ["modulnummer", "modulname", "modulname_en", "fachkompetenz", "methodenkompetenz", "personale_soziale_kompetenz", "uebergreifende_handlungskompetenz", "lehr_lerneinheiten", "inhalte", "voraussetzungen", "ects", "verantwortung", "literatur"]
COMPETENCES = ["fachkompetenz", "methodenkompetenz", "personale_soziale_kompetenz", "uebergreifende_handlungskompetenz"]
TERMS = {"23/24": ["wise23_24", "sose24"], "24/25": ["wise24_25", "sose25"], "25/26": ["wise25_26", "sose26"]}
#: Prefixes of part types and the programme each stands for; the longest one counts.
PROGRAMMES = [("STANDARD", "STD", "Standard"), ("STANDARD POLISHED", "STP", "Standard poliert"), ("ECONOMY", "ECO", "Einfach"), ("PROMO", "PRO", "Werbung"), ("SMALL", "SML", "Klein"), ("MEDIUM", "MED", "Mittel"), ("LARGE", "LRG", "Groß")]
FRAMEWORK = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144]


def modules(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "module")


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    d = T.compose(read(spark, folder, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", T.clean_text(F.col("text")).alias("text"))


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return L.vocabulary(modules(spark, folder), FIELDS[1:])


def competences(spark: SparkSession, folder: str) -> DataFrame:
    """``zeile_id, modulnummer, art, text``: every competence of every row."""
    return modules(spark, folder).select("zeile_id", "modulnummer", *COMPETENCES).unpivot(["zeile_id", "modulnummer"], COMPETENCES, "art", "text").where("text is not null")


def word_casing(spark: SparkSession, folder: str) -> DataFrame:
    """The usual spelling of each word, by frequency, then by code point."""
    words = read(spark, folder, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}{3,}"), F.lit(0))).alias("w"))
    counts = words.groupBy(F.lower("w").alias("klein"), "w").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("klein").agg(F.min_by("w", F.struct((-F.col("n")).alias("m"), "w")).alias("anzeige"), F.sum("n").alias("anzahl"))


def tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    """tf-idf of the documents' terms by source."""
    return V.tfidf(V.term_rows(read(spark, folder, "documents").where("source is not null"), "source", "text"), "source", CONFIG.min_df, CONFIG.max_df).select("source", "term", "df", F.round("gewicht", 6).alias("gewicht"))


def label_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The 25 most telling terms of every module, its name counted twice: nouns and short names, no filler; a
    pair of words if it is a fixed one."""
    m = modules(spark, folder).where("modulnummer is not null").select("modulnummer", F.concat_ws(". ", "modulname", "modulname", "inhalte").alias("text"))
    w = V.tfidf(V.term_rows(m, "modulnummer", "text", V.STOPS | V.GENERIC, least=3), "modulnummer", CONFIG.min_df, CONFIG.label_max_df).withColumn("gewicht", F.round("gewicht", 9))
    named = V.noun_terms(w, V.word_forms(m, "text", 3), "modulnummer")
    return V.top_terms(named, "modulnummer", CONFIG.label_terms).select("modulnummer", F.col("rang").cast("bigint").alias("rang"), "term")


def source_cosine(spark: SparkSession, folder: str) -> DataFrame:
    w = V.tfidf(V.term_rows(read(spark, folder, "documents").where("source is not null"), "source", "text"), "source", CONFIG.min_df, CONFIG.max_df)
    return V.tfidf_cosine(w, "source").select("a", "b", F.round("cosinus", 6).alias("cosinus"))


def build_key(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "literatur").select("lit_id", T.reference_key(F.col("erstautor_nachname"), F.col("titel")).alias("schluessel"))


def key_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return S.key_frequency(read(spark, folder, "literatur"), "lit_key", "modulnummer", "eintrag_roh", "lit_id").orderBy(F.desc("anzahl"), "lit_key")


def frequent_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The head of the frequency table: the fifteen keys of the most modules."""
    return key_frequency(spark, folder).limit(15).select("lit_key", "anzahl")


def canonical_keys(spark: SparkSession, folder: str) -> DataFrame:
    return S.canonical_keys(read(spark, folder, "literatur"), "lit_key", CONFIG.fuzzy_threshold)


def lines_of(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("nr", "zeile"))
    return rows.select("doc_id", "nr", F.trim(F.regexp_replace("zeile", "\r$", "")).alias("zeile")).where("zeile <> ''")


def heading_lines(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("nr")
    marked = lines_of(spark, folder).withColumn("folgt", F.lead("zeile").over(w))
    return marked.select("doc_id", F.col("nr").cast("bigint").alias("nr"), T.is_heading(F.col("zeile"), F.col("folgt")).alias("kopf"))


def heading_fill(spark: SparkSession, folder: str) -> DataFrame:
    """The heading in force at each line, carried forward."""
    w = Window.partitionBy("doc_id").orderBy("nr")
    marked = lines_of(spark, folder).withColumn("folgt", F.lead("zeile").over(w))
    heads = marked.withColumn("h", F.when(T.is_heading(F.col("zeile"), F.col("folgt")), F.col("zeile")))
    return heads.select("doc_id", F.col("nr").cast("bigint").alias("nr"), F.last("h", ignorenulls=True).over(w).alias("kopf"))


def broken_words(spark: SparkSession, folder: str) -> DataFrame:
    return L.joined_words(competences(spark, folder), "text", vocabulary(spark, folder))


def dehyphenate(spark: SparkSession, folder: str) -> DataFrame:
    return L.dehyphenate(competences(spark, folder).drop("modulnummer"), ["zeile_id", "art"], "text", vocabulary(spark, folder))


def phrases(spark: SparkSession, folder: str) -> DataFrame:
    return L.opening_phrases(competences(spark, folder), "modulnummer", "text", CONFIG.phrase_df, *CONFIG.phrase_prefix)


def learn_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases(spark, folder)


def strip_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return L.strip_openings(competences(spark, folder).drop("modulnummer"), ["zeile_id", "art"], "text", phrases(spark, folder), CONFIG.phrase_rounds, CONFIG.phrase_prefix[1])


def removed_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return L.removed_openings(phrases(spark, folder), least=CONFIG.phrase_df)


def audit_counters(spark: SparkSession, folder: str) -> DataFrame:
    """How much cleaning takes away: artefacts of pages, broken words that are joined, phrases, notes on literature."""
    texts = competences(spark, folder)
    literature = modules(spark, folder).select(F.explode(F.regexp_extract_all("literatur", F.lit(BOILERPLATE.pattern), F.lit(0))).alias("t"))
    return L.audit({
        "Artefakte": modules(spark, folder).select(F.explode(F.array("inhalte", "lehr_lerneinheiten")).alias("t")).select(F.explode(F.regexp_extract_all("t", F.lit("|".join(f"(?:{a})" for a in T.ARTEFACTS[2:])), F.lit(0))).alias("t")),
        "Trennungen": L.broken_words(texts, "text").join(L.joined_words(texts, "text", vocabulary(spark, folder)), ["links", "rechts"], "left_semi"),
        "Floskeln": phrases(spark, folder).where(F.col("df") >= CONFIG.phrase_df),
        "Hinweise": literature.where("t <> ''"),
    })


def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents")
    s = T.sentences(F.regexp_replace("text", r"\s+", " "))
    return d.select("doc_id", F.size(s).cast("bigint").alias("saetze"), T.clip(F.get(s, F.lit(0)), 80).alias("erster"))


def content_points(spark: SparkSession, folder: str) -> DataFrame:
    return outline_points(modules(spark, folder), "zeile_id", "inhalte")


def content_texts(spark: SparkSession, folder: str) -> DataFrame:
    return grouped_text(content_points(spark, folder), "zeile_id")


def module_json(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document per module: its first headings and points, with how many there are."""
    p = content_points(spark, folder).select("zeile_id", "position", F.col("zwischenueberschrift").alias("h"), T.point_text(F.col("zwischenueberschrift"), F.col("stichpunkt")).alias("punkt"))
    heads = p.where("h <> ''").groupBy("zeile_id", "h").agg(F.min("position").alias("position"))
    first = lambda df, c, n: df.groupBy("zeile_id").agg(F.count(F.lit(1)).alias(f"{c}_n"), F.transform(F.slice(F.sort_array(F.collect_list(F.struct("position", c))), 1, n), lambda x: x[c]).alias(c))
    m = modules(spark, folder).select("zeile_id", "modulnummer", "modulname").join(first(heads, "h", CONFIG.shown_headings), "zeile_id", "left").join(first(p, "punkt", CONFIG.shown_points), "zeile_id", "left")
    doc = F.struct(F.col("modulnummer").alias("id"), F.col("modulname").alias("name"), F.col("h").alias("ueberschriften"), F.col("h_n").alias("ueberschriften_gesamt"), F.col("punkt").alias("punkte"), F.col("punkt_n").alias("punkte_gesamt"))
    return m.select("zeile_id", F.to_json(doc).alias("dokument"))


def literature_entries(spark: SparkSession, folder: str) -> DataFrame:
    return entries(modules(spark, folder), "zeile_id", "literatur", learn_places(spark, folder))


def learn_places(spark: SparkSession, folder: str) -> DataFrame:
    return places(read(spark, folder, "literatur"), "eintrag_roh", CONFIG.place_strong, CONFIG.place_weak)


def prefix_programme(spark: SparkSession, folder: str) -> DataFrame:
    """The programme of each part by the longest prefix of its type; the table of prefixes is a constant."""
    table = spark.createDataFrame(PROGRAMMES, "praefix string, kuerzel string, name string")
    p = read(spark, folder, "part").select("p_partkey", "p_type")
    hit = p.join(F.broadcast(table), F.col("p_type").startswith(F.col("praefix")), "left")
    best = hit.groupBy("p_partkey").agg(F.max_by(F.struct("kuerzel", "name"), F.length("praefix")).alias("b"))
    return best.select("p_partkey", F.coalesce("b.kuerzel", F.lit("SON")).alias("kuerzel"), F.coalesce("b.name", F.lit("Sonstige")).alias("name"))


def without_framework(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "supplier").where(~F.col("s_suppkey").isin(FRAMEWORK)).select("s_suppkey", "s_name")


def search(spark: SparkSession, folder: str) -> DataFrame:
    """The entity a text names: exactly first (name · key, key, name), else the first that contains it."""
    p = read(spark, folder, "part").select("p_partkey", "p_name")
    wanted = spark.createDataFrame([("hot ring",), ("7",), ("ring",), ("HOT",), ("nichts davon",)], "text string")
    name, key, text = F.lower("p_name"), F.col("p_partkey").cast("string"), F.lower("text")
    rank = F.when((F.concat(name, F.lit(" · "), key) == text) | (key == text) | (name == text), 0).when(name.contains(text) | key.contains(text), 1)
    hits = p.join(F.broadcast(wanted)).withColumn("rang", rank).where("rang is not null")
    return hits.groupBy("text").agg(F.min(F.struct("rang", "p_partkey")).alias("b")).select("text", "b.p_partkey")


def latest_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The last loaded version of every module."""
    w = Window.partitionBy("modulnummer").orderBy(F.desc("geladen_am"), F.desc("zeile_id"))
    return modules(spark, folder).withColumn("r", F.row_number().over(w)).where("r = 1").select("modulnummer", "zeile_id", "geladen_am")


def repeated_entries(spark: SparkSession, folder: str) -> DataFrame:
    return Q.repeated(read(spark, folder, "literatur").where("lit_key is not null"), ["modulnummer", "lit_key"], "lit_id").select("lit_id", "modulnummer", "lit_key")


def shared_names(spark: SparkSession, folder: str) -> DataFrame:
    return Q.shared_names(modules(spark, folder), "modulnummer", "modulname")


def empty_fields(spark: SparkSession, folder: str) -> DataFrame:
    return Q.empty_fields(modules(spark, folder), "zeile_id", FIELDS)


def equal_competences(spark: SparkSession, folder: str) -> DataFrame:
    return Q.equal_fields(modules(spark, folder), "zeile_id", COMPETENCES)


def uncertainty_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return Q.reasons(read(spark, folder, "literatur"), "unsicher_grund")


def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    return Q.report(modules(spark, folder), read(spark, folder, "literatur"), FIELDS, COMPETENCES)


def quality_points(spark: SparkSession, folder: str) -> DataFrame:
    return Q.point_report(modules(spark, folder), cut_lineage(content_points(spark, folder)))


def quality_overview(spark: SparkSession, folder: str) -> DataFrame:
    """Findings by how often they come, the fifteen most frequent."""
    counts = quality_report(spark, folder).groupBy("bereich", "befund").agg(F.count(F.lit(1)).alias("anzahl"))
    return counts.orderBy(F.desc("anzahl"), "bereich", "befund").limit(15)


def module_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """One row per module: whole credits, first year of its literature, doubtful entries."""
    lit = read(spark, folder, "literatur").groupBy("modulnummer").agg(F.count(F.lit(1)).alias("eintraege"), F.sum(F.col("parse_unsicher").cast("bigint")).alias("unsicher"), F.min("jahr").alias("erstes_jahr"))
    m = modules(spark, folder).select("zeile_id", "modulnummer", T.cell_number(F.col("ects")).alias("ects"))
    return m.join(lit, "modulnummer", "left").select("zeile_id", "ects", F.coalesce("eintraege", F.lit(0)).alias("eintraege"), F.coalesce("unsicher", F.lit(0)).alias("unsicher"), "erstes_jahr")


def competence_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Competences as rows, as they stand and cleaned side by side."""
    texts = competences(spark, folder).select("zeile_id", "art", F.col("text").alias("text_original"), "text")
    return T.compose(texts, "text").select("zeile_id", "art", "text_original", T.flat(T.clean_text(F.col("text"))).alias("text_bereinigt"))


def utilisation(spark: SparkSession, folder: str) -> DataFrame:
    u = U.utilisation(read(spark, folder, "auslastung"), "modulcode", "max_tn", TERMS)
    return u.select("code", "jahr_1", "jahr_2", "jahr_3", "durchf", "abgesagt", "max_tn", *[F.round(c, 6).alias(c) for c in ("je_jahr", "je_durchf", "quote")])


def utilisation_missing(spark: SparkSession, folder: str) -> DataFrame:
    return U.unmatched(modules(spark, folder), "modulnummer", read(spark, folder, "auslastung"), "modulcode")


def module_utilisation(spark: SparkSession, folder: str) -> DataFrame:
    m = modules(spark, folder).select("modulnummer").distinct()
    return m.join(utilisation(spark, folder).withColumnRenamed("code", "modulnummer"), "modulnummer").select("modulnummer", "durchf", "abgesagt")


QUERIES = {
    f.__name__: f
    for f in (
        frequent_keys, audit_counters, module_json, quality_points, quality_overview, clean_text, vocabulary, word_casing, tfidf_weights, label_terms, source_cosine, build_key, key_frequency, canonical_keys, heading_lines, heading_fill, broken_words, dehyphenate,
        learn_phrases, strip_phrases, removed_phrases, sentence_counts, content_points, content_texts, literature_entries, learn_places, prefix_programme, without_framework, search, latest_versions,
        repeated_entries, shared_names, empty_fields, equal_competences, uncertainty_reasons, quality_report, module_sheet, competence_rows, utilisation, utilisation_missing, module_utilisation,
    )
}

# ------------------------------------------------------------------ oracles

_STOPS = ", ".join(f"'{s}'" for s in sorted(V.STOPS))


def _terms(least: int, most: float, base: str = "SELECT source AS e, text AS t FROM documents WHERE source IS NOT NULL AND text IS NOT NULL", stops: str = _STOPS) -> str:
    return rf"""WITH texts AS ({base}), wl AS (SELECT e, list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_&-]{{{least},}}'), lambda w: NOT list_contains([{stops}], w)) AS w FROM texts),
grams AS (SELECT e, unnest(w) AS term FROM wl UNION ALL SELECT e, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM wl),
tf AS (SELECT e, term, count(*) AS tf FROM grams GROUP BY 1, 2), tn AS (SELECT count(DISTINCT e) AS nn FROM tf),
tdf AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= {most} * (SELECT nn FROM tn)),
raw AS (SELECT e, term, df, (ln(tf) + 1) * (ln((nn + 1.0) / (df + 1.0)) + 1) AS w FROM tf JOIN tdf USING (term), tn),
nrm AS (SELECT e, sqrt(sum(w * w)) AS norm FROM raw GROUP BY e), tw AS (SELECT e AS source, term, df, w / norm AS w FROM raw JOIN nrm USING (e))"""


_LABELS = "SELECT modulnummer AS e, concat_ws('. ', modulname, modulname, inhalte) AS t FROM module WHERE modulnummer IS NOT NULL"
_GENERIC = ", ".join(f"'{s}'" for s in sorted(V.GENERIC))
_ADJ = "(?:" + "|".join(V.ADJECTIVES) + ")$"
_COMP = "comp AS (" + " UNION ALL ".join(f"SELECT zeile_id, modulnummer, '{c}' AS art, {c} AS text FROM module WHERE {c} IS NOT NULL" for c in COMPETENCES) + ")"
_VOCAB = rf"v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(t), '\p{{L}}{{2,}}')) AS w FROM (SELECT unnest([{', '.join(FIELDS[1:])}]) AS t FROM module))"
_JOINED = rf"""b AS (SELECT unnest(regexp_extract_all(text, '{L.BROKEN}')) AS b FROM comp), p AS (SELECT split_part(b, '- ', 1) AS links, split_part(b, '- ', 2) AS rechts, count(*) AS anzahl FROM b GROUP BY 1, 2),
j AS (SELECT *, links || rechts AS wort FROM p WHERE rechts NOT IN ({', '.join(f"'{c}'" for c in L.CONJUNCTIONS)}) AND (lower(links || rechts) IN (SELECT w FROM v) OR rechts NOT IN (SELECT w FROM v)))"""
_SHORT = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)


#: Stands where a sentence ends, in SQL.
_CUT = chr(0xE001)


def _sentences(text: str) -> str:
    cut = f"regexp_replace({text}, '([.!?])\\s+([A-ZÄÖÜ„\"(])', '\\1{_CUT}\\2', 'g')"
    for _ in range(2):
        cut = f"regexp_replace({cut}, '(^|[\\s{_CUT}])((?i:{_SHORT})|[0-9]+\\.){_CUT}', '\\1\\2 ', 'g')"
    return f"string_split({cut}, '{_CUT}')"


_FLAT = r"regexp_replace(text, '[\r\n]+', ' ', 'g')"
_OPEN = rf"""s AS (SELECT modulnummer AS e, unnest({_sentences(_FLAT)}) AS s FROM comp), k AS (SELECT e, regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_*–-]+|[,;:]') AS t FROM s),
o AS (SELECT e, t[1:n] AS p FROM (SELECT e, t, unnest(range(2, least(len(t) - 1, 12) + 1)) AS n FROM k WHERE len(t) > 2)),
c AS (SELECT array_to_string(p, ' ') AS phrase, count(DISTINCT e) AS df FROM o WHERE len(list_filter(p, lambda w: NOT list_contains([{', '.join(f"'{w}'" for w in L.FUNCTION_WORDS)}], w))) > 0 GROUP BY 1),
seed(phrase) AS (VALUES {', '.join(f"('{x}')" for x in L.SEEDS)}),
phr AS (SELECT phrase, df FROM c WHERE df >= 8 OR phrase IN (SELECT phrase FROM seed) UNION ALL SELECT phrase, 0 FROM seed WHERE phrase NOT IN (SELECT phrase FROM c))"""


def _clean(source: str, keys: str) -> str:
    """SQL of the cleaned texts of ``source`` (keys, text): ``keys, t`` where t is as before cleaning and l its lines."""
    x = "nfc_normalize(text)"
    for vowel, umlaut in zip("aouAOU", "äöüÄÖÜ"):
        x = f"replace({x}, '{vowel}¨', '{umlaut}')"
    for a, b in ((r"[\x{00ad}\x{200b}\x{feff}]", "''"), (r"¬\s*", "''"), (r"\r\n?", "chr(10)"), (r"[\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}\t]", "' '"), (r"\[\*\]", "chr(10) || '• '"), *((a, "chr(10)") for a in T.ARTEFACTS)):
        x = f"regexp_replace({x}, '{a}', {b}, 'g')"
    return rf"""a AS (SELECT {keys}, text, {x} AS t FROM ({source})), l AS (SELECT {keys}, text, t, list_transform(string_split(t, chr(10)), lambda s: regexp_replace(trim(regexp_replace(s, ' +', ' ', 'g')), '^(?:[-–•▪*?] ?)([^\s])', '- \1')) AS l FROM a),
 rein AS (SELECT {keys}, text AS original, CASE WHEN t IS NULL THEN NULL ELSE array_to_string(list_filter(l, lambda s: NOT regexp_matches(s, '^[-–•▪*?]?$')), chr(10)) END AS text FROM l)"""


_STOP_TITLE = ", ".join(f"'{s}'" for s in T.TITLE_STOPS)
_NORM = f"regexp_replace(translate(replace(lower({{}}), 'ß', 'ss'), '{T.PLAIN[0]}', '{T.PLAIN[1]}'), '[^a-z0-9]', '', 'g')"
_LAST = r"regexp_extract(coalesce(erstautor_nachname, ''), '(\S+)\s*$', 1)"
_LINES = r"lines AS (SELECT doc_id, i - 1 AS nr, trim(regexp_replace(p[i], '\r$', '')) AS zeile FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)), kept AS (SELECT * FROM lines WHERE zeile <> ''), lag_ AS (SELECT *, lead(zeile) OVER (PARTITION BY doc_id ORDER BY nr) AS folgt FROM kept)"
_KOPF = r"""(coalesce(length(zeile) <= 80 AND upper(zeile) = zeile AND length(regexp_replace(zeile, '[^\p{L}]', '', 'g')) >= 3, false)
 OR (ends_with(zeile, ':') AND len(regexp_split_to_array(zeile, '\s+')) <= 10)
 OR (NOT regexp_matches(zeile, '[.,;]$') AND coalesce((regexp_matches(folgt, '^(?:[-–•▪*]|\d+[.)])') AND len(regexp_split_to_array(zeile, '\s+')) <= 15) OR (len(regexp_split_to_array(zeile, '\s+')) <= 5 AND NOT contains(zeile, ',') AND length(folgt) > length(zeile)), false)))"""
_PROG = ", ".join(f"('{p}', '{k}', '{n}')" for p, k, n in PROGRAMMES)
_CELLS = ", ".join(c for cs in TERMS.values() for c in cs)
_NUM = "CAST(trunc(TRY_CAST(replace(trim({}), ',', '.') AS DOUBLE)) AS BIGINT)"

_EMPTY = " UNION ALL ".join(f"SELECT '{f}' AS feld, count(*) AS anzahl, array_to_string(list_transform(list(zeile_id ORDER BY zeile_id)[1:50], lambda z: z::VARCHAR), '; ') AS schluessel FROM module WHERE trim(coalesce({f}, '')) = '' HAVING count(*) > 0" for f in FIELDS)
_DOUBT = "(SELECT grund, count(*) AS n FROM (SELECT unnest(string_split(unsicher_grund, '; ')) AS grund FROM literatur WHERE unsicher_grund <> '') GROUP BY grund)"
_REPORT = f"""SELECT 'Module' AS bereich, 'Zeilen' AS befund, '' AS schluessel, count(*)::VARCHAR AS wert, '' AS details FROM module
 UNION ALL SELECT 'Literatur', 'Einträge', '', count(*)::VARCHAR, '' FROM literatur UNION ALL SELECT 'Literatur', 'verschiedene Schlüssel', '', count(DISTINCT lit_key)::VARCHAR, '' FROM literatur
 UNION ALL SELECT 'Literatur', 'unsicher', '', count(*) FILTER (parse_unsicher)::VARCHAR, printf('%.1f %%', 100.0 * count(*) FILTER (parse_unsicher) / nullif(count(*), 0)) FROM literatur
 UNION ALL SELECT 'Literatur', 'ohne Ort', '', count(*) FILTER (coalesce(ort, '') = '')::VARCHAR, '' FROM literatur
 UNION ALL SELECT 'Literatur', 'Einträge je Modul (Median)', '', trunc(quantile_cont(n, 0.5))::BIGINT::VARCHAR, '' FROM (SELECT count(*) AS n FROM literatur GROUP BY modulnummer)
 UNION ALL SELECT 'Literatur', 'Grund der Unsicherheit', '', n::VARCHAR, grund FROM {_DOUBT} UNION ALL SELECT 'Module', 'leeres Feld', schluessel, anzahl::VARCHAR, feld FROM ({_EMPTY})
 UNION ALL SELECT 'Module', 'ohne Literatur', coalesce(modulnummer, ''), '', '' FROM module m WHERE NOT EXISTS (SELECT 1 FROM literatur l WHERE l.modulnummer = m.modulnummer)
 UNION ALL SELECT 'Kompetenzen', 'gleicher Text', zeile_id::VARCHAR, '', a || ' = ' || b FROM ({" UNION ALL ".join(f"SELECT zeile_id, '{a}' AS a, '{b}' AS b FROM module WHERE trim({a}) <> '' AND {a} = {b}" for i, a in enumerate(COMPETENCES) for b in COMPETENCES[i + 1 :])})
 UNION ALL SELECT 'Literatur', 'doppelt', coalesce(modulnummer, ''), '', lit_key FROM (SELECT modulnummer, lit_key FROM literatur WHERE lit_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY modulnummer, lit_key ORDER BY lit_id) > 1)
 UNION ALL SELECT 'Module', 'gleicher Name', string_agg(DISTINCT modulnummer, '; ' ORDER BY modulnummer), count(DISTINCT modulnummer)::VARCHAR, modulname FROM module WHERE trim(modulname) <> '' GROUP BY modulname HAVING count(DISTINCT modulnummer) > 1"""
_SHAPES = " UNION ALL ".join(f"SELECT unnest(regexp_extract_all(l, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS ort, {w} AS w FROM z" for p, w in learned_place_shapes())
_PLACES = rf"""WITH z AS (SELECT l FROM (SELECT unnest(regexp_split_to_array(eintrag_roh, '[
]+')) AS l FROM literatur) WHERE trim(l) <> ''), f AS ({_SHAPES}), c AS (SELECT ort, count(*) FILTER (w = 0) AS stark, count(*) FILTER (w = 1) AS schwach FROM f GROUP BY ort)
 SELECT ort, stark, schwach FROM c WHERE (stark >= 2 OR schwach >= 3) AND length(ort) > 3 AND ort NOT IN ({', '.join(f"'{p}'" for p in PLACES)}) AND NOT regexp_matches(ort, '{PUBLISHER.pattern}', 'i')
 AND NOT regexp_matches(ort, '(?:ung|keit|heit|ment|ing|tion|schaft|ismus|lehre|recht|ik|ie)$') AND lower(ort) NOT IN ({_STOP_TITLE})"""

SQL = {
    "vocabulary": f"WITH {_VOCAB} SELECT w AS wort FROM v",
    "word_casing": r"WITH w AS (SELECT unnest(regexp_extract_all(text, '\p{L}{3,}')) AS w FROM documents), c AS (SELECT lower(w) AS klein, w, count(*) AS n FROM w GROUP BY 1, 2) SELECT klein, first(w ORDER BY n DESC, encode(w)) AS anzeige, sum(n)::BIGINT AS anzahl FROM c GROUP BY klein",
    "tfidf_weights": _terms(2, 0.5) + " SELECT source, term, df, round(w, 6) AS gewicht FROM tw",
    "label_terms": _terms(3, 0.3, _LABELS, f"{_STOPS}, {_GENERIC}") + rf""", form AS (SELECT lower(w) AS k, first(w ORDER BY n DESC, encode(w)) AS f FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}_&-]{{3,}}')) AS w FROM texts) GROUP BY w) GROUP BY 1),
 part AS (SELECT DISTINCT term, df, split_part(term, ' ', 1) AS x, split_part(term, ' ', 2) AS y FROM tw),
 good AS (SELECT p.term FROM part p JOIN form f ON f.k = p.x LEFT JOIN form g ON g.k = p.y LEFT JOIN tdf dx ON dx.term = p.x LEFT JOIN tdf dy ON dy.term = p.y WHERE regexp_matches(f.f, '^\p{{Lu}}') AND
 CASE WHEN p.y = '' THEN NOT regexp_matches(p.x, '{_ADJ}') ELSE regexp_matches(g.f, '^\p{{Lu}}') AND NOT regexp_matches(p.y, '{_ADJ}') AND p.df >= 3 AND p.df >= 0.6 * least(coalesce(dx.df, 1000000000), coalesce(dy.df, 1000000000)) END)
 SELECT source AS modulnummer, row_number() OVER (PARTITION BY source ORDER BY round(w, 9) DESC, encode(term)) AS rang, term FROM tw WHERE term IN (SELECT term FROM good) QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(w, 9) DESC, encode(term)) <= 25""",
    "source_cosine": _terms(2, 0.5) + " SELECT x.source AS a, y.source AS b, round(sum(x.w * y.w), 6) AS cosinus FROM tw x JOIN tw y ON x.term = y.term AND x.source < y.source GROUP BY 1, 2",
    "build_key": rf"""WITH k AS (SELECT lit_id, {_NORM.format(_LAST)} AS name,
 array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_split_to_array(titel, ': | – |\. |\? ')[1], '\s+'), lambda w: {_NORM.format("w")}), lambda w: w <> '' AND NOT list_contains([{_STOP_TITLE}], w))[1:3], '_') AS rest FROM literatur)
 SELECT lit_id, CASE WHEN name = '' AND rest = '' THEN '' WHEN rest = '' THEN CASE WHEN name = '' THEN 'ohneautor' ELSE name END ELSE CASE WHEN name = '' THEN 'ohneautor' ELSE name END || '_' || rest END AS schluessel FROM k""",
    "key_frequency": "SELECT lit_key, count(DISTINCT modulnummer) AS anzahl, string_agg(DISTINCT modulnummer, '; ' ORDER BY modulnummer DESC) AS entities, arg_min(eintrag_roh, lit_id) AS beispiel FROM literatur WHERE lit_key <> '' AND NOT starts_with(lit_key, 'ohneautor') GROUP BY lit_key",
    "heading_lines": f"WITH {_LINES} SELECT doc_id, nr, {_KOPF} AS kopf FROM lag_",
    "heading_fill": f"WITH {_LINES} SELECT doc_id, nr, last_value(CASE WHEN {_KOPF} THEN zeile END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kopf FROM lag_",
    "prefix_programme": f"WITH t(praefix, kuerzel, name) AS (VALUES {_PROG}), h AS (SELECT p_partkey, kuerzel, name, row_number() OVER (PARTITION BY p_partkey ORDER BY length(praefix) DESC NULLS LAST) AS r FROM part LEFT JOIN t ON starts_with(p_type, praefix)) SELECT p_partkey, coalesce(kuerzel, 'SON') AS kuerzel, coalesce(name, 'Sonstige') AS name FROM h WHERE r = 1",
    "without_framework": f"SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN ({', '.join(map(str, FRAMEWORK))})",
    "search": "WITH w(text) AS (VALUES ('hot ring'), ('7'), ('ring'), ('HOT'), ('nichts davon')), h AS (SELECT text, p_partkey, CASE WHEN lower(p_name) || ' · ' || p_partkey = lower(text) OR p_partkey::VARCHAR = lower(text) OR lower(p_name) = lower(text) THEN 0 WHEN contains(lower(p_name), lower(text)) OR contains(p_partkey::VARCHAR, lower(text)) THEN 1 END AS r FROM part, w) SELECT text, p_partkey FROM h WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY r, p_partkey) = 1",
    "latest_versions": "SELECT modulnummer, zeile_id, geladen_am FROM module QUALIFY row_number() OVER (PARTITION BY modulnummer ORDER BY geladen_am DESC NULLS LAST, zeile_id DESC) = 1",
    "repeated_entries": "SELECT lit_id, modulnummer, lit_key FROM literatur WHERE lit_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY modulnummer, lit_key ORDER BY lit_id) > 1",
    "shared_names": "SELECT modulname, count(DISTINCT modulnummer) AS anzahl, string_agg(DISTINCT modulnummer, '; ' ORDER BY modulnummer) AS schluessel FROM module WHERE trim(modulname) <> '' GROUP BY modulname HAVING count(DISTINCT modulnummer) > 1",
    "empty_fields": f"SELECT feld, anzahl, schluessel FROM ({_EMPTY})",
    "equal_competences": " UNION ALL ".join(f"SELECT zeile_id, '{a}' AS a, '{b}' AS b FROM module WHERE trim({a}) <> '' AND {a} = {b}" for i, a in enumerate(COMPETENCES) for b in COMPETENCES[i + 1 :]),
    "uncertainty_reasons": "SELECT grund, count(*) AS anzahl FROM (SELECT unnest(string_split(unsicher_grund, '; ')) AS grund FROM literatur WHERE unsicher_grund <> '') GROUP BY grund",
    "module_sheet": f"WITH l AS (SELECT modulnummer, count(*) AS n, sum(parse_unsicher::BIGINT)::BIGINT AS u, min(jahr) AS j FROM literatur GROUP BY 1) SELECT zeile_id, {_NUM.format('ects')} AS ects, coalesce(n, 0) AS eintraege, coalesce(u, 0) AS unsicher, j AS erstes_jahr FROM module LEFT JOIN l USING (modulnummer)",
    "competence_rows": f"WITH {_COMP}, {_clean('SELECT * FROM comp', 'zeile_id, art')} SELECT zeile_id, art, original AS text_original, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text_bereinigt FROM rein",
    "utilisation": f"""WITH l AS (SELECT trim(modulcode) AS code, jahr, c, {_NUM.format('max_tn')} AS m, coalesce(length(trim(concat_ws('', {_CELLS}))) > 0, false) AS aktiv FROM (
 {' UNION ALL '.join(f"SELECT *, '{y}' AS jahr, {c} AS c FROM auslastung" for y, cs in TERMS.items() for c in cs)})),
 k AS (SELECT *, CASE WHEN upper(trim(c)) = 'X' THEN 'x' WHEN trim(c) = '' THEN NULL WHEN TRY_CAST(trim(c) AS DOUBLE) IS NOT NULL THEN 'h' END AS art FROM l WHERE code <> ''),
 g AS (SELECT code, coalesce(sum(CASE WHEN art = 'h' AND jahr = '23/24' THEN {_NUM.format('c')} END), 0)::BIGINT AS jahr_1, coalesce(sum(CASE WHEN art = 'h' AND jahr = '24/25' THEN {_NUM.format('c')} END), 0)::BIGINT AS jahr_2, coalesce(sum(CASE WHEN art = 'h' AND jahr = '25/26' THEN {_NUM.format('c')} END), 0)::BIGINT AS jahr_3,
 count(*) FILTER (art = 'h') AS durchf, count(*) FILTER (art = 'x') AS abgesagt, max(CASE WHEN aktiv THEN m END) AS max_tn FROM k GROUP BY code)
 SELECT *, round((jahr_1 + jahr_2 + jahr_3) / 3.0::DOUBLE, 6) AS je_jahr, round((jahr_1 + jahr_2 + jahr_3)::DOUBLE / nullif(durchf, 0), 6) AS je_durchf, round((jahr_1 + jahr_2 + jahr_3)::DOUBLE / nullif(durchf, 0) / nullif(max_tn, 0), 6) AS quote FROM g""",
    "clean_text": f"WITH {_clean('SELECT doc_id, text FROM documents', 'doc_id')} SELECT doc_id, text FROM rein",
    "broken_words": f"WITH {_COMP}, {_VOCAB}, {_JOINED} SELECT links, rechts, anzahl, wort FROM j",
    "dehyphenate": f"""WITH {_COMP}, {_VOCAB}, {_JOINED}, js AS (SELECT coalesce(list(links || '- ' || rechts), []) AS js FROM j)
 SELECT zeile_id, art, array_to_string(list_transform(list_zip(string_split_regex(text, '{L.BROKEN}'), list_append(regexp_extract_all(text, '{L.BROKEN}'), '')), lambda z: z[1] || CASE WHEN list_contains(js, z[2]) THEN replace(z[2], '- ', '') ELSE z[2] END), '') AS text FROM comp, js""",
    "learn_phrases": f"WITH {_COMP}, {_OPEN} SELECT phrase, len(string_split(phrase, ' '))::INT AS n, df FROM phr",
    "removed_phrases": f"WITH {_COMP}, {_OPEN} SELECT phrase, df, CASE WHEN df >= 8 THEN 'gelernt' ELSE 'vorgegeben' END AS quelle FROM phr",
    "sentence_counts": rf"WITH s AS (SELECT doc_id, {_sentences(r"regexp_replace(text, '\s+', ' ', 'g')")} AS s FROM documents) SELECT doc_id, len(s) AS saetze, CASE WHEN length(s[1]) <= 80 THEN s[1] ELSE coalesce(nullif(regexp_extract(left(s[1], 80), '^(.*)\s\S*$', 1), ''), left(s[1], 80)) || ' …' END AS erster FROM s",
    "frequent_keys": "SELECT lit_key, count(DISTINCT modulnummer) AS anzahl FROM literatur WHERE lit_key <> '' AND NOT starts_with(lit_key, 'ohneautor') GROUP BY lit_key ORDER BY anzahl DESC, encode(lit_key) LIMIT 15",
    "canonical_keys": f"""WITH RECURSIVE k AS (SELECT DISTINCT lit_key AS k, split_part(lit_key, '_', 1) AS a, regexp_extract(lit_key, '^[^_]*_(.*)$', 1) AS t FROM literatur WHERE lit_key IS NOT NULL), q AS (SELECT x.k, y.k AS k2, x.t, y.t AS u FROM k x JOIN k y ON x.a = y.a AND x.k < y.k WHERE x.t <> '' AND y.t <> '' AND least(length(x.t), length(y.t)) >= 88.0 / 112.0 * greatest(length(x.t), length(y.t))),
 m AS (SELECT *, list_transform(string_split(u, ''), lambda c: list_sum(list_transform(range(1, length(t) + 1), lambda i: CASE WHEN t[i] = c THEN (1::HUGEINT << (i - 1)::INT) ELSE 0::HUGEINT END))::HUGEINT) AS ms, (1::HUGEINT << length(t)::INT) - 1 AS voll FROM q),
 r AS (SELECT k, k2, length(t) AS n, length(u) AS o, list_reduce(ms, lambda z, x: ((z + (z & x)) | (z - (z & x))) & voll, voll) AS z FROM m), e AS (SELECT k AS a, k2 AS b FROM r WHERE 200.0 * (n - bit_count(z)) / (n + o) >= 88 UNION ALL SELECT k2, k FROM r WHERE 200.0 * (n - bit_count(z)) / (n + o) >= 88),
 g AS (SELECT k AS k, k AS m FROM k UNION SELECT e.b, g.m FROM g JOIN e ON e.a = g.k) SELECT k AS key, min(m) AS kanon FROM g GROUP BY k""",
    "learn_places": _PLACES,
    "quality_report": _REPORT,
    "quality_overview": f"SELECT bereich, befund, count(*) AS anzahl FROM ({_REPORT}) GROUP BY 1, 2 ORDER BY anzahl DESC, bereich, befund LIMIT 15",
    "audit_counters": rf"""WITH {_COMP}, {_VOCAB}, {_JOINED}, {_OPEN} SELECT 'Trennungen' AS zaehler, coalesce(sum(anzahl), 0)::BIGINT AS anzahl FROM j UNION ALL SELECT 'Floskeln', count(*) FROM phr WHERE df >= 8
 UNION ALL SELECT 'Artefakte', coalesce(sum(len(regexp_extract_all(t, '{"|".join(f"(?:{a})" for a in T.ARTEFACTS[2:])}'))), 0)::BIGINT FROM (SELECT unnest([inhalte, lehr_lerneinheiten]) AS t FROM module)
 UNION ALL SELECT 'Hinweise', coalesce(sum(len(list_filter(regexp_extract_all(literatur, '{BOILERPLATE.pattern}'), lambda x: x <> ''))), 0)::BIGINT FROM module""",
    "utilisation_missing": "SELECT DISTINCT modulnummer FROM module WHERE modulnummer IS NOT NULL AND modulnummer NOT IN (SELECT trim(modulcode) FROM auslastung WHERE modulcode IS NOT NULL)",
}
SQL["module_utilisation"] = f"SELECT modulnummer, durchf, abgesagt FROM ({SQL['utilisation']}) u JOIN (SELECT DISTINCT modulnummer FROM module) m ON m.modulnummer = u.code"

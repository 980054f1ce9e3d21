"""Exchange formats: what is written comes back the same; handbooks, workbooks, file choice, parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus.config import Config, check_parameters
from quercus.functions import text as T
from quercus.operators import vectors as V
from quercus.session import read, shared_path
from quercus.sources import tables as S
from quercus.sources.markdown import parse_handbooks

CONFIG = Config()
TYPED = ["titel", "ort", "eintrag_roh", "unsicher_grund"]
SHEET = ["modulcode", "max_tn", "wise23_24", "sose24", "wise24_25", "sose25", "wise25_26", "sose26"]


def csv_strings(spark: SparkSession, folder: str) -> DataFrame:
    """The reading list as a quoted CSV with cells of several lines, read back all-string: missing is empty."""
    path = shared_path(spark, "csv")
    S.write_csv(read(spark, folder, "literatur").select(F.col("lit_id").cast("string").alias("lit_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in TYPED]), path)
    back = S.require(S.read_csv(spark, path), ["lit_id", *TYPED])
    return back.select(F.col("lit_id").cast("bigint").alias("lit_id"), *TYPED)


def csv_missing(spark: SparkSession, folder: str) -> DataFrame:
    """The same, empty cells taken as missing."""
    path = shared_path(spark, "csv")
    S.write_csv(read(spark, folder, "literatur").select(F.col("lit_id").cast("string").alias("lit_id"), *TYPED), path)
    return S.read_csv(spark, path, keep_empty=False).select(F.col("lit_id").cast("bigint").alias("lit_id"), *TYPED)


def workbook_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The utilisation sheet as workbooks of 500 runs, read back cell by cell."""
    a = read(spark, folder, "auslastung").select(F.col("lauf_id").cast("string").alias("lauf_id"), *SHEET)
    books = S.workbooks(a, F.floor(F.col("lauf_id").cast("bigint") / 500), "Datenbasis")
    back = S.parse_workbooks(books, "content", "Datenbasis", ["lauf_id", *SHEET])
    return back.select(F.col("lauf_id").cast("bigint").alias("lauf_id"), *SHEET)


def json_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as JSON documents, one a line, read back by schema."""
    path = shared_path(spark, "json")
    c = read(spark, folder, "customer").select(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("konto")).alias("d"))
    S.write_json(c, "d", path)
    return S.read_json(spark, path, "id bigint, name string, konto double")


def latest_file(spark: SparkSession, folder: str) -> DataFrame:
    """Of files named by date the latest: those of the utilisation sheet, by the days it was loaded."""
    a = read(spark, folder, "auslastung").select(F.concat(F.lit("daten/20200101_auslastung_"), F.date_format("geladen_am", "yyyyMMdd"), F.lit("_"), F.col("lauf_id") % 7, F.lit(".xlsx")).alias("path"))
    return S.latest(a, "path")


def optional_source(spark: SparkSession, folder: str) -> DataFrame:
    """A table that need not be there: regions, and none of a table that isn't."""
    empty = spark.createDataFrame([], "r_regionkey int, r_name string")
    there = S.optional(lambda: read(spark, folder, "region"), empty)
    absent = S.optional(lambda: read(spark, folder, "no_such_table"), empty)
    return there.select("r_regionkey", "r_name").unionByName(absent)


def _simple(column: str):
    return T.flat(F.regexp_replace(F.coalesce(column, F.lit("")), r"[^\p{L}\p{N} .,-]", " "))


def markdown_modules(spark: SparkSession, folder: str) -> DataFrame:
    """The modules written as Markdown handbooks and read back."""
    m = read(spark, folder, "module").where(r"modulnummer rlike '^W3M\\d{5}$' and trim(modulname) <> ''")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    english = _simple("modulname_en")
    text = F.concat_ws(
        "\n", line("## **", _simple("modulname"), " (", F.col("modulnummer"), ")**"), F.when(english != "", line("### **", english, "**")), F.lit("|ECTS-LEISTUNGSPUNKTE|DAVON SELBSTSTUDIUM|\n|---|---|"),
        line("|150|", F.coalesce(F.nullif(F.trim("ects"), F.lit("")), F.lit("–")), "|"), line("### **FACHKOMPETENZ**\n", _simple("fachkompetenz")), line("### **METHODENKOMPETENZ**\n", _simple("methodenkompetenz")),
        F.lit("|LERNEINHEITEN UND INHALTE|PRÄSENZZEIT|SELBSTSTUDIUM|\n|---|---|---|"), line("|", _simple("modulname"), "|30|60|\n|", english, "|||"), F.lit("### **BESONDERHEITEN**\nkeine\n### **VORAUSSETZUNGEN**"), _simple("voraussetzungen"),
    )
    back = parse_handbooks(m.select(text.alias("t")), "t")
    return back.select("modulnummer", "modulname", "modulname_en", "ects", "fachkompetenz", "methodenkompetenz", "lehr_lerneinheiten", "voraussetzungen")


def text_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """The key of each text in the cache of vectors."""
    return read(spark, folder, "documents").select("doc_id", T.text_hash("hash-64", F.col("text")).alias("hash"))


def embedding_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that are new to a cache which has those of every other document, by content hash."""
    d = read(spark, folder, "documents").select("doc_id", "text")
    known = V.embed_new(d.where("doc_id % 2 = 0"), "doc_id", "text", None)
    return V.embed_new(d, "doc_id", "text", known).select("hash", F.size("vektor").cast("bigint").alias("laenge"))


def labelled_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles behind their place, as points stand behind their heading."""
    return read(spark, folder, "literatur").select("lit_id", T.point_text(F.col("ort"), F.col("titel")).alias("text"))


def semester_table(spark: SparkSession, folder: str) -> DataFrame:
    """The terms of every academic year of the utilisation sheet."""
    from quercus.plans.records import TERMS

    years = spark.createDataFrame([(y,) for y in TERMS], "jahr string")
    return years.select("jahr", F.posexplode(T.semesters(F.col("jahr"))).alias("nr", "semester")).select("jahr", F.col("nr").cast("bigint").alias("nr"), "semester")


def weight_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Weights as shares of all weights, and what invalid view parameters fall back to."""
    shares = [(d, round(CONFIG.share(d), 6)) for d in CONFIG.weights]
    tried = {"gut": ({"contents": 10, "competences": 0, "literature": 100}, 8, 50), "leer": ({"contents": 0, "competences": 0, "literature": 0}, 7, 500), "tief": ({"contents": 1, "competences": 1, "literature": 1}, 0, 3)}
    for name, (weights, cap, k) in tried.items():
        w, c, n = check_parameters(weights, cap, k, 158, 40)
        shares += [(f"{name} {x}", float(v)) for x, v in (*w.items(), ("cap", c), ("k", n))]
    return spark.createDataFrame(shares, "name string, wert double")


QUERIES = {f.__name__: f for f in (csv_strings, csv_missing, workbook_rows, json_rows, latest_file, optional_source, markdown_modules, text_hashes, embedding_cache, labelled_titles, semester_table, weight_shares)}

_S = r"trim(regexp_replace(regexp_replace(coalesce({}, ''), '[^\p{{L}}\p{{N}} .,-]', ' ', 'g'), '\s+', ' ', 'g'))"
_HASH = "left(sha256(CASE WHEN text IS NULL THEN 'hash-64' ELSE 'hash-64' || chr(31) || text END), 16)"

SQL = {
    "csv_strings": "SELECT lit_id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in TYPED) + " FROM literatur",
    "csv_missing": "SELECT lit_id, " + ", ".join(f"nullif({c}, '') AS {c}" for c in TYPED) + " FROM literatur",
    "workbook_rows": f"SELECT lauf_id, {', '.join(SHEET)} FROM auslastung",
    "json_rows": "SELECT c_custkey AS id, c_name AS name, c_acctbal AS konto FROM customer",
    "latest_file": "SELECT 'daten/20200101_auslastung_' || d || '_' || n || '.xlsx' AS pfad FROM (SELECT strftime(geladen_am, '%Y%m%d') AS d, lauf_id % 7 AS n FROM auslastung) ORDER BY d DESC, n DESC LIMIT 1",
    "optional_source": "SELECT r_regionkey, r_name FROM region",
    "markdown_modules": f"""SELECT modulnummer, {_S.format('modulname')} AS modulname, coalesce(nullif({_S.format('modulname_en')}, ''), 'FACHKOMPETENZ') AS modulname_en, CASE WHEN regexp_full_match(trim(ects), '\\d+([.,]\\d+)?') THEN trim(ects) ELSE '' END AS ects,
 {_S.format('fachkompetenz')} AS fachkompetenz, {_S.format('methodenkompetenz')} AS methodenkompetenz, {_S.format('modulname')} AS lehr_lerneinheiten, {_S.format('voraussetzungen')} AS voraussetzungen FROM module WHERE regexp_full_match(modulnummer, 'W3M\\d{{5}}') AND trim(modulname) <> ''""",
    "text_hashes": f"SELECT doc_id, {_HASH} AS hash FROM documents",
    "embedding_cache": f"SELECT DISTINCT {_HASH} AS hash, CASE WHEN text <> '' THEN 64 END AS laenge FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)",
    "labelled_titles": "SELECT lit_id, CASE WHEN trim(coalesce(ort, '')) <> '' THEN ort || ': ' || titel ELSE titel END AS text FROM literatur",
    "semester_table": "SELECT * FROM (VALUES ('23/24', 0::BIGINT, 'WiSe23/24'), ('23/24', 1, 'SoSe24'), ('24/25', 0, 'WiSe24/25'), ('24/25', 1, 'SoSe25'), ('25/26', 0, 'WiSe25/26'), ('25/26', 1, 'SoSe26')) t(jahr, nr, semester)",
    "weight_shares": "SELECT name, wert::DOUBLE AS wert FROM (VALUES ('contents', 0.45), ('competences', 0.35), ('literature', 0.2), ('gut contents', 10), ('gut competences', 0), ('gut literature', 100), ('gut cap', 8), ('gut k', 118), ('leer contents', 45), ('leer competences', 35), ('leer literature', 20), ('leer cap', 5), ('leer k', 158), ('tief contents', 1), ('tief competences', 1), ('tief literature', 1), ('tief cap', 0), ('tief k', 118)) t(name, wert)",
}

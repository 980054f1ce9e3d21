"""Dictionaries learned from the corpus: vocabulary, opening phrases; and what they are used for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quercus.functions.text import CONJUNCTIONS, sentences
from quercus.session import cut_lineage

# Words that alone make no phrase, and phrases taken as known from the start.
FUNCTION_WORDS = ["der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einer", "und", "oder", "in", "im", "zu", "zur", "zum", "von", "vom", "mit", "für", "auf", "an", "am", "bei", "sie", "es", "the", "a", "an", "of", "to", "and", "is", "on", "with", ",", ";", ":"]
SEEDS = [
    "die studierenden sind nach abschluss des moduls in der lage ,", "nach abschluss des moduls sind die studierenden in der lage ,", "die studierenden sind in der lage ,", "die studierenden können",
    "sie sind in der lage ,", "sie können", "students are able to", "students", "the students are able to", "after completing the module , students are able to", "students can", "they are able to", "they can", "they have",
]
SUBJECTS = [["sie"], ["die", "studierenden"], ["die", "absolventinnen", "und", "absolventen"], ["they"], ["students"]]
GOES_ON = ["und", "sowie", "oder", "bzw", "and", "or", ","]


def vocabulary(texts: DataFrame, columns: list[str]) -> DataFrame:
    """``wort``: the distinct lower-case words of the columns."""
    one = F.explode(F.array(*columns))
    return texts.select(one.alias("t")).select(F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}{2,}"), F.lit(0))).alias("wort")).distinct()


#: A word that was broken in two, ``Unter- nehmen``: whole words, as a run of letters begins where the one before it ends.
BROKEN = r"\p{L}{2,}- \p{Ll}{2,}"


def broken_words(texts: DataFrame, text: str) -> DataFrame:
    """``links, rechts``: every broken word of the texts, but those before a conjunction."""
    found = texts.select(F.explode(F.regexp_extract_all(text, F.lit(BROKEN), F.lit(0))).alias("b"))
    both = found.select(F.substring_index("b", "- ", 1).alias("links"), F.substring_index("b", "- ", -1).alias("rechts"))
    return both.where(~F.col("rechts").isin(CONJUNCTIONS))


def joined_words(texts: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """``links, rechts, anzahl, wort``: broken words that are joined - the joined form is a known
    word, or the right half is none. The vocabulary is joined, never collected."""
    pairs = broken_words(texts, text).groupBy("links", "rechts").agg(F.count(F.lit(1)).alias("anzahl"))
    pairs = pairs.withColumn("wort", F.concat("links", "rechts"))
    whole = known.select(F.col("wort").alias("w1"), F.lit(True).alias("k1"))
    half = known.select(F.col("wort").alias("w2"), F.lit(True).alias("k2"))
    out = pairs.join(whole, F.lower("wort") == F.col("w1"), "left").join(half, F.col("rechts") == F.col("w2"), "left")
    return out.where("k1 or k2 is null").select("links", "rechts", "anzahl", "wort")


def dehyphenate(texts: DataFrame, keys: list[str], text: str, known: DataFrame) -> DataFrame:
    """``texts`` with broken words joined, each as a whole word. ``keys`` tell the texts apart; a text
    meets only its own joins, by an equi-join on them, and one without broken words none."""
    broken = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(BROKEN), F.lit(0)))).alias("_b")
    joins = joined_words(texts, text, known).select(F.concat("links", F.lit("- "), "rechts").alias("_b"))
    by_key = texts.select(*keys, broken).join(joins, "_b").groupBy(*keys).agg(F.collect_set("_b").alias("_j"))
    out = texts.join(by_key, keys, "left")
    fixed = F.transform(F.regexp_extract_all(text, F.lit(BROKEN), F.lit(0)), lambda b: F.when(F.array_contains("_j", b), F.replace(b, F.lit("- "), F.lit(""))).otherwise(b))
    whole = F.array_join(F.zip_with(F.split(text, BROKEN, -1), fixed, lambda gap, b: F.concat(gap, F.coalesce(b, F.lit("")))), "")
    return out.withColumn(text, F.when(F.col("_j").isNull(), F.col(text)).otherwise(whole)).drop("_j")


def tokens(sentence):
    return F.regexp_extract_all(F.lower(sentence), F.lit(r"[\p{L}\p{N}_*–-]+|[,;:]"), F.lit(0))


def opening_phrases(texts: DataFrame, entity: str, text: str, least: int = 8, shortest: int = 2, longest: int = 12) -> DataFrame:
    """``phrase, n, df``: openings of sentences, shorter than them, of at least ``least`` entities.

    Every sentence yields at most longest - shortest + 1 openings; openings of function
    words only are none. The seeds are among them with the df they have, maybe 0.
    """
    s = texts.select(entity, F.explode(sentences(F.regexp_replace(text, "[\r\n]+", " "))).alias("s")).select(entity, tokens(F.col("s")).alias("t"))
    upto = F.least(F.size("t") - 1, F.lit(longest))
    openings = s.where(F.size("t") > shortest).select(entity, F.explode(F.transform(F.sequence(F.lit(shortest), upto), lambda n: F.slice("t", 1, n))).alias("p"))
    openings = openings.where(F.size(F.array_except("p", F.array(*map(F.lit, FUNCTION_WORDS)))) > 0)
    counted = openings.select(entity, F.array_join("p", " ").alias("phrase")).groupBy("phrase").agg(F.count_distinct(entity).alias("df"))
    seeds = texts.sparkSession.createDataFrame([(x,) for x in SEEDS], "phrase string")
    kept = counted.join(F.broadcast(seeds.withColumn("seed", F.lit(True))), "phrase", "left").where(F.col("seed") | (F.col("df") >= least)).select("phrase", "df")
    kept = kept.unionByName(seeds.join(counted, "phrase", "left_anti").withColumn("df", F.lit(0).cast("bigint")))
    return kept.select("phrase", F.size(F.split("phrase", " ")).alias("n"), "df")


def strip_openings(texts: DataFrame, keys: list[str], text: str, phrases: DataFrame, rounds: int = 3, longest: int = 12) -> DataFrame:
    """``keys, text``: texts without their opening phrases, white space inside sentences as it was.

    Per sentence up to ``rounds`` times the longest known opening is taken away, unless a
    conjunction or comma follows; then an inverted subject that begins the rest ("können
    sie") goes, too. A sentence that is a phrase as a whole goes. Sentences are exploded and
    joined with the phrases by their openings - one equi-join a round, the dictionary is
    not collected.
    """
    token = r"[\p{L}\p{N}_*–-]+|[,;:]"
    known = cut_lineage(phrases.select("phrase").distinct())
    rest = texts.select(*keys, F.posexplode(sentences(F.regexp_replace(text, "[\r\n]+", " "))).alias("nr", "s")).withColumn("done", F.lit(False))

    def without(n: int) -> Column:
        return F.regexp_replace("s", rf"^(?:.*?(?:{token})){{{n}}}[ ,;:]*", "")

    inverted = F.regexp_replace("s", r"(?i)^[\p{L}\p{N}_]+\s+(?:" + "|".join(r"\s".join(x) for x in SUBJECTS) + r")(?![\p{L}\p{N}_])[\s,]*", "")
    for i in range(rounds):
        t = rest.where("not done").select(*keys, "nr", tokens(F.col("s")).alias("t"))
        # in the first round a sentence may be a phrase as a whole
        upto = F.least(F.size("t") if i == 0 else F.size("t") - 1, F.lit(longest))
        openings = t.where(upto >= 1).select(*keys, "nr", "t", F.explode(F.sequence(F.lit(1), upto)).alias("n"))
        following = F.coalesce(F.try_element_at("t", F.col("n") + 1), F.lit(""))
        openings = openings.select(*keys, "nr", "n", F.array_join(F.slice("t", 1, F.col("n")), " ").alias("phrase"), following.alias("following"), (F.size("t") == F.col("n")).alias("whole"))
        openings = openings.where((F.col("n") > 1) | F.col("whole"))
        hits = openings.join(known, "phrase").where(~F.col("following").isin(GOES_ON)).groupBy(*keys, "nr").agg(F.max("n").alias("cut"), F.max("whole").alias("whole"))
        rest = rest.join(hits, [*keys, "nr"], "left").where("whole is null or not whole")
        cut = F.col("s")
        for n in range(longest, 0, -1):
            cut = F.when(F.col("cut") == n, without(n)).otherwise(cut)
        rest = rest.withColumn("s", cut).withColumn("s", F.when(F.col("cut").isNotNull(), inverted).otherwise(F.col("s")))
        rest = cut_lineage(rest.withColumn("done", F.col("cut").isNull()).drop("cut", "whole"))
    kept = rest.select(*keys, "nr", F.trim("s").alias("s")).where("length(s) > 2")
    first_up = F.concat(F.upper(F.substring("s", 1, 1)), F.expr("substring(s, 2)"))
    return kept.select(*keys, "nr", first_up.alias("s")).groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nr", "s"))), lambda x: x["s"]), " ").alias(text))


def removed_openings(phrases: DataFrame, learned: str = "gelernt", least: int = 8) -> DataFrame:
    """The audit of phrases: ``phrase, df, quelle``, the most frequent first; seeds too rare to be learned are told apart."""
    return phrases.select("phrase", "df", F.when(F.col("df") >= least, learned).otherwise("vorgegeben").alias("quelle")).orderBy(F.desc("df"), "phrase")


def audit(counters: dict[str, DataFrame]) -> DataFrame:
    """``zaehler, anzahl``: how many rows each of several audits has; rows are aggregated, so that a task
    that runs twice counts once."""
    parts = [df.agg(F.count(F.lit(1)).alias("anzahl")).select(F.lit(name).alias("zaehler"), "anzahl") for name, df in counters.items()]
    return reduce(DataFrame.unionByName, parts)

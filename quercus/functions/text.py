"""Text functions as column expressions: everything here stays in the JVM unless it says so."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
CONJUNCTIONS = ["und", "oder", "sowie", "bzw", "als", "wie", "and", "or", "noch", "bis", "statt", "samt", "inklusive", "beziehungsweise", "respektive", "aber", "also", "etc", "usw", "u"]
ABBREVIATIONS = ["bzw.", "z.b.", "u.a.", "d.h.", "ca.", "vgl.", "evtl.", "ggf.", "inkl.", "insb.", "etc.", "nr.", "abs.", "art.", "sog.", "bspw.", "usw."]
TITLE_STOPS = ["der", "die", "das", "den", "dem", "des", "ein", "eine", "einer", "eines", "und", "oder", "in", "im", "an", "am", "auf", "aus", "bei", "mit", "nach", "von", "vom", "zu", "zum", "zur", "the", "a", "an", "of", "and", "for", "to", "on", "with"]
PLAIN = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


ARTEFACTS = [
    r"LEHR- UND LERNEINHEITEN PRÄSENZZEIT SELBSTSTUDIUM\s+[^\n]+?\s+\d+\s+\d+\s*", r"(?m)^\s*-?\s*(?:LERNEINHEITEN UND INHALTE|LEHR- UND LERNEINHEITEN)\s*", r"(?m)^Stand vom \d{2}\.\d{2}\.\d{4}\s*$",
    r"W3M\d{5} // Seite \d+", r"\[/?list\]",
]
#: Marks that stand behind the letter they belong to.
MARKS = "[\u0300-\u036f]"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition; the one cleaning step without a built-in function."""
    return text.map(lambda s: unicodedata.normalize("NFC", s) if s is not None else None)


def compose(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a column composed (NFC). Only rows that have marks of their own leave the JVM."""
    marked = F.coalesce(F.col(column).rlike(MARKS), F.lit(False))
    return df.where(~marked).unionByName(df.where(marked).withColumn(column, nfc(column)))


def clean_text(text: Column) -> Column:
    """Bullets unified, exotic blanks plain, soft hyphens and hooks gone, lines collapsed and
    trimmed, page artefacts, bare bullets and empty lines dropped. Null stays null. See ``compose``
    for composition, which comes before."""
    x = text
    for vowel, umlaut in zip("aouAOU", "äöüÄÖÜ"):  # a dieresis that was left beside its vowel
        x = F.replace(x, F.lit(vowel + "¨"), F.lit(umlaut))
    x = F.regexp_replace(x, r"[­​﻿]", "")
    x = F.regexp_replace(x, r"¬\s*", "")
    x = F.regexp_replace(x, "\r\n?", "\n")
    x = F.regexp_replace(x, r"[  -   　\t]", " ")
    x = F.regexp_replace(x, r"\[\*\]", "\n• ")
    for artefact in ARTEFACTS:
        x = F.regexp_replace(x, artefact, "\n")
    lines = F.transform(F.split(x, "\n"), lambda s: F.trim(F.regexp_replace(s, " +", " ")))
    lines = F.transform(lines, lambda s: F.regexp_replace(s, r"^(?:[-–•▪*?] ?)(?=\S)", "- "))
    return F.array_join(F.filter(lines, lambda s: ~s.rlike(r"^[-–•▪*?]?$")), "\n")


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column, least: int = 2) -> Column:
    """Lower-case words of letters, digits, & and -."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}\p{{N}}_&-]{{{least},}}"), F.lit(0))


def ascii_fold(text: Column) -> Column:
    """Lower case, ß as ss, the accented Latin letters of Western Europe plain."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), *PLAIN)


def norm_token(text: Column) -> Column:
    return F.regexp_replace(ascii_fold(text), "[^a-z0-9]", "")


def reference_key(surname: Column, title: Column, words_kept: int = 3) -> Column:
    """Folded surname (its last word after a particle) and the first telling words of the
    main title, joined by ``_``; ``ohneautor`` without surname; empty without both."""
    main = F.element_at(F.split(title, r": | – |\. |\? "), 1)
    telling = F.slice(F.filter(F.transform(F.split(main, r"\s+"), norm_token), lambda w: (w != "") & ~w.isin(TITLE_STOPS)), 1, words_kept)
    name = norm_token(F.regexp_extract(F.coalesce(surname, F.lit("")), r"(\S+)\s*$", 1))
    rest = F.array_join(telling, "_")
    author = F.when(name == "", "ohneautor").otherwise(name)
    return F.when((name == "") & (rest == ""), "").when(rest == "", author).otherwise(F.concat(author, F.lit("_"), rest))


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! ? before a capital; a cut after an abbreviation or a number is undone."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-ZÄÖÜ„\"(])")
    held = lambda s: F.lower(F.regexp_extract(s, r"(\S+)$", 1))
    joins = lambda s: held(s).isin(ABBREVIATIONS) | s.rlike(r"(?:^|\s)\d+\.$")
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when((F.size(acc) > 0) & joins(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), F.lit(" "), s)))).otherwise(F.concat(acc, F.array(s))),
    )


def comma_list(text: Column) -> Column:
    """Parts of a comma list; a part that starts in lower case or with a hyphen belongs to the one before."""
    return F.aggregate(
        F.split(text, r",\s+"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((F.size(acc) > 0) & s.rlike(r"^(?:[a-zäöüß-]|z\. ?B\.)"), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), F.lit(", "), s)))).otherwise(F.concat(acc, F.array(s))),
    )


def is_heading(line: Column, following: Column) -> Column:
    """Whether a line heads what follows: capitals, a colon at its end, or short before a list or longer line."""
    n = F.size(F.split(F.trim(line), r"\s+"))
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    capitals = (F.length(line) <= 80) & (F.upper(line) == line) & (letters >= 3)
    colon = line.endswith(":") & (n <= 10)
    listed = following.rlike(r"^(?:[-–•▪*]|\d+[.)])") & (n <= 15)
    short = (n <= 5) & ~line.contains(",") & (F.length(following) > F.length(line))
    return F.coalesce(capitals, F.lit(False)) | colon | (~line.rlike("[.,;]$") & F.coalesce(listed | short, F.lit(False)))


def semesters(year: Column) -> Column:
    """``23/24`` as its winter and summer terms."""
    return F.array(F.concat(F.lit("WiSe"), year), F.concat(F.lit("SoSe"), F.element_at(F.split(year, "/"), 2)))


def cell_kind(cell: Column, cancelled: str = "X") -> Column:
    """A workbook cell: ``cancelled``, ``held`` (a number), ``other`` (text), or null when blank."""
    x = F.trim(cell)
    return F.when(F.upper(x) == cancelled, "cancelled").when(x == "", None).when(x.try_cast("double").isNotNull(), "held").when(x.isNotNull(), "other")


def cell_number(cell: Column) -> Column:
    """The whole number of a cell, decimals cut; a decimal comma counts as a point."""
    return F.replace(F.trim(cell), F.lit(","), F.lit(".")).try_cast("double").cast("bigint")


def point_text(head: Column, item: Column) -> Column:
    return F.when(F.trim(F.coalesce(head, F.lit(""))) != "", F.concat(head, F.lit(": "), item)).otherwise(item)


def match_text(score: Column, a: Column, b: Column) -> Column:
    return F.format_string("[%.2f] %s ⟷ %s", score, a, b)


def parse_matches(text: Column) -> Column:
    """``array<struct<s,a,b>>`` of matches written by ``match_text`` and joined by `` || ``; negative scores don't parse."""
    pattern = r"^\[(\d\.\d+)\] (.*) ⟷ (.*)$"
    part = F.filter(F.split(text, r" \|\| "), lambda m: m.rlike(pattern))
    return F.transform(part, lambda m: F.struct(F.regexp_extract(m, pattern, 1).cast("double").alias("s"), F.regexp_extract(m, pattern, 2).alias("a"), F.regexp_extract(m, pattern, 3).alias("b")))


def text_hash(model: str, *texts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u001f", F.lit(model), *texts), 256), 1, 16)


def level(percentile: Column, levels: tuple[tuple[float, str], ...], rest: str = "gering") -> Column:
    """Band of a percentile; null stays null."""
    out = F.when(percentile.isNull(), None)
    for least, name in levels:
        out = out.when(percentile >= least, name)
    return out.otherwise(rest)


def z_word(z: Column) -> Column:
    return F.when(z.isNull(), "–").when(z >= 2, "sehr hoch").when(z >= 1, "hoch").when(z >= 0, "mittel").otherwise("gering")


def top_share(percentile: Column) -> Column:
    """``obere x %``: never under 0.1, one decimal below 1."""
    rest = F.greatest(F.lit(100.0) - percentile, F.lit(0.1))
    return F.when(percentile.isNull(), None).when(rest < 1, F.format_string("obere %.1f %%", rest)).otherwise(F.format_string("obere %d %%", F.round(rest).cast("int")))


def clip(text: Column, most: int = 200) -> Column:
    """A text cut at a word boundary, with an ellipsis."""
    cut = F.regexp_extract(F.substring(text, 1, most), r"^(.*)\s\S*$", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(cut == "", F.substring(text, 1, most)).otherwise(cut), F.lit(" …")))


def subsequence_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the usual table as the bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """200 * LCS / (len a + len b): similarity by insertions and losses only, in Arrow batches."""
    return pd.Series([None if x is None or y is None else 200.0 * subsequence_length(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a, b)], dtype="float64")

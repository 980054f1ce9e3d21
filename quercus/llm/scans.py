"""Noise in text from scanned pages: page lines, broken words, misread characters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quercus.session import cut_lineage, spread

# Fixed values. What a scanner reads for a glyph: right form, and forms read instead.
CONFUSIONS = {
    "e": ["c"], "t": ["f"], "f": ["t"], "u": ["n"], "n": ["u"], "i": ["l", "1"], "l": ["1"], "I": ["l", "1"], "g": ["9"], "o": ["0"], "O": ["0"],
    "h": ["li"], "m": ["rn"], "ü": ["ii"], "nn": ["im"], "rn": ["m"], "B": ["8"], "S": ["5"], "s": ["5"], "d": ["cl"], "w": ["vv"], "Z": ["2"],
}
#: Words before which a hyphen at the end of a word is one of ellipsis ("Kosten- und Nutzen").
CONJUNCTIONS = ["und", "oder", "bzw", "sowie", "als", "wie", "bis", "noch", "statt", "and", "or", "u", "o", "aber", "beziehungsweise", "samt", "mit"]
#: A hyphen at the end of a line or stretch: typed, soft, or read as a hook.
HYPHEN = "[-\u00ad\u00ac\u2010]"
#: A mask without words: numbers and single letters, bars (whose skeleton is i) and dashes.
NUMBERED = r"^[-–—|/i ]*#(?:[-–—|/.i ]+#)?[-–—|/i ]*$"
#: How many times as frequent as a known word another must be for the known one to be maybe a misread form of it.
RATIO = 20
#: Hash values by which words are told apart before a shuffle.
BUCKETS = 1 << 18
#: Stands where a word was mended, between its halves or behind its umlaut, until the words are told apart.
JOINT = "\ue002"
#: A word: runs of letters and digits joined by single signs.
WORD = r"[\p{L}\p{N}]+(?:[-&/'’][\p{L}\p{N}]+)*"


def skeleton(word: Column) -> Column:
    """Glyphs as strokes: forms that a scanner confuses have one skeleton.

    n, u, h and ü are two minims, m is three, i, l, r and 1 are one; e and c, t and f,
    g and 9, o and 0, b and 8, s and 5 are one sign each.
    """
    x = F.lower(word)
    for glyph, strokes in (("n", "ii"), ("u", "ii"), ("h", "ii"), ("ü", "ii"), ("m", "iii"), ("d", "ci"), ("w", "vv")):
        x = F.replace(x, F.lit(glyph), F.lit(strokes))
    return F.translate(x, "l1rj|!cf90856äöß2q", "iiiiiietgobsbaoszg")


def composed(text: Column) -> Column:
    """Umlauts and accents that stand as a letter and a mark of their own, as one letter."""
    x = text
    for mark, plain, whole in (("\u0308", "aouAOU", "äöüÄÖÜ"), ("\u0301", "eE", "éÉ"), ("\u0300", "aeAE", "àèÀÈ")):
        for a, b in zip(plain, whole):
            x = F.replace(x, F.lit(a + mark), F.lit(b))
    return F.when(text.rlike("[\u0300\u0301\u0308]"), x).otherwise(text)


def line_mask(line: Column) -> Column:
    """A line with its numbers masked and its words as skeletons: the same for every
    copy of a header, whatever page it stands on and however it was misread."""
    x = F.trim(F.regexp_replace(line, r"\s+", " "))
    x = F.when(x.rlike(r"^\W*(?:19|20)\d\d\W*$"), F.lit("#year")).otherwise(x)
    x = F.regexp_replace(x, r"\b[A-Z0-9]*\d[A-Z0-9]*\d[A-Z0-9]*\b", "#")
    x = F.regexp_replace(x, r"(?<![\p{L}\p{N}])[\p{L}\p{N}](?![\p{L}\p{N}])", "#")
    return skeleton(F.regexp_replace(x, r"\d+(?![\p{L}])(?<![\p{L}]\d)", "#"))


def _lines(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``k, feld, nr, zeile``: the lines of every cell, in order."""
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("feld"), F.col(f).alias("text")) for f in fields]))
    cells = df.select(F.col(key).alias("k"), named.alias("c")).select("k", "c.feld", "c.text").where("trim(text) <> ''")
    cells = spread(cells.withColumn("row", F.monotonically_increasing_id()))
    return cells.select("k", "feld", "row", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("nr", "zeile")).where("trim(zeile) <> ''")


def page_masks(lines: DataFrame) -> DataFrame:
    """``mask`` of the lines that belong to pages.

    Running text belongs to one field, a page line comes into all of them: a mask is one
    of page lines when at least three cells have it, the fields with a line like it being
    at least three, each with more than a fifth of any other's rate, so of one or two fields
    none with letters is found; a mask of numbers and signs only is one wherever it stands, save for a year.
    """
    by_field = lines.groupBy("mask", "feld").agg(F.count_distinct("row").alias("n"))
    size = lines.groupBy("feld").agg(F.count_distinct("row").alias("cells"))
    rate = by_field.join(F.broadcast(size), "feld").withColumn("rate", F.col("n") / F.col("cells"))
    masks = rate.groupBy("mask").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("fields"), (F.min("rate") / F.max("rate")).alias("even"))
    letters = F.length(F.regexp_replace("mask", r"[^\p{L}]", ""))
    return masks.where(((letters >= 2) & (F.col("n") >= 3) & (F.col("fields") >= 3) & (F.col("even") > 0.2)) | F.col("mask").rlike(NUMBERED)).select("mask")


def _convertible(right: str, seen: str) -> int:
    """The least number of confusions that turn ``right`` into ``seen``; -1 if none do.

    A confusion changes its first and its last sign, so what both have in common at the
    start and at the end is no part of one; the rest, mostly a few signs, is looked at.
    """
    i, ends = 0, min(len(right), len(seen))
    while i < ends and right[i] == seen[i]:
        i += 1
    right, seen, k = right[i:], seen[i:], 0
    while k < min(len(right), len(seen)) and right[-1 - k] == seen[-1 - k]:
        k += 1
    right, seen = right[: len(right) - k], seen[: len(seen) - k]
    best = {(0, 0): 0}
    for i in range(len(right) + 1):
        for j in range(len(seen) + 1):
            cost = best.get((i, j))
            if cost is None:
                continue
            if i < len(right) and j < len(seen) and right[i] == seen[j]:
                best[i + 1, j + 1] = min(cost, best.get((i + 1, j + 1), cost))
            for n in (1, 2):
                for form in CONFUSIONS.get(right[i : i + n], ()) if i + n <= len(right) else ():
                    if seen.startswith(form, j):
                        to = (i + n, j + len(form))
                        best[to] = min(cost + 1, best.get(to, cost + 1))
    return best.get((len(right), len(seen)), -1)


@F.pandas_udf(T.IntegerType())
def confusions(right: pd.Series, seen: pd.Series) -> pd.Series:
    return pd.Series([_convertible(r, s) for r, s in zip(right, seen)], dtype="int32")


def word_array(text: Column, token: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(token), F.lit(0))


def vocabulary(texts: DataFrame, column: str) -> DataFrame:
    """``wort, n``: the words of trusted texts and how often they occur."""
    return texts.select(F.explode_outer(word_array(F.col(column))).alias("wort")).where("wort is not null").groupBy("wort").agg(F.count(F.lit(1)).alias("n"))


def _beside(words: Column) -> Column:
    """The words of an array, each as (raw, l, r) with its neighbours; the last entry has no word."""
    none = F.array(F.lit(""))
    behind = F.concat(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), none)
    return F.arrays_zip(words.alias("raw"), F.concat(none, words).alias("l"), behind.alias("r"))


def _only(arrays: DataFrame, words: str, wanted: DataFrame) -> DataFrame:
    """Every word of the array column ``words`` that is one of ``wanted`` (w), as ``w, l, r`` with its neighbours.

    Rows of other words end where they are read: a broadcast table of at most BUCKETS hash
    values tells most of them, whatever the data. Neighbours are looked up for what is left.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    some = wanted.select(bucket("w").alias("bucket")).distinct()
    others = [c for c in arrays.columns if c != words]
    # the outer form, or the array would be made twice: once more to see whether it is empty
    rows = arrays.select(*others, words, F.posexplode_outer(words).alias("i", "w")).where("w is not null").withColumn("bucket", bucket("w")).join(F.broadcast(some), "bucket", "left_semi")
    beside = lambda i: F.coalesce(F.get(words, i), F.lit(""))
    near = rows.select(*others, "w", F.when(F.col("i") > 0, beside(F.col("i") - 1)).otherwise("").alias("l"), beside(F.col("i") + 1).alias("r"))
    return near.join(wanted.select("w").distinct(), "w", "left_semi")


def _in_context(cases: DataFrame, options: DataFrame, trusted: DataFrame, column: str) -> DataFrame:
    """``wort, l, r, right``: the right form of each misread word between its neighbours.

    ``cases`` (wort, l, r) are the words with what stands beside them, ``options`` (wort,
    right, own, c, n, known) the forms each may be. Support of a form is how often trusted
    texts have it beside neighbours of these skeletons, as neighbours may be misread, too. A
    form that has support goes before those without; then fewer confusions, more support,
    more occurrences, the smaller form. A word that is itself known is given up only for a
    form that has support where it has none.
    """
    forms = options.select(F.col("right").alias("w")).unionByName(options.where("known").select(F.col("wort").alias("w")))
    beside = _only(trusted.select(word_array(F.col(column)).alias("ws")), "ws", forms)
    beside = cut_lineage(beside.select(F.col("w").alias("right"), "l", "r"))

    def support_of(side: str) -> DataFrame:
        # counted as they stand before their skeletons are made
        counts = beside.where(f"{side} <> ''").groupBy("right", side).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("right", skeleton(F.col(side)).alias(f"s{side}")).agg(F.sum("n").alias(f"n{side}"))

    left, right = support_of("l"), support_of("r")
    own = options.where("known").select("wort", F.col("wort").alias("right"), F.lit(0).alias("own"), F.lit(0).alias("c"), F.lit(0).cast("long").alias("n")).distinct()
    tried = cases.withColumn("sl", skeleton(F.col("l"))).withColumn("sr", skeleton(F.col("r"))).join(options.select("wort", "right", "own", "c", "n").unionByName(own), "wort")
    tried = tried.join(left, ["right", "sl"], "left").join(right, ["right", "sr"], "left")
    support = F.coalesce("nl", F.lit(0)) + F.coalesce("nr", F.lit(0))
    order = F.struct((support == 0).alias("alone"), "own", "c", (-support).alias("s"), (-F.col("n")).alias("n"), "right")
    best = tried.groupBy("wort", "l", "r").agg(F.min(order).alias("b"), F.max(F.when(F.col("c") == 0, support)).alias("self"))
    fine = F.col("self").isNull() | ((F.col("self") == 0) & ~F.col("b.alone"))
    return best.where(fine & (F.col("b.right") != F.col("wort"))).select("wort", "l", "r", F.col("b.right").alias("right"))


def repair(df: DataFrame, key: str, fields: list[str], trusted: DataFrame, trusted_text: str) -> tuple[DataFrame, DataFrame]:
    """Findings in scanned cells, and the repaired cells.

    Findings are ``key, feld, art, wert``, once per cell: art ``zeile`` a line that
    belongs to the page, as it stands, trimmed; art ``wort`` the right spelling of a word
    that was broken in two or misread. Repaired cells are ``key, feld, text``: page lines
    gone, words joined and corrected, each cell one continuous paragraph.

    1. Lines are masked (numbers, and words by their skeletons) and counted by field;
       see ``page_masks``.
    2. The other lines are reflowed by a window over the cell: a word with a hyphen at the
       end of a line, or before a blank, is joined with the next word if that starts in
       lower case and is no conjunction.
       Dots beside their vowel are put on it.
    3. Forms of one skeleton that confusions turn into each other are candidates: for a
       word that trusted texts never have, all of theirs - failing that, one that the scans
       themselves have more often (names that only scanned records have); for a word they
       have, those at least RATIO times as frequent. Between its neighbours the word becomes
       the form that trusted texts have there, see ``_in_context``.

    Scale: lines, words and vocabulary are relations joined by mask and skeleton, the words
    beside a form by form and skeleton; nothing is collected. Windows go over single cells.

    Defined cases: null, empty and blank cells give no rows; unknown words without a
    trusted counterpart stay as they are; a hyphen before an upper-case letter or a
    number stays; repeated rows of ``df`` give their findings once; an empty ``trusted``
    leaves only page lines and broken words; empty tables give no rows; other columns are
    ignored.
    """
    lines = cut_lineage(_lines(df, key, fields).withColumn("mask", line_mask(F.col("zeile"))))
    masks = page_masks(lines)
    page = lines.join(masks, "mask", "left_semi")
    text = lines.join(masks, "mask", "left_anti")
    whole = Window.partitionBy("row").orderBy("nr")
    joined = F.concat_ws("\n", F.collect_list("zeile").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    flowed = text.withColumn("t", joined).withColumn("first", F.row_number().over(whole)).where("first = 1").select("k", "feld", "row", composed(F.col("t")).alias("t"))
    stop = "|".join(CONJUNCTIONS)
    break_ = rf"(?<=\p{{L}}){HYPHEN}\s+(?!(?:{stop})\b)(?=\p{{Ll}})"
    flowed = flowed.withColumn("t", F.regexp_replace("t", break_, JOINT))
    # dots that were read as a sign of their own beside the vowel they belong to
    for vowel, umlaut in zip("aouAOU", "äöüÄÖÜ"):
        flowed = flowed.withColumn("t", F.replace("t", F.lit(vowel + "\u00a8"), F.lit(umlaut + JOINT)))
    flowed = cut_lineage(flowed)
    # JOINT marks a mended word; neighbours are those of the mended text
    token = WORD.replace(r"\p{N}", rf"\p{{N}}{JOINT}")
    tokens = flowed.select("k", "feld", "row", word_array(F.col("t"), token).alias("ws"))
    plain = lambda c: F.translate(c, JOINT, "")
    single = tokens.select(F.explode("ws").alias("wort")).select(plain("wort").alias("wort"))
    # words that were mended, with their neighbours
    broken = tokens.where(F.array_join("ws", " ").contains(JOINT)).select("k", "feld", "row", F.explode(_beside(F.col("ws"))).alias("x")).where(F.col("x.raw").contains(JOINT))
    broken = broken.select("k", "feld", "row", *[plain(f"x.{a}").alias(b) for a, b in (("raw", "wort"), ("l", "l"), ("r", "r"))])
    trusted = trusted.select(composed(F.col(trusted_text)).alias("t"))
    known = cut_lineage(vocabulary(trusted, "t").withColumn("s", skeleton(F.col("wort"))))
    forms = single.where(r"length(wort) >= 3 and wort rlike '\\p{L}'").groupBy("wort").agg(F.count(F.lit(1)).alias("times"))
    forms = cut_lineage(forms.join(known.select("wort", F.col("n").alias("has")), "wort", "left").withColumn("s", skeleton(F.col("wort"))))
    right = known.select("s", F.col("wort").alias("right"), "n", F.lit(0).alias("own"))
    right = right.unionByName(forms.where("has is null and times >= 2").select("s", F.col("wort").alias("right"), F.col("times").alias("n"), F.lit(1).alias("own")))
    pairs = forms.join(right, "s").where("right <> wort").where(f"(has is null and (own = 0 or n > times)) or (own = 0 and n >= {RATIO} * has)")
    pairs = spread(pairs.select("wort", "right", "own", "n", F.col("has").isNotNull().alias("known"))).withColumn("c", confusions("right", "wort")).where("c > 0")
    options = cut_lineage(pairs)
    unmarked = flowed.select("k", "feld", "row", word_array(plain("t")).alias("ws"))
    doubtful = cut_lineage(_only(unmarked, "ws", options.select(F.col("wort").alias("w"))).withColumnRenamed("w", "wort").distinct())
    # a word that can be but one form needs no context
    ways = options.groupBy("wort").agg(F.count(F.lit(1)).alias("ways"), F.min("right").alias("right"), F.max("known").alias("known"))
    settled = ways.where("ways = 1 and not known").select("wort", "right")
    rivals = options.join(settled, "wort", "left_anti")
    fixes = _in_context(doubtful.select("wort", "l", "r").distinct(), rivals, trusted, "t")
    fixed = doubtful.join(fixes, ["wort", "l", "r"]).unionByName(doubtful.join(settled, "wort"))
    fixed = cut_lineage(fixed.select("k", "feld", "row", "wort", "l", "r", "right"))
    broken = broken.join(fixed.select("row", "wort", "l", "r", "right"), ["row", "wort", "l", "r"], "left").select("k", "feld", F.coalesce("right", "wort").alias("wert"))
    found = fixed.select("k", "feld", F.col("right").alias("wert")).unionByName(broken).select("k", "feld", F.lit("wort").alias("art"), "wert")
    found = found.unionByName(page.select("k", "feld", F.lit("zeile").alias("art"), F.trim(F.regexp_replace("zeile", r"^\s+|\s+$", "")).alias("wert"))).distinct()
    by_cell = fixed.groupBy("row").agg(F.collect_set(F.struct("wort", "l", "r", "right")).alias("fix"))
    texts = flowed.select("k", "feld", "row", F.regexp_replace(F.translate("t", JOINT, ""), r"\s+", " ").alias("t"))
    # the words of a text that has fixes, and what to put in their places
    texts = texts.join(by_cell, "row", "left").withColumn("ws", F.when(F.col("fix").isNotNull(), F.filter(_beside(word_array(F.col("t"))), lambda x: x["raw"].isNotNull())))
    chosen = F.transform("ws", lambda x: F.coalesce(F.get(F.filter("fix", lambda f: (f["wort"] == x["raw"]) & (f["l"] == x["l"]) & (f["r"] == x["r"])), F.lit(0))["right"], x["raw"]))
    gaps = F.split("t", WORD, -1)
    rebuilt = F.array_join(F.zip_with(gaps, chosen, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")
    return found.withColumnRenamed("k", key), texts.select("k", "feld", F.when(F.col("fix").isNull(), F.col("t")).otherwise(rebuilt).alias("text")).withColumnRenamed("k", key)

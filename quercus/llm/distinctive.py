"""How distinctive a term is of a record: log-entropy weighting by two SQL aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A term in more than total/HOT records is hot; there are at most HOT * (terms per record) of
#: them by pigeonhole on counted rows, see ``_with_spread``.
HOT = 2048


def letter_terms(text, least: int = 4):
    """Array of the longest runs of letters of at least ``least`` letters, lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"\p{{L}}{{{least},}}"), F.lit(0)), F.lower)


def log_entropy(terms: DataFrame, record: str, term: str, group: str | None = None) -> DataFrame:
    """Weight of every term in every record against all records.

    ``terms`` has one row per occurrence. First aggregation: local frequency ``tf`` by
    (record, term). Second: by term the global frequency ``gf``, the number of records
    ``df``, of distinct groups ``gruppen`` and the entropy of the spread
    ``H = ln gf - sum(s ln s) / gf`` with s the term's frequency in a group, which needs no
    join. The weight is ``log2(1 + tf) * (1 - H / ln n)`` with n the number of groups that
    have a term: 1 - 0 for a term of a single group, nought for one spread evenly over all.
    A term of at most m groups has H <= ln m, so it weighs at least ``least_weight(tf, m, n)``.

    Returns ``record, term, [group,] tf, gf, df, gruppen, n, gewicht``. ``group`` must be
    a function of the record; without it every record is a group.

    Scale: both aggregations combine map-side. The statistics return to the rows by an
    equi-join; those of terms that make up more than 1/HOT of all (record, term) rows - at
    most HOT of them whatever the corpus - go by broadcast and their rows are not shuffled,
    so no task gets a hot term.

    Defined cases: rows with a null record or term are no occurrences; a null group is
    a group for the entropy, but not counted in gruppen; with a single group n is taken as 2,
    so that the weight is defined; an empty table gives no rows; other columns are ignored.
    """
    grouped = [F.col(group).alias("_g")] if group else []
    local = (
        terms.select(F.col(record).alias("_r"), F.col(term).alias("_t"), *grouped)
        .where("_r is not null and _t is not null")
        .groupBy("_r", "_t")
        .agg(F.count(F.lit(1)).alias("tf"), *([F.min("_g").alias("_g")] if group else []))
    )
    by_group = local.groupBy("_t", "_g").agg(F.sum("tf").alias("s"), F.count(F.lit(1)).alias("c")) if group else local.select("_t", F.col("_r").alias("_g"), F.col("tf").alias("s"), F.lit(1).alias("c"))
    s = F.col("s").cast("double")
    counts = by_group.groupBy("_t").agg(F.sum("s").alias("gf"), F.sum(s * F.log(s)).alias("p"), F.sum("c").alias("df"), F.count("_g").alias("gruppen"))
    unit = F.coalesce(F.xxhash64("_g"), F.lit(0)) if group else F.xxhash64("_r")
    totals = local.agg(F.greatest(F.count_distinct(unit), F.lit(2)).alias("n"), F.count(F.lit(1)).alias("cells"))
    gf = F.col("gf").cast("double")
    spread = counts.crossJoin(F.broadcast(totals)).select(
        "_t", "gf", "df", "gruppen", "n",
        (F.lit(1.0) - (F.log(gf) - F.col("p") / gf) / F.log(F.col("n").cast("double"))).alias("g"),
        (F.col("df") * HOT > F.col("cells")).alias("hot"),
    )
    return _with_spread(local, spread).select(
        F.col("_r").alias(record), F.col("_t").alias(term), *([F.col("_g").alias(group)] if group else []),
        "tf", "gf", "df", "gruppen", "n", (F.log2(F.lit(1.0) + F.col("tf")) * F.col("g")).alias("gewicht"),
    )


def least_weight(tf: Column, groups: int, n: Column) -> Column:
    """What a term with local frequency ``tf`` weighs at least if it stands in no more than ``groups``
    of ``n`` groups: its entropy is greatest when it is spread evenly over them. A hair less, as
    sums of doubles differ in their last digits."""
    return F.log2(F.lit(1.0) + tf) * (F.lit(1.0) - F.log(F.lit(float(groups))) / F.log(n.cast("double"))) - F.lit(1e-9)


def _with_spread(local: DataFrame, spread: DataFrame) -> DataFrame:
    """The statistics at every (record, term) row. Terms with more than 1/HOT of the rows are at most
    HOT: their statistics are broadcast and their rows stay where they are."""
    hot = spread.where("hot").drop("hot")
    marked = local.join(F.broadcast(hot), "_t", "left")
    cold = marked.where("gf is null").select(*local.columns).join(spread.where("not hot").drop("hot"), "_t")
    return marked.where("gf is not null").unionByName(cold.select(*marked.columns))

"""Body regions in texts, by a dictionary (ord, term, regions) that callers give; ord is its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .dictionary import found_terms

#: Characters about a term's first place that tell the side: in a text, then before and after the term.
CONTEXT, BEFORE, AFTER = 100, 30, 10


def _has(text: Column, words: list[str], whole: bool) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | (text.rlike(rf"(?<![a-z]){w}(?![a-z])") if whole else F.contains(text, F.lit(w)))
    return out


def sided(regions: Column, context: Column, term: Column, word_boundaries: bool = False) -> Column:
    """A pair of a left and a right region narrowed to the side that the context names near the term; others as they are."""
    low = F.lower(context)
    at = F.instr(low, term)
    start = F.greatest(at - BEFORE, F.lit(1))
    near = F.when(at == 0, low).otherwise(F.substring(low, start, at - start + F.char_length(term) + AFTER))
    left, right, both = (_has(near, w, word_boundaries) for w in (fixed.LEFT, fixed.RIGHT, fixed.BOTH))
    pair = (F.size(regions) == 2) & F.coalesce(F.contains(F.get(regions, F.lit(0)), F.lit("_left")), F.lit(False))
    side = lambda s: F.filter(regions, lambda r: F.contains(r, F.lit(s)))
    return F.when(~pair | both | (left & right), regions).when(left, side("_left")).when(right, side("_right")).otherwise(regions)


#: Rows to broadcast at most.
BROADCAST_ROWS = 10_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def term_regions(terms: DataFrame, dictionary: DataFrame, term: str = "term", context: str = "context", word_boundaries: bool = False) -> DataFrame:
    """terms with regions: of the equal key, else of the first key that contains the term or is in it; empty without any.

    Keys are looked for in the different terms, and these in the keys, each by automata over blocks.
    """
    rows = terms.withColumn("__low", F.lower(F.trim(term)))
    own = rows.select("__low").where("__low is not null").distinct()
    keys = dictionary.select("ord", "term")
    within = found_terms(own, keys, "__low", "__low", "ord", "term").select("__low", "ord")
    about = found_terms(keys, own, "ord", "term", "__low", "__low").select("__low", "ord")
    hits = within.union(about).join(_few(dictionary.select("ord", F.col("term").alias("__term"), F.col("regions").alias("__regions"))), "ord")
    first = F.struct((F.col("__term") != F.col("__low")).alias("other"), F.col("ord"))
    best = hits.groupBy("__low").agg(F.min_by(F.struct("__term", "__regions"), first).alias("__b"))
    rows = rows.join(_few(best), "__low", "left")
    regions = sided(F.col("__b.__regions"), F.coalesce(context, F.lit("")), F.col("__b.__term"), word_boundaries)
    return rows.withColumn("regions", F.coalesce(regions, F.array().cast("array<string>"))).drop("__low", "__b")


def text_regions(texts: DataFrame, dictionary: DataFrame, text: str = "text", key: str = "doc_id", word_boundaries: bool = False) -> DataFrame:
    """(key, region): the regions of all terms that each text contains, by side as near their first place."""
    low = texts.select(key, F.lower(text).alias("__low"))
    rows = found_terms(low, dictionary, key, "__low", "ord", "term", CONTEXT).withColumnRenamed("near", "__near")
    rows = rows.join(_few(dictionary.select("ord", "term", "regions")), "ord")
    return rows.select(key, F.explode(sided(F.col("regions"), F.col("__near"), F.col("term"), word_boundaries)).alias("region")).distinct()


def region_labels(rows: DataFrame, terms: DataFrame, region: str = "region") -> DataFrame:
    """rows with label: the region's label, or its id where it has none."""
    labels = terms.select(F.col("region_id").alias(region), "label").distinct()
    return rows.join(_few(labels), region, "left").withColumn("label", F.coalesce("label", region))


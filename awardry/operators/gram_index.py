"""An index of three-character sequences, by which Boolean search looks at few texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boolean_query import condition, evaluated, parsed

#: Texts of a block of postings, about; a sequence that all texts hold is a row for each block.
BLOCK = 2048
#: Of a term's sequences the rarest are asked for, so many.
RAREST = 3
SIZE = 3
#: Ids to broadcast at most.
BROADCAST_ROWS = 200_000


def grams(text: Column) -> Column:
    """The different sequences of SIZE characters of a text, found in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * SIZE + "))"), F.lit(1)))


def write_gram_index(texts: DataFrame, path: str, key: str = "id", text: str = "text", block: int = BLOCK) -> None:
    """Postings (gram, block, n, ids) of lower-case texts, each block's in the order of grams; ids are whole numbers.

    Texts are dealt out by their block once; a block's postings are made where its texts are, so no row is shuffled
    for a text's sequence.
    """
    rows = texts.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    blocks = max(1, -(-rows.count() // block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).repartition(blocks, "block")
    rows = rows.select("id", "block", F.explode(grams(F.col("text"))).alias("gram"))
    postings = rows.groupBy("gram", "block").agg(F.count("*").alias("n"), F.collect_list("id").alias("ids"))
    postings.sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(path)


def read_gram_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _terms(tree: tuple) -> set[str]:
    return {tree[1]} if tree[0] == "term" else set().union(*map(_terms, tree[1:])) if len(tree) > 1 else set()


def candidates(index: DataFrame, query: str, brackets: bool = True) -> DataFrame | None:
    """The ids (id) of texts that may satisfy a query, a superset of those that do; None if every text may.

    A term's texts are the intersection of its sequences' postings, and AND and OR those of their parts. A term of fewer
    characters and a negated one leave every text in.
    """
    tree = parsed(query, brackets)
    of = {t: {t[i : i + SIZE] for i in range(len(t) - SIZE + 1)} for t in _terms(tree)}
    if evaluated(tree, lambda t: not of[t], lambda x: True, True):  # what a text without any of the sequences would be
        return None
    wanted = sorted(set().union(*of.values()))
    sizes = dict(index.where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("n")).collect())  # a row for each of the query's sequences
    asked = {t: sorted(g, key=lambda x: (sizes.get(x, 0), x))[:RAREST] for t, g in of.items()}
    used = sorted(set().union(*map(set, asked.values())))
    held = index.where(F.col("gram").isin(used)).select("gram", F.explode("ids").alias("id")).groupBy("id").agg(F.collect_set("gram").alias("grams"))
    has = lambda t: F.size(F.array_except(F.array(*[F.lit(g) for g in asked[t]]), "grams")) == 0 if asked[t] else F.lit(True)
    return held.where(evaluated(tree, has, lambda x: F.lit(True), F.lit(True))).select("id")


def indexed_boolean_search(cases: DataFrame, index: DataFrame, query: str, text: Column, key: str = "id", brackets: bool = True) -> DataFrame:
    """The cases that satisfy a query, as boolean_search without filters; only those that the index leaves are looked at."""
    if not query or not query.strip():
        return cases.limit(0)
    left = candidates(index, query, brackets)
    if left is not None:
        ids = left.withColumnRenamed("id", "__id")
        ids = F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids
        cases = cases.join(ids, cases[key] == ids["__id"], "left_semi")
    return cases.where(condition(query, text, brackets))

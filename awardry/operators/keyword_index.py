"""An inverted index with block maxima, for exact keyword search that leaves out blocks of documents.

Documents are dealt into blocks of about BLOCK: by the scale of their lengths, as the length decides what a token's
occurrences are worth, and inside a scale by hash. A posting row has a token's documents of one block, so a token that is in
all documents is many rows and no task holds more than some blocks of it. Each row has the greatest score that the
token gives any document of its block; the sum over a query's tokens bounds every document of the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..working import stored

#: Documents of a block, about.
BLOCK = 4096
#: Steps of the scale of lengths for a doubling.
STEPS = 4
#: Blocks that are looked into first, for each query; n results of them tell which others can be left out.
FIRST = 4
#: Rows to broadcast at most.
BROADCAST_ROWS = 100_000
#: Bounds are sums in another order than scores: they are taken so much greater.
SLACK = 1 + 1e-9
POSTINGS = "array<struct<id:long,tf:long,len:long>>"


def occurrence_score(tf: Column, length: Column, mean_length: float) -> Column:
    """What a token that occurs tf times adds, once for each time that the query has it."""
    return tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))


def write_index(documents: DataFrame, path: str, mean_length: float = 100.0, block: int = BLOCK) -> None:
    """Postings of documents (id, tokens) as a table (token, block, best, postings), in the order of tokens and blocks."""
    docs = documents.select("id", F.size("tokens").cast("long").alias("len"), "tokens").where("len > 0")
    docs = stored(docs, "tokens")  # texts are parted once, for the blocks' sizes and for the postings
    scale = F.floor(F.log2("len") * STEPS).cast("int")
    sizes = docs.groupBy(scale.alias("scale")).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))  # a row for each scale: some hundred
    docs = docs.withColumn("scale", scale).join(F.broadcast(sizes), "scale")
    docs = docs.withColumn("block", F.shiftleft(F.col("scale").cast("long"), 40) + F.pmod(F.xxhash64("id"), "parts"))
    counts = docs.select("id", "len", "block", F.explode("tokens").alias("token")).groupBy("token", "block", "id", "len").agg(F.count("*").alias("tf"))
    # counts are sent as rows, not as lists that nearly all have one document
    rows = counts.repartition("token", "block").groupBy("token", "block").agg(
        F.max(occurrence_score(F.col("tf"), F.col("len"), mean_length)).alias("best"), F.collect_list(F.struct("id", "tf", "len")).alias("postings"),
    )
    rows = rows.select("token", "block", "best", F.col("postings").cast(POSTINGS).alias("postings"), F.lit(mean_length).alias("mean_length"))
    rows.repartitionByRange("token", "block").sortWithinPartitions("token", "block").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token, weight): the share of the score of each different token."""
    q = queries.select("query_id", F.size(F.array_distinct("tokens")).alias("distinct"), F.explode("tokens").alias("token"))
    return q.groupBy("query_id", "token").agg((F.count("*") / F.first("distinct")).alias("weight"))


def block_bounds(index: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, block, bound, docs): for each block with a query's token no document's score is greater than bound."""
    held = index.select("token", "block", "best").join(_few(tokens), "token")
    bound = F.least(F.sum(F.col("best") * F.col("weight")) / 10.0, F.lit(1.0)) * SLACK
    return held.groupBy("query_id", "block").agg(bound.alias("bound"))


def block_scores(index: DataFrame, tokens: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, id, keyword): the scores of all documents of the blocks (query_id, block) that have a token."""
    wanted = tokens.join(blocks.select("query_id", "block"), "query_id")
    rows = index.join(_few(wanted), ["token", "block"])
    rows = rows.select("query_id", "block", "weight", "mean_length", F.explode("postings").alias("p"))
    part = occurrence_score(F.col("p.tf"), F.col("p.len"), F.col("mean_length")) * F.col("weight")
    return rows.groupBy("query_id", F.col("p.id").alias("id")).agg(F.least(F.sum(part) / 10.0, F.lit(1.0)).alias("keyword"))


def _best(scores: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("keyword"), F.asc("id"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def indexed_top(index: DataFrame, queries: DataFrame, n: int, first: int = FIRST, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """(results, blocks) for queries (query_id, tokens): of each query the n best (query_id, id, keyword, rank), equal scores by id.

    The same as scoring every document, rounded to digits. The blocks with the greatest bounds are scored first; their n-th
    score is the least that another block must be able to reach, so that the rest are never read. blocks tells of each
    (query_id, block, bound) in which round it was scored, 0 for never.
    """
    tokens = stored(query_tokens(queries), "query_tokens")
    bounds = stored(block_bounds(index, tokens), "block_bounds")
    w = Window.partitionBy("query_id").orderBy(F.desc("bound"), F.asc("block"))
    bounds = stored(bounds.withColumn("place", F.row_number().over(w)), "block_order")
    rounded = lambda scores: scores.withColumn("keyword", F.round("keyword", digits))
    one = stored(_best(rounded(block_scores(index, tokens, bounds.where(F.col("place") <= first))), n), "first_scores")
    least = one.where(F.col("rank") == n).select("query_id", F.col("keyword").alias("least"))
    told = bounds.join(F.broadcast(least), "query_id", "left")  # a row for each query
    # a bound may be rounded up to the least score
    reach = F.col("least").isNull() | (F.col("bound") + 10.0**-digits >= F.col("least"))
    blocks = stored(told.select("query_id", "block", "bound", F.when(F.col("place") <= first, 1).when(reach, 2).otherwise(0).alias("round")), "block_rounds")
    two = rounded(block_scores(index, tokens, blocks.where("round = 2")))
    return _best(one.drop("rank").unionByName(two), n), blocks

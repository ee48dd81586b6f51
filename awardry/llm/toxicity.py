"""Operator 6: toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and of beginnings of words is trained in numpy from confirmed toxic documents and
unlabelled ones. With the class prior p, the risk is p * E_P[l(+1)] + max(0, E_U[l(-1)] - p * E_P[l(-1)]),
l being the logistic loss: the unlabelled mean, corrected by the prior, stands for the negatives, and
may not fall below zero (where it would, a step goes the other way, out of overfitting). Words are
chosen by how much likelier they are in positive than in unlabelled training documents. Training uses
bounded samples, of max_positive and max_unlabelled documents, the least by a hash of their ids. The
unlabelled ones only tell how common a word is among all texts and hold the weights of a thousand words
down; 20,000 documents place a share of 1 % within 0.07 % (a standard deviation). Counts of words are
made on the executors, and only chosen words go to the driver. Scores use the whole text of every document.

Edge cases: a null or empty text has no words and scores by the bias alone. Rows with a null id are
scored, and aren't trained on. Labels that are null aren't confirmations. Without a positive training
document all scores are the prior. Repeated rows are each scored. An empty table gives an empty
result. Other columns pass through; columns with the names of the results are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import stored

#: Bounds of the training samples, and words in the model at most.
MAX_POSITIVE, MAX_UNLABELLED, MAX_WORDS = 4000, 20_000, 1024
#: A word must be in so many positive training documents, and its lift so many standard deviations above what is asked for.
LEAST_DOCS, SURE = 5, 2.0
#: The class prior's bounds, where it is estimated.
PRIOR_BOUNDS = (0.01, 0.5)
STEPS, RATE, DECAY = 1200, 0.05, 1e-5

#: Lengths of the beginnings of words that are features beside the words: an inflected language has many forms of one.
PREFIXES = (4, 5, 6, 7)

_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> set[str]:
    """The different words (runs of letters, lower case) of a whole text, and their beginnings: with a hyphen, and with two where two words share it."""
    words = set(_WORD.findall(text.lower())) if text else set()
    found = Counter(w[:k] + "-" for w in words if len(w) > PREFIXES[0] for k in PREFIXES if len(w) > k)
    return words.union(found, [p + "-" for p, n in found.items() if n > 1])


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], words: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the classifier; documents are given by the indices of their words."""
    sizes = [len(d) for d in positive + unlabelled]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    cols = np.concatenate([*positive, *unlabelled, np.zeros(0, np.int64)]).astype(np.int64)
    n_p, n_u = len(positive), len(unlabelled)
    weights, bias = np.zeros(words), math.log(prior / (1 - prior))
    m, v = np.zeros(words + 1), np.zeros(words + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, weights[cols], n_p + n_u) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_minus = np.logaddexp(0, z)  # of calling a document clean
        negative = loss_minus[n_p:].mean() - prior * loss_minus[:n_p].mean()
        pull = np.zeros(n_p + n_u)  # derivative of the risk by z
        if negative >= 0:
            pull[:n_p] = prior * ((p[:n_p] - 1) - p[:n_p]) / n_p
            pull[n_p:] = p[n_p:] / n_u
        else:
            pull[:n_p] = prior * p[:n_p] / n_p
            pull[n_p:] = -p[n_p:] / n_u
        grad = np.append(np.bincount(cols, pull[rows], words) + DECAY * weights, pull.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = np.maximum(weights - move[:-1], 0), bias - move[-1]  # chosen words speak for toxicity only
    return weights, float(bias)


def held_out(key: str) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_table(sample: DataFrame) -> DataFrame:
    """(id, positive, words): the different words of each sampled document (id, positive, text)."""

    def run(batches):
        for batch in batches:
            words = [list(tokens(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], ["id", "positive", "words"])

    return sample.mapInArrow(run, "id long, positive boolean, words array<string>")


def fit(
    docs: DataFrame, labels: DataFrame, prior: float | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic",
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_words: int = MAX_WORDS, sure: float = SURE,
) -> dict[str, float]:
    """word -> weight, "" -> bias, from the rows that aren't held out.

    max_positive and max_unlabelled bound the samples, max_words the model; sure is how many standard deviations a word's lift must lie above what is asked for. Without a prior, the share of confirmed toxic documents among the training rows of labels is taken.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).cast("long").alias("id")).agg(F.max((F.col(label) == 1)).alias("positive"))
    if prior is None:
        prior = known.agg(F.avg(F.col("positive").cast("double"))).first()[0] or PRIOR_BOUNDS[0]
    prior = min(max(prior, PRIOR_BOUNDS[0]), PRIOR_BOUNDS[1])
    texts = docs.where(F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    order = F.xxhash64(F.col("id"), F.lit(6))
    chosen = known.where("positive").orderBy(order, "id").limit(max_positive).select("id", F.lit(True).alias("positive"))
    free = texts.select("id").distinct().orderBy(order, "id").limit(max_unlabelled).select("id", F.lit(False).alias("positive"))
    ids = stored(chosen.union(free), "toxicity_sample")  # at most max_positive + max_unlabelled rows
    sample = texts.join(F.broadcast(ids), "id").groupBy("id", "positive").agg(F.min("text").alias("text"))  # repeated rows of an id are one
    table = stored(word_table(sample), "toxicity_words")
    totals = {r[0]: r[1] for r in table.groupBy("positive").count().collect()}
    n_p, n_u = totals.get(True, 0), totals.get(False, 0)
    if not n_p or not n_u:
        return {"": math.log(prior / (1 - prior))}
    counts = table.select("positive", F.explode("words").alias("word")).groupBy("word").agg(
        F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")
    )
    lift = F.log((F.col("p") + 0.5) / n_p) - F.log((F.col("u") + 0.5) / n_u)
    # a word of toxic texts alone is 1 / prior times likelier in them; half of that on the log scale must be sure
    least = lift - sure * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("u") + 0.5))
    marked = (F.col("p") >= LEAST_DOCS) & (least >= 0.5 * math.log(1 / prior))
    kept = counts.where(marked).orderBy((lift * F.sqrt("p")).desc(), "word").limit(max_words)
    index = {r[0]: i for i, r in enumerate(kept.select("word").collect())}
    vocabulary = F.array(*[F.lit(w) for w in index]) if index else F.array().cast("array<string>")
    rows = table.select("id", "positive", F.array_intersect("words", vocabulary).alias("words")).orderBy("positive", "id").toPandas()
    documents = [np.array([index[w] for w in words], np.int64) for words in rows["words"]]
    sides = [[d for d, p in zip(documents, rows["positive"]) if bool(p) is want] for want in (True, False)]
    weights, bias = train(*sides, len(index), prior)
    return {"": bias} | dict(zip(index, weights.tolist()))


def scored(docs: DataFrame, model: dict[str, float], text: str = "text", out: str = "score") -> DataFrame:
    """docs with out: the probability of being toxic, from 0 to 1."""
    docs = docs.drop(out)
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_WORDS words
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = dict(held.value)
        bias = weights.pop("")
        known = weights.keys()
        for batch in batches:
            z = np.array([bias + sum(weights[w] for w in sorted(tokens(t.as_py()) & known)) for t in batch.column(at)], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*batch.schema.names, out])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(out, DoubleType()))


def op6_toxicity(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    found = scored(docs, fit(docs, labels))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

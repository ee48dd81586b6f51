"""Operator 11: document fingerprints by order MinHash.

A text's k-mers of code points are numbered by occurrence, so that each (k-mer, number) is there once. For each of SKETCHES
permutations the TUPLE least of them are taken, put back in their text order, and the tuple of their k-mers is
hashed. Two texts' tuples are equal if both the k-mers and their order agree, so the share of equal hashes falls with the
edit distance; MinHash alone doesn't see the order. A fingerprint is SKETCHES hashes of 8 hexadecimal digits.

A text is read in pieces of PIECE k-mers, and each piece's least merge, so that memory beyond the text's own
arrays doesn't grow.

Edge cases: a null or empty text has the fingerprint of zeros, which is like itself alone. A text of fewer code points than
a k-mer's is one k-mer; of fewer k-mers than a tuple's, all are taken. Null ids come last in the order of ids and repeated
rows are each returned. Rows that share an id follow one another by the hash of their text, then the text. An empty table
gives an empty result; a single row is its own next one. op11's table has the columns that it names only; fingerprints()
passes other columns through and replaces one of the result's name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import filled, slices
from .shingles import FACTOR, mixed

#: Code points of a k-mer, k-mers of a tuple, permutations.
KMER, TUPLE, SKETCHES = 5, 2, 64
PIECE = 2048

_random = np.random.default_rng(11)
_FACTORS = (_random.integers(0, 2**31, SKETCHES, np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)[:, None]
_SHIFTS = _random.integers(0, 2**32, SKETCHES, np.uint64).astype(np.uint32)[:, None]


def kmers(text: str) -> np.ndarray:
    """uint64 hashes of a text's k-mers in order."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    k = min(KMER, len(c))
    size = len(c) - k + 1
    acc = c[:size].copy()
    for i in range(1, k):
        acc *= FACTOR
        acc += c[i : i + size]
    return mixed(acc)


def occurrences(values: np.ndarray) -> np.ndarray:
    """How often each value has stood before its place."""
    n = len(values)
    bits = np.uint64(max(1, n.bit_length()))
    places = np.arange(n, dtype=np.uint64)
    ordered = np.sort((values >> bits << bits) | places)  # by value, then place: faster than an indirect sort
    group, at = ordered >> bits, (ordered & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    out = np.empty(n, np.int64)
    out[at] = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
    return out


def sketch(text: str | None) -> np.ndarray:
    """The SKETCHES hashes (uint32) of a text; zeros for an empty one."""
    if not text:
        return np.zeros(SKETCHES, np.uint32)
    values = kmers(text)
    numbered = mixed(values + occurrences(values).astype(np.uint64) * FACTOR)
    x = (numbered >> np.uint64(32)).astype(np.uint32)
    rows, most = np.arange(SKETCHES), np.uint32(2**32 - 1)
    least, where = [], []
    buffer = np.empty((SKETCHES, min(PIECE, len(x))), np.uint32)
    for i in range(0, len(x), PIECE):
        piece = x[i : i + PIECE]
        y = np.multiply(_FACTORS, piece, out=buffer[:, : len(piece)])
        y += _SHIFTS
        for _ in range(min(TUPLE, len(piece))):
            at = y.argmin(1)
            least.append(y[rows, at])
            where.append(at + i)
            y[rows, at] = most
    where = np.stack(where, 1)
    if where.shape[1] > TUPLE:
        order = np.argsort(np.stack(least, 1), axis=1, kind="stable")[:, :TUPLE]
        where = where[rows[:, None], order]
    where.sort(axis=1)
    acc = np.full(SKETCHES, where.shape[1], np.uint64)
    for i in range(where.shape[1]):
        acc = mixed(acc * FACTOR + values[where[:, i]])
    return (acc >> np.uint64(32)).astype(np.uint32)


def fingerprint(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal hashes; an empty text is like an empty one alone."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column fingerprint, without a shuffle."""
    docs = docs.drop("fingerprint")
    schema = StructType([*docs.schema.fields, StructField("fingerprint", StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [fingerprint(sketch(t.as_py())) for t in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], [*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(run, schema)


def ring(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, guest, again, id, hash, text): rows sorted inside parts, so that the next row of a part is the next document by descending id.

    Parts are ranges of ids, bounded by quantiles, some for each shuffle partition; an id that fills several ranges is dealt on
    by the hash of its text. Behind a part's rows comes a guest, the first row of the part after it (after the last: of the
    first), whose next row isn't there. Equal rows come once, with their number in again. Of the rows the driver sees
    only the id and the hash of each part's first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), filled(docs, text).alias("text"))
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.withColumn("again", F.lit(1).cast("long"))
    else:
        rows = rows.groupBy("id", "text").agg(F.count("*").alias("again"))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    cut, fills = np.unique(np.array(cuts, np.int64), return_counts=True)

    @F.pandas_udf("long")
    def part_of(null: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        null, ids = null.to_numpy(), ids.to_numpy()
        if not len(cut):
            return pd.Series(null.astype(np.int64))
        at = np.searchsorted(cut, ids)
        near = np.minimum(at, len(cut) - 1)
        full = (cut[near] == ids) & (fills[near] > 1)
        share = (hashes.to_numpy().astype(np.float64) / 2.0**64 + 0.5) * fills[near]
        piece = np.where(full, np.minimum(share.astype(np.int64), fills[near] - 1), 0)
        place = 2 * (len(cut) - at) + ~full  # by descending id; an id that fills ranges comes before those below it
        return pd.Series(np.where(null, 2 * len(cut) + 2, place) * (int(fills.max()) + 1) + piece)

    rows = rows.withColumn("hash", F.xxhash64("text"))
    rows = rows.withColumn("part", part_of(F.col("id").isNull(), F.coalesce("id", F.lit(0)), F.col("hash")))
    order = [F.bitwise_not("id").alias("order"), F.col("hash")]
    firsts = rows.groupBy("part").agg(F.min(F.struct(*order)).alias("r")).select("part", F.bitwise_not("r.order").alias("id"), "r.hash").sort("part").collect()
    guests = [(f.id, f.hash, firsts[i - 1].part) for i, f in enumerate(firsts)]
    guests = spark.createDataFrame(guests, "g_id long, g_hash long, g_part long")
    rows = rows.join(F.broadcast(guests), rows["id"].eqNullSafe(guests["g_id"]) & (rows["hash"] == guests["g_hash"]), "left")
    place = lambda part, guest: F.struct(part.alias("part"), F.lit(guest).alias("guest"))
    places = F.when(F.col("g_part").isNull(), F.array(place(F.col("part"), False))).otherwise(F.array(place(F.col("part"), False), place(F.col("g_part"), True)))
    rows = rows.select(F.explode(places).alias("p"), "again", "id", "hash", "text").select("p.*", "again", "id", "hash", "text")
    return rows.repartition("part").sortWithinPartitions("part", "guest", *order, "text")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following one's beginning as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each row beside its edited text and the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: part, guest, again, id, text, sketch
        for batch in slices(batches):
            out: list[tuple] = []
            for part, guest, again, i, t in zip(*[batch.column(c).to_pylist() for c in ("part", "guest", "again", "id", "text")]):
                now = part, guest, again, i, t, sketch(t)
                if held and not held[1] and held[0] == part:
                    _, _, times, own_id, own, own_sketch = held
                    # copies follow one another; the last of them has the next text behind it
                    for n, other, other_sketch in ((times - 1, own, own_sketch), (1, t, now[-1])):
                        if n:
                            e = edited(own, other)
                            es = sketch(e)
                            row = own_id, len(own), hashlib.sha256(e.encode()).hexdigest(), fingerprint(own_sketch), fingerprint(es), likeness(own_sketch, es), likeness(own_sketch, other_sketch), n
                            out.append(row)
                held = now
            columns = list(zip(*out)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "again"]
    found = ring(docs, key, text).mapInArrow(
        run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, again long"
    )
    return found.select(*names[:-1], F.explode(F.array_repeat(F.lit(0), F.col("again").cast("int")))).drop("col")


def op11_order_minhash(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_next(docs).withColumnRenamed("id", "doc_id")

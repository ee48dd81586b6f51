"""Which terms of a dictionary stand in which texts, by Aho-Corasick automata over bounded blocks of the dictionary."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the terms that one automaton holds: it takes some hundred bytes for each.
BLOCK_CHARS = 2_000_000

_built: dict[str, object] = {}


def automaton(name: str, of: dict[str, list[int]]):
    """The automaton of a block {term: its places among the block's ids}, made once in each worker; the last one is kept."""
    if name not in _built:
        import ahocorasick

        _built.clear()
        made = ahocorasick.Automaton()
        for term, places in of.items():
            if term:
                made.add_word(term, (len(term), places))
        made.make_automaton()
        _built[name] = made
    return _built[name]


def found_terms(
    texts: DataFrame, terms: DataFrame, key: str, text: str, term_id: str, term: str, context: int = 0, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(key, term_id, at, near), ids being whole numbers or strings: each term that a text contains, with its first place, from 1, and what stands so many characters about it.

    One pass over a text finds all terms of a block, however many they are. A dictionary beyond ``block_chars`` characters is
    cut into blocks by hash; a block is all that the driver and a task hold of it, and each is one pass over the texts.
    An empty term is in every text, at 1; null terms and texts are in none.
    """
    spark = texts.sparkSession
    own_type = dict(terms.dtypes)[term_id]
    id_type = "string" if own_type == "string" else "long"
    terms = terms.select(F.col(term_id).cast(id_type).alias("id"), F.col(term).alias("term")).where("term is not null")
    size = terms.agg(F.sum(F.char_length("term") + 1)).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    texts = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    key_type = dict(texts.dtypes)["k"]
    out = None
    for b in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b) if blocks > 1 else terms
        ids, of = [], {}
        for r in own.collect():  # one bounded block
            of.setdefault(r.term, []).append(len(ids))
            ids.append(r.id)
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, of, pa.array(ids)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            name, of, ids = held.value
            find = automaton(name, of)
            for batch in batches:
                rows, places, at, near = [], [], [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    first = dict.fromkeys(of.get("", ()), (0, 0))
                    if len(find):
                        for last, (n, users) in find.iter(t):
                            for u in users:
                                first.setdefault(u, (last + 1 - n, n))
                    rows.extend([i] * len(first))
                    places.extend(first)
                    for start, n in first.values():
                        at.append(start + 1)
                        near.append(t[max(0, start - context) : start + n + context])
                if rows:
                    columns = [batch.column(0).take(pa.array(rows)), ids.take(pa.array(places)), pa.array(at, pa.int32()), pa.array(near, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["k", "id", "at", "near"])

        part = texts.mapInArrow(run, f"k {key_type}, id {id_type}, at int, near string") if ids else None
        out = part if out is None else out.union(part) if part is not None else out
    if out is None:
        out = spark.createDataFrame([], f"k {key_type}, id {id_type}, at int, near string")
    return out.select(F.col("k").alias(key), F.col("id").cast(own_type).alias(term_id), "at", "near")

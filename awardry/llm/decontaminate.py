"""Operator 10: benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items are partitioned by the size of their shingle set (powers of two). An item's MinHash
sketch is the k least hashes of its set, k being the partition's; the share of the sketch that a
document holds estimates how much of the item the document contains, however long the document is.
A document is held against the partitions whose items it is large enough to contain; items which
reach the partition's least share (missed with a probability of 1e-9 at the threshold; exact where
the sketch is the whole set) are verified by exact containment of their full shingle sets.
Documents aren't shuffled: the items go to them in blocks of a bounded number of shingles, one pass
for each block: benchmarks of hundreds of millions of words take some tens of passes.

Edge cases: a null or empty text has no shingles: such an item is in no document, such a document
holds no item. An item of fewer words than a shingle is one shingle of that many words and is found
wherever these words stand in a row. Items with a null id and documents with a null id are left out
of the pairs. Repeated items or documents give a pair each. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .shingles import shingle_hashes, words_of

#: Least hashes in a sketch; sets of up to so many shingles are held whole.
SKETCH = 32
#: Shingles of items that are broadcast at once.
BLOCK_SHINGLES = 4_000_000
#: Low bits of a hash that are looked up first.
MASK = np.uint64((1 << 20) - 1)
#: Chance that a partition's estimate misses an item at the threshold.
MISS = 1e-9


def least_hits(size: int, percent: int) -> int:
    """How many hashes of an item's sketch a document must hold to be verified."""
    if size <= SKETCH:
        return -(-size * percent // 100)
    p, tail, hits = percent / 100, 0.0, 0
    while True:
        tail += math.comb(SKETCH, hits) * p**hits * (1 - p) ** (SKETCH - hits)
        if tail > MISS:
            return max(1, hits)
        hits += 1


class Items:
    """A block of items as arrays: full sets, and the sketches by partition."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]], percent: int):
        self.percent, self.ids, self.sets = percent, [r[0] for r in rows], [r[2] for r in rows]
        #: words in a shingle (fewer for short items) and size partition -> sketch hashes, their items, ...
        self.parts = {}
        groups: dict[tuple[int, int], list[int]] = {}
        for i, (_, words, hashes) in enumerate(rows):
            groups.setdefault((words, int(len(hashes)).bit_length()), []).append(i)
        for key, members in groups.items():
            hashes = np.concatenate([self.sets[i][:SKETCH] for i in members])
            owner = np.concatenate([np.full(min(SKETCH, len(self.sets[i])), i) for i in members])
            order = np.argsort(hashes, kind="stable")
            filled = np.zeros(int(MASK) + 1, bool)
            filled[hashes & MASK] = True
            self.parts[key] = (hashes[order], owner[order], min(len(self.sets[i]) for i in members), filled)
        self.need = np.array([least_hits(len(s), percent) for s in self.sets])

    def inside(self, words: list[bytes], n: int) -> Iterator[tuple[int, int, int]]:
        """(item id, size of its set, shingles shared) for the items that a text contains."""
        sets: dict[int, np.ndarray] = {}
        for (k, _), (hashes, owner, smallest, filled) in self.parts.items():
            if len(words) - k + 1 < 1 or (len(words) - k + 1) * 100 < smallest * self.percent:
                continue
            if k not in sets:
                sets[k] = shingle_hashes(words, k)
            own = sets[k]
            own = own[filled[own & MASK]]  # few shingles of a document are in any sketch
            hit = np.unique(own[hashes[np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)] == own]) if len(own) else own
            if not len(hit):
                continue
            spans = [owner[slice(*np.searchsorted(hashes, [h, h + np.uint64(1)]))] for h in hit]
            found, counts = np.unique(np.concatenate(spans), return_counts=True)
            for i in found[counts >= self.need[found]]:
                shared = int(np.isin(self.sets[i], sets[k]).sum())
                if shared * 100 >= len(self.sets[i]) * self.percent:
                    yield self.ids[i], len(self.sets[i]), shared


def item_sets(items: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(id, words, shingles): the sorted set of each item that has one."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words_of(t.as_py())
                if w and i is not None:
                    rows.append((i, min(words, len(w)), np.unique(shingle_hashes(w, words)).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                ["id", "words", "shingles"],
            )

    return items.select(F.col(key).cast("long"), text).mapInArrow(run, "id long, words int, shingles binary")


def contained_items(
    docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", item_key: str = "item_id", text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): the items of whose shingles at least percent are in a document."""
    spark = docs.sparkSession
    sets = stored(item_sets(items, words, item_key, text), "benchmark_sets")
    total = sets.agg(F.sum(F.length("shingles") / 8)).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_SHINGLES))
    schema = "doc_id long, item_id long, n_item long, n_shared long"
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        rows = sets.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        held = spark.sparkContext.broadcast(Items([(r[0], r[1], np.frombuffer(r[2], np.uint64)) for r in rows], percent))

        def run(batches, held=held):
            for batch in batches:
                found = []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if i is not None:
                        found += [(i, *x) for x in held.value.inside(words_of(t.as_py()), words)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(4)], ["doc_id", "item_id", "n_item", "n_shared"])

        out = out.union(docs.select(F.col(key).cast("long"), text).mapInArrow(run, schema))
    return out


def op10_benchmark_decontamination(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


ORACLE = r"""
with t as (select 'd' as kind, doc_id as id, text from documents union all select 'i', item_id, text from benchmark),
w as (select kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from t),
s as (select distinct kind, id, array_to_string(ws[i:i + 4], ' ') as sh from (select kind, id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)),
n as (select id, count(*) as n from s where kind = 'i' group by id),
c as (select d.id as doc_id, i.id as item_id, count(*) as n_shared from s d join s i on d.kind = 'd' and i.kind = 'i' and d.sh = i.sh group by 1, 2)
select doc_id, item_id, n.n as n_item, n_shared from c join n on n.id = item_id where n_shared * 100 >= n.n * 80
"""

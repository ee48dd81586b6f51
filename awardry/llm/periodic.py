"""Operator 13: periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q and a length of at least max(least, 3 q) that can't be made longer. Cut
the words into aligned blocks of B = 2**k words. A run whose period is in [B, 2 B) has an aligned block that occurs again
q words on, that is in the neighbouring window of B starts; shorter periods than the least block show in the window right
behind its start. The occurrences of a block in its window come from range successors: the block's suffixes are a stretch
of the suffix array, and a wavelet matrix over the suffix array gives the smallest, second and last of those in the window.
One occurrence is one candidate period. Several form a progression, whose difference is the block's own period; the run's
period then moves the block's own periodic stretch onto the occurrences', so that these two stretches' left or right
ends lie q apart: they and the ends of the progression are the candidates. Each is extended as far as it holds, by ranks of
dyadic blocks, and stays if it is long enough; of one stretch the smallest period stays.

Many documents are handled at once, with words of different documents told apart; time is n log n, memory
that of some ten arrays a word, of SLICE words or one document.

Edge cases: a null or empty text, or one without words, has no runs and an empty collapsed text. Rows with a null id and
repeated rows are each returned. An empty table gives an empty result. Other columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled
from .wavelet import Blocks, WaveletMatrix

LEAST, TIMES = 24, 3
#: Words that are handled at once; one document may have more.
SLICE = 1 << 16
RUNS = "array<struct<start:long,length:long,period:long>>"


def candidates(blocks: Blocks, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods to try: (p, q), such that each run of length max(least, 3 q) holds some p and p + q at which it has period q."""
    n, first_k = len(blocks.suffixes), max(0, ((least + 1) // TIMES).bit_length() - 1)
    parts = []  # place, left, right, from, to: occurrences from .. to of the block at the place
    for k in range(first_k, len(blocks.ranks)):
        size = 1 << k
        p = np.arange(0, n - size + 1, size)
        left = blocks.ranks[k][p]
        many = blocks.sizes[k][left]
        p, left, right = p[many > 1], left[many > 1], (left + many)[many > 1]
        if k == first_k:
            parts.append((p, left, right, p + 1, p + size + 1))
        parts.append((p, left, right, p + size, p + 2 * size))
    if not parts or not sum(len(x[0]) for x in parts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, left, right, least_at, most_at = map(np.concatenate, zip(*parts))
    # only suffixes whose first block occurs twice are asked for
    starts = np.unique(blocks.ranks[first_k])
    asked = np.repeat(blocks.sizes[first_k][starts] > 1, np.diff(np.append(starts, n)))
    place = np.concatenate([[0], np.cumsum(asked)])
    left, right = place[left], place[right]
    tree = WaveletMatrix(blocks.suffixes[asked])
    before, upto = tree.below(left, right, least_at), tree.below(left, right, most_at)
    some = upto > before
    p, left, right, before, upto = p[some], left[some], right[some], before[some], upto[some]
    first = tree.smallest(left, right, before)
    more = np.flatnonzero(upto - before > 1)
    places, periods = [p], [first - p]
    if len(more):
        p, first, left, right = p[more], first[more], left[more], right[more]
        last = tree.smallest(left, right, upto[more] - 1)
        step = tree.smallest(left, right, before[more] + 1) - first
        places += [p, p, p]
        periods += [
            last - p,
            first - blocks.behind(first, first + step) - (p - blocks.behind(p, p + step)),
            first + blocks.ahead(first, first + step) - (p + blocks.ahead(p, p + step)),
        ]
    p, q = np.concatenate(places), np.concatenate(periods)
    good = (q > 0) & (p + q < n)
    return p[good], q[good]


def runs_of(symbols: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The runs of a sequence of numbers: rows (start, length, period) by start, then period."""
    none = np.zeros((0, 3), np.int64)
    if len(symbols) < max(least, TIMES):
        return none
    blocks = Blocks(symbols)
    p, q = candidates(blocks, least)
    if not len(p):
        return none
    back = blocks.behind(p, p + q)
    start, length = p - back, back + blocks.ahead(p, p + q) + q
    good = length >= np.maximum(least, TIMES * q)
    found = np.unique(np.stack([start[good], length[good], q[good]], 1), axis=0)
    if not len(found):
        return none
    least_period = np.ones(len(found), bool)
    least_period[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[least_period]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


class Numbers(dict):
    """A number for each word."""

    def __missing__(self, word):
        self[word] = out = len(self)
        return out


def runs_of_documents(documents: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """The runs of each document, given by its words."""
    number = Numbers()
    ends = np.cumsum([len(w) for w in documents])
    symbols = np.fromiter((number[w] for words in documents for w in words), np.int64, int(ends[-1]) if len(ends) else 0)
    of = np.repeat(np.arange(len(documents)), np.diff(ends, prepend=0))
    found = runs_of(of * (len(number) + 1) + symbols, least)  # words of two documents are never equal
    doc = of[found[:, 0]] if len(found) else np.zeros(0, np.int64)
    found[:, 0] -= (ends - np.diff(ends, prepend=0))[doc]
    return np.split(found, np.searchsorted(doc, np.arange(1, len(documents))))


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, without those that some run holds behind its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """op13's planted runs: a tenth of the documents repeat some of their words from some place on."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """(id, n_words, runs, collapsed): of each row the runs by start, then period, and the text without their repetitions.

    change(id, words), if it is given, alters the words first.
    """

    def table(ids: list, documents: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of_documents(documents, least)
        flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
        texts = [collapsed(w, r).decode() for w, r in zip(documents, found)]
        columns = [pa.array(ids, pa.int64()), pa.array([len(w) for w in documents], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, documents, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = t.as_py().encode().split()  # at the bytes 32 and 9 to 13
                words = change(i, words) if change else words
                if ids and size + len(words) > SLICE:
                    yield table(ids, documents)
                    ids, documents, size = [], [], 0
                ids.append(i)
                documents.append(words)
                size += len(words)
            if ids:
                yield table(ids, documents)

    rows = docs.select(F.col(key).cast("long").alias("id"), filled(docs, text).alias("text"))
    return rows.mapInArrow(run, f"id long, n_words long, runs {RUNS}, collapsed string")


def op13_periodic_runs(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs, change=planted)
    # runs come by start, then period: of equal exponents the first stays
    greater = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda a, x: F.when(greater(x, a), x).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE = rf"""
with recursive table_steps as (select z, 0 as k, z as x from range(256) r(z) union all select z, k + 1, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end from table_steps where k < 8),
crc as materialized (select list(x order by z) as t from table_steps where k = 8),
src as (select row_number() over () as rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents),
sums as (select rid, doc_id, ws, len(ws) as n, case when doc_id is null then 1 else xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) end as h from src, crc),
cuts as (select *, case when n > 0 and h % 10 = 0 then (h // 10) % n else n end as a from sums),
texts as (select rid, doc_id, n, case when a = n then ws else list_transform(range(n), lambda i: ws[(case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) end)::bigint + 1]) end as ws from cuts),
words as materialized (select rid, n, i, ws[i + 1] as w from (select rid, n, ws, unnest(range(n)) as i from texts)),
same as (select a.rid, b.i - a.i as q, a.i from words a join words b on a.rid = b.rid and a.w = b.w and b.i > a.i and 3 * (b.i - a.i) <= a.n),
stretches as (select rid, q, min(i) as s, count(*) + q as len from (select *, i - row_number() over (partition by rid, q order by i) as g from same) group by rid, q, g having count(*) + q >= greatest({LEAST}, 3 * q)),
runs as materialized (select rid, s, len, min(q) as q from stretches group by rid, s, len),
best as (select rid, s, len, q from (select *, row_number() over (partition by rid order by len::double / q desc, s, q) as k from runs) where k = 1),
listed as (select rid, count(*) as n, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as t from runs group by rid),
gone as (select distinct rid, unnest(range(s + q, s + len)) as i from runs),
collapsed as (select w.rid, string_agg(w.w, ' ' order by w.i) as t from words w left join gone g on g.rid = w.rid and g.i = w.i where g.i is null group by w.rid)
select x.doc_id, coalesce(l.n, 0)::bigint as n_runs, b.s::bigint as start, b.len::bigint as length, b.q::bigint as period, (b.len * 1000 // b.q)::bigint as exponent_milli,
    sha256(coalesce(l.t, '')) as runs_sha256, sha256(coalesce(c.t, '')) as collapsed_sha256
from texts x left join listed l using (rid) left join best b using (rid) left join collapsed c using (rid)
"""

"""Operator 12: grouping of spelling variants by finite-state composition.

The vocabulary's minimised acceptor is composed with a transducer of one edit (a code point inserted, deleted or
replaced) and the acceptor again; the pairs that the composition accepts are words and their near words. It is
enumerated by partitions of its initial states. A pair whose shorter word has m code points and whose first difference
is at place i lies in one zone [a, b) of places with a <= i < b; both words then have the same first a and the same
last m - b code points. So (m, a, b, first a, last m - b) is a key: a task has the words of a key, makes their acceptor,
starts behind the common beginning and lets edits happen in the zone only. Each pair is found at one key.

At first a word has two zones, the halves. Keys of more than GROUP words are dealt once more with their zone halved, until
they are small or the zone is one place; such a key has at most as many words as there are ways to put one or two code
points at that place. So no task holds an unbounded group, whatever the words. A task returns a row for each of a key's
words: its near words there as a count, and the best of them. Pairs are never rows.

A word's form is its near word of greatest count (ties: the least in code-point order), if that is FACTOR times the word's
or more. Forms are followed to their end by pointer doubling, as each step multiplies the count by FACTOR.

Edge cases: a null or empty text has no runs. A null id counts as an empty one in the sum that is tested for a planted
misspelling (op12 alone). Repeated rows count each. Runs of any length are words. An empty table gives an empty
result. Other columns are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .acceptor import Acceptor
from .common import stored
from .near_dup import grouped

#: Runs of letters; the class is fixed by the contract.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: Words of a key that one task takes at once.
GROUP = 5_000
#: Different words that a task counts before it hands them on.
COUNTED = 200_000
#: Tables of up to so many rows are broadcast: a few MB each on the driver, whatever the vocabulary.
BROADCAST_ROWS = 20_000
KEY = ["m", "a", "b", "head", "tail"]


def lowered(text: str) -> str:
    return text.translate(LOWER)


def misspelt(doc_id: int | None, word: str) -> str:
    """The word with one code point less if the checksum of id and word says so: op12's planted misspellings."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word if h % 199 else word[: (at := h % len(word))] + word[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", change: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """(word, n): lower-cased runs of letters of all whole texts, after change(id, run), with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = Counter(RUN.findall(lowered(t.as_py() or "")))
                if change:
                    for w, n in runs.items():
                        counts[change(i, w)] += n
                else:
                    counts.update(runs)
                if len(counts) > COUNTED:
                    yield table(counts)
                    counts.clear()
        yield table(counts)

    def table(counts: Counter) -> pa.RecordBatch:
        long = [(w, n) for w, n in counts.items() if len(w) >= LEAST_LENGTH]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in long], pa.string()), pa.array([n for _, n in long], pa.int64())], ["word", "n"])

    parts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def zoned(rows: DataFrame) -> DataFrame:
    """Rows with word, m, a and b get head and tail: hashes of the first a and of the last m - b code points."""
    length = F.char_length("word")
    last = F.greatest(F.col("m") - F.col("b"), F.lit(0))
    head, tail = F.col("word").substr(F.lit(1), F.col("a")), F.col("word").substr(length - last + 1, last)
    return rows.withColumns({"head": F.xxhash64(head), "tail": F.xxhash64(tail)})


def keyed(words: DataFrame) -> DataFrame:
    """(word, n, m, a, b, head, tail): each word as the shorter or the longer of a pair, in both halves."""
    length = F.char_length("word")
    middle = F.floor((F.col("m") + 1) / 2).cast("int")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m"))
    zones = F.array(F.struct(F.lit(0).alias("a"), middle.alias("b")), F.struct(middle.alias("a"), (F.col("m") + 1).alias("b")))
    return zoned(rows.select("word", "n", "m", F.explode(zones).alias("z")).select("word", "n", "m", "z.a", "z.b"))


def halved(rows: DataFrame) -> DataFrame:
    """The same words with their zones cut in two."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    zones = F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b"))
    return zoned(rows.select("word", "n", "m", F.explode(zones).alias("z")).select("word", "n", "m", "z.a", "z.b"))


def looked_up(rows: DataFrame, found: DataFrame, key: str | list[str], how: str = "left") -> DataFrame:
    """rows joined to a table that is unique in its key: broadcast by its number of rows, else sent and merged.

    Files are compressed, so their size, by which Spark would broadcast a table, doesn't tell what the driver must hold.
    """
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(found) if few else found.hint("merge"), key, how)


def partitions(words: DataFrame, most: int = GROUP) -> DataFrame:
    """The rows of keyed() that share their key with another; keys of more than most words are cut to narrower zones."""
    rows, out = keyed(words), None
    while True:
        sizes = stored(rows.groupBy(*KEY).agg(F.count("*").alias("size")).where("size > 1"), "spelling_sizes")
        rows = looked_up(rows, sizes, KEY, "inner")
        large = (F.col("size") > most) & (F.col("b") - F.col("a") > 1)
        done = rows.where(~large).drop("size")
        out = done if out is None else out.unionByName(done)
        if sizes.where(large).isEmpty():
            return out
        rows = stored(halved(rows.where(large).drop("size")), "spelling_zones")


def near_words(rows: DataFrame) -> DataFrame:
    """(word, n, n_near, best): for each word and key its near words by composition; best is (-n, word) of the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, KEY):
            words, counts = group.column("word").to_pylist(), group.column("n").to_pylist()
            m, a, b = (group.column(c)[0].as_py() for c in ("m", "a", "b"))
            n = dict(zip(words, counts))
            found: dict[str, int] = {}
            best: dict[str, tuple[int, str]] = {}
            for pair in Acceptor(sorted(n)).one_edit(a, b):
                if min(map(len, pair)) != m:  # a pair of two longer words is another key's
                    continue
                for u, v in (pair, pair[::-1]):
                    found[u] = found.get(u, 0) + 1
                    best[u] = min(best.get(u, (0, "")), (-n[v], v))
            if found:
                columns = [list(found), [n[w] for w in found], list(found.values()), [-best[w][0] for w in found], [best[w][1] for w in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["word", "n", "n_near", "best_n", "best_word"])

    dealt = rows.repartition(*KEY).sortWithinPartitions(*KEY)
    return dealt.mapInArrow(run, "word string, n long, n_near long, best_n long, best_word string")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) without cycles: each form followed to the last."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = looked_up(now, step, "root")
        ahead = stored(ahead.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling_roots")
        now = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, factor: int = FACTOR, most: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table (word, n) of different words."""
    words = stored(words.select("word", "n"), "spelling_words")
    pairs = near_words(partitions(words, most))
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best_word").alias("w")))
    near = stored(pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")), "spelling_near")
    out = looked_up(words, near, "word")
    good = -F.col("best.k") >= F.col("n") * factor
    out = out.select("word", F.when(good, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, -F.col("best.k")).alias("form_n"))
    out = stored(out, "spelling_forms")
    roots = rooted(out.where("form is not null").select("word", "form"))
    return looked_up(out, roots, "word").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(word_counts(docs, change=misspelt).where(F.col("n") >= LEAST_COUNT))


ORACLE = rf"""
with recursive runs as (select doc_id, w, count(*) as n from (select doc_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as w from documents) group by all),
table_steps as (select z, 0 as k, z as x from range(256) r(z) union all select z, k + 1, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end from table_steps where k < 8),
crc as materialized (select list(x order by z) as t from table_steps where k = 8),
bytes as (select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || w)) as hx from runs),
sums as (select doc_id, w, n, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(hx) + 1, 2), lambda i: ('0x' || substr(hx, i, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h from bytes, crc),
changed as (select case when h % 199 = 0 then substr(w, 1, (h % length(w))::bigint) || substr(w, (h % length(w))::bigint + 2) else w end as word, n from sums),
vocab as (select word, sum(n)::bigint as n from changed where length(word) >= {LEAST_LENGTH} group by word having sum(n) >= {LEAST_COUNT}),
less as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as s from (select word, n, unnest(range(length(word))) as i from vocab)),
pairs as (select a.word as u, b.word as v from less a join less b on a.i = b.i and a.s = b.s and a.word <> b.word
    union select a.word, b.word from less a join vocab b on a.s = b.word union select b.word, a.word from less a join vocab b on a.s = b.word),
near as (select u as word, count(*) as n_near, first(v order by b.n desc, v) as best from pairs join vocab b on b.word = v group by u),
forms as (select a.word, a.n, coalesce(n_near, 0)::bigint as n_near, case when b.n >= {FACTOR} * a.n then best end as form, case when b.n >= {FACTOR} * a.n then b.n end as form_n
    from vocab a left join near using (word) left join vocab b on b.word = best),
walk as (select word, word as root, form as ahead from forms union all select walk.word, walk.ahead, f.form from walk join forms f on f.word = walk.ahead)
select word, form, root, n, n_near, form_n from forms join (select word, root from walk where ahead is null) using (word)
"""

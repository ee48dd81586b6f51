"""Operator 3: near duplicates by SetSketch registers.

Each text's set of word shingles gets a SetSketch: register i is floor(1 - log_b(h_i)), h_i being
the least of exponentially distributed hashes of the shingles, truncated to 16 bits. Registers of a
union are the maxima of the registers, and two sets' registers are equal with a probability close to
their Jaccard similarity. BANDS bands of ROWS registers are hashed to buckets; a pair at 0.8 shares
no bucket with probability 1e-6. Pairs in a bucket are estimated jointly by maximum likelihood from
how many registers are greater, less and equal, and confirmed on their full shingle sets.

Equal sets are one class from the start. Classes in a bucket aren't paired with one another:

1. each class is held against one head, that of most of its buckets (star_links), and components are formed;
2. only buckets whose classes are of different components are left; inside tasks, block by block, the
   members outside a bucket's largest component are held against the rest, and those stay that some
   pair of registers doesn't rule out (undecided);
3. these come to their bucket once more, now with their shingle sets, and are confirmed inside the
   task, component against component; of the links found only those that join two components come
   out (block_links).

So no pair is ever a row, rows out are linear in a bucket's members, and no link between different
components is left out: a pair that shares several buckets is compared in the largest of them.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing.
Fewer words than a shingle's are one shingle. Rows with a null id are returned with a null component
and kept. Rows that share an id are each linked by their own text. Repeated rows are each returned.
An empty table gives an empty result. Other columns are dropped. Ids are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted, stored
from .graph import components
from .shingles import mixed, shingle_set

BANDS, ROWS = 75, 8
M = BANDS * ROWS
#: SetSketch parameters: base, rate, largest register.
BASE, RATE, TOP = 1.001, 20.0, 65_534
#: A pair whose estimate lies so many standard deviations below the threshold isn't confirmed.
MARGIN = 6
#: Members of a bucket on either side of a block; the same by shingles where their sets come along.
BLOCK_MEMBERS, BLOCK_SHINGLES = 2048, 1_000_000
#: Members held against one head in a task.
STAR = 1024
#: Ids to broadcast at most.
BROADCAST_ROWS = 200_000

_random = np.random.default_rng(20)
_FACTORS = (_random.integers(0, 2**31, M, np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_SHIFTS = _random.integers(0, 2**32, M, np.uint64).astype(np.uint32)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The M registers (uint16) of a set given by its 64-bit hashes."""
    if not len(hashes):
        return np.zeros(M, np.uint16)
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(M, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(least, (x[i : i + 256, None] * _FACTORS + _SHIFTS).min(0), out=least)
    h = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """int64 bucket keys, one row for each sketch and one column for each band."""
    words = np.ascontiguousarray(regs).reshape(-1, BANDS, ROWS).view(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(words.shape[2]):
        key = mixed(key + words[:, :, i])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of pairs of sketches (rows), the sizes being known."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u = size_a / (size_a + size_b)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j):
        p_up, p_down = p(u - v * j), p(v - u * j)
        term = lambda n, q: np.where(n > 0, n * np.log(np.maximum(q, 1e-12)), 0)
        return term(up, p_up) + term(down, p_down) + term(same, 1 - p_up - p_down)

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(30):
        x, y = high - ratio * (high - low), low + ratio * (high - low)
        better = likelihood(x) < likelihood(y)
        low, high = np.where(better, x, low), np.where(better, high, y)
    return (low + high) / 2


def sketch_table(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, n_shingles, print, regs): the set's size, a 128-bit hash of the set, and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, regs = [], [], []
            for t in batch.column(2):
                s = shingle_set(t.as_py(), words)
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                regs.append(registers(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())],
                ["id", "text_hash", "n_shingles", "print", "regs"],
            )

    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text).mapInArrow(run, "id long, text_hash long, n_shingles long, print binary, regs binary")


def spread(similarity: float) -> float:
    """How far below the similarity an estimate from M registers may lie."""
    return MARGIN * math.sqrt(similarity * (1 - similarity) / M)


def matrix(column, kind=np.uint16) -> np.ndarray:
    """A column of equally long binary values as an array, one row for each."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def buckets(reps: DataFrame) -> DataFrame:
    """(key, band, cid, n): a row for each band of each class."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                keys = band_keys(matrix(part.column("regs"))).reshape(-1)
                at = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
                bands = np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(bands), *[part.column(c).take(at) for c in ("cid", "n")]], ["key", "band", "cid", "n"])

    return reps.select("regs", "cid", "n").mapInArrow(run, "key long, band int, cid long, n long")


def near(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each group, as they come sorted by the names."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        marks = np.stack([table.column(c).to_numpy() for c in names])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1)]
        yield from (table.slice(x, y - x) for x, y in zip(cuts, cuts[1:]))
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def star_links(first: DataFrame, reps: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) of first with 100 * intersection >= percent * union of their full shingle sets.

    A head v comes to a task with up to STAR of its members, so each text is shuffled once.
    """
    similarity = percent / 100
    heads = first.groupBy("v").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    members = salted(first, heads, "v", "u").select("v", F.pmod(F.xxhash64("u"), "parts").cast("int").alias("part"), F.lit(False).alias("head"), F.col("u").alias("cid"))
    own = heads.select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("head"), F.col("v").alias("cid"))
    rows = members.union(own).join(reps.select("cid", "n", "regs"), "cid").join(texts, "cid")
    dealt = rows.repartition("v", "part").sortWithinPartitions("v", "part", F.desc("head"))

    def run(batches):
        held = None  # registers, size and set of the head
        for batch in batches:
            us, vs = [], []
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                head, texts = part.column("head").to_numpy(zero_copy_only=False), part.column("text")
                regs, n, cid, v = matrix(part.column("regs")), part.column("n").to_numpy(), part.column("cid").to_numpy(), part.column("v").to_numpy()
                of = np.maximum.accumulate(np.where(head, np.arange(len(head)), -1))
                before = (held[0], held[1]) if held else (regs[0], n[0])
                head_regs = np.where((of >= 0)[:, None], regs[of], before[0])
                sizes = np.where(of >= 0, n[of], before[1])
                good = estimate(regs, head_regs, n.astype(float), sizes.astype(float)) >= similarity - spread(similarity)
                for i in np.flatnonzero(head | good):
                    s = shingle_set(texts[i].as_py(), words)
                    if head[i]:
                        held = regs[i], n[i], s
                    elif 100 * (c := np.intersect1d(s, held[2], True).size) >= percent * (len(s) + len(held[2]) - c):
                        us.append(cid[i])
                        vs.append(v[i])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def dealt(rows: DataFrame, lefts: Column, rights: Column) -> DataFrame:
    """Each member of a bucket to its blocks: those outside the head's component (left) meet all members (right).

    lefts and rights are the numbers of blocks of either side. Adds left, l and r; a block is one key, l and r.
    """
    l, r = F.pmod(F.xxhash64("cid"), lefts).cast("int"), F.pmod(F.xxhash64("cid", F.lit(1)), rights).cast("int")
    place = lambda left, a, b: F.struct(F.lit(left).alias("left"), a.alias("l"), b.alias("r"))
    own = F.transform(F.sequence(F.lit(0), rights - 1), lambda k: place(True, l, k))
    none = F.array().cast("array<struct<left:boolean,l:int,r:int>>")
    places = F.concat(F.when(F.col("component") != F.col("head"), own).otherwise(none), F.transform(F.sequence(F.lit(0), lefts - 1), lambda k: place(False, k, r)))
    rows = rows.withColumn("place", F.explode(places)).select("*", "place.*").drop("place")
    return rows.repartition("key", "l", "r").sortWithinPartitions("key", "l", "r")


def pairs_of(group: pa.Table, compared: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): the pairs of a block that have different components and whose equal values don't rule them out.

    compared has M values for each member. Of the buckets that a pair shares, all of them mixed, only the
    largest (then that with the greatest key) has the pair: all would compare it alike.
    """
    left, key, similarity = group.column("left").to_numpy(), group.column("key")[0].as_py(), percent / 100
    ids, n, component, head = (group.column(c).to_numpy() for c in ("cid", "n", "component", "head"))
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    if not len(a) or not len(b):
        return
    lists = group.column("mixed").combine_chunks()
    at, each = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
    keys, sizes = np.zeros((len(ids), BANDS), np.int64), np.zeros((len(ids), BANDS), np.int64)
    bands = each.field("band").to_numpy()
    keys[at, bands], sizes[at, bands] = each.field("key").to_numpy(), each.field("size").to_numpy()
    for i in a:
        js = b[component[b] != component[i]]
        js = js[(component[js] == head[i]) | (ids[js] > ids[i])]
        js = js[np.minimum(n[js], n[i]) * 100 >= np.maximum(n[js], n[i]) * percent]
        js = js[(compared[js] == compared[i]).sum(1) >= (similarity - spread(similarity)) * M]
        if len(js):
            order = np.empty(BANDS, np.int64)
            order[np.lexsort((keys[i], sizes[i]))] = np.arange(BANDS)
            shared = (keys[js] == keys[i]) & (sizes[i] > 0)
            js = js[keys[i][np.where(shared, order, -1).argmax(1)] == key]
        if len(js):
            yield i, js


def undecided(members: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """(key, cid, component, head): the members of mixed buckets with a partner whose registers' low bytes don't rule it out.

    members has key, cid, n, component, head, size and outside; info has regs and mixed (band, key and size
    of each mixed bucket, BANDS at most) by cid.
    """

    def shorten(batches):
        for batch in batches:
            low = matrix(batch.column("regs")).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([r.tobytes() for r in low], pa.binary()), batch.column("mixed")], ["cid", "low", "mixed"])

    short = info.select("cid", "regs", "mixed").mapInArrow(shorten, "cid long, low binary, mixed array<struct<band:int,key:long,size:long>>")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_MEMBERS).cast("int")
    rows = dealt(members.drop("band").join(short, "cid"), blocks("outside"), blocks("size"))
    names = ["key", "cid", "component", "head"]

    def run(batches):
        for group in grouped(batches, ["key", "l", "r"]):
            low, seen = matrix(group.column("low"), np.uint8), np.zeros(group.num_rows, bool)
            for i, js in pairs_of(group, low, percent):
                seen[i] = seen[js] = True
            if seen.any():
                yield from group.select(names).filter(pa.array(seen)).combine_chunks().to_batches()

    return rows.mapInArrow(run, "key long, cid long, component long, head long").distinct()


def block_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join two components: rows of undecided() with n, regs, mixed and shingles are confirmed in blocks."""
    outside = F.when(F.col("component") != F.col("head"), F.col("n")).otherwise(0)
    sums = rows.groupBy("key").agg(F.sum(outside).alias("outside"), F.sum("n").alias("total"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_SHINGLES).cast("int")
    rows = dealt(salted(rows, sums, "key", "cid"), blocks("outside"), blocks("total"))
    similarity = percent / 100

    def links(group: pa.Table) -> tuple[list[int], list[int]]:
        regs, n, ids, component = matrix(group.column("regs")), *(group.column(c).to_numpy() for c in ("n", "cid", "component"))
        values, sets = np.unique(np.concatenate([np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]), return_inverse=True)
        sets = np.split(sets, np.cumsum(n)[:-1])
        marked = np.zeros(len(values), bool)
        root: dict[int, int] = {}

        def find(c):
            while root.setdefault(c, c) != c:
                c = root[c]
            return c

        us, vs = [], []
        for i, js in pairs_of(group, regs, percent):
            marked[sets[i]] = True
            guess = estimate(regs[i][None], regs[js], np.full(len(js), float(n[i])), n[js].astype(float))
            for j, g in sorted(zip(js.tolist(), guess.tolist()), key=lambda x: -x[1]):  # the likeliest first
                if g < similarity - spread(similarity):
                    break
                p, q = find(component[i]), find(component[j])
                if p != q and 100 * (c := int(marked[sets[j]].sum())) >= percent * (n[i] + n[j] - c):
                    root[max(p, q)] = min(p, q)
                    us.append(ids[i])
                    vs.append(ids[j])
            marked[sets[i]] = False
        return us, vs

    def run(batches):
        for group in grouped(batches, ["key", "l", "r"]):
            us, vs = links(group)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def only(df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows of df whose value in the column is in wanted: long rows that no one asks for aren't shuffled."""
    ids = wanted.select(column).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return df.join(ids, column, "left_semi")


def of_classes(wanted: DataFrame, docs: DataFrame, repeated: bool, key: str, text: str) -> DataFrame:
    """(cid, text): a text of each wanted class (cid, id, text_hash)."""
    texts = only(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), wanted, "id").withColumn("text_hash", F.xxhash64("text"))
    if repeated:  # several rows of one id: each text once
        texts = texts.groupBy("id", "text_hash").agg(F.min("text").alias("text"))
    return texts.join(wanted.select("cid", "id", "text_hash"), ["id", "text_hash"]).select("cid", "text")


def with_shingles(texts: DataFrame, words: int) -> DataFrame:
    """(cid, shingles): the sorted set of each text as bytes."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), words).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(sets, pa.binary())], ["cid", "shingles"])

    return texts.mapInArrow(run, "cid long, shingles binary")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, n_shingles, component): for each row of docs the hash of its text, the size of its set and the least id that it can reach."""
    sketches = stored(sketch_table(docs, words, key, text), "sketches")
    # one class for each different set; partial aggregation takes up copies before the shuffle
    found = sketches.where("id is not null and n_shingles > 0")
    repeated = not found.groupBy("id").count().where("count > 1").isEmpty()
    row = F.struct(F.col("n_shingles").alias("n"), "text_hash", "regs")
    reps = found.groupBy("print").agg(F.min("id").alias("id"), F.min_by(row, F.struct("id", "text_hash")).alias("r"))
    # numbered as they are written: what is read later has these numbers
    reps = stored(reps.select(F.monotonically_increasing_id().alias("cid"), "print", "id", "r.*"), "classes")

    keys = buckets(reps)
    heads = keys.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("cid", "n")).alias("first")).where("size > 1")
    met = stored(keys.join(heads, "key").select("key", "band", "cid", "n", F.col("first.cid").alias("v"), F.col("first.n").alias("vn")), "shared_buckets")
    first = met.where((F.col("cid") != F.col("v")) & near(F.col("n"), F.col("vn"), percent))
    first = first.groupBy(F.col("cid").alias("u"), "v").agg(F.count("*").alias("c"))
    first = stored(first.groupBy("u").agg(F.max_by("v", F.struct("c", -F.col("v"))).alias("v")), "first_pairs")
    wanted = first.select(F.col("u").alias("cid")).union(first.select("v")).distinct().join(reps.select("cid", "id", "text_hash"), "cid")
    wanted = stored(wanted, "first_classes")
    edges = stored(star_links(first, only(reps, wanted, "cid"), of_classes(wanted, docs, repeated, key, text), words, percent), "links")

    labels = components(edges)
    members = met.select("key", "band", "cid", "n").join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    members = stored(members, "labelled_buckets")
    counts = members.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key")
    counts = counts.agg(F.sum("c").alias("size"), F.max(F.struct("c", "component")).alias("top")).where("size > top.c")
    counts = counts.select("key", "size", F.col("top.component").alias("head"), (F.col("size") - F.col("top.c")).alias("outside"))
    members = stored(salted(members, counts, "key", "cid"), "mixed_buckets")
    mixed_of = members.groupBy("cid").agg(F.collect_list(F.struct("band", "key", "size")).alias("mixed"))
    info = stored(only(reps, members, "cid").join(mixed_of, "cid"), "mixed_classes")
    left = stored(undecided(members, info, percent), "undecided")
    wanted = stored(left.select("cid").distinct().join(info.select("cid", "id", "text_hash", "n", "regs", "mixed"), "cid"), "undecided_classes")
    sets = with_shingles(of_classes(wanted, docs, repeated, key, text), words)
    more = block_links(left.join(wanted.select("cid", "n", "regs", "mixed"), "cid").join(sets, "cid"), percent)
    labels = components(edges.union(more))

    classes = reps.select("cid", "print", "id").join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = classes.groupBy("component").agg(F.min("id").alias("least"))
    classes = salted(classes, least, "component", "cid").select("print", F.col("least").alias("component"))
    rows = sketches.select("id", "text_hash", "n_shingles", "print")
    out = rows.where("n_shingles > 0").join(classes, "print", "left")  # empty sets, which all have one print, need no class
    out = out.unionByName(rows.where("n_shingles = 0").withColumn("component", F.lit(None).cast("long")))
    component = F.when(F.col("id").isNull(), None).otherwise(F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")))
    return out.select("id", "text_hash", "n_shingles", component.alias("component"))


def op3_near_duplicates(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, words=2, percent=80)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


ORACLE = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, sh from (select doc_id, case when len(ws) = 1 then ws[1] else ws[i] || ' ' || ws[i + 1] end as sh from (select doc_id, ws, unnest(range(1, greatest(len(ws), 2))) as i from w where len(ws) > 0))),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
e as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 80 * (x.n + y.n - c)),
b as (select u, v from e union all select v, u from e),
reach as (select doc_id as id, doc_id as r from w union select b.v, reach.r from reach join b on b.u = reach.id where reach.r < b.v),
comp as (select id, min(r) as component_id from reach group by id)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, (w.doc_id = component_id) as kept
from w left join n on n.doc_id = w.doc_id join comp on comp.id = w.doc_id
"""

"""Operator 2: token ids as length-delimited binary records with an offset index.

Texts are encoded with a tokenizer file of the tokenizers library, an end id closes each document,
and the ids go to shards in ascending doc_id order. A record is

    length of the payload (uint64) | masked checksum of these 8 bytes (uint32) | payload | masked checksum of the payload (uint32)

and a payload is: 1 if the document has an id, else 0 (uint8); bytes of an id, 2 or 4 (uint8); doc_id
(int64); number of ids (uint64); ids. All numbers are little-endian. The checksum is CRC-32, rotated
right by 15 bits plus 0xA282EAD8. Beside each shard its index has 16 bytes for each record: its offset
and its number of ids, so that readers can fetch records in any order. Tasks write under new names and
report them; only files that a finished task has reported are read, so tasks can be run again.

A word is encoded once for many texts: the tokenizer's normaliser and splitter never look across
spaces and line ends, and their pieces are encoded by the library.

Edge cases: a null text counts as empty and has the end id alone. A null doc_id comes first. Rows
that share a doc_id are ordered by text (null first); repeated rows each get a record. An empty
table gives an empty result. Other columns aren't written.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path
from .kept import Kept

HEAD = struct.Struct("<BBqQ")
ENTRY = np.dtype([("offset", "<u8"), ("n", "<u8")])
#: Words whose ids a worker keeps, twice at most.
KEPT = 500_000
INDEX_SCHEMA = "shard int, path string, offset long, n_tokens long, start long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframed(stream) -> bytes:
    """The payload of the record at which a stream stands; an error if a checksum is wrong."""
    head = stream.read(12)
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("a record's length is damaged")
    body = stream.read(struct.unpack("<Q", head[:8])[0] + 4)
    if masked(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
        raise ValueError("a record's payload is damaged")
    return body[:-4]


def packed(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return HEAD.pack(doc_id is not None, width, doc_id or 0, len(ids)) + ids.astype(f"<u{width}").tobytes()


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    has_id, width, doc_id, _ = HEAD.unpack_from(payload)
    return doc_id if has_id else None, np.frombuffer(payload, f"<u{width}", offset=HEAD.size)


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder(Kept):
    """word -> its ids as uint32 bytes."""

    #: Letters that are their own composed form, then punctuation in which no contraction starts.
    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        super().__init__(KEPT)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.packed_ids = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        # byte-level pieces: printable bytes stand for themselves, the rest for the characters from 256
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.chars = [chr(b if b in printable else next(others)) for b in range(256)]
        # the short way is taken if the file normalises and splits as it supposes
        probe = ["", "Élan", "été...", "Straße", "Thing", "x##", "a`b"]
        self.quick = True
        self.quick = all(np.array_equal(self.whole(w), np.frombuffer(self.make(w), "<u4")) for w in probe)
        self.by_words = all(np.array_equal(self.whole(f"{a} {b}\n{a}"), np.concatenate([self.whole(x) for x in (a, b, a)])) for a, b in (("Ab'", "s."), ("é", "́x"), ("1", "2")))
        self.clear()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def make(self, word: str) -> bytes:
        if self.quick and (m := self.PLAIN.fullmatch(word)):
            letters, marks = m[1].lower(), m[2]
            if marks:
                return self[letters] + self[marks]
            if not letters.isascii():
                letters = "".join([self.chars[b] for b in letters.encode()])
            packed_ids = self.packed_ids
            return b"".join([packed_ids[t.id] for t in self.model.tokenize(letters)])
        return self.whole(word).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if not self.by_words:
            return self.whole(text)
        if self.quick and (text.isascii() or latin(text)):  # lower case commutes with composing there
            text = text.lower()
        return np.frombuffer(b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))), "<u4")


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, path: str, end_id: int = 1, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write shards and indexes below path, a folder that all executors reach.

    Returns the manifest, a row for each shard: shard, path, n_docs, n_tokens, start (ids in the shards before).
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    store, folder = _opened(path)
    store.create_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer).encode
        end = np.array([end_id], "<u4")
        own, target = _opened(path)
        shard = TaskContext.get().partitionId()
        name = f"part-{shard:05d}-{uuid.uuid4().hex}"
        entries, at, total, file = [], 0, 0, None
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if file is None:
                    file = own.open_output_stream(f"{target}/{name}.rec", buffer_size=1 << 20)
                ids = np.concatenate((encode(t.as_py()), end))
                record = framed(packed(i, ids))
                file.write(record)
                entries.append((at, len(ids)))
                at += len(record)
                total += len(ids)
        if file is not None:
            file.close()
            with own.open_output_stream(f"{target}/{name}.idx") as index:
                index.write(np.array(entries, ENTRY).tobytes())
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{path}/{name}", "n_docs": len(entries), "n_tokens": total}], schema)

    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).repartitionByRange("id", F.substring("text", 1, 32)).sortWithinPartitions("id", "text")
    shards = sorted(tuple(r) for r in rows.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long").collect())
    starts = np.cumsum([0, *[s[3] for s in shards]])
    return spark.createDataFrame([(*s, int(b)) for s, b in zip(shards, starts)], "shard int, path string, n_docs long, n_tokens long, start long")


def read_index(manifest: DataFrame) -> DataFrame:
    """INDEX_SCHEMA: where each record is, its ids, and the ids of all records before it. A partition for each shard."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                store, file = _opened(r["path"] + ".idx")
                with store.open_input_stream(file) as f:
                    entries = np.frombuffer(f.read(), ENTRY)
                starts = r["start"] + np.cumsum(entries["n"].astype(np.int64)) - entries["n"].astype(np.int64)
                n = len(entries)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r["shard"], np.int32)), pa.array([r["path"]] * n), pa.array(entries["offset"].astype(np.int64)), pa.array(entries["n"].astype(np.int64)), pa.array(starts)],
                    ["shard", "path", "offset", "n_tokens", "start"],
                )

    shards = max(1, manifest.count())
    return manifest.repartition(shards, "shard").mapInArrow(run, INDEX_SCHEMA)


def read_records(index: DataFrame, digest: bool = False) -> DataFrame:
    """The records of index rows, in the rows' order: doc_id, start and ids (array<int>), or with digest n_tokens and ids_crc32."""

    def run(batches):
        path, stream = None, None
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                ids, data = [], []
                for p, offset in zip(part.column("path").to_pylist(), part.column("offset").to_pylist()):
                    if p != path:
                        store, file = _opened(p + ".rec")
                        path, stream = p, store.open_input_file(file)
                    stream.seek(offset)
                    doc_id, values = unpacked(unframed(stream))
                    ids.append(doc_id)
                    data.append(values)
                columns = [pa.array(ids, pa.int64()), part.column("start")]
                if digest:
                    columns += [pa.array([len(d) for d in data], pa.int64()), pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in data], pa.int64())]
                else:
                    columns.append(pa.array([d.astype(np.int32) for d in data], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", *(["n_tokens", "ids_crc32"] if digest else ["ids"])]
    return index.mapInArrow(run, "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids array<int>"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = write_records(docs, new_path(spark, "token_records"))
    return read_records(read_index(manifest), digest=True)

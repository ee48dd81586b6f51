"""Operator 7: SentencePiece encoding and decoding by a weighted finite-state transducer.

The model is compiled to a transducer from characters to piece ids. Its first part is the normaliser:
the model's arcs from strings to strings (the longest that fits; a character without an arc stays), a
state that remembers a space where runs of them are to become one, and an arc that writes a word mark
for the text's start. Its second part are the pieces: from a state, each piece that the input spells
leads on with the weight -score; a character in no piece leads on by its UTF-8 bytes' pieces, or by
the unknown piece, with a weight above all others'. The shortest path (tropical semiring) through the
composition with a text is its encoding. Decoding runs the inverse transducer, from ids to bytes.

Unigram models are just that. In models of byte-pair merging, states also remember the last piece,
and a piece may follow another only if merging their joint text yields just these two: a sequence is
the result of merging if and only if that holds for all its neighbours. So for these models one path is
left of each text, and its weight decides nothing: it is looked for by its longest arcs first, and the first
path that reaches the end is the shortest. The weights matter in unigram models, of which all arcs are followed.

Where no piece has a word mark after another character, paths meet in one state before each run of
word marks, and each stretch between is composed once and kept. A model whose pieces, normaliser or
options can't be compiled so (pieces set by the user or unused ones among merged pieces, word marks at
the ends of words) is refused with a ValueError.

Edge cases: a null text has no pieces (an empty list), as an empty one has; it decodes to the empty
text. Repeated rows are each encoded. Very long texts are composed stretch by stretch. An empty table gives an
empty result. Other columns pass through; a column with the name of the result column is replaced.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import slices
from .kept import Kept

MARK = "▁"
#: Stretches whose pieces a worker keeps, in two generations.
KEPT = 180_000
#: Above any piece's id.
WIDTH = 1 << 24


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Normaliser:
    """The first part of the transducer: the model's arcs, kept as the double array that the model has."""

    def __init__(self, spec):
        data = spec.precompiled_charsmap
        size = int.from_bytes(data[:4], "little")
        self.units, self.targets = np.frombuffer(data, "<u4", size // 4, 4).tolist() if data else [], data[4 + size :]
        self.once, self.dummy = spec.remove_extra_whitespaces, spec.add_dummy_prefix
        if not spec.escape_whitespaces:
            raise ValueError("spaces aren't escaped")
        starts = bytes(c for c in range(1, 256) if self.units and self._step(0, c) is not None)
        self.start = re.compile(b"[" + re.escape(starts) + b"]") if starts else None

    def _step(self, node: int, byte: int) -> int | None:
        """The node that the byte leads to: its place is the node's offset, with the byte's bits turned."""
        unit = self.units[node]
        at = node ^ ((unit >> 10) << ((unit & 512) >> 6)) ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def _arc(self, data: bytes, i: int) -> tuple[int, bytes] | None:
        """The end of the longest arc from i, and what it writes."""
        node, best = 0, None
        for j in range(i, len(data)):
            node = self._step(node, data[j])
            if node is None:
                break
            unit = self.units[node]
            if unit >> 8 & 1:  # an arc ends here; its target's place is in the node's offset
                best = j + 1, self.units[node ^ ((unit >> 10) << ((unit & 512) >> 6))] & 0x7FFFFFFF
        return best and (best[0], self.targets[best[1] : self.targets.index(b"\0", best[1])])

    def written(self, text: str) -> str:
        """What the arcs write for a text, spaces being still spaces."""
        if self.start:
            data, out, i = text.encode(), [], 0
            while found := self.start.search(data, i):
                out.append(data[i : found.start()])
                arc = self._arc(data, found.start())
                if arc is None:  # the character has no arc of its own
                    end = found.start() + len(data[found.start() : found.start() + 4].decode("utf-8", "ignore")[0].encode())
                    arc = end, data[found.start() : end]
                i = arc[0]
                out.append(arc[1])
            text = (b"".join(out) + data[i:]).decode()
        return re.sub(" +", " ", text).strip(" ") if self.once else text

    def __call__(self, text: str) -> str:
        text = self.written(text)
        text = (MARK * self.dummy + text).replace(" ", MARK) if text else ""
        return text.rstrip(MARK) if self.once else text


class Transducer(Kept):
    """The compiled model; as a dictionary it has the ids (little-endian uint32 bytes) of stretches."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        super().__init__(KEPT)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        trainer, kinds = model.trainer_spec, model.pieces[0].Type if model.pieces else None
        self.merges = trainer.model_type == trainer.BPE
        if not self.merges and trainer.model_type != trainer.UNIGRAM or trainer.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only unigram and byte-pair models with word marks before words can be compiled")
        self.normaliser = Normaliser(model.normalizer_spec)
        self.byte_ids, self.unknown = [0] * 256, 0
        self.ids: dict[str, int] = {}
        self.surface: list[bytes] = []
        self.weights = [-p.score for p in model.pieces]
        usual = [p.score for p in model.pieces if p.type == kinds.NORMAL]
        for i, p in enumerate(model.pieces):
            surface = b""
            if p.type == kinds.BYTE:
                surface = bytes([int(p.piece[3:5], 16)])
                self.byte_ids[surface[0]] = i
            elif p.type == kinds.UNKNOWN:
                self.unknown, surface = i, trainer.unk_surface.encode()
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                if p.type == kinds.USER_DEFINED:
                    self.weights[i] = -(len(p.piece.encode()) * max(usual) - 0.1)
                self.ids[p.piece] = i
                surface = p.piece.replace(MARK, " ").encode()
            if self.merges and p.type in (kinds.USER_DEFINED, kinds.UNUSED):
                raise ValueError(f"{path}: among merged pieces, {p.piece!r} can't be compiled")
            self.surface.append(surface)
        self.bytes = trainer.byte_fallback
        #: Beyond the weight of any piece: a character in no piece.
        self.beyond = 0.0 if self.merges else 10 - min(usual, default=0)
        #: Whether a stretch may begin at each run of word marks.
        self.apart = not any(MARK in p.lstrip(MARK) for p in self.ids)
        if self.merges and not self.apart:
            raise ValueError(f"{path}: a merged piece has a word mark after another character")
        self.names = {i: p for p, i in self.ids.items()}
        self.score = {p: model.pieces[i].score for p, i in self.ids.items()}
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        #: Whether a stretch has one path: by merged neighbours, if no merged piece has a character that isn't itself one.
        self.one_path = self.merges and all(c in self.ids for p in self.ids for c in p)
        self.shorter: dict[int, int] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        if self.one_path:
            self._chain(self.trie)
            self._halve()
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.allowed: dict[int, bool] = {}

    def _chain(self, trie: dict) -> None:
        """Each node's "" becomes the longest piece on the way to it, or -1; shorter: the next such piece of each piece."""
        open_nodes = [(trie, -1)]
        while open_nodes:
            node, longest = open_nodes.pop()
            if (own := node.get("")) is not None:
                self.shorter[own], longest = longest, own
            node[""] = longest
            open_nodes += [(below, longest) for c, below in node.items() if c]

    def _halve(self) -> None:
        """halves: the parts that a piece is merged of last, for pieces with a score of their own that come after both, down to characters."""
        shared = Counter(self.score.values())
        for p, score in sorted(self.score.items(), key=lambda x: -x[1]):
            if len(p) > 1 and shared[score] == 1 and len(two := self.merged(p, 2)) == 2:
                if all(len(h) == 1 or h in self.halves and self.score[h] > score for h in two):
                    self.halves[p] = two[0], two[1]

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether merging their joint text leaves two pieces, each a character or in halves.

        Their merges are undone, the last one first; before each, the parts at the border must not have been a better pair, nor
        an equal one further left.
        """
        score, halves, made, left = self.score, self.halves, -np.inf, False
        while True:
            pair = score.get(a + b, -np.inf)
            if pair > made or left and pair == made:
                return False
            of_a, of_b = score[a] if a in halves else np.inf, score[b] if b in halves else np.inf
            if of_a == of_b == np.inf:
                return True
            left = of_b <= of_a
            made, a, b = (of_b, a, halves[b][0]) if left else (of_a, halves[a][1], b)

    def merged(self, text: str, least: int = 1) -> list[str]:
        """The pieces that repeated merging of the best neighbours makes of a short text, until so many are left."""
        parts = list(text)
        while len(parts) > least:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -np.inf), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_follow(self, last: int, piece: int) -> bool:
        """last: -1 at the start and after a character in no piece, which nothing merges with."""
        if not self.merges:
            return True
        key = last * WIDTH + piece
        if (found := self.allowed.get(key)) is None:
            want = [self.names[piece]] if last < 0 else [self.names[last], self.names[piece]]
            if all(len(p) == 1 or p in self.halves for p in want):
                found = len(want) == 1 or self.stay_apart(*want)
            else:
                found = self.merged("".join(want)) == want
            self.allowed[key] = found
        return found

    def shortest(self, text: str) -> list[int]:
        """The ids on the shortest path of one stretch; of equally short ones to a place, the one found first.

        Where neighbours decide, no place can be reached by two last pieces, so each keeps one state.
        """
        n, trie, allowed, weights = len(text), self.trie, self.allowed, self.weights
        cost: list[float] = [0.0] + [np.inf] * n
        last, before = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            so_far = cost[i]
            if so_far == np.inf:
                continue
            node, j, own = trie, i, last[i] * WIDTH
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                piece = node.get("")
                if piece is not None and so_far + weights[piece] < cost[j]:
                    ok = allowed.get(own + piece)
                    if self.may_follow(last[i], piece) if ok is None else ok:
                        cost[j], last[j], before[j] = so_far + weights[piece], piece, i
            if text[i] not in self.ids and so_far + self.beyond < cost[i + 1]:
                cost[i + 1], last[i + 1], before[i + 1] = so_far + self.beyond, -1, i
        place, out = n, []
        while place > 0:
            if last[place] < 0 and self.bytes:
                out += [self.byte_ids[b] for b in reversed(text[before[place]].encode())]
            elif last[place] < 0:
                out.append(self.unknown)
            else:
                out.append(last[place])
            place = before[place]
        return out[::-1]

    def only(self, text: str) -> list[int]:
        """The ids on the only path of one stretch, if a stretch has one: at each place the longest piece first.

        A place is reached by one last piece at most, so one that leads to no end is left for good.
        """
        n, trie, allowed, names, shorter = len(text), self.trie, self.allowed, self.names, self.shorter
        path, starts, closed = [], [], set()
        i, last, piece = 0, -1, None
        while i < n:
            if piece is None:
                node, j = trie, i
                while j < n and (below := node.get(text[j])) is not None:
                    node, j = below, j + 1
                piece = node[""]
            while piece >= 0:
                j = i + len(names[piece])
                if j not in closed:
                    ok = allowed.get(last * WIDTH + piece)
                    if self.may_follow(last, piece) if ok is None else ok:
                        break
                piece = shorter[piece]
            else:
                j = i + 1
                if text[i] in self.ids or j in closed:  # no way on: back to the place before
                    closed.add(i)
                    i, piece = starts.pop(), path.pop()
                    last, piece = path[-1] if path else -1, shorter.get(piece, -1)
                    continue
            path.append(piece)
            starts.append(i)
            i, last, piece = j, piece, None
        if -1 not in path:
            return path
        out: list[int] = []
        for at, piece in zip(starts, path):
            out += [piece] if piece >= 0 else [self.byte_ids[b] for b in text[at].encode()] if self.bytes else [self.unknown]
        return out

    def make(self, stretch: str) -> bytes:
        if len(self.allowed) > 2 * KEPT:
            self.allowed.clear()
        if self.one_path:
            found = self.only(stretch)
        else:
            inner = self.inner
            cuts = [i for i in range(1, len(stretch)) if stretch[i - 1 : i + 1] not in inner]
            if cuts:  # no piece goes across: the parts are stretches of their own
                return b"".join([self[stretch[a:b]] for a, b in zip([0, *cuts], [*cuts, len(stretch)])])
            found = self.shortest(stretch)
        return struct.pack(f"<{len(found)}I", *found)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian uint32 bytes."""
        if not text:
            return b""
        n = self.normaliser
        if n.start or n.once or not n.dummy or not self.apart or text[0] == " " or "  " in text or MARK in text or "\n" in self.ids:
            text = n(text)
            parts = re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", text) if self.apart else [text]
        else:  # the same where only spaces have an arc, with stretches ended at line ends, which are in no piece
            parts = list(filter(None, (MARK + text).replace(" ", " " + MARK).replace("\n", " \n ").split(" ")))
        found = b"".join(map(self.__getitem__, parts))
        if self.bytes:
            return found
        ids = np.frombuffer(found, "<u4")  # a run of unknown characters is one unknown piece
        return np.delete(ids, np.flatnonzero((ids[1:] == self.unknown) & (ids[:-1] == self.unknown))).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        ids, n = ids.tolist(), self.normaliser
        parts = [self.surface[i] for i in ids]
        for k, i in enumerate(ids if n.dummy or n.once else ()):
            if i not in self.names:
                break
            parts[k] = parts[k].lstrip(b" ") if n.once else parts[k].removeprefix(b" ")
            if parts[k] or not n.once:
                break
        return b"".join(parts).decode("utf-8", "replace")


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each worker and model."""
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encoded(docs: DataFrame, text: str = "text", out: str = "piece_ids", model: str | None = None, back: str | None = None) -> DataFrame:
    """docs with out: array<int> of the piece ids of the whole text, and with back, if given: what the ids decode to.

    model is a path on every executor. Decoding in the same pass keeps one worker for a task.
    """
    model = model or default_model()
    docs = docs.drop(out, *([back] if back else []))
    schema = StructType([*docs.schema.fields, StructField(out, ArrayType(IntegerType()))])
    names = [*docs.columns, out]
    if back:
        schema, names = schema.add(back, "string"), [*names, back]
    at = docs.columns.index(text)

    def run(batches):
        fst = transducer(model)
        for batch in slices(batches):
            parts = [np.frombuffer(fst.encode(t.as_py()), "<u4") for t in batch.column(at)]
            more = [pa.array([fst.decode(p) for p in parts], pa.string())] if back else []
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(parts), *more], names)

    return docs.mapInArrow(run, schema)


def decoded(docs: DataFrame, ids: str = "piece_ids", out: str = "decoded", model: str | None = None) -> DataFrame:
    """docs with out: the text that the piece ids stand for."""
    model = model or default_model()
    docs = docs.drop(out)
    schema = StructType([*docs.schema.fields]).add(out, "string")
    at = docs.columns.index(ids)

    def run(batches):
        fst = transducer(model)
        for batch in slices(batches):
            texts = [fst.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, text: str = "text", model: str | None = None, decoded: bool = True) -> DataFrame:
    """docs without the text, with piece_ids of the whole text, what they decode to (decoded, unless it isn't asked for), n_pieces, ids_crc32
    (of the ids as little-endian uint32) and same: whether decoding gives the text back."""
    model = model or default_model()
    kinds = {"piece_ids": ArrayType(IntegerType()), **({"decoded": "string"} if decoded else {}), "n_pieces": "long", "ids_crc32": "long", "same": "boolean"}
    names = [c for c in docs.columns if c != text and c not in kinds]
    schema = StructType([f for f in docs.schema.fields if f.name in names])
    for name, kind in kinds.items():
        schema = schema.add(name, kind)
    rest, at = [docs.columns.index(c) for c in names], docs.columns.index(text)

    def run(batches):
        fst = transducer(model)
        for batch in slices(batches):
            ids, back, crcs, same = [], [], [], []
            for t in batch.column(at):
                t = t.as_py()
                found = fst.encode(t)
                ids.append(np.frombuffer(found, "<u4"))
                crcs.append(zlib.crc32(found))
                again = fst.decode(ids[-1])
                same.append(again == (t or ""))
                if decoded:
                    back.append(again)
            sizes = pa.array([len(x) for x in ids], pa.int64())
            made = [_lists(ids), *([pa.array(back, pa.string())] if decoded else []), sizes, pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], *made], schema.names)

    return docs.mapInArrow(run, schema)


def op7_sentencepiece(spark, sf_dir) -> DataFrame:
    """doc_id, piece_ids, decoded (what the ids decode to), n_pieces, ids_crc32 and same."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

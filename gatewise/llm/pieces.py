"""SentencePiece encoding with source offsets, and decoding.

Encoding runs in three steps:

1. *Normalisation.*  Longest-prefix replacement through the model's compiled
   character map (a double-array trie over UTF-8 and a pool of replacement
   strings), white space handled as the model says.  Every byte of normalised
   text remembers the span of source bytes it came from.
2. *Segmentation.*  No piece of the model holds the space mark after another
   character, nor a line feed besides its byte piece (both are checked when the
   model is loaded), so merges never cross the start of a run of marks or a
   line feed.  The text is cut there; each chunk is normalised, segmented by the
   library and projected once, and remembered; a batch's unknown chunks go to
   the library together.  A chunk's spans are moved to its place in the text.
3. *Projection.*  Pieces tile the normalised text, so each takes the source
   span from its first byte's start to its last byte's end.  Byte pieces of one
   character share the character's span.  Pieces that don't tile it are an error.

Decoding starts from the ids alone.  If the model breaks an assumption, whole
texts are normalised, segmented and projected; nothing is remembered then.

Defined results: a null or empty text has no pieces and decodes to the empty
text; equal rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
import struct
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Chunks a worker remembers; the table starts anew beyond that.
REMEMBERED = 600_000


class CharacterMap:
    """The compiled map: u32 size of the trie, its u32 units, then zero-ended replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.pool = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that ``data`` has at ``at``, and its replacement."""
        units = self.units
        if not units:
            return None
        found = None
        node = self._offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.pool[start : self.pool.index(b"\0", start)]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


def _width(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


@dataclass
class Normal:
    """Normalised bytes; ``starts[i]``, ``ends[i]``: the source span of byte i.  ``None`` spans: the source itself."""

    data: bytes
    starts: list[int]
    ends: list[int]


@dataclass
class Coded:
    """Pieces, their spans of source bytes in UTF-8, and the text decoded from the pieces."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    decoded: str


class Chunks:
    """Segmented chunks: where each one's pieces lie in the flat arrays, and its source bytes."""

    def __init__(self):
        self.slots: dict[str, int] = {}
        self.used = 0
        self.first, self.count, self.size = (np.zeros(1024, np.int64) for _ in range(3))
        self.ids, self.starts, self.ends = (np.zeros(4096, np.int32) for _ in range(3))

    def _room(self, names: tuple[str, ...], least: int) -> None:
        for name in names:
            old = getattr(self, name)
            if least > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(least, 2 * len(old)) - len(old), old.dtype)]))

    def add(self, chunks: list[str], sizes: np.ndarray, counts: np.ndarray, *found: np.ndarray) -> None:
        """``found``: ids, starts and ends of all chunks' pieces, of which each chunk has ``counts``."""
        at, many = len(self.slots), len(found[0])
        self._room(("first", "count", "size"), at + len(chunks))
        self._room(("ids", "starts", "ends"), self.used + many)
        here = slice(at, at + len(chunks))
        self.count[here] = counts
        self.first[here] = self.used + np.cumsum(counts) - counts
        self.size[here] = sizes
        for name, values in zip(("ids", "starts", "ends"), found):
            getattr(self, name)[self.used : self.used + many] = values
        self.used += many
        self.slots.update(zip(chunks, range(at, at + len(chunks))))


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as formats

        with open(path, "rb") as f:
            blob = f.read()
        spec = formats.ModelProto()
        spec.ParseFromString(blob)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        rules = spec.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = (
            rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces,
        )
        self.pieces = [p.piece for p in spec.pieces]
        self.bytes = {i: int(p.piece[3:5], 16) for i, p in enumerate(spec.pieces) if p.type == 6}
        special = {p.piece for p in spec.pieces if p.type not in (1, 6)}
        plain = [p for p in self.pieces if p not in special]
        self.local = (
            self.prefix
            and self.escape
            and not self.squeeze
            and not self.map.units
            and not any(p.type == 4 for p in spec.pieces)
            and spec.trainer_spec.model_type == 2
            and not spec.trainer_spec.treat_whitespace_as_suffix
            and not any(MARK in p.lstrip(MARK) or "\n" in p for p in plain)
        )
        self.lengths = [1 if i in self.bytes else len(p.encode()) for i, p in enumerate(self.pieces)]
        self.lengths_of = np.array(self.lengths, np.int64)
        self.decimals = list(map(str, range(len(self.pieces))))
        self.unknown = self.library.unk_id()
        self.known = Chunks()

    # -- normalisation

    def normalise(self, text: str, inside: bool = False) -> Normal:
        """As the library normalises, with the source span of every byte; no dummy prefix ``inside`` a text."""
        data = text.encode()
        out, starts, ends = bytearray(), [], []
        space = MARK.encode() if self.escape else b" "

        def put(piece: bytes, a: int, b: int) -> None:
            out.extend(piece)
            starts.extend([a] * len(piece))
            ends.extend([b] * len(piece))

        at = 0
        if not self.map.units and not self.squeeze:  # no key to find: every character but a space is itself
            if text and self.prefix and not inside:
                put(space, 0, 0)
            for k, part in enumerate(text.split(" ")):
                if k:
                    put(space, at, at + 1)
                    at += 1
                if part.isascii():
                    out.extend(part.encode())
                    starts.extend(range(at, at + len(part)))
                    ends.extend(range(at + 1, at + len(part) + 1))
                    at += len(part)
                else:
                    for char in map(str.encode, part):
                        put(char, at, at + len(char))
                        at += len(char)
            return Normal(bytes(out), starts, ends)
        pending: list[tuple[bytes, int, int]] = []
        while at < len(data):
            hit = self.map.longest(data, at)
            length, new = hit if hit else (_width(data[at]), data[at : at + _width(data[at])])
            pending.append((new, at, at + length))
            at += length
        if self.squeeze:  # at the start and the end, and runs
            while pending and not pending[0][0].strip(b" "):
                pending.pop(0)
        if not pending:
            return Normal(b"", [], [])
        if self.prefix and not inside:
            put(space, pending[0][1], pending[0][1])
        gap = self.squeeze
        for new, a, b in pending:
            for char in new.decode():
                if char == " ":
                    if not (self.squeeze and gap):
                        put(space, a, b)
                    gap = True
                else:
                    put(char.encode(), a, b)
                    gap = False
        if self.squeeze:
            while out.endswith(space):
                for _ in space:
                    out.pop(), starts.pop(), ends.pop()
        return Normal(bytes(out), starts, ends)

    # -- segmentation

    _CUT = re.compile(r"[ ▁]+[^ ▁\n]*|\n[^ ▁\n]*")

    def chunks(self, text: str) -> list[str]:
        """Cuts of the text with its dummy prefix; joined they are that text."""
        return self._CUT.findall(" " + text)

    def learn(self, new: list[str]) -> None:
        """Normalise, segment and project chunks.  The library's dummy prefix stands for a chunk's first mark, or is dropped."""
        if len(self.known.slots) + len(new) > REMEMBERED:
            self.known = Chunks()
        marked = [c[0] in " ▁" for c in new]
        coded = self.library.encode([c[1:] if m else c for c, m in zip(new, marked)], num_threads=1)
        # the library has no pieces for the empty text left of a lone mark
        lone = [self.library.piece_to_id(MARK)]
        coded = [lone if c in (" ", MARK) else ids if m else ids[1:] for c, m, ids in zip(new, marked, coded)]
        counts = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter(chain.from_iterable(coded), np.int64, int(counts.sum()))
        raw = np.frombuffer("".join(new).encode(), np.uint8)
        at = np.flatnonzero((raw & 0xC0) != 0x80)  # where characters start
        edges = np.append(at, len(raw))[np.cumsum([0, *map(len, new)])]  # and chunks
        if (ids == self.unknown).any():
            found = [self.project(self.normalise(c, inside=True), i) for c, i in zip(new, coded)]
            flat = np.array([x for one in found for x in one], np.int64).reshape(-1, 3).T
            self.known.add(new, np.diff(edges), counts, *flat)
            return
        # all chunks at once, as ``normalise`` and ``project`` do: a space is written as a mark, others as they are
        width = np.diff(at, append=len(raw))
        written = np.where(raw[at] == 0x20, len(MARK.encode()), width)
        first, last = np.repeat(at, written), np.repeat(at + width, written)
        sizes = self.lengths_of[ids]
        done = np.cumsum(sizes)
        covered = np.concatenate([[0], done])[np.cumsum(counts)]
        needed = np.cumsum(np.concatenate([[0], written]))[np.searchsorted(at, edges[1:])]
        if not np.array_equal(covered, needed):
            raise ValueError("pieces don't cover the normalised text")
        base = np.repeat(edges[:-1], counts)
        self.known.add(new, np.diff(edges), counts, ids, first[done - sizes] - base, last[done - 1] - base)

    def segment(self, chunks: list[str]) -> np.ndarray:
        """Where each chunk is remembered."""
        found = list(map(self.known.slots.get, chunks))
        if None in found:
            self.learn(list({c for c, f in zip(chunks, found) if f is None}))
            found = list(map(self.known.slots.get, chunks))
            if None in found:  # the table was emptied
                self.learn(list(set(chunks)))
                found = [self.known.slots[c] for c in chunks]
        return np.array(found, np.int64)

    def prepare(self, texts: list[str]) -> None:
        """Learn the unknown chunks of many texts together."""
        if self.local:
            slots = self.known.slots
            new = {c for t in texts if t for c in self.chunks(t) if c not in slots}
            if new:
                self.learn(list(new))

    # -- projection

    def project(self, normal: Normal, ids: list[int]) -> list[tuple[int, int, int]]:
        """``(id, start, end)``: the source span of each piece."""
        at, out = 0, []
        for i in ids:
            n = self.lengths[i] if i != self.unknown else _width(normal.data[at])
            out.append((i, normal.starts[at], normal.ends[at + n - 1]))
            at += n
        if at != len(normal.data):
            raise ValueError(f"pieces cover {at} of {len(normal.data)} bytes of the normalised text")
        return out

    def code(self, text: str) -> Coded:
        if not text:
            return Coded(*(np.empty(0, np.int32) for _ in range(3)), "")
        if self.local:
            slots = self.segment(self.chunks(text))
            known = self.known
            counts, sizes = known.count[slots], known.size[slots]
            before = np.cumsum(counts) - counts
            at = np.repeat(known.first[slots] - before, counts) + np.arange(int(counts.sum()))
            shift = np.repeat(np.cumsum(sizes) - sizes - 1, counts)  # the dummy prefix is no byte of the source
            ids = known.ids[at]
            starts, ends = np.maximum(known.starts[at] + shift, 0), np.maximum(known.ends[at] + shift, 0)
        else:
            found = self.project(self.normalise(text), self.library.encode(text))
            ids, starts, ends = np.array(found, np.int64).reshape(-1, 3).T
        return Coded(ids, starts, ends, self.decode(ids.tolist()))

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """``(id, start, end)`` with spans of source bytes in UTF-8; together they cover the text in order."""
        coded = self.code(text)
        return list(zip(coded.ids.tolist(), coded.starts.tolist(), coded.ends.tolist()))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, their comma-joined digest, and the digest of the decoded text."""
        coded = self.code(text)
        written = ",".join(map(self.decimals.__getitem__, coded.ids.tolist()))
        return len(coded.ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(coded.decoded.encode()).hexdigest()

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    gc.disable()  # the chunk table is large and without cycles; walking it again and again costs a third of the time
    return PieceModel(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, starts, ends, decoded)`` for every row: pieces, their source byte spans, the text decoded."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = model(path)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        known.prepare(texts)
        coded = [known.code(t) for t in texts]
        columns = [pa.array([getattr(c, k) for c in coded], pa.list_(pa.int32())) for k in ("ids", "starts", "ends")]
        decoded = pa.array([c.decoded for c in coded], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, decoded], [id_col, "ids", "starts", "ends", "decoded"])

    rows = docs.select(id_col, F.col(text_col).alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return common.map_batches(
        rows, run, f"`{id_col}` {kind}, ids array<int>, starts array<int>, ends array<int>, decoded string"
    )


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: what ``encode`` gives, folded where it is made."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = model(path)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        known.prepare(texts)
        found = [known.digest(t) for t in texts]
        columns = [pa.array([f[0] for f in found], pa.int64())]
        columns += [pa.array([f[k] for f in found], pa.string()) for k in (1, 2)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(id_col, F.col(text_col).alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return common.map_batches(rows, run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = digests(common.documents(spark, sf_dir), str(public_tokenizers.path("piece_bpe_32k.model")))
    return common.durable(found, "pieces")

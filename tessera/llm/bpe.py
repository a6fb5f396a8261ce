"""Byte-level BPE encoding and decoding with a sentencepiece model made from a rank file.

The rank file (base64 token, rank) is written down as a sentencepiece BPE model: each token's
bytes are mapped to printable characters, its score is its negative rank, its id its rank, and
nothing is normalised. Texts are split by the vocabulary's pattern; every pre-token is encoded
by itself. A pre-token that is a token as a whole takes that id, as rank encoders do. Decoding
maps ids back to bytes.

Null text counts as empty: no ids, empty bytes. Rows, repeated ones included, are kept as they
are; other columns pass through untouched, so names can only clash with the added ones, which
replace columns of the same name.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batches
from .textbytes import Texts, chunks, from_arrow
from .units import Encoded, spaced_words


def _byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is visible, else the next from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


CHARACTERS = _byte_characters()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: bytes (wire type 2), float (5) or int (0)."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """ModelProto with pieces in order of rank, then the unknown piece."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(CHARACTERS[b] for b in token).encode()
        out.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks))  # BPE, size, id of unknown
    trainer += b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))  # no begin, end or padding
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class ByteBPE:
    """encode(text) -> ids and decode(ids) -> bytes for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        if sorted(self.ranks.values()) != list(range(len(self.ranks))):
            raise ValueError("ranks must run from 0 without a gap")
        self._processor = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.split = regex.compile(pattern).findall
        self._bytes = sorted(self.ranks, key=self.ranks.get)
        self._map = {b: c for b, c in enumerate(CHARACTERS)}

    def pieces(self, texts: list[str]) -> list[list[int]]:
        """Ids of each pre-token."""
        raw = [t.encode() for t in texts]
        found = [self.ranks.get(r) for r in raw]
        merged = [r.decode("latin-1").translate(self._map) for r, f in zip(raw, found, strict=True) if f is None]
        rest = iter(self._processor.encode(merged, num_threads=1))
        return [next(rest) if f is None else [f] for f in found]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.pieces(self.split(text)) for i in ids]

    def decode(self, ids) -> bytes:
        return b"".join([self._bytes[i] for i in ids])


class _Units(Encoded):
    """Also keeps each unit's ids in decimal, for the digest."""

    def __init__(self, bpe: ByteBPE):
        self._bpe = bpe
        super().__init__(self._encode_units)

    def _clear(self) -> None:
        super()._clear()
        self.decimal = np.empty(0, object)
        self.decoded = np.empty(0, object)

    def _encode_units(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        split = [self._bpe.split(p.decode()) for p in pieces]
        distinct = list({m for x in split for m in x})
        known = dict(zip(distinct, self._bpe.pieces(distinct), strict=True))
        flat: list[int] = []
        sizes = []
        for x in split:
            before = len(flat)
            for m in x:
                flat += known[m]
            sizes.append(len(flat) - before)
        return np.array(flat, np.uint32), np.array(sizes, np.int64)

    def _added(self, pieces: list[bytes], slots: np.ndarray) -> None:
        flat = self.flat[self.at[slots[0]] :].tolist()
        sizes = np.diff(self.at[slots[0] :]).tolist()
        decimal, decoded = np.empty(len(pieces), object), np.empty(len(pieces), object)
        k = 0
        for j, size in enumerate(sizes):
            ids = flat[k : k + size]
            decimal[j] = ",".join(map(str, ids)).encode()
            decoded[j] = self._bpe.decode(ids)
            k += size
        self.decimal = np.concatenate([self.decimal, decimal])
        self.decoded = np.concatenate([self.decoded, decoded])


@functools.cache
def _bpe(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


@functools.cache
def _units(path: str, pattern: str) -> _Units:
    return _Units(_bpe(path, pattern))


def _encoded(texts: Texts, units: _Units) -> Iterator[tuple[np.ndarray, bytes, bytes]]:
    """(ids, ids in decimal, decoded bytes) of each text."""
    for _, _, part in chunks(texts):
        starts, ends = spaced_words(part)
        slots = units.slots(part, starts, ends)
        ids, sizes = units.gather(slots)
        decimal, decoded = units.decimal[slots], units.decoded[slots]
        bounds = np.searchsorted(starts, part.at)
        at = np.concatenate([[0], np.cumsum(sizes)])
        for i in range(len(part)):
            a, b = bounds[i], bounds[i + 1]
            yield ids[at[a] : at[b]], b",".join(decimal[a:b]), b"".join(decoded[a:b])


def _replacing(df: DataFrame, fields: list[T.StructField]) -> tuple[list[str], T.StructType]:
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    return [f.name for f in kept], T.StructType(kept + fields)


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids`` (array<int>)."""
    kept, schema = _replacing(df, [T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def work(stream):
        units = _units(path, pattern)
        for batch in batches(stream):
            found = [x.astype(np.int32) for x, _, _ in _encoded(from_arrow(batch.column(text)), units)]
            yield _with(batch, kept, [(ids, pa.array(found, pa.list_(pa.field("element", pa.int32(), False))))])

    return df.mapInArrow(work, schema)


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out`` (binary), the bytes of the ids; null ids count as none."""
    kept, schema = _replacing(df, [T.StructField(out, T.BinaryType())])

    def work(stream):
        bpe = _bpe(path, pattern)
        for batch in batches(stream):
            found = [bpe.decode(x or ()) for x in batch.column(ids).to_pylist()]
            yield _with(batch, kept, [(out, pa.array(found, pa.binary()))])

    return df.mapInArrow(work, schema)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encodes each text, decodes the ids, and adds n_tokens, ids_sha256 and decoded_sha256."""
    string = T.StringType()
    kept, schema = _replacing(df, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", string), T.StructField("decoded_sha256", string)])
    kept = [k for k in kept if k != text]
    schema = T.StructType([f for f in schema.fields if f.name != text])

    def work(stream):
        units = _units(path, pattern)
        digest = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches(stream):
            sizes, coded, decoded = [], [], []
            for ids, decimal, raw in _encoded(from_arrow(batch.column(text)), units):
                sizes.append(len(ids))
                coded.append(digest(decimal))
                decoded.append(digest(raw))
            yield _with(batch, kept, [("n_tokens", pa.array(sizes, pa.int64())), ("ids_sha256", pa.array(coded, pa.string())), ("decoded_sha256", pa.array(decoded, pa.string()))])

    return df.mapInArrow(work, schema)


def _with(batch: pa.RecordBatch, kept: list[str], new: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + [a for _, a in new], names=kept + [n for n, _ in new])

"""Byte-level BPE through sentencepiece: a model serialised from a rank file, encoding and decoding.

The model is written straight from the vocabulary: one piece per rank, its bytes mapped to one character each, scored
by the negative rank, with identity normalisation; sentencepiece's BPE then merges the pair of the lowest rank first,
leftmost on ties, which is what rank files mean. Texts are parted by the pre-token pattern; each pre-token is encoded
alone. Decoding looks the bytes of each id up.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tamarack.llm.common import SAFE_CUT, UnitCache, segments

SEGMENT_CHARS = 1 << 20
OUT_BYTES = 4 << 20
UNITS_HELD = 150_000
# byte b is written as the character U+0100 + b: no blank, no control character, no meta symbol of sentencepiece
_MAPPED = {b: 0x100 + b for b in range(256)}
_encoders: dict[tuple[str, str], Encoder] = {}
_tokens: dict[str, list[bytes]] = {}


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file by rank; ranks must run from 0 without a gap."""
    by_rank = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                by_rank[int(rank)] = base64.b64decode(token)
    if sorted(by_rank) != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without a gap")
    return [by_rank[i] for i in range(len(by_rank))]


def _mapped(piece: bytes) -> str:
    return piece.decode("latin-1").translate(_MAPPED)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model (protocol buffer wire format) whose ids are the ranks; the last id is unknown."""
    def piece(text: str, score: float, kind: int | None = None) -> bytes:
        body = _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score)
        return _field(1, body + (_flag(3, kind) if kind else b""))

    pieces = [piece(_mapped(t), -float(rank)) for rank, t in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, 2))
    trainer = _flag(3, 2)  # model type: BPE
    # name; no dummy prefix, no removal or escaping of blanks
    normalizer = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encoder of one rank file and pre-token pattern, for one worker."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        tokens = read_ranks(path)
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        self.cache = UnitCache(self._encode_units, UNITS_HELD)

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit as little-endian 32-bit integers. A pre-token that is in the vocabulary is its own id."""
        split = [[p.encode() for p in self.pattern.findall(u)] for u in units]
        rest = list({p for parts in split for p in parts if p not in self.ids})
        found = dict(zip(rest, self.model.encode([_mapped(p) for p in rest], num_threads=1), strict=True)) if rest else {}
        packed = []
        for parts in split:
            ids = array("I")
            for p in parts:
                if p in self.ids:
                    ids.append(self.ids[p])
                else:
                    ids.extend(found[p])
            packed.append(ids.tobytes())
        return packed

    def encode(self, text: str) -> bytes:
        out = [b"".join(self.cache.values_of(SAFE_CUT.split(s))) for s in segments(text, SEGMENT_CHARS)] if text else []
        return b"".join(out)


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def decode(ids: bytes, path: str) -> bytes:
    """The bytes of packed ids, joined."""
    if path not in _tokens:
        _tokens[path] = read_ranks(path)
    return b"".join(map(_tokens[path].__getitem__, array("I", ids)))


def _by_bytes(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``OUT_BYTES`` of the last column."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"")
        if size >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of each row of ``docs`` (doc_id, text).

    Null and empty text has no ids. One row per input row, repeated or not; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = own.encode(text.as_py() or "")
                    yield doc_id, len(ids) // 4, ids

        yield from _by_bytes(rows(), schema)

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` (doc_id, n_tokens, ids) with ``decoded``: the bytes of the ids, joined. Null ids give null."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc_id, n, ids in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
                    ids = ids.as_py()
                    yield doc_id, n, ids, None if ids is None else decode(ids, path)

        yield from _by_bytes(rows(), schema)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        decoded, "doc_id long, n_tokens long, ids binary, decoded binary")

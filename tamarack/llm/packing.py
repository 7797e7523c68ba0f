"""Vector bin packing of token pieces into training sequences.

Documents become pieces of at most ``max_tokens`` ids. Pieces are dealt out evenly to partitions of bounded size, and each
partition packs its own: a sequence is filled with the piece whose demands (tokens, segments, loss-bearing
tokens) have the largest dot product with what the sequence has left, until no piece fits under all limits.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm.common import UnitCache

BATCH_CHARS = 1 << 20
# Sets words apart in one call of the tokenizer.
MARK = "|"
WORDS_A_CALL = 100
# What the normaliser below changes in Latin letters up to U+024F is their case alone: all are composed already.
LATIN = re.compile("[\x00-\u024f]*")
CASE_FOLDING = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
OUT_BYTES = 8 << 20
# Pieces that one task packs together: the open sequence at its end is all the padding that the parting costs.
PIECES_A_TASK = 8192
_encoders: dict[str, UnitCache] = {}


@dataclass(frozen=True)
class Limits:
    """Of one sequence; ``segments`` bounds the attention blocks, ``loss_tokens`` the tokens that bear loss.

    The last one binds where a sequence has less than ``tokens - loss_tokens`` segments, whose first tokens bear none.
    """

    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4084

    @property
    def longest_piece(self) -> int:
        """Tokens of a piece that fits a sequence, if all but the first bear loss."""
        return min(self.tokens, self.loss_tokens + 1)


class _Words(UnitCache):
    """A cache that is asked once per word, repeated or not: most words of a batch are held."""

    def values_of(self, units: list) -> list:
        values = list(map(self.get, units))
        if None not in values:
            return values
        gaps = [i for i, v in enumerate(values) if v is None]
        missing = list({units[i]: None for i in gaps})
        older = self.older
        new = {u: older[u] for u in missing if u in older}
        rest = [u for u in missing if u not in new] if new else missing
        if rest:
            new.update(zip(rest, self.encode(rest), strict=True))
        if len(self) + len(new) > self.limit:
            self.older = dict(self)
            self.clear()
        longest = self.longest
        self.update(new if max(map(len, new)) <= longest else {u: v for u, v in new.items() if len(u) <= longest})
        for i in gaps:
            values[i] = new[units[i]]
        return values


def _word_encoder(path: str):
    """A function from words to their packed ids. Words go to the library many at a time, with a mark between them.

    The mark stands alone between blanks, so it is a pre-token of its own and has one id; words that hold it, and words
    that may hold a special token, are encoded apart. Words of Latin letters are lower-cased here, and skip the
    tokenizer's normaliser, which would take about as long as the encoding.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    folds = content["normalizer"] == CASE_FOLDING
    plain = Tokenizer.from_str(json.dumps(content | {"normalizer": None})) if folds else tokenizer
    for t in (tokenizer, plain):
        t.no_truncation()
        t.no_padding()
    mark = tokenizer.encode(MARK, add_special_tokens=False).ids

    def apart(words: list[bytes]) -> list[bytes]:
        batch = tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in batch]

    def joined(words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        if folds and all(map(LATIN.fullmatch, texts)):
            return together(plain, words, [t.lower() for t in texts])
        if folds:
            latin = {w: t.lower() for w, t in zip(words, texts, strict=True) if LATIN.fullmatch(t)}
            held = dict(zip(latin, together(plain, list(latin), list(latin.values())), strict=True))
            rest = {w: t for w, t in zip(words, texts, strict=True) if w not in held}
            held.update(zip(rest, together(tokenizer, list(rest), list(rest.values())), strict=True))
            return [held[w] for w in words]
        return together(tokenizer, words, texts)

    def together(by: Tokenizer, words: list[bytes], written: list[str]) -> list[bytes]:
        found: list[bytes] = []
        parts = [words[i:i + WORDS_A_CALL] for i in range(0, len(words), WORDS_A_CALL)]
        texts = [f" {MARK} ".join(written[i:i + WORDS_A_CALL]) for i in range(0, len(words), WORDS_A_CALL)]
        for part, e in zip(parts, by.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == mark[0])
            if len(cuts) != len(part) - 1:
                found.extend(apart(part))
                continue
            raw = ids.tobytes()
            starts = [0, *(4 * (cuts + 1)).tolist()]
            ends = [*(4 * cuts).tolist(), len(raw)]
            found.extend([raw[s:t] for s, t in zip(starts, ends, strict=True)])
        return found

    def encode(words: list[bytes]) -> list[bytes]:
        sign = MARK.encode()
        alone = [w for w in words if sign in w] if len(mark) == 1 else words
        if not alone:
            return joined(words)
        held = dict(zip(alone, apart(alone), strict=True))
        rest = [w for w in words if w not in held]
        held.update(zip(rest, joined(rest), strict=True))
        return [held[w] for w in words]

    return encode


def _encoder(path: str) -> UnitCache:
    """The worker's cache of the ids (packed 32-bit integers) of words for a tokenizer file that drops white space and case."""
    if path not in _encoders:
        _encoders[path] = _Words(_word_encoder(path))
    return _encoders[path]


def encode_words(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of texts by a tokenizer that drops white space and case: words between ASCII blanks are encoded once each."""
    words: list[bytes] = []
    ends = []
    for text in texts:
        raw = text.encode() if text else b""
        # special tokens, whose case counts, hold the mark
        words += (raw if MARK.encode() in raw else raw.lower()).split()
        ends.append(len(words))
    values = _encoder(path).values_of(words)
    return [b"".join(values[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def encode_pieces(docs: DataFrame, path: str, end_id: int, max_tokens: int = Limits().longest_piece, checksums: bool = False) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids of the documents (doc_id, text): doc_id, start, length, doc_tokens, ids.

    With ``checksums``, ids_crc32 (unsigned) stands in place of the ids, which then never leave the worker.

    A document's ids are those of its text by the tokenizer file at ``path``, then ``end_id``; ``doc_tokens`` counts them
    all, ``start`` those before the piece; ``ids`` are little-endian unsigned 32-bit integers. All pieces but the last
    have ``max_tokens`` ids. Null and empty text has the end id alone. One document per row, repeated or not.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids_crc32", pa.int64()) if checksums else ("ids", pa.binary())])
    end = array("I", [end_id]).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        def encoded() -> Iterator[tuple]:
            doc_ids: list = []
            texts: list = []
            held = 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    text = text.as_py()
                    doc_ids.append(doc_id)
                    texts.append(text)
                    held += len(text or "")
                    if held >= BATCH_CHARS:
                        yield from zip(doc_ids, encode_words(texts, path), strict=True)
                        doc_ids, texts, held = [], [], 0
            yield from zip(doc_ids, encode_words(texts, path), strict=True)

        for doc_id, ids in encoded():
            ids += end
            n = len(ids) // 4
            for start in range(0, n, max_tokens):
                piece = ids[4 * start:4 * (start + max_tokens)]
                rows.append((doc_id, start, len(piece) // 4, n, zlib.crc32(piece) if checksums else piece))
                size += 64 if checksums else len(piece)
            if size >= OUT_BYTES:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(
        encode, f"doc_id long, start long, length long, doc_tokens long, {'ids_crc32 long' if checksums else 'ids binary'}")


def dot_product_packing(demands: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset (in the first dimension) of each item; ``demands`` is items by dimensions.

    Items must fit alone. Equal demands are taken in the order given. The work is sequences times distinct demands.
    """
    kinds, kind_of = np.unique(demands, axis=0, return_inverse=True)
    kind_of = kind_of.reshape(-1)
    if (kinds > limits).any():
        raise ValueError("an item exceeds the limits of a sequence")
    order = np.argsort(kind_of, kind="stable")
    left = np.bincount(kind_of, minlength=len(kinds))
    next_of = np.concatenate([[0], np.cumsum(left)[:-1]])
    # kinds are sorted by the first dimension, so those that fit in it come first; spent ones score minus infinity
    columns, shares = [kinds[:, d] for d in range(kinds.shape[1])], [kinds[:, d] / limits[d] for d in range(kinds.shape[1])]
    largest = kinds.max(axis=0) if len(kinds) else limits
    spent = np.zeros(len(kinds))
    sequence = np.empty(len(demands), np.int64)
    offset = np.empty(len(demands), np.int64)
    placed = number = 0
    while placed < len(demands):
        room = limits.astype(np.int64).copy()
        at = 0
        while True:
            n = int(np.searchsorted(columns[0], room[0], side="right"))
            if not n:
                break
            score = shares[0][:n] * (room[0] / limits[0]) + spent[:n]
            for d in range(1, len(columns)):
                score += shares[d][:n] * (room[d] / limits[d])
                if room[d] < largest[d]:
                    score[columns[d][:n] > room[d]] = -np.inf
            best = int(score.argmax())
            if score[best] == -np.inf:
                break
            item = order[next_of[best]]
            sequence[item], offset[item] = number, at
            next_of[best] += 1
            left[best] -= 1
            at += int(kinds[best][0])
            room -= kinds[best]
            placed += 1
            if not left[best]:
                spent[best] = -np.inf
        number += 1
    return sequence, offset


def pack(pieces: DataFrame, limits: Limits | None = None, loss: str | None = None) -> DataFrame:
    """``pieces`` (at least ``length``) with sequence_id and offset.

    ``loss`` names the column of loss-bearing tokens; by default all tokens of a piece but its first bear loss, since
    nothing precedes that in its segment. Within a sequence offsets run from 0 without a gap. Pieces are dealt out
    evenly (not by key, so repeated rows do no harm) to tasks of about ``PIECES_A_TASK``. Null lengths count as 0.
    ``pieces`` should be a written table: it is counted first. An empty table gives an empty result.
    """
    limits = limits or Limits()
    bounds = np.array([limits.tokens, limits.segments, limits.loss_tokens])
    tasks = max(1, -(-pieces.count() // PIECES_A_TASK))
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    schema = T.StructType([pieces.schema[c] for c in columns] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    where = columns.index("length"), columns.index(loss) if loss else None

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        numbers = [None if i is None else rows.column(i).cast(pa.int64()).fill_null(0).to_numpy() for i in where]
        length = numbers[0]
        bearing = np.maximum(length - 1, 0) if loss is None else numbers[1]
        sequence, offset = dot_product_packing(np.stack([length, np.ones_like(length), bearing], axis=1), bounds)
        sequence += np.int64(TaskContext.get().partitionId()) << 32
        rows = rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from rows.to_batches(max_chunksize=10_000)

    return pieces.select(*[F.col(f"`{c}`") for c in columns]).repartition(tasks).mapInArrow(packed, schema)

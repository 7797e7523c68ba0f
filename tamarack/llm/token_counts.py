"""Token counts of texts by a ``tokenizers`` file: lengths only, in Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import SAFE_CUT, UnitCache, byte_batches, segments

# Characters of text per call of the tokenizer, and of a long text per segment.
BATCH_CHARS = 1 << 20
_counters: dict[str, UnitCache] = {}


def _counter(path: str) -> UnitCache:
    """The worker's cache of unit lengths for a tokenizer file."""
    if path not in _counters:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def lengths(units: list[str]) -> list[int]:
            found: list[int] = []
            for batch in byte_batches(units, BATCH_CHARS):
                found.extend(map(len, tokenizer.encode_batch_fast(batch, add_special_tokens=False)))
            return found

        _counters[path] = UnitCache(lengths)
    return _counters[path]


def token_lengths(texts: Iterable[str | None], path: str) -> Iterator[int]:
    """The number of tokens of each text (0 for null).

    Texts are taken together until they hold ``BATCH_CHARS`` characters; long ones are cut into segments at safe
    boundaries, where no token can span. Within a batch each distinct unit (a word with the blank before it) is
    encoded once, by the library.
    """
    cache = _counter(path)
    owners: list[int] = []
    units: list[str] = []
    totals: dict[int, int] = {}
    held = 0

    def flush() -> None:
        for owner, n in zip(owners, cache.values_of(units), strict=True):
            totals[owner] += n
        owners.clear()
        units.clear()

    done = 0
    for i, text in enumerate(texts):
        totals[i] = 0
        for segment in segments(text, BATCH_CHARS) if text else ():
            parts = SAFE_CUT.split(segment)
            units.extend(parts)
            owners.extend([i] * len(parts))
            held += len(segment)
            if held >= BATCH_CHARS:
                flush()
                held = 0
                # the text in hand may have more segments: its total is not final
                while done < i:
                    yield totals.pop(done)
                    done += 1
    flush()
    while done in totals:
        yield totals.pop(done)
        done += 1


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens above ``limit``) of each row of ``docs`` (doc_id, text).

    Tokens are those of the file at ``path`` without begin, end or other added tokens; strings of special tokens
    inside a text are handled as the library does by default. Null text counts as empty. One row per input row,
    repeated or not; other columns are not read; an empty table gives an empty result.
    """
    narrow = docs.select("doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_bytes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(token_lengths(texts, path), pa.int64())], schema=schema)

    counted = narrow.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

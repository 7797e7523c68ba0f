"""Filter interaction audit: what each filter removes in every order, from one walk over the subsets of filters.

A document's failures make a mask. Counts per part and mask (at most 32 cells for five filters) are all that the orders
need. The subsets of active filters are walked in Gray-code order: each step toggles one filter, which raises or lowers
the counter of active failures of the cells that fail it; a cell whose counter leaves or reaches zero leaves or joins the
survivors. The survivors of the 32 subsets are stored; a step of an order is a difference of two of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import key128, materialise

UPPER = bytes(range(ord("A"), ord("Z") + 1))
# The bytes of UTF-8 that begin no character.
FOLLOWING = bytes(range(0x80, 0xC0))
FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@dataclass(frozen=True)
class TextFilters:
    """A fails under ``least_words`` words, B below ``distinct_percent`` of distinct words, C above ``upper_percent`` of
    ``[A-Z]`` characters, D on any of ``symbols``, E on a text that a smaller doc_id has."""

    least_words: int = 100
    distinct_percent: int = 80
    upper_percent: int = 10
    symbols: bytes = b"#$%&*|"

    def mask(self, text: bytes) -> int:
        """Bits 0 to 3: the failures A to D of a UTF-8 text."""
        words = text.split()
        n = len(words)
        characters = len(text) - _count(text, FOLLOWING)
        return ((n < self.least_words) | (100 * len(set(words)) < self.distinct_percent * n) << 1
                | (100 * _count(text, UPPER) > self.upper_percent * characters) << 2 | (_count(text, self.symbols) > 0) << 3)


def _count(text: bytes, wanted: bytes) -> int:
    return len(text) - len(text.translate(None, wanted))


def failures(docs: DataFrame, filters: TextFilters) -> DataFrame:
    """doc_id, part, h1, h2 (hash of the text) and mask (A to D) of each row of ``docs`` (doc_id, text, lang)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = pa.array([filters.mask(t.as_py()) for t in batch.column(4)], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], masks], ["doc_id", "part", "h1", "h2", "mask"])

    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2 = key128(text)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        h1.alias("h1"), h2.alias("h2"), text.cast("binary").alias("t"),
    ).mapInArrow(judge, "doc_id long, part string, h1 long, h2 long, mask int")


def cells(docs: DataFrame, labels: DataFrame, filters: TextFilters | None = None) -> DataFrame:
    """part, mask (bits 0 to 4: A to E), n, good and toxic: documents per part and set of failures.

    good and toxic count those whose labels say quality = 1 or toxic = 1. A null text is empty, a null lang the empty
    part. A row without doc_id has no smaller document, so it does not fail E, and no label; a doc_id labelled
    twice is good or toxic if any of its labels is.
    """
    judged = materialise(failures(docs, filters or TextFilters()), "failures")
    # joined on the whole row identity: a text that many documents share is one key per document
    first = judged.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).filter(F.col("doc_id").isNotNull()).withColumn("first", F.lit(True))
    marked = judged.join(first.hint("merge"), ["doc_id", "h1", "h2"], "left")
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    per_id = marked.groupBy("doc_id", "part", F.col("mask").bitwiseOR(F.when(later, 16).otherwise(0)).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t")).groupBy("doc_id").agg(
        F.coalesce(F.bool_or("g"), F.lit(False)).alias("g"), F.coalesce(F.bool_or("t"), F.lit(False)).alias("t"))
    joined = per_id.join(known.hint("merge"), "doc_id", "left")
    return joined.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("g"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("t"), F.col("n")).otherwise(0)).alias("toxic"))


def gray_survivors(masks: np.ndarray, counts: np.ndarray, n_filters: int) -> np.ndarray:
    """Survivors of each subset of active filters (rows) in each count (columns); cell i fails the bits of ``masks[i]``."""
    survivors = np.zeros((1 << n_filters, counts.shape[1]), np.int64)
    active_failures = np.zeros(len(masks), np.int64)
    running = counts.sum(axis=0)
    survivors[0] = running
    active = 0
    for step in range(1, 1 << n_filters):
        toggled = (step & -step).bit_length() - 1  # the bit in which this Gray code differs from the last
        fails = (masks >> toggled) & 1 == 1
        active ^= 1 << toggled
        if active >> toggled & 1:
            running = running - counts[fails & (active_failures == 0)].sum(axis=0)
            active_failures[fails] += 1
        else:
            active_failures[fails] -= 1
            running = running + counts[fails & (active_failures == 0)].sum(axis=0)
        survivors[active] = running
    return survivors


def steps(masks: np.ndarray, counts: np.ndarray, names: str) -> Iterator[tuple]:
    """filter_order, step and COUNTS of each step of each order of the filters; the columns of ``counts`` are all, good, toxic."""
    n = len(names)
    survivors = gray_survivors(masks, counts, n)
    failing = [counts[(masks >> f) & 1 == 1, 0].sum() for f in range(n)]
    unique = [counts[masks == 1 << f, 0].sum() for f in range(n)]
    # an order puts f after exactly the subset s in |s|! (n - 1 - |s|)! ways
    shapley = [sum(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * int(survivors[s, 0] - survivors[s | 1 << f, 0])
                   for s in range(1 << n) if not s >> f & 1) for f in range(n)]
    for order in permutations(range(n)):
        active = 0
        for step, f in enumerate(order, 1):
            lost = survivors[active] - survivors[active | 1 << f]
            active |= 1 << f
            yield ("".join(names[x] for x in order), step, survivors[active, 0], lost[0], failing[f] - lost[0], unique[f], lost[1], lost[2], shapley[f])


def audit(counted: DataFrame, names: str = FILTERS) -> DataFrame:
    """part, filter_order, step and counts of every step of every order, from ``cells`` (one row per part at a time)."""
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in COUNTS]])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                masks = np.array([c["mask"] for c in found], np.int64)
                counts = np.array([[c["n"], c["good"], c["toxic"]] for c in found], np.int64)
                rows = [(part, *s) for s in steps(masks, counts, names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # a part has one cell per mask, 32 at most
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    columns = ", ".join(f"{c} long" for c in COUNTS)
    return parts.mapInArrow(walk, f"part string, filter_order string, step int, {columns}")


def filter_audit(docs: DataFrame, labels: DataFrame, filters: TextFilters | None = None) -> DataFrame:
    """One row per part, order of the five filters and step; no rows for an empty table. See ``cells`` for odd rows."""
    return audit(cells(docs, labels, filters))

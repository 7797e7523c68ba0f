"""Sets of word shingles, classes of documents with equal sets, and components of links: shared by the operators on pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import key128, materialise

WORDS_HELD = 200_000
OUT_TOKENS = 500_000


class _WordHashes(dict):
    """64-bit hashes of words; starts anew when it holds ``WORDS_HELD`` words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_HELD:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_words = _WordHashes()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the n-word shingles of a text; of all its words, if they are fewer.

    Words are runs of anything but ASCII blanks, with A-Z lower-cased. No words: an empty set.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        # a different odd factor for each position
        total = mix(total) + hashes[i:len(words) - width + 1 + i] * np.uint64(2 * i + 0x9E3779B97F4A7C15)
    return np.unique(mix(total))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 128-bit hash (h1, h2) of the text: the identity of a row, whatever ids repeat."""
    h1, h2 = key128(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h1.alias("h1"), h2.alias("h2"))


def classes_of(signed: DataFrame, name: str) -> DataFrame:
    """node (an id of its own), digest and the representative row (rep_id, rep_h1, rep_h2) of each class of equal sets."""
    part = signed.filter(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    least = part.groupBy("digest").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("rep"))
    return materialise(least.select(
        F.monotonically_increasing_id().alias("node"), "digest", F.col("rep.doc_id").alias("rep_id"),
        F.col("rep.h1").alias("rep_h1"), F.col("rep.h2").alias("rep_h2")), name)


def is_rep() -> Column:
    return (F.col("doc_id") == F.col("rep_id")) & (F.col("h1") == F.col("rep_h1")) & (F.col("h2") == F.col("rep_h2"))


def class_texts(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """node and text of the representative rows of the ``chosen`` classes, one row each."""
    pairs = rows.join(chosen.hint("merge"), is_rep())
    return pairs.groupBy("rep_id", "rep_h1", "rep_h2", "node").agg(F.first("text").alias("text")).select("node", "text")


def shingles(texts: DataFrame, words: int) -> DataFrame:
    """node, n (all its n-grams) and token of each distinct n-gram of ``texts`` (node, text)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(nodes, sets):
            sizes = [len(s) for s in sets]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(nodes, np.int64), sizes)), pa.array(np.repeat(np.array(sizes, np.int64), sizes)),
                 pa.array(np.concatenate(sets).view(np.int64))], ["node", "n", "token"])

        for batch in batches:
            nodes, sets, held = [], [], 0
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                nodes.append(node)
                sets.append(shingle_set(text.as_py(), words))
                held += len(sets[-1])
                if held >= OUT_TOKENS:
                    yield out(nodes, sets)
                    nodes, sets, held = [], [], 0
            if held:
                yield out(nodes, sets)

    return texts.select("node", "text").mapInArrow(explode, "node long, n long, token long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component (smallest node reachable) of all nodes that have a link in ``links`` (a, b).

    Alternates large and small stars: every node links its larger neighbours, then its smaller ones, to its smallest
    neighbour, until the links are stars: each node has one link, and no centre is linked itself. Each round is
    written to the shared folder.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(
            down.select("u", F.col("m").alias("v"))).distinct()
        links = materialise(small, name)
        # per node: its links upwards, and whether it is a centre
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1")
        if odd.isEmpty():
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def with_components(signed: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n, component_id of each row of ``signed``: the smallest doc_id of the classes in its component."""
    placed = classes.join(found.hint("merge"), "node", "left").select("digest", "rep_id", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    named = placed.join(least.hint("merge"), "component").select(F.col("digest").alias("_digest"), "component_id")
    whole = signed.join(named.hint("merge"), F.col("digest") == F.col("_digest"), "left")
    return whole.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))

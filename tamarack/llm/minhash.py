"""Near-duplicate documents: one-permutation MinHash, optimal densification, banded buckets, star-shaped candidates.

One hash per shingle both picks a bin and competes in it, so a signature costs one pass. An empty bin takes the value of
a random non-empty bin, by a fixed random order of bins per bin (optimal densification). Bands of the signature
make buckets; a bucket of m documents gives m - 1 candidate pairs with its centre, never all pairs. Pairs are
confirmed on the full shingle sets. The documents of buckets that still hold several components are settled exactly, on
their sets, in prefix trees (:func:`tamarack.llm.ngram_join.joined_links`): no pair is formed but the links found there.

Documents of equal sets form a class with an id of its own; only one of its documents goes through the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import materialise, release
from tamarack.llm.ngram_join import NgramJoin, joined_links
from tamarack.llm.sets import class_texts, classes_of, components, is_rep, keyed, mix, shingle_set, with_components


@dataclass(frozen=True)
class MinHash:
    """``bands`` of ``band_rows`` bins: at similarity 0.8 a pair shares no bucket with chance (1 - 0.8**4)**24 < 4e-6."""

    shingle_words: int = 5
    percent: int = 80
    bands: int = 24
    band_rows: int = 4

    @property
    def bins(self) -> int:
        return self.bands * self.band_rows


class _Signer:
    def __init__(self, method: MinHash):
        k = method.bins
        rng = np.random.default_rng(20_240)
        self.method = method
        # the first bin of row i is i itself, then all bins in a random order
        self.order = np.concatenate([np.arange(k)[:, None], np.stack([rng.permutation(k) for _ in range(k)])], axis=1)
        # bin i holds the hashes from edge i up to edge i + 1
        self.edges = (np.arange(1, k, dtype=object) * 2**64 // k).astype(np.uint64)
        self.factors = rng.integers(1, 2**63, (method.band_rows,), np.uint64) | np.uint64(1)

    def bands(self, members: np.ndarray) -> np.ndarray:
        """Band hashes of a non-empty sorted set."""
        starts = np.concatenate([[0], np.searchsorted(members, self.edges)])
        filled = np.diff(np.append(starts, len(members))) > 0
        source = self.order[np.arange(len(starts)), filled[self.order].argmax(axis=1)]
        signature = members[starts[source]].reshape(self.method.bands, self.method.band_rows)
        return mix((mix(signature) * self.factors).sum(axis=1, dtype=np.uint64)).view(np.int64)


def signatures(rows: DataFrame, method: MinHash) -> DataFrame:
    """doc_id, h1, h2, n, digest (16 bytes of the whole set; null for an empty set) and bands of each row of ``keyed``."""
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()),
                        ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        signer = _Signer(method)
        for batch in batches:
            n, digest, bands = [], [], []
            for text in batch.column(1):
                members = shingle_set(text.as_py(), method.shingle_words)
                n.append(len(members))
                digest.append(xxhash.xxh128_digest(members.tobytes()) if len(members) else None)
                bands.append(signer.bands(members) if len(members) else None)
            columns = [batch.column(0), batch.column(2), batch.column(3), n, digest, bands]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(sign, "doc_id long, h1 long, h2 long, n long, digest binary, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, method: MinHash) -> DataFrame:
    """The pairs (a, b) whose shingle sets meet the threshold; ``texts`` has node and text."""
    percent, n = method.percent, method.shingle_words

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, other = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for i, (left, right) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                right = right.as_py()
                if right != held:  # rows come sorted by b: its set is made once
                    held, other = right, shingle_set(right, n)
                own = shingle_set(left.as_py(), n)
                common = len(np.intersect1d(own, other, assume_unique=True))
                if common and 100 * common >= percent * (len(own) + len(other) - common):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("_ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("_tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "_ta", "_tb").mapInArrow(check, "a long, b long").distinct()


def _star_pairs(members: DataFrame, method: MinHash) -> DataFrame:
    """Pairs of each bucket's members with its centre, the smallest, if their sizes allow a link."""
    centres = members.groupBy("band", "bucket").agg(F.min(F.struct("node", "n")).alias("c"))
    joined = members.join(centres, ["band", "bucket"]).filter(
        (F.col("node") != F.col("c.node"))
        & (100 * F.least(F.col("n"), F.col("c.n")) >= method.percent * F.greatest(F.col("n"), F.col("c.n"))))
    return joined.select(F.col("node").alias("a"), F.col("c.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, method: MinHash | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text).

    Documents are linked if the Jaccard similarity of their shingle sets is at least ``method.percent`` / 100;
    component_id is the smallest doc_id reachable, kept tells that it is the row's own. A document without words links
    with nothing. Rows that share a doc_id are judged each by its own text. Rows without doc_id take no part: component_id
    is null and they are kept. Other columns are not read; an empty table gives an empty result.
    """
    method = method or MinHash()
    spark = docs.sparkSession
    rows = keyed(docs)
    signed = materialise(signatures(rows, method), "signatures")
    narrow = signed.drop("bands")
    classes = classes_of(narrow, "classes")
    # these ids grow with the corpus: joined by merging at every size; a repeated row gives its bands again
    reps = signed.join(classes.drop("digest").hint("merge"), is_rep()).select("node", "n", F.posexplode("bands").alias("band", "bucket")).distinct()
    banded = materialise(reps, "bands")
    shared = banded.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").select("band", "bucket")
    members = materialise(banded.join(shared, ["band", "bucket"]), "bucket-members")
    candidates = classes.drop("digest").join(members.select("node").distinct().hint("merge"), "node", "left_semi")
    texts = materialise(class_texts(rows, candidates), "texts")
    release(spark)

    tested = materialise(_star_pairs(members, method), "pairs")
    links = materialise(confirmed(tested, texts, method), "links")
    found = components(links)
    release(spark)
    placed = members.join(found.hint("merge"), "node", "left").select("band", "bucket", "node", F.coalesce("component", "node").alias("at"))
    # two members have met as centre and member; larger buckets may hold links that no centre shows
    mixed = placed.groupBy("band", "bucket").agg(F.min("at").alias("_x"), F.max("at").alias("_y"), F.count(F.lit(1)).alias("size")).filter(
        "_x < _y AND size > 2").select("band", "bucket")
    left = materialise(placed.join(mixed.hint("merge"), ["band", "bucket"]).select("node", "at").distinct(), "mixed-nodes")
    if not left.isEmpty():
        release(spark)
        exact = NgramJoin(words=method.shingle_words, percent=method.percent)
        new = joined_links(texts.join(left.select("node").hint("merge"), "node", "left_semi"), left, exact)
        if not new.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new))
    release(spark)
    return with_components(narrow, classes, found).select("doc_id", F.col("n").alias("n_shingles"), "component_id").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

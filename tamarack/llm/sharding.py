"""Weighted rendezvous sharding of record keys, and gapless slots inside each shard. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_BUCKETS = 1024


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) whose score for this key is highest.

    The score of shard ``i`` is ``ln(u) / weight`` with ``u`` uniform in (0, 1) from a hash of the key and ``i``, so a
    shard gets a share of the keys in proportion to its weight. Scores of other shards do not depend on a shard that
    is added or taken away: a new last shard takes keys only into itself. A null key hashes like a key of its own.
    Ties go to the smaller shard. A shard of weight 0 gets nothing.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be at least 0, and one of them above 0")
    base = F.xxhash64(key)
    scores = []
    for i, w in enumerate(weights):
        if w > 0:
            # the upper 53 bits as a number strictly between 0 and 1
            u = (F.shiftrightunsigned(F.xxhash64(base, F.lit(i)), 11) + F.lit(0.5)) / F.lit(float(2**53))
            scores.append(F.struct((F.ln(u) / F.lit(float(w))).alias("score"), F.lit(-i).alias("i")))
    if len(scores) == 1:
        return F.lit(next(i for i, w in enumerate(weights) if w > 0))
    return (-F.greatest(*scores)["i"]).cast("int")


def number_slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot",
                 buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Number the rows of each shard from 0 without a gap.

    Rows are dealt to (shard, bucket) by a hash of ``order`` and numbered there; each bucket starts where the counts
    of the buckets before it end. The table of counts has at most ``shards * buckets`` rows, so it is broadcast, and
    no task holds a whole shard. ``order`` should identify a row: rows that are equal in it share a bucket.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("_shard").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(F.col(shard).alias("_shard"), F.col("_bucket").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
        .select("_shard", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy(shard, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_rank", F.row_number().over(within))
    joined = numbered.join(F.broadcast(starts), (F.col(shard) == F.col("_shard")) & (F.col("_bucket") == F.col("_at")))
    return joined.withColumn(slot, (F.col("_start") + F.col("_rank") - 1).cast("long")).drop(
        "_bucket", "_rank", "_shard", "_at", "_start")


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """Place documents (``doc_id``, ``text``) on shards by rendezvous hashing of ``doc_id``.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law (``key``), shard, slot, and grown_shard: the shard after
    the weights became ``grown`` (one more shard like the last by default). Null text counts as no bytes, a null
    doc_id as one key of its own. Rows with equal doc_id go to the same shard and get slots of their own. An empty
    table gives an empty result; other columns are not read.
    """
    grown = list(weights) + [weights[-1]] if grown is None else list(grown)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), rendezvous_shard(F.col("doc_id"), weights).alias("shard"),
        rendezvous_shard(F.col("doc_id"), grown).alias("grown_shard"),
    )
    placed = number_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

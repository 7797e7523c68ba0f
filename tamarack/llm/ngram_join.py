"""N-gram Jaccard join: ordered n-gram sets in prefix trees, walked with shared overlaps and cut by the lengths that remain.

Documents of equal sets form a class. A class can have a partner only if enough of its first n-grams, by hash, stand
among the first ones of another class: counting those, not whole sets, leaves the classes that may link (``alike``).
Their n-grams are then ordered by the number of classes that hold them. Of two linked sets the rarer ends (the
prefixes) meet, so that classes joined by common prefix n-grams make up families that can be settled apart. A family goes
to tasks in blocks of bounded size; the sets of a block make a prefix tree (:mod:`tamarack.llm.prefix_tree`) that each of
them walks. Blocks of one large family then meet two by two, by component: blocks inside one component have nothing left to find.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import materialise, release
from tamarack.llm.prefix_tree import tree_links
from tamarack.llm.sets import class_texts, classes_of, components, is_rep, keyed, shingle_set, shingles, with_components

@dataclass(frozen=True)
class NgramJoin:
    """Sets of ``words``-word n-grams are linked at a Jaccard similarity of ``percent`` / 100.

    ``sample_percent`` is the part of a set that the first filter asks for beyond the prefix; ``block_tokens`` the
    n-grams of a block. Both divide the work; the links do not depend on them.
    """

    words: int = 4
    percent: int = 85
    sample_percent: int = 8
    block_tokens: int = 1_500_000

    def least_common(self, n):
        """Of a set of n, the n-grams that a linked set has in common with it at least."""
        return -(-n * self.percent // 100)

    def sample(self, n):
        """The n-grams of the first filter beyond the prefix; monotone in n."""
        return max(1, n * self.sample_percent // 100)


def heads(rows: DataFrame, method: NgramJoin) -> DataFrame:
    """doc_id, h1, h2, n, digest (null for an empty set), asked (n-grams of the head that must be shared) and head."""
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()),
                        ("asked", pa.int32()), ("head", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            n, digest, asked, head = [], [], [], []
            for text in batch.column(1):
                members = shingle_set(text.as_py(), method.words)
                size = len(members)
                common = method.least_common(size)
                n.append(size)
                digest.append(xxhash.xxh128_digest(members.tobytes()) if size else None)
                # the smallest set that can link asks for the smallest sample; both sets hold it in their heads
                asked.append(method.sample(common) if size else 0)
                head.append(members[:size - common + method.sample(size)].view(np.int64))
            columns = [batch.column(0), batch.column(2), batch.column(3), n, digest, asked, head]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(sign, "doc_id long, h1 long, h2 long, n long, digest binary, asked int, head array<long>")


def alike(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes (rows of ``classes``) of which enough of the head stands in the head of another class: all that can link.

    Sets of n and m at the threshold have at least ``least_common`` n-grams in common, so the head of each, the
    prefix and l more, holds the first l of them (in the order of the hashes).
    """
    # every join on ids of the corpus merges, at every size
    reps = signed.join(classes.drop("digest").hint("merge"), is_rep())
    tokens = reps.select("node", F.explode("head").alias("token"))
    # a row that stands twice in the table shares its n-grams with itself: its class passes the filter the easier
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token")
    hits = tokens.join(shared.hint("merge"), "token").groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    enough = hits.join(reps.select("node", "asked").hint("merge"), "node").filter("c >= asked")
    return materialise(classes.join(enough.select("node").hint("merge"), "node", "left_semi"), "alike")


def _trees(method: NgramJoin):
    """Links within each group of rows: node, n, at, tokens, side (null, or which of two blocks a row belongs to)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table["tokens"].combine_chunks()
        offsets = lists.offsets.to_numpy()
        tokens = lists.values.to_numpy()[offsets[0]:offsets[-1]]
        side = table["side"].to_numpy(zero_copy_only=False)
        asks = None
        if table["side"].null_count == 0:
            asks = side == (1 if (side == 1).sum() <= (side == 0).sum() else 0)
        links = tree_links(table["node"].to_numpy(), table["n"].to_numpy(), tokens, offsets - offsets[0], table["at"].to_numpy(), asks, method.percent)
        a, b = [x for x, _ in links], [y for _, y in links]
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def joined_links(texts: DataFrame, placed: DataFrame | None, method: NgramJoin) -> DataFrame:
    """Links (a, b) between the sets of ``texts`` (node, text) that join all components that similar sets make up.

    ``placed`` (node, at) names the components known before; nodes that it leaves out stand alone.
    """
    spark = texts.sparkSession
    tokens = materialise(shingles(texts, method.words), "tokens")
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    # one document's n-grams in a row, the most frequent first
    ordered = tokens.join(held.hint("merge"), "token").groupBy("node", "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("f")).alias("f"), "token"))), lambda x: x["token"]).alias("tokens"))
    least = F.ceil(F.col("n") * method.percent / 100)
    able = ordered.filter(F.size("tokens") >= least)
    if placed is None:
        able = able.withColumn("at", F.col("node"))
    else:
        able = able.join(placed.hint("merge"), "node", "left").withColumn("at", F.coalesce("at", "node"))
    sets = materialise(able.select("node", "n", "at", "tokens"), "ordered-sets")
    release(spark)

    # the rare ends: from the n-gram on with which a linked set must have another in common
    ends = sets.select("node", "at", F.explode(F.slice("tokens", least.cast("int"), F.size("tokens"))).alias("token"))
    heads_of = ends.groupBy("token").agg(F.min("node").alias("b"), F.min("at").alias("_x"), F.max("at").alias("_y")).filter("_x < _y")
    meet = materialise(ends.join(heads_of.select("token", "b").hint("merge"), "token").filter("node <> b").select(
        F.col("node").alias("a"), "b").distinct(), "meeting")
    if meet.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    families = components(meet, "families").withColumnRenamed("component", "family")
    members = sets.join(families.hint("merge"), "node")
    volume = members.groupBy("family").agg(F.sum(F.size("tokens")).alias("v"), F.min("at").alias("_x"), F.max("at").alias("_y")).filter("_x < _y").select(
        "family", F.ceil(F.col("v") / method.block_tokens).alias("blocks"))
    rows = materialise(members.join(volume.hint("merge"), "family"), "families")
    release(spark)
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    inside = rows.select("family", block.alias("block"), "node", "n", "at", "tokens", F.lit(None).cast("int").alias("side"))
    links = materialise(inside.groupBy("family", "block").applyInArrow(_trees(method), "a long, b long"), "tree-links")
    large = rows.filter("blocks > 1")
    if large.isEmpty():
        return links
    return links.union(_across(large, links, method))


def _across(rows: DataFrame, links: DataFrame, method: NgramJoin) -> DataFrame:
    """Links between blocks of large families.

    Components of more than a block are cut into blocks of their own; the other members of a family share mixed ones,
    each component in one of them. Two blocks meet unless they lie in one component.
    """
    old = rows.select(F.col("node").alias("a"), F.col("at").alias("b"))
    now = components(old.union(links.join(rows.select(F.col("node").alias("a")).hint("merge"), "a", "left_semi")), "placed")
    placed = materialise(rows.drop("blocks").join(now.hint("merge"), "node", "left").withColumn("at", F.coalesce("component", "at")).drop("component"), "placed-sets")
    size = placed.groupBy("family", "at").agg(F.sum(F.size("tokens")).alias("v"))
    own = size.filter(F.col("v") >= method.block_tokens).select("family", "at", F.ceil(F.col("v") / method.block_tokens).alias("own"))
    rest = size.filter(F.col("v") < method.block_tokens).groupBy("family").agg(F.ceil(F.sum("v") / method.block_tokens).alias("mixed"))
    blocked = materialise(
        placed.join(own, ["family", "at"], "left").join(rest, "family", "left").select(
            "family", "node", "n", "at", "tokens",
            F.when(F.col("own").isNotNull(), F.concat_ws(":", "at", F.pmod(F.xxhash64("node"), F.col("own"))))
            .otherwise(F.concat_ws(":", F.lit("mixed"), F.pmod(F.xxhash64("at"), F.col("mixed")))).alias("block"),
            F.col("own").isNotNull().alias("pure")), "blocks")
    # one row per block: how many there are follows the size of a family, not of the table
    blocks = blocked.groupBy("family", "block").agg(F.max("pure").alias("pure"), F.min("at").alias("at"))
    other = blocks.select("family", *[F.col(c).alias(f"_{c}") for c in ("block", "pure", "at")])
    meet = blocks.join(other, "family").filter(
        (F.col("block") < F.col("_block")) & ~(F.col("pure") & F.col("_pure") & (F.col("at") == F.col("_at"))) | (F.col("block") == F.col("_block")) & ~F.col("pure"))
    unit = F.concat_ws("|", "block", "_block")
    alone = F.col("block") == F.col("_block")
    sides = meet.select("family", unit.alias("unit"), F.explode(F.when(alone, F.array(F.struct(F.col("block").alias("block"), F.lit(None).cast("int").alias("side"))))
        .otherwise(F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("side")), F.struct(F.col("_block").alias("block"), F.lit(1).alias("side"))))).alias("s")).select(
        "family", "unit", "s.block", "s.side")
    return blocked.drop("pure").join(sides, ["family", "block"]).select("family", "unit", "node", "n", "at", "tokens", "side").groupBy(
        "family", "unit").applyInArrow(_trees(method), "a long, b long")


def ngram_join(docs: DataFrame, method: NgramJoin | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text).

    Two documents are linked if the Jaccard similarity of their n-gram sets is at least ``method.percent`` / 100;
    component_id is the smallest doc_id reachable by links. A text shorter than an n-gram is one n-gram; a null or blank
    text has none and is linked with nothing. Rows that share a doc_id are judged each by its own text. Rows without
    doc_id take no part: component_id is null. Other columns are not read; an empty table gives an empty result.
    """
    method = method or NgramJoin()
    rows = keyed(docs)
    signed = materialise(heads(rows, method), "signed")
    narrow = signed.select("doc_id", "h1", "h2", "n", "digest")
    classes = classes_of(narrow, "classes")
    chosen = alike(signed, classes)
    release(docs.sparkSession)
    texts = materialise(class_texts(rows, chosen.drop("digest")), "texts")
    release(docs.sparkSession)
    links = joined_links(texts, None, method)
    found = components(links)
    return with_components(narrow, classes, found).select("doc_id", F.col("n").alias("n_shingles"), "component_id")

"""From raw documents to packed training sequences: five operators of ``tamarack.llm`` in a row.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; :func:`run` writes it as Parquet to the shared folder and
reads it again as the next stage's ``docs``. All stages but the last return the columns of ``docs``, whatever they
are called; ``doc_id``, ``text`` and ``lang`` are read, and ``n_chars`` follows the text where it changes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import line_dedup, minhash, packing, quality, secrets
from tamarack.llm.common import materialise


def _apart(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator reads, and the whole row beside them: no name of ``docs`` can clash with its own."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``changed`` (text, _row), with the new text and its number of characters."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return changed.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a risk-controlled cutoff rejects go.

    Texts are read twice and never shuffled: once for the cutoffs, once to judge.
    """
    statistics = materialise(quality.text_statistics(docs.select("doc_id", "lang", "text")).drop("text"), "quality")
    cutoffs = quality.learn_cutoffs(statistics, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.judge(quality.text_statistics(_apart(docs, "lang", "text")), cutoffs)
    return judged.filter("kept").select("_row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents stay in the largest document only."""
    return _with_text(docs, line_dedup.dedup_lines(_apart(docs, "doc_id", "text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id; of repeated rows, one.

    Documents are linked if their sets of five-word shingles are similar to 0.8 or more. Rows that share an id go if all
    of them are to go; rows without an id stay.
    """
    groups = materialise(minhash.near_duplicates(docs, minhash.MinHash(shingle_words=5, percent=80)), "near-duplicates")
    ids = groups.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    # these ids grow with the corpus: joined by merging at every size
    gone = ids.filter(~F.col("kept")).select("doc_id")
    kept = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)
    if not ids.filter("kept AND n > 1").isEmpty():
        again = _apart(kept, "doc_id").withColumn("_hash", F.sha2(F.col("_row.text").cast("binary"), 256))
        once = again.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "_hash"])
        kept = once.unionByName(again.filter(F.col("doc_id").isNull())).select("_row.*")
    return kept


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mask."""
    return _with_text(docs, secrets.redact_secrets(_apart(docs, "text")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed into sequences of at most 4096."""
    pieces = packing.encode_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, checksums=True)
    return packing.pack(materialise(pieces, "pieces"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]
# Packing counts the pieces of a tokenizer, which SQL cannot.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

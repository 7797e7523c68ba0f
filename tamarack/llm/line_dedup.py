"""Line de-duplication over levelled sorted runs of line hashes. DataFrame functions only.

Documents arrive in batches, those with the largest ids first. A batch is summed up as one row per line key (two
64-bit hashes, number of documents, largest document); the summary is merge-anti-joined with the *settled* keys of
the runs (those that have already reached the number of documents asked for, whose fate later batches cannot
change) and the rest is added as a sorted run of level 0. When a level holds ``fanout`` runs, they are merged into
one run of the next level. In the end the runs are merged once, and lines are anti-joined with the frequent keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import ascii_lower, ascii_strip, fresh_path, key128, materialise, release

NO_ID = -(2**63)
RUN_SCHEMA = "_h1 long, _h2 long, _n_docs long, _last_doc long"


def line_key(line: Column) -> Column:
    return ascii_lower(ascii_strip(line))


class LineRuns:
    """Levelled sorted runs of line keys below one shared path."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4, path: str | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.path = path or fresh_path(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self._made = 0

    def _write(self, summary: DataFrame) -> str:
        """One run: range-partitioned and sorted by key, so that parts have disjoint key ranges."""
        self._made += 1
        path = f"{self.path}/run-{self._made}"
        summary.repartitionByRange("_h1", "_h2").sortWithinPartitions("_h1", "_h2").write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(*paths)

    def runs(self) -> list[str]:
        return [p for level in self.levels for p in level]

    @staticmethod
    def _merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy("_h1", "_h2").agg(F.sum("_n_docs").alias("_n_docs"), F.max("_last_doc").alias("_last_doc"))

    def absorb(self, lines: DataFrame) -> None:
        """Add the lines (``_h1``, ``_h2``, ``_doc``) of a batch of documents that no earlier batch held.

        Batches must come in falling order of documents: a settled key then keeps its largest document.
        """
        summary = (
            lines.select("_h1", "_h2", "_doc").distinct()
            .groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n_docs"), F.max("_doc").alias("_last_doc"))
        )
        if self.runs():
            settled = self._read(self.runs()).filter(F.col("_n_docs") >= self.min_docs).select("_h1", "_h2")
            summary = summary.join(settled, ["_h1", "_h2"], "left_anti")
        self.levels[0].append(self._write(summary))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._write(self._merged(self._read(self.levels[level])))
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(merged)
            self.levels[level] = []
            level += 1

    def frequent(self) -> DataFrame:
        """Keys held by at least ``min_docs`` documents, with their largest document."""
        if not self.runs():
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return self._merged(self._read(self.runs())).filter(F.col("_n_docs") >= self.min_docs)


def _batches(docs: DataFrame, n: int) -> list[Column]:
    """Conditions that part the documents into ``n`` ranges of about equal row counts, largest ids first."""
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    if not cuts:
        return [F.lit(True)]
    parts = [F.col("doc_id") > cuts[0]]
    parts += [(F.col("doc_id") <= a) & (F.col("doc_id") > b) for a, b in zip(cuts, cuts[1:], strict=False)]
    return parts + [(F.col("doc_id") <= cuts[-1]) | F.col("doc_id").isNull()]


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that can be dropped: document, hash of its text, position, key hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2 = key128(F.col("_key"))
    return (
        docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"), F.xxhash64(text).alias("_text"),
                    F.posexplode(F.split(text, "\n", -1)).alias("_at", "_line"))
        .select("_doc", "_text", "_at", line_key(F.col("_line")).alias("_key"))
        .filter(F.char_length("_key") >= min_chars)
        .select("_doc", "_text", "_at", h1.alias("_h1"), h2.alias("_h2"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 4) -> DataFrame:
    """Drop lines that repeat across documents; they stay in the largest ``doc_id`` that holds them.

    ``docs`` has ``doc_id`` and ``text``. The key of a line is the line without ASCII blanks at its ends and with A-Z
    lower-cased; keys shorter than ``min_chars`` never count. Returns all columns of ``docs`` with ``text`` rebuilt from
    the lines that stay, and n_lines and n_dropped. Null and empty text is one empty line (and becomes ``""``). Rows
    without an id count as one document before all others; rows that share an id count as one document. Repeated rows
    stay. Lines inside the keeping document stay, repeated or not. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs, fanout)
    for part in _batches(docs, batches):
        runs.absorb(_lines(docs.filter(part), min_chars))
    # written, so that the join below shuffles two plain tables: then the adaptive skew join can split a hot key
    frequent = materialise(runs.frequent().select("_h1", "_h2", "_last_doc"), "frequent-lines")
    release(spark)
    dropped = (
        _lines(docs, min_chars).join(frequent, ["_h1", "_h2"]).filter(F.col("_doc") < F.col("_last_doc"))
        .groupBy("_doc", "_text").agg(F.sort_array(F.collect_set("_at")).alias("_drop"))
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"_doc_": F.coalesce("doc_id", F.lit(NO_ID)), "_text_": F.xxhash64(text)})
    joined = keyed.join(dropped, (F.col("_doc_") == F.col("_doc")) & (F.col("_text_") == F.col("_text")), "left")
    # the kept runs between one dropped line and the next, in linear time
    split = joined.withColumn("_all", F.split(text, "\n", -1)).withColumn(
        "_cut", F.concat(F.array(F.lit(-1)), F.coalesce("_drop", F.array().cast("array<int>")), F.array(F.size("_all"))))
    kept = F.expr(
        "array_join(flatten(transform(sequence(1, size(_cut) - 1),"
        " j -> slice(_all, _cut[j - 1] + 2, _cut[j] - _cut[j - 1] - 1))), '\n')")
    return split.select(
        *[F.when(F.col("_drop").isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`")
          for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.size("_all").cast("long").alias("n_lines"),
        F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped"),
    )

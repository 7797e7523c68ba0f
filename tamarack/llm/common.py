"""Helpers that several operators share: shared storage, byte-wise text functions, unit caches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# The ASCII white space of the contracts, ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a session on one machine (as in tests) gets a temporary folder of its own;
    a session on a cluster is refused, because executors do not see each other's disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tamarack-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/tamarack/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished work: it does so when the driver collects its garbage.

    For iterative operators, whose rounds are written to the shared folder and no longer need them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Pure ASCII values take the fast built-in, others a translation."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def ascii_strip(text: Column) -> Column:
    """``[\\x20\\x09-\\x0D]`` stripped at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def key128(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: together an identity for groups and joins."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols)


def byte_batches(texts: Iterable[str], limit: int) -> Iterator[list[str]]:
    """Lists of texts of about ``limit`` characters each; a longer text makes a list of its own."""
    held: list[str] = []
    size = 0
    for t in texts:
        if held and size + len(t) > limit:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


class UnitCache(dict):
    """Encodings of text units (words with their leading blank) of one worker, about twice ``limit`` units at most.

    ``encode`` gets a list of units that are not held and returns their values in the same order. The cache is a
    plain dict, so that hits cost one lookup. When it is full it becomes the older generation and starts anew; units
    that are met again move back from there, so that what is common stays. A unit longer than ``longest`` is never
    held, so memory is bounded whatever the texts are.
    """

    def __init__(self, encode: Callable[[list], list], limit: int = 300_000, longest: int = 64):
        super().__init__()
        self.encode, self.limit, self.longest = encode, limit, longest
        self.older: dict = {}

    def values_of(self, units: list) -> list:
        distinct = dict.fromkeys(units)
        missing = [u for u in distinct if u not in self]
        if missing and len(self) + len(missing) > self.limit:
            self.older = dict(self)
            self.clear()
            missing = list(distinct)
        older, rest = self.older, {}
        if older and missing:
            self.update([(u, older[u]) for u in missing if u in older])
            missing = [u for u in missing if u not in older]
        if missing:
            values = self.encode(missing)
            if max(map(len, missing)) <= self.longest:
                self.update(zip(missing, values, strict=True))
            else:
                for u, v in zip(missing, values, strict=True):
                    (self if len(u) <= self.longest else rest)[u] = v
        if rest:
            return [rest[u] if u in rest else self[u] for u in units]
        return list(map(self.__getitem__, units))


# A cut before a blank between two characters that are no white space: no pre-token of a byte-level pattern (whose
# words take at most one blank before them) spans it, and no lookahead reaches over it.
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


def segments(text: str, limit: int) -> Iterator[str]:
    """A text in pieces of about ``limit`` characters, parted at safe cuts only; joined they give the text."""
    at = 0
    while len(text) - at > limit:
        cut = SAFE_CUT.search(text, at + limit)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]

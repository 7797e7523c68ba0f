"""Nearest neighbours by cosine over shifted space-filling curves.

Vectors are scaled to length 1 and projected to a few dimensions, differently for each curve; the projected points,
shifted by a random vector, are ordered along a Hilbert curve. The keys of a curve are cut into ranges, which Spark deals
to its tasks. A query meets the candidates of its own range and of the neighbouring ones; they are ranked by their exact
cosine, and the best of all curves are merged. A few curves run at a time, so that vectors are shuffled a few times over
and no more, however many curves there are.

Vectors of equal direction form a class, which stands on the curves once; its smallest ids answer for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm.common import materialise, release


@dataclass(frozen=True)
class Curves:
    """``curves`` orderings of ``dims`` projected dimensions with ``bits`` bits each.

    The bits tell apart what lies in a dense group. A curve is cut into ``slices`` ranges (fewer if they would hold less
    than ``least_slice`` vectors) at quantiles of the keys of ``sample`` vectors; a window is a query's range and
    ``reach`` ranges on either side, so that its share of the table, and with it recall, does not fall with the rows.
    ``together`` curves are shuffled at once; a task holds about ``block_rows`` candidates and ``block_queries`` queries.
    """

    curves: int = 16
    dims: int = 16
    bits: int = 24
    slices: int = 64
    reach: int = 2
    least_slice: int = 512
    sample: int = 8192
    together: int = 2
    block_rows: int = 16_384
    block_queries: int = 4096
    seed: int = 7

    def slices_of(self, rows: int) -> int:
        return max(1, min(self.slices, rows // self.least_slice))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of grid cells (points by dimensions, each below 2**bits), as unsigned 64-bit.

    Undoes the rotations and reflections of the sub-cubes from the coarsest bit to the finest, then reads the bits
    of all dimensions in turn through a Gray code. 64 bits at most in all.
    """
    key = np.zeros(len(cells), np.uint64)
    for bit in hilbert_bits(cells, bits):
        key = (key << np.uint64(1)) | bit
    return key


def hilbert_bits(cells: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits of the positions, the first one first."""
    x = [c.astype(np.uint64) for c in cells.T]
    n = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        low = np.uint64((1 << level) - 1)
        for i in range(n):
            high = (x[i] >> np.uint64(level)) & one == one
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[n - 1] >> np.uint64(level)) & one == one, flip ^ np.uint64((1 << level) - 1), flip)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            yield ((x[i] ^ flip) >> np.uint64(level)) & one


def _projection(dim: int, curve: int, c: Curves) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions (as many as the vectors allow) and the shift of one curve."""
    rng = np.random.default_rng([c.seed, curve, dim])
    basis = np.linalg.qr(rng.standard_normal((dim, min(dim, c.dims))))[0]
    return basis, rng.random(basis.shape[1])


def curve_keys(unit: np.ndarray, curve: int, c: Curves) -> np.ndarray:
    """Sortable keys of unit vectors on one curve, as rows of bytes. The grid spans eight deviations of a projection and its shift."""
    basis, shift = _projection(unit.shape[1], curve, c)
    scaled = (unit @ basis) * np.sqrt(unit.shape[1]) / 16 + 0.25 + shift / 2
    cells = np.clip(scaled * (1 << c.bits), 0, (1 << c.bits) - 1).astype(np.uint64)
    return np.packbits(np.stack([b.astype(np.uint8) for b in hilbert_bits(cells, c.bits)], axis=1), axis=1)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as doubles; null components become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def directions(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """id, asks, dim, (h1, h2) and vec of the rows that take part; the hash is that of the direction, to 2**-40."""
    kind = vectors.schema[vector_col].dataType.elementType
    element = kind if isinstance(kind, T.FloatType) else T.DoubleType()
    own = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(T.ArrayType(element)).alias("vec"))
    own = own.select("id", F.coalesce(is_query, F.lit(False)).alias("asks"), "vec")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            lengths = pc.list_value_length(batch.column(2))
            for dim in [d for d in pc.unique(lengths).to_pylist() if d]:
                part = batch.filter(pc.equal(lengths, dim))
                m = _matrix(part.column(2))
                fine = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
                part, m = part.filter(pa.array(fine)), m[fine]
                scaled = m / np.abs(m).max(axis=1, initial=0, keepdims=True)
                length = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
                whole = np.rint(scaled / length * float(1 << 40)).astype(np.int64)
                keys = np.frombuffer(b"".join(xxhash.xxh128_digest(w.tobytes()) for w in whole), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.full(len(m), dim, np.int32)), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), part.column(2)],
                    ["id", "asks", "dim", "h1", "h2", "vec"])

    return own.mapInArrow(hashed, f"id long, asks boolean, dim int, h1 long, h2 long, vec array<{element.simpleString()}>")


def _sortable(keys: np.ndarray) -> np.ndarray:
    """Rows of bytes as byte strings, which numpy can search."""
    return np.frombuffer(np.ascontiguousarray(keys).tobytes(), f"S{keys.shape[1]}")


def _cuts(classes: DataFrame, rows: dict[int, int], c: Curves) -> dict[int, list[np.ndarray]]:
    """Per vector length and curve, the keys at which ranges begin, from a bounded sample."""
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(c.sample).select("dim", "vec").collect()
    cuts = {}
    for dim in {r.dim for r in sample}:
        m = np.array([r.vec for r in sample if r.dim == dim], np.float64)
        unit = m / np.linalg.norm(m, axis=1)[:, None]
        n = c.slices_of(rows[dim])
        at = np.arange(1, n) * len(m) // n
        cuts[dim] = [np.sort(_sortable(curve_keys(unit, curve, c)))[at] for curve in range(c.curves)]
    return cuts


def _ranked(k: int):
    """The k best classes of each query in a block: rows of node, asks and vec."""
    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
        node, m = table["node"].to_numpy(), _matrix(table["vec"])
        norm = np.linalg.norm(m, axis=1)
        q, x = np.flatnonzero(asks), np.flatnonzero(~asks)
        out_q, out_x, out_s = [], [], []
        top = min(k, len(x))
        for at in range(0, len(q) if top else 0, 256):
            rows = q[at:at + 256]
            score = (m[rows] @ m[x].T) / norm[rows][:, None] / norm[x]
            kth = np.partition(score, len(x) - top, axis=1)[:, len(x) - top]
            for i, row in enumerate(rows):
                near = x[score[i] >= kth[i] - 1e-12]
                exact = np.einsum("j,ij->i", m[row], m[near]) / (norm[row] * norm[near])
                best = np.lexsort((node[near], -exact))[:top]
                out_q.append(np.full(len(best), node[row]))
                out_x.append(node[near][best])
                out_s.append(exact[best])
        columns = [np.concatenate(o) if o else np.empty(0) for o in (out_q, out_x, out_s)]
        return pa.Table.from_arrays([pa.array(v.astype(t)) for v, t in zip(columns, (np.int64, np.int64, np.float64), strict=True)], names=["q", "node", "score"])

    return run


def _along(classes: DataFrame, curves: list[int], cuts: dict, shape: dict[int, tuple[int, int]], k: int, c: Curves) -> DataFrame:
    """q, node and score of the best candidates of each query on some curves. ``shape``: blocks of candidates and of queries per range."""
    kind = classes.schema["vec"].dataType.simpleString()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dim in pc.unique(table["dim"]).to_pylist():
                part = table.filter(pc.equal(table["dim"], dim)).combine_chunks()
                n_x, n_q = shape[dim]
                m = _matrix(part["vec"])
                unit = m / np.linalg.norm(m, axis=1)[:, None]
                node, asks = part["node"].to_numpy(), np.flatnonzero(part["asks"].to_numpy(zero_copy_only=False).astype(bool))
                for curve in curves:
                    starts = cuts[dim][curve] if dim in cuts else np.zeros(0, "S1")
                    own = np.searchsorted(starts, _sortable(curve_keys(unit, curve, c)), "right")

                    def out(rows: np.ndarray, ranges: np.ndarray, x: np.ndarray, a: np.ndarray, asking: bool) -> pa.RecordBatch:
                        n = len(rows)
                        columns = [np.full(n, dim, np.int32), np.full(n, curve, np.int32), ranges.astype(np.int32), x.astype(np.int32), a.astype(np.int32)]
                        return pa.RecordBatch.from_arrays(
                            [*map(pa.array, columns), pa.array(node[rows]), pa.array(np.full(n, asking)), part["vec"].combine_chunks().take(pa.array(rows))],
                            ["dim", "curve", "slice", "x", "a", "node", "asks", "vec"])

                    every = np.arange(len(node))
                    for a in range(n_q):
                        yield out(every, own, node % n_x, np.full(len(node), a), False)
                    for step in range(-c.reach, c.reach + 1):
                        there = own[asks] + step
                        rows, ranges = asks[(there >= 0) & (there <= len(starts))], there[(there >= 0) & (there <= len(starts))]
                        for x in range(n_x if len(rows) else 0):
                            yield out(rows, ranges, np.full(len(rows), x), node[rows] % n_q, True)

    placed = classes.select("node", "asks", "dim", "vec").mapInArrow(
        dealt, f"dim int, curve int, slice int, x int, a int, node long, asks boolean, vec {kind}")
    return placed.groupBy("dim", "curve", "slice", "x", "a").applyInArrow(_ranked(k), "q long, node long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            curves: Curves | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found for each row that ``is_query`` (on ``id``) marks.

    Candidates are all rows but the query's own. The score is the cosine in double precision (of vectors of equal
    direction, that of the one with the smallest id); ties go to the smaller id. Null vectors and ids, zero vectors and
    vectors with null or non-finite components take no part. Vectors are compared with those of the same length. Rows that
    repeat an id count once if their directions are equal; an id with several directions counts by its best one, as
    a query and as a neighbour, and never neighbours itself. Other columns are not read; an empty table gives an empty
    result. Recall is measured against brute force in the tests and the README.
    """
    c = curves or Curves()
    spark = vectors.sparkSession
    usable = materialise(directions(vectors, is_query, id_col, vector_col), "directions")
    # a class has an id of its own: vectors of several directions may share theirs
    first = usable.groupBy("h1", "h2", "dim").agg(F.min(F.struct("id", "vec")).alias("r"), F.max("asks").alias("asks"))
    classes = materialise(first.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "dim", "asks", F.col("r.vec").alias("vec")), "class-vectors")
    ids = materialise(usable.select("id", "asks", "h1", "h2", "dim").distinct()
                      .join(classes.select("node", "h1", "h2", "dim"), ["h1", "h2", "dim"]).select("id", "asks", "node"), "vector-ids")
    # one row per vector length
    counts = {r.dim: (r.n, r.q) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).collect()}
    cuts = _cuts(classes, {d: n for d, (n, _) in counts.items()}, c)
    shape = {}
    for dim, (n, q) in counts.items():
        ranges = c.slices_of(n) if dim in cuts else 1
        shape[dim] = max(1, -(-n // (ranges * c.block_rows))), max(1, -(-q * (2 * c.reach + 1) // (ranges * c.block_queries)))
    several = 2 * (k + 1)
    found = None
    for at in range(0, c.curves, c.together):
        part = materialise(_along(classes, list(range(at, min(c.curves, at + c.together))), cuts, shape, several, c), "found")
        found = part if found is None else found.union(part)
        release(spark)
    pairs = found.groupBy("q", "node").agg(F.max("score").alias("score"))
    by_class = Window.partitionBy("q").orderBy(F.desc("score"), "node")
    best = pairs.withColumn("r", F.row_number().over(by_class)).filter(F.col("r") <= several).select("q", "node", "score")
    # the smallest ids of each class: more than k + 1 can never be needed
    small = ids.select("id", "node").distinct().withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).filter(
        F.col("r") <= k + 1).select("node", F.col("id").alias("vec_id"))
    answers = best.join(small, "node").select("q", "vec_id", "score")
    asked = ids.filter("asks").select(F.col("id").alias("query_id"), F.col("node").alias("q")).distinct()
    per_id = asked.join(answers, "q").filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return per_id.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Hard negatives by lists that clusters of anchors share, walked until nothing better can follow.

Anchors are clustered by direction. For a cluster whose members lie within an angle of its centre, a candidate's length and
its angle to the centre bound its inner product with every member (per unit of the member's length). The candidates of
a block are sorted by that bound once for each cluster; all members walk this list together, and each stops when the next
bound certifies that no later candidate can enter its result. Blocks of candidates and of anchors have bounded size and
meet in Spark tasks; the results of all blocks are merged. One walk finds the positives among the rows of the
anchor's label, a second the negatives, between score limits that follow from each positive.

Vectors are compared as whole numbers, floor(256 x), so that scores are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.common import materialise

NONE = np.iinfo(np.int64).min
# Scores held at once by a walk.
CELLS = 2_000_000


@dataclass(frozen=True)
class Mining:
    """How many positives and negatives, their limits, and how the work is divided (which changes no result).

    ``sample`` anchors at most are brought to the driver to fit ``clusters`` centres.
    """

    positives: int = 5
    negatives: int = 3
    low_percent: int = 50
    high_percent: int = 95
    scale: float = 256.0
    clusters: int = 16
    sample: int = 4096
    block_values: int = 1 << 21
    anchor_values: int = 1 << 18
    seed: int = 12


def numbered(vectors: DataFrame, label: Column, is_anchor: Column, m: Mining, id_col: str, vector_col: str) -> DataFrame:
    """id, key, label, dim, q (whole components) and asks of the rows that take part; equal rows once.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. id and key tell rows apart.
    """
    v = F.col(vector_col)
    # a null component makes the condition null
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x.cast("double") * m.scale)).alias("q"))
    return own.distinct().select(
        "id", F.xxhash64("label", "q").alias("key"), "label", F.size("q").alias("dim"), "q", F.coalesce(is_anchor, F.lit(False)).alias("asks"))


def fit_centres(anchors: DataFrame, m: Mining) -> dict[int, np.ndarray]:
    """Unit centres per vector length, by spherical k-means on at most ``m.sample`` anchors. Any centres give the same result."""
    rows = anchors.orderBy(F.xxhash64("id", "key"), "id").limit(m.sample).select("dim", "q").collect()
    rng = np.random.default_rng(m.seed)
    centres = {}
    for dim in {r.dim for r in rows if r.dim}:
        unit = np.array([r.q for r in rows if r.dim == dim], np.float64)
        unit = unit[np.linalg.norm(unit, axis=1) > 0]
        if not len(unit):
            continue
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        middle = unit[rng.permutation(len(unit))[:m.clusters]]
        for _ in range(10):
            nearest = (unit @ middle.T).argmax(axis=1)
            sums = np.stack([unit[nearest == c].sum(axis=0) for c in range(len(middle))])
            length = np.linalg.norm(sums, axis=1)[:, None]
            middle = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), middle)
        centres[dim] = middle
    return centres


def _best(walker: np.ndarray, score: np.ndarray, place: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best of each walker: higher scores, then smaller ``order`` of the candidate at ``place``."""
    rows = np.lexsort((order[place], -score, walker))
    walker = walker[rows]
    first = np.searchsorted(walker, walker, "left")
    return rows[np.arange(len(rows)) - first < k]


class _Walk:
    """Candidates of one block, as a list per cluster, and the walkers of its anchors."""

    def __init__(self, anchors: np.ndarray, candidates: np.ndarray, centres: np.ndarray | None):
        self.anchors, self.candidates = anchors, candidates
        a_norm, x_norm = (np.sqrt((v.astype(np.float64)**2).sum(axis=1)) for v in (anchors, candidates))
        self.a_norm, self.x_norm = a_norm, x_norm
        top = max((float(np.abs(v).max()) if v.size else 0.0) for v in (anchors, candidates))
        total = top * top * anchors.shape[1]
        if total >= 2.0**63:
            raise ValueError("an inner product may not fit 64 bits")
        self.exact_floats = total < 2.0**53
        if self.exact_floats:
            self.anchors, self.candidates = anchors.astype(np.float64), candidates.astype(np.float64)
        unit_a = anchors / np.maximum(a_norm, 1e-300)[:, None]
        self.unit_x = candidates / np.maximum(x_norm, 1e-300)[:, None]
        if centres is None:
            mean = unit_a.sum(axis=0)
            centres = (mean / max(np.linalg.norm(mean), 1e-300))[None, :]
        near = unit_a @ centres.T
        self.centres, self.cluster = centres, near.argmax(axis=1)
        self.angle = np.where(a_norm > 0, np.arccos(np.clip(near.max(axis=1), -1, 1)), 0.0)

    def lists(self):
        """Per cluster: its anchors, the candidates by falling bound, and their bounds per unit of an anchor's length."""
        for c in np.unique(self.cluster).tolist():
            members = np.flatnonzero(self.cluster == c)
            # 1e-6 stands for the rounding of cosines and angles
            gap = np.arccos(np.clip(self.unit_x @ self.centres[c], -1, 1)) - self.angle[members].max() - 1e-6
            bound = self.x_norm * np.cos(np.maximum(gap, 0.0)) + self.x_norm * 1e-9
            order = np.argsort(-bound, kind="stable")
            yield members, order, bound[order]

    def scores(self, members: np.ndarray, places: np.ndarray) -> np.ndarray:
        return (self.anchors[members] @ self.candidates[places].T).astype(np.int64)


def walk(w: _Walk, owner: np.ndarray, low: np.ndarray, high: np.ndarray, allowed, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """walker, place and score of the k best allowed candidates of each walker with low <= score <= high.

    Walker i stands for anchor ``owner[i]``; ``allowed(walkers, places)`` masks the candidates a walker may take.
    Candidates of equal score go by ``order``.
    """
    out_w, out_p, out_s = [], [], []
    for members, places, bounds in w.lists():
        active = np.flatnonzero(np.isin(owner, members))
        held_w, held_p, held_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, length = 0, 512
        kth = np.full(len(owner), NONE)
        while len(active) and at < len(places):
            end = min(len(places), at + max(1, min(length, CELLS // len(active))))
            part = places[at:end]
            anchors, row = np.unique(owner[active], return_inverse=True)
            score = w.scores(anchors, part)[row]
            fits = (score >= np.maximum(low[active], kth[active])[:, None]) & (score <= high[active][:, None]) & allowed(active, part)
            i, j = np.nonzero(fits)
            held_w, held_p, held_s = (np.concatenate(x) for x in ((held_w, active[i]), (held_p, part[j]), (held_s, score[i, j])))
            best = _best(held_w, held_s, held_p, order, k)
            held_w, held_p, held_s = held_w[best], held_p[best], held_s[best]
            full = np.flatnonzero(np.bincount(held_w, minlength=len(owner)) == k)
            if len(full):  # rows stand by walker and falling score: the last one of a full walker is its k-th
                kth[full] = held_s[np.searchsorted(held_w, full, "right") - 1]
            if end < len(places):
                # an equal score could still win by its order
                most = w.a_norm[owner[active]] * bounds[end]
                most = most + np.abs(most) * 1e-9
                active = active[(most >= low[active]) & ((kth[active] == NONE) | (most >= kth[active]))]
            at, length = end, length * 2
        out_w.append(held_w), out_p.append(held_p), out_s.append(held_s)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_w, out_p, out_s))


def _table(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    q = table["q"].combine_chunks()
    return (table["id"].to_numpy(), table["key"].to_numpy(), table["label"].to_numpy(),
            q.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1))


def _units(vectors: DataFrame, anchors: DataFrame, keys: list[str], m: Mining) -> DataFrame:
    """Blocks of candidates beside blocks of anchors, within ``keys``: each candidate and anchor once in each unit that it meets.

    ``vectors`` and ``anchors`` have id, key, label, dim, q and limits (an anchor's; null for candidates).
    """
    def blocks(df: DataFrame, values: int, name: str) -> DataFrame:
        size = F.greatest(F.lit(1), F.floor(F.lit(values) / F.greatest("dim", F.lit(1))))
        return df.groupBy(*keys, *[c for c in ("dim",) if c not in keys]).agg(F.count(F.lit(1)).alias("c")).select(
            *keys, F.ceil(F.col("c") / size).alias(name))

    shape = blocks(vectors, m.block_values, "nx").join(blocks(anchors, m.anchor_values, "na"), keys)
    mine = F.pmod(F.xxhash64("id", "key"), F.col("nx"))
    theirs = F.pmod(F.xxhash64("key", "id"), F.col("na"))

    def placed(df: DataFrame, asks: bool) -> DataFrame:
        joined = df.join(shape, keys)
        if asks:
            joined = joined.withColumns({"a": theirs, "x": F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1))})
        else:
            joined = joined.withColumns({"x": mine, "a": F.explode(F.sequence(F.lit(0).cast("long"), F.col("na") - 1))})
        return joined.select(*[F.col(k).alias(f"_{k}") for k in keys], "x", "a", "id", "key", "label", "dim", "q", "limits", F.lit(asks).alias("asks"))

    return placed(vectors, False).unionByName(placed(anchors, True)).groupBy(*[f"_{k}" for k in keys], "x", "a")


FOUND = "a_id long, a_key long, limit_score long, id long, key long, score long"


def _found(a_id, a_key, limit, x_id, x_key, score) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (a_id, a_key, limit, x_id, x_key, score)],
                                names=["a_id", "a_key", "limit_score", "id", "key", "score"])


def _searched(centres: dict[int, np.ndarray], m: Mining, same_label: bool):
    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
        a_rows, x_rows = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        empty = np.zeros(0, np.int64)
        if not len(a_rows) or not len(x_rows):
            return _found(*[empty] * 6)
        a_id, a_key, a_label, a = _table(a_rows)
        x_id, x_key, x_label, x = _table(x_rows)
        order = np.empty(len(x_id), np.int64)
        order[np.lexsort((x_key, x_id))] = np.arange(len(x_id))
        w = _Walk(a, x, centres.get(a.shape[1]))
        if same_label:
            owner = np.arange(len(a_id))
            low, high, limit = np.full(len(owner), NONE), np.full(len(owner), np.iinfo(np.int64).max), np.zeros(len(owner), np.int64)

            def allowed(walkers, places):
                return (a_id[owner[walkers]][:, None] != x_id[places]) | (a_key[owner[walkers]][:, None] != x_key[places])
        else:
            limits = a_rows["limits"].to_pylist()
            owner = np.repeat(np.arange(len(a_id)), [len(v) for v in limits])
            limit = np.array([s for v in limits for s in v], np.int64)
            # percentages of whole numbers, without products beyond 64 bits
            low = limit // 100 * m.low_percent + -(-(limit % 100 * m.low_percent) // 100)
            high = limit // 100 * m.high_percent + limit % 100 * m.high_percent // 100

            def allowed(walkers, places):
                return a_label[owner[walkers]][:, None] != x_label[places]
        i, p, s = walk(w, owner, low, high, allowed, order, m.positives if same_label else m.negatives)
        return _found(a_id[owner[i]], a_key[owner[i]], limit[i], x_id[p], x_key[p], s)

    return run


def hard_negatives(vectors: DataFrame, label: Column, is_anchor: Column, mining: Mining | None = None, id_col: str = "vec_id",
                   vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: the hardest negatives per anchor and positive.

    ``is_anchor`` is a condition on ``id``. Positives of an anchor are its best other rows of the same ``label``; the
    negatives of a positive are the best rows of another label whose score lies between ``low_percent`` and ``high_percent``
    of the positive's. Higher scores come first, ties go by smaller id (rows that share an id: by a hash of label and
    vector). All are taken where there are fewer. Rows that repeat id, label and vector count once; rows that share only the id are
    rows of their own. Vectors are compared with those of the same length. An empty table gives an empty result; a
    table with components so large that scores leave 64 bits is refused.
    """
    m = mining or Mining()
    rows = materialise(numbered(vectors, label, is_anchor, m, id_col, vector_col), "whole-vectors")
    asking = rows.filter("asks")
    centres = fit_centres(asking, m)
    none = F.lit(None).cast("array<long>").alias("limits")
    columns = ["id", "key", "label", "dim", "q"]
    better = Window.partitionBy("a_id", "a_key", "limit_score").orderBy(F.desc("score"), "id", "key")

    def merged(found: DataFrame, k: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(better)).filter(F.col("rank") <= k)

    candidates = rows.select(*columns, none)
    same = _units(candidates, asking.select(*columns, none), ["dim", "label"], m).applyInArrow(_searched(centres, m, True), FOUND)
    positives = materialise(merged(same, m.positives).select("a_id", "a_key", F.col("id").alias("positive_id"), F.col("key").alias("p_key"),
                                                            F.col("score").alias("positive_score")), "positives")
    # no score lies between the limits of a negative one; at most as many limits as positives
    limits = positives.filter("positive_score >= 0").groupBy(F.col("a_id").alias("id"), F.col("a_key").alias("key")).agg(
        F.array_sort(F.collect_set("positive_score")).alias("limits"))
    limited = materialise(asking.select(*columns).join(limits.hint("merge"), ["id", "key"]), "limits")
    other = _units(candidates, limited, ["dim"], m).applyInArrow(_searched(centres, m, False), FOUND)
    negatives = merged(other, m.negatives).select(
        "a_id", "a_key", F.col("limit_score").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    return positives.join(negatives.hint("merge"), ["a_id", "a_key", "positive_score"]).select(
        F.col("a_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")

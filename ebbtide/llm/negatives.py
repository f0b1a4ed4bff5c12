"""Hard-negative mining: for every anchor and positive, the highest-scored rows of other labels inside a score window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ebbtide.llm.common import release, row_id, stage

#: Anchors of a cell, and rows of a cell, of the grid in which scores are made.
ANCHORS, ROWS = 4096, 16384
#: Anchors whose scores against the rows of a cell are held at once.
AT_ONCE = 64


def usable(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, q array<long>, rid): rows that take part, components as floor(scale * x), stored once."""
    x = F.col(vector)
    fine = F.col(label).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    shape = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    # floor saturates at the range of long; such a component is refused when scores are made
    taken = row_id(vectors.select(vec_id, label, vector), "rid").filter(F.coalesce(fine, F.lit(False)))
    return stage(taken.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), shape.alias("q"), "rid"), "vectors")


def _grid(rows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows in blocks meet anchors in blocks: every (anchor block, row block, dimension) is one group of bounded size."""
    n_rows, n_anchors = max(rows.count(), 1), max(anchors.count(), 1)
    over, down = -(-n_rows // ROWS), -(-n_anchors // ANCHORS)
    spot = lambda parts: F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = anchors.withColumns({"dim": F.size("q"), "ga": spot(down), "gr": every(over)})
    right = rows.withColumns({"dim": F.size("q"), "gr": spot(over), "ga": every(down)})
    return left, right


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of ``a`` and ``b``."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if bound < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return a @ b.T
    raise ValueError("components are too large for scores in 64-bit integers")


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, None] == b[None, :]


def _first(score: np.ndarray, ids: np.ndarray, missing: np.ndarray, rid: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by descending score, then id (missing ids last), then row."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((rid[near], ids[near], missing[near], -score[near]))[:k]]


def _sides(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
    """Chunks of anchors with their scores against all rows of the cell."""
    b_id = right.column("id2")
    one = {c: left.column(c).to_numpy() for c in ("id", "rid", "label")}
    two = {"id": b_id.fill_null(0).to_numpy(), "none": b_id.is_null().to_numpy(), "rid": right.column("rid2").to_numpy(), "label": right.column("label2").to_numpy()}
    dim = left.column("dim")[0].as_py()
    a, b = _matrix(left.column("q"), dim), _matrix(right.column("q2"), dim)
    for at in range(0, len(a), AT_ONCE):
        yield at, one, two, _scores(a[at : at + AT_ONCE], b)


_HIT = "anchor long, arid long, score long, id long, rid long"


def _emit(held: list[tuple], two: dict) -> pa.Table:
    if not held:
        return pa.table({c: pa.array([], pa.int64()) for c in ("anchor", "arid", "score", "id", "rid")})
    place = np.concatenate([h[2] for h in held])
    size = [len(h[2]) for h in held]
    return pa.table(
        {
            "anchor": np.repeat([h[0] for h in held], size), "arid": np.repeat([h[1] for h in held], size), "score": np.concatenate([h[3] for h in held]),
            "id": pa.array(two["id"][place], pa.int64(), mask=two["none"][place]), "rid": two["rid"][place],
        }
    )


def positives(rows: DataFrame, anchors: DataFrame, first: int) -> DataFrame:
    """(anchor, arid, score, id, rid): the ``first`` other rows of the anchor's label by score; each cell gives as many, then a shuffle by anchor trims them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = []
        if left.num_rows and right.num_rows:
            for at, one, two, scores in _sides(left, right):
                fit = _same(one["label"][at : at + AT_ONCE], two["label"]) & ~_same(one["rid"][at : at + AT_ONCE], two["rid"])
                for k in range(len(scores)):
                    near = np.flatnonzero(fit[k])
                    if len(near):
                        near = near[_first(scores[k, near], two["id"][near], two["none"][near], two["rid"][near], first)]
                        held.append((one["id"][at + k], one["rid"][at + k], near, scores[k, near]))
        return _emit(held, two if held else {})

    left, right = _grid(rows, anchors)
    cells = left.groupBy("ga", "gr", "dim").cogroup(_renamed(right).groupBy("ga2", "gr2", "dim2"))
    found = cells.applyInArrow(run, _HIT)
    top = F.row_number().over(_by_anchor(F.desc("score"), F.asc_nulls_last("id"), F.asc("rid")))
    return found.withColumn("_r", top).filter(F.col("_r") <= first).drop("_r")


def _by_anchor(*order: Column) -> WindowSpec:
    return Window.partitionBy("arid").orderBy(*order)


def _renamed(rows: DataFrame) -> DataFrame:
    """The row side under its own names for the key, so that both sides of a group may come from one table."""
    return rows.select(*[F.col(c).alias(f"{c}2") for c in ("ga", "gr", "dim", "id", "label", "q", "rid")])


def candidates(rows: DataFrame, anchors: DataFrame, found: DataFrame, count: int, low: int, high: int) -> DataFrame:
    """(anchor, arid, score, id, rid): rows of other labels that may be among the first ``count`` of a window of their anchor.

    Whatever is among the first of all rows is among the first of its cell, so a cell gives at most ``count`` rows per window.
    """
    windows = found.groupBy("arid").agg(F.collect_list("score").alias("windows"))  # a few scores per anchor
    known = anchors.join(windows.withColumnRenamed("arid", "rid"), "rid")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = []
        if left.num_rows and right.num_rows:
            listed = left.column("windows").to_pylist()
            for at, one, two, scores in _sides(left, right):
                other = ~_same(one["label"][at : at + AT_ONCE], two["label"])
                for k in range(len(scores)):
                    s = scores[k]
                    taken: set[int] = set()
                    for p in set(listed[at + k]):
                        # low * p <= 100 * s <= high * p, in whole numbers without overflow
                        inside = np.flatnonzero((s >= -(-low * p // 100)) & (s <= high * p // 100) & other[k])
                        if len(inside):
                            taken.update(inside[_first(s[inside], two["id"][inside], two["none"][inside], two["rid"][inside], count)].tolist())
                    if taken:
                        near = np.array(sorted(taken))
                        held.append((one["id"][at + k], one["rid"][at + k], near, s[near]))
        return _emit(held, two if held else {})

    left, right = _grid(rows, known)
    cells = left.groupBy("ga", "gr", "dim").cogroup(_renamed(right).groupBy("ga2", "gr2", "dim2"))
    return cells.applyInArrow(run, _HIT)


def packed_key(arid: Column, score: Column, positive: Column, vec_id: Column, rid: Column) -> Column:
    """Sort key in bytes: anchor row, descending score, positives first, id (missing last), row. Bytes compare as unsigned, so signs are flipped."""
    eight = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    flip = lambda c: c.bitwiseXOR(F.lit(-(1 << 63)))
    place = F.when(positive, F.lit(0)).otherwise(F.lit(2)) + F.when(vec_id.isNull(), F.lit(1)).otherwise(F.lit(0))
    return F.concat(eight(arid), eight(F.bitwise_not(flip(score))), F.unhex(F.lpad(F.hex(place), 2, "0")), eight(flip(F.coalesce(vec_id, F.lit(0).cast("long")))), eight(rid))


class _Windows:
    """Open windows of the anchor at hand: positives met so far, and how many negatives each has had."""

    def __init__(self, count: int, low: int, high: int):
        self.count, self.low, self.high = count, low, high
        self.arid, self.open = None, []

    def anchor(self, arid: int) -> None:
        if arid != self.arid:
            self.arid, self.open = arid, []

    def take(self, anchor: int, score: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        """Negatives in descending order of score: what each open window still takes."""
        for w in self.open:
            positive, p_score, had = w
            if had < self.count:
                near = np.flatnonzero((score >= -(-self.low * p_score // 100)) & (score <= self.high * p_score // 100))[: self.count - had]
                for rank, k in enumerate(near.tolist(), had + 1):
                    yield anchor, positive, rank, ids[k], p_score, int(score[k])
                w[2] += len(near)


def mine(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives_each: int = 5, negatives_each: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id is divisible by ``every``; scores are inner products of floor(scale * component). Anchors in
    blocks meet all rows in blocks; a cell passes on only what may be among the first, so of N scores per anchor a few dozen per
    cell are shuffled. Positives and candidates are then packed into (anchor, descending score, kind, id) keys,
    partitioned by anchor and sorted within partitions; one pass over the sorted rows opens a window per positive and gives out
    negatives as they come, holding only the open windows. At equal scores positives come first, so a window of score zero
    is open before its negatives.

    Rows with a null label, a null vector or a null or non-finite component take no part; rows without id are no anchors but may be
    partners, last among ties. Repeated ids are rows of their own, ordered by place in the input; vectors of unequal length do not
    meet; empty vectors score zero among themselves. Components too large for 64-bit scores are an error. An empty table,
    or no anchor, gives no rows. Other columns are not read, whatever their names.
    """
    rows = usable(vectors, vec_id, vector, label, scale)
    anchors = rows.filter(F.col("id").isNotNull() & (F.pmod("id", F.lit(every)) == 0))
    found = stage(positives(rows, anchors, positives_each), "positives")
    near = candidates(rows, anchors, found, negatives_each, low, high)
    both = found.withColumn("positive", F.lit(True)).unionByName(near.withColumn("positive", F.lit(False)))
    keyed = both.withColumn("key", packed_key(F.col("arid"), F.col("score"), F.col("positive"), F.col("id"), F.col("rid")))
    ordered = keyed.repartition("arid").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Windows(negatives_each, low, high)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        for b in batches:
            arid, good = b.column("arid").to_numpy(), b.column("positive").to_numpy(zero_copy_only=False)
            anchor, score, ids = b.column("anchor").to_numpy(), b.column("score").to_numpy(), b.column("id").to_pylist()
            # runs of one anchor and one kind
            cuts = np.flatnonzero((arid[1:] != arid[:-1]) | (good[1:] != good[:-1])) + 1
            out = []
            for p, q in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if p == q:
                    continue
                state.anchor(arid[p])
                if good[p]:
                    state.open += [[ids[k], int(score[k]), 0] for k in range(p, q)]
                else:
                    out += state.take(int(anchor[p]), score[p:q], ids[p:q])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names)
        release()

    return ordered.select("anchor", "arid", "positive", "score", "id").mapInArrow(run, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

"""Boosted trees over binned rows: every level of a tree is one Spark job that sums histograms.

The method is that of Spark's ``GBTClassifier`` (log loss, variance gain, at most 32 bins a feature from its sampled split points), and the result
is Spark's own model. What differs is how rows are held: as blocks of binned features, a byte a feature, that are cached and summed by numpy. Residuals
are rounded to a grid on which their sums are exact, so neither the order nor the number of the parts changes a tree.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.session import shared_folder

#: Rows of a block; what is done with a block stays in the cache of a core.
BLOCK = 1 << 15
#: Bins of a feature; a sample that weighs more than its share gives a few more. Two features share a code of 16 bits.
BINS = 32
#: Last bin to the left where all rows go left.
ALL = 1 << 15
#: Rows up to which a part is not worth a task of its own.
PART = 2 * BLOCK
#: Trees after which the margins of the rows are stored anew; until then each pass adds the last trees to them.
PENDING = 3
#: Parts up to which their histograms go to the driver one by one; those of more are summed on the way.
DIRECT = 256
#: A gain below this share of the squared mean is rounding.
ROUNDING = 1e-14


@dataclass(frozen=True)
class Step:
    """A level of a tree that is cut: per place the feature and the last bin that goes left."""

    feature: tuple[int, ...]
    last: tuple[int, ...]


@dataclass(frozen=True)
class Tree:
    """A finished tree: its levels, and the value of every place below the last one, times the tree's weight."""

    steps: tuple[Step, ...]
    values: np.ndarray


class Node:
    """A node while its tree grows: sums of its rows, and what it was cut by."""

    __slots__ = ("bin", "feature", "gain", "kids", "raw", "squares", "sum", "weight")

    def __init__(self, weight: float, total: float, raw: int):
        self.weight, self.sum, self.raw, self.squares, self.gain, self.feature, self.bin, self.kids = weight, total, raw, math.nan, -1.0, -1, ALL, ()

    @property
    def mean(self) -> float:
        return self.sum / self.weight

    @property
    def impurity(self) -> float:
        return (self.squares - self.sum * self.sum / self.weight) / self.weight


def split_points(rows: DataFrame, names: tuple[str, ...], weight: str, n: int, weighted: float, seed: int, bins: int = BINS) -> list[np.ndarray]:
    """Thresholds of every feature, by the rule of Spark's trees: mid-points between values, at equal shares of the weight of the sampled rows.

    The sample is the one that Spark takes for a fit: some 10,000 rows, whatever the number of rows.
    """
    spark, wanted = rows.sparkSession, max(bins * bins, 10_000)
    share = wanted / n if wanted < n else 1.0
    some = rows.select(weight, *names)
    if share < 1.0:
        drawn = some._jdf.javaRDD().sample(False, share, spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt())
        some = DataFrame(spark._jsparkSession.createDataFrame(drawn, some._jdf.schema()), spark)
    sampled = np.array([tuple(r) for r in some.collect()], np.float64).reshape(-1, len(names) + 1)
    return [_thresholds(sampled[:, k + 1], sampled[:, 0], share * weighted, min(bins, n) - 1) for k in range(len(names))]


def _thresholds(x: np.ndarray, w: np.ndarray, weighted: float, most: int) -> np.ndarray:
    """Split points of one feature. Zeros count by what is missing from the weight that the sample should have."""
    said = x != 0
    if not said.any():
        return np.array([])
    values, place = np.unique(x[said], return_inverse=True)
    counts = np.bincount(place, weights=w[said])
    if weighted - counts.sum() > np.finfo(float).eps * said.sum() * 100:
        at = np.searchsorted(values, 0.0)
        values, counts = np.insert(values, at, 0.0), np.insert(counts, at, weighted - counts.sum())
    middle = (values[:-1] + values[1:]) / 2.0
    if len(middle) <= most:
        return middle
    stride = weighted / (most + 1)
    found, so_far, target = [], counts[0], stride
    for i, c in enumerate(counts[1:]):
        before, so_far = so_far, so_far + c
        if abs(before - target) < abs(so_far - target):
            found.append(middle[i])
            target += stride
    return np.array(found)


def binned(rows: DataFrame, names: tuple[str, ...], label: str, points: list[np.ndarray], radix: int) -> RDD:
    """Blocks of (codes of two features each, labels, margins); missing or infinite features and labels other than 0 and 1 are refused."""

    def pack(y: np.ndarray, x: list[np.ndarray]) -> tuple[bytes, bytes, bytes]:
        bins = [np.searchsorted(p, v, side="left").astype(np.uint16) for p, v in zip(points, x, strict=True)]
        bins += [np.zeros(len(y), np.uint16)] * (len(bins) % 2)
        codes = np.stack([a * np.uint16(radix) + b for a, b in zip(bins[::2], bins[1::2], strict=True)])
        return codes.tobytes(), (y == 1).astype(np.uint8).tobytes(), np.zeros(len(y)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            y, *x = (t.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in (label, *names))
            if not all(np.isfinite(v).all() for v in x) or not ((y == 0) | (y == 1)).all():
                raise ValueError("a fit takes finite features and labels of 0 and 1 only")
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in pack(y, x)], ["codes", "y", "margin"])

        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                if held and size + part.num_rows > BLOCK:
                    yield out()
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if held:
            yield out()

    blocks = rows.select(label, *names).mapInArrow(run, "codes binary, y binary, margin binary")
    return blocks.rdd.map(lambda r: (bytes(r[0]), bytes(r[1]), bytes(r[2])))


def _read(block: tuple[bytes, bytes, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, y, margin = block
    return np.frombuffer(codes, np.uint16).reshape(-1, len(y)), np.frombuffer(y, np.uint8), np.frombuffer(margin, np.float64)


def _places(codes: np.ndarray, radix: int, steps: tuple[Step, ...]) -> np.ndarray:
    """The place of every row below the given levels."""
    place = np.zeros(codes.shape[1], np.uint8 if len(steps) <= 8 else np.uint16)
    for step in steps:
        right = np.zeros(len(place), bool)
        for k, (f, last) in enumerate(zip(step.feature, step.last, strict=True)):
            if last < ALL:
                two = codes[f // 2]  # the first feature of a code is its high digit
                beyond = two - two // np.uint16(radix) * np.uint16(radix) > last if f % 2 else two > last * radix + radix - 1
                if len(step.feature) > 1:
                    beyond &= place == k
                right |= beyond
        place += place
        place += right
    return place


def _margins(codes: np.ndarray, radix: int, margin: np.ndarray, trees: tuple[Tree, ...]) -> np.ndarray:
    for t in trees:
        margin = margin + t.values.take(_places(codes, radix, t.steps))
    return margin


def _residuals(y: np.ndarray, margin: np.ndarray | None, ratio: float, scale: float) -> np.ndarray:
    """What a tree is fitted on, times the row's weight, on the grid; without margins, for the first tree, the sign of the label."""
    weighted = np.array([-scale, ratio * scale])
    if margin is None:
        return np.rint(weighted.take(y))
    under = margin * np.array([-2.0, 2.0]).take(y)
    np.exp(under, out=under)
    under += 1.0
    return np.rint((4.0 * weighted).take(y) / under)


def _tally(trees: tuple[Tree, ...], grown: int, steps: tuple[Step, ...], asked: tuple[int, ...], counted: bool, width: int, radix: int, ratio: float, scale: float) -> Callable:
    """Sums over the rows of a part: squares by place and label, and for the asked places of a level per feature and bin residuals and, if ``counted``, raw counts and positives.

    At the root also the squares of the places below the last tree, by the residuals that it was fitted on.
    """

    def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
        k, sums, rows = len(asked), None, 0
        ends = np.zeros(2 << len(steps))
        under = np.zeros(0 if steps or not grown else 2 << len(trees[-1].steps))
        slot = np.full(1 << len(steps), -1, np.intp)
        slot[list(asked)] = np.arange(k) * radix * radix
        for block in blocks:
            codes, y, margin = _read(block)
            before = _margins(codes, radix, margin, trees[:-1]) if grown else None
            if len(under):
                grid = _residuals(y, before if grown > 1 else None, ratio, scale)
                under += _squares(_places(codes, radix, trees[-1].steps), y, grid, len(under))
            if not k:
                continue
            grid = _residuals(y, _margins(codes, radix, before, trees[-1:]) if grown else None, ratio, scale)
            place = _places(codes, radix, steps)
            ends += _squares(place, y, grid, len(ends))
            if sums is None:
                sums = np.zeros((1 + counted, len(codes), k * radix * radix))
            rows += len(y)
            base = slot.take(place)
            if k < len(slot):
                at = np.flatnonzero(base >= 0)
                base, y, grid, codes = base.take(at), y.take(at), grid.take(at), codes.take(at, axis=1)
            packed = 1.0 + y * float(1 << 26) if counted else None  # rows below, positives above
            cell, size = np.empty(len(y), np.intp), sums.shape[2]
            for p, two in enumerate(codes):
                np.add(base, two, out=cell)
                sums[0, p] += np.bincount(cell, weights=grid, minlength=size)
                if counted:
                    sums[1, p] += np.bincount(cell, weights=packed, minlength=size)
        if rows >= 1 << 26:
            raise OverflowError("a part of a fit has too many rows")
        if sums is not None:
            yield (under, ends, *_by_feature(sums, k, width, radix))
        elif not k:
            yield (under,)

    return run


def _squares(place: np.ndarray, y: np.ndarray, grid: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(place.astype(np.intp) * 2 + y, weights=grid * grid, minlength=size)


def _by_feature(sums: np.ndarray, k: int, width: int, radix: int) -> tuple[np.ndarray, ...]:
    """Residuals, and raw counts and positives where there are any, per place, feature and bin, from those of pairs of features."""
    pairs = sums.reshape(len(sums), -1, k, radix, radix)
    each = np.stack([pairs.sum(axis=4), pairs.sum(axis=3)], axis=2).reshape(len(sums), -1, k, radix)[:, :width].transpose(0, 2, 1, 3)
    if len(each) == 1:
        return (each[0],)
    positives = np.floor(each[1] / (1 << 26))
    return each[0], each[1] - positives * (1 << 26), positives


def _plus(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def _summed(blocks: RDD, tally: Callable) -> tuple:
    told = blocks.mapPartitions(tally)
    if blocks.getNumPartitions() > DIRECT:
        return told.treeReduce(_plus)
    parts = told.collect()  # one histogram per part
    out = parts[0]
    for part in parts[1:]:
        out = _plus(out, part)
    return out


def _cut(total: np.ndarray, raw: np.ndarray, positives: np.ndarray, ratio: float, splits: list[int]) -> tuple[Node, tuple | None]:
    """The node of a histogram, and its best (gain, feature, bin, left, right), None if no split gains anything."""
    weight = raw - positives + positives * ratio
    whole = Node(float(weight[0].sum()), float(total[0].sum()), int(raw[0].sum()))
    wl, sl, nl = (np.cumsum(v, axis=1)[:, :-1] for v in (weight, total, raw))
    wr, sr, nr = whole.weight - wl, whole.sum - sl, whole.raw - nl
    usable = (nl >= 1) & (nr >= 1) & (wl > 0) & (wr > 0) & (np.arange(raw.shape[1] - 1)[None, :] < np.array(splits)[:, None])
    if not usable.any():
        return whole, None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(usable, (sl * sl / wl + sr * sr / wr - whole.sum * whole.sum / whole.weight) / whole.weight, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[f, b] <= ROUNDING * whole.mean**2:
        return whole, None
    left = Node(float(wl[f, b]), float(sl[f, b]), int(nl[f, b]))
    return whole, (float(gain[f, b]), int(f), int(b), left, Node(whole.weight - left.weight, whole.sum - left.sum, whole.raw - left.raw))


class Fit:
    """What all trees of a fit share: class weight, grid, split points, and the counts of all rows, which no tree changes."""

    def __init__(self, ratio: float, scale: float, splits: list[int], depth: int):
        self.ratio, self.scale, self.splits, self.depth, self.radix, self.counts = ratio, scale, splits, depth, max(splits) + 1, None

    def tally(self, trees: tuple[Tree, ...], grown: int, steps: tuple[Step, ...] = (), asked: tuple[int, ...] = ()) -> Callable:
        return _tally(trees, grown, steps, asked, bool(steps) or self.counts is None, len(self.splits), self.radix, self.ratio, self.scale)

    def squared(self, nodes: dict[int, Node], sums: np.ndarray) -> None:
        for place, node in nodes.items():
            node.squares = float(sums[2 * place] + sums[2 * place + 1] / self.ratio) / self.scale**2


def _grow(fit: Fit, blocks: RDD, trees: tuple[Tree, ...], grown: int, leaves: dict[int, Node], rate: float) -> tuple[Node, Tree, dict[int, Node]]:
    """One tree, level by level, and the nodes below its last level.

    Of two nodes below one the smaller is summed, the other is what is left; sums on the grid and counts are whole numbers, so this is exact.
    Squares, for the impurity that is stored, come with the next pass; ``leaves`` are those of the tree before.
    """
    steps, root, sums = [], None, {}
    level: dict[int, Node] = {}
    for depth in range(max(1, fit.depth)):
        asked = tuple(min((place, place + 1), key=lambda p: level[p].raw) for place in level if place % 2 == 0) if depth else (0,)
        under, squares, *found = _summed(blocks, fit.tally(trees, grown, tuple(steps), asked))
        if not depth:
            fit.squared(leaves, under)
            fit.counts = fit.counts or found[1:]
            sums = {0: tuple(x[0] for x in (found[0], *fit.counts))}
            level[0] = root = _cut(found[0][0] / fit.scale, *sums[0][1:], fit.ratio, fit.splits)[0]
        else:
            seen = {place: tuple(x[i] for x in found) for i, place in enumerate(asked)}
            sums = seen | {place ^ 1: tuple(a - b for a, b in zip(sums[place // 2], s, strict=True)) for place, s in seen.items()}
        fit.squared(level, squares)
        feature, last, below = [0] * (1 << depth), [ALL] * (1 << depth), {}
        for place, node in level.items():
            total, *counts = sums[place]
            _, best = _cut(total / fit.scale, *counts, fit.ratio, fit.splits)
            if best and fit.depth and abs(node.impurity) >= np.finfo(float).eps:
                node.gain, node.feature, node.bin, *node.kids = best
                feature[place], last[place] = node.feature, node.bin
                below[2 * place], below[2 * place + 1] = node.kids
        level = below
        if not below:
            break
        steps.append(Step(tuple(feature), tuple(last)))
    values = np.zeros(1 << len(steps))

    def fill(node: Node, place: int, under: int) -> None:
        if not node.kids:
            values[place << under] = node.mean * rate  # a leaf's rows go left from there on
            return
        for side, kid in enumerate(node.kids):
            fill(kid, 2 * place + side, under - 1)

    fill(root, 0, len(steps))
    return root, Tree(tuple(steps), values), level


def _pruned(node: Node) -> None:
    """Leaves of equal value below one node become that node's."""
    for kid in node.kids:
        _pruned(kid)
    if node.kids and not node.kids[0].kids and not node.kids[1].kids and node.kids[0].mean == node.kids[1].mean:
        node.kids, node.gain = (), -1.0


def _stored(root: Node, points: list[np.ndarray]) -> list[tuple]:
    """Nodes of a tree in the form and order in which Spark stores them."""
    rows: list[tuple] = []

    def put(node: Node) -> int:
        at = len(rows)
        rows.append(())
        kids = [put(k) for k in node.kids] or [-1, -1]
        cut = (node.feature, [float(points[node.feature][node.bin])], -1) if node.kids else (-1, [], -1)
        rows[at] = (at, node.mean, node.impurity, [node.weight, node.sum, node.squares], node.raw, node.gain, *kids, cut)
        return at

    _pruned(root)
    put(root)
    return rows


def _model(spark, told: GBTClassifier, roots: list[Node], points: list[np.ndarray], rate: float) -> GBTClassificationModel:
    """Spark's model of the given trees, by way of the form in which it is stored."""
    path = shared_folder(spark, "boosted")
    named = lambda params: {p.name: v for p, v in params.items()}
    head = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    whole = {"class": "org.apache.spark.ml.classification.GBTClassificationModel", **head, "uid": told.uid, "paramMap": named(told._paramMap), "defaultParamMap": named(told._defaultParamMap), "numFeatures": len(points), "numTrees": len(roots)}
    ours = {"featuresCol", "labelCol", "maxDepth", "weightCol"}
    tree = {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", **head, "paramMap": {k: v for k, v in whole["paramMap"].items() if k in ours}, "defaultParamMap": {}}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    trees = [(i, json.dumps({**tree, "uid": f"dtr_{told.uid}_{i}"}), rate if i else 1.0) for i in range(len(roots))]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    node = "struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
    rows = [(i, row) for i, root in enumerate(roots) for row in _stored(root, points)]
    spark.createDataFrame(rows, f"treeID int, nodeData {node}").coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


def fit(rows: DataFrame, names: tuple[str, ...], label: str, weight: str, ratio: float, told: GBTClassifier) -> GBTClassificationModel:
    """The model that ``told`` describes, fitted on stored ``rows`` whose positives weigh ``ratio`` and whose negatives weigh 1.

    A level of a tree reads every block once and sends one histogram per part; the driver holds trees and sums only. Blocks take some 30 bytes a
    row, in memory or else on disk.
    """
    spark, trees, rate = rows.sparkSession, told.getMaxIter(), told.getStepSize()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")).first()
    if not size["n"]:
        raise ValueError("a fit takes one row or more")
    points = split_points(rows, names, weight, size["n"], size["w"], told.getSeed())
    splits = [len(p) for p in points]
    # a residual is 4 at most: on this grid a sum over all rows is a whole number below 2^52
    scale = 2.0 ** math.floor(52 - math.log2(4.0 * max(1.0, ratio) * size["n"]))
    shared = Fit(ratio, scale, splits, told.getMaxDepth())
    blocks = binned(rows, names, label, points, shared.radix)
    blocks = blocks.coalesce(max(1, min(blocks.getNumPartitions(), -(-size["n"] // PART)))).persist(StorageLevel.MEMORY_AND_DISK)
    roots, pending, leaves = [], (), {}
    try:
        for k in range(trees):
            old = None
            if len(pending) > PENDING:  # the last tree stays, for the squares below it
                old, blocks, pending = blocks, blocks.map(_advance(pending[:-1], shared.radix)).persist(StorageLevel.MEMORY_AND_DISK), pending[-1:]
            root, tree, leaves = _grow(shared, blocks, pending, k, leaves, rate if k else 1.0)
            if old is not None:
                old.unpersist()
            roots.append(root)
            pending = (*pending, tree)
        if leaves:
            shared.squared(leaves, _summed(blocks, shared.tally(pending, trees))[0])
    finally:
        blocks.unpersist()
    return _model(spark, told, roots, points, rate)


def _advance(trees: tuple[Tree, ...], radix: int) -> Callable:
    def run(block: tuple[bytes, bytes, bytes]) -> tuple[bytes, bytes, bytes]:
        codes, _, margin = _read(block)
        return block[0], block[1], _margins(codes, radix, margin, trees).tobytes()

    return run

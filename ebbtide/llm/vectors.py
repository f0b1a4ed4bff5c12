"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import fixed, row_id, stage
from ebbtide.llm.components import components, fold

#: Vectors that the centroids are fitted on, at most.
SAMPLE = 20_000
#: Cells at most; beyond, cells hold more vectors and are cut into more blocks.
MAX_CELLS = 4096
#: Vectors of a cell that are compared with as many others at once.
BLOCK = 1024
#: Blocks of vectors that are stored as one row, and met with those of another row by one task.
STORED = 16


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _key(vector: Column) -> Column:
    """Hash of a vector; equal vectors have equal ones."""
    return F.xxhash64(vector)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, by the largest component first so that no square overflows."""
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors: assign by cosine, average, scale back; empty cells keep their place."""
    centres = x[np.random.default_rng(0).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def _homes(nodes: DataFrame, told: Broadcast, kind: type) -> DataFrame:
    """Home cell of every vector, which keeps its own components and type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = told.value[0]
        for b in batches:
            vectors = b.column("v").to_pylist()
            home, packed = [0] * len(vectors), [None] * len(vectors)
            lengths = np.array([len(v) for v in vectors])
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                x = np.array([vectors[i] for i in at], kind)
                for r, (i, best) in enumerate(zip(at.tolist(), (unit(x) @ models[d].T).argmax(axis=1).tolist(), strict=True)):
                    home[i], packed[i] = best, x[r].tobytes()
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), pa.array(lengths, pa.int32()), pa.array(home, pa.int32()), pa.array(packed, pa.binary())], ["node", "n", "dim", "home", "x"])

    return nodes.mapInArrow(run, "node long, n long, dim int, home int, x binary")


class Block:
    """Vectors of neighbouring cells in the order of cells, with the cells that they live in."""

    def __init__(self, model: tuple, d: int, node: bytes, n: bytes, home: bytes, x: bytes, kind: type):
        self.centres, self.margin = model[0][d], model[1][d]
        self.node, self.n, self.home = np.frombuffer(node, np.int64), np.frombuffer(n, np.int64), np.frombuffer(home, np.int32)
        self.x = unit(np.frombuffer(x, kind).reshape(len(self.node), -1))
        self.cells, self.first, self.at = np.unique(self.home, return_index=True, return_inverse=True)

    def visits(self, cells: np.ndarray, chord: float) -> np.ndarray:
        """Vectors x cells: whether a vector visits a cell.

        It visits each cell whose border (the plane half-way between the two centroids) is nearer than the margin: a partner
        whose home lies there may be as close. Its own cell is among them.
        """
        mine, theirs = self.centres[self.cells], self.centres[cells]
        apart = np.sqrt(np.maximum(2 - 2 * mine @ theirs.T, 1e-18))
        wide = np.where(apart < 3 * chord, chord / 2, self.margin) * apart
        own = (self.x * self.centres[self.home]).sum(axis=1)
        return (own[:, None] - self.x @ theirs.T <= wide[self.at]) | (self.home[:, None] == cells[None, :])


def _blocks(homes: DataFrame, told: Broadcast, chord: float, kind: type) -> DataFrame:
    """Sorted vectors as rows of at most STORED blocks of one length, with the cells they live in and those they visit."""
    most = STORED * BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, d = [], 0, None

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            node, n, home = (t.column(c).to_numpy() for c in ("node", "n", "home"))
            packed = node.astype(np.int64).tobytes(), n.astype(np.int64).tobytes(), home.astype(np.int32).tobytes(), b"".join(t.column("x").to_pylist())
            block = Block(told.value, d, *packed, kind)
            every = np.arange(len(block.centres))
            seen = np.flatnonzero(np.concatenate([block.visits(every[k : k + BLOCK], chord).any(axis=0) for k in range(0, len(every), BLOCK)]))
            columns = [pa.array([v]) for v in (int(node.min()), d)] + [pa.array([v], pa.list_(pa.int32())) for v in (block.cells.tolist(), seen.tolist())] + [pa.array([v], pa.binary()) for v in packed]
            return pa.RecordBatch.from_arrays([columns[0], columns[1].cast(pa.int32()), *columns[2:]], ["b", "dim", "cells", "seen", "node", "n", "home", "x"])

        for b in batches:
            lengths, at = b.column("dim").to_numpy(), 0
            while at < b.num_rows:
                if held and (lengths[at] != d or size == most):
                    yield out()
                    held, size = [], 0
                d = int(lengths[at])
                other = np.flatnonzero(lengths[at:] != d)
                take = min(int(other[0]) if len(other) else b.num_rows - at, most - size)
                held.append(b.slice(at, take))
                size, at = size + take, at + take
        if held:
            yield out()

    return homes.mapInArrow(run, "b long, dim int, cells array<int>, seen array<int>, node binary, n binary, home binary, x binary")


def _compare(a: Block, b: Block, chord: float, cosine: float) -> pa.Table:
    """Links between the vectors of two rows of blocks, or of one with itself: links of each vector, and a star per group.

    The residents of a cell meet those that visit it. Each resident counts its partners there. A visitor's partner is
    counted for the visitor too, unless the resident visits the visitor's home, where it is counted already.
    """
    alone = a is b
    offset = 0 if alone else len(a.node)
    node = a.node if alone else np.concatenate([a.node, b.node])
    links, labels = np.zeros(len(node), np.int64), np.arange(len(node))
    seen = {0: b.visits(a.cells, chord)}
    seen[1] = seen[0] if alone else a.visits(b.cells, chord)
    for here, there, side, mine, theirs in ((a, b, 0, 0, offset), (b, a, 1, offset, 0))[: 1 if alone else 2]:
        for k, (first, end) in enumerate(zip(here.first, [*here.first[1:], len(here.node)], strict=True)):
            visitors = np.flatnonzero(seen[side][:, k])
            for r in range(int(first), int(end), BLOCK):
                some = here.x[r : min(r + BLOCK, int(end))]
                for g in range(0, len(visitors), BLOCK):
                    guests = visitors[g : g + BLOCK]
                    i, j = np.nonzero(some @ there.x[guests].T >= cosine)
                    i, j = i + r, guests[j]
                    if alone:
                        i, j = i[i != j], j[i != j]
                    if not len(i):
                        continue
                    np.add.at(links, i + mine, there.n[j])
                    once = ~seen[1 - side][i, there.at[j]]
                    np.add.at(links, j[once] + theirs, here.n[i[once]])
                    labels = fold(labels, i + mine, j + theirs)
    used = np.flatnonzero((links > 0) | (labels != np.arange(len(node))))
    return pa.table({"node": node[used], "links": links[used], "root": node[labels[used]]})


def _met(blocks: DataFrame, told: Broadcast, chord: float, cosine: float, kind: type) -> DataFrame:
    """What every two rows of blocks give, one of which has visitors for the other.

    They are read where they are stored, once per pair of parts, and nothing is shuffled: a vector is never copied for the cells it visits.
    """
    names = ("node", "n", "home", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                a = Block(told.value, get("l_dim"), *(get(f"l_{c}") for c in names), kind)
                b = a if get("l_b") == get("r_b") else Block(told.value, get("r_dim"), *(get(f"r_{c}") for c in names), kind)
                yield from _compare(a, b, chord, cosine).to_batches()

    left, right = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "lr")
    near = F.arrays_overlap("l_cells", "r_seen") | F.arrays_overlap("r_cells", "l_seen")
    pairs = left.hint("shuffle_replicate_nl").join(right, (F.col("l_dim") == F.col("r_dim")) & (F.col("l_b") <= F.col("r_b")) & near)
    return pairs.select("l_b", "r_b", "l_dim", "r_dim", *[f"{side}_{c}" for side in "lr" for c in names]).mapInArrow(run, "node long, links long, root long")


def near_vectors(vectors: DataFrame, cosine: float = 0.95, sample: int = SAMPLE, sigmas: float = math.inf) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors with a cosine of at least ``cosine`` in double precision are linked, whatever their labels; equal
    vectors are one node with a count. Centroids are fitted on at most ``sample`` vectors, chosen by
    hash; every vector is assigned. A pair parted by a cell border is found if the border is within the margin
    of either, and one of them is within half of what their difference measures across the border. That is the chord of
    the angle at most, so half the chord is the margin, whatever the directions of the differences. A finite ``sigmas``
    takes that many times sqrt(1/d) of the chord between centroids further apart than three chords: fewer visits, but it loses
    pairs of vectors that lie in few of their d dimensions.

    Null, zero, non-finite vectors and such with null components are rows without links, each its own component.
    Vectors of other lengths are compared among themselves only. Rows without id take part, but name
    a component only if all its rows lack an id. Repeated rows link like any equal vectors.
    """
    rows = row_id(fixed(vectors.select("vec_id", F.col("embedding").alias("v")), "vectors")).withColumn("_ok", usable(F.col("v")))
    good = rows.filter("_ok")
    nodes = stage(good.groupBy("v").agg(F.min("_rid").alias("node"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low")), "nodes")
    sizes = {r["d"]: r["n"] for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length of vector
    chord, models, margin = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9, {}, {}  # rounding never parts a pair on the bound
    for d, n in sizes.items():
        share = min(1.0, sample / n)
        some = nodes.filter((F.size("v") == d) & (F.pmod(F.xxhash64("v"), F.lit(1 << 30)) <= int(share * (1 << 30)))).select("v").limit(sample).toPandas()["v"]
        x = unit(np.stack(some.to_list())) if len(some) else np.ones((1, d)) / math.sqrt(d)
        models[d] = spherical_kmeans(x, max(1, min(MAX_CELLS, len(x), n // BLOCK * 2)))
        margin[d] = min(chord, sigmas * chord / math.sqrt(d)) / 2
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    context = vectors.sparkSession.sparkContext
    told = context.broadcast((models, margin))  # MAX_CELLS centroids per length of vector
    kind = np.float32 if dict(rows.dtypes)["v"] == "array<float>" else np.float64
    total = sum(sizes.values())
    parts = max(-(-total // (STORED * BLOCK)), min(-(-total // BLOCK), 2 * context.defaultParallelism))
    # by the hash of the node too, so that a cell with very many vectors is cut evenly
    homes = _homes(nodes.select("node", "n", "v"), told, kind).repartitionByRange(parts, "dim", "home", F.xxhash64("node")).sortWithinPartitions("dim", "home")
    blocks = stage(_blocks(homes, told, chord, kind), "blocks")
    met = stage(_met(blocks, told, chord, cosine, kind), "links")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(met.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = nodes.select("node", "n", "low", _key(F.col("v")).alias("h")).join(links, "node", "left").join(groups, "node", "left")
    named = stage(named.select("node", "h", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "named")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    names = named.join(lows, "root").select("node", "h", "n_links", "component_id")
    asked = good.select("vec_id", "v", _key(F.col("v")).alias("h"))
    shared = named.groupBy("h").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("h")
    # a row is the one node of its hash; only where nodes share a hash are vectors moved to tell which
    if shared.isEmpty():
        linked = asked.select("vec_id", "h").join(names, "h")
    else:
        told_apart = names.join(shared, "h", "left_semi").join(nodes.select("node", "v"), "node")
        linked = asked.select("vec_id", "h").join(names.join(shared, "h", "left_anti"), "h").select("vec_id", "n_links", "component_id")
        linked = linked.unionByName(asked.join(told_apart, ["h", "v"]).select("vec_id", "n_links", "component_id"))
    linked = linked.select("vec_id", "n_links", "component_id")
    alone = rows.filter("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

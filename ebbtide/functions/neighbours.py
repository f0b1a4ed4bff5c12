"""Exact k-nearest join of a table with itself: pivots, blocks along rings, and bounds from the triangle inequality."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.functions.ranking import global_position
from ebbtide.session import cut_lineage

#: Points taken as pivots, at most; they and the blocks below are all that is sent to every task.
PIVOTS = 256
#: Points of a block, at least; more where there would be over ``MAX_BLOCKS`` blocks.
BLOCK, MAX_BLOCKS = 2048, 65_536
#: Guard against rounding in the bounds, relative to the numbers they are made of.
SLACK = 1e-9


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, summed dimension by dimension, so that equal points are at exactly zero."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = a[:, d, None] - b[None, :, d]
        out += gap * gap
    return out


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


@dataclass(frozen=True)
class _Pieces:
    """Parts of blocks inside one cell: block, cell, least and greatest distance from the pivot; and the pivots."""

    block: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    pivots: np.ndarray

    def visits(self, x: np.ndarray, own: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Rows x pieces: pieces that may hold a point within ``reach`` of a row.

        A point of a piece lies in a ring around the piece's pivot, and on that pivot's side of the plane between the two pivots.
        """
        to = np.sqrt(_squares(x, self.pivots))
        mine = to[np.arange(len(x)), own]
        apart = np.sqrt(_squares(self.pivots[own], self.pivots))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (to * to - (mine * mine)[:, None]) / (2 * apart), 0.0)
        slack = SLACK * (1.0 + to + mine[:, None])
        ring = np.maximum(self.low[None] - to[:, self.cell], to[:, self.cell] - self.high[None])
        return np.maximum(ring, plane[:, self.cell]) - slack[:, self.cell] <= reach[:, None]


def _nearest(d: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least by (distance, id) of a row of distances."""
    if len(d) > k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        near = np.arange(len(d))
    return near[np.lexsort((first[near], d[near]))[:k]]


def _found(queries: pa.Table, data: pa.Table, k: int, name: str) -> pa.Table:
    """The ``k`` nearest points of a block for each query, as (rep, other, square) rows; a point is not its own neighbour."""
    rep, other = queries.column("rep").to_numpy(), data.column(f"rep{name}").to_numpy()
    x, y = _matrix(queries.column("z")), _matrix(data.column(f"z{name}"))
    out = []
    for at in range(0, len(x), 256):
        squares = _squares(x[at : at + 256], y)
        squares[rep[at : at + 256, None] == other[None, :]] = np.inf
        for i in range(len(squares)):
            near = _nearest(squares[i], other, k)
            near = near[np.isfinite(squares[i, near])]
            out.append((np.full(len(near), rep[at + i]), other[near], squares[i, near]))
    cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, t) for c, t in ((0, np.int64), (1, np.int64), (2, float))]
    return pa.table(dict(zip(("rep", "other", "square"), (pa.array(c) for c in cols), strict=True)))


_PAIR = "rep long, other long, square double"


def nearest_join(points: DataFrame, k: int, id: str = "_id", vector: str = "z", pivots: int = PIVOTS, seed: int = 42) -> DataFrame:
    """(id, rank, other, distance): the ``k`` nearest other points of every point, ties by the lesser id; exact.

    ``id`` is a unique long, ``vector`` an array of finite doubles of one length. Equal vectors are one point with its first
    k+1 ids, for no list can hold more of them; so copies of one vector, however many, are no hot group. Points are
    ordered by (nearest pivot, distance from it) and cut into blocks of bounded size. First each point looks into its own
    block, which bounds how far its neighbours can be; then it visits the blocks whose rings and half-spaces come
    within that bound. Nothing is dropped: a bound that excludes nothing leads to all blocks. Fewer than k+1 points give
    shorter lists; an empty table gives no rows.
    """
    spark = points.sparkSession
    base = cut_lineage(points.select(F.col(id).cast("long").alias("id"), F.transform(vector, lambda v: v.cast("double") + 0.0).alias("z")))
    first = Window.partitionBy("z").orderBy("id")
    some = base.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k + 1)  # trimmed before the shuffle
    groups = cut_lineage(some.groupBy("z").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]))

    chosen = groups.select("z", F.xxhash64("rep", F.lit(seed)).alias("h"), "rep").orderBy("h", "rep").limit(pivots).collect()  # bounded by ``pivots``
    if not chosen:
        return base.select("id", F.lit(1).alias("rank"), F.col("id").alias("other"), F.lit(0.0).alias("distance"))
    centres = spark.sparkContext.broadcast(np.array([r["z"] for r in chosen]))

    @F.arrow_udf("struct<cell:int,away:double>")
    def placed(col: pa.Array) -> pa.Array:
        x = _matrix(col)
        cell, away = np.zeros(len(x), np.int32), np.zeros(len(x))
        for at in range(0, len(x), 1024):
            squares = _squares(x[at : at + 1024], centres.value)
            cell[at : at + 1024] = squares.argmin(1)
            away[at : at + 1024] = np.sqrt(squares.min(1))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(away)], ["cell", "away"])

    spots = groups.select("rep", "z", placed("z").alias("p")).select("rep", "z", "p.cell", "p.away")
    ordered = global_position(spots, ["cell", "away", "rep"], "_pos")
    size = max(BLOCK, -(-groups.count() // MAX_BLOCKS))
    data = cut_lineage(ordered.withColumn("block", F.floor(F.col("_pos") / size).cast("long")).drop("_pos"))

    # own block: neighbours there, and how far the k-th of them is
    own = data.groupBy("block").applyInArrow(lambda t: _found(t, t.rename_columns({"rep": "rep2", "z": "z2"}).select(["rep2", "z2"]), k, "2"), _PAIR)
    own = cut_lineage(own)
    reach = own.groupBy("rep").agg(F.when(F.count("square") >= k, F.sqrt(F.max("square"))).alias("reach"))
    parts = data.groupBy("block", "cell").agg(F.min("away").alias("low"), F.max("away").alias("high")).orderBy("block", "cell").collect()  # blocks and pivots at most
    told = spark.sparkContext.broadcast(_Pieces(*[np.array([r[c] for r in parts]) for c in ("block", "cell", "low", "high")], centres.value))

    @F.arrow_udf("array<long>")
    def visited(z: pa.Array, cell: pa.Array, block: pa.Array, far: pa.Array) -> pa.Array:
        pieces, x, out = told.value, _matrix(z), []
        here, home, bound = cell.to_numpy(), block.to_numpy(), far.fill_null(np.inf).to_numpy(zero_copy_only=False)
        step = max(1, (1 << 22) // (len(pieces.block) + len(pieces.pivots)))
        for at in range(0, len(x), step):
            near = pieces.visits(x[at : at + step], here[at : at + step], bound[at : at + step])
            out += [[int(b) for b in np.unique(pieces.block[row]) if b != h] for row, h in zip(near, home[at : at + step].tolist(), strict=True)]
        return pa.array(out, pa.list_(pa.int64()))

    queries = data.join(reach, "rep", "left")
    visits = queries.select("rep", "z", F.explode(visited("z", "cell", "block", "reach")).alias("goal"))
    visits = cut_lineage(visits)
    # a block that very many points visit is met by several tasks, each with the whole block
    crowds = visits.groupBy("goal").agg(F.ceil(F.count(F.lit(1)) / (4 * size)).cast("int").alias("tasks"))
    asked = visits.join(F.broadcast(crowds), "goal").withColumn("task", F.pmod(F.xxhash64("rep"), F.col("tasks")).cast("int"))  # a row per block
    shown = data.join(F.broadcast(crowds), F.col("block") == F.col("goal")).select(
        F.col("block").alias("goal2"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task2"), F.col("rep").alias("rep2"), F.col("z").alias("z2")
    )
    far = asked.groupBy("goal", "task").cogroup(shown.groupBy("goal2", "task2")).applyInArrow(lambda q, d: _found(q, d, k, "2"), _PAIR)

    pairs = own.unionByName(far)
    known = pairs.join(groups.select(F.col("rep").alias("other"), F.col("ids").alias("theirs")), "other")
    each = known.select("rep", F.explode("theirs").alias("n"), "square")
    best = each.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy("square", "n"))).filter(F.col("_r") <= k)
    lists = best.groupBy("rep").agg(F.collect_list(F.struct("square", "n")).alias("near"))
    full = groups.join(lists, "rep", "left").select("z", F.array_sort(F.concat(F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("square"), i.alias("n"))), F.coalesce("near", F.array()))).alias("near"))
    # back to every point: its own copies first, then the others
    mine = base.join(full, "z").select("id", F.slice(F.filter("near", lambda s: s["n"] != F.col("id")), 1, k).alias("near"))
    return mine.select("id", F.posexplode("near").alias("p", "s")).select("id", (F.col("p") + 1).alias("rank"), F.col("s.n").alias("other"), F.sqrt("s.square").alias("distance"))

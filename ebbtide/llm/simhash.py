"""SimHash near-dedup: fingerprints of word shingles, linked by a binary trie self-join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import fixed, fresh, release, row_id, small_side, stage
from ebbtide.llm.components import components, fold

BITS = 64
HALF = 32
SEED = 42


def fingerprint(text: str | None, k: int = 3) -> int:
    """SimHash of the k-word shingles of a text as an unsigned number; no words give 0.

    Bytes split at space and tab to carriage return and lower-case A-Z only, as the words ask for.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(k, len(words)) - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(_rid, doc_id, fp) for every row; fp is the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), k) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("_rid"), b.column("doc_id"), pa.array(fps.view(np.int64))], ["_rid", "doc_id", "fp"])
        release()

    rows = row_id(docs.select("doc_id", "text"))
    return rows.mapInArrow(run, f"_rid long, doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _cells(rows: DataFrame, depth: int, more: int) -> DataFrame:
    """Send fingerprints of cells at trie level ``depth`` down by ``more`` levels.

    A cell is a pair of trie nodes (lo, hi) of one level: the same node twice, or two nodes that
    differ in one bit. Within the first half of the bits one error is allowed, so a fingerprint of
    a (node, node) cell goes to its child and to the pairs of its child with each node one new bit
    away; in a cell that has used its error both sides must take the same new bits.
    """
    prefix = F.shiftrightunsigned("_bits", BITS - depth - more) if depth + more else F.lit(0).cast("long")
    flips = F.array(*[F.lit(1 << b) for b in range(more)]).cast("array<long>") if more else F.array().cast("array<long>")
    own = F.array(F.struct(prefix.alias("lo"), prefix.alias("hi")))
    near = F.transform(flips, lambda f: F.struct(F.least(prefix, prefix.bitwiseXOR(f)).alias("lo"), F.greatest(prefix, prefix.bitwiseXOR(f)).alias("hi")))
    low = prefix.bitwiseAND((1 << more) - 1)
    kept = F.array(F.struct((F.shiftleft("lo", more).bitwiseOR(low)).alias("lo"), (F.shiftleft("hi", more).bitwiseOR(low)).alias("hi")))
    cells = F.when(F.col("lo") == F.col("hi"), F.concat(own, near)).otherwise(kept)
    return rows.select("_turn", "_bits", F.explode(cells).alias("_c")).select("_turn", "_bits", F.lit(depth + more).alias("_depth"), "_c.lo", "_c.hi")


def _pairs(bits: np.ndarray, depth: int, lo: int, hi: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked fingerprints of one cell: traverse pairs of trie nodes together.

    ``bits`` is sorted, so a trie node is a range. A pair of ranges keeps the bits by which its
    nodes differ; each level adds one bit, and a pair goes as soon as it has more errors than
    allowed: one in the first half, ``radius`` below. Pairs of few fingerprints are compared at once.
    """
    n = len(bits)
    if lo == hi:
        front = np.array([[0, n, 0, n, 0]], np.int64)
    else:
        cut = int(np.searchsorted(bits, np.uint64(hi << (BITS - depth))))
        front = np.array([[0, cut, cut, n, 1]], np.int64)
    while len(front):
        a0, a1, b0, b1, _ = front.T
        few = ((a1 - a0) * (b1 - b0) <= 64) | (depth >= BITS)
        small, front = front[few], front[~few]
        for at in range(0, len(small), 50_000):
            part = small[at : at + 50_000]
            na, nb = part[:, 1] - part[:, 0], part[:, 3] - part[:, 2]
            count = na * nb
            which = np.repeat(np.arange(len(part)), count)
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            i, j = part[which, 0] + k // nb[which], part[which, 2] + k % nb[which]
            near = (i != j) & (np.bitwise_count(bits[i] ^ bits[j]) <= radius)
            yield i[near], j[near]
        if not len(front):
            break
        ones = np.concatenate(([0], np.cumsum((bits >> np.uint64(BITS - 1 - depth)) & np.uint64(1)).astype(np.int64)))
        depth += 1
        a0, a1, b0, b1, e = front.T
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        apart = ~same
        allowed = 1 if depth <= HALF else radius
        front = np.concatenate([
            np.stack([a0, am, b0, bm, e], 1), np.stack([am, a1, bm, b1, e], 1), np.stack([a0, am, bm, b1, e + 1], 1), np.stack([am, a1, b0, bm, e + 1], 1)[apart],
        ])
        front = front[(front[:, 0] < front[:, 1]) & (front[:, 2] < front[:, 3]) & (front[:, 4] <= allowed)]
        front = front[~((front[:, 0] == front[:, 2]) & (front[:, 1] - front[:, 0] == 1) & (front[:, 3] - front[:, 2] == 1))]


def _tie(key: tuple, cell: pa.Table, radius: int) -> pa.Table:
    """Links of one cell, reduced to a star per group: (u, v) with v the least of the group."""
    turn, depth, lo, hi = (k.as_py() for k in key)
    bits = np.sort(cell.column("_bits").to_numpy().view(np.uint64))
    labels = np.arange(len(bits))
    for i, j in _pairs(bits, depth, lo, hi, radius):
        labels = fold(labels, i, j)
    tied = np.flatnonzero(labels != np.arange(len(bits)))
    if turn:
        bits = (bits << np.uint64(HALF)) | (bits >> np.uint64(HALF))
    return pa.table({"u": bits[tied].view(np.int64), "v": bits[labels[tied]].view(np.int64)})


def linked_fingerprints(fps: DataFrame, radius: int = 3, cell: int = 4096) -> DataFrame:
    """Distinct ``fp`` -> (node, root): groups of fingerprints chained by at most ``radius`` (3 or fewer) differing bits.

    Two fingerprints within three bits have at most one error in one of their halves. So two tries
    are joined with themselves, one per half first, each with one error allowed until the half
    ends. The top of the trie is expanded as rows until a node holds about ``cell`` fingerprints; node
    pairs that hold more go further down, level by level, so no group is collected whole. Below,
    each pair of nodes is traversed in its task, which returns a star per group, not all pairs.
    """
    if not 0 <= radius <= 3:
        raise ValueError("one error in a half is enough for a radius of 0 to 3")
    n = fps.count()
    depth = min(HALF, max(0, math.ceil(math.log2(max(1, n) / cell))))
    turned = F.shiftleft("fp", HALF).bitwiseOR(F.shiftrightunsigned("fp", HALF))
    both = fps.select(F.lit(0).alias("_turn"), F.col("fp").alias("_bits")).union(fps.select(F.lit(1).alias("_turn"), turned.alias("_bits")))
    rows = _cells(both.withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(0).cast("long")}), 0, depth)
    key, done = ["_turn", "_depth", "lo", "hi"], []
    while True:
        full = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 8 * cell).drop("_n")
        full = stage(full, "full-cells") if depth < HALF else full.limit(0)
        if depth >= HALF or full.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(full, key, "left_anti"))
        more = min(4, HALF - depth)
        rows, depth = stage(_cells(rows.join(full, key, "left_semi"), depth, more), "deeper-cells"), depth + more
    cells = done[0]
    for part in done[1:]:
        cells = cells.unionByName(part)
    links = cells.groupBy(*key).applyInArrow(lambda k, t: _tie(k, t, radius), "u long, v long")
    return components(links)


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """Per row: _rid, doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable), _root (names the group).

    Texts are whole; null, empty and blank texts have fingerprint 0 and are linked like any other. Fewer than
    ``k`` words are one shingle. Equal fingerprints, so repeated rows too, are one node. Rows without id take part but never
    name a component unless all its rows lack an id. An empty table gives no rows; other columns
    are not read.
    """
    rows = stage(fingerprints(docs, k), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    groups = stage(linked_fingerprints(nodes.select("fp"), radius), "groups")
    named = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    # one row per fingerprint on this side; a fingerprint with very many rows is split by adaptive skew handling
    names = named.join(lows, "root").select("fp", "component_id", F.col("root").alias("_root"))
    return rows.join(names, "fp").select("_rid", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "_root")


def deduplicated(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """One document of each group, the first row with the least id, in the columns of ``docs``.

    The rows to drop are stored and anti-joined; texts are shuffled only if that list is too long to broadcast.
    """
    docs = fixed(docs)
    rows = stage(near_duplicates(docs, k, radius), "near-duplicates")
    # rows that carry their group's least id (or none, where no row has one); the first of them stays
    first = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("_root").agg(F.min("_rid").alias("_rid"))
    drop = stage(rows.join(first, "_rid", "left_anti").select("_rid"), "dropped")
    rid = fresh(docs)
    return row_id(docs, rid).join(small_side(drop.select(F.col("_rid").alias(rid))), rid, "left_anti").drop(rid)

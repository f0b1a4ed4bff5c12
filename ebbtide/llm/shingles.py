"""Near copies by Jaccard similarity of word shingles: min-hash bands find candidates, whole sets confirm them."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm import simhash
from ebbtide.llm.common import fixed, fresh, release, row_id, small_side, stage
from ebbtide.llm.components import components

SEED = 42
#: Bands of a sketch and least values of a band. Sets of similarity s meet with probability 1 - (1 - s ** 8) ** 32: 0.997 at 0.8, 0.08 at 0.5.
BANDS, ROWS = 32, 8


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; words as in :func:`simhash.fingerprint`, fewer than k are one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(k, len(words)) - 1 :].tolist(), strict=True)), np.uint64, n))


@functools.cache
def _turns() -> tuple[np.ndarray, np.ndarray]:
    """Fixed pseudo-random numbers that turn one hash into another, a pair for each least value."""
    made = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
    return made[0], made[1] | np.uint64(1)


def bands(found: np.ndarray) -> list[int]:
    """Keys of the bands of a set: hashes of ROWS least values each; no shingles give none."""
    if not len(found):
        return []
    flip, factor = _turns()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1024):
        np.minimum(least, ((found[None, at : at + 1024] ^ flip) * factor).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(part.tobytes(), band) - (1 << 63) for band, part in enumerate(least.reshape(BANDS, ROWS))]


def majority(found: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if over half of the hashes have it; as a signed number."""
    ones = np.zeros(simhash.BITS, np.int64)
    for at in range(0, len(found), 8192):
        ones += np.unpackbits(found[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view(np.int64)[0])


def parities(found: np.ndarray) -> bytes:
    """One bit per low bits of a hash, as many as the next power of two of the shingles (64 at least): whether an odd number has them."""
    bits = max(64, 1 << max(0, len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A number that two sets of these parities differ by in their shingles at least; the longer is folded to the shorter."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _confirmed(pairs: DataFrame, marks: DataFrame, rows: DataFrame, k: int, similarity: float) -> DataFrame:
    """(u, v) of ``pairs`` whose whole shingle sets have at least the similarity.

    ``marks`` (node, n, odd) has the parities of each set; pairs whose parities differ in more places than the sets may
    differ in shingles go first, and only the texts of the others are read again.
    """

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (b.column("n1").to_numpy().astype(float) + b.column("n2").to_numpy()) * (1 - similarity) / (1 + similarity) + 1e-6
            keep = [differing(x.as_py(), y.as_py()) <= m for x, y, m in zip(b.column("o1"), b.column("o2"), most, strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        release()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [shingles(t.as_py(), k).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("_rid"), pa.array(packed, pa.binary())], ["node", "s"])
        release()

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for p, q in zip(b.column("a"), b.column("b"), strict=True):
                x, y = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        release()

    one, two = (marks.select(F.col("node").alias(c), F.col("n").alias(f"n{i}"), F.col("odd").alias(f"o{i}")) for i, c in ((1, "u"), (2, "v")))
    pairs = stage(pairs.distinct().join(one, "u").join(two, "v").select("u", "v", "n1", "n2", "o1", "o2").mapInArrow(close, "u long, v long"), "candidates")
    used = stage(pairs.select(F.col("u").alias("_rid")).union(pairs.select("v")).distinct(), "candidate-rows")
    whole = stage(rows.join(small_side(used), "_rid", "left_semi").select("_rid", "text").mapInArrow(sets, "node long, s binary"), "candidate-sets")
    met = pairs.join(whole.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(whole.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    return stage(met.select("u", "v", "a", "b").mapInArrow(alike, "u long, v long"), "confirmed")


def _by_fingerprint(rows: DataFrame) -> DataFrame:
    """(u, v): every row and the least row of its group of SimHash fingerprints."""
    met = stage(rows.filter("n > 0").groupBy("fp").agg(F.min("_rid").alias("low")), "fingerprints")
    groups = simhash.linked_fingerprints(met.select("fp"))
    roots = met.join(groups, met["fp"] == groups["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    leads = roots.groupBy("root").agg(F.min("low").alias("v"))
    named = stage(roots.join(leads, "root").select("fp", "v"), "fingerprint-leads")
    return rows.filter("n > 0").join(named, "fp").filter("_rid <> v").select(F.col("_rid").alias("u"), "v")


def _rare_first(open_: DataFrame, docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """(u, v): pairs of the given rows (node, n, root) of different groups that may be similar, by the shingles they share.

    The shingles of a set are ordered by how many of these rows have them. Two similar sets share one of the first: among the first
    n - 2s / (1 + s) n of the smaller and the first n - s n of the larger set, and then enough may follow it. Shingles of one row
    only come first and pair with nothing, so what many rows have in common, such as a passage, is reached only by sets that
    hold little else.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column("_rid"), pa.array([shingles(t.as_py(), k).view(np.int64) for t in part.column("text")], pa.list_(pa.int64()))], ["node", "s"])
        release()

    used = stage(open_.select(F.col("node").alias("_rid")), "open-rows")
    whole = stage(docs.join(small_side(used), "_rid", "left_semi").select("_rid", "text").mapInArrow(sets, "node long, s array<long>"), "open-sets")
    each = whole.select("node", F.explode("s").alias("g"))
    shared = stage(each.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared-shingles")
    listed = each.join(shared, "g").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "g"))).alias("a"))  # shingles of one text
    placed = listed.join(open_, "node").select("node", "n", "root", (F.col("n") - F.size("a")).alias("_own"), F.posexplode("a").alias("p", "x"))
    placed = placed.select("node", "n", "root", F.col("x.g").alias("g"), (F.col("_own") + F.col("p")).alias("pos"))
    placed = stage(placed.filter(F.col("pos") <= F.col("n") * (1 - similarity) + 1e-6), "first-shingles")
    both = 2 * similarity / (1 + similarity)
    x, y = (placed.select("g", *[F.col(c).alias(f"{c}{s}") for c in ("node", "n", "root", "pos")]) for s in "12")
    need = both / 2 * (F.col("n1") + F.col("n2")) - 1e-6
    may = (
        (F.col("n1") <= F.col("n2")) & (F.col("root1") != F.col("root2")) & (F.col("n1") >= similarity * F.col("n2") - 1e-6)
        & (F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) >= need)
    )
    return x.filter(F.col("pos1") <= F.col("n1") * (1 - both) + 1e-6).join(y, "g").filter(may).select(F.col("node1").alias("u"), F.col("node2").alias("v"))


def near_copies(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row: _rid, doc_id, component_id (least doc_id reachable), _root (names the group).

    Rows are linked if the Jaccard similarity of their sets of k-word shingles is at least ``similarity``; groups are chains of links.
    Candidates are rows whose SimHash fingerprints the trie self-join links, and rows that share a band of their sketches,
    which sets of similarity 0.8 do but for 3 in 1,000: three bits alone would find few of them. The rows of a band's
    bucket are first compared with its least one, a row per member; rows of buckets that then still hold several
    groups are compared by their rarest shingles (:func:`_rare_first`), which loses no pair of them. Every link is confirmed by the whole sets. Equal sets, so repeated rows too,
    are one node; texts without words are equal. Rows without id never name a group unless all its rows lack an id.
    """
    docs = row_id(fixed(docs).select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [shingles(t.as_py(), k) for t in part.column("text")]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_rid"), part.column("doc_id"), pa.array(keys, pa.binary()), pa.array([len(s) for s in found], pa.int32()), pa.array([bands(s) for s in found], pa.list_(pa.int64())), pa.array([parities(s) for s in found], pa.binary()), pa.array([majority(s) for s in found], pa.int64())],
                    ["_rid", "doc_id", "key", "n", "bands", "odd", "fp"],
                )
        release()

    rows = stage(docs.mapInArrow(run, f"_rid long, doc_id {dict(docs.dtypes)['doc_id']}, key binary, n int, bands array<long>, odd binary, fp long"), "shingles")
    nodes = stage(rows.groupBy("key").agg(F.min("_rid").alias("node"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("_n")), "nodes")
    copies = stage(rows.select("_rid", "key").join(nodes.filter("_n > 1"), "key").filter("_rid <> node").select("_rid"), "copies")
    own = rows.join(small_side(copies), "_rid", "left_anti").select(F.col("_rid").alias("node"), "n", F.explode("bands").alias("h"))
    marks = rows.select(F.col("_rid").alias("node"), "n", "odd")
    # a bucket's least member is a partial aggregate, so a bucket with a third of all rows is joined, never sorted in one task
    leads = stage(own.groupBy("h").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "leads")
    met = stage(own.join(leads.select("h", F.col("lead.node").alias("lead"), F.col("lead.n").alias("m")), "h"), "met")
    may = lambda n, m: F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6
    first = met.filter("node <> lead").filter(may("n", "m")).select(F.col("node").alias("u"), F.col("lead").alias("v"))
    links = _confirmed(first.union(_by_fingerprint(rows.join(small_side(copies), "_rid", "left_anti"))), marks, docs, k, similarity)
    groups = stage(components(links), "groups")
    told_root = met.select("h", "node", "n").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = told_root.groupBy("h").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a < _b").select("h")
    open_ = stage(told_root.join(apart, "h", "left_semi").select("node", "n", "root").distinct(), "open")
    rest = _confirmed(_rare_first(open_, docs, k, similarity), marks, docs, k, similarity)
    groups = stage(components(links.union(rest)), "groups")
    named = nodes.join(groups, "node", "left").select("key", "low", F.coalesce("root", "node").alias("_root"))
    lows = named.groupBy("_root").agg(F.min("low").alias("component_id"))
    return rows.select("_rid", "doc_id", "key").join(named.join(lows, "_root").select("key", "component_id", "_root"), "key").drop("key")


def deduplicated(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group, the first row with the least id, in the columns of ``docs``."""
    docs = fixed(docs)
    rows = stage(near_copies(docs, k, similarity), "near-copies")
    first = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("_root").agg(F.min("_rid").alias("_rid"))
    drop = stage(rows.join(first, "_rid", "left_anti").select("_rid"), "dropped")
    rid = fresh(docs)
    return row_id(docs, rid).join(small_side(drop.select(F.col("_rid").alias(rid))), rid, "left_anti").drop(rid)

"""Repeated passages by depth-limited radix passes over suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import fixed, row_id, small_side, stage

WINDOW = 400
#: Bytes of the first digit. A window holds WINDOW - DIGIT + 1 of them.
DIGIT = 64
#: Longest piece of a text that is indexed at a time; pieces overlap by a window.
PIECE = 1 << 23
#: Distinct runs of one first digit up to which a single task sorts their windows.
GROUP = 4096
#: Parts over which the runs of a very frequent digit are dealt.
SALTS = 32
#: A key with more than one of so many rows is looked up in a broadcast, not in a shuffle.
OFTEN = 1000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def digits(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``DIGIT`` bytes at every place, by doubling from 8 bytes."""
    n = len(data) - 7
    out = _mix(np.ndarray((n,), "<u8", data, strides=(1,)).astype(np.uint64))
    width = 8
    while width < DIGIT:
        out = _mix(out[:-width] * np.uint64(3) + (out[width:] ^ _ODD))
        width *= 2
    return out


def runs(text: bytes) -> tuple[np.ndarray, ...]:
    """Windows of a text in runs that share a first digit.

    The first digit of a window is the least of its digit hashes, leftmost on ties, so equal
    windows have it at equal places. Returns arrays: place of the digit, least and
    greatest distance of a window's start before it, digit hash, and hash of all bytes of the run.
    """
    span = WINDOW - DIGIT + 1
    parts = []
    for at in range(0, max(1, len(text) - WINDOW + 1), PIECE):
        piece = text[at : at + PIECE + WINDOW - 1]
        n = len(piece) - WINDOW + 1
        if n < 1:
            continue
        h = digits(np.frombuffer(piece, np.uint8))
        low = np.uint64((1 << 24) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        wide = np.full(-(-len(key) // span) * span, np.iinfo(np.uint64).max, np.uint64)
        wide[: len(key)] = key
        grid = wide.reshape(-1, span)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        place = (np.minimum(back[:n], ahead[span - 1 : span - 1 + n]) & low).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        last = np.append(first[1:], n) - 1
        a = place[first]
        mine = np.fromiter((xxhash.xxh64_intdigest(piece[p : q + WINDOW], s) for p, q, s in zip(first.tolist(), last.tolist(), (a - first).tolist(), strict=True)), np.uint64, len(first))
        parts.append((a + at, a - last, a - first, h[a].view(np.int64), mine.view(np.int64)))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def window_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``WINDOW`` bytes at every place: digits of 8 to 256 bytes, each made of two halves."""
    out = _mix(np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64))
    width = 8
    while width * 2 <= WINDOW:
        out = _mix(out[:-width] * np.uint64(3) + (out[width:] ^ _ODD))
        width *= 2
    return _mix(out[: len(data) - WINDOW + 1] * np.uint64(5) + out[WINDOW - width :])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_rid", "a", "near", "far", "digit", "run"]
    for b in batches:
        found = [runs(t or b"") for t in b.column("text").to_pylist()]
        sizes = [len(f[0]) for f in found]
        rid = np.repeat(b.column("_rid").to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(rid), *[pa.array(np.concatenate([f[k] for f in found])) for k in range(5)]], names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the runs that must be compared, cut out of their texts."""
    for b in batches:
        out = {k: [] for k in ("_rid", "a", "near", "far", "digit", "hot", "bytes")}
        for rid, text, listed in zip(b.column("_rid").to_pylist(), b.column("text").to_pylist(), b.column("listed").to_pylist(), strict=True):
            for r in listed:
                for k in ("a", "near", "far", "digit", "hot"):
                    out[k].append(r[k])
                out["_rid"].append(rid)
                out["bytes"].append(text[r["a"] - r["far"] : r["a"] - r["near"] + WINDOW])
        yield pa.RecordBatch.from_arrays([pa.array(out["_rid"], pa.int64()), *[pa.array(out[k], pa.int64()) for k in ("a", "near", "far", "digit")], pa.array(out["hot"], pa.bool_()), pa.array(out["bytes"], pa.binary())], list(out))


def _windows(rid: np.ndarray, a: np.ndarray, far: np.ndarray, cut: list[bytes]) -> tuple[np.ndarray, ...]:
    """(row, start, distance, hash) of every window of the runs."""
    hashes = [window_hashes(np.frombuffer(c, np.uint8)) for c in cut]
    n = np.array([len(h) for h in hashes])
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    dist = np.repeat(far, n) - step
    return np.repeat(rid, n), np.repeat(a, n) - dist, dist, np.concatenate(hashes)


def _spans(rid: np.ndarray, start: np.ndarray) -> pa.Table:
    """Windows, in order of (row, start), merged to byte spans."""
    if not len(rid):
        return pa.table({"_rid": pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "end": pa.array([], pa.int64())})
    new = np.concatenate(([True], (rid[1:] != rid[:-1]) | (start[1:] > start[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rid)) - 1
    return pa.table({"_rid": rid[first], "start": start[first], "end": start[last] + WINDOW})


def equal_windows(data: np.ndarray, pos: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Which windows, ``WINDOW`` bytes from ``pos`` in ``data``, are equal to another of the same ``cell``: radix passes by bytes.

    Windows are ordered by eight bytes, the most significant first; a pass looks only at windows that are still equal to
    another, and orders them only where they differ. What is left after the last byte is equal in all.
    """
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    at = np.argsort(cell, kind="stable")
    group = np.cumsum(np.concatenate(([0], cell[at][1:] != cell[at][:-1]))) if len(at) else at
    for depth in range(0, WINDOW, 8):
        many = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
        at, group = at[many], group[many]
        if not len(at):
            break
        key = words[pos[at] + min(depth, WINDOW - 8)]
        split = (key[1:] != key[:-1]) & (group[1:] == group[:-1])
        if split.any():
            order = np.lexsort((key, group))
            at, group, key = at[order], group[order], key[order]
            split = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
            group = np.cumsum(np.concatenate(([0], split)))
    hit = np.zeros(len(pos), bool)
    if len(at):
        hit[at[np.bincount(group)[group] > 1]] = True
    return hit


def _sorted_group(group: pa.Table) -> pa.Table:
    """Repeated windows of the runs of one first digit: equal distance, equal bytes, two places at least."""
    rid, a, far = (group.column(c).to_numpy() for c in ("_rid", "a", "far"))
    cut = group.column("bytes").to_pylist()
    size = np.array([len(c) for c in cut], np.int64)
    n = size - WINDOW + 1
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    dist = np.repeat(far, n) - step
    hit = equal_windows(np.frombuffer(b"".join(cut), np.uint8), np.repeat(np.cumsum(size) - size, n) + step, dist)
    rid, start = np.repeat(rid, n)[hit], (np.repeat(a, n) - dist)[hit]
    order = np.lexsort((start, rid))
    return _spans(rid[order], start[order])


def _listed_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            p = b.slice(at, 2000)
            rid, start, dist, h = _windows(*[p.column(c).to_numpy() for c in ("_rid", "a", "far")], p.column("bytes").to_pylist())
            digit = np.repeat(p.column("digit").to_numpy(), (p.column("far").to_numpy() - p.column("near").to_numpy()) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(start), pa.array(_mix(h + dist.astype(np.uint64) * _ODD).view(np.int64)), pa.array(digit)], ["_rid", "start", "h", "digit"])


def _met(listed: DataFrame, often: DataFrame) -> DataFrame:
    """Runs whose digit occurs again, with whether other runs share it. Digits with very many runs are dealt over several tasks."""
    total = often.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(often.filter(F.col("_n") > total / 1000).select("digit", F.lit(True).alias("_hot")))  # fewer than 1,000 by their definition
    left = listed.join(hot, "digit", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_rid", "a"), F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = often.join(hot, "digit", "left").withColumn("_salt", F.explode(copies)).select("digit", "mixed", "_salt")
    return left.join(right, ["digit", "_salt"]).drop("_salt")


def _repeated(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in ``counted``, one row per key with its number of rows ``_n``.

    Keys with more than one of ``OFTEN`` of these rows are broadcast, so theirs are not shuffled; the others meet in a join.
    """
    total = counted.agg(F.sum("_n")).first()[0] or 0
    often = F.col("_n") > total / OFTEN
    hot = F.broadcast(counted.filter(often).select(*keys, F.lit(True).alias("_hot")))  # fewer than OFTEN by their definition
    marked = rows.join(hot, keys, "left")
    rest = marked.filter("_hot IS NULL").drop("_hot").join(counted.filter(~often).select(*keys), keys)
    return marked.filter("_hot").drop("_hot").unionByName(rest)


def repeated_spans(base: DataFrame) -> DataFrame:
    """(_rid, text bytes) -> (_rid, start, end): byte spans made of windows that start anywhere else too.

    Passes from the most significant digit down, each over what is still open:

    1. The first digit of a suffix is the least 64-byte hash in its window. Runs of windows that
       share it are counted by digit; a digit that occurs once ends there.
    2. Runs equal in all bytes are repeats as a whole; only one of them stays open, and only if
       its digit has other runs too.
    3. The windows of the open runs are sorted by their bytes, eight at a time through all 400, each pass only where windows are
       still equal; equal groups are the repeats.
       Digits with more than ``GROUP`` open runs are not gathered: their windows are counted as rows.

    Steps 1 and 2 are counts that combine before the shuffle. A digit with more than a thousandth of all runs, of
    which there are fewer than a thousand, is dealt over ``SALTS`` parts before it is joined; runs as frequent
    are looked up where they lie.
    """
    listed = stage(base.mapInArrow(_index, "_rid long, a long, near long, far long, digit long, run long"), "runs")
    often = listed.groupBy("digit").agg(F.count(F.lit(1)).alias("_n"), F.min("run").alias("_lo"), F.max("run").alias("_hi")).filter("_n > 1")
    often = stage(often.select("digit", (F.col("_lo") != F.col("_hi")).alias("mixed"), "_n"), "digits")
    met = stage(_met(listed, often), "met")
    whole = met.filter("not mixed")
    mixed = met.filter("mixed")
    same = stage(mixed.groupBy("digit", "run").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_rid", "a", "near", "far")).alias("r")), "same")
    whole = whole.unionByName(_repeated(mixed, same.filter("_n > 1").select("digit", "run", "_n"), ["digit", "run"]))
    spans = whole.select("_rid", (F.col("a") - F.col("far")).alias("start"), (F.col("a") - F.col("near") + WINDOW).alias("end"))
    crowded = stage(same.groupBy("digit").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > GROUP).select("digit", F.lit(True).alias("hot")), "crowded")
    marked = same.join(small_side(crowded), "digit", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    open_ = marked.select("r._rid", F.struct("r.a", "r.near", "r.far", "digit", "hot").alias("x"))
    by_text = open_.groupBy("_rid").agg(F.collect_list("x").alias("listed"))  # runs of one text
    cut = stage(base.join(by_text, "_rid").mapInArrow(_cut, "_rid long, a long, near long, far long, digit long, hot boolean, bytes binary"), "open-runs")
    small = cut.filter("not hot").groupBy("digit").applyInArrow(_sorted_group, "_rid long, start long, end long")
    windows = cut.filter("hot").mapInArrow(_listed_windows, "_rid long, start long, h long, digit long")
    twice = stage(windows.groupBy("digit", "h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "windows")
    large = windows.join(twice, ["digit", "h"]).select("_rid", "start", (F.col("start") + WINDOW).alias("end"))
    return spans.unionByName(small).unionByName(large)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, gone, n, digest, kept = [], [], [], [], []
        for text, listed in zip(b.column("text").to_pylist(), b.column("listed").to_pylist(), strict=True):
            text = text or b""
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in listed or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            edges = [0, *[x for s in merged for x in s], len(text)]
            rest = b"".join(text[p:q] for p, q in zip(edges[::2], edges[1::2], strict=True))
            size.append(len(text))
            gone.append(len(text) - len(rest))
            n.append(len(merged))
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """Texts without the bytes covered by repeated windows: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    A window of 400 bytes that also starts anywhere else in the table, the same text included,
    is removed at every place where it occurs; spans are judged on the input. ``kept`` is bytes, as a
    cut may fall inside a character. Null is empty; texts under 400 bytes, and tables without
    repeats, are kept whole. Every row is a document of its own, so repeated rows remove each other.
    Columns other than doc_id and text are not read.
    """
    docs = fixed(docs)
    base = row_id(docs.select("doc_id", F.col("text").cast("binary").alias("text")))
    spans = repeated_spans(base.filter(F.octet_length("text") >= WINDOW).select("_rid", "text"))
    by_text = spans.groupBy("_rid").agg(F.collect_list(F.struct("start", "end")).alias("listed"))  # spans of one text
    doc_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {doc_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return base.join(by_text, "_rid", "left").mapInArrow(_keep, schema)

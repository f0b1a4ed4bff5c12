"""Byte-level BPE: every distinct word of the corpus is encoded once, ids go back to the places of the word."""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm import pieces
from ebbtide.llm.common import fixed, release, row_id


def ranks_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """Token bytes -> id, from a file with a base64 token and its rank per line. It is read on the driver."""
    with open(path or ranks_file(), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=4)
def _encoder(ranks: frozenset):
    import public_tokenizers
    import tiktoken

    # a word is one match of the pattern, so the library only merges
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})


def token_bytes(ranks: dict[bytes, int]) -> pa.Array:
    """The token-byte table: the bytes of every id, null where the vocabulary has a gap."""
    listed = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        listed[rank] = token
    return pa.array(listed, pa.large_binary())


def _packed(values: list[bytes]) -> bytes:
    """Byte strings as their lengths and their bytes, compressed."""
    sizes = np.fromiter(map(len, values), "<u4", len(values))
    return zstandard.ZstdCompressor(level=3).compress(sizes.tobytes() + b"".join(values))


def _unpacked(packed: bytes, n: int) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.frombuffer(raw[: 4 * n], "<u4").astype(np.int64), raw[4 * n :]


def _buckets(words: pa.Array, buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words.to_pylist()), np.uint32, len(words)) % buckets


def encode(docs: DataFrame, ranks: dict[bytes, int], buckets: int | None = None) -> DataFrame:
    """(_rid, doc_id, n_tokens long, ids binary): ids of every whole text as little-endian unsigned 32-bit numbers.

    Texts are cut in blocks of documents, and the words of a block in distinct words and the word at every position. Distinct words go
    to their hash bucket, packed as one row per block and bucket; equal words of all blocks meet there and each is encoded once. The
    ids return in the same packed form and the block is put together by position. A word counts once per block however often it
    occurs, so a word with a third of all occurrences is no hot key. ``buckets`` (eight per shuffle partition) sets
    how many distinct words are remembered at once; where there are more than ``pieces.KEEP``, some are encoded again.

    Null and empty texts have no ids. Rows of one id, and rows without id, stay apart; an empty table gives no rows. A text
    of any length is encoded whole: it is cut in slices, and only its word numbers and ids are held together. Columns
    other than doc_id and text are not read, whatever their names.
    """
    spark = docs.sparkSession
    doc_type = dict(docs.dtypes)["doc_id"]
    rows = row_id(fixed(docs.select("doc_id", "text"))).select("_rid", "doc_id", "text")
    told = spark.sparkContext.broadcast(ranks)  # a vocabulary, some MB
    buckets = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rids, _, texts in pieces.blocks(batches):
            found = pieces.distinct(pieces.pretokens(texts)[0])[0]
            spot = _buckets(found, buckets)
            order = np.argsort(spot, kind="stable")
            ends = np.cumsum(np.bincount(spot, minlength=buckets))
            listed = found.take(pa.array(order)).to_pylist()
            used = np.flatnonzero(np.diff(ends, prepend=0))
            parts = [listed[p:q] for p, q in zip(np.concatenate(([0], ends))[used].tolist(), ends[used].tolist(), strict=True)]
            cols = [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), rids[0])), pa.array([len(x) for x in parts], pa.int32()), pa.array([_packed(x) for x in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "block", "n", "words"])
        release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _encoder(frozenset(told.value.items()))._encode_single_piece
        known, at = None, None
        for b in batches:
            out = []
            for bucket, n, packed in zip(*[b.column(c).to_pylist() for c in ("bucket", "n", "words")], strict=True):
                if bucket != at:  # rows come sorted by bucket; words of another bucket are other words
                    known, at = pieces.WordIds(lambda ws: pieces.packed([one(w) for w in ws])), bucket
                sizes, raw = _unpacked(packed, n)
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                flat, per_word, _ = known.look(pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]))
                # ids of a vocabulary of up to 65,536 tokens take two bytes
                kind = "<u2" if len(told.value) <= 1 << 16 else "<u4"
                out.append(zstandard.ZstdCompressor(level=3).compress(per_word.astype("<u4").tobytes() + flat.astype(kind).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), b.column("n"), pa.array(out, pa.binary())], ["home", "bucket", "n", "ids"])
        release()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rids, ids, texts in pieces.blocks(batches):
            found, counts = pieces.pretokens(texts)
            listed, index = pieces.distinct(found)
            small = zstandard.ZstdCompressor(level=1)
            one = [
                pa.array([rids[0]]), pa.array([rids], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([counts], pa.list_(pa.int64())),
                pa.array([small.compress(_buckets(listed, buckets).astype("<u4").tobytes())], pa.binary()), pa.array([small.compress(index.astype("<u4").tobytes())], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(one, ["block", "rids", "doc_ids", "counts", "spots", "places"])
        release()

    def together(block: pa.Table, found: pa.Table) -> pa.Table:
        kind = "<u2" if len(told.value) <= 1 << 16 else "<u4"
        sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for n, packed in sorted(zip(found.column("bucket").to_pylist(), zip(found.column("n").to_pylist(), found.column("ids").to_pylist(), strict=True), strict=True)):
            per_word, raw = _unpacked(packed[1], packed[0])
            sizes.append(per_word)
            flat.append(np.frombuffer(raw, kind).astype(np.uint32))
        sizes, flat = np.concatenate(sizes), np.concatenate(flat)
        out = []
        for row in block.to_batches():
            for k in range(row.num_rows):
                plain = zstandard.ZstdDecompressor()
                spot = np.frombuffer(plain.decompress(row.column("spots")[k].as_py()), "<u4")
                at = np.empty(len(spot), np.int64)
                at[np.argsort(spot, kind="stable")] = np.arange(len(spot))  # words lie by bucket, then by their number
                index = np.frombuffer(plain.decompress(row.column("places")[k].as_py()), "<u4")
                ids, per_place = pieces.spread(at[index], flat, sizes)
                n = pieces.per_text(per_place, row.column("counts")[k].values.to_numpy())
                offsets = np.concatenate(([0], np.cumsum(n))) * 4
                stored = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids, "<u4").tobytes())])
                out.append(pa.table([row.column("rids")[k].values, row.column("doc_ids")[k].values, pa.array(n), stored.cast(pa.binary())], ["_rid", "doc_id", "n_tokens", "ids"]))
        release()
        return pa.concat_tables(out)

    each = rows.mapInArrow(words, "bucket int, block long, n int, words binary")
    ids = each.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(merge, "home long, bucket int, n int, ids binary")
    blocks = rows.mapInArrow(places, f"block long, rids array<long>, doc_ids array<{doc_type}>, counts array<long>, spots binary, places binary")
    joined = blocks.groupBy("block").cogroup(ids.groupBy("home"))
    return joined.applyInArrow(together, f"_rid long, doc_id {doc_type}, n_tokens long, ids binary")


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``tokens`` with a column ``decoded`` binary: the bytes of its ids, joined with the token-byte table.

    The table has one row per id of the vocabulary and is sent to every task; an id without bytes is an error. Null ids give
    null. A column ``decoded`` of the input is replaced; other columns pass unchanged.
    """
    told = tokens.sparkSession.sparkContext.broadcast(ranks)
    kept = tokens.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(told.value)
        for b in batches:
            col = b.column("ids")
            raw = [x or b"" for x in col.to_pylist()]
            out, at = [], 0
            while at < len(raw):  # some million ids at a time
                to, held = at, 0
                while to < len(raw) and (to == at or held + len(raw[to]) <= 1 << 24):
                    held += len(raw[to])
                    to += 1
                ids = np.frombuffer(b"".join(raw[at:to]), "<u4")
                found = table.take(pa.array(np.minimum(ids, len(table) - 1)))
                if found.null_count or (ids >= len(table)).any():
                    raise ValueError("an id has no bytes in the vocabulary")
                offsets = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1] if len(found) else np.zeros(1, np.int64)
                text = found.buffers()[2].to_pybytes() if len(found) else b""
                ends = offsets[np.concatenate(([0], np.cumsum([len(x) >> 2 for x in raw[at:to]])))].tolist()
                out += [text[p:q] for p, q in zip(ends, ends[1:])]
                at = to
            decoded = pa.array([d if ok else None for d, ok in zip(out, col.is_valid().to_pylist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, decoded], [*b.schema.names, "decoded"])
        release()

    return kept.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes), "decoded binary"]))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids alone."""
    ranks = read_ranks(path)
    back = decode(encode(docs, ranks), ranks)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


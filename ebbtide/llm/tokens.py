"""Token ids of documents, stored as Huffman-coded blocks and read back."""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.llm import huffman, pieces
from ebbtide.llm.common import release, row_id, stage
from ebbtide.session import shared_folder

END_ID = 0
#: Ids after which a block is closed; a document is never cut, so a longer one has a block of its own.
BLOCK_IDS = 1 << 16
#: Distinct words whose ids a worker keeps.
KEEP = 1_000_000
#: Code points of texts that a task encodes together.
BLOCK_CHARS = 8 << 20
#: Ids that a task decodes side by side.
DECODED = 1 << 20


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as the library gives them, each distinct word once while it is remembered.

    Where the vocabulary cuts texts by the public byte-level pattern, words are cut for many texts at once and the library
    sees only words that are new. Texts that hold the string of a special token, which the library cuts out first, and all texts of other
    kinds of vocabularies are given to the library whole.
    """

    def __init__(self, definition: str, keep: int = KEEP):
        made = json.loads(definition)
        added = made.get("added_tokens") or []
        self.definition, self.library = definition, None
        self.size = max([*made["model"]["vocab"].values(), *(t["id"] for t in added)]) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = [t["content"] for t in added]
        self.public = pieces.splits_publicly(made)
        del made
        self.words = pieces.WordIds(pieces.library_words(definition), keep=keep) if self.public else None

    def whole(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if self.library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.definition)
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as numbers of the kind of the vocabulary."""
        if not self.public:
            return self.whole(texts)
        apart = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        kept = list(texts)
        for k in apart:
            kept[k] = ""
        found, counts = pieces.pretokens(kept)
        words, index = pieces.distinct(found)
        flat, sizes, _ = self.words.look(words)
        ids, per_place = pieces.spread(index, flat, sizes)
        raw = ids.astype(self.kind).tobytes()
        ends = (np.concatenate(([0], np.cumsum(pieces.per_text(per_place, counts)))) * self.kind.itemsize).tolist()
        out = [raw[p:q] for p, q in zip(ends, ends[1:])]
        for k, x in zip(apart, self.whole([texts[k] for k in apart]), strict=True):
            out[k] = x
        return out


@functools.lru_cache(maxsize=1)
def _encoder(definition: str, keep: int) -> Encoder:
    """The encoder of a worker; its next tasks find the words that earlier ones met."""
    return Encoder(definition, keep)


def encoded(docs: DataFrame, definition: str, keep: int = KEEP, chars: int = BLOCK_CHARS) -> DataFrame:
    """(_rid, doc_id, ids, n): ids of every whole text with the end id, as little-endian numbers; null is empty."""
    told = docs.sparkSession.sparkContext.broadcast(definition)  # a vocabulary, some MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(told.value, keep)
        end = np.array([END_ID], enc.kind).tobytes()
        for rids, docs_, texts in pieces.blocks(batches, chars):
            ids = [x + end for x in enc.encode(texts)]
            n = pa.array([len(x) // enc.kind.itemsize for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), docs_, pa.array(ids, pa.binary()), n], ["_rid", "doc_id", "ids", "n"])
        if keep < KEEP:  # little is to be remembered: nothing between tasks
            del enc
            _encoder.cache_clear()
        release()

    return row_id(docs.select("doc_id", "text")).select("_rid", "doc_id", "text").mapInArrow(run, f"_rid long, doc_id {dict(docs.dtypes)['doc_id']}, ids binary, n long")


def global_counts(rows: DataFrame, size: int, kind: np.dtype) -> np.ndarray:
    """How often each id occurs; one row per id and task is shuffled, one per id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for ids in b.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=size) if len(ids.as_py()) > 4 * size else 0
            short = b"".join(x for x in b.column("ids").to_pylist() if len(x) <= 4 * size)
            total += np.bincount(np.frombuffer(short, kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def _segment(rows: DataFrame, parts: int) -> Column:
    """Order-preserving segment of a row by doc_id, missing ids last.

    Cut points are approximate quantiles of the ids, so segments are of similar size; an id that repeats over
    several quantiles is split further by the place of its rows in the input.
    """
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    cuts = cuts or []
    often = sorted({c for a, c in zip(cuts, cuts[1:]) if a == c})
    listed = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    place = F.when(F.col("doc_id").isNull(), F.lit(2 * len(cuts) + 2)).otherwise(
        F.size(F.filter(listed, lambda c: c < F.col("doc_id"))) + F.size(F.filter(listed, lambda c: c <= F.col("doc_id")))
    )
    many = F.col("doc_id").isNull() | (F.col("doc_id").isin(often) if often else F.lit(False))
    return F.struct(place.alias("a"), F.when(many, F.shiftright("_rid", 33)).otherwise(0).alias("b"))


def write(docs: DataFrame, path: str, definition: str, parts: int | None = None, keep: int = KEEP, chars: int = BLOCK_CHARS) -> None:
    """Encode ``docs`` and write them below ``path`` in ascending order of doc_id.

    ``path/lengths``: the code length of every id that occurs, which defines the canonical code.
    ``path/blocks``: per row a block of whole documents: segment, block, the first id's place in the
    segment, doc_ids, ids per document, bytes per document, payload, and per document the bit offset of every
    ``huffman.STEP``-th id, from which decoding can begin. ``path/segments``: ids before each segment.
    """
    enc = Encoder(definition)
    size, kind = enc.size, enc.kind
    rows = stage(encoded(docs, definition, keep, chars), "token-ids")
    lengths = huffman.code_lengths(global_counts(rows, size, kind))
    codes = huffman.canonical(lengths)
    spark = docs.sparkSession
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int").coalesce(1).write.parquet(f"{path}/lengths")
    told = spark.sparkContext.broadcast((lengths, codes))  # one entry per id of the vocabulary

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = told.value
        for b in batches:
            listed = b.column("ids").to_pylist()
            at = 0
            while at < len(listed):  # documents of about two blocks at a time
                to, held = at, 0
                while to < len(listed) and (to == at or held + len(listed[to]) <= 4 * BLOCK_IDS * kind.itemsize):
                    held += len(listed[to])
                    to += 1
                ids = np.frombuffer(b"".join(listed[at:to]), kind).astype(np.int64)
                sizes = np.array([len(x) // kind.itemsize for x in listed[at:to]], np.int64)
                payload, used, marks = huffman.encode(ids, sizes, lengths, codes)
                ends = np.concatenate(([0], np.cumsum(used))).tolist()
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(at, to - at) for c in ("_rid", "doc_id", "n")], pa.array([payload[p:q] for p, q in zip(ends, ends[1:])], pa.binary()), pa.array([m.tolist() for m in marks], pa.list_(pa.int64()))],
                    ["_rid", "doc_id", "n", "payload", "marks"],
                )
                at = to

    doc_type = dict(docs.dtypes)["doc_id"]
    packed = rows.mapInArrow(pack, f"_rid long, doc_id {doc_type}, n long, payload binary, marks array<long>")
    n_parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one segment per partition; only parts of an id that repeats very often follow each other around
    target = (F.floor(F.col("_seg.a") / 2) + F.col("_seg.b")).cast("int")
    placed = packed.withColumn("_seg", _segment(rows.select("_rid", "doc_id"), n_parts)).repartitionById(n_parts, target).sortWithinPartitions("_seg", F.col("doc_id").asc_nulls_last(), "_rid")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, number, first, total, held = None, 0, 0, 0, {k: [] for k in ("doc_id", "n", "used", "payload", "marks")}

        def close() -> pa.RecordBatch:
            nonlocal number, first, total
            out = pa.RecordBatch.from_pylist(
                [{"segment": seg, "block": number, "first": first, "doc_ids": held["doc_id"], "sizes": held["n"], "bytes": held["used"], "marks": held["marks"], "payload": b"".join(held["payload"])}], schema=schema
            )
            first, number, total = first + total, number + 1, 0
            for v in held.values():
                v.clear()
            return out

        id_type = None
        for b in batches:
            if id_type is None:
                id_type = b.schema.field("doc_id").type
                schema = pa.schema([("segment", pa.struct([("a", pa.int32()), ("b", pa.int64())])), ("block", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(id_type)), ("sizes", pa.list_(pa.int64())), ("bytes", pa.list_(pa.int64())), ("marks", pa.list_(pa.list_(pa.int64()))), ("payload", pa.binary())])
            for row_seg, doc, n, payload, marks in zip(*[b.column(c).to_pylist() for c in ("_seg", "doc_id", "n", "payload", "marks")], strict=True):
                if held["n"] and (row_seg != seg or total >= BLOCK_IDS):
                    yield close()
                if row_seg != seg:
                    seg, number, first = row_seg, 0, 0
                for k, v in (("doc_id", doc), ("n", n), ("used", len(payload)), ("payload", payload), ("marks", marks)):
                    held[k].append(v)
                total += n
        if held["n"]:
            yield close()

    schema = f"segment struct<a:int,b:bigint>, block long, first long, doc_ids array<{doc_type}>, sizes array<long>, bytes array<long>, marks array<array<long>>, payload binary"
    placed.mapInArrow(block, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    ids = blocks.groupBy("segment").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)).alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.partitionBy(F.lit(0)).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids.select("segment", "ids", before.alias("before")).coalesce(1).write.parquet(f"{path}/segments")  # a row per segment


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, decoded block by block."""
    listed = spark.read.parquet(f"{path}/lengths").collect()  # one row per id of the vocabulary
    lengths = np.zeros(max([r["id"] for r in listed], default=0) + 1, np.uint8)
    for r in listed:
        lengths[r["id"]] = r["length"]
    told = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{path}/blocks")
    placed = blocks.join(F.broadcast(spark.read.parquet(f"{path}/segments").select("segment", "before")), "segment")
    doc_type = dict(blocks.dtypes)["doc_ids"][len("array<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = huffman.Decoder(told.value)

        def decode(blocks: list[tuple]) -> pa.RecordBatch:
            """Several blocks side by side: every run between two bit offsets is one lane."""
            sizes = np.concatenate([np.array(b[2], np.int64) for b in blocks])
            used = np.concatenate([np.array(b[3], np.int64) for b in blocks])
            base = (np.cumsum(used) - used) * 8
            per_doc = np.array([len(m) for b in blocks for m in b[4]], np.int64)
            marks = np.array([x for b in blocks for m in b[4] for x in m], np.int64) + np.repeat(base, per_doc)
            step = np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
            runs = np.minimum(huffman.STEP, np.repeat(sizes, per_doc) - step * huffman.STEP)
            ids = table.decode(b"".join(b[5] for b in blocks), marks, runs).astype("<u4")
            ends = np.concatenate(([0], np.cumsum(sizes)))
            n = [len(b[2]) for b in blocks]
            first = np.repeat([b[0] for b in blocks], n) + ends[:-1] - np.repeat(ends[np.cumsum([0, *n[:-1]])], n)
            crc = [zlib.crc32(ids[p:q]) for p, q in zip(ends.tolist(), ends[1:].tolist())]
            docs = pa.concat_arrays([b[1] for b in blocks])
            return pa.RecordBatch.from_arrays([docs, pa.array(first), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

        held, total = [], 0
        for b in batches:
            for k in range(b.num_rows):
                at = b.column("first")[k].as_py() + b.column("before")[k].as_py()
                held.append((at, b.column("doc_ids")[k].values, *[b.column(c)[k].as_py() for c in ("sizes", "bytes", "marks", "payload")]))
                total += sum(held[-1][2])
                if total >= DECODED:
                    yield decode(held)
                    held, total = [], 0
        if held:
            yield decode(held)

    return placed.mapInArrow(run, f"doc_id {doc_type}, start long, n_tokens long, ids_crc32 long")


def stored_tokens(docs: DataFrame, tokenizer: str | None = None, keep: int = KEEP, chars: int = BLOCK_CHARS) -> DataFrame:
    """Write the ids of ``docs`` to a fresh file set in the shared folder and read them back.

    One row per row of ``docs``: doc_id, start (ids of all documents before it), n_tokens (with the
    end id), ids_crc32. Null and empty texts have the end id alone. Rows of one id keep their order in the
    input; rows without id come last. ``keep`` bounds the words a worker remembers and ``chars`` the texts it encodes together: fewer take less memory and
    more time, the ids are the same. An empty table gives no rows; columns other than doc_id and text are not read.
    """
    with open(tokenizer or vocabulary_file(), encoding="utf-8") as f:
        definition = f.read()
    path = shared_folder(docs.sparkSession, "tokens")
    write(docs, path, definition, keep=keep, chars=chars)
    return read(docs.sparkSession, path)

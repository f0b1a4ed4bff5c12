"""Cross-tokenizer alignment: tokens of two vocabularies over the same bytes, cut into groups and linked."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm import pieces
from ebbtide.llm.common import release, row_id, stage

#: Code points of text after which a block is closed; all tokens of both sides of a block are sorted together.
BLOCK_CHARS = 2 << 20
#: The mark that the second vocabulary writes for a space.
SPACE = "▁"


def definitions(a: str | None = None, b: str | None = None) -> tuple[str, bytes]:
    """The two vocabularies as stored: the definition of a byte-level one, and a model of pieces. Read on the driver."""
    import public_tokenizers

    with open(a or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        first = f.read()
    with open(b or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return first, f.read()


class ByteLevel:
    """First vocabulary: words by the public pattern, ids by the library, token bytes by the byte letters."""

    def __init__(self, definition: str):
        made = json.loads(definition)
        if not pieces.splits_publicly(made):
            raise ValueError("the first vocabulary must cut texts by the public byte-level pattern")
        letters, names = pieces.byte_letters(), made["model"]["vocab"]
        table = [b""] * (max(names.values()) + 1)
        for name, number in names.items():
            table[number] = bytes(letters[c] for c in name)
        self.ids = pieces.WordIds(pieces.library_words(definition), pa.array(table, pa.large_binary()))
        self.cut = pieces.pretokens


class Pieces:
    """Second vocabulary: words with the spaces before them, of which no piece goes beyond; bytes that are no piece fall back."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.library.id_to_piece(k) for k in range(self.library.vocab_size())]
        if any(SPACE in n.lstrip(SPACE) for n in names):
            raise ValueError("pieces of the second vocabulary must not hold a space after another character")
        table = [bytes([int(n[3:5], 16)]) if self.library.is_byte(k) else b"" if self.library.is_control(k) or self.library.is_unknown(k) else n.replace(SPACE, " ").encode() for k, n in enumerate(names)]
        self.one = self.library.piece_to_id(SPACE)
        self.ids = pieces.WordIds(self._learn, pa.array(table, pa.large_binary()))
        self.cut = pieces.spaced_words

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # the library puts one space before what it is given, but gives nothing for an empty text
        found = self.library.encode([w[1:].decode() for w in words], num_threads=1)
        return pieces.packed([[self.one] if w == b" " else ids for w, ids in zip(words, found, strict=True)])


class Side:
    """One vocabulary over the texts of a block: ids, byte ranges from the start of the block, tokens per text."""

    def __init__(self, vocabulary, texts: list[str]):
        found, counts = vocabulary.cut(texts)
        words, index = pieces.distinct(found)
        flat, sizes, refused = vocabulary.ids.look(words)
        self.bad = pieces.per_text(refused[index], counts) > 0
        self.ids, per_place = pieces.spread(index, flat, sizes)
        self.n = pieces.per_text(per_place, counts)
        width = vocabulary.ids.width[self.ids]
        self.ends = np.cumsum(width)
        self.starts = self.ends - width


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the intervals of A and of B: a group ends where the next start reaches the greatest end so far."""
    start, end = np.concatenate((a_start, b_start)), np.concatenate((a_end, b_end))
    side = np.repeat(np.array([0, 1], np.int8), [len(a_start), len(b_start)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    group = np.zeros(len(start), np.int64)
    group[order[1:]] = np.cumsum(start[order][1:] >= reach[:-1])
    return group[: len(a_start)], group[len(a_start) :]


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of an interval of A and one of B that share a byte; both sides are in order and without gaps, so pairs stay within groups."""
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = high - low
    i = np.repeat(np.arange(len(a_start)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


class Writer:
    """Groups as text: ids of A joined by commas, a bar, ids of B; groups are joined by semicolons."""

    def __init__(self, size: int):
        self.size = size
        self.table = pa.array([f"{k}{mark}".encode() for mark in (",", "|", ";", "") for k in range(size)], pa.large_binary())

    def write(self, a: Side, b: Side, group_a: np.ndarray, group_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The text of all documents of a block, and where each ends."""
        n = int(group_a[-1]) + 1 if len(group_a) else 0
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        at_a = np.arange(len(group_a)) + (np.cumsum(in_b) - in_b)[group_a]
        at_b = np.arange(len(group_b)) + np.cumsum(in_a)[group_b]
        last_a, last_b = np.zeros(len(group_a), np.int64), np.zeros(len(group_b), np.int64)
        last_a[np.cumsum(in_a) - 1] = 1
        last_b[np.cumsum(in_b) - 1] = 2
        ends_b = np.cumsum(b.n)
        last_b[ends_b[b.n > 0] - 1] = 3
        chosen = np.empty(len(group_a) + len(group_b), np.int64)
        chosen[at_a] = a.ids + last_a * self.size
        chosen[at_b] = b.ids + last_b * self.size
        if not len(chosen):
            return b"", np.zeros(len(a.n), np.int64)
        text = self.table.take(pa.array(chosen))
        offsets = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1]
        return text.buffers()[2].to_pybytes()[: offsets[-1]], offsets[np.cumsum(a.n + b.n)]


def align_block(first: ByteLevel, second: Pieces, writer: Writer, texts: list[str]) -> dict:
    """Tokens, groups and links of the texts of a block, each with a space before it; see :func:`aligned` for texts without tokens."""
    kept = np.array([bool(t) and SPACE not in t for t in texts], bool)
    while True:
        spaced = [" " + t if ok else "" for t, ok in zip(texts, kept.tolist(), strict=True)]
        a, b = Side(first, spaced), Side(second, spaced)
        bad = a.bad | b.bad
        if not bad.any():
            break
        kept &= ~bad  # such a text has no tokens on either side
    group_a, group_b = coalesce(a.starts, a.ends, b.starts, b.ends)
    i, j = overlaps(a.starts, a.ends, b.starts, b.ends)
    linked = a.ends[i] == b.ends[j]
    i, j = i[linked], j[linked]
    text, ends = writer.write(a, b, group_a, group_b)
    # groups and links of a document: those of its tokens of A
    ends_a = np.cumsum(a.n)
    fresh = np.concatenate(([True], group_a[1:] != group_a[:-1]))[: len(group_a)]
    n_links = np.diff(np.searchsorted(i, np.concatenate(([0], ends_a))))
    return {"a": a, "b": b, "n_groups": pieces.per_text(fresh, a.n), "n_links": n_links, "link_a": a.ids[i], "link_b": b.ids[j], "text": text, "ends": ends}


def _listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array([values], pa.list_(kind))


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None, texts: bool = False) -> DataFrame:
    """One row per row of ``docs``: _rid, doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with ``texts`` also ``groups``.

    Both vocabularies encode space+text. All tokens of A and B of a block of documents are sorted by start; a group ends where a
    start reaches the greatest end so far, which is where tokens of both end. Within groups the overlapping pairs are
    expanded; those that end together are links. Links of an id pair are counted over the whole corpus: a block gives a row per
    distinct pair, which are summed, compared with the greatest count of their B id and joined back to (block, slot). A
    pair has at most one row per block, so a pair with a third of all links is no hot key.

    Null and empty texts, and those whose joined token bytes differ from space+text (as with U+2581 in them), have no tokens: zeros and
    an empty string. Rows of one id stay apart; an empty table gives no rows. A text of any length stays in one block, whose token
    places are held together. Columns other than doc_id and text are not read, whatever their names.
    """
    spark = docs.sparkSession
    doc_type = dict(docs.dtypes)["doc_id"]
    told = spark.sparkContext.broadcast(definitions(a, b))  # two vocabularies, some MB
    per_doc = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = ByteLevel(told.value[0]), Pieces(told.value[1])
        writer = Writer(max(len(first.ids.width), len(second.ids.width)))
        for rids, ids, listed in pieces.blocks(batches, BLOCK_CHARS):
            got = align_block(first, second, writer, listed)
            bounds = np.concatenate(([0], got["ends"])).tolist()
            said = [got["text"][p:q] for p, q in zip(bounds, bounds[1:])]
            marks = [hashlib.sha256(s).hexdigest() if s else "" for s in said]
            found = pa.array(got["link_a"].astype(np.int64) << 32 | got["link_b"]).dictionary_encode()
            slots, pairs = found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_numpy(zero_copy_only=False)
            counted = np.bincount(slots, minlength=len(pairs))
            packed = zstandard.ZstdCompressor(level=1).compress(slots.astype("<u4").tobytes())
            row = {
                "block": pa.array([rids[0]]), "rids": _listed(np.array(rids), pa.int64()), "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                "n_a": _listed(got["a"].n, pa.int64()), "n_b": _listed(got["b"].n, pa.int64()), "n_groups": _listed(got["n_groups"], pa.int64()), "n_links": _listed(got["n_links"], pa.int64()),
                "marks": pa.array([marks], pa.list_(pa.string())), "said": pa.array([[s.decode() for s in said] if texts else []], pa.list_(pa.string())), "slots": pa.array([packed], pa.binary()),
                "pair_a": _listed(pairs >> 32, pa.int64()), "pair_b": _listed(pairs & 0xFFFFFFFF, pa.int64()), "pair_n": _listed(counted, pa.int64()),
            }
            yield pa.RecordBatch.from_arrays(list(row.values()), list(row))
        release()

    shape = f"block long, rids array<long>, doc_ids array<{doc_type}>, " + ", ".join(f"{c} array<long>" for c in per_doc)
    schema = shape + ", marks array<string>, said array<string>, slots binary, pair_a array<long>, pair_b array<long>, pair_n array<long>"
    blocks = stage(row_id(docs.select("doc_id", "text")).select("_rid", "doc_id", "text").mapInArrow(run, schema), "aligned")

    zipped = F.arrays_zip("pair_a", "pair_b", "pair_n")
    pairs = blocks.select("block", F.posexplode(zipped).alias("slot", "p")).select("block", "slot", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = stage(counts, "pair-counts")
    greatest = counts.groupBy("b").agg(F.max("count").alias("most"))
    judged = counts.join(greatest, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    back = pairs.join(judged, ["a", "b"]).select(F.col("block").alias("home"), "slot", "count", "best")

    def score(block: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("slot").to_numpy())
        count, best = known.column("count").to_numpy()[order], known.column("best").to_numpy()[order].astype(np.int64)
        out = []
        for row in block.to_batches():
            for k in range(row.num_rows):
                slots = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.column("slots")[k].as_py()), "<u4")
                links = row.column("n_links")[k].values.to_numpy()
                cols = {"_rid": row.column("rids")[k].values, "doc_id": row.column("doc_ids")[k].values} | {c: row.column(c)[k].values for c in per_doc}
                cols["n_best"] = pa.array(pieces.per_text(best[slots], links))
                cols["count_sum"] = pa.array(pieces.per_text(count[slots], links))
                cols["groups_sha256"] = row.column("marks")[k].values
                cols["groups"] = row.column("said")[k].values if texts else pa.nulls(len(links), pa.string())
                out.append(pa.table(cols))
        release()
        return pa.concat_tables(out)

    result = f"_rid long, doc_id {doc_type}, " + ", ".join(f"{c} long" for c in [*per_doc, "n_best", "count_sum"]) + ", groups_sha256 string, groups string"
    scored = blocks.select("block", "rids", "doc_ids", *per_doc, "marks", "said", "slots").groupBy("block").cogroup(back.groupBy("home")).applyInArrow(score, result)
    return scored if texts else scored.drop("groups")

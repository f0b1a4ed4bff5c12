"""Language ID with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from ebbtide.llm.common import release

UNDETERMINED = "und"
DIMENSIONS = 512
#: Letters are told apart up to this many code points; beyond, code points share vectors.
LETTERS = 1024
SEED = 7
#: Letters of a text that are counted at a time.
CHUNK = 1 << 20


def letter_vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    """One random vector of -1 and 1 per letter, the same in every process; place 0 is the gap between words."""
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (LETTERS, dimensions))


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams of a whole text as numbers, and their counts.

    Letters are lower-cased; a run of other characters is one gap, also before and after the text.
    Trigrams around a gap (letter, gap, letter) are left out, for they join two words.
    """
    found: dict[int, int] = {}
    tail = np.zeros(1, np.int32)
    for at in range(0, max(1, len(text)), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "replace"), np.uint32)
        ids = np.where(_is_letter(points), points % np.uint32(LETTERS - 1) + 1, 0).astype(np.int32)
        ids = np.concatenate([tail, ids, np.zeros(int(at + CHUNK >= len(text)), np.int32)])
        ids = ids[np.concatenate(([True], (ids[1:] != 0) | (ids[:-1] != 0)))]
        tail = ids[-2:]
        grams = ((ids[:-2] * LETTERS) + ids[1:-1]) * LETTERS + ids[2:]
        codes, counts = np.unique(grams[ids[1:-1] != 0], return_counts=True)
        if len(text) <= CHUNK:
            return codes, counts
        for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
            found[c] = found.get(c, 0) + n
    return np.fromiter(found, np.int32, len(found)), np.fromiter(found.values(), np.int64, len(found))


def _letter_table() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return out


_TABLE: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letter_table())
    return _TABLE[0][points]


class Space:
    """Document vectors: trigram vectors bundled with their counts."""

    def __init__(self, dimensions: int = DIMENSIONS):
        letters = letter_vectors(dimensions)
        self.dimensions = dimensions
        self.shifted = [np.roll(letters, s, axis=1) for s in (2, 1, 0)]  # a permutation per place

    def bind(self, codes: np.ndarray) -> np.ndarray:
        """Trigram vectors: the product of the permuted vectors of the three letters."""
        a, b, c = codes // LETTERS**2, codes // LETTERS % LETTERS, codes % LETTERS
        return self.shifted[0][a] * self.shifted[1][b] * self.shifted[2][c]

    def vectors(self, texts: list[str]) -> np.ndarray:
        """One bundle per text, zero for a text without letters."""
        parts = [trigrams(t) for t in texts]
        which = np.repeat(np.arange(len(texts)), [len(c) for c, _ in parts])
        codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        table = np.zeros((len(texts), len(codes)), np.float32)
        table[which, place] = np.concatenate([n for _, n in parts])
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for at in range(0, len(codes), 8192):
            out += table[:, at : at + 8192] @ self.bind(codes[at : at + 8192]).astype(np.float32)
        return out

    def unit(self, texts: pa.Array, group: int = 64) -> Iterator[tuple[list[int], np.ndarray]]:
        """(places, unit vectors) of the texts that have letters, in groups of a bounded size."""
        for at in range(0, len(texts), group):
            v = self.vectors([t or "" for t in texts[at : at + group].to_pylist()])
            size = np.linalg.norm(v, axis=1)
            has = np.flatnonzero(size)
            yield (has + at).tolist(), v[has] / size[has, None]


def train(labelled: DataFrame, dimensions: int = DIMENSIONS, sample: int | None = 5_000) -> tuple[list[str], np.ndarray]:
    """Prototypes: for each language the sum of the unit vectors of its documents.

    ``labelled`` has text and lang. With ``sample``, a row is used if a hash of its text falls below a bound that
    leaves about ``sample`` rows of each language; None uses every row. Partial sums are made in the
    tasks, so the driver gets one vector per language and task.
    """
    rows = labelled.select("text", "lang").filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sample is not None:
        place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
        share = F.lit(0.0)
        for name, n in counts.items():
            share = F.when(F.col("lang") == name, F.lit(min(1.0, sample / n))).otherwise(share)
        rows = rows.filter(place < share)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dimensions), {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for at, unit in space.unit(b.column("text")):
                for k, v in zip(at, unit, strict=True):
                    sums[langs[k]] = sums.get(langs[k], 0) + v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.astype(np.float64).tolist() for s in sums.values()])], ["lang", "v"])
        release()

    summed: dict[str, np.ndarray] = {}
    parts = rows.mapInArrow(partial, "lang string, v array<double>")
    whole = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    for r in whole.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).collect():
        summed[r["lang"]] = np.array([e["x"] for e in r["v"]])
    names = sorted(summed)
    if not names:
        return [], np.zeros((0, dimensions), np.float32)
    made = np.stack([summed[n] / np.linalg.norm(summed[n]) for n in names])
    return names, np.round(made, 6).astype(np.float32)  # rounded: the order of summing must not decide


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row of ``docs`` from its whole text.

    The prediction is the language whose prototype has the largest cosine with the document, the
    first by name on ties; score is that cosine, held to 0 to 1. Null texts, texts without any letter
    and tables without a labelled row give ``und`` and 0. Only text is read; other columns are carried, and columns
    that bear the names of the results are replaced.
    """
    dimensions = prototypes.shape[1]
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    base = docs.select(*[F.col(f"`{c}`") for c in kept])
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((names, prototypes))  # languages x dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, protos = model.value
        space = Space(dimensions)
        for b in batches:
            preds, scores = [UNDETERMINED] * b.num_rows, [0.0] * b.num_rows
            for at, unit in space.unit(b.column("text")) if langs else ():
                cosines = unit @ protos.T
                for k, best, c in zip(at, cosines.argmax(axis=1).tolist(), cosines.max(axis=1).tolist(), strict=True):
                    preds[k], scores[k] = langs[best], min(1.0, max(0.0, c))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], schema=pa.schema([*b.schema, ("lang_pred", pa.string()), ("score", pa.float64())]))
        release()

    schema = StructType([*base.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return base.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents that training must not see: CRC-32 of the id as text is 2 modulo 4; without id they are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predictions(docs: DataFrame, dimensions: int = DIMENSIONS, sample: int | None = 5_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that are not held out."""
    mine = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    names, prototypes = train(mine.filter("not held_out"), dimensions, sample)
    return identify(mine.select("doc_id", "text", "held_out"), names, prototypes).select("doc_id", "held_out", "lang_pred", "score")


def recognised(docs: DataFrame, dimensions: int = DIMENSIONS, sample: int | None = 5_000, least: float = 0.1, enough: int = 200) -> DataFrame:
    """Documents with a recognised language, in the columns of ``docs``.

    Rows without letters go, and rows of at least ``enough`` code points whose cosine with the best prototype is
    below ``least``: text in none of the languages learned. Shorter texts say too little to be rejected.
    """
    names, prototypes = train(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))), dimensions, sample)
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    judged = identify(packed, names, prototypes)
    return judged.filter((F.col("lang_pred") != UNDETERMINED) & ((F.col("score") >= least) | (F.length("text") < enough))).select("_row.*")

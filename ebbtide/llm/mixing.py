"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.llm.common import fixed, small_side, stage

#: Bits of the hash that one histogram resolves.
LEVEL_BITS = 12
HASH_BITS = 60
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and tab to carriage return; null has none."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def spread(doc_id: Column) -> Column:
    """Sixty bits of the MD5 digest of the id as text; rows without id share one value."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size) -> source, source_size, target.

    Sources ordered by code point, null last, take ``weights`` in turn. ``share`` of all words is
    dealt by weight; a target stops at ``cap`` times its source, and the excess goes to the others by
    weight until none is above. A source is capped at level x if cap * size / weight <= x, so the
    level follows from running sums over sources in that order: one row per source, however large
    the corpus, and the order by source name runs over the same rows.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])
    named = sizes.withColumn("_w", F.element_at(turn, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    by_cap = every.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    rising = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    falling = by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("_cap").over(rising), F.lit(0.0))) / F.sum("_w").over(falling)
    ranked = named.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_level", level)
    free = F.min(F.when(F.col("_cap") > F.col("_w") * F.col("_level"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("x")))).over(every)["x"]
    return ranked.withColumn("_x", free).select("source", "source_size", F.coalesce(F.least("_cap", F.col("_w") * F.col("_x")), "_cap").alias("target"))


def _digit(level: int) -> Column:
    """Digit of a level of the order (hash, text hash, row): twelve bits each from the top."""
    wide = HASH_BITS // LEVEL_BITS
    if level < wide:
        return F.shiftright("_h", HASH_BITS - LEVEL_BITS * (level + 1)).bitwiseAND((1 << LEVEL_BITS) - 1)
    key, at = ("_t", level - wide) if level < wide + 6 else ("_r", level - wide - 6)
    low = 64 - LEVEL_BITS * (at + 1)
    return (F.shiftrightunsigned(key, low) if low >= 0 else F.col(key)).bitwiseAND((1 << (LEVEL_BITS if low >= 0 else LEVEL_BITS + low)) - 1)


def thresholds(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, int]:
    """Nested cuts: for each source the digits of its boundary row, and how many digits are settled.

    A histogram of words by source and digit gives the bucket where the remainder ends. Only rows
    of that bucket go into the next, finer histogram. It ends when every boundary bucket holds one
    row at most; rows equal in id and text are told apart by their row number in the last levels.
    """
    state = wanted.select("_s", F.col("_left"), F.array().cast("array<long>").alias("_cut"))
    inside = rows.filter("size > 0")
    for level in range(HASH_BITS // LEVEL_BITS + 12):
        bins = (
            inside.join(small_side(state), "_s").groupBy("_s", "_left", "_cut", _digit(level).alias("_d"))
            .agg(F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_n"))
        )
        run = Window.partitionBy("_s").orderBy("_d")
        before = F.coalesce(F.sum("_words").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = bins.withColumn("_before", before).filter("_before <= _left and _left < _before + _words")
        state = stage(
            placed.select("_s", (F.col("_left") - F.col("_before")).alias("_left"), F.concat("_cut", F.array("_d")).alias("_cut"), F.col("_n"), F.col("_words")),
            "cuts",
        )
        open_ = state.filter("_n > 1").select("_s", "_left", "_cut")
        settled = state if level == 0 else settled.join(state.select(F.col("_s"), F.lit(True).alias("_new")), "_s", "left_anti").unionByName(state)
        if open_.isEmpty():
            break
        inside = inside.join(small_side(open_.select("_s", F.element_at("_cut", level + 1).alias("_d"))), "_s").filter(_digit(level) == F.col("_d")).drop("_d")
        state = open_
    return settled, level


def _keyed(docs: DataFrame) -> DataFrame:
    """Size, source key and the three parts of the order of every document.

    The source key is never null, so that plain joins hold the null source too.
    """
    return docs.withColumns(
        {
            "size": word_count(F.col("text")),
            "_s": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")),
            "_h": spread(F.col("doc_id")),
            "_t": F.xxhash64("text"),
            "_r": F.monotonically_increasing_id(),
        }
    )


def plan(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> tuple[DataFrame, int]:
    """One row per source: target, how often every document is taken, and the cut for once more."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    wanted = targets(sizes, weights, share, cap).withColumn("_whole", whole).withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    wanted = stage(wanted.withColumn("_left", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long")).drop("source"), "targets")
    cuts, level = thresholds(rows.select("_s", "size", "_h", "_t", "_r"), wanted.filter("_left > 0"))
    return stage(wanted.join(cuts.select("_s", "_cut", F.col("_left").alias("_rest")), "_s", "left"), "found"), level


def decide(keyed: DataFrame, found: DataFrame, level: int) -> DataFrame:
    """Add the source's figures and ``taken``; one comparison of digits per document, no shuffle while sources are few."""
    digits = F.array(*[_digit(k) for k in range(level + 1)])
    mine = F.slice(digits, 1, F.size("_cut"))
    extra = F.when(F.col("_cut").isNull(), F.col("_left") > 0).otherwise((mine < F.col("_cut")) | ((mine == F.col("_cut")) & (F.col("_rest") * 2 >= F.col("size"))))
    times = F.col("_whole") + F.when(extra & (F.col("size") > 0), 1).otherwise(0)
    return keyed.join(small_side(found), "_s").withColumn("_times", times).withColumn("taken", F.col("size") * F.col("_times"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """Words that a mix takes of each document: doc_id, source, size, source_size, target, taken.

    Every document of a source is taken floor(target / source size) times; the documents up to a
    threshold of the hash of their id are taken once more, up to the remainder. The boundary document
    is taken too if that brings the words nearer to the target. Nothing is sorted.

    Null text has size 0. Null sources are one source, last in order. Rows of one id are ordered by
    the hash of their text, equal rows by their place. Empty documents are taken with 0 words; a
    source of empty documents has target 0. An empty table gives no rows. Columns of ``docs`` other
    than doc_id, text and source are not read.
    """
    rows = stage(_keyed(docs.select("doc_id", "text", "source")).drop("text"), "sizes")
    found, level = plan(rows, weights, share, cap)
    return decide(rows, found, level).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as :func:`mix` takes it, in the columns of ``docs``.

    ``docs`` is scanned twice and never shuffled. Rows without words are left out, for they add nothing.
    """
    docs = fixed(docs)
    keyed = _keyed(docs.select("doc_id", "text", "source"))
    found, level = plan(stage(keyed.drop("text"), "sizes"), weights, share, cap)
    names = docs.columns
    packed = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    taken = decide(_keyed(packed), found, level).filter("taken > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("_row.*")

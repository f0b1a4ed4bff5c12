"""Benchmark decontamination: n-gram windows of the test items looked up in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import BROADCAST_ROWS, ascii_lower, fixed, fresh, row_id, small_side, stage

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, then runs of digits, a-z and characters beyond ASCII."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), NOT_WORD), "")


def item_windows(items: DataFrame, n: int) -> DataFrame:
    """(item_id, text) -> window, length, items: every window of n words and the items that hold it.

    Items of fewer words, but not none, are one window of their own length.
    """
    listed = items.select("item_id", words(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - n + 1, F.lit(1)))
    parts = listed.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("_w", i, n))).alias("_p"))
    return parts.groupBy(F.concat_ws(" ", "_p").alias("window"), F.size("_p").alias("length")).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def _starts(length: int) -> Column:
    """Hash of the words at every place of a document where a window of ``length`` may start."""
    last = F.size("_w") - length + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("_w", i, length)))).otherwise(F.array().cast("array<bigint>"))


def hits(docs: DataFrame, windows: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """(row id, start, length, items) of every occurrence of a window in the documents.

    Every token window of a document is hashed and looked up in the set of window hashes; a hit is
    verified word by word. With ``small`` the set is broadcast and the look-up runs inside the scan, so no text is
    shuffled; else the hashes are shuffled, and the documents with hash hits are read again to verify.
    """
    found = []
    for length in lengths:
        probe = windows.filter(F.col("length") == length).select(F.xxhash64(F.split("window", " ")).alias("_h"), "window", "items")
        probe = F.broadcast(probe) if small else probe
        listed = docs.select("_rid", words(F.col("text")).alias("_w"))
        kept = ["_rid", "_w"] if small else ["_rid"]
        met = listed.select(*kept, F.posexplode(_starts(length)).alias("_at", "_h")).join(probe, "_h")
        if not small:
            met = met.join(listed, "_rid")
        sure = F.concat_ws(" ", F.slice("_w", F.col("_at") + 1, length)) == F.col("window")
        found.append(met.filter(sure).select("_rid", F.col("_at").alias("start"), F.lit(length).alias("length"), "items"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _covered(spans: Column) -> Column:
    """Words inside the union of (start, length) spans, given in order of start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(a, s):
        end = s["start"] + s["length"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(end - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"))

    return F.aggregate(spans, zero, add, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, broadcast_windows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    ``spans`` lists the hit windows as (start, length) in words, in order. The set of windows is
    broadcast up to ``broadcast_windows`` of them (at most some 200 bytes each), else shuffled.

    Null and empty texts have no words and no hits, in documents and items alike. Items without id
    count as hits but are not listed; repeated items of one id are one item. Rows of ``docs`` are
    judged one by one, whether or not ids repeat. Without items nothing is hit. Other columns are
    not read.
    """
    docs = fixed(docs)
    windows = stage(item_windows(items, n), "windows")
    sizes = windows.groupBy("length").count().collect()  # n rows at most
    base = row_id(docs.select("doc_id", "text"))
    counted = base.select("_rid", "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<struct<start:int,length:int>>")
    if not sizes:
        found = counted.select("_rid", none.alias("spans"), F.array().cast("array<string>").alias("items")).limit(0)
    else:
        small = sum(r["count"] for r in sizes) <= broadcast_windows
        found = hits(base, windows, sorted(r["length"] for r in sizes), small).groupBy("_rid").agg(
            F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
        )
    joined = counted.join(found, "_rid", "left").withColumns({"spans": F.coalesce("spans", none), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return joined.select(
        "doc_id", "n_words", _covered(F.col("spans")).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans", "_rid",
    )


def clean_documents(docs: DataFrame, items: DataFrame, n: int = 10, broadcast_windows: int = BROADCAST_ROWS) -> DataFrame:
    """Documents without any hit, in the columns of ``docs``.

    The list of contaminated rows is stored and anti-joined; texts are shuffled only if it is too
    long to broadcast.
    """
    docs = fixed(docs)
    bad = stage(contamination(docs, items, n, broadcast_windows).filter("contaminated").select("_rid"), "contaminated")
    rid = fresh(docs)
    return row_id(docs, rid).join(small_side(bad.select(F.col("_rid").alias(rid))), rid, "left_anti").drop(rid)

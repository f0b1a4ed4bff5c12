"""CSV records with line breaks inside quoted cells, read from splittable files by many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ends_inside(line: str, inside: bool, quote: str = '"', comma: str = ",") -> bool:
    """Whether a quoted cell is open after ``line``, given whether one was before.

    A quote opens a cell only as its first character, so quotes in the middle of plain cells mean nothing; two quotes inside a
    quoted cell are one; what follows a closing quote belongs to the cell up to the next comma.
    """
    at = 0
    while True:
        if not inside:
            if line.startswith(quote, at):
                inside, at = True, at + 1
            else:
                at = line.find(comma, at)
                if at < 0:
                    return False
                at += 1
                continue
        while True:
            at = line.find(quote, at)
            if at < 0:
                return True
            if not line.startswith(quote, at + 1):
                break
            at += 2
        inside = False
        at = line.find(comma, at + 1)
        if at < 0:
            return False
        at += 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """Lines of a task in order, by file and input split; a split may come in several runs."""
    for b in batches:
        file, block, line = (b.column(c).to_pylist() for c in ("file", "block", "line"))
        at = 0
        for k in range(1, b.num_rows + 1):
            if k == b.num_rows or file[k] != file[at] or block[k] != block[at]:
                yield file[at], block[at], line[at:k]
                at = k


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split, for either state before it: the state after it, and whether a record begins in it."""
    state, out = None, []
    for file, block, lines in _runs(batches):
        if state is None or state["file"] != file or state["block"] != block:
            state = {"file": file, "block": block, "closed": False, "open": True, "begins_open": False}
            out.append(state)
        for line in lines:
            state["begins_open"] |= not state["open"]
            if '"' in line:
                state["closed"], state["open"] = ends_inside(line, state["closed"]), ends_inside(line, state["open"])
    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("closed", pa.bool_()), ("open", pa.bool_()), ("begins_open", pa.bool_())]))


def _states(summary: list) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """(file, block) -> state before the split, block that began the record open there, place of the split in the order of all."""
    out, file, inside, owner = {}, None, False, 0
    for number, r in enumerate(sorted(summary, key=lambda r: (r["file"], r["block"]))):
        if r["file"] != file:
            file, inside, owner = r["file"], False, r["block"]
        out[file, r["block"]] = (inside, owner, number)
        if not inside or r["begins_open"]:
            owner = r["block"]
        inside = r["open"] if inside else r["closed"]
    return out


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, place, record): every CSV record of the UTF-8 files below ``path``, in files cut at any byte.

    Pass one reads the lines of each input split and notes, for a quoted cell open or closed before it, how it ends. These notes,
    a row per split, are put in order on the driver, which gives the true state before each split. Pass two joins
    lines to records inside each split; the pieces of a record that runs over splits, at most two per split, are
    shuffled by the split that began it. Lines end with a line feed, before which a carriage return is dropped at the end of a
    record and kept inside cells. Blank records are left out. A record is held in memory whole; a file that ends inside a
    quoted cell gives what it has as the last record. No file gives no rows.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    summary = lines.mapInArrow(_summary, "file string, block long, closed boolean, open boolean, begins_open boolean").collect()  # a row per split
    told = spark.sparkContext.broadcast(_states(summary))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("place", pa.int64()), ("record", pa.string()), ("owner", pa.int64())])
        here, out, held, inside, place, number, owner = None, [], [], False, 0, 0, None

        def close(open_: bool) -> None:
            nonlocal held, place, owner
            if held:
                out.append({"file": here[0], "split": number, "place": place, "record": "\n".join(held), "owner": owner if owner is not None else here[1] if open_ else None})
            held, place, owner = [], place + 1, None

        for file, block, lines_ in _runs(batches):
            if (file, block) != here:
                close(inside)
                here, place = (file, block), 0
                inside, began, number = told.value[here]
                owner = began if inside else None
            for line in lines_:
                if not inside:
                    close(False)
                held.append(line)
                if '"' in line:
                    inside = ends_inside(line, inside)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        close(inside)
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    # places count from 1 where a record begins the split, so a piece at its head has place 0
    joined = lines.mapInArrow(join, "file string, split long, place long, record string, owner long")
    parts = F.array_sort(F.collect_list(F.struct("split", "place", "record")))
    over = joined.filter("owner IS NOT NULL").groupBy("file", "owner").agg(parts.alias("p")).select(
        "file", F.col("p")[0]["split"].alias("split"), F.col("p")[0]["place"].alias("place"), F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")
    )
    every = joined.filter("owner IS NULL").drop("owner").unionByName(over)
    return every.withColumn("record", F.regexp_replace("record", "\r$", "")).filter(F.length(F.trim("record")) > 0)


def read_quoted_csv(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Header cells and rows (source_file, source_row, cells array<string>) of CSV files with one header and line breaks in cells.

    Files with another header than the first are refused.
    """
    rows = records(spark, path)
    # the first record of a file; blank lines before it are left out above
    first = rows.groupBy("file").agg(F.min(F.struct("split", "place", "record")).alias("r"))
    heads = [r["h"] for r in first.select(F.regexp_replace("r.record", "^﻿", "").alias("h")).distinct().limit(2).collect()]
    if len(heads) > 1:
        raise ValueError("the files have different headers")
    if not heads:
        return [], spark.createDataFrame([], "source_file string, source_row long, cells array<string>")
    # a header has no more cells than commas and one
    width = heads[0].count(",") + 1
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    parsed = F.from_csv("record", ", ".join(f"c{k} string" for k in range(width)), options)
    head = spark.range(1).select(F.lit(heads[0]).alias("record")).select(parsed.alias("c")).select("c.*").first()
    names = [head[k] for k in range(width)]
    while names and names[-1] is None:
        names.pop()
    starts = first.select("file", F.col("r.split").alias("_s"), F.col("r.place").alias("_p"))
    body = rows.join(F.broadcast(starts), "file").filter((F.col("split") != F.col("_s")) | (F.col("place") != F.col("_p")))  # a row per file
    parsed = F.from_csv("record", ", ".join(f"c{k} string" for k in range(len(names))), options)
    cells = F.array(*[F.col(f"_c.c{k}") for k in range(len(names))])
    out = body.withColumn("_c", parsed).select(F.col("file").alias("source_file"), (F.shiftleft("split", 33) + F.col("place")).alias("source_row"), cells.alias("cells"))
    return [n or "" for n in names], out

"""CSV files with line breaks in cells, cut at any byte, against the whole-file reader and Python's own."""

import csv
import io
import random

import pytest

from ebbtide.sources.csv_records import ends_inside, records
from ebbtide.sources.imports import read_import_csv

NASTY = ["plain", "", "a,b", 'say "hi"', "line\nbreak", "two\n\nbreaks", 'quote "\nand, break"', '"', '""', "\n", "é中", " lead", "x" * 300, "end\\", "windows\r\nbreak"]


def made(path, n=400, seed=3, end="\n"):
    rng = random.Random(seed)
    rows = [[str(i), rng.choice(NASTY), rng.choice(NASTY), rng.choice(["1", "2", ""])] for i in range(n)]
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["﻿Row", "Message  Text", "Other", "Flag"])
        w.writerows(rows)
    return rows


def read(spark, path, size):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", min(size, 7))
        df = read_import_csv(spark, path, multi_line=True)
        return df.columns, df.orderBy("source_file", "source_row").drop("source_file", "source_row").collect(), records(spark, path).rdd.getNumPartitions()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("size", [37, 211, 1000, 100_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_cut_gives_the_rows_written(spark, tmp_path, size, end):
    path = str(tmp_path / "a.csv")
    rows = made(path, 120 if size < 100 else 400, end=end)
    columns, got, _ = read(spark, path, size)
    assert columns == ["row", "message_text", "other", "flag", "source_file", "source_row"]
    assert [list(r) for r in got] == [[c or None for c in r] for r in rows]


def test_equals_the_whole_file_reader(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    made(path, 300, 8)
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path).collect()
    _, got, parts = read(spark, path, 500)
    assert sorted(tuple(c or "" for c in r) for r in got) == sorted(tuple(c or "" for c in r) for r in raw)


def test_one_file_is_many_tasks(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    made(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
        assert lines.rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_cell_over_many_splits(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    long = "\n".join(f"line {i}, still \"inside\"" for i in range(200))
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f)
        w.writerows([["k", "t"], ["1", long], ["2", "x"]])
    _, got, _ = read(spark, path, 100)
    assert [tuple(r) for r in got] == [("1", long), ("2", "x")]


def test_stray_quotes_short_rows_blank_lines_and_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,t\n1,5" pipe\n\n2\n3,a,too many\n4,"q" tail\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('k,t\n5,"x\ny"\n', encoding="utf-8")
    _, got, _ = read(spark, str(tmp_path), 9)
    assert [r["k"] for r in got] == ["1", "2", "3", "4", "5"]
    assert [r["t"] for r in got][:3] == ['5" pipe', None, "a"] and got[4]["t"] == "x\ny"
    (tmp_path / "c.csv").write_text("t,k\n1,2\n", encoding="utf-8")
    with pytest.raises(ValueError):
        read(spark, str(tmp_path), 1000)


def test_header_alone_and_unclosed_cell(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,t\n", encoding="utf-8")
    columns, got, _ = read(spark, str(tmp_path / "a.csv"), 1000)
    assert columns[:2] == ["k", "t"] and got == []
    (tmp_path / "b.csv").write_text('k,t\n1,"open\nto the end', encoding="utf-8")
    _, got, _ = read(spark, str(tmp_path / "b.csv"), 5)
    assert len(got) == 1 and got[0]["k"] == "1"


def test_state_of_a_line():
    rng = random.Random(1)
    for _ in range(3000):
        cells = ["".join(rng.choice('a",\n') for _ in range(rng.randrange(6))) for _ in range(3)]
        f = io.StringIO()
        csv.writer(f, lineterminator="").writerow(cells)
        inside = False
        for line in f.getvalue().split("\n"):
            inside = ends_inside(line, inside)
        assert not inside
    assert ends_inside('a,"b', False) and not ends_inside('b"', True) and ends_inside('b""', True) and not ends_inside('a"b', False)

"""Mixing against a plain walk in hash order."""

import hashlib

import pytest

from ebbtide.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, _s string, taken int"


def brute(rows, weights=(5, 2, 1), cap=3.0):
    """rows: (doc_id, words, source) -> source -> (size, target, taken words)."""
    sizes = {}
    for _, n, s in rows:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not more:
            break
        capped |= more
    return sizes, {s: cap * sizes[s] if s in capped else weight[s] * level for s in names}


def mixed(spark, rows):
    df = spark.createDataFrame([(d, None if n is None else " ".join(["w"] * n), s, "x", "y", 0) for d, n, s in rows], SCHEMA)
    return mixing.mix(df).collect()


@pytest.mark.parametrize("case", ["many", "ties", "nulls"])
def test_targets_and_taken(spark, case):
    if case == "many":
        rows = [(i, i * 7 % 23, f"s{i % 5 if i % 3 else 0}") for i in range(400)]
    elif case == "ties":
        rows = [(1, 10, "a")] * 50 + [(2, 10, "b")] * 5 + [(None, 10, "c")] * 40  # repeated rows share a hash
    else:
        rows = [(None, None, None), (1, 5, None), (None, 3, "z"), (4, 0, "e"), (5, None, "e"), (6, 40, "ü"), (7, 1, "Z")] + [(i, 4, "Z") for i in range(20, 60)]
    sizes, want = brute([(d, n or 0, s) for d, n, s in rows])
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    words = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        words[r["source"]] = words.get(r["source"], 0) + r["taken"]
    longest = {s: max([n or 0 for _, n, t in rows if t == s]) for s in sizes}
    for s, n in words.items():
        assert abs(n - want[s]) <= longest[s] / 2 + 1
    assert sorted(map(str, got)) == sorted(map(str, mixed(spark, rows[::-1])))


def test_order_of_taking_is_the_hash(spark):
    rows = [(i, 3 + i % 5, "a") for i in range(300)] + [(1000 + i, 9, "b") for i in range(100)]
    got = {r["doc_id"]: r["taken"] // r["size"] for r in mixed(spark, rows)}
    for first, last in ((0, 300), (1000, 1100)):
        order = sorted(range(first, last), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        times = [got[i] for i in order]
        assert times == sorted(times, reverse=True) and max(times) - min(times) <= 1


def test_mixed_documents_repeat_rows(spark):
    rows = [(i, 5, "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame([(d, " ".join(["w"] * n), s, "x", "y", 0) for d, n, s in rows], SCHEMA)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    times = {r["doc_id"]: r["taken"] // 5 for r in mixing.mix(df).collect()}
    counts = {}
    for r in out.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts == {d: n for d, n in times.items() if n}


def test_empty_table_and_white_space(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
    texts = [" a\tb\x0bc\x0cd\re\n ", "", "   ", "a b", None, "x" * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r[0] for r in df.orderBy("i").select(mixing.word_count(df["text"])).collect()]
    assert got == [5, 0, 0, 1, 0, 1]

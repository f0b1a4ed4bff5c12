"""Near copies by word shingles against all pairs."""

import random

import numpy as np

import corpus_pipeline
from test_simhash import groups
from ebbtide.llm import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def sets(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near(a, b):
    return a == b or bool(a and b) and len(a & b) * 5 >= 4 * len(a | b)


def corpus():
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(60):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 100, 300]))]
        rows.append(w)
        for changes in (1, 2, 4, 6):
            rows.append([*w])
            for _ in range(changes):
                rows[-1][rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    rows += [[*passage, *[f"w{rng.randrange(3000)}" for _ in range(60)]] for _ in range(20)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(30):  # each near the next, the ends far apart
        chain = [*chain[2:], f"d{i}", f"e{i}"]
        rows.append(chain)
    texts = [" ".join(w) for w in rows]
    made = [(i, t) for i, t in enumerate(texts)] + [(9000, texts[0].upper()), (None, texts[5]), (None, ""), (8000, None), (8001, " \n"), (7, "one"), (7, "one"), (None, "alone")]
    return [(d, t, "x", "y", 1) for d, t in made]


def test_stage_keeps_one_of_each_group_of_similarity_four_fifths(spark):
    rows = corpus()
    s = [sets(r[1]) for r in rows]
    found = groups(len(rows), lambda i, j: near(s[i], s[j]))
    least = {}
    for r, g in zip(rows, found):
        least[g] = min((x for x in (r[0], least.get(g)) if x is not None), default=None)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(least.values(), key=str)


def test_empty_table(spark):
    assert shingles.deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_parities_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(1)
    for n, m in [(0, 0), (1, 1), (60, 70), (500, 620), (3000, 2500), (120, 130)]:
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: min(n, m) * 9 // 10], rng.integers(0, 2**64, max(0, m - min(n, m) * 9 // 10), dtype=np.uint64)]))
        assert shingles.differing(shingles.parities(a), shingles.parities(b)) <= len(np.setxor1d(a, b))


def test_sets_at_the_border_share_a_band():
    """At a similarity of 0.8 or a little more nearly all pairs are candidates; half as similar ones are few."""
    rng = np.random.default_rng(6)

    def share(similarity, n=200, pairs=300):
        both = round(2 * n * similarity / (1 + similarity))
        met = 0
        for _ in range(pairs):
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            b = np.concatenate([a[:both], rng.integers(0, 2**64, n - both, dtype=np.uint64)])
            met += bool(set(shingles.bands(np.unique(a))) & set(shingles.bands(np.unique(b))))
        return met / pairs

    assert share(0.81) >= 0.97 and share(0.9) == 1.0 and share(0.4) <= 0.1


def test_planted_copies_are_found(spark):
    """Texts with words changed here and there so that the similarity is 0.8 to 0.95: of the pairs that plain sets link, nine in ten or more are linked."""
    rng = random.Random(11)
    rows, want = [], set()
    for i in range(150):
        w = [f"w{rng.randrange(20000)}" for _ in range(rng.choice([80, 200, 500]))]
        v = [*w]
        for _ in range(max(1, round(len(w) * rng.choice([0.005, 0.01, 0.02])))):
            v[rng.randrange(len(v))] = f"x{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        if near(sets(rows[-2][1]), sets(rows[-1][1])):
            want.add(2 * i)
    found = {r["doc_id"]: r["component_id"] for r in shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = {i for i in want if found[i + 1] == i}
    assert len(want) > 90 and len(got) >= 0.97 * len(want)
    assert all(found[i] == i for i in found if i % 2 == 0)


def test_a_clashing_column_stays(spark):
    rows = spark.createDataFrame([(1, "a b c", 5), (1, "a b c", 6), (2, "d", 7)], "doc_id long, text string, _rid long")
    kept = shingles.deduplicated(rows)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]

"""SimHash groups against all pairs, and components against a union-find."""

import random
import re

import numpy as np
import pytest
import xxhash

from ebbtide.llm import components, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, fp string, root string, component_id int"


def plain(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def groups(n, near):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows):
    fps = [plain(t) for _, t in rows]
    found = groups(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    least = {}
    for (d, _), g in zip(rows, found):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(((d, f"{f:016x}", least.get(g)) for (d, _), f, g in zip(rows, fps, found)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "Déjà", "vu", "eins", "zwei", "x", "yy", "zzz", " odd"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    for i in range(40):  # long texts with one word changed
        w = [rng.choice(vocabulary) + str(rng.randrange(50)) for _ in range(700)]
        rows += [(1000 + 3 * i, " ".join(w)), (1001 + 3 * i, "\t".join(["other", *w[1:]])), (1002 + 3 * i, " ".join(w).upper())]
    return rows + [(None, ""), (5, None), (None, " \n "), (7, "one"), (7, "one"), (8, "ONE"), (9, "one two"), (None, "only here, without an id"), (77, "a b c " * 20_000)]


def test_groups_equal_all_pairs(spark, corpus):
    got = simhash.near_duplicates(frame(spark, corpus))
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()), key=str) == brute(corpus)


@pytest.mark.parametrize("cell", [1, 8])
def test_trie_join_at_every_depth(spark, cell):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    base[:20] = base[0] & ~np.uint64(0xFFFF) | rng.integers(0, 2**16, 20, dtype=np.uint64)  # one deep branch
    flip = [base]
    for _ in range(3):
        flip.append(flip[-1] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)))
    fps = np.unique(np.concatenate(flip)).view(np.int64).tolist()
    want = groups(len(fps), lambda i, j: bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 3)
    rows = simhash.linked_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long"), 3, cell).collect()
    root = {r["node"]: r["root"] for r in rows}
    mine = [root.get(f, f) for f in fps]
    names = {}
    assert len({names.setdefault(g, m) for g, m in zip(want, mine)}) == len(set(want)) == len(set(mine))
    assert all(names[g] == m for g, m in zip(want, mine))


def test_one_document_of_each_group_stays(spark, corpus):
    df = frame(spark, corpus)
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    fps = [plain(t) for _, t in corpus]
    found = groups(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    assert kept.count() == len(set(found))
    ids = {}
    for (d, _), g in zip(corpus, found):
        ids[g] = min((x for x in (d, ids.get(g)) if x is not None), default=None)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(ids.values(), key=str)


def test_empty_table(spark):
    empty = frame(spark, [])
    assert simhash.near_duplicates(empty).collect() == [] and simhash.deduplicated(empty).collect() == []


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(200)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    edges += [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(180)] + [(7, 7), (None, 3), (3, None), (300, 299)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    at = {n: i for i, n in enumerate(nodes)}
    linked = {(max(at[a], at[b]), min(at[a], at[b])) for a, b in edges if a is not None and b is not None and a != b}
    assert got == {n: nodes[g] for n, g in zip(nodes, groups(len(nodes), lambda i, j: (i, j) in linked))}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []

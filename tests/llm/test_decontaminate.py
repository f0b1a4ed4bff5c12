"""Decontamination against a plain scan."""

import hashlib
import re

from ebbtide.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= {str(x) for x in windows[key] if x is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


PASSAGE = "The quick brown fox jumps over the lazy dog while Zoë naps, 42 times"
DOCS = [
    (1, f"Intro. {PASSAGE.upper()}! Outro {PASSAGE}"),
    (2, "the quick brown fox jumps over the lazy dog while"),
    (3, "the quick brown fox jumps over the lazy dog, and more words follow here"),
    (4, None), (None, ""), (None, PASSAGE), (7, "Ünïts é É only"), (8, "short item"), (8, "a Short, item!"), (8, "a Short, item!"),
    (9, "x " * 20_000 + PASSAGE), (10, "short short item item short item"),
]
ITEMS = [(10, PASSAGE), (9, "and " + PASSAGE), (None, PASSAGE), (3, "short item"), (3, "É"), (5, None), (6, "..."), (11, "")]


def frames(spark, docs=DOCS, items=ITEMS):
    return (
        spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, items string, n_hit int"),
        spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, length int"),
    )


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_equals_a_plain_scan(spark):
    docs, items = frames(spark)
    want = brute(DOCS, ITEMS)
    assert result(decontaminate.contamination(docs, items)) == want
    assert result(decontaminate.contamination(docs, items, broadcast_windows=0)) == want


def test_empty_tables(spark):
    docs, items = frames(spark)
    nothing = items.limit(0)
    assert result(decontaminate.contamination(docs, nothing)) == brute(DOCS, [])
    assert decontaminate.contamination(docs.limit(0), items).collect() == []


def test_clean_documents_keep_columns_and_rows(spark):
    docs, items = frames(spark)
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns
    clean = [(d, t) for d, t in DOCS if not brute([(d, t)], ITEMS)[0][5]]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_main_path_is_native(spark, sf_dir):
    from ebbtide.llm import queries

    for name in ("op2_decontaminate", "op4_mix"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if x in plan]

"""The pipeline against the brute-force versions of its stages, and the SQL of single operators."""

import collections
import zlib

import duckdb
import numpy as np
import pytest
from test_decontaminate import brute as leaks
from test_shingles import near, sets
from test_simhash import groups
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from ebbtide.llm import language, mixing, queries, tokens
from ebbtide.llm.common import table

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in found.description)
    at = [[d[0] for d in found.description].index(c) for c in columns]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(tuple(r[i] for i in at) for r in found.fetchall())


def test_stages_one_after_the_other(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        ids = [r["doc_id"] for r in after]
        if name != "token_ids":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            preds = {r["doc_id"]: r for r in language.predictions(table(spark, sf_dir, "documents")).collect()}
            assert sorted(ids) == sorted(r["doc_id"] for r in before if preds[r["doc_id"]]["score"] >= 0.1 or 0 < preds[r["doc_id"]]["score"] and len(r["text"]) < 200)
        elif name == "near_duplicates":
            words = [sets(r["text"]) for r in before]
            found = groups(len(words), lambda i, j: near(words[i], words[j]))
            least = collections.defaultdict(list)
            for r, g in zip(before, found):
                least[g].append(r["doc_id"])
            assert sorted(ids) == sorted(min(v) for v in least.values())
        elif name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
            assert sorted(ids) == sorted(r[0] for r in leaks([(r["doc_id"], r["text"]) for r in before], items) if not r[5])
        elif name == "mix":
            times = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix(spark.createDataFrame(before)).collect()}
            assert collections.Counter(ids) == {d: n for d, n in times.items() if n}
        else:
            library = Tokenizer.from_file(tokens.vocabulary_file())
            want = [(r["doc_id"], library.encode(r["text"], add_special_tokens=False).ids) for r in before]
            want = sorted((d, len(i) + 1, zlib.crc32(np.array([*i, 0], "<u4").tobytes())) for d, i in want)
            assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in after) == want


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "token_ids"]

"""Language profiles: held-out accuracy, order of letters, odd texts."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import language

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int"


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = language.predictions(docs).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    tested = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in tested]) > 0.97


def test_held_out_labels_are_never_learned(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hidden = docs.withColumn("lang", F.when(~language.held_out(F.col("doc_id")), F.col("lang")).otherwise("xx"))
    rows = lambda d: sorted(tuple(r) for r in language.predictions(d).collect())
    assert rows(hidden) == rows(docs.withColumn("source", F.lit("none"))) == rows(docs)


def test_bundle_is_the_sum_of_bound_trigrams():
    space, text = language.Space(64), "Ab, abc zz-top Éa"
    letters = language.letter_vectors(64).astype(int)
    ids = [0] + [ord(c) % (language.LETTERS - 1) + 1 if c.isalpha() else 0 for c in text.lower()] + [0]
    ids = [c for i, c in enumerate(ids) if c or not i or ids[i - 1]]
    want = sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(ids, ids[1:], ids[2:]) if b)
    assert space.vectors([text])[0].tolist() == want.tolist()
    assert not np.array_equal(space.vectors(["abc"]), space.vectors(["cba"]))


def test_chunks_of_long_texts_meet(monkeypatch):
    text = "".join(chr(97 + i * i % 26) + " ," * (i % 7 == 0) for i in range(2000))
    whole = dict(zip(*[x.tolist() for x in language.trigrams(text)]))
    for chunk in (1, 7, 100):
        monkeypatch.setattr(language, "CHUNK", chunk)
        assert dict(zip(*[x.tolist() for x in language.trigrams(text)])) == whole


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, "the cat and the dog of the house " * 3, "en") for i in range(30)] + [(100 + i, "der Hund und die Katze von dem Haus " * 3, "de") for i in range(30)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "123 !!", "de"), (None, "the house and the cat", None), (None, "die Katze", "de"), (203, "x " * 200_000, "en"), (5, "the dog", "en"), (5, "the dog", "en")]
    return spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)


def test_odd_rows(frame):
    got = language.predictions(frame).collect()
    assert len(got) == frame.count()
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {200, 201, 202} and all(r["score"] == 0 for r in got if r["doc_id"] in und)
    assert {r["lang_pred"] for r in got} == {"und", "en", "de"}
    assert language.predictions(frame.limit(0)).collect() == []
    alone = language.predictions(frame.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in alone} == {"und"}


def test_rejects_keep_columns(frame):
    short = frame.sparkSession.createDataFrame([(300, "qzx vkj", None, "s", 1)], frame.schema)  # unlike both languages, but too short to say
    frame = frame.unionByName(short)
    kept = language.recognised(frame)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in frame.collect()} - {r["doc_id"] for r in kept.collect()} == {200, 201, 202, 203}  # the last is one letter over and over, like no language

"""Erasure over several stored tables: all or nothing, partitions that need no change keep their files, safe to run again."""

import datetime as dt

import pytest

from ebbtide.operators import erasure
from ebbtide.sources import catalog

NOW = dt.datetime(2024, 6, 1)


def day(k):
    return dt.date(2024, 1, 1 + k)


@pytest.fixture
def root(spark, tmp_path):
    bought = spark.createDataFrame([(i, i % 5, day(i % 4)) for i in range(40)] + [(90, None, None)], "tx_id long, customer_id long, day date")
    scored = spark.createDataFrame([(i, i % 5) for i in range(10)], "pred_id long, customer_id long")
    acts = spark.createDataFrame([(i, i) for i in range(10)] + [(77, None)], "action_id long, pred_id long")
    alone = spark.createDataFrame([(100 + i, 9, day(9)) for i in range(3)], "tx_id long, customer_id long, day date")
    folder = str(tmp_path / "db")
    catalog.put_tables(spark, folder, {"purchases": (bought.unionByName(alone), "day"), "predictions": (scored, None), "actions": (acts, None)})
    return folder


def rows(spark, root, name):
    return sorted(map(tuple, catalog.read_table(spark, root, name).collect()), key=str)


REFERENCES = {"actions": ("pred_id", "predictions")}


def test_erased_customers_are_gone_everywhere(spark, root):
    before = catalog.read_catalog(spark, root)[1]["purchases"]["parts"]
    gone = spark.createDataFrame([(2,), (2,), (None,), (55,)], "customer_id long")
    assert erasure.erase_stored(spark, root, gone, NOW, REFERENCES) == 3
    assert rows(spark, root, "purchases") == sorted([(i, i % 5, day(i % 4)) for i in range(40) if i % 5 != 2] + [(90, None, None)] + [(100 + i, 9, day(9)) for i in range(3)], key=str)
    assert rows(spark, root, "predictions") == sorted([(i, i % 5) for i in range(10) if i % 5 != 2], key=str)
    assert rows(spark, root, "actions") == sorted([(i, i if i % 5 != 2 else None) for i in range(10)] + [(77, None)], key=str)
    after = catalog.read_catalog(spark, root)[1]["purchases"]["parts"]
    assert after["2024-01-10"] == before["2024-01-10"] and after[catalog.NONE] == before[catalog.NONE]
    assert all(after[f"2024-01-0{k}"] != before[f"2024-01-0{k}"] for k in range(1, 5))
    assert sorted(r["customer_id"] for r in erasure.tombstones(spark, root).collect()) == ["2", "55"]


def test_a_second_run_finds_nothing(spark, root):
    gone = spark.createDataFrame([(2,)], "customer_id long")
    erasure.erase_stored(spark, root, gone, NOW, REFERENCES)
    version = catalog.read_catalog(spark, root)[0]
    assert erasure.erase_stored(spark, root, gone, NOW, REFERENCES) == 0
    assert catalog.read_catalog(spark, root)[0] == version


def test_a_killed_run_leaves_the_old_tables(spark, root, monkeypatch):
    names = ("purchases", "predictions", "actions")
    before = [rows(spark, root, n) for n in names]
    gone = spark.createDataFrame([(2,)], "customer_id long")
    publish = catalog.publish

    def killed(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(catalog, "publish", killed)
    with pytest.raises(KeyboardInterrupt):
        erasure.erase_stored(spark, root, gone, NOW, REFERENCES)
    assert [rows(spark, root, n) for n in names] == before and erasure.tombstones(spark, root).count() == 0
    monkeypatch.setattr(catalog, "publish", publish)
    assert erasure.erase_stored(spark, root, gone, NOW, REFERENCES) == 3
    assert all(r[1] != 2 for r in rows(spark, root, "purchases"))


def test_of_two_runs_at_once_one_is_refused(spark, root):
    base, content = catalog.read_catalog(spark, root)
    catalog.publish(spark, root, base, content)
    with pytest.raises(Exception, match="(?i)exist"):
        catalog.publish(spark, root, base, content)
    assert catalog.read_catalog(spark, root)[0] == base + 1


def test_a_partition_left_empty_and_imports_after(spark, root):
    erasure.erase_stored(spark, root, spark.createDataFrame([(9,)], "customer_id long"), NOW)
    assert "2024-01-10" not in catalog.read_catalog(spark, root)[1]["purchases"]["parts"]
    again = spark.createDataFrame([(9, "x"), (8, "y")], "customer_id long, name string")
    assert [r["customer_id"] for r in erasure.without_erased(spark, root, again).collect()] == [8]
    erasure.erase_stored(spark, root, spark.createDataFrame([(k,) for k in range(5)], "customer_id long"), NOW)
    assert rows(spark, root, "predictions") == [] and rows(spark, root, "purchases") == [(90, None, None)]

"""Boosted trees over binned blocks, against Spark's own fit and against themselves."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ebbtide.functions import boosting
from ebbtide.functions.trees import tree_nodes
from ebbtide.operators import training

NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def rows(spark):
    """Over 10,000 rows, so that split points come from a sample; one feature has three values and one is mostly zero."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 3))
    x[:, 1] = rng.integers(0, 3, len(x))
    x[:, 2] *= rng.random(len(x)) < 0.3
    y = x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(size=len(x)) > 1
    return spark.createDataFrame([(*map(float, v), int(p)) for v, p in zip(x, y)], "a double, b double, c double, churned int").repartition(5).cache()


def _nodes(model, spark):
    return tree_nodes(model.stages[-1], spark).orderBy("tree", "node").collect()


def test_a_fit_equals_that_of_spark(spark, rows):
    classes = training.class_weight(rows).first()
    weighted = rows.withColumn("weight", F.when(F.col("churned") == 1, F.lit(classes["scale_pos_weight"])).otherwise(1.0)).withColumn("churned", F.col("churned").cast("double"))
    stages = [VectorAssembler(inputCols=list(NAMES), outputCol="features"), GBTClassifier(labelCol="churned", weightCol="weight", maxIter=6, maxDepth=3, stepSize=0.1, seed=42)]
    stored = training.cut_lineage(weighted.select(*NAMES, "churned", "weight").repartition(training.fit_parts(12_000, spark.sparkContext.defaultParallelism)))
    want, got = Pipeline(stages=stages).fit(stored), training.train_risk_model(rows, NAMES, trees=6, depth=3)
    a, b = _nodes(want, spark), _nodes(got, spark)
    assert [(x.tree, x.node, x.left, x.right, x.feature, x.threshold) for x in a] == [(x.tree, x.node, x.left, x.right, x.feature, x.threshold) for x in b]
    assert np.allclose([(x.value, x.cover) for x in a], [(x.value, x.cover) for x in b], rtol=1e-6, atol=1e-9)
    assert np.allclose(want.stages[-1].featureImportances.toArray(), got.stages[-1].featureImportances.toArray(), atol=1e-9)
    kept = lambda m: [tuple(r) for r in m.stages[-1]._call_java("toDebugString").splitlines()[1:]]
    assert len(kept(want)) == len(kept(got)) and got.stages[-1].treeWeights == want.stages[-1].treeWeights
    theirs, ours = ({r["features"]: r["probability"][1] for r in m.transform(rows.limit(200)).collect()} for m in (want, got))
    assert theirs.keys() == ours.keys() and all(ours[k] == pytest.approx(v, abs=1e-9) for k, v in theirs.items())


def test_a_pass_sums_histograms_and_never_starts_a_fit_of_spark(rows, monkeypatch):
    """A level is one pass over the blocks: trees x levels, and one for the last leaves."""
    monkeypatch.setattr(GBTClassifier, "fit", lambda *a, **k: pytest.fail("rows went through Spark's fit"))
    passes, summed = [], boosting._summed
    monkeypatch.setattr(boosting, "_summed", lambda blocks, tally: passes.append(1) or summed(blocks, tally))
    training.train_risk_model(rows, NAMES, trees=3, depth=2)
    assert len(passes) == 3 * 2 + 1


def test_parts_do_not_change_a_tree(spark, rows, monkeypatch):
    """Sums are exact, so many parts, their sums on the way and many small blocks give the same digits."""
    few = boosting.fit(*_given(rows, 1))
    monkeypatch.setattr(boosting, "PART", 1)
    monkeypatch.setattr(boosting, "DIRECT", 2)
    many = boosting.fit(*_given(rows, 1, 7))
    kept = lambda m: [(r.tree, r.node, r.value, r.cover, r.feature, r.threshold) for r in tree_nodes(m, spark).orderBy("tree", "node").collect()]
    assert kept(few) == kept(many)


def _given(rows, parts, then=None):
    stored = training.cut_lineage(rows.select(*NAMES, F.col("churned").cast("double").alias("churned"), F.lit(1.0).alias("weight")).filter("a > 0").limit(5000).orderBy("a").coalesce(parts))
    told = GBTClassifier(labelCol="churned", weightCol="weight", maxIter=5, maxDepth=3, stepSize=0.1, seed=1)
    return stored.repartition(then) if then else stored, NAMES, "churned", "weight", 1.0, told


def test_odd_rows_are_refused(spark):
    for x, y in ((float("nan"), 1), (float("inf"), 0), (None, 1), (1.0, 2)):
        with pytest.raises(Exception, match="finite features"):
            training.train_risk_model(spark.createDataFrame([(0.5, 0), (1.5, 1), (x, y)], "a double, churned int"), ("a",), trees=1)


def test_one_class_and_constant_features_give_leaves(spark):
    rows = spark.createDataFrame([(1.0, float(i), 1) for i in range(40)], "a double, b double, churned int")
    model = training.train_risk_model(rows, ("a", "b"), trees=2, depth=2)
    assert [(r.tree, r.left) for r in _nodes(model, spark)] == [(0, -1), (1, -1)]
    assert training.model_scores(model, rows).filter("score > 0.8").count() == 40

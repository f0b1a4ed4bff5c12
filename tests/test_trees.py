"""Tree contributions against the definition: all subsets of features, walked over the exported nodes."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.functions.trees import ensemble, tree_nodes
from ebbtide.operators import explain, training

NAMES = ("a", "b", "c", "d", "e")


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 5))
    x[:, 4] = rng.integers(0, 3, 500)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + 0.5 * x[:, 4]) > 0.6).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))], "customer_id long, a double, b double, c double, d double, e double, churned int").cache()


@pytest.fixture(scope="module", params=[(4, 3), (3, 6)])
def model(frame, request):
    return training.train_risk_model(frame, NAMES, trees=request.param[0], depth=request.param[1])


def walk(nodes, tree, x, known):
    """Value of a tree when only the features in ``known`` are known: other splits take both ways by cover."""

    def at(node):
        r = nodes[tree, node]
        if r["left"] < 0:
            return r["value"]
        if r["feature"] in known:
            return at(r["left"] if x[r["feature"]] <= r["threshold"] else r["right"])
        left, right = nodes[tree, r["left"]], nodes[tree, r["right"]]
        return (left["cover"] * at(r["left"]) + right["cover"] * at(r["right"])) / r["cover"]

    return at(0)


def by_subsets(nodes, x):
    trees = {t for t, _ in nodes}
    value = {s: sum(walk(nodes, t, x, s) for t in trees) for k in range(6) for s in map(frozenset, itertools.combinations(range(5), k))}
    phi = []
    for i in range(5):
        rest = [s for s in value if i not in s]
        phi.append(sum(math.factorial(len(s)) * math.factorial(4 - len(s)) / 120 * (value[s | {i}] - value[s]) for s in rest))
    return phi, value[frozenset()]


def test_equals_all_subsets(spark, frame, model):
    nodes = {(r["tree"], r["node"]): r for r in tree_nodes(model.stages[-1], spark).collect()}
    for r in explain.tree_contributions(frame.limit(25), model, NAMES).collect():
        phi, base = by_subsets(nodes, [r[n] for n in NAMES])
        assert [c["contribution"] for c in r["contributions"]] == pytest.approx([2 * p for p in phi], abs=1e-9)
        assert r["base_value"] == pytest.approx(2 * base, abs=1e-9)
        assert [(c["feature"], c["value"]) for c in r["contributions"]] == [(n, r[n]) for n in NAMES]


def test_adds_up_to_the_log_odds_of_the_score(frame, model):
    rows = explain.tree_contributions(training.model_scores(model, frame), model, NAMES).collect()
    assert len(rows) == 500
    for r in rows:
        total = r["base_value"] + math.fsum(c["contribution"] for c in r["contributions"])
        assert total == pytest.approx(math.log(r["score"] / (1 - r["score"])), abs=1e-6)


def test_missing_values_go_as_in_scoring(spark, model):
    rows = spark.createDataFrame([(1, None, 0.1, 0.2, 0.3, 1.0), (2, float("nan"), None, 0.2, None, 2.0)], "customer_id long, a double, b double, c double, d double, e double")
    scores = {r["customer_id"]: r["score"] for r in training.model_scores(model, rows).collect()}
    for r in explain.tree_contributions(rows, model, NAMES).collect():
        total = r["base_value"] + math.fsum(c["contribution"] for c in r["contributions"])
        assert total == pytest.approx(math.log(scores[r["customer_id"]] / (1 - scores[r["customer_id"]])), abs=1e-6)


def test_stays_in_place(frame, model):
    plan = explain.tree_contributions(frame, model, NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan and "Generate" not in plan
    assert explain.tree_contributions(frame.limit(0), model, NAMES).count() == 0


def test_a_tree_without_splits(spark):
    rows = spark.createDataFrame([(k, float(k % 2), 1) for k in range(20)], "customer_id long, a double, churned int")
    known = ensemble(tree_nodes(training.train_risk_model(rows, ("a",), trees=2).stages[-1], spark))
    assert known.contributions(np.zeros((3, 1))).tolist() == [[0.0]] * 3 and known.values(np.zeros((1, 1)))[0] == pytest.approx(known.base)


def test_reasons_from_trees(frame, model):
    rows = explain.tree_contributions(frame, model, NAMES).withColumns({"recency_days": F.lit(1.0), "tx_count_90d": F.lit(1.0)})
    top = explain.top_reasons(rows, 3).first()["reasons"]
    assert len(top) == 3 and [abs(c["contribution"]) for c in top] == sorted((abs(c["contribution"]) for c in top), reverse=True)


def test_scores_equal_a_walk_over_the_exported_nodes(spark, frame, model):
    nodes = {(r["tree"], r["node"]): r for r in tree_nodes(model.stages[-1], spark).collect()}
    trees = {t for t, _ in nodes}
    for r in training.model_scores(model, frame.limit(60)).collect():
        x = [r[n] for n in NAMES]
        margin = sum(walk(nodes, t, x, frozenset(range(5))) for t in trees)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-2 * margin)), abs=1e-9)

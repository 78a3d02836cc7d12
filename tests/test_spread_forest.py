import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from penstock.models import classifiers as M
from penstock.models import spread_forest as S

WIDTH = 12


def values(n=3000, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 7, (n, WIDTH)).astype(float)
    y = (rng.random(n) < 0.15 + 0.7 * ((x[:, 0] > 2) ^ (x[:, 1] > 4))).astype(int)
    return x, y, np.where(y == 1, 1.5, 0.75)


@pytest.fixture(scope="module")
def rows(spark):
    x, y, w = values()
    made = [(i if i % 9 else None, x[i].tolist(), int(y[i]), float(w[i]), f"name {i % 50}") for i in range(len(x))]
    df = M.from_array(spark.createDataFrame(made, "id long, vec array<double>, label int, weight double, name string"), "vec").persist()
    df.count()
    return df


def by_hand(forest, x):
    """Mean leaf value of every row, walking the whole forest on the driver."""
    bins, p = S.binned(x, forest.cuts), np.zeros(len(x))
    units = {(r.tree, r.top): {c: np.frombuffer(r[c], kind) for c, kind in S._KINDS.items()} for r in forest.units.collect()}
    for t, top in enumerate(forest.tops):
        node = S.walk(top, bins)
        for u in np.unique(node).tolist():
            here = node == u
            p[here] += S.walk_unit(units[t, u], bins[here]) if top["feat"][u] == S.HELD else top["value"][u]
    return p / len(forest.tops)


@pytest.mark.parametrize(("depth", "min_leaf"), [(4, 1), (6, 8), (12, 2)])
def test_subtree_equals_mllib_tree(rows, depth, min_leaf):
    """Without bags, with all features a node: the same probabilities and nodes."""
    x, y, w = values()
    unit = S.grow_unit(x.astype(np.uint8), y, w, np.ones(len(x)), depth, min_leaf, WIDTH, 32, np.random.default_rng(1))
    plain = RandomForestClassifier(numTrees=1, maxDepth=depth, minInstancesPerNode=min_leaf, bootstrap=False, weightCol="weight",
                                   featureSubsetStrategy="all", maxBins=32, seed=1).fit(rows)
    want = [(r.vec, r.p) for r in M.Scorer(plain).score(rows).select("vec", "p").collect()]
    got = S.walk_unit(unit, np.array([v for v, _ in want]).astype(np.uint8))
    assert np.mean(np.abs(got - [p for _, p in want]) > 1e-9) < 0.02  # ties between equal gains may fall otherwise in deep nodes
    assert abs(len(unit["feat"]) - plain.totalNumNodes) <= 0.02 * plain.totalNumNodes and len(unit["feat"]) > 5


@pytest.mark.parametrize("local_rows", [1 << 20, 400])
def test_forest_of_many_nodes_stays_off_the_driver(spark, rows, monkeypatch, tmp_path, local_rows):
    """The driver gets the tops only; every row comes back once with the score that walking the forest gives, also after saving."""
    monkeypatch.setattr(M, "MANY_NODES", 1000)
    monkeypatch.setattr(S, "LOCAL_ROWS", local_rows)
    spec = M.TreeSpec("forest", 10, 12, 2)
    scorer = M.fit_trees(rows, spec, "weight")
    assert isinstance(scorer, M.SpreadForest) and len(scorer.forest.tops) == 10
    held = sum(len(t["feat"]) for t in scorer.forest.tops)
    assert held == 10 if local_rows > 3000 else 10 < held < 0.3 * scorer.nodes
    scored = scorer.classify(rows)
    assert scored.filter("prediction = label").count() > 0.8 * 3000
    assert scored.select(rows.columns).exceptAll(rows).isEmpty() and rows.exceptAll(scored.select(rows.columns)).isEmpty()
    got = scored.select("vec", "p").collect()
    assert np.allclose([r.p for r in got], by_hand(scorer.forest, np.array([r.vec for r in got])), atol=1e-12, rtol=0)
    scorer.save(f"{tmp_path}/model")
    loaded = M.load_scorer(spark, f"{tmp_path}/model")
    assert loaded.nodes == scorer.nodes
    assert loaded.score(scorer.score(rows, "a"), "b").filter("a is null or abs(a - b) > 1e-12").isEmpty()
    again = M.fit_trees(rows, spec, "weight")
    assert again.score(scorer.score(rows, "a"), "b").filter("a is null or abs(a - b) > 1e-12").isEmpty()


@pytest.mark.parametrize("local_rows", [1 << 20, 400])
def test_spread_forest_is_as_good_as_mllib(rows, monkeypatch, local_rows):
    """Scores and sizes of both forests agree within the spread of their draws."""
    spec = M.TreeSpec("forest", 60, 10, 4)
    plain = M.fit_trees(rows, spec, "weight")
    assert not isinstance(plain, M.SpreadForest)
    monkeypatch.setattr(M, "MANY_NODES", 1000)
    monkeypatch.setattr(S, "LOCAL_ROWS", local_rows)
    spread = M.fit_trees(rows, spec, "weight")
    both = spread.score(plain.score(rows, "a"), "b")
    assert both.agg(F.avg(F.abs(F.col("a") - F.col("b")))).first()[0] < 0.05
    assert 0.85 < spread.nodes / plain.nodes < 1.18


def test_no_rows_to_score_and_pure_trees(rows, monkeypatch):
    monkeypatch.setattr(M, "MANY_NODES", 10)
    scorer = M.fit_trees(rows.filter("label = 1 or id = 1"), M.TreeSpec("forest", 5, 6, 2), "weight")
    assert isinstance(scorer, M.SpreadForest)
    assert scorer.score(rows.filter("label > 7")).count() == 0
    assert scorer.score(rows.limit(20)).filter("p between 0 and 1").count() == 20


def test_bags_are_poisson_and_differ_by_tree():
    a, b = S.bag(42, 0, 1 << 32, 50_000), S.bag(42, 1, 1 << 32, 50_000)
    assert abs(a.mean() - 1) < 0.03 and abs(a.var() - 1) < 0.05 and abs(np.mean(a == 0) - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.02 and abs(np.corrcoef(a[1:], a[:-1])[0, 1]) < 0.02
    assert (a == S.bag(42, 0, 1 << 32, 50_000)).all()


def test_features_are_drawn_without_replacement():
    drawn = S._drawn(np.random.default_rng(1), 20_000, 4, 9)
    assert all(len(set(r)) == 4 for r in drawn[:500].tolist())
    assert np.allclose(np.bincount(drawn.reshape(-1), minlength=9) / 20_000, 4 / 9, atol=0.02)


def test_odd_rows_stay_with_mllib(rows):
    assert S.grow(rows.withColumn("label", F.lit(0)), 3, 3) is None
    assert S.grow(rows.withColumn("label", F.col("label") + F.col("label") * F.col("vec")[0].cast("int")), 3, 3) is None
    assert S.grow(rows.withColumn("weight", F.when(F.col("label") == 1, 1.0)), 3, 3, weight="weight") is None
    assert S.grow(rows, 3, 3, bins=300) is None

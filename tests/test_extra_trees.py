import numpy as np
import pytest
from pyspark.sql import functions as F

from penstock.models import classifiers as M
from penstock.models import extra_trees as X


@pytest.fixture
def blobs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(int)
    rows = [(i, [float(v) for v in x[i]], int(y[i]), 1.0) for i in range(600)]
    return M.from_array(spark.createDataFrame(rows, "id long, vec array<double>, label int, weight double"), "vec")


def brute_walk(tree, row):
    u = 0
    while tree["feat"][u] >= 0:
        u = tree["left"][u] if row[tree["feat"][u]] <= tree["cut"][u] else tree["right"][u]
    return u


def test_learns_and_respects_limits(blobs):
    forest = X.grow(blobs, trees=6, depth=6, min_leaf=5, min_split=10, seed=1, weight="weight")
    rows = blobs.select("vec", "label").collect()
    x = np.array([r.vec for r in rows])
    y = np.array([r.label for r in rows])
    p = np.mean([t["value"][X.walk(t, x)] for t in forest], 0)
    assert ((p > 0.5) == y).mean() > 0.85
    for t in forest:
        leaves = X.walk(t, x)
        assert all(X.walk(t, x[i: i + 1])[0] == brute_walk(t, x[i]) for i in range(0, 600, 37))
        counts = np.bincount(leaves, minlength=len(t["feat"]))
        assert all(counts[u] >= 5 for u in np.unique(leaves))
        depth = {0: 0}
        for u in range(len(t["feat"])):
            if t["feat"][u] >= 0:
                depth[t["left"][u]] = depth[t["right"][u]] = depth[u] + 1
        assert max(depth.values()) <= 6


def test_same_seed_same_forest_and_scores(spark, blobs, tmp_path):
    a = M.ExtraTrees(X.grow(blobs, 3, 4, 5, 10, seed=2, weight="weight"))
    b = M.ExtraTrees(X.grow(blobs, 3, 4, 5, 10, seed=2, weight="weight"))
    assert all(np.array_equal(s["cut"], t["cut"]) and np.array_equal(s["feat"], t["feat"]) for s, t in zip(a.forest, b.forest, strict=True))
    path = str(tmp_path / "model")
    a.save(path)
    c = M.load_scorer(spark, path)
    one = a.score(blobs).select("id", "p").orderBy("id").collect()
    two = c.score(blobs).select("id", "p").orderBy("id").collect()
    assert one == two and a.nodes == c.nodes
    assert set(a.score(blobs).columns) == set(blobs.columns) | {"p"}


def test_pure_or_tiny_tables_give_single_leaves(spark):
    rows = [(i, [float(i), 1.0], 1, 1.0) for i in range(30)]
    df = M.from_array(spark.createDataFrame(rows, "id long, vec array<double>, label int, weight double"), "vec")
    forest = X.grow(df, 2, 5, 5, 10, weight="weight")
    assert all(len(t["feat"]) == 1 and t["value"][0] == 1.0 for t in forest)
    few = df.filter(F.col("id") < 3).withColumn("label", (F.col("id") % 2).cast("int"))
    assert all(len(t["feat"]) == 1 for t in X.grow(few, 2, 5, 1, 10))


def test_equal_rows_are_merged(spark, monkeypatch):
    """Copies cost one row of a pass and count towards leaf limits as the rows they are."""
    rows = [(i, [float(i % 2), float(i // 2 % 2)], int(i % 8 in (1, 2, 3, 6)), 1.0) for i in range(800)]
    df = M.from_array(spark.createDataFrame(rows, "id long, vec array<double>, label int, weight double"), "vec")
    staged, plain = [], X.stage
    monkeypatch.setattr(X, "MERGE_ROWS", 100)
    monkeypatch.setattr(X, "stage", lambda d, tag: staged.append(plain(d, tag)) or staged[-1])
    forest = X.grow(df, 3, 4, 5, 10, weight="weight")
    assert staged[0].count() <= 8 and staged[0].agg(F.sum("_n")).first()[0] == 800
    assert all((t["feat"] >= 0).any() for t in forest)


@pytest.mark.parametrize("spec", [M.TreeSpec("forest", 4, 5, bagged=False), M.TreeSpec("boosted", 20, 3, weighted=False)])
def test_merged_fit_equals_plain_fit(spark, monkeypatch, spec):
    rows = [(i, [float(i % 2), float(i // 2 % 2)], int(i * 7 % 10 < (8, 3, 2, 9)[i % 4]), 1.0 + i % 10 // 5) for i in range(4000)]
    df = M.from_array(spark.createDataFrame(rows, "id long, vec array<double>, label int, weight double"), "vec")
    plain = M.fit_trees(df, spec, "weight").score(df).select("id", "p").orderBy("id").collect()
    fitted = []
    monkeypatch.setattr(M, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(M, "compact", lambda t, keep=M.compact: fitted.append(t.count()) or keep(t))
    merged = M.fit_trees(df, spec, "weight").score(df).select("id", "p").orderBy("id").collect()
    assert fitted == [8]
    assert all(a.id == b.id and abs(a.p - b.p) < 1e-9 for a, b in zip(plain, merged, strict=True))


def test_large_forest_is_grown_in_parts(spark, blobs, monkeypatch, tmp_path):
    """Parts of a forest are fitted at once, with all trees among them; a saved one scores alike."""
    monkeypatch.setattr(M, "ROWS_PER_TASK", 300)
    scorer = M.fit_trees(blobs, M.TreeSpec("forest", 11, 6, 2), "weight")
    assert len(scorer.parts) == 8 and sum(p.model.getNumTrees for p in scorer.parts) == 11
    scored = scorer.classify(blobs)
    assert scored.filter("prediction = label").count() > 0.85 * 600
    scorer.save(f"{tmp_path}/model")
    again = M.load_scorer(spark, f"{tmp_path}/model")
    both = again.score(scorer.score(blobs, "a"), "b")
    assert both.filter("a is null or abs(a - b) > 1e-12").count() == 0 and again.nodes == scorer.nodes
    monkeypatch.setattr(M, "ROWS_PER_TASK", 20_000)
    assert not hasattr(M.fit_trees(blobs, M.TreeSpec("forest", 11, 3), "weight"), "parts")

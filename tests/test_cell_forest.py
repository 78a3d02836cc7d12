import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from penstock.models import cell_forest as C
from penstock.models import classifiers as M
from penstock.models import extra_trees as X


def table(spark, n=3000, values=7, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, values, (n, 3)).astype(float)
    y = (rng.random(n) < 0.15 + 0.7 * ((x[:, 0] > 2) ^ (x[:, 1] > 4))).astype(int)
    rows = [(i, x[i].tolist(), int(y[i]), 1.5 if y[i] else 0.75) for i in range(n)]
    return M.from_array(spark.createDataFrame(rows, "id long, vec array<double>, label int, weight double"), "vec")


@pytest.fixture(scope="module")
def rows(spark):
    df = table(spark).persist()
    df.count()
    return df


def counted(df, cuts):
    by = [C._code_column(cuts).alias("code"), F.col("label").alias("y"), F.col("weight").alias("w")]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


@pytest.mark.parametrize(("depth", "min_leaf"), [(4, 1), (6, 8), (9, 40)])
def test_tree_on_cells_equals_mllib_tree_on_rows(rows, depth, min_leaf):
    """Without bags, with all features a node: the same probabilities and nodes; leaf limits count rows, not cells."""
    cuts = [np.arange(6) + 0.5] * 3
    cells = counted(rows, cuts).select("code", "y", "w", F.array(F.col("n")).alias("bags"))
    forest = C.grow_cells(cells, cuts, 1, depth, min_leaf, 1)
    plain = RandomForestClassifier(numTrees=1, maxDepth=depth, minInstancesPerNode=min_leaf, bootstrap=False, weightCol="weight",
                                   featureSubsetStrategy="all", maxBins=32, seed=1).fit(rows)
    both = M.CellForest(forest, cuts).score(M.Scorer(plain).score(rows, "a"), "b")
    assert both.filter("a is null or b is null or abs(a - b) > 1e-9").count() == 0
    assert len(forest[0]["feat"]) == plain.totalNumNodes > 5


def test_large_forest_is_grown_on_cells(spark, rows, monkeypatch, tmp_path):
    """More rows of the same cells cost no more to grow; the forest learns, repeats, and scores alike after saving and by walking."""
    monkeypatch.setattr(M, "CELL_ROWS", 1000)
    grown, keep = [], C.grow_cells
    monkeypatch.setattr(C, "grow_cells", lambda cells, *a: grown.append(cells) or keep(cells, *a))
    spec = M.TreeSpec("forest", 9, 6, 4)
    scorer = M.fit_trees(rows, spec, "weight")
    assert isinstance(scorer, M.CellForest) and len(scorer.forest) == 9
    assert scorer.classify(rows).filter("prediction = label").count() > 0.8 * 3000
    many = rows.crossJoin(spark.range(8).select(F.col("id").alias("copy")))
    M.fit_trees(many, spec, "weight")
    assert grown[0].count() == grown[1].count() <= 7**3 * 2
    again = M.fit_trees(rows, spec, "weight")
    assert all(np.array_equal(a[c], b[c]) for a, b in zip(scorer.forest, again.forest, strict=True) for c in ("feat", "cut", "left", "right"))
    scorer.save(f"{tmp_path}/model")
    loaded = M.load_scorer(spark, f"{tmp_path}/model")
    both = X.score(loaded.score(scorer.score(rows, "a"), "b"), scorer.forest, "c")
    assert both.filter("a is null or a <> b or a <> c").count() == 0 and loaded.nodes == scorer.nodes


def test_forest_on_cells_is_as_good_as_mllib(spark, rows, monkeypatch):
    """Mean scores and sizes of both forests agree within the spread of their draws."""
    spec = M.TreeSpec("forest", 40, 6, 8)
    plain = M.fit_trees(rows, spec, "weight")
    monkeypatch.setattr(M, "CELL_ROWS", 1000)
    cells = M.fit_trees(rows, spec, "weight")
    both = cells.score(plain.score(rows, "a"), "b")
    assert both.agg(F.avg(F.abs(F.col("a") - F.col("b")))).first()[0] < 0.05
    assert 0.75 < cells.nodes / plain.nodes < 1.33


def test_bags_draw_every_row_once_on_average(spark):
    cells = spark.createDataFrame([(i, i % 2, 1.0, 1 + i % 50) for i in range(200)], "code long, y int, w double, n long")
    drawn = C.draw_bags(cells, 60, 5)
    a, b = ({r.code: r.bags for r in d.collect()} for d in (drawn, C.draw_bags(cells.repartition(7), 60, 5)))
    assert a == b and len(a) == 200 and all(len(v) == 60 for v in a.values())
    x = np.array([a[i] for i in range(200)])
    n = 1 + np.arange(200) % 50
    assert abs(x.sum() / (60 * n.sum()) - 1) < 0.02
    assert 0.8 < ((x - n[:, None]) ** 2 / n[:, None]).mean() < 1.2  # Poisson: the variance is the mean


def test_cuts_and_codes():
    assert C.place_cuts(np.array([1.0, 1.0, 2.0, 4.0]), np.ones(4), 32).tolist() == [1.5, 3.0]
    cuts = C.place_cuts(np.arange(1000.0), np.ones(1000), 4)
    assert len(cuts) == 3 and np.allclose(cuts, [249.5, 499.5, 749.5], atol=1.1)
    heavy = C.place_cuts(np.arange(1000.0), np.where(np.arange(1000) < 500, 3.0, 1.0), 4)
    assert heavy[1] < 400
    assert len(C.place_cuts(np.full(9, 2.0), np.ones(9), 4)) == 0
    assert C.codes(np.array([[1.5, 0.0], [1.6, 9.0], [9.0, -1.0]]), [np.array([1.5, 3.0]), np.array([0.0])]).tolist() == [0, 3, 4]


def test_other_tables_stay_with_mllib(spark, rows, monkeypatch):
    """Many features, one class, or weights that are no weights: MLlib fits or refuses them as before."""
    monkeypatch.setattr(M, "CELL_ROWS", 1000)
    spec = M.TreeSpec("forest", 3, 3, 5)
    wide = M.from_array(rows.select("id", "label", "weight", F.concat("vec", "vec").alias("vec")), "vec")
    assert not isinstance(M.fit_trees(wide, spec, "weight"), M.CellForest)
    assert C.grow(rows.withColumn("label", F.lit(0)), 3, 3) is None
    assert C.grow(rows.withColumn("label", F.col("id").cast("int") % 3), 3, 3) is None
    assert C.grow(rows.withColumn("weight", F.when(F.col("id") > 3, 1.0)), 3, 3, weight="weight") is None
    with pytest.raises(Exception, match="(?i)null"):
        M.fit_trees(rows.withColumn("label", F.when(F.col("id") > 3, F.col("label"))), spec, "weight")

import numpy as np
from pyspark.ml.feature import PCA

from penstock.models.classifiers import from_array
from penstock.operators import selection


def test_jacobi_matches_eigh():
    rng = np.random.default_rng(0)
    m = rng.normal(size=(12, 12))
    a = m @ m.T
    values, axes = selection.jacobi(a)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1], rtol=1e-9, atol=1e-9)
    assert np.allclose(a @ axes, axes * values, atol=1e-7)


def test_explained_variance_equals_mllib(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    df = spark.createDataFrame([([float(v) for v in row],) for row in x], "vec array<double>")
    _, ours = selection.pca_jacobi(df, "vec", 4)
    model = PCA(k=4, inputCol="features").fit(from_array(df, "vec"))
    got = [r.explained for r in ours.orderBy("component").collect()]
    assert np.allclose(got, model.explainedVariance.toArray(), atol=1e-9)


def test_too_few_rows(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "vec array<double>")
    assert selection.pca_jacobi(df, "vec")[1].count() == 0

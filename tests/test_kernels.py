import numpy as np
from pyspark.sql import functions as F

from penstock.models import classifiers as M
from penstock.models import kernels as K


def test_map_approximates_the_rbf_kernel(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5)) * 0.5
    w, b = K.draws(spark, 5, 0.5, features=2048)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(40)], "id long, vec array<double>")
    z = np.array([r.z for r in rows.select("id", K.mapped(F.col("vec"), w, b).alias("z")).orderBy("id").collect()])
    exact = np.exp(-0.5 * ((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    assert np.abs(z @ z.T - exact).mean() < 0.03


def test_rbf_separates_xor_where_linear_cannot(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, size=(400, 2))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    df = M.from_array(spark.createDataFrame([(i, [float(a), float(c)], int(t)) for i, ((a, c), t) in enumerate(zip(x, y))],
                                            "id long, vec array<double>, label int"), "vec")
    accuracy = lambda s: s.classify(df).select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    w, b = K.draws(spark, 2, 4.0)
    rbf = M.fit_rbf_svc(df, w, b, max_iter=50)
    assert accuracy(rbf) > 0.9
    assert accuracy(M.fit_linear_svc(df, max_iter=50)) < 0.7
    assert set(rbf.score(df).columns) == set(df.columns) | {"p"}


def test_scale_gamma(spark):
    rows = spark.createDataFrame([([1.0, 3.0],), ([1.0, 3.0],)], "vec array<double>")
    assert K.scale_gamma(rows) == 1.0 / (2 * 1.0)
    flat = spark.createDataFrame([([2.0, 2.0],)], "vec array<double>")
    assert K.scale_gamma(flat) == 0.5

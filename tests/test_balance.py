"""Sampling, neighbours and over-sampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from penstock.operators import sampling
from penstock.operators.joins import salted_join
from penstock.operators.neighbors import knn_classify, knn_join
from penstock.operators.smote import balance, synthetic_rows


def _classes(spark, n=3000):
    return spark.range(n).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))


def test_split_is_exact_and_stable(spread):
    df = _classes(spread)
    a, rest = sampling.stratified_split(df.repartition(5), ["label"], 0.25, ["id"])
    counts = {r["label"]: r["count"] for r in a.groupBy("label").count().collect()}
    assert counts == {0: 675, 1: 75}
    b, _ = sampling.stratified_split(df.coalesce(1), ["label"], 0.25, ["id"])
    assert sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in b.collect())
    assert a.count() + rest.count() == 3000 and a.join(rest, "id", "left_semi").count() == 0


def test_extreme_shares(spread):
    df = _classes(spread, 200)
    none, everything = sampling.stratified_split(df, ["label"], 0.0, ["id"])
    assert (none.count(), everything.count()) == (0, 200)
    assert sampling.stratified_sample(df, ["label"], 1.0, ["id"]).count() == 200


def test_quotas_by_largest_remainder(spread):
    counts = spread.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, n long")
    got = {r["k"]: r["quota"] for r in sampling.stratum_quotas(counts, 7, ["k"]).collect()}
    assert got == {"a": 4, "b": 2, "c": 1}  # 3.5, 2.1, 1.4


def test_sample_size_cap():
    assert sampling.sample_size(841_977, 0.05) == 42_098
    assert sampling.sample_size(841_977, 0.25, cap=100_000) == 100_000


def test_bootstrap_keeps_shares(spread):
    df = _classes(spread)
    got = sampling.bootstrap(df, "label", 0.5, ["id"])
    assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {0: 1350, 1: 150}
    assert got.select("draw").distinct().count() == 1500
    assert got.select("id").distinct().count() < 1500


def test_draws_from_more_than_a_thousand_classes(spread, monkeypatch):
    monkeypatch.setattr(sampling, "DRAWS_PER_CHUNK", 7)
    df = spread.range(4800).select("id", F.concat(F.lit("c"), F.col("id") % 1200).alias("label"))
    got = sampling.bootstrap(df, "label", 0.5, ["id"])
    counts = {r["label"]: r["count"] for r in got.groupBy("label").count().collect()}
    assert len(counts) == 1200 and set(counts.values()) == {2}
    assert sorted(r["draw"] for r in got.select("draw").collect()) == list(range(2400))
    drawn = sampling.weighted_draws(df, "label", 24000, ["id"])
    assert drawn.count() == drawn.select("draw").distinct().count() == 24000 and drawn.select("label").distinct().count() == 1200
    big = sampling.bootstrap(spread.range(3000).select("id", F.lit("a").alias("label")), "label", 1.0, ["id"])
    assert sorted(r["draw"] for r in big.select("draw").collect()) == list(range(3000))


def test_few_rows_drawn_very_often(spread):
    df = spread.range(3001).select("id", (F.col("id") == 0).cast("int").alias("label"))
    got = sampling.weighted_draws(df, "label", 6000, ["id"])
    assert got.count() == 6000
    assert 2800 < got.filter("label = 1").count() < 3200


def test_salted_join_loses_nothing(spread):
    big = spread.range(5000).select(F.col("id"), (F.col("id") % 3 == 0).cast("long").alias("k"))
    small = spread.createDataFrame([(0, "x"), (1, "y")], "k long, v string")
    salts = F.when(F.col("k") == 1, 8).otherwise(1).cast("long")
    got = salted_join(big.withColumn("s", salts), small.withColumn("s", salts), ["k"], "s", "id")
    assert got.count() == 5000 and got.select("id").distinct().count() == 5000


def test_weights(spread):
    w = {r["label"]: r["weight"] for r in sampling.balanced_weights(_classes(spread)).distinct().select("label", "weight").distinct().collect()}
    assert w == {0: pytest.approx(3000 / (2 * 2700)), 1: pytest.approx(5.0)}


@pytest.mark.parametrize("pivots,slice_rows", [(1, 10), (12, 25), (None, 4096)])
def test_neighbors_against_brute_force(spread, pivots, slice_rows):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(120, 3)), rng.normal(8, 0.2, size=(60, 3)), np.zeros((40, 3))])  # 40 copies
    df = spread.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")
    got = knn_join(df, df, 4, same_table=True, pivots=pivots, slice_rows=slice_rows).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    got = got.sort_values(["id", "rank"])["neighbor"].to_numpy().reshape(len(x), 4)
    np.testing.assert_array_equal(got, want)


def test_neighbors_in_another_table(spread):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(30, 2)), rng.normal(size=(50, 2))
    mk = lambda m, o: spread.createDataFrame([(o + i, [float(v) for v in r]) for i, r in enumerate(m)], "id long, vec array<double>")
    got = knn_join(mk(a, 0), mk(b, 1000), 3, pivots=5, slice_rows=8).toPandas().sort_values(["id", "rank"])
    want = np.argsort(((a[:, None] - b[None]) ** 2).sum(-1), axis=1)[:, :3] + 1000
    np.testing.assert_array_equal(got["neighbor"].to_numpy().reshape(30, 3), want)


def test_fewer_candidates_than_k(spread):
    df = spread.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, vec array<double>")
    assert [(r["id"], r["neighbor"]) for r in knn_join(df, df, 5, same_table=True).orderBy("id").collect()] == [(1, 2), (2, 1)]


def test_knn_classifier(spread):
    train = spread.createDataFrame([(i, [float(i)], int(i >= 10)) for i in range(20)], "id long, vec array<double>, label int")
    test = spread.createDataFrame([(100, [2.2]), (101, [17.7])], "id long, vec array<double>")
    assert {r["id"]: r["prediction"] for r in knn_classify(train, test, 3).collect()} == {100: 0, 101: 1}


def test_two_clusters_are_balanced(spread):
    rng = np.random.default_rng(7)
    minority, majority = rng.normal(5, 1, (6, 2)), rng.normal(0, 1, (30, 2))
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(minority)]
    rows += [(100 + i, [float(v) for v in r], 0) for i, r in enumerate(majority)]
    df = spread.createDataFrame(rows, "id long, vec array<double>, label int")
    new = synthetic_rows(df, k=3).toPandas()
    assert len(new) == 15 - 6
    for r in new.itertuples():
        a, b = minority[r.base], minority[r.neighbor]
        np.testing.assert_allclose(np.asarray(r.vec), a + r.u * (b - a))
    counts = {(r["label"], r["synthetic"]): r["count"] for r in balance(df, k=3).groupBy("label", "synthetic").count().collect()}
    assert counts == {(0, False): 30, (1, False): 6, (1, True): 9}


def test_few_minority_rows_report_their_neighbours(spread):
    rows = [(i, [float(i)], 1) for i in range(3)] + [(100 + i, [50.0 + i], 0) for i in range(20)]
    df = spread.createDataFrame(rows, "id long, vec array<double>, label int")
    new = synthetic_rows(df, k=5).toPandas()
    assert len(new) == 10 - 3 and set(new["near"]) == {2}
    assert all(r.neighbor != r.base and 0 <= r.neighbor < 3 for r in new.itertuples())
    with pytest.raises(ValueError, match="2 neighbours, 5 asked"):
        synthetic_rows(df, k=5, strict=True)
    with pytest.raises(ValueError, match="two minority rows"):
        synthetic_rows(df.filter("label = 0 OR id = 0"), k=5)

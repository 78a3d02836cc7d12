from pyspark.sql import functions as F

from penstock.operators import sampling as S


def rows(spark):
    data = [(i, None if i % 4 == 0 else i % 3) for i in range(400)]
    return spark.createDataFrame(data, "id long, label int")


def test_stratified_split_keeps_the_null_class(spark):
    taken, rest = S.stratified_split(rows(spark), ["label"], 0.5, ["id"])
    assert taken.count() == 200 and rest.count() == 200
    assert taken.filter(F.col("label").isNull()).count() == 50


def test_bootstrap_and_weighted_draws_reach_the_null_class(spark):
    drawn = S.bootstrap(rows(spark), "label", 0.5, ["id"])
    assert drawn.count() == 200 and drawn.filter(F.col("label").isNull()).count() == 50
    weighted = S.weighted_draws(rows(spark), "label", 300, ["id"])
    assert weighted.count() == 300 and weighted.filter(F.col("label").isNull()).count() > 40


def test_balanced_weights_of_the_null_class(spark):
    w = S.balanced_weights(rows(spark))
    assert w.filter(F.col("weight").isNull()).count() == 0
    assert w.filter(F.col("label").isNull()).first()["weight"] == 400 / (4 * 100)

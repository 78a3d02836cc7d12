"""Names, labels, coercion, scaling and variance edge cases."""

import pytest
from pyspark.sql import functions as F

from penstock.operators import columns as C
from penstock.operators import impute, profile, scale
from penstock.operators.ordering import with_row_id
from penstock.sources.csvfiles import read_text_table, write_csv
from penstock.sources.staging import is_complete, materialize


def test_names_by_case(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "Time int, TIMESTAMP int, row int, Attack int, attack_x int")
    assert C.drop_non_features(df).columns == ["attack_x"]
    assert C.drop_non_sensors(df).columns == ["TIMESTAMP", "row", "Attack", "attack_x"]


def test_columns_that_differ_only_in_case(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int").toDF("Attack", "attack")
    assert C.drop_non_sensors(df).collect()[0][:] == (1, 2)
    assert C.resolve_label(df).columns == ["Attack", "label"]


def test_label_names():
    assert C.label_column(["x", "Attack"]) == "Attack"
    assert C.label_column(["attack", "label"]) == "label"
    assert C.label_column(["x", "y"]) == "y"
    assert C.label_column(["x", "y"], ("attack",), "first") == "x"


def test_label_codes(spark):
    df = spark.createDataFrame([(1,), (-1,), (0,), (None,)], "raw int")
    got = df.select(C.attack_from_signed(F.col("raw")), C.attack_from_nonzero(F.col("raw"))).collect()
    assert [r[0] for r in got] == [0, 1, 1, 1]
    assert [r[1] for r in got] == [1, 1, 0, 1]


def test_ragged_columns(spark):
    train = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    test = spark.createDataFrame([(4, 5, 6)], "c int, a int, d int")
    a, b = C.align(train, test)
    assert a.columns == b.columns == ["a", "c"] and b.first()[:] == (5, 4)


def test_deny_list():
    assert len(C.DENY_LIST) == 21
    found, missing = C.split_deny_list(["2_LT_001_PV", "x"])
    assert found == ["2_LT_001_PV"] and len(missing) == 20


def test_dirty_cells_fill_before_they_become_numbers(spark):
    cells = ["1.5", "abc", None, "Infinity", "NaN"]
    df = spark.createDataFrame(list(enumerate(cells)), "row_id long, x string")
    df = df.withColumn("x", F.when(F.col("x") != "NaN", F.col("x")))
    filled = impute.ordered_fill(df, ["x"], block_rows=2).select("row_id", C.to_number(F.col("x")).alias("x"))
    assert [r["x"] for r in filled.orderBy("row_id").collect()] == [1.5, 0.0, 0.0, float("inf"), float("inf")]


def test_all_null_in_either_table(spark):
    train = spark.createDataFrame([(1.0, None, 1.0), (None, None, 2.0)], "a double, b double, c double")
    test = spark.createDataFrame([(1.0, 2.0, None)], "a double, b double, c double")
    assert profile.all_null_columns(train, test, ["a", "b", "c"]) == ["b", "c"]


def test_zero_range_is_only_shifted(spark):
    train = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    test = spark.createDataFrame([(5.0,), (7.0,)], "x double")
    params = scale.params_dict(scale.fit_params(train, ["x"]))
    assert [r[0] for r in scale.apply_params(train, params).collect()] == [0.0, 0.0]
    assert [r[0] for r in scale.apply_params(test, params).collect()] == [0.0, 2.0]


def test_range_edges_are_strict(spark):
    df = spark.createDataFrame([(-0.1,), (-0.1001,), (1.1,), (1.1001,)], "x double")
    got = scale.out_of_range(df, ["x"]).first()
    assert (got["cells"], got["outside"], got["pct_outside"]) == (4, 2, 50.0)


def test_variance_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 1.9)], "at double, under double")  # variances 2.0 and 1.805
    assert profile.low_variance_columns(profile.column_stats(df, df.columns), 2.0) == ["under"]


def test_bad_cells_are_counted_apart(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1.0,)], "x double")
    r = profile.column_stats(df, ["x"]).first()
    assert (r["rows"], r["nulls"], r["nans"], r["infs"]) == (4, 1, 1, 1)
    assert profile.null_cells(df, ["x"]).first()[0] == 2


def test_labels_must_pair_up(spark):
    a = spark.createDataFrame([(1,), (2,)], "row_id long")
    assert C.attach_labels(a, a.withColumn("label", F.lit(0))).count() == 2
    with pytest.raises(ValueError):
        C.attach_labels(a, spark.createDataFrame([(1, 0)], "row_id long, label int"))


def test_banner_csv(spark, tmp_path):
    path = tmp_path / "plant.csv"
    path.write_text("exported by plant\na,b\n1,NA\n2,x\n")
    got = read_text_table(spark, str(path), ["a", "b"], banner=True).orderBy("a").collect()
    assert [tuple(r) for r in got] == [("1", None), ("2", "x")]


def test_stage_is_written_once(spark, tmp_path):
    path = str(tmp_path / "stage")
    assert not is_complete(spark, path)
    assert materialize(spark.range(3), path).count() == 3
    assert materialize(spark.range(9), path).count() == 3
    assert materialize(spark.range(9), path, force=True).count() == 9


def test_scaler_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 10.0), (3.0, 30.0)], "b double, a double")
    path = str(tmp_path / "params")
    scale.save_params(scale.fit_params(df, ["b", "a"]), path)
    params = scale.params_dict(scale.load_params(spark, path))
    assert list(params) == ["b", "a"]
    assert [tuple(r) for r in scale.apply_params(df, params).orderBy("b").collect()] == [(0.0, 0.0), (1.0, 1.0)]


def test_csv_sink(spark, tmp_path):
    write_csv(spark.range(3), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def test_noise_does_not_depend_on_partitioning(spark):
    df = spark.range(50).select("id", F.lit(1.0).alias("x"))
    a = scale.add_noise(df.repartition(5), ["x"], ["id"]).orderBy("id").collect()
    b = scale.add_noise(df.coalesce(1), ["x"], ["id"]).orderBy("id").collect()
    assert a == b and len({r["x"] for r in a}) > 40


def test_quantile_transform(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    got = [r[0] for r in scale.quantile_transform(df, scale.fit_quantiles(df, ["x"], 11)).orderBy("x").collect()]
    assert got == pytest.approx([i / 100 for i in range(101)])
    normal = scale.quantile_transform(df, scale.fit_quantiles(df, ["x"], 11), normal=True).orderBy("x").collect()
    assert normal[50][0] == pytest.approx(0.0) and normal[25][0] == pytest.approx(-0.6744897, abs=1e-6)


def test_wide_and_long(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0), (1, "b", 1.0), (2, "b", 5.0)], "k int, sensor string, value double")
    wide = C.to_wide(df, ["k"], ["a", "b"]).orderBy("k")
    assert [tuple(r) for r in wide.collect()] == [(1, 3.0, 1.0), (2, None, 5.0)]
    assert C.to_long(wide, ["a", "b"], ["k"]).count() == 4


def test_flows(spark):
    from penstock.plans.flows import prepare_loop, prepare_water

    rows = [(i, float(i % 5), 1.0, None if i % 3 else str(i), 7.0) for i in range(60)]
    schema = "t long, `1_FIT_001_PV` double, `2_LT_001_PV` double, valve string, stuck double"
    train = with_row_id(spark.createDataFrame(rows, schema), ["t"])
    test = train.withColumn("label", (F.col("t") % 4 == 0).cast("int"))
    done = prepare_water(train, test, settle_rows=10, exclude=("t",))
    assert done.denied == ["2_LT_001_PV"] and done.low_variance == ["stuck"]
    assert done.features == ["1_FIT_001_PV", "valve"] and done.train.count() == 50
    checks = {r["check"]: r["passed"] for r in profile.readiness(done.facts).collect()}
    assert checks.pop("enough_attack_rows") == 0 and set(checks.values()) == {1}

    labels = test.select("row_id", F.col("label").alias("attack"))
    loop = prepare_loop(train.drop("valve"), test.drop("label", "valve"), labels, chunk_rows=20)
    assert "label" in loop.test.columns and loop.train.filter("label <> 0").count() == 0

"""Ordered building blocks over several partitions and small blocks, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from penstock.operators.impute import chunk_mean_fill, interpolate, ordered_fill
from penstock.operators.ordering import quantiles, running_totals, with_row_id
from penstock.operators.windows import boundary_windows, clean_outliers, lags, rolling, sequence, transitions


@pytest.fixture
def gaps(spread):
    """500 rows with long gaps and a hot entity that holds most rows."""
    rng = np.random.default_rng(1)
    n = 500
    x = pd.Series(rng.normal(size=n)).where(rng.random(n) < 0.1)
    x[100:330] = np.nan
    entity = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 6, n))
    pdf = pd.DataFrame({"t": np.arange(n) * 3, "entity": entity, "x": x})
    rows = [(int(t), int(e), None if np.isnan(v) else float(v)) for t, e, v in pdf.itertuples(index=False)]
    df = spread.createDataFrame(rows, "t long, entity long, x double").repartition(7)
    return pdf, df


def test_row_id_is_dense_and_ordered(gaps):
    pdf, df = gaps
    got = with_row_id(df, ["t"]).toPandas().sort_values("t")
    assert got["row_id"].tolist() == list(range(len(pdf)))


def test_row_id_with_a_hot_first_key(spread):
    df = spread.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    got = with_row_id(df, ["k", "id"]).toPandas().sort_values(["k", "id"])
    assert got["row_id"].tolist() == list(range(1000))


def test_running_totals_by_group(spread):
    df = spread.range(600).select((F.col("id") % 4).alias("g"), F.col("id").alias("v"), (F.col("id") % 7).alias("n"))
    got = running_totals(df, ["v"], ["n"], ["g"]).toPandas().sort_values(["g", "v"])
    assert got["cum_n"].tolist() == got.groupby("g")["n"].cumsum().tolist()


def test_quantiles_match_numpy(spread):
    rng = np.random.default_rng(2)
    values = np.round(rng.gamma(2, 3, 2000), 2)
    values[:700] = 1.25  # one value holds a third of the rows
    df = spread.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(values)], "g int, v double")
    probs = [0.0, 0.01, 0.5, 0.77, 0.99, 1.0]
    got = quantiles(df, "v", probs, ["g"]).toPandas()
    for (g, p), q in got.set_index(["g", "prob"])["quantile"].items():
        assert q == pytest.approx(np.quantile(values[np.arange(2000) % 3 == g], p))
    assert len(got) == 18
    whole = quantiles(df, "v", probs).toPandas().set_index("prob")["quantile"]
    assert whole.to_dict() == pytest.approx({p: np.quantile(values, p) for p in probs})


@pytest.mark.parametrize("block_rows", [7, 64, 100_000])
def test_fills_cross_blocks(gaps, block_rows):
    pdf, df = gaps
    ordered = with_row_id(df, ["t"])
    got = ordered_fill(ordered, ["x"], block_rows=block_rows).toPandas().sort_values("t")
    want = pdf["x"].ffill().bfill()
    np.testing.assert_allclose(got["x"].astype(float), want)


@pytest.mark.parametrize("block_rows", [9, 100_000])
def test_fill_by_entity(gaps, block_rows):
    pdf, df = gaps
    ordered = with_row_id(df, ["entity", "t"])
    got = ordered_fill(ordered, ["x"], entity=["entity"], backward=False, block_rows=block_rows).toPandas()
    got = got.sort_values(["entity", "t"])
    want = pdf.sort_values(["entity", "t"]).groupby("entity")["x"].ffill()
    np.testing.assert_allclose(got["x"].astype(float), want)


def test_interpolation_crosses_blocks(gaps):
    pdf, df = gaps
    got = interpolate(with_row_id(df, ["t"]), ["x"], "t", block_rows=11).toPandas().sort_values("t")
    want = pd.Series(pdf["x"].to_numpy(), index=pdf["t"]).interpolate("index", limit_area="inside")
    np.testing.assert_allclose(got["x"].astype(float), want)


@pytest.mark.parametrize("block_rows", [8, 50, 100_000])
def test_windows_cross_blocks_but_not_entities(gaps, block_rows):
    pdf, df = gaps
    filled = df.fillna(0.0)
    ordered = sequence(filled, ["t"], ["entity"])
    pdf = pdf.fillna(0.0).sort_values(["entity", "t"])
    groups = pdf.groupby("entity")["x"]
    got = lags(ordered, ["x"], (1, 3), partition=["entity"], block_rows=block_rows).toPandas().sort_values(["entity", "t"])
    np.testing.assert_allclose(got["x_lag3"].astype(float), groups.shift(3))
    got = rolling(ordered, ["x"], 4, ("mean", "std", "min", "max"), partition=["entity"], block_rows=block_rows)
    got = got.toPandas().sort_values(["entity", "t"])
    assert len(got) == len(pdf)
    r = groups.rolling(4, min_periods=1)
    np.testing.assert_allclose(got["x_mean4"], r.mean().to_numpy(), atol=1e-12)
    np.testing.assert_allclose(got["x_max4"], r.max().to_numpy())
    np.testing.assert_allclose(got["x_std4"].astype(float), r.std().to_numpy(), atol=1e-7)
    full = rolling(ordered, ["x"], 4, ("mean",), complete=True, partition=["entity"], block_rows=block_rows)
    assert full.count() == groups.rolling(4).mean().notna().sum()


def test_transitions_across_blocks(spread):
    states = [0, 0, 1, 1, 0, 1, 0, 0, 0, 1]
    df = with_row_id(spread.createDataFrame(list(enumerate(states)), "t long, s int"), ["t"])
    got = transitions(df, ["s"], 3, block_rows=4).toPandas().sort_values("t")
    changed = [0] + [int(a != b) for a, b in zip(states, states[1:])]
    assert got["s_changed"].tolist() == changed
    assert got["s_changes3"].tolist() == pd.Series(changed).rolling(3, min_periods=1).sum().astype(int).tolist()


def test_boundary_windows(spread):
    df = spread.range(20).select(F.col("id").alias("t"), (F.col("id") >= 12).cast("int").alias("split"))
    assert sorted(r["t"] for r in boundary_windows(df, "split", 4, ["t"], block_rows=8).collect()) == [12, 13, 14]


def test_chunk_means_with_an_empty_chunk(spread):
    rows = [(0, 1.0), (1, None), (2, None), (3, None), (4, None), (5, 7.0)]
    df = spread.createDataFrame(rows, "row_id long, x double")
    got = chunk_mean_fill(df, ["x"], rows=2).orderBy("row_id").toPandas()["x"].tolist()
    assert got[:2] == [1.0, 1.0] and got[4:] == [7.0, 7.0] and all(np.isnan(v) for v in got[2:4])


def test_gap_runs(spread):
    rows = [(i, v) for i, v in enumerate([None, None, 3.0, None, 5.0, None])]
    df = spread.createDataFrame(rows, "row_id long, x double")

    def run(**kw):
        return [r["x"] for r in ordered_fill(df, ["x"], block_rows=2, **kw).orderBy("row_id").collect()]

    assert run(backward=False) == [None, None, 3, 3, 5, 5]
    assert run(forward=False) == [3, 3, 3, 5, 5, None]
    assert run() == [3, 3, 3, 3, 5, 5]


def test_outlier_is_replaced_by_the_mode(spread):
    rows = [("a", i, 100.0 if i == 40 else 5.0 + 0.1 * (i % 3)) for i in range(128)]
    df = spread.createDataFrame(rows, "sensor string, row_id long, value double")
    got = clean_outliers(df).toPandas().sort_values("row_id")
    assert got["outlier"].iloc[40] == 1 and got["cleaned"].iloc[40] in (5.0, 5.1)
    assert got["outlier"].sum() < 5

"""The exact neighbour join: candidates by matrix product, and its rows before the join."""

import numpy as np
import pytest

from penstock.operators import neighbors
from penstock.operators.neighbors import _distances, _nearest


@pytest.mark.parametrize("case", ["spread", "equal distances", "far from the origin", "ties", "not a number"])
def test_nearest_equals_brute_force(case):
    draw = np.random.default_rng(3)
    x, y = draw.normal(size=(40, 16)), draw.normal(size=(90, 16))
    if case == "equal distances":
        x = y = np.eye(30)
    if case == "far from the origin":
        x, y = x + 1e7, y + 1e7
    if case == "ties":
        x, y = np.round(x), np.round(y[:, :]) * 0
    if case == "not a number":
        y[5, 2] = np.nan
    d = _distances(x, y)
    order = np.argsort(d, axis=1, kind="stable")[:, :5]
    i, j, found = _nearest(x, y, 5)
    assert (i == np.repeat(np.arange(len(x)), 5)).all()
    assert (j.reshape(order.shape) == order).all()
    assert (found.reshape(order.shape) == np.take_along_axis(d, order, axis=1)).all()


def test_fewer_candidates_than_asked():
    i, j, d = _nearest(np.zeros((2, 3)), np.ones((2, 3)), 5)
    assert i.tolist() == [0, 0, 1, 1] and j.tolist() == [0, 1, 0, 1]


def test_asked_vectors_are_routed_once_and_slices_set_the_pivots(spark, monkeypatch):
    """In many dimensions every cell is needed: the vectors must not be written once a cell, nor cells grow with the root."""
    x = np.random.default_rng(4).normal(size=(900, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    staged, plain = {}, neighbors.stage
    monkeypatch.setattr(neighbors, "stage", lambda d, tag: staged.setdefault(tag, plain(d, tag)))
    got = neighbors.knn_join(df, df, 3, same_table=True, slice_rows=300).count()
    assert got == 2700
    assert staged["knn-routed"].count() == 900
    assert staged["knn-cells"].select("cell").distinct().count() <= 3

"""Rolling means of the recent-row buffer, without pandas windows."""

import numpy as np
import pandas as pd
import pytest

from penstock.streaming.online import _rolling


@pytest.mark.parametrize("values", [[], [3.0], [1, 2, np.nan, 4, 5, 6, np.nan, np.nan, np.nan, np.nan, 3], [np.inf, 1, 2, 3, 4, 5]])
def test_rolling_equals_pandas(values):
    v = np.array(values, dtype=float)
    window = pd.Series(v, dtype=float).rolling(4, min_periods=1)
    mean, n = _rolling(v, 4)
    assert np.allclose(mean, window.mean(), equal_nan=True)
    assert n.tolist() == window.count().astype("int64").tolist()

import numpy as np

from penstock.operators import windows


def frame(spark, rows):
    return spark.createDataFrame(rows, "sensor string, row_id long, value double")


def series(sensor, start, n, seed, spike=None, gap=None):
    rng = np.random.default_rng(seed)
    x = np.sin(np.arange(n) / 9.0) + rng.normal(size=n) * 0.05
    rows = []
    for i in range(n):
        v = float(x[i])
        if spike is not None and i == spike:
            v = 40.0
        if gap is not None and i in gap:
            v = None
        rows.append((sensor, start + i, v))
    return rows


def test_other_sensors_change_nothing(spark):
    a = series("a", 0, 700, 1, spike=333)
    alone = sorted(tuple(r) for r in windows.clean_outliers(frame(spark, a), block_rows=128).collect())
    with_b = windows.clean_outliers(frame(spark, a + series("b", 700, 250, 2)), block_rows=128)
    assert sorted(tuple(r) for r in with_b.filter("sensor = 'a'").collect()) == alone
    assert len(alone) == 700 and with_b.count() == 950


def test_spike_found_and_gaps_left_alone(spark):
    rows = series("a", 0, 600, 3, spike=250, gap={100, 101, 102})
    out = {r.row_id: r for r in windows.clean_outliers(frame(spark, rows), block_rows=128).collect()}
    assert out[250].outlier == 1 and out[250].cleaned != 40.0
    assert all(out[i].outlier == 0 and out[i].value is None for i in (100, 101, 102))
    assert sum(r.outlier for r in out.values()) <= 6


def test_short_sensor_is_one_block(spark):
    out = windows.clean_outliers(frame(spark, series("s", 5, 40, 4)), block_rows=128).collect()
    assert sorted(r.row_id for r in out) == list(range(5, 45))

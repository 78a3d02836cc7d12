import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from penstock.llm import op11_hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score string, leaf string, qid string"


def brute(rows):
    """The contract, row by row: rows are (vec_id, vector, label) that take part, label already turned."""
    out = []
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.int64)
    lab = np.array([r[2] for r in rows])
    for a in range(len(rows)):
        if ids[a] % 100:
            continue
        s = x @ x[a]
        order = np.lexsort((ids, -s))
        pos = [j for j in order if lab[j] == lab[a] and ids[j] != ids[a]][:5]
        for p in pos:
            ps = s[p]
            neg = [j for j in order if lab[j] != lab[a] and 30 * ps <= 100 * s[j] <= 90 * ps][:10]
            out += [(int(ids[a]), int(ids[p]), r + 1, int(ids[j]), int(ps), int(s[j])) for r, j in enumerate(neg)]
    return sorted(out)


def fixture(n=900, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dim))
    rows = []
    for i in range(n):
        lab = int(rng.integers(10))
        v = (centres[lab] * 0.15 + rng.normal(size=dim) * 0.12).astype(np.float32)
        if i % 37 == 5:
            v = rows[-1][1]  # equal vectors: ties in every score
        rows.append((i, v, lab))
    return rows


def taking_part(rows):
    return [(i, [math.floor(256 * float(c)) for c in v], (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows]


def frame(spark, rows, extra=()):
    data = [(i, [float(c) for c in v], lab, "clash", "clash", "clash") for i, v, lab in rows] + list(extra)
    return spark.createDataFrame(data, SCHEMA)


def test_against_brute_force_with_small_chunks(spark, spread, monkeypatch):
    monkeypatch.setattr(hn, "CHUNK_ROWS", 16)
    monkeypatch.setattr(hn, "QUERY_BLOCK", 3)
    monkeypatch.setattr(hn, "SEED_ROWS", 20)
    monkeypatch.setattr(hn, "FIT_ROWS", 300)
    rows = fixture()
    odd = [
        (10_000, None, 1, "x", "x", "x"), (10_100, [0.1] * 8, None, "x", "x", "x"), (10_200, [0.1, None] + [0.1] * 6, 1, "x", "x", "x"),
        (10_300, [float("nan")] + [0.1] * 7, 1, "x", "x", "x"), (10_400, [0.1] * 3, 1, "x", "x", "x"), (None, [0.2] * 8, 1, "x", "x", "x"),
        (10_500, [float("inf")] + [0.1] * 7, 2, "x", "x", "x"),
    ]
    got = sorted(tuple(r) for r in hn.mine(frame(spark, rows, odd)).collect())
    assert got == brute(taking_part(rows))
    assert len(got) > 100


def test_tree_bounds_hold_for_every_row():
    rng = np.random.default_rng(1)
    v = rng.integers(-100, 100, size=(400, 6))
    m2 = float((v * v).sum(1).max())
    tree = hn.fit_tree(hn.padded(v[:200], m2), m2, branch=4, leaf=8)
    at, seen = hn.route(tree, hn.padded(v, m2))
    tree.rows = np.bincount(at, minlength=len(tree.parent))
    for u, (near, far, _) in seen.items():
        if u:
            tree.near[u][:], tree.far[u][:] = near, far
    q = rng.integers(-100, 100, size=(20, 6))
    worst, best = hn.bounds(tree, q)
    s = q @ v.T
    assert np.all(s <= best[:, at] + 1e-6) and np.all(s >= worst[:, at] - 1e-6)


def test_empty_and_anchorless_tables(spark):
    assert hn.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, np.full(4, 0.01 * i, np.float32), i % 3) for i in range(1, 60)]
    assert hn.mine(frame(spark, rows)).count() == 0


def test_columns_and_types(spark, sf_dir):
    out = hn.digest(spark, sf_dir)
    assert [f.simpleString() for f in out.schema.fields] == [
        "anchor_id:bigint", "positive_id:bigint", "rank:int", "negative_id:bigint", "positive_score:bigint", "negative_score:bigint"
    ]
    got = out.filter(F.col("rank") == 1).count()
    assert got >= 0

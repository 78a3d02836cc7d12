import math

import numpy as np

from penstock.llm import op1_ann as ann


def brute(ids, x, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in range(len(ids)):
        s = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -s.round(12))) if ids[j] != ids[i]]
        out[int(ids[i])] = [int(ids[j]) for j in order[:k]]
    return out


def test_hadamard_is_orthonormal():
    h = ann.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(np.abs(h), 8**-0.5)


def test_buckets_are_nearest_signed_axes():
    x = np.random.default_rng(0).normal(size=(50, 6))
    signs = ann.rotations(6, 1, 1, 3)[0]
    r = ann.rotated(x, signs[0])
    first = ann.buckets(x, signs, 3)[:, 0]
    assert all(abs(abs(row).max() - (row if code < 8 else -row)[code % 8]) < 1e-12 for row, code in zip(r, first, strict=True))


def test_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    frame = rows.toPandas()
    want = brute(frame.vec_id.to_numpy(), np.stack(frame.embedding.to_numpy()).astype(float), 5)
    got = ann.nearest(rows, rows).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(v) == 5 for v in found.values()) and len(found) == len(want)
    assert np.mean([len(set(found[q]) & set(w)) / 5 for q, w in want.items()]) >= 0.9


def test_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, None), (6, [0.0, 0.0, 0.0]),
            (7, [nan, 1.0, 0.0]), (8, [inf, 0.0, 0.0]), (9, [1.0, None, 0.0]), (10, [1.0]), (None, [1.0, 0.0, 0.0]), (11, []), (12, [1e-200, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as id", "'x' as v", "'x' as t")
    got = ann.nearest(frame, frame).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
    assert set(by) == {1, 2, 3, 4, 12}
    assert by[1] == [(2, 1.0), (3, 1.0), (12, 1.0), (4, 0.0)]
    assert by[4] == [(1, 0.0), (2, 0.0), (3, 0.0), (12, 0.0)]


def test_many_copies_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 40)
    monkeypatch.setattr(ann, "QUERIES", 7)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    x[:150] = x[0]
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in sorted(ann.nearest(frame, frame, probes=16).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found[0] == [1, 2, 3, 4, 5] and found[149] == [0, 1, 2, 3, 4]
    want = brute(np.arange(300), x, 5)
    assert np.mean([len(set(found[q]) & set(w)) / 5 for q, w in want.items()]) >= 0.97


def test_rows_of_one_id_take_one_place(spark):
    rows = [(1, [1.0, 0.001 * j, 0.0, 0.0]) for j in range(1, 7)] + [(i, [1.0, 0.0, 0.1 * i, 0.0]) for i in range(2, 8)]
    asked = [(100, [1.0, 0.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.001])]
    frame, queries = (spark.createDataFrame(r, "vec_id long, embedding array<double>") for r in (rows, asked))
    found = {}
    for r in sorted(ann.nearest(frame, queries).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [i for i, _ in found[100]] == [1, 2, 3, 4, 5] and [i for i, _ in found[1]] == [2, 3, 4, 5, 6]
    assert found[100][0][1] == ann.cosines(np.array([asked[0][1]]), np.array([rows[0][1]]))[0]


def test_best_ids_match_brute_force():
    rng = np.random.default_rng(7)
    for k in (1, 3, 50):
        q, x, q_id, x_id = rng.normal(size=(20, 3)), rng.normal(size=(60, 3)), np.arange(20), rng.integers(0, 25, 60)
        a, b, score = ann.best_of(q_id, q, x_id, x, k)
        for i in range(len(q)):
            best = {}
            for j in range(len(x)):
                if x_id[j] != i:
                    best[int(x_id[j])] = max(best.get(int(x_id[j]), -2.0), float(ann.cosines(q[i : i + 1], x[j : j + 1])[0]))
            want = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
            assert list(zip(x_id[b[a == i]].tolist(), score[a == i].tolist(), strict=True)) == want


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(frame, frame).collect() == []

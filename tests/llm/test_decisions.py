import itertools
import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from penstock.llm import op4_quality as op4
from penstock.llm import op5_mixing as op5
from penstock.llm import op7_pii as op7
from penstock.llm import op9_sharding as op9

DOCS = "doc_id long, text string, source string"


# ---- op4


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = op4.fit_rules(docs, labels)
    assert 1 <= len(model.rules) <= 200
    scored = op4.score_documents(docs, model, F.col("doc_id"), op4.held_out()).filter("k1").withColumnRenamed("k0", "doc_id").join(labels, "doc_id")
    right = scored.groupBy("quality").agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int")).alias("a")).collect()
    assert all(r.a > 0.97 for r in right) and len(right) == 2
    assert op4.fit_rules(docs, labels) == model  # reruns agree


def test_compiled_score_is_the_sum_of_rules(spark):
    rule = (op4.Condition("words", True, 1.0), op4.Condition("upper", False, 0.5))
    model = op4.RuleModel(-1.0, ((rule, 3.0),))
    rows = spark.createDataFrame([(1, "a few plain words"), (2, "LOUD WORDS HERE"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.k0: r.score for r in op4.score_documents(rows, model, F.col("doc_id")).collect()}
    low, high = 1 / (1 + math.e), 1 / (1 + math.exp(-2))
    assert np.allclose([got[k] for k in (1, 2, 3, 4)], [high, low, low, low])


def test_paths():
    tree = "Tree\n  If (feature 0 <= 0.5)\n   If (feature 1 > 2.0)\n    Predict: 1.0\n   Else (feature 1 <= 2.0)\n    Predict: 0.0\n  Else (feature 0 > 0.5)\n   Predict: 1.0\n"
    a, b = op4.Condition("x", False, 0.5), op4.Condition("y", True, 2.0)
    assert op4.paths(tree, ["x", "y"]) == [(a,), (a, b), (a, op4.Condition("y", False, 2.0)), (op4.Condition("x", True, 0.5),)]


def test_quality_odd(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = op4.fit_rules(odd_docs, none)
    assert model == op4.RuleModel(0.0) and op4.fit_rules(no_docs, none) == model
    assert op4.keep_good(odd_docs, model).columns == odd_docs.columns and op4.keep_good(odd_docs, model).count() == odd_docs.count()
    ones = spark.createDataFrame([(k, 1) for k in range(9)] + [(None, 0), (3, None)], "doc_id long, quality int")
    assert op4.keep_good(no_docs, op4.fit_rules(odd_docs, ones)).count() == 0
    assert all(0 <= r.score <= 1 for r in op4.score_documents(odd_docs, op4.fit_rules(odd_docs, ones), F.col("doc_id")).collect())


# ---- op5


def test_mix_is_near_its_targets(spread):
    rows = [(k, "w " * (1 + k * 7919 % 50), f"s{k % 5}" if k % 3 else "hot") for k in range(3000)] + [(9999, "w " * 400, "s1"), (None, None, None), (5, "x", None)]
    docs = spread.createDataFrame(rows, DOCS)
    plan = op5.mix_plan(docs).collect()
    assert len(plan) == len(rows)
    taken, target, size = Counter(), {}, Counter()
    for r in plan:
        taken[r.source_size] += r.times * r["size"]
        target[r.source_size] = r.target
        size[r.source_size] += r["size"]
    assert all(0 <= r.times <= 2 for r in plan)
    assert all(abs(taken[s] - target[s]) <= 400 for s in target) and all(t <= 2 * s + 1e-9 for s, t in target.items())
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    again = op5.mix_plan(docs.repartition(7)).collect()
    assert sorted((r.doc_id or -1, r.times) for r in plan) == sorted((r.doc_id or -1, r.times) for r in again)
    mixed = Counter(r.doc_id for r in op5.mix_documents(docs).collect())
    assert mixed == Counter({r.doc_id: r.times for r in plan if r.times and r.doc_id != 5} | {5: sum(r.times for r in plan if r.doc_id == 5)})


def test_budgets_are_nested(spread):
    docs = spread.createDataFrame([(k, "w " * (1 + k % 9), "ab"[k % 2]) for k in range(500)], DOCS)
    small, large = ({r.doc_id: r.times for r in op5.mix_plan(docs, share=s).collect()} for s in (0.3, 0.6))
    assert all(small[k] <= large[k] for k in small)


def test_mix_odd(odd_docs, no_docs):
    assert op5.mix_documents(odd_docs).columns == odd_docs.columns and op5.mix_plan(odd_docs).count() == odd_docs.count()
    assert op5.mix_documents(no_docs).count() == 0 and op5.mix_plan(no_docs).count() == 0


# ---- op7

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            tests = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and op7.luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}
            if tests[kind]():
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.text("1230.@+- ()ab\n%é", max_size=60) | st.from_regex(r"(\+[0-9]{1,3}[ (.-]?[0-9 ().-]{6,14}[0-9] ?|[0-9]{12,19} |[a-z.]{1,5}@[a-z-]{1,5}\.[a-z.]{1,4} ?|[0-9]{1,3}(\.[0-9]{1,3}){2,4} ){1,4}", fullmatch=True))
def test_base_spans_are_those_of_the_patterns(text):
    assert op7.base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1" * 100_000, "x" * 200_000 + "1"):
        op7.find_spans([text], op7.Field(np.zeros((len(op7.FEATURES), 5)), np.zeros((5, 5)), np.zeros((5, 5))))


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(2)
    own, chain, skip = rng.normal(size=(len(op7.FEATURES), 5)), rng.normal(size=(5, 5)), np.zeros((5, 5))
    shapes = rng.normal(size=(3, len(op7.FEATURES)))
    field = op7.Field(own, chain, skip)
    got = field.beliefs(shapes, np.array([True, False, False]), np.array([-1, -1, -1]))
    local = shapes @ own
    want = np.zeros((3, 5))
    for y in itertools.product(range(5), repeat=3):
        p = math.exp(sum(local[k, y[k]] for k in range(3)) + chain[y[0], y[1]] + chain[y[1], y[2]])
        for k in range(3):
            want[k, y[k]] += p
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True))


def test_field_adds_what_repeats(spark, sf_dir):
    field = op7.fit_on(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    text = "pay 4539578763621486 now. Again 4539.5787.6362.1486 please. Version 3. of token = \"4539aa\""
    base, added = op7.find_spans([text], field)[0]
    assert base == [("card", 4, 20)] and added == [("card", text.index("4539.57"), text.index(" please"))]
    assert op7.find_spans(["The version 3.0 has 12 parts in 1999."], field)[0] == ([], [])


def test_personal_odd(spark, odd_docs, no_docs):
    field = op7.fit_on(no_docs)
    assert op7.find_personal(odd_docs, field).count() == odd_docs.count() and op7.find_personal(no_docs, field).count() == 0


# ---- op9


def test_shards(spread):
    docs = spread.createDataFrame([(k, "x" * (k % 40)) for k in range(4000)] + [(7, "again")] * 5, "doc_id long, text string")
    done = op9.shard_documents(docs, [1.0] * 16, grown=[1.0] * 17).collect()
    by = {}
    for r in done:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(16))
    assert max(map(len, by.values())) < 1.4 * len(done) / 16 and len({r.shard for r in done if r.doc_id == 7}) == 1
    moved = sum(r.grown_shard == 16 for r in done) / len(done)
    assert 0.03 < moved < 0.09


def test_weights(spread):
    docs = spread.range(6000).withColumnRenamed("id", "doc_id")
    n = Counter(r.shard for r in op9.shard_documents(docs, [1.0, 3.0, 0.0]).collect())
    assert 0.7 < n[1] / 6000 < 0.8 and 2 not in n


def test_shards_odd(odd_docs, no_docs):
    done = op9.shard_documents(odd_docs, [1.0] * 4)
    assert done.count() == odd_docs.count() and done.columns == [c for c in odd_docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert op9.shard_documents(no_docs, [1.0]).count() == 0


# ---- pipeline


def test_pipeline_stages(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.written(stage(spark, docs, sf_dir), "test")
        if name != "shard":
            assert path.columns == columns, name
        if name not in ("mix", "shard"):
            assert 0 < path.count() <= before, name
            assert path.exceptAll(docs).count() == 0
        before, docs = path.count(), path
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.exceptAll(docs).count() == 0 and whole.count() == docs.count()
    for odd in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            odd = corpus_pipeline.written(stage(spark, odd, sf_dir), "odd")

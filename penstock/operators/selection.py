"""Feature selection: distribution shift, correlation, ensemble vote, PCA, names."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstock.functions.draws import seeded_hash
from penstock.operators.columns import to_long
from penstock.operators.neighbors import knn_join
from penstock.operators.ordering import running_totals
from penstock.operators.scale import Params

# Fixed values.
KS_P_VALUE = 0.05
TOP_NEIGHBORS = 40
REDUNDANT_CORRELATION = 0.98
PCA_COMPONENTS = 8


def ks_two_sample(long: DataFrame, in_second: Column, by: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    """`(by…, n_first, n_second, d, p_value)`: two-sample Kolmogorov-Smirnov per feature.

    Values are counted per (feature, value) before the ordered pass, so repeated readings cost one row.
    The p-value is the asymptotic one.
    """
    counts = long.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count_if(~in_second).alias("a"), F.count_if(in_second).alias("b")
    )
    totals = counts.groupBy(*by).agg(F.sum("a").alias("n_first"), F.sum("b").alias("n_second"))
    steps = running_totals(counts, [value], ["a", "b"], by).join(totals, list(by))
    gap = F.abs(F.col("cum_a") / F.col("n_first") - F.col("cum_b") / F.col("n_second"))
    found = steps.groupBy(*by).agg(
        F.first("n_first").alias("n_first"), F.first("n_second").alias("n_second"), F.max(gap).alias("d")
    )
    scale = F.sqrt(F.col("n_first") * F.col("n_second") / (F.col("n_first") + F.col("n_second")))
    return found.withColumn("p_value", kolmogorov_tail(scale * F.col("d")))


def kolmogorov_tail(x: Column) -> Column:
    """Upper tail of the Kolmogorov distribution."""
    terms = F.sequence(F.lit(1), F.lit(100))
    total = F.aggregate(
        terms, F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * x * x),
    )
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * total)))


def shifted_features(ks: DataFrame, p_value: float = KS_P_VALUE) -> list[str]:
    """Features whose train and validation distributions differ."""
    return sorted(r["feature"] for r in ks.filter(F.col("p_value") < p_value).select("feature").collect())


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """`(feature, other, correlation)` for all ordered pairs; the matrix has the size of the column list."""
    vectors = VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="error").transform(df.select(*cols))
    matrix = Correlation.corr(vectors.select("_v"), "_v").first()[0].toArray()
    pairs = [(a, b, float(matrix[i][j])) for i, a in enumerate(cols) for j, b in enumerate(cols) if i != j]
    return df.sparkSession.createDataFrame(pairs, "feature string, other string, correlation double")


def top_correlated(corr: DataFrame, k: int = TOP_NEIGHBORS) -> DataFrame:
    """The k most correlated other sensors of each sensor, by absolute value."""
    order = Window.partitionBy("feature").orderBy(F.round(F.abs("correlation"), 9).desc(), "other")
    return corr.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def redundant_features(corr: DataFrame, cols: Sequence[str], above: float = REDUNDANT_CORRELATION) -> list[str]:
    """Features to drop: those correlated above the limit with a feature kept earlier in column order."""
    close = {(r["feature"], r["other"]) for r in corr.filter(F.abs("correlation") > above).collect()}
    kept: list[str] = []
    for c in cols:
        if not any((c, k) in close for k in kept):
            kept.append(c)
    return [c for c in cols if c not in kept]


def binned_counts(df: DataFrame, params: Params, label: str = "label", bins: int = 10) -> DataFrame:
    """`(feature, bin, label, n)` with equal-width bins of the training range; outer values go to the edge bins."""
    binned = []
    for c, p in params.items():
        spread = p["max"] - p["min"]
        at = F.floor((F.col(c) - F.lit(p["min"])) * bins / F.lit(spread if spread != 0 else 1.0)).cast("int")
        binned.append(F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).alias(c))
    long = to_long(df.select(F.col(label).alias("label"), *binned), list(params), ["label"], value="bin")
    return long.groupBy("feature", "bin", "label").agg(F.count(F.lit(1)).alias("n"))


def contingency_scores(counts: DataFrame) -> DataFrame:
    """`(feature, chi2, info_gain, gain_ratio)` from binned counts. The windows run over bins × classes."""
    everything, by_bin = Window.partitionBy("feature"), Window.partitionBy("feature", "bin")
    by_label = Window.partitionBy("feature", "label")
    sums = counts.select(
        "*", F.sum("n").over(everything).alias("total"), F.sum("n").over(by_bin).alias("in_bin"),
        F.sum("n").over(by_label).alias("in_label"),
    )
    n, total, row, col = F.col("n"), F.col("total"), F.col("in_bin"), F.col("in_label")
    scored = sums.groupBy("feature").agg(
        (F.first("total") * (F.sum(n * n / (row * col)) - 1)).alias("chi2"),
        F.sum(n / total * F.log2(n * total / (row * col))).alias("info_gain"),
        F.sum(-n / total * F.log2(row / total)).alias("_bin_entropy"),
    )
    return scored.select(
        "feature", "chi2", "info_gain",
        F.when(F.col("_bin_entropy") == 0, 0.0).otherwise(F.col("info_gain") / F.col("_bin_entropy")).alias("gain_ratio"),
    )


def moment_scores(df: DataFrame, cols: Sequence[str], label: str = "label") -> DataFrame:
    """`(feature, abs_corr, anova_f)` against a numeric 0/1 label."""
    long = df.select(F.col(label).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in cols])
    long = to_long(long, cols, ["label"])
    groups = long.groupBy("feature", "label").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * grand * grand
    within = F.sum(F.col("n") * F.col("v"))
    classes = F.count(F.lit(1))
    f_values = groups.groupBy("feature").agg(
        F.when(within == 0, 0.0).otherwise((between / (classes - 1)) / (within / (F.sum("n") - classes))).alias("anova_f")
    )
    corr = long.groupBy("feature").agg(F.coalesce(F.abs(F.corr("value", "label")), F.lit(0.0)).alias("abs_corr"))
    return corr.join(f_values, "feature")


# Fixed value: anchors of the anchored ReliefF, a documented bound of the rows that ask for neighbours (all rows answer).
RELIEFF_ANCHORS = 1000


def relieff(df: DataFrame, cols: Sequence[str], k: int = 10, anchors: int | None = None) -> DataFrame:
    """`(feature, relieff)` of a table `(id, vec, label)` with a 0/1 label, `vec` in the order of `cols`.

    Every row (or, with `anchors`, the `anchors` rows of smallest seeded hash of the id) looks for its k nearest rows of its own
    class (hits) and of the other class (misses) among all rows; the weight of a feature is its mean distance to misses less
    that to hits. With anchors the cost grows with the rows once, not with the rows squared.
    """
    base = df.select("id", F.col("vec").cast("array<double>").alias("vec"), "label")
    asking = base
    if anchors is not None:
        asking = base.orderBy(seeded_hash("relieff", "id"), "id").limit(anchors)
    sides = {v: base.filter(F.col("label") == v).select("id", "vec") for v in (0, 1)}
    pairs = None
    for v in (0, 1):
        mine = asking.filter(F.col("label") == v).select("id", "vec")
        if anchors is None:
            hits = knn_join(mine, sides[v], k, same_table=True)
        else:
            first = Window.partitionBy("id").orderBy("distance", "neighbor")
            found = knn_join(mine, sides[v], k + 1).filter(F.col("neighbor") != F.col("id"))
            hits = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        hits = hits.select("id", "neighbor", F.lit(-1.0).alias("sign"))
        misses = knn_join(mine, sides[1 - v], k).select("id", "neighbor", F.lit(1.0).alias("sign"))
        both = hits.unionByName(misses)
        pairs = both if pairs is None else pairs.unionByName(both)
    # The mean over the pairs found, so a class with fewer than k rows does not weigh less.
    own = base.select("id", F.col("vec").alias("a"))
    other = base.select(F.col("id").alias("neighbor"), F.col("vec").alias("b"))
    apart = pairs.join(own, "id").join(other, "neighbor").select(
        "sign", F.posexplode(F.zip_with("a", "b", lambda x, y: F.abs(x - y))).alias("position", "diff")
    )
    names = F.array(*[F.lit(c) for c in cols])
    means = apart.groupBy("position").agg(
        F.avg(F.when(F.col("sign") > 0, F.col("diff"))).alias("miss"), F.avg(F.when(F.col("sign") < 0, F.col("diff"))).alias("hit")
    )
    return means.select(F.element_at(names, F.col("position") + 1).alias("feature"), (F.col("miss") - F.col("hit")).alias("relieff"))


def vote(scores: DataFrame, methods: Sequence[str], top: int = 20) -> DataFrame:
    """Rank-sum vote over score columns: `(feature, rank_sum, place)`, best `top` first; one row per feature."""
    ranks = [
        F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.round(m, 9).desc())).alias(f"_r_{m}") for m in methods
    ]
    ranked = scores.select("feature", *ranks)
    total = ranked.select("feature", sum((F.col(f"_r_{m}") for m in methods), F.lit(0)).cast("long").alias("rank_sum"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("rank_sum", "feature"))
    return total.withColumn("place", place).filter(F.col("place") <= top)


def pca(df: DataFrame, vector: str, k: int = PCA_COMPONENTS):
    """Fitted PCA model and `(component, explained)`."""
    model = PCA(k=k, inputCol=vector, outputCol="components").fit(df)
    rows = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)]
    return model, df.sparkSession.createDataFrame(rows, "component int, explained double")


def gram(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """`(n, column sums, X^T X)` of an array column in one pass: each Arrow batch adds its own product, one aggregate sums them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column(vector)
            x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
            cells = np.concatenate([[batch.num_rows], x.sum(0), (x.T @ x).ravel()])
            yield pa.record_batch({"i": pa.array(np.arange(len(cells)), pa.int32()), "v": pa.array(cells, pa.float64())})

    sums = df.select(vector).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # 1 + p + p^2 cells
    if not sums:
        return 0, np.zeros(0), np.zeros((0, 0))
    cells = np.zeros(max(r["i"] for r in sums) + 1)
    for r in sums:
        cells[r["i"]] = r["v"]
    p = int(round((-1 + math.sqrt(1 + 4 * (len(cells) - 1))) / 2))
    return int(cells[0]), cells[1: 1 + p], cells[1 + p:].reshape(p, p)


def jacobi(a: np.ndarray, tol: float = 1e-12, sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending) and eigenvectors (columns) of a symmetric matrix by cyclic Jacobi rotations."""
    a = np.array(a, dtype=np.float64)
    p = len(a)
    v = np.eye(p)
    scale = max(1e-300, np.abs(a).max() if p else 1.0)
    for _ in range(sweeps):
        off = np.sqrt((np.triu(a, 1) ** 2).sum())
        if off <= tol * scale:
            break
        for i in range(p - 1):
            for j in range(i + 1, p):
                if abs(a[i, j]) <= tol * scale * 1e-3:
                    continue
                theta = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + math.sqrt(theta * theta + 1))
                c = 1 / math.sqrt(t * t + 1)
                s = t * c
                ci, cj = a[:, i].copy(), a[:, j].copy()
                a[:, i], a[:, j] = c * ci - s * cj, s * ci + c * cj
                ri, rj = a[i, :].copy(), a[j, :].copy()
                a[i, :], a[j, :] = c * ri - s * rj, s * ri + c * rj
                vi, vj = v[:, i].copy(), v[:, j].copy()
                v[:, i], v[:, j] = c * vi - s * vj, s * vi + c * vj
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order]


def pca_jacobi(df: DataFrame, vector: str, k: int = PCA_COMPONENTS) -> tuple[np.ndarray, DataFrame]:
    """Principal axes (p x k) and `(component, explained)`, the share of the total variance, from the sample covariance.

    The covariance comes from one aggregate of per-batch Gram matrices, so its cost grows with the rows only; the p x p
    eigenproblem is solved by Jacobi rotations on the driver. Fewer than two rows: no components."""
    n, total, g = gram(df, vector)
    spark = df.sparkSession
    if n < 2:
        return np.zeros((len(total), 0)), spark.createDataFrame([], "component int, explained double")
    mean = total / n
    cov = (g - n * np.outer(mean, mean)) / (n - 1)
    values, axes = jacobi(cov)
    trace = values.sum()
    rows = [(i + 1, float(values[i] / trace) if trace > 0 else 0.0) for i in range(min(k, len(values)))]
    return axes[:, :k], spark.createDataFrame(rows, "component int, explained double")


# Instrument codes by priority.
HIGH_PRIORITY, MEDIUM_PRIORITY, LOW_PRIORITY = ("FIT", "LT", "PIT"), ("AIT",), ("STATUS",)


def priority(sensor: Column) -> Column:
    """high / medium / low / other tier from the instrument code in the sensor name."""

    def has(codes: Sequence[str]) -> Column:
        return F.regexp_extract(sensor, f"(^|_)({'|'.join(codes)})(_|$)", 2) != ""

    return F.when(has(HIGH_PRIORITY), "high").when(has(MEDIUM_PRIORITY), "medium").when(has(LOW_PRIORITY), "low").otherwise("other")


def state_overlap(train: DataFrame, test: DataFrame, states: Sequence[str]) -> DataFrame:
    """`(train_states, test_states, shared, unseen, pct_shared)` over distinct state tuples."""
    a = train.select(*states).distinct().withColumn("_train", F.lit(1))
    b = test.select(*states).distinct().withColumn("_test", F.lit(1))
    both = a.select(*states, "_train", F.lit(0).alias("_test")).unionByName(b.select(*states, F.lit(0).alias("_train"), "_test"))
    seen = both.groupBy(*states).agg(F.max("_train").alias("a"), F.max("_test").alias("b"))
    one = seen.agg(
        F.sum("a").alias("train_states"), F.sum("b").alias("test_states"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("shared"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("unseen"),
    )
    return one.withColumn("pct_shared", 100.0 * F.col("shared") / F.col("test_states"))

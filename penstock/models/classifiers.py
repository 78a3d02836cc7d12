"""Edge and central classifiers on MLlib, described by small specs."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import classification as ml
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.functions.decisions import predicted
from penstock.models import cell_forest, extra_trees, kernels, spread_forest
from penstock.session import scratch_dir, scratch_path
from penstock.sources.staging import stage

MAX_DEPTH = 30  # the deepest tree MLlib builds


@dataclass(frozen=True)
class TreeSpec:
    """A tree ensemble: `kind` is forest, extra or boosted."""

    kind: str
    trees: int
    depth: int
    min_leaf: int = 1
    step: float = 0.1
    weighted: bool = True
    seed: int = 42
    bins: int = 32
    bagged: bool = True


@dataclass(frozen=True)
class CascadeConfig:
    name: str
    edge: TreeSpec
    central: TreeSpec


def _boosted(trees: int, depth: int) -> TreeSpec:
    return TreeSpec("boosted", trees, depth, step=0.1, weighted=False)


# The six configurations (edge, central). Minimum split sizes follow from the leaf sizes.
CONFIGS = (
    CascadeConfig("Config_1_Lightweight", TreeSpec("forest", 50, 15, 5), TreeSpec("forest", 200, 30, 2)),
    CascadeConfig("Config_2_Balanced", TreeSpec("forest", 100, 20, 5), _boosted(200, 7)),
    CascadeConfig("Config_3_FastEdge", TreeSpec("extra", 50, 15, 5), TreeSpec("forest", 300, 30, 2)),
    CascadeConfig("Config_4_Conservative", TreeSpec("forest", 50, 10, 8), TreeSpec("forest", 200, 30, 2)),
    CascadeConfig("Config_5_OptimalBalance", TreeSpec("forest", 75, 15, 5), _boosted(200, 7)),
    CascadeConfig("Config_6_HighAccuracy", TreeSpec("forest", 100, 20, 2), TreeSpec("forest", 300, 30, 2)),
)

# The single configuration of the second testbed, without leaf limits.
SECOND_TESTBED = CascadeConfig("Config_2_Balanced", TreeSpec("forest", 100, 20), _boosted(200, 7))

EDGE_SHARES = (0.05, 0.10, 0.15, 0.20, 0.25)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Add the feature vector from named columns."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def from_array(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    """Add the feature vector from an array column."""
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def attack_probability(column: str = "probability") -> Column:
    """P(attack) of an MLlib probability vector."""
    return vector_to_array(F.col(column))[1]


def ensure_checkpoints(spark: SparkSession) -> None:
    """Long boosting runs cut their lineage in the shared scratch folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{scratch_dir(spark)}/lineage")


class Scorer:
    """A fitted classifier that adds P(attack) as one column."""

    def __init__(self, model):
        self.model = model

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Add `out`; the input needs `features`."""
        scored = self.model.transform(df)
        return scored.select(*df.columns, attack_probability().alias(out))

    def classify(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Add `out` and `prediction`."""
        return self.score(df, out).withColumn("prediction", predicted(F.col(out)))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @property
    def nodes(self) -> int:
        return self.model.totalNumNodes


class MarginScorer(Scorer):
    """A classifier without probabilities: P is the logistic of its margin."""

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        margin = vector_to_array(F.col("rawPrediction"))[1]
        return self.model.transform(df).select(*df.columns, (1.0 / (1.0 + F.exp(-margin))).alias(out))


class ExtraTrees(Scorer):
    """Extra-trees grown level by level (`extra_trees.grow`), scored on Arrow batches."""

    def __init__(self, forest: list[dict]):
        self.forest = forest

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        return extra_trees.score(df, self.forest, out)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        spark.createDataFrame(extra_trees.node_table(self.forest), extra_trees.NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")

    @property
    def nodes(self) -> int:
        return sum(len(tree["feat"]) for tree in self.forest)


class ForestParts(Scorer):
    """A forest grown in parts of its trees: P(attack) is the mean over all trees."""

    def __init__(self, parts: list[Scorer]):
        self.parts = parts

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        trees = [part.model.getNumTrees for part in self.parts]
        scored, names = df, [f"_part_{i}" for i in range(len(trees))]
        for part, name in zip(self.parts, names, strict=True):
            scored = part.score(scored, name)
        total = sum((F.col(name) * n for name, n in zip(names, trees, strict=True)), F.lit(0.0))
        return scored.select(*df.columns, (total / sum(trees)).alias(out))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        spark.createDataFrame([(len(self.parts),)], "parts int").write.mode("overwrite").parquet(f"{path}/parts")
        for i, part in enumerate(self.parts):
            part.save(f"{path}/part-{i}")

    @property
    def nodes(self) -> int:
        return sum(part.nodes for part in self.parts)


class CellForest(ExtraTrees):
    """A forest grown on counted cells (`cell_forest.grow`), scored by its decision table; saved and loaded as its nodes."""

    def __init__(self, forest: list[dict], cuts: list):
        super().__init__(forest)
        self.cuts, self.table = cuts, cell_forest.decision_table(forest, cuts)

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        return cell_forest.score(df, self.cuts, self.table, out)


class SpreadForest(Scorer):
    """A forest whose nodes stay on the executors (`spread_forest.grow`)."""

    def __init__(self, forest: spread_forest.Forest):
        self.forest = forest

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        return spread_forest.score(df, self.forest, out)

    def save(self, path: str) -> None:
        spread_forest.save(self.forest, path)

    @property
    def nodes(self) -> int:
        return self.forest.nodes


def fit_extra_trees(train: DataFrame, spec: TreeSpec, weight: str | None) -> ExtraTrees:
    """The published extra-trees: minimum split size twice the leaf size, as in the configurations."""
    depth = min(spec.depth, MAX_DEPTH)
    return ExtraTrees(extra_trees.grow(train, spec.trees, depth, spec.min_leaf, 2 * spec.min_leaf, spec.seed, weight))


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    """A saved scorer of any kind."""

    def load(at: str):
        meta = json.loads(spark.read.text(f"{at}/metadata").first()["value"])
        return getattr(ml, meta["class"].rsplit(".", 1)[-1]).load(at)

    try:
        model = load(path)
    except AnalysisException:  # extra-trees keep a table of nodes, forests in parts their number, spread forests their subtrees
        try:
            n = spark.read.parquet(f"{path}/parts").first()["parts"]
            return ForestParts([Scorer(load(f"{path}/part-{i}")) for i in range(n)])
        except AnalysisException:
            pass
        try:
            return SpreadForest(spread_forest.load(spark, path))
        except AnalysisException:
            pass
        return ExtraTrees(extra_trees.from_node_table(spark.read.parquet(f"{path}/nodes").collect()))
    return MarginScorer(model) if isinstance(model, ml.LinearSVCModel) else Scorer(model)


ROWS_PER_TASK = 20_000
FOREST_TASKS = 16  # tasks that the parts of one forest keep busy together
MANY_NODES = 1 << 20  # a bagged forest that may have more nodes keeps them on the executors
CELL_ROWS = 160_000  # a bagged forest of more rows is grown on counted cells where these are bounded


def compact(train: DataFrame) -> DataFrame:
    """Training rows in no more partitions than their number is worth: every level of every tree is a job over all of them."""
    return train.coalesce(max(1, -(-train.count() // ROWS_PER_TASK)))


def merge_equal(train: DataFrame, weight: str | None, validation: str | None) -> DataFrame:
    """Equal rows of `(features, label[, weight])` as one row with their summed weight, in `weight`.

    A tree without bagging and without a leaf limit is the same on both, as it sees weighted sums only."""
    keys = ["features", "label", *([validation] if validation else [])]
    total = F.sum(F.col(weight)) if weight else F.count(F.lit(1)).cast("double")
    return stage(train.groupBy(*keys).agg(total.alias(weight or "weight")), "merged-rows")


def most_nodes(spec: TreeSpec, rows: int) -> int:
    """Bound of a forest's nodes: a tree has two for each leaf at most, and `min_leaf` rows a leaf."""
    return spec.trees * min(2 ** (min(spec.depth, MAX_DEPTH) + 1), 2 * rows // max(1, spec.min_leaf))


def fit_trees(train: DataFrame, spec: TreeSpec, weight: str | None = None, validation: str | None = None) -> Scorer:
    """Fit a tree ensemble on `(features, label[, weight])`.

    Boosting stops early when `validation` names a boolean column of held-out rows. Beyond `ROWS_PER_TASK` rows, equal rows are
    merged first where that gives the same trees, and a forest of few tasks is grown in parts of its trees, all at once. Beyond
    `CELL_ROWS` rows, a bagged forest on few features is grown on counted cells. One that may have more than `MANY_NODES` nodes is
    grown and kept on the executors.
    """
    ensure_checkpoints(train.sparkSession)
    weight = weight if spec.weighted else None
    if spec.kind == "extra":
        return fit_extra_trees(compact(train), spec, weight)
    sums_only = spec.min_leaf == 1 and (spec.kind == "boosted" or not spec.bagged)
    if sums_only and train.count() > ROWS_PER_TASK:
        train, weight = merge_equal(train, weight, validation), weight or "weight"
    if spec.kind == "forest" and spec.bagged and spec.trees > 0 and train.count() > CELL_ROWS and cell_forest.bounded(train, spec.bins):
        grown = cell_forest.grow(train, spec.trees, min(spec.depth, MAX_DEPTH), spec.min_leaf, spec.seed, weight, spec.bins)
        if grown:
            return CellForest(*grown)
    if spec.kind == "forest" and spec.bagged and spec.trees > 0 and most_nodes(spec, train.count()) > MANY_NODES:
        spread = spread_forest.grow(train, spec.trees, min(spec.depth, MAX_DEPTH), spec.min_leaf, spec.seed, weight, spec.bins)
        if spread:
            return SpreadForest(spread)
    train = compact(train)
    if spec.kind == "boosted":
        learner = GBTClassifier(
            maxIter=spec.trees, maxDepth=min(spec.depth, MAX_DEPTH), stepSize=spec.step, seed=spec.seed,
            minInstancesPerNode=spec.min_leaf, maxBins=spec.bins,
        )
        if validation:
            learner = learner.setValidationIndicatorCol(validation)
    else:
        learner = RandomForestClassifier(
            numTrees=spec.trees, maxDepth=min(spec.depth, MAX_DEPTH), minInstancesPerNode=spec.min_leaf, seed=spec.seed,
            maxBins=spec.bins, bootstrap=spec.bagged,
            featureSubsetStrategy="auto" if spec.bagged else "all",
        )
    if weight:
        learner = learner.setWeightCol(weight)
    tasks = train.rdd.getNumPartitions()
    parts = min(spec.trees, FOREST_TASKS // tasks) if spec.kind == "forest" and spec.bagged and 1 < tasks else 1
    return _fit_in_parts(learner, train, spec, parts) if parts > 1 else Scorer(learner.fit(train))


def _fit_in_parts(learner: RandomForestClassifier, train: DataFrame, spec: TreeSpec, parts: int) -> ForestParts:
    """The trees of one forest, dealt over `parts` fits with seeds of their own that run at once ("auto" means "sqrt" for several trees)."""

    def fit(i: int) -> Scorer:
        trees = spec.trees // parts + (i < spec.trees % parts)
        return Scorer(learner.copy().setNumTrees(trees).setSeed(spec.seed + i).setFeatureSubsetStrategy("sqrt").fit(train))

    with ThreadPoolExecutor(parts) as pool:
        return ForestParts(list(pool.map(fit, range(parts))))


def fit_logistic(train: DataFrame, weight: str | None = None, max_iter: int = 100) -> Scorer:
    learner = LogisticRegression(maxIter=max_iter)
    return Scorer((learner.setWeightCol(weight) if weight else learner).fit(train))


def fit_linear_svc(train: DataFrame, weight: str | None = None, max_iter: int = 100) -> Scorer:
    """Linear support vectors; MLlib has no RBF kernel."""
    learner = LinearSVC(maxIter=max_iter)
    return MarginScorer((learner.setWeightCol(weight) if weight else learner).fit(train))


def fit_rbf_svc(train: DataFrame, w: list[list[float]], b: list[float], weight: str | None = None, max_iter: int = 100) -> Scorer:
    """RBF support vectors: a linear machine on random Fourier features of `features` (`kernels`)."""
    return FourierScorer(fit_linear_svc(kernels.with_fourier_features(train, w, b), weight, max_iter).model, w, b)


class FourierScorer(MarginScorer):
    """Scores rows through the same Fourier map as the fit; the output keeps the rows' own `features`."""

    def __init__(self, model, w, b):
        super().__init__(model)
        self.w, self.b = w, b

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        mapped = df.withColumn("_own", F.col("features"))
        scored = super().score(kernels.with_fourier_features(mapped, self.w, self.b), out)
        return scored.withColumn("features", F.col("_own")).select(*df.columns, out)


def fit_single_tree(train: DataFrame, depth: int = 5, weight: str | None = None) -> Scorer:
    learner = DecisionTreeClassifier(maxDepth=depth)
    return Scorer((learner.setWeightCol(weight) if weight else learner).fit(train))


def saved_size_mb(spark: SparkSession, scorer: Scorer) -> float:
    """Bytes of the saved model, in MB."""
    path = scratch_path(spark, "model")
    scorer.save(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.sum("length")).first()[0] / (1024 * 1024)


# Fixed value: timed runs that are averaged.
TIMED_RUNS = 3


def scoring_seconds(scorer: Scorer, df: DataFrame, runs: int = TIMED_RUNS) -> float:
    """Mean seconds to score `df`, after one warm-up run."""
    scored = scorer.score(df).select("p")
    scored.write.format("noop").mode("overwrite").save()
    start = time.perf_counter()
    for _ in range(runs):
        scored.write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - start) / runs

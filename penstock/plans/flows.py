"""The two preparation flows, from raw tables to scaled splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penstock.operators import columns as C
from penstock.operators import impute, profile, scale, splits
from penstock.operators.episodes import with_episode
from penstock.sources.staging import stage

# Fixed value: settling rows at the start of the first testbed's training period (6 h at 1 Hz).
SETTLING_ROWS = 21_600


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    features: list[str]
    params: scale.Params
    facts: DataFrame
    denied: list[str]
    empty: list[str]
    low_variance: list[str]


def prepare_water(
    train: DataFrame, test: DataFrame, settle_rows: int = SETTLING_ROWS, row_id: str = "row_id", label: str = "label",
    exclude: Sequence[str] = (),
) -> Prepared:
    """First flow: settling cut, deny-list, empty columns, ordered fills, coercion, variance filter, min-max.

    Both tables need a dense `row_id`; `label` is a 0/1 column of the test table. Cells may be text: they are filled
    as they are and turned into numbers afterwards.
    """
    train = C.drop_leading(train, settle_rows, row_id)
    keep = {row_id, label, *exclude}
    sensors = [c for c in C.drop_non_sensors(train).columns if c not in keep and c in test.columns]
    denied, _ = C.split_deny_list(sensors)
    sensors = [c for c in sensors if c not in denied]
    empty = profile.all_null_columns(train, test, sensors)
    sensors = [c for c in sensors if c not in empty]

    def complete(df: DataFrame, extra: list[str]) -> DataFrame:
        filled = impute.ordered_fill(df.select(row_id, *extra, *[F.col(f"`{c}`") for c in sensors]), sensors, row_id)
        text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
        return filled.select(row_id, *extra, *[C.to_number(F.col(f"`{c}`"), c in text).alias(c) for c in sensors])

    train = stage(complete(train, []), "filled-train")
    test = stage(complete(test, [label]), "filled-test")
    low = profile.low_variance_columns(profile.column_stats(train, sensors))
    features = [c for c in sensors if c not in low]
    params = scale.params_dict(scale.fit_params(train, features))
    scaled_train = scale.apply_params(train.select(row_id, *features), params)
    scaled_test = scale.apply_params(test.select(row_id, label, *features), params)
    facts = _facts(scaled_train, scaled_test, features, label, settle_rows, row_id, len(denied), len(low))
    return Prepared(scaled_train, scaled_test, features, params, facts, denied, empty, low)


def _facts(train, test, features, label, settle_rows, row_id, denied, low) -> DataFrame:
    """One row of facts for the readiness checks."""
    stats = profile.column_stats(train, features)
    side = stats.agg(
        F.max("rows").alias("rows_loaded"), F.min("min").alias("scaled_min"), F.max("max").alias("scaled_max"),
        F.sum("nulls").alias("null_cells"), F.sum(F.col("nans") + F.col("infs")).alias("bad_cells"),
    ).first()
    left = train.filter(F.col(row_id) < settle_rows).agg(F.count(F.lit(1)).alias("leading_rows_left"))
    attacks = test.agg(F.count_if(F.col(label) == 1).alias("n")).first()["n"]
    return left.select(
        "leading_rows_left", *[F.lit(side[c]).alias(c) for c in side.asDict()], F.lit(denied).alias("denied_found"),
        F.lit(low).alias("low_variance_found"), F.lit(attacks).alias("attack_rows"),
    )


def prepare_loop(
    train: DataFrame, test: DataFrame, labels: DataFrame, row_id: str = "row_id", chunk_rows: int = impute.CHUNK_ROWS
) -> Prepared:
    """Second flow: drop names, numeric columns, chunk means, label join, common columns, min-max.

    Training rows are all normal. `labels` holds the row id and the label column under one of its known names.
    """

    def features_of(df: DataFrame) -> DataFrame:
        return C.numeric_only(C.drop_non_features(df))

    labels = C.resolve_label(labels).select(row_id, C.attack_from_nonzero(F.col("label")).alias("label"))
    train, test = C.align(features_of(train), features_of(test))
    names = [c for c in train.columns if c != row_id]
    train = stage(impute.chunk_mean_fill(train, names, row_id, chunk_rows), "chunks-train")
    test = stage(impute.chunk_mean_fill(test, names, row_id, chunk_rows), "chunks-test")
    params = scale.params_dict(scale.fit_params(train, names))
    scaled_train = scale.apply_params(train, params).withColumn("label", F.lit(0))
    scaled_test = C.attach_labels(scale.apply_params(test, params), labels, row_id)
    facts = profile.shape(scaled_train, "train").unionByName(profile.shape(scaled_test, "test"))
    return Prepared(scaled_train, scaled_test, names, params, facts, [], [], [])


def combine_training(
    train_normal: DataFrame, test: DataFrame, step: str, mode: str = "holdout", test_share: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """(training rows, evaluation rows) of the second testbed, whose training period has no attacks.

    Normal training rows are stacked on attack rows of the test period. In "reference" mode all of them are used and the
    evaluation keeps the whole test period, so the scores are optimistic. In "holdout" mode whole attack episodes go to
    one side only. `step` counts consecutive time steps; `test` holds the 0/1 `label`.
    """
    normal = train_normal.withColumn("label", F.lit(0))
    if mode == "reference":
        return normal.unionByName(test.filter("label = 1")), test
    if mode != "holdout":
        raise ValueError(f"unknown mode {mode}")
    runs = splits.episode_holdout(with_episode(test, "label", step), test_share)
    kept = runs.filter("held_out = 0").select(*test.columns)
    held = runs.filter("held_out = 1").select(*test.columns)
    return normal.unionByName(kept), test.filter("label = 0").unionByName(held)

"""Choosing columns and recoding labels.

Names are compared in Python and picked by position, so tables whose columns differ only in case are
handled the same under any `spark.sql.caseSensitive` setting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that are never features.
NON_FEATURES_ANY_CASE = ("time", "date", "timestamp", "row", "index", "attack")
NON_SENSORS_EXACT = ("Date", "Time", "Timestamp", "Row")

# Sensors whose distribution shifts between the splits.
SHIFTED_SENSORS = (
    "1_AIT_001_PV", "1_AIT_003_PV", "1_AIT_004_PV", "1_AIT_005_PV",
    "2_LT_001_PV", "2_PIT_001_PV",
    "2A_AIT_001_PV", "2A_AIT_002_PV", "2A_AIT_003_PV", "2A_AIT_004_PV",
    "2B_AIT_001_PV", "2B_AIT_002_PV", "2B_AIT_003_PV", "2B_AIT_004_PV",
    "3_AIT_005_PV",
)

# Valves that never move.
CONSTANT_VALVES = (
    "2_SV_101_STATUS", "2_SV_201_STATUS", "2_SV_301_STATUS",
    "2_SV_401_STATUS", "2_SV_501_STATUS", "2_SV_601_STATUS",
)

DENY_LIST = SHIFTED_SENSORS + CONSTANT_VALVES

# Label column names in order of preference.
LABEL_NAMES = ("label", "attack", "Attack")


def keep_columns(df: DataFrame, keep: Callable[[T.StructField], bool]) -> DataFrame:
    """Project to the fields for which `keep` is true, by position."""
    fields = df.schema.fields
    by_position = df.toDF(*[f"c{i}" for i in range(len(fields))])
    return by_position.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(fields) if keep(f)])


def drop_non_features(df: DataFrame) -> DataFrame:
    """Drop time, row and label columns, whatever their case."""
    return keep_columns(df, lambda f: f.name.lower() not in NON_FEATURES_ANY_CASE)


def drop_non_sensors(df: DataFrame) -> DataFrame:
    """Drop the four time and row columns when spelled exactly so."""
    return keep_columns(df, lambda f: f.name not in NON_SENSORS_EXACT)


def numeric_only(df: DataFrame) -> DataFrame:
    """Keep numeric columns; each column is typed once for the whole table."""
    return keep_columns(df, lambda f: isinstance(f.dataType, T.NumericType))


def split_deny_list(columns: Iterable[str], deny: Sequence[str] = DENY_LIST) -> tuple[list[str], list[str]]:
    """(found, missing) names of the deny-list, in deny-list order."""
    present = set(columns)
    return [n for n in deny if n in present], [n for n in deny if n not in present]


def drop_denied(df: DataFrame, deny: Sequence[str] = DENY_LIST) -> DataFrame:
    """Drop the deny-list names that are present."""
    unwanted = set(deny)
    return keep_columns(df, lambda f: f.name not in unwanted)


def align(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reduce both tables to their common columns, in train order."""
    common = [c for c in train.columns if c in set(test.columns)]
    return train.select(*[F.col(f"`{c}`") for c in common]), test.select(*[F.col(f"`{c}`") for c in common])


def label_column(columns: Sequence[str], names: Sequence[str] = LABEL_NAMES, fallback: str = "last") -> str:
    """Name of the label column: the first known name, else the last (or first) column."""
    for name in names:
        if name in columns:
            return name
    return columns[-1] if fallback == "last" else columns[0]


def resolve_label(df: DataFrame, names: Sequence[str] = LABEL_NAMES, fallback: str = "last") -> DataFrame:
    """Rename the label column to `label`; other columns are kept."""
    chosen = df.columns.index(label_column(df.columns, names, fallback))
    return df.toDF(*["label" if i == chosen else c for i, c in enumerate(df.columns)])


def split_last_column(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(features, labels): the last column leaves the features and becomes `label`, both keyed."""
    last = df.columns[-1]
    features = keep_columns(df, lambda f: f.name != last)
    return features, df.select(F.col(key), F.col(f"`{last}`").alias("label"))


def attack_from_signed(raw: Column) -> Column:
    """Codes 1 = normal, anything else (NULL too) = attack."""
    return F.when(raw == 1, 0).otherwise(1)


def attack_from_nonzero(raw: Column) -> Column:
    """Codes 0 = normal, anything else (NULL too) = attack."""
    return F.when(raw == 0, 0).otherwise(1)


def contains(text: Column, part: str) -> Column:
    """Substring test, NULL counts as no."""
    return F.coalesce(text.contains(part), F.lit(False))


def to_number(cell: Column, is_text: bool = True) -> Column:
    """Number in a cell; unparsable, missing and NaN cells become 0. Numeric cells skip the parsing."""
    number = cell.try_cast("double") if is_text else cell.cast("double")
    return F.coalesce(F.when(F.isnan(number), None).otherwise(number), F.lit(0.0))


def drop_leading(df: DataFrame, rows: int, row_id: str = "row_id") -> DataFrame:
    """Drop the first `rows` rows of the order; a filter that reaches the scan of a stored row id."""
    return df.filter(F.col(row_id) >= rows)


def attach_labels(features: DataFrame, labels: DataFrame, key: str = "row_id") -> DataFrame:
    """Join a label side table on the row key, refusing tables that do not pair one to one.

    The check counts keys of both sides in one aggregate; only the key column is read for it.
    """
    keys = features.select(key, F.lit(1).alias("a"), F.lit(0).alias("b"))
    keys = keys.unionByName(labels.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    paired = keys.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odd = paired.agg(F.count_if((F.col("a") != 1) | (F.col("b") != 1))).first()[0]
    if odd:
        raise ValueError(f"{odd} row keys do not have exactly one feature row and one label row")
    return features.join(labels, key)


def to_long(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), feature: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long: `(keys…, feature, value)` with one row per cell. The plan does not grow with the columns."""
    cells = df.select(*keys, F.posexplode(F.array(*[F.col(f"`{c}`") for c in cols])).alias("_at", value))
    names = F.array(*[F.lit(c) for c in cols])
    return cells.select(*keys, F.element_at(names, F.col("_at") + 1).alias(feature), value)


def to_wide(
    long: DataFrame, key: Sequence[str], sensors: Sequence[str], sensor: str = "sensor", value: str = "value"
) -> DataFrame:
    """Long to wide: mean reading of each named sensor per key, NULL where there is none."""
    return long.groupBy(*key).agg(*[F.avg(F.when(F.col(sensor) == s, F.col(value))).alias(s) for s in sensors])

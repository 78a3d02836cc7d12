"""Exact, repartition-stable sampling and class weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstock.functions.draws import seeded_hash, seeded_uniform
from penstock.operators.joins import join_null_safe, salted_join, small_side
from penstock.operators.ordering import running_totals, with_row_id
from penstock.sources.staging import stage

_BUCKET_BITS = 16
DRAWS_PER_SALT = 1000
DRAWS_PER_CHUNK = 10_000


def sample_size(n_rows: int, share: float, cap: int | None = None) -> int:
    """Rows to draw: `int(n * share)`, at most `cap`."""
    wanted = int(n_rows * share)
    return wanted if cap is None else min(wanted, cap)


def stratum_quotas(counts: DataFrame, total: int, strata: Sequence[str]) -> DataFrame:
    """Split `total` over strata in proportion to `n`, exactly: `(strata…, n, quota)`.

    Whole parts first, then one more for the largest remainders; ties go to the smaller stratum value.
    The windows run over one row per stratum.
    """
    everything = Window.partitionBy(F.lit(1))
    by_rest = Window.partitionBy(F.lit(1)).orderBy(F.col("_rest").desc(), *strata)
    scaled = counts.withColumn("_fair", F.col("n") * F.lit(total) / F.sum("n").over(everything))
    scaled = scaled.withColumn("_whole", F.floor("_fair").cast("long"))
    scaled = scaled.withColumn("_rest", F.round(F.col("_fair") - F.col("_whole"), 9))
    left_over = F.lit(total) - F.sum("_whole").over(everything)
    return scaled.withColumn("_left", left_over).select(
        *strata, "n", (F.col("_whole") + (F.row_number().over(by_rest) <= F.col("_left")).cast("long")).alias("quota")
    )


def mark_sample(
    df: DataFrame, strata: Sequence[str], key: Sequence[str], quotas_of: Callable[[DataFrame], DataFrame], seed: int = 42,
    flag: str = "taken",
) -> DataFrame:
    """Flag `quota` rows of each stratum, those with the smallest (hash, key). A null stratum value is a stratum of its own.

    `quotas_of` turns `(strata…, n)` into `(strata…, quota)`. A count per (stratum, hash bucket) finds the bucket in
    which the quota falls; only the rows of that bucket, about one in 65,536, are ranked to find the last row taken.
    Every row is then flagged by comparing it with that row, map-side: no row is shuffled, and a class with most of
    the rows is never sorted in one task. `key` must identify rows.
    """
    bucket = F.shiftright("_h", 32 - _BUCKET_BITS)
    hashed = df.withColumn("_h", seeded_hash(seed, *key))
    sizes = stage(hashed.groupBy(*strata, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")), "buckets")
    quotas = quotas_of(sizes.groupBy(*strata).agg(F.sum("_n").alias("n"))).select(*strata, "quota")
    running = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    reached = join_null_safe(sizes.withColumn("_upto", F.sum("_n").over(running)), quotas, list(strata))
    cuts = reached.filter((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
    cuts = cuts.select(*strata, "_bucket", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    at_cut = join_null_safe(hashed.withColumn("_bucket", bucket), small_side(cuts), [*strata, "_bucket"])
    first = Window.partitionBy(*strata).orderBy("_h", *key)
    last = at_cut.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") == F.col("_need"))
    last = small_side(last.select(*strata, F.struct("_h", *key).alias("_last")))
    taken = F.coalesce(F.struct("_h", *key) <= F.col("_last"), F.lit(False))
    return join_null_safe(hashed, last, list(strata), "left").select(*[F.col(c) for c in df.columns], taken.alias(flag))


def stratified_sample(
    df: DataFrame, strata: Sequence[str], share: float, key: Sequence[str], seed: int = 42, cap: int | None = None
) -> DataFrame:
    """Sample without replacement with the exact share of every stratum."""
    kept, _ = stratified_split(df, strata, share, key, seed, cap)
    return kept


def stratified_split(
    df: DataFrame, strata: Sequence[str], share: float, key: Sequence[str], seed: int = 42, cap: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(sample, rest) with the exact share of every stratum in the sample."""

    def quotas(counts: DataFrame) -> DataFrame:
        total = counts.agg(F.sum("n")).first()[0] or 0
        return stratum_quotas(counts, sample_size(total, share, cap), strata)

    marked = mark_sample(df, strata, key, quotas, seed)
    return marked.filter("taken").drop("taken"), marked.filter("not taken").drop("taken")


def rank_in_class(df: DataFrame, label: str, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(`df` with the dense 0-based `_rank` inside its class, staged `(label, n, _start)` with the place of the class in order of labels).

    The counts are joined, in broadcast form where classes are few.
    """
    totals = running_totals(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), [label], ["n"])
    counts = stage(totals.select(label, "n", (F.col("cum_n") - F.col("n")).alias("_start")), "class-counts")
    starts = small_side(counts.select(F.col(label).alias("_class"), "_start"))
    ranked = with_row_id(df, [label, *key], "_position").join(starts, F.col(label).eqNullSafe(F.col("_class")), "left")
    return ranked.select(*df.columns, (F.col("_position") - F.col("_start")).alias("_rank")), counts


def draw_rows(ranked: DataFrame, draws: DataFrame, label: str, counts: DataFrame) -> DataFrame:
    """Join draws `(draw, label, _rank)` to the rows they hit; `counts` is `(label, n, drawn)`.

    A small class can be drawn very often; its rows are copied over salts, one per about 1000 expected hits.
    """
    copies = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("drawn") / (F.col("n") * DRAWS_PER_SALT)).cast("long"))
    salts = small_side(counts.select(F.col(label).alias("_class"), copies.alias("_salts")))

    def salted(rows: DataFrame) -> DataFrame:
        return rows.join(salts, F.col(label).eqNullSafe(F.col("_class"))).drop("_class")

    return salted_join(salted(draws), salted(ranked), [label, "_rank"], "_salts", "draw")


def bootstrap(df: DataFrame, label: str, share: float, key: Sequence[str], seed: int = 42, cap: int | None = None) -> DataFrame:
    """Stratified sample with replacement; adds the draw number `draw`.

    Draw j of a class with n rows takes the row ranked `floor(u(seed, class, j) * n)`.
    """
    ranked, counts = rank_in_class(df, label, key)
    total = sample_size(counts.agg(F.sum("n")).first()[0] or 0, share, cap)
    quotas = stage(running_totals(stratum_quotas(counts, total, [label]), [label], ["quota"]), "quotas")
    # A class that is drawn often is cut into chunks before its draws are listed.
    last = F.col("quota") - 1
    chunks = quotas.filter("quota > 0").select(
        label, "n", last.alias("_last"), (F.col("cum_quota") - F.col("quota")).alias("_start"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / DRAWS_PER_CHUNK))).alias("_chunk"),
    )
    spread = chunks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), label, "_chunk")
    first = F.col("_chunk") * DRAWS_PER_CHUNK
    listed = spread.select(label, "n", "_start", F.explode(F.sequence(first, F.least(first + DRAWS_PER_CHUNK - 1, F.col("_last")))).alias("_j"))
    draws = listed.select(
        (F.col("_start") + F.col("_j")).alias("draw"), label,
        F.floor(seeded_uniform(seed, F.col(label).cast("string"), F.col("_j")) * F.col("n")).cast("long").alias("_rank"),
    )
    return draw_rows(ranked, draws, label, quotas.withColumnRenamed("quota", "drawn")).select("draw", *df.columns)


def weighted_draws(df: DataFrame, label: str, n_draws: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Sample with replacement, each row weighted by the inverse frequency of its class.

    That is: every class is equally likely, then every row of the class. Adds the draw number `draw`.
    """
    ranked, counts = rank_in_class(df, label, key)
    classes = counts.count()
    numbered = small_side(with_row_id(counts.select(label, "n"), [label], "_pick"))
    pick = F.floor(seeded_uniform(f"{seed}:class", F.col("draw")) * classes).cast("long")
    draws = df.sparkSession.range(n_draws).withColumnRenamed("id", "draw").withColumn("_pick", pick).join(numbered, "_pick")
    draws = draws.select("draw", label, F.floor(seeded_uniform(f"{seed}:row", F.col("draw")) * F.col("n")).cast("long").alias("_rank"))
    expected = counts.withColumn("drawn", F.lit(n_draws // max(1, classes)))
    return draw_rows(ranked, draws, label, expected).select("draw", *df.columns)


def balanced_weights(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """Add the weight `n / (classes * n_class)`; the counts are joined, in broadcast form where classes are few."""
    counts = stage(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), "class-counts")
    total, classes = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    known = counts.select(F.col(label).alias("_class"), (F.lit(float(total or 0)) / (F.lit(classes) * F.col("n"))).alias("_w"))
    joined = df.join(small_side(known), df[label].eqNullSafe(F.col("_class")), "left")
    return joined.select(*df.columns, F.col("_w").alias(weight)) if weight not in df.columns else joined.drop(weight).withColumnRenamed("_w", weight).drop("_class")


# Fixed value: weight of the attack class in the weighted baseline.
POSITIVE_WEIGHT = 20.0


def positive_weight(df: DataFrame, label: str = "label", weight: str = "weight", value: float = POSITIVE_WEIGHT) -> DataFrame:
    """Add a weight of `value` for attack rows and 1 for the others."""
    return df.withColumn(weight, F.when(F.col(label) == 1, F.lit(value)).otherwise(F.lit(1.0)))


# Fixed value: 1 s to 5 s.
DOWNSAMPLE = 5


def downsample(df: DataFrame, factor: int = DOWNSAMPLE, row_id: str = "row_id") -> DataFrame:
    """Keep every `factor`-th row of the order."""
    return df.filter(F.pmod(F.col(row_id), F.lit(factor)) == 0)


def downsample_mean(df: DataFrame, cols: Sequence[str], at: str, factor: int = DOWNSAMPLE) -> DataFrame:
    """Mean of each column over `factor` consecutive time steps: `(step, cols…)`."""
    step: Column = F.floor(F.col(at) / factor).cast("long")
    return df.groupBy(step.alias("step")).agg(*[F.avg(c).alias(c) for c in cols])

"""Mixing sources to target weights by hash-threshold histograms.

Targets: a share of all tokens is dealt to the sources by weight; none gets more than `most` times its own tokens, and what is
left over is dealt again by weight until nobody is above. Sorted by tokens per weight, that is one running sum over sources.

Taking: every document is taken floor(target / source) times, and once more if its hash lies below the source's threshold. The
threshold comes from a histogram of tokens by (source, 4,096 hash buckets): all buckets below the budget are in, and the bucket
on the boundary alone is split again, 4,096-fold, until it holds one hash. The boundary document is in if that brings the sum nearer to the
budget. Documents are then filtered by comparing hashes; nothing is sorted. Thresholds are nested: a larger budget keeps all that a
smaller one takes. A hash depends on id and text, so reruns and any partitioning agree.

Results: null text has size 0; a document of size 0 is taken if its hash is below the threshold; a null source is a source of its own,
last in order; rows that repeat id and text share a hash, so they are taken together; a null id counts as an id. `mix_plan` has
one row per input row; `mix_documents` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penstock.llm.common import table
from penstock.operators.joins import small_side
from penstock.sources.staging import stage

SEED = "mix-1"
BITS, LEVELS = 12, 4  # 48 bits of hash
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0


def word_count(text: Column) -> Column:
    """Runs of bytes other than ASCII space and control white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def hash48() -> Column:
    text = F.md5(F.coalesce("text", F.lit("")))
    seeded = F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text)
    return F.conv(F.substring(F.md5(seeded), 1, 12), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """`(source, source_size, target)` from `(source, source_size)`, one row per source: windows over sources, not over documents."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    weighed = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = most * F.col("source_size")
    order = Window.orderBy(cap / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    budget = F.sum("source_size").over(everyone) * F.lit(share)
    rest = F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (budget - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / rest  # per weight, if all before are full and none after
    ranked = weighed.select("source", "source_size", "w", cap.alias("cap"), level.alias("level"), (F.col("level") * F.col("w") <= F.col("cap")).alias("fits"))
    final = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level").alias("l")))).over(everyone)["l"]
    return ranked.select("source", "source_size", F.when(final.isNull(), F.col("cap")).otherwise(F.least("cap", final * F.col("w"))).alias("target"))


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """`(source, copies, below)`: documents of a source are taken `copies` times, and once more if their hash is less than `below`.

    `sized` has (source, size, h); `wanted` has (source, source_size, target). Each level aggregates the rows of one bucket per source.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    at = small_side(wanted.select(F.col("source").alias("s"), copies.alias("copies"), (F.col("target") - copies * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix")))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = sized.join(at, sized["source"].eqNullSafe(at["s"]) & (F.shiftright("h", shift + BITS) == at["prefix"]))
        bucket = inside.groupBy("s", "copies", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        run = stage(bucket.withColumn("upto", F.sum("n").over(upto)), "buckets")  # at most 4,096 rows a source
        crossing = run.filter("upto > left").groupBy("s", "copies", "left").agg(F.min(F.struct("bucket", "n", "upto")).alias("b"))
        found = crossing.select("s", "copies", (F.col("left") - (F.col("b.upto") - F.col("b.n"))).alias("left"), F.col("b.bucket").alias("prefix"), F.col("b.n").alias("n"))
        if level == LEVELS:
            take = F.when(2 * F.col("left") >= F.col("n"), F.col("prefix") + 1).otherwise(F.col("prefix"))
            found = found.select("s", take.alias("below"))
        at = small_side(found)
    plain = wanted.select(F.col("source").alias("s2"), copies.alias("copies"))
    everything = F.lit(1 << (BITS * LEVELS)).cast("long")  # no bucket crosses the budget: all are in
    return plain.join(at, plain["s2"].eqNullSafe(at["s"]), "left").select(F.col("s2").alias("source"), "copies", F.coalesce("below", everything).alias("below"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), hash48().alias("h"), *more)


def mix_table(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """`(s, source_size, target, copies, below)`, one row per source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = small_side(targets(sources, weights, share, most))
    below = thresholds(sized, wanted).withColumnRenamed("source", "s")
    return small_side(wanted.join(below, wanted["source"].eqNullSafe(below["s"])).drop("source"))


def _taken(rows: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """Rows of `_sized` with their source's plan and with `times`; where the plan is small, rows are not shuffled."""
    extra = F.when(F.col("target") >= most * F.col("source_size"), F.lit(most)).otherwise(F.col("copies") + (F.col("h") < F.col("below")).cast("int"))
    return rows.join(plan, rows["source"].eqNullSafe(plan["s"])).withColumn("times", extra.cast("long"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """`(doc_id, size, source_size, target, times)` for each row of `docs`."""
    sized = stage(_sized(docs), "sized")
    return _taken(sized, mix_table(sized, weights, share, most), most).select("doc_id", "size", "source_size", "target", "times")


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows of `docs`, each as often as the mix takes it."""
    plan = mix_table(stage(_sized(docs), "sized"), weights, share, most)
    rows = _sized(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = _taken(rows, plan, most).filter("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))

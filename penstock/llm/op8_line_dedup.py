"""Line dedup by winnowing over line hashes; built-in functions only.

A line is a stretch without line breaks together with the breaks after it; lines are compared without the white space around
them. Each window of `run` lines elects its smallest line hash, the leftmost of ties. These window minima are the document's
fingerprints: two equal runs of `run` lines always elect the same one, so a fingerprint at a single place rules out all windows that
elected it. Where a fingerprint has several places, the match is extended both ways over the windows that elected it: windows that are
equal line by line meet by content, all but the first in the corpus are repeats, and neighbouring repeats join to maximal runs. The
lines of those runs are deleted.

Fewer than `run` lines can hold a whole passage, so with `words` each stretch of 1 to `run` - 1 lines that has so many words or more is a
fingerprint of its own beside the windows: it meets by content, all but the first are repeats, and they join to runs with the windows. Every
repeated stretch of whole lines that has `run` lines or `words` words is then deleted. A word is a stretch without ASCII white space, so
a script that puts no spaces between words counts a line as few words. The query `op8_line_dedup` leaves `words` out, as its SQL
is windows of three lines and no more; `op8_passage_dedup` is the whole rule.

"First" is the smallest id, then the earlier line. Both groupings are minima, so they combine before the shuffle and a line that a
third of all documents share moves once per task; the joins back only add one row per key and split under adaptive execution.

Results: a null or empty text has no lines; a document with fewer than `run` lines keeps all but long passages; null ids come first; rows that share an id
are ordered by a fingerprint of the text; rows that repeat id and text count as one document. Other columns are ignored. Windows and
passages are compared by 96 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penstock.llm.common import doc_id, keyed_documents, table
from penstock.sources.staging import stage

RUN, WORDS = 3, 50
WORD = "[^\\x20\\x09-\\x0D]+"


def lines_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[^\\n]+\\n*|\\n+"), F.lit(0))


def windows(texts: DataFrame, run: int, words: int | None) -> DataFrame:
    """`(_doc, _alt, pos, size, whole, more, least, at)`: each window of `size` lines with its content hash, its fingerprint and that one's place.

    Windows of `run` lines have their minimum as fingerprint, shorter ones of at least `words` words their content hash.
    """
    hashes = F.transform("l", lambda x: F.xxhash64(F.btrim(x, F.lit(" \t\r\n")))).alias("h")
    counts = [] if words is None else [F.transform("l", lambda x: F.regexp_count(x, F.lit(WORD))).alias("w")]
    bare = texts.select("_doc", "_alt", lines_of(F.col("text")).alias("l")).select("_doc", "_alt", hashes, *counts)
    enough = bare.filter(F.size("h") >= (run if words is None else 1))
    n = F.size("h")

    def window(i: Column, size: int) -> Column:
        part = F.slice("h", i + 1, size)
        whole = F.xxhash64(part)
        least = F.array_min(part) if size == run else whole
        place = (i + F.array_position(part, least) - 1).cast("int") if size == run else i
        return F.struct(
            i.alias("pos"), F.lit(size).alias("size"), whole.alias("whole"), F.hash(part).alias("more"), least.alias("least"), place.alias("at")
        )

    def windows_of(size: int) -> Column:
        fits = lambda i: i + size <= n
        if size < run:
            fits = lambda i: (i + size <= n) & (F.aggregate(F.slice("w", i + 1, size), F.lit(0), lambda total, w: total + w) >= words)
        return F.transform(F.filter(F.sequence(F.lit(0), n - 1), fits), lambda i: window(i, size))

    every = F.concat(*[windows_of(size) for size in range(run if words is None else 1, run + 1)])
    return enough.select("_doc", "_alt", F.explode(every).alias("w")).select("_doc", "_alt", "w.*")


def repeated_runs(texts: DataFrame, run: int, words: int | None) -> DataFrame:
    """`(_doc, _alt, runs)`: sorted maximal runs `(start, end)` of lines, end exclusive, that repeat earlier ones."""
    found = stage(windows(texts, run, words), "windows")
    prints = found.groupBy("least").agg(F.min(F.struct("_doc", "_alt", "at")).alias("lo"), F.max(F.struct("_doc", "_alt", "at")).alias("hi"))
    shared = prints.filter("lo <> hi").select("least")
    matched = found.join(shared, "least", "left_semi")
    place = F.struct("_doc", "_alt", "pos")
    content = ["size", "whole", "more"]
    first = matched.groupBy(*content).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = matched.join(first, content).filter(place > F.col("first")).groupBy("_doc", "_alt", "pos").agg(F.max("size").alias("size"))
    by_doc = Window.partitionBy("_doc", "_alt").orderBy("pos")
    reached = F.max(F.col("pos") + F.col("size")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("pos") > reached, F.lit(True)).cast("int")
    numbered = later.withColumn("fresh", fresh).withColumn("k", F.sum("fresh").over(by_doc))
    runs = numbered.groupBy("_doc", "_alt", "k").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("size")).alias("end"))
    return runs.groupBy("_doc", "_alt").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def dedup_lines(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """`(doc_id, n_lines, n_removed, runs, kept)` for each row: the deleted runs of lines and the text without them."""
    texts = keyed_documents(docs)
    done = texts.join(repeated_runs(texts, run, words), ["_doc", "_alt"], "left").withColumn("lines", lines_of(F.col("text")))
    n, runs = F.size("lines"), F.coalesce("runs", F.array().cast("array<struct<start:int,end:int>>"))
    gap = lambda k: F.slice(
        "lines",
        F.when(k == 0, F.lit(0)).otherwise(F.get("runs", k - 1)["end"]) + 1,
        F.when(k == F.size("runs"), n).otherwise(F.get("runs", k)["start"]) - F.when(k == 0, F.lit(0)).otherwise(F.get("runs", k - 1)["end"]),
    )
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("runs")), gap))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda total, r: total + (r["end"] - r["start"]))
    return done.withColumn("runs", runs).select(
        doc_id(), n.cast("long").alias("n_lines"), removed.alias("n_removed"), "runs", F.array_join(kept, "").alias("kept")
    )


def _digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_lines", "n_removed", F.size("runs").cast("long").alias("n_runs"), F.sha2("kept", 256).alias("kept_sha256"))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(dedup_lines(table(spark, sf_dir, "documents"), words=None))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(dedup_lines(table(spark, sf_dir, "documents")))

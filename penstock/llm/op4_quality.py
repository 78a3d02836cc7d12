"""Quality classifier: a sparse rule ensemble over text statistics, compiled to Spark column expressions.

1. `statistics` are column expressions over the whole text. Labels, language, source and id are never among them.
2. A random forest of shallow trees is fitted on labelled rows. Every path from a root to an inner node or leaf is a conjunctive
   rule over statistics.
3. A logistic regression with lasso penalty picks and weighs the rules.
4. The rules left are compiled into one expression: a sum of weights over conditions under the logistic function. Scoring is a
   projection, without Python and without a shuffle.

The fit uses `FIT_ROWS` labelled rows at most, chosen by a hash of the id; that bound is a parameter. All documents are scored.

Results: a null text counts as empty and is scored like any other; without usable labels, or with labels of one kind only, the score of every
row is the share of label 1 (0.5 without labels); a null id is never held out and never labelled; rows that repeat are scored alike; when a
document has several labels each is a row of the fit. Other columns are ignored, or kept by `keep_good`.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm.common import table
from penstock.sources.staging import stage

FIT_ROWS = 20_000
TREES, DEPTH, PENALTY, SEED = 24, 4, 0.002, 7
FOLDS, HELD_OUT = 3, 1


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; all are 0 for an empty one."""
    per = lambda n, d: F.coalesce(n / F.nullif(d, F.lit(0)), F.lit(0.0)).cast("double")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    chars = F.char_length(text)
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words)
    lines = F.filter(F.split(text, "\\n+"), lambda x: x != "")
    return {
        "words": F.log1p(n.cast("double")),
        "word_length": per(chars, n),
        "distinct_words": per(F.log1p(F.size(F.array_distinct(words)).cast("double")), F.log1p(n.cast("double"))),  # hardly depends on length
        "distinct_lines": per(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": per(n, F.size(lines)),
        "upper": per(count("\\p{Lu}"), chars),
        "digits": per(count("[0-9]"), chars),
        "marks": per(count("[#$%&*|~^<>{}=_\\\\]"), chars),
        "shouts": per(count("[!?]"), n),
        "stops": per(count("[.]"), n),
        "commas": per(count("[,;:]"), n),
        "letters": per(count("\\p{L}"), chars),
        "same_again": per(count("(?<![^\\x20\\x09-\\x0D])([^\\x20\\x09-\\x0D]{1,40})(?=[\\x20\\x09-\\x0D]\\1(?![^\\x20\\x09-\\x0D]))"), n),
    }


NAMES = [
    "words", "word_length", "distinct_words", "distinct_lines", "line_words", "upper", "digits", "marks", "shouts", "stops", "commas", "letters", "same_again",
]


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(f"_s_{self.name}") > self.cut if self.above else F.col(f"_s_{self.name}") <= self.cut


Rule = tuple[Condition, ...]


def paths(tree_text: str, names: list[str] = NAMES) -> list[Rule]:
    """Conjunctive rules of a fitted tree, one for each path from the root to any node."""
    found, way = [], []
    for line in tree_text.splitlines():
        got = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+|NaN|Infinity)\)", line)
        if got:
            depth = len(got[1])
            way = [c for c in way if c[0] < depth]
            way.append((depth, Condition(names[int(got[3])], got[4] == ">", float(got[5]))))
            found.append(tuple(c for _, c in way))
    return found


def tighten(rule: Rule) -> Rule:
    """The strictest condition of each kind."""
    best: dict[tuple[str, bool], float] = {}
    for c in rule:
        key = (c.name, c.above)
        best[key] = c.cut if key not in best else (max if c.above else min)(best[key], c.cut)
    return tuple(Condition(name, above, cut) for (name, above), cut in sorted(best.items()))


@dataclass(frozen=True)
class RuleModel:
    base: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        """Probability of label 1 from the columns of `with_statistics`."""
        total = F.lit(self.base)
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(rule: Rule) -> Column:
    out = rule[0].column()
    for c in rule[1:]:
        out = out & c.column()
    return out


def with_statistics(docs: DataFrame, *keep: Column) -> DataFrame:
    """`keep` and one column for each statistic (no struct: the optimiser would compute its fields again for every rule)."""
    found = statistics(F.coalesce("text", F.lit("")))
    return docs.select(*keep, *[found[n].alias(f"_s_{n}") for n in NAMES])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> RuleModel:
    """Learn from rows of `labels` (doc_id, quality) outside the held-out fold."""
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("double").alias("label"))
    n, ones = marked.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0.0, float(n)):
        share = min(max((ones / n) if n else 0.5, 1e-6), 1 - 1e-6)
        return RuleModel(math.log(share / (1 - share)))
    if n > fit_rows:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / n))
    texts = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull()).join(marked, "doc_id")
    rows = stage(with_statistics(texts, F.col("doc_id"), F.col("label"), F.xxhash64("text").alias("t")), "labelled")
    one = rows.repartition(1).sortWithinPartitions("doc_id", "t", "label")  # bounded by fit_rows; one order, so that reruns agree
    one = stage(one.select("*", array_to_vector(F.array(*[f"_s_{c}" for c in NAMES])).alias("features")), "fit")
    n, ones = one.agg(F.count(F.lit(1)), F.sum("label")).first()  # labels may have no documents here
    if not n or ones in (0.0, float(n)):
        share = min(max((ones / n) if n else 0.5, 1e-6), 1 - 1e-6)
        return RuleModel(math.log(share / (1 - share)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=SEED).fit(one)
    rules = sorted({tighten(r) for tree in forest.trees for r in paths(tree.toDebugString)}, key=repr)
    if not rules:
        share = ones / n
        return RuleModel(math.log(share / (1 - share)))
    held = one.select("label", array_to_vector(F.array(*[_holds(r).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=200).fit(stage(held, "rules"))
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w]
    return RuleModel(float(lasso.intercept), tuple(weights))


def score_documents(docs: DataFrame, model: RuleModel, *keep: Column) -> DataFrame:
    """`keep` and `score` for each row of `docs`."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = with_statistics(docs, *[c.alias(n) for c, n in zip(keep, names, strict=True)])
    return rows.select(*names, model.score().alias("score"))


def keep_good(docs: DataFrame, model: RuleModel, least: float = 0.5) -> DataFrame:
    """Rows of `docs` with a score of `least` or more; all columns stay, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return score_documents(docs, model, row).filter(F.col("score") >= least).select("k0.*")


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_rules(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model, F.col("doc_id"), held_out())
    return scored.select(F.col("k0").alias("doc_id"), F.col("k1").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

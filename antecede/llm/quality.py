"""Operator 4: a quality classifier by a sparse rule ensemble.

Statistics of whole texts are Spark expressions. A forest of shallow trees is fitted on them; every
path from a root to a node below it is a conjunctive rule over one to a few statistics; a logistic
regression with the lasso penalty over the rules, taken as 0/1 columns, keeps few of them; and the
score is one Spark expression again, so scoring is a projection without any shuffle or Python.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.common import text_of, written

#: Labelled rows that a model is fitted on, at most: those with the lowest hashes of their doc_id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH = 30, 3
LASSO = 0.0005

#: What a rule asks: (statistic, "<=" or ">", bound), all of them.
Rule = tuple[tuple[str, str, float], ...]


class Model(NamedTuple):
    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self) -> Column:
        """From the statistics as columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule) -> Column:
    out = None
    for s, op, bound in rule:
        test = F.col(s) <= bound if op == "<=" else F.col(s) > bound
        out = test if out is None else out & test
    return out


def measured(df: DataFrame, *keep: str) -> DataFrame:
    """`keep` and the statistics of the column `text`. Words and lines are split once, in a projection of their own."""
    split = df.select(*keep, "text", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x != "").alias("lines"))
    return split.select(*keep, *(c.alias(n) for n, c in statistics(*map(F.col, ("text", "words", "lines"))).items()))


def statistics(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Of a whole text; each is 0 for an empty one."""
    n_words, n_chars, n_lines = F.size(words), F.char_length(text), F.size(lines)
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")
    gone = lambda c: n_chars - F.char_length(F.replace(text, F.lit(c), F.lit("")))
    same = F.size(F.filter(F.zip_with(F.slice(words, 2, F.greatest(n_words, F.lit(1))), words, lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False))))
    return {
        "log_words": F.ln(n_words + 1.0),
        "word_length": per(n_chars - n_words, n_words),
        "shouted": per(F.regexp_count(text, F.lit(r"\p{Lu}{2,}")), n_words),
        "odd_runs": per(F.regexp_count(text, F.lit(r"[^\p{L}\p{M}\p{N}\s.,;:'\"()!?-]+")), n_words),
        "digit_runs": per(F.regexp_count(text, F.lit("[0-9]+")), n_words),
        "exclaimed": per(gone("!"), n_words),
        "stops": per(gone("."), n_words),
        "commas": per(gone(","), n_words),
        "distinct_words": per(F.size(F.array_distinct(words)), n_words),
        "repeated_words": per(same, n_words),
        "distinct_lines": per(F.size(F.array_distinct(lines)), n_lines),
        "words_a_line": per(n_words, n_lines),
    }


NAMES = (
    "log_words", "word_length", "shouted", "odd_runs", "digit_runs", "exclaimed", "stops", "commas", "distinct_words", "repeated_words", "distinct_lines", "words_a_line",
)


def remainder() -> Column:
    """crc32 of doc_id as text, modulo 5; 0 is held out. A null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """label and the statistics of at most `most` labelled rows that are not held out.

    A doc_id with several labels takes the highest. Only doc_ids are looked at to choose the rows;
    the chosen ones, which are bounded, are broadcast, and only their texts are measured.
    """
    known = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label")).where(remainder() != 0)
    here = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = written(here.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labelled")
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    return written(measured(texts, "label"), "training")


def tree_paths(node, names: tuple[str, ...], so_far: Rule = ()) -> list[Rule]:
    """The path to each node below `node`, which is one of a fitted tree."""
    if "Leaf" in node.getClass().getSimpleName():
        return []
    split, out = node.split(), []
    for op, child in (("<=", node.leftChild()), (">", node.rightChild())):
        path = (*so_far, (names[split.featureIndex()], op, float(split.threshold())))
        out += [path, *tree_paths(child, names, path)]
    return out


def simple(rule: Rule) -> Rule:
    """Of several bounds on one side of a statistic the tightest, in a fixed order."""
    bounds: dict[tuple[str, str], float] = {}
    for s, op, b in rule:
        old = bounds.get((s, op), b)
        bounds[s, op] = min(old, b) if op == "<=" else max(old, b)
    return tuple((s, op, b) for (s, op), b in sorted(bounds.items()))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of `labels.quality`. Without labels of both kinds it gives every text the same score: their share, or 0.5."""
    rows = training_rows(docs, labels, sample_rows)
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        share = (ones + 0.5) / (n + 1)
        return Model([], -math.log(1 / share - 1))
    vectors = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(rows).select("label", "features").coalesce(4).cache()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=7, maxBins=64).fit(vectors)
    vectors.unpersist()
    rules = sorted({simple(p) for t in forest.trees for p in tree_paths(t._java_obj.rootNode(), NAMES)})
    # Of two rules that are each other's opposite one is enough.
    rules = [r for r in rules if len(r) > 1 or r[0][1] == "<="]
    flags = rows.select("label", F.array(*(holds(r).cast("double") for r in rules)).alias("flags"))
    flagged = flags.select("label", array_to_vector("flags").alias("features")).coalesce(4).cache()
    lasso = LogisticRegression(regParam=LASSO, elasticNetParam=1.0, standardization=False, maxIter=60).fit(flagged)
    flagged.unpersist()
    return Model([(r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if w], float(lasso.intercept))


def with_scores(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` in a struct `doc`, and `score`."""
    texts = docs.select(F.struct(*keep).alias("doc"), text_of().alias("text"))
    return measured(texts, "doc").select("doc", model.score().alias("score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of `docs`.

    A null text counts as empty; an empty one is scored from statistics that are all 0. Repeated
    rows are scored each, and equal texts get equal scores. Nothing but the text enters a score.
    """
    scored = with_scores(docs, fit(docs, labels), ["doc_id"])
    return scored.select("doc.doc_id", "score").select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, that the classifier predicts to be good."""
    scored = with_scores(docs, fit(docs, labels), docs.columns)
    # A filter moves below projections and would measure a text anew for each use of a statistic; it can't pass what explode() makes.
    return scored.select("doc", F.explode(F.array("score")).alias("score")).where(F.col("score") >= threshold).select("doc.*")

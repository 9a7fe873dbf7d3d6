"""Quality classifier: a sparse ensemble of rules, compiled to Spark columns."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .language_id import held_out


def statistics(text: str | Column) -> dict[str, Column]:
    """Statistics of a text as columns; a null text counts as empty."""
    text = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda left: (F.length(text) - F.length(left)) / n
    words = F.split(text, r"[\x20\x09-\x0D]+")
    lines = F.split(text, "\n")
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return {
        "length": F.log1p(F.length(text)),
        "letters": letters / n,
        "capitals": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))) / F.greatest(letters, F.lit(1)),
        "digits": share(F.translate(text, "0123456789", "")),
        "shouts": share(F.translate(text, "!?", "")),
        "stops": share(F.translate(text, ".,;:", "")),
        "symbols": share(F.translate(text, "|#*=_~<>{}[]\\/@$%^&+", "")),
        "word_length": n / F.size(words),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_length": F.log1p(n / F.size(lines)),
    }


Condition = tuple[str, str, float]


@dataclass(frozen=True)
class RuleModel:
    """score = sigmoid(bias + the weights of the rules that hold); a rule is a conjunction of (statistic, <= or >, bound)."""

    bias: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...]

    def column(self) -> Column:
        """The score over columns that bear the statistics' names."""
        total = reduce(Column.__add__, (F.when(_holds(rule), F.lit(weight)).otherwise(F.lit(0.0)) for weight, rule in self.rules), F.lit(self.bias))
        return 1 / (1 + F.exp(-total))


def _holds(rule: tuple[Condition, ...]) -> Column:
    return reduce(Column.__and__, (F.col(k) <= bound if op == "<=" else F.col(k) > bound for k, op, bound in rule))


def _paths(debug: str, names: list[str]) -> set[tuple[Condition, ...]]:
    """The conjunction that leads to each node of a printed forest, one bound per statistic and side."""
    found: set[tuple[Condition, ...]] = set()
    path: list[Condition] = []
    for line in debug.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)", line):
            depth = len(m[1])
            path = [c for c in path if c[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
            tight: dict[tuple[str, str], float] = {}
            for _, (k, op, bound) in path:
                tight[k, op] = min(bound, tight.get((k, op), bound)) if op == "<=" else max(bound, tight.get((k, op), bound))
            found.add(tuple(sorted((k, op, bound) for (k, op), bound in tight.items())))
        elif line.lstrip().startswith("Tree "):
            path = []
    return found


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, trees: int = 20, depth: int = 3, lasso: float = 0.002, seed: int = 10) -> RuleModel:
    """Fits the rules on labelled documents: at most about ``max_rows`` of them, by the hash of their ids.

    Paths of a shallow forest over the statistics become rules, and a lasso logistic regression over
    the rules keeps few of them. Labels other than 0 and 1 and null ones are left out; an id with
    several labels counts with each. Without labels the score is 0.5, with one label alone a
    constant near it.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).filter("label in (0, 1) and id is not null")
    n = known.count()
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(10)), F.lit(1 << 40)) / (1 << 40)
    known = cut(known.filter(draw * n < max_rows), "labels")
    stats = statistics("text")
    names = list(stats)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("label", *(c.cast("double").alias(k) for k, c in stats.items()))
    rows = cut(rows, "labelled")
    ones, n = rows.agg(F.sum("label"), F.count("*")).first()
    if not n or ones in (0, n):
        share = ((ones or 0) + 1) / (n + 2)
        return RuleModel(math.log(share / (1 - share)), ())
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, minInstancesPerNode=5, featureSubsetStrategy="onethird")
    printed = forest.fit(rows.select("label", array_to_vector(F.array(*names)).alias("features"))).toDebugString
    rules = sorted(_paths(printed, names))
    if not rules:
        return RuleModel(math.log(ones / (n - ones)), ())
    marked = rows.select("label", array_to_vector(F.array(*(_holds(r).cast("double") for r in rules))).alias("features"))
    fitted = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=50, standardization=False).fit(marked)
    kept = tuple((float(w), r) for w, r in zip(fitted.coefficients.toArray().tolist(), rules) if abs(w) > 1e-6)
    return RuleModel(float(fitted.intercept), kept)


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for each row, from the text alone, by column expressions.

    Null counts as the empty text; rows that repeat are scored each, and equal texts alike. Other
    columns are not read.
    """
    stats = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", *(c.cast("double").alias(k) for k, c in statistics("text").items()))
    return stats.select("doc_id", model.column().alias("score"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out(5, 0)))
    return score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

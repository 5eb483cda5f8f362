"""Text quality as a sparse ensemble of rules: tree paths, lasso logistic weights, Spark columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from kittally.llm.common import id_text, remainder, values
from kittally.session import cut

STATISTICS = [
    "n_bytes", "n_words", "n_lines", "word_len", "longest_word", "upper", "digit", "mark", "bang", "bar", "symbol", "beyond_ascii",
    "blank", "distinct_words", "distinct_lines", "repeated_next", "most_common", "ends_marked", "odd_end",
]
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5


def statistics(text: str | None) -> list[float]:
    """The numbers in STATISTICS for one whole text; a null text counts as empty and gives zeros."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [float(len(raw))] + [0.0] * (len(STATISTICS) - 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, counts, 6)
    lines = [x for x in raw.split(b"\n") if x]
    n, size, solid = len(words), len(raw), sum(map(len, words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    share = lambda *c: float(sum(counts[ord(x)] for x in c)) / solid
    ends = [w[-1] for w in words]
    return [
        float(size), float(n), float(len(lines)), solid / n, float(max(map(len, words))),
        kinds[1] / solid, kinds[3] / solid, kinds[5] / solid, share("!"), share("|"), share(*"#$%&*@^~+=<>\\/_"), kinds[4] / solid,
        (size - solid) / size, len(seen) / n, len(set(lines)) / len(lines), sum(map(bytes.__eq__, words, words[1:])) / n,
        max(seen.values()) / n, sum(_CLASS[e] == 5 for e in ends) / n, sum(_CLASS[e] == 5 and e not in b".,;:?'\")" for e in ends) / n,
    ]


def describe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, one double per statistic) for each row, over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t) for (t,) in values(batch, "text")], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T.copy())], ["doc_id", *STATISTICS])

    return id_text(docs, key, text).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True, order=True)
class Condition:
    statistic: str
    above: bool
    bound: float

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c > self.bound if self.above else c <= self.bound


Rule = tuple[Condition, ...]


def rule_column(rule: Rule) -> Column:
    """1.0 where all conditions hold, else 0.0."""
    holds = F.lit(True)
    for c in rule:
        holds = holds & c.column()
    return F.when(holds, 1.0).otherwise(0.0)


def tree_rules(forest) -> list[Rule]:
    """The conditions on the way to every node of every tree, each set once, tightened per side."""
    found: set[Rule] = set()

    def walk(node, path: dict) -> None:
        if path:
            found.add(tuple(sorted(Condition(s, above, bound) for (s, above), bound in path.items())))
        if node.numDescendants() == 0:
            return
        name, bound = STATISTICS[node.split().featureIndex()], float(node.split().threshold())
        walk(node.leftChild(), path | {(name, False): min(bound, path.get((name, False), bound))})
        walk(node.rightChild(), path | {(name, True): max(bound, path.get((name, True), bound))})

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), {})
    return sorted(found)


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 as one column expression over the statistics."""
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z = z + rule_column(rule) * w
        return 1.0 / (1.0 + F.exp(-z))


def fit(labelled: DataFrame, trees: int = 20, depth: int = 3, penalty: float = 0.001, rounds: int = 40, seed: int = 7) -> RuleModel:
    """Rules and weights from rows of statistics with an int ``label``; null labels and NaN are left out.

    The forest and the lasso are fitted on all rows given. With one label only, the model is its constant
    share; with none, one half.
    """
    rows = cut(labelled.where("label in (0, 1)").select("label", *STATISTICS).na.drop())
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if positive in (0, n):
        share = (positive + 1) / (n + 2)
        return RuleModel([], [], float(np.log(share / (1 - share))))
    gathered = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(gathered)
    rules = tree_rules(forest)
    if not rules:
        return RuleModel([], [], float(np.log(positive / (n - positive))))
    held = rows.select(F.col("label").cast("double").alias("label"), *(rule_column(r).alias(f"r{i}") for i, r in enumerate(rules)))
    held = cut(VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(held).select("label", "features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=rounds, standardization=False).fit(held)
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients) if w]
    return RuleModel([r for r, _ in kept], [w for _, w in kept], float(lasso.intercept))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                   folds: int = 5, held_fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Learns from labelled rows outside the held-out fold only; an input of a score is nothing but the text.
    Null and empty texts have zero statistics and are scored like others. Null labels are ignored; a
    document labelled more than once counts as often.
    """
    known = cut(describe(docs, key, text))
    marked = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    model = fit(known.where(remainder("doc_id", folds) != held_fold).join(marked, "doc_id"))
    score = model.score()
    return known.select(
        "doc_id", (remainder("doc_id", folds) == held_fold).alias("held_out"), score.alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))

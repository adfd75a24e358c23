"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

Shallow trees propose conjunctive rules; a lasso logistic regression weighs them; what keeps a weight becomes SQL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, without
from .textstats import CLASSES, SYMBOLS, char_classes, duplicate_lines, repeated_words, word_hashes

STATS = (
    "log_words", "word_length", "upper_share", "digit_share", "space_share", "stop_share", "mark_share", "wide_share", "symbol_share",
    "caps_words", "repeat_share", "dup_line_share", "distinct_share", "run_share", "line_words", "end_share",
)
#: Labelled rows that the fit may see at most.
FIT_ROWS = 20_000


def _stats(text: str) -> list[float]:
    b = text.encode()
    words = b.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    h, c = word_hashes(words), char_classes(b) / len(b)
    lines, dup = duplicate_lines(b)
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    share = dict(zip(CLASSES, c.tolist(), strict=True))
    return [
        float(np.log1p(n)), (len(b) - n) / n, *[share[k] for k in ("upper", "digit", "space", "stop", "mark", "wide")], symbols / len(b),
        sum(map(bytes.isupper, words)) / n, repeated_words(h) / n, dup / max(lines, 1), len(np.unique(h)) / n, float(np.mean(h[1:] == h[:-1])) if n > 1 else 0.0,
        n / max(lines, 1), sum(w.endswith((b".", b"!", b"?")) for w in words) / n,
    ]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([_stats(t or "") for t in batch.column("text").to_pylist()], float).reshape(-1, len(STATS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x[:, j]) for j in range(len(STATS))]], ["doc_id", *STATS])


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text; null and empty texts have zeros."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_batches, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is_greater, threshold), with its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, greater, t in self.terms:
            out &= F.col(name) > t if greater else F.col(name) <= t
        return out


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 as a column expression over the statistics."""
        z = F.lit(self.intercept)
        for r in self.rules:
            z = z + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _paths(text: str) -> set[tuple]:
    """All paths from the root of the trees in a forest's printed form, as conjunctions; nested terms on one side of a statistic are merged."""
    found: set[tuple] = set()
    at: list[tuple[str, bool, float]] = []
    for line in text.splitlines():
        s = line.strip()
        depth = len(line) - len(line.lstrip())
        if s.startswith("Tree"):
            base, at = depth, []
        elif s.startswith(("If", "Else")):
            name, op, t = s[s.index("(feature ") + 9 : s.rindex(")")].split()
            level = depth - base - 2
            at = at[:level] + [(STATS[int(name)], op == ">", float(t))]
            best: dict[tuple[str, bool], float] = {}
            for n, g, v in at:
                best[n, g] = v if (n, g) not in best else (max if g else min)(best[n, g], v)
            found.add(tuple(sorted((n, g, v) for (n, g), v in best.items())))
    return found


def fit_rules(stats: DataFrame, label: str, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 11) -> RuleModel:
    """A rule model from a table of statistics with a 0/1 label. With one class only, or no rows, the score is that class's share (or 0.5)."""
    n, ones = stats.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0))).first()
    if n == 0 or ones in (0, n):
        p = (ones + 1) / (n + 2)
        return RuleModel((), float(np.log(p / (1 - p))))
    rare = F.when(F.col(label) == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones)))
    x = VectorAssembler(inputCols=list(STATS), outputCol="x").transform(stats.withColumn("w", rare))
    forest = RandomForestClassifier(featuresCol="x", labelCol=label, weightCol="w", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7).fit(x)
    rules = [Rule(t) for t in sorted(_paths(forest.toDebugString))]
    if not rules:
        return RuleModel((), float(np.log(ones / (n - ones))))
    hits = stats.select(F.col(label), *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    z = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="z").transform(hits)
    lasso = LogisticRegression(featuresCol="z", labelCol=label, elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(z)
    kept = tuple(Rule(r.terms, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w)
    return RuleModel(kept, float(lasso.intercept))


def held_out(id_column: str = "doc_id", modulus: int = 3, rest: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The fit sees at most fit_rows labelled rows that aren't held out (those with the least hash of their id), and only statistics of the text. Rows of `labels` with a null
    id or label are ignored; of several labels for an id the least counts, and of several texts the one with the least statistics. Null and empty texts have a score too. Null ids are never held out. An empty table
    gives an empty result.
    """
    stats = stage(text_stats(docs), "quality-stats")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # one row an id, in an order that doesn't depend on how the table is stored
    sample = stats.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min(F.struct(*STATS)).alias("s")).select("doc_id", "y", "s.*")
    sample = stage(sample.repartition(4, "doc_id").sortWithinPartitions("doc_id"), "quality-sample")
    model = fit_rules(sample, "y")
    out = stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """docs without those that the classifier rejects."""
    return without(docs, quality_scores(docs, labels, label).filter("predicted = 0").select("doc_id"))

"""Heads over an encoder's vectors as a Spark ML estimator and its saved model, and their calibration.

A head scores the nodes (attr, value, leaf; leaf '' is the class's own) of many attributes at once, all fitted in the same passes over the vectors. Targets may be fractional, and a node that isn't named for a row
takes no part in that row's loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The temperatures that are tried. Fixed values.
TEMPERATURES = (0.5, 1, 2, 3, 5, 8, 12, 20, 30)
PAIR = "array<struct<node:int,pos:double,neg:double>>"


def training_table(vectors: DataFrame, targets: DataFrame) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """(rows, nodes): vec_id, embedding, and `targets`: an array of (node, pos, neg), one entry for each node that is known on the row.

    targets: vec_id, attr, value, leaf, y in 0 .. 1, and optionally weight (of the positive part) and known. A pair enters with weight `weight * y` as positive and `1 - y` as negative; pairs that aren't known don't enter.
    """
    has = set(targets.columns)
    t = targets.filter("known") if "known" in has else targets
    t = t.filter(F.col("y").isNotNull())
    nodes = [(r["attr"], r["value"], r["leaf"]) for r in t.select("attr", "value", "leaf").distinct().orderBy("attr", "value", "leaf").collect()]  # a row per node
    spark = vectors.sparkSession
    index = spark.createDataFrame([(i, *n) for i, n in enumerate(nodes)], "node int, attr string, value string, leaf string")
    pair = F.struct("node", ((F.col("weight") if "weight" in has else F.lit(1.0)) * F.col("y")).cast("double").alias("pos"), (1 - F.col("y")).cast("double").alias("neg"))
    t = t.join(F.broadcast(index), ["attr", "value", "leaf"]).groupBy("vec_id").agg(F.array_sort(F.collect_list(pair)).alias("targets"))  # at most one entry per node and row
    return vectors.select("vec_id", "embedding").join(t.hint("merge"), "vec_id"), nodes


#: The attribute of the heads that tell whether an attribute is present at all.
KIND = "kind"


def identity_pairs(targets: DataFrame, at: float = 0.5) -> DataFrame:
    """vec_id, attr, value, leaf, y, weight: the pairs that identity heads learn from. targets: vec_id, attr, value, leaf, y; what isn't listed is 0.

    A class is trained where its attribute is present (a class of it at `at`), a leaf where its class is. Where a label stopped at the class (the class is present, and no leaf of another name), leaves of other names are unknown
    and left out. The node (kind, attr, '') is trained on every row with any target, by whether the attribute is present. Positives weigh the root of absent / present rows, clipped to 1 .. 30; kinds weigh 1.
    """
    t = targets.groupBy("vec_id", "attr", "value", "leaf").agg(F.max("y").alias("y"))
    nodes = t.select("attr", "value", "leaf").distinct()
    items = t.select("vec_id").distinct()
    cls = t.filter((F.col("leaf") == "") & (F.col("y") >= at)).select("vec_id", "attr", "value")
    present = cls.select("vec_id", "attr").distinct()
    stopped = cls.join(t.filter((F.col("leaf") != "") & (F.lower("leaf") != F.lower("value")) & (F.col("y") >= at)).select("vec_id", "attr", "value").hint("merge"), ["vec_id", "attr", "value"], "left_anti").withColumn("_stopped", F.lit(True))
    classes = present.join(nodes.filter("leaf = ''").hint("shuffle_hash"), "attr")
    leaves = cls.join(nodes.filter("leaf != ''").hint("shuffle_hash"), ["attr", "value"]).join(stopped.hint("merge"), ["vec_id", "attr", "value"], "left")
    leaves = leaves.filter(F.col("_stopped").isNull() | (F.lower("leaf") == F.lower("value"))).drop("_stopped")
    pairs = classes.select("vec_id", "attr", "value", "leaf").unionByName(leaves.select("vec_id", "attr", "value", "leaf"))
    pairs = pairs.join(t.hint("merge"), ["vec_id", "attr", "value", "leaf"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    count = t.groupBy("attr", "value", "leaf").agg(F.count_if(F.col("y") >= at).alias("_n")).join(F.broadcast(items.agg(F.count("*").alias("_all"))), F.lit(True))
    weight = F.sqrt(F.greatest(F.lit(1.0), F.least(F.lit(30.0), (F.col("_all") - F.col("_n")) / F.greatest("_n", F.lit(1)))))
    pairs = pairs.join(count.select("attr", "value", "leaf", weight.alias("weight")).hint("merge"), ["attr", "value", "leaf"])
    attrs = nodes.select("attr").distinct().agg(F.sort_array(F.collect_set("attr")).alias("_attrs"))  # one row
    grid = items.join(F.broadcast(attrs), F.lit(True)).select("vec_id", F.explode("_attrs").alias("value"))
    kinds = grid.join(present.select("vec_id", F.col("attr").alias("value"), F.lit(1.0).alias("y")).hint("merge"), ["vec_id", "value"], "left")
    kinds = kinds.select("vec_id", F.lit(KIND).alias("attr"), "value", F.lit("").alias("leaf"), F.coalesce("y", F.lit(0.0)).alias("y"), F.lit(1.0).alias("weight"))
    return pairs.select("vec_id", "attr", "value", "leaf", "y", "weight").unionByName(kinds)


def joint_scores(scores: DataFrame, *keys: str) -> DataFrame:
    """keys, attr, value, leaf, p from node scores with their kinds: p(attribute) p(class), and for a leaf p(leaf) more. An attribute without a kind counts as present."""
    p = scores.withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))
    kind = p.filter(F.col("attr") == KIND).select(*keys, F.col("value").alias("attr"), F.col("p").alias("_k"))
    own = W.partitionBy(*keys, "attr", "value")
    n = p.filter(F.col("attr") != KIND).join(kind.hint("merge"), [*keys, "attr"], "left")
    cls = F.coalesce(F.max(F.when(F.col("leaf") == "", F.col("p"))).over(own), F.lit(1.0))
    return n.withColumn("_c", cls * F.coalesce("_k", F.lit(1.0))).select(*keys, "attr", "value", "leaf", F.when(F.col("leaf") == "", F.col("_c")).otherwise(F.col("_c") * F.col("p")).alias("p"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _pairs(column: pa.Array) -> tuple[np.ndarray, ...]:
    """row, node, pos, neg of all targets of a batch."""
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return row, *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("node", "pos", "neg"))


def _moments(features: str, targets: str, n: int, family: str):
    """Sums over a task: of each component and its square (node -1), and of each node's weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, np.zeros(n)
        for batch in filter(len, batches):
            x = _matrix(batch.column(features))
            part = np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
            total = part if total is None else total + part
            _, node, pos, neg = _pairs(batch.column(targets))
            weight += np.bincount(node, pos + neg if family == "sigmoid" else pos, minlength=n)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([-1, -2], pa.int32()), pa.array([total.tolist(), weight.tolist()], pa.list_(pa.float64()))], ["node", "v"])

    return run


def _gradients(features: str, targets: str, family: str, w: np.ndarray, mean: np.ndarray, std: np.ndarray, second: bool = False):
    """Sums over a task: of the loss and its gradient at w (nodes x components and a constant), with second also its second derivatives (family sigmoid), a row per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad = np.zeros(len(w)), np.zeros(w.shape)
        bend = np.zeros((*w.shape, w.shape[1])) if second else None
        for batch in filter(len, batches):
            x = (_matrix(batch.column(features)) - mean) / std
            x = np.hstack([x, np.ones((len(x), 1))])
            z = x @ w.T
            row, node, pos, neg = _pairs(batch.column(targets))
            e = np.zeros(z.shape)
            if family == "sigmoid":
                s = z[row, node]
                loss += np.bincount(node, pos * np.logaddexp(0, -s) + neg * np.logaddexp(0, s), minlength=len(w))
                p = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
                np.add.at(e, (row, node), (pos + neg) * p - pos)
                for i in np.unique(node) if second else []:
                    own = x[row[node == i]]
                    bend[i] += own.T @ (own * ((pos + neg) * p * (1 - p))[node == i, None])
            else:
                lp = z - z.max(1, keepdims=True)
                lp -= np.log(np.exp(lp).sum(1, keepdims=True))
                loss += np.bincount(node, -pos * lp[row, node], minlength=len(w))
                e = np.exp(lp) * np.bincount(row, pos, minlength=len(x))[:, None]
                np.add.at(e, (row, node), -pos)
            grad += e.T @ x
        out = np.hstack([loss[:, None], grad, *([bend.reshape(len(w), -1)] if second else [])])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(w)), pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], ["node", "v"])

    return run


def _summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"node": [key[0]], "v": [np.sum(np.stack(rows["v"].to_list()), 0).tolist()]})


def _totals(df: DataFrame, few: bool = False) -> dict[int, np.ndarray]:
    """The sum of v for each node, from one row of each task; few: the tasks' rows are known to be small together, and are summed on the driver."""
    out: dict[int, np.ndarray] = {}
    if not few:
        return {r["node"]: np.array(r["v"]) for r in df.groupBy("node").applyInPandas(_summed, "node int, v array<double>").collect()}  # a row per node
    for r in df.toArrow().to_pylist():
        out[r["node"]] = out.get(r["node"], 0.0) + np.array(r["v"])
    return out


#: Bytes of partial sums that the driver takes from all tasks together, and values of second derivatives in a task.
DRIVER_BYTES, BENDS = 32 << 20, 1 << 21


def newton(f: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], w: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """Newton steps on independent convex functions at once, one per row of w, each with its own step halving: f gives all values, gradients and second derivatives."""
    value, g, bend = f(w)
    for _ in range(steps):
        if np.linalg.norm(g) <= tol * max(1.0, np.linalg.norm(w)):
            break
        d = np.linalg.solve(bend + 1e-10 * np.eye(w.shape[1]), g[:, :, None])[:, :, 0]
        step = np.ones(len(w))
        while True:
            after, h, bend2 = f(w - step[:, None] * d)
            worse = after > value - 1e-4 * step * (g * d).sum(1) + 1e-12
            if not worse.any() or step[worse].max() < 1e-6:
                break
            step[worse] /= 2
        w, value, g, bend = w - step[:, None] * d, after, h, bend2
    return w


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, tol: float, memory: int = 10) -> np.ndarray:
    """L-BFGS with step halving: f gives the value and its gradient."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.linalg.norm(g) <= tol * max(1.0, np.linalg.norm(x)):
            break
        d, kept = -g, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d = d - a * y
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else min(1.0, 1.0 / np.linalg.norm(g)))
        for (s, y), a in zip(past, reversed(kept), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        step = 1.0
        while True:
            after, h = f(x + step * d)
            if after <= value + 1e-4 * step * (g @ d):
                break
            step /= 2
            if step < 1e-12:
                return x
        s, y = step * d, h - g
        x, value, g = x + s, after, h
        if s @ y > 1e-12 * (y @ y):
            past = [*past[-memory + 1 :], (s, y)]
    return x


class _Columns(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vectors, arrays of one length", TypeConverters.toString)
    targetsCol = Param(Params._dummy(), "targetsCol", "known nodes with weights, as training_table makes them", TypeConverters.toString)
    logitsCol = Param(Params._dummy(), "logitsCol", "a logit for each node, in the model's order", TypeConverters.toString)
    family = Param(Params._dummy(), "family", "sigmoid (each node for itself) or softmax (one distribution over all)", TypeConverters.toString)
    regParam = Param(Params._dummy(), "regParam", "penalty on squared weights of standardised components", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "steps at most", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "relative size of the gradient at which the fit ends", TypeConverters.toFloat)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(featuresCol="embedding", targetsCol="targets", logitsCol="logits", family="sigmoid", regParam=1e-3, maxIter=100, tol=1e-5)


class NodeHeads(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fits one linear head per node, all in the same passes: minimises the mean weighted cross-entropy of each node (family sigmoid) or of each row (softmax), plus regParam / 2 of the squared weights.

    Each pass sums the gradient inside the tasks; one row per task and node is shuffled and one per node reaches the driver (where all tasks' rows are small together, they do). Sigmoids of few components are fitted by
    Newton steps, others by L-BFGS; the minimum is the same. A node without any weight keeps weights of zero.
    """

    def __init__(self, nodes: list[tuple[str, str, str]] | None = None, **params) -> None:
        super().__init__()
        self.nodes = nodes or []
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> NodeHeadsModel:
        f, t, family, reg = (self.getOrDefault(c) for c in ("featuresCol", "targetsCol", "family", "regParam"))
        if family not in ("sigmoid", "softmax"):
            raise ValueError(f"no family {family}")
        df = dataset.select(F.col(f).cast("array<double>").alias(f), F.col(t).cast(PAIR).alias(t)).filter(F.col(f).isNotNull() & F.col(t).isNotNull() & (F.size(f) > 0)).persist()
        n = len(self.nodes)
        try:
            sums = _totals(df.mapInArrow(_moments(f, t, n, family), "node int, v array<double>"))
            if -1 not in sums or not n:
                raise ValueError("no row with a target to fit")
            rows, d = sums[-1][0], (len(sums[-1]) - 1) // 2
            mean = sums[-1][1 : d + 1] / rows
            std = np.sqrt(np.maximum(sums[-1][d + 1 :] / rows - mean**2, 0))
            std[std == 0] = 1.0
            weight = np.maximum(sums[-2], 1e-300) if family == "sigmoid" else np.full(n, max(sums[-2].sum(), 1e-300))

            second = family == "sigmoid" and n * (d + 1) ** 2 <= BENDS
            few = df.rdd.getNumPartitions() * n * (1 + (d + 1) * (d + 2 if second else 1)) * 8 <= DRIVER_BYTES

            def at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                got = _totals(df.mapInArrow(_gradients(f, t, family, w, mean, std, second), "node int, v array<double>"), few)
                v = np.stack([got[i] for i in range(n)]) / weight[:, None]
                pull = np.hstack([w[:, :-1], np.zeros((n, 1))])
                return v[:, 0] + reg / 2 * (pull**2).sum(1), v[:, 1 : d + 2] + reg * pull, v[:, d + 2 :].reshape(n, d + 1, -1) + reg * np.diag([1.0] * d + [0.0]) if second else v

            def joint(flat: np.ndarray) -> tuple[float, np.ndarray]:
                value, g, _ = at(flat.reshape(n, d + 1))
                return float(value.sum()), g.ravel()

            start, steps, tol = np.zeros((n, d + 1)), self.getOrDefault("maxIter"), self.getOrDefault("tol")
            w = newton(at, start, steps, tol) if second else minimise(joint, start.ravel(), steps, tol).reshape(n, d + 1)
        finally:
            df.unpersist()
        raw = w[:, :-1] / std
        return self._copyValues(NodeHeadsModel(self.nodes, raw, w[:, -1] - raw @ mean))


class NodeHeadsModel(Model, _Columns, MLReadable, MLWritable):
    """Linear heads: transform adds `logits`, an array of a logit for each of `nodes`; null where a row has no vector. calibration: rows by attribute, as calibrate() makes them (None: not calibrated)."""

    def __init__(self, nodes: list[tuple[str, str, str]], coefficients: np.ndarray, intercepts: np.ndarray, calibration: list[dict] | None = None) -> None:
        super().__init__()
        self.nodes, self.coefficients, self.intercepts, self.calibration = [tuple(x) for x in nodes], coefficients, intercepts, calibration

    def _transform(self, dataset: DataFrame) -> DataFrame:
        w, b = self.coefficients, self.intercepts

        @F.pandas_udf("array<double>")
        def logits(x: pd.Series) -> pd.Series:
            known = [v is not None for v in x]
            z = iter(np.stack([v for v in x if v is not None]).astype(np.float64) @ w.T + b if any(known) else [])
            return pd.Series([next(z) if k else None for k in known], index=x.index, dtype=object)

        return dataset.withColumn(self.getOrDefault("logitsCol"), logits(F.col(self.getOrDefault("featuresCol")).cast("array<double>")))

    def setLogits(self, name: str) -> NodeHeadsModel:
        return self._set(logitsCol=name)

    def node_scores(self, dataset: DataFrame, *keys: str) -> DataFrame:
        """keys, attr, value, leaf, logit: a row per row and node."""
        names = F.array(*[F.struct(F.lit(a).alias("attr"), F.lit(v).alias("value"), F.lit(l).alias("leaf")) for a, v, l in self.nodes])  # noqa: E741
        z = self.transform(dataset).filter(F.col(self.getOrDefault("logitsCol")).isNotNull())
        z = z.select(*keys, F.inline(F.arrays_zip(names.alias("n"), F.col(self.getOrDefault("logitsCol")).alias("logit"))))
        return z.select(*keys, "n.attr", "n.value", "n.leaf", "logit")

    def class_scores(self, dataset: DataFrame, *keys: str) -> DataFrame:
        """keys, attr, value, logit: the log-sum-exp over a class's own node and its leaves."""
        return class_logits(self.node_scores(dataset, *keys), *keys)

    def write(self) -> MLWriter:
        return _HeadsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _HeadsReader(cls)


#: The calibration of one attribute; null temperature: of several choices.
CALIBRATION = "attr string, rows long, balanced double, skill double, temperature double, floor double, leaf_threshold double"


class _HeadsWriter(MLWriter):
    def __init__(self, model: NodeHeadsModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, SparkSession.active()
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={"calibrated": m.calibration is not None})
        rows = [(i, *n, [float(x) for x in w], float(b)) for i, (n, w, b) in enumerate(zip(m.nodes, m.coefficients, m.intercepts, strict=True))]
        spark.createDataFrame(rows, "node int, attr string, value string, leaf string, coefficients array<double>, intercept double").coalesce(1).write.parquet(f"{path}/nodes")
        cal = [tuple(r[f.split()[0]] for f in CALIBRATION.split(", ")) for r in m.calibration or []]
        spark.createDataFrame(cal, CALIBRATION).coalesce(1).write.parquet(f"{path}/calibration")


class _HeadsReader(MLReader):
    def __init__(self, kind: type) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> NodeHeadsModel:
        spark = SparkSession.active()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        rows = spark.read.parquet(f"{path}/nodes").orderBy("node").collect()
        cal = [r.asDict() for r in spark.read.parquet(f"{path}/calibration").collect()] if meta["calibrated"] else None
        m = self.kind([(r["attr"], r["value"], r["leaf"]) for r in rows], np.array([r["coefficients"] for r in rows]), np.array([r["intercept"] for r in rows]), cal)
        m._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(m, meta)
        return m


def class_logits(scores: DataFrame, *keys: str) -> DataFrame:
    """keys, attr, value, logit from node scores: the log-sum-exp inside each class."""
    w = W.partitionBy(*keys, "attr", "value")
    return scores.withColumn("_m", F.max("logit").over(w)).groupBy(*keys, "attr", "value").agg((F.max("_m") + F.log(F.sum(F.exp(F.col("logit") - F.col("_m"))))).alias("logit"))


def within_class(scores: DataFrame, *unit: str, row: str = "row_id") -> DataFrame:
    """unit, attr, value, leaf, p: the distribution over the nodes of a class, pooled over the unit's rows by their mean log-probability and normalised again."""
    w = W.partitionBy(*unit, row, "attr", "value")
    s = scores.withColumn("_z", F.col("logit") - F.max("logit").over(w))
    s = s.withColumn("_lp", F.col("_z") - F.log(F.sum(F.exp("_z")).over(w)))
    s = s.groupBy(*unit, "attr", "value", "leaf").agg(F.avg("_lp").alias("_lp"))
    u = W.partitionBy(*unit, "attr", "value")
    e = F.exp(F.col("_lp") - F.max("_lp").over(u))
    return s.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(u)).select(*unit, "attr", "value", "leaf", "p")


def calibrate(
    scores: DataFrame, gold: DataFrame, multi: tuple[str, ...] = (), always: tuple[str, ...] = (), weak_skill: float = 0.3, weak_floor: float = 0.5, grid: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), least: int = 10,
    precision: float = 0.75,
) -> DataFrame:
    """CALIBRATION, a row per attribute, from node scores of held-out rows (vec_id, attr, value, leaf, logit) and their gold classes and leaves (vec_id, attr, value, leaf; '' or null: no leaf).

    balanced: mean recall of the class with the greatest logit over the classes that occur; skill: its gain over chance as a share of the possible gain; temperature: of TEMPERATURES the one with the
    least negative log-likelihood of the gold class, ties to the lower (null for `multi`); floor: weak_floor where the skill is under weak_skill, unless in `always`; leaf_threshold: the least of the grid at which at least
    `least` leaves are served inside their gold class with the precision, 1.01 if none.
    """
    c = class_logits(scores, "vec_id")
    # a label outside the head's classes tells nothing
    g = gold.select("vec_id", "attr", F.col("value").alias("gold")).distinct().join(c.select("attr", F.col("value").alias("gold")).distinct().hint("merge"), ["attr", "gold"], "left_semi")
    best = c.groupBy("vec_id", "attr").agg(F.min_by("value", F.struct(-F.col("logit"), "value")).alias("pred"), F.collect_list("logit").alias("z"), F.map_from_entries(F.collect_list(F.struct("value", "logit"))).alias("of"))
    j = g.join(best.hint("merge"), ["vec_id", "attr"])
    recall = j.groupBy("attr", "gold").agg(F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("r")).groupBy("attr").agg(F.avg("r").alias("balanced"), F.count("*").alias("k"))
    first = j.groupBy("vec_id", "attr").agg(F.min("gold").alias("gold"), F.first("z").alias("z"), F.first("of").alias("of"))
    top = F.array_max("z")
    nll = lambda t: F.avg(F.log(F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp((x - top) / t))) + (top - F.element_at("of", F.col("gold"))) / t)
    ts = first.groupBy("attr").agg(F.count("*").alias("rows"), F.array(*[F.struct(nll(float(t)).alias("l"), F.lit(float(t)).alias("t")) for t in TEMPERATURES]).alias("ts"))
    temperature = F.array_min("ts")["t"]
    out = recall.join(ts.hint("merge"), "attr").withColumn("skill", (F.col("balanced") - 1 / F.col("k")) / F.greatest(1 - 1 / F.col("k"), F.lit(1e-6)))
    # leaves inside the gold class
    inside = within_class(scores.join(gold.select("vec_id", "attr", "value").distinct().hint("merge"), ["vec_id", "attr", "value"], "left_semi").withColumn("row_id", F.lit(0)), "vec_id")
    lead = inside.groupBy("vec_id", "attr", "value").agg(F.min_by(F.struct("leaf", "p"), F.struct(-F.col("p"), "leaf")).alias("b"))
    named = gold.filter(F.coalesce("leaf", F.lit("")) != "").select("vec_id", "attr", "value", F.col("leaf").alias("gold_leaf")).distinct()
    named = named.groupBy("vec_id", "attr", "value").agg(F.collect_set("gold_leaf").alias("gold_leaf")).join(lead.hint("merge"), ["vec_id", "attr", "value"]).filter("b.leaf != ''")
    right = F.array_contains("gold_leaf", F.col("b.leaf"))
    cols = [x for i, t in enumerate(grid) for x in (F.count_if(F.col("b.p") >= t).alias(f"s{i}"), F.count_if((F.col("b.p") >= t) & right).alias(f"r{i}"))]
    served = F.lit(1.01)
    for i, t in sorted(enumerate(grid), key=lambda x: -x[1]):
        served = F.when((F.col(f"s{i}") >= least) & (F.col(f"r{i}") >= precision * F.col(f"s{i}")), float(t)).otherwise(served)
    leaves = named.groupBy("attr").agg(*cols).select("attr", served.alias("leaf_threshold"))
    out = out.join(leaves.hint("merge"), "attr", "left")
    floor = F.when((F.col("skill") < weak_skill) & ~F.col("attr").isin(list(always)), weak_floor).otherwise(0.0)
    single = F.when(~F.col("attr").isin(list(multi)), temperature)
    return out.select("attr", "rows", "balanced", "skill", single.alias("temperature"), floor.alias("floor"), F.coalesce("leaf_threshold", F.lit(1.01)).alias("leaf_threshold"))


def calibrated(model: NodeHeadsModel, calibration: DataFrame) -> NodeHeadsModel:
    """The model with its calibration, a row per attribute, which is saved with it."""
    return model._copyValues(NodeHeadsModel(model.nodes, model.coefficients, model.intercepts, [r.asDict() for r in calibration.collect()]))

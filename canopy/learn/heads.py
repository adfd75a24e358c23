"""Learned columns as Spark ML jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..workers import cut
from .models import NodeHeads, NodeHeadsModel, identity_pairs, joint_scores, training_table


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds `weight`, so that classes weigh the same."""
    c = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = c.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    return df.join(F.broadcast(c.join(F.broadcast(total), F.lit(True))), label).withColumn("weight", F.col("_t") / (F.col("_k") * F.col("_n"))).drop("_n", "_t", "_k")


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype("<i4"), pa.array(np.concatenate(rows) if rows else [], kind))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the distinct characters and pairs of characters of each lower-cased text, in order, and how often each occurs."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part, gs, ns = batch.slice(lo, 500), [], []
            for text in part.column("text").to_pylist():
                a = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype("<i8")
                g, n = np.unique(np.concatenate([a, (a[:-1] + 1 << 21) | a[1:]]), return_counts=True)
                gs.append(g)
                ns.append(n.astype("<i4"))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], _lists(gs, pa.int64()), _lists(ns, pa.int32())], ["id", "lang", "label", "held", "g", "n"])


def _weighed(known: np.ndarray):
    """Places of a text's grams in the vocabulary, in order, and their log frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, n = (pa.chunked_array([batch.column(c)]).combine_chunks() for c in ("g", "n"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(g.offsets.to_numpy()))
            g, n = g.flatten().to_numpy(), n.flatten().to_numpy()
            i = np.searchsorted(known, g)
            hit = i < len(known)
            hit[hit] = known[i[hit]] == g[hit]
            ends = np.cumsum([0, *np.bincount(row[hit], minlength=batch.num_rows)]).astype("<i4")
            own = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (i[hit].astype("<i4"), 1 + np.log(n[hit]))]
            kind = [pa.array(np.full(batch.num_rows, v), t) for v, t in ((0, pa.int8()), (len(known), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.StructArray.from_arrays([*kind, *own], ["type", "size", "indices", "values"])], ["id", "lang", "label", "held", "tf"])

    return run


def language_head(texts: DataFrame, held_out: Column, features: int = 40_000, min_docs: int = 2) -> tuple[DataFrame, float]:
    """(id, lang, pred, held) and the held-out accuracy: character 1- and 2-grams, log term frequency, IDF, logistic regression. texts: id, text, lang."""
    names = [r[0] for r in texts.select("lang").filter("lang is not null").distinct().orderBy("lang").collect()]  # one row per language
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("lang")) - 1
    df = texts.filter("lang is not null").withColumns({"label": at.cast("double"), "held": held_out})
    shape = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in ("id", "lang", "label", "held"))
    # texts are read once; vocabulary, vectors and fit go by what each text counts
    grams = cut(df.select("id", "lang", "label", "held", "text").mapInArrow(_grams, f"{shape}, g array<long>, n array<int>"))
    each = grams.filter("not held").select(F.inline(F.arrays_zip("g", "n"))).groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    known = np.array(sorted(r[0] for r in each.orderBy(F.desc("n"), "g").limit(features).collect()), "<i8")  # `features` rows at most
    # a sparse vector's own fields, read back as vectors: no built-in makes one from arrays
    rows = cut(grams.mapInArrow(_weighed(known), f"{shape}, tf struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"), grams)
    tf = df.sparkSession.read.schema(StructType([*rows.schema.fields[:4], StructField("tf", VectorUDT())])).parquet(rows._cut_at)
    z = IDF(inputCol="tf", outputCol="x").fit(tf.filter("not held")).transform(tf).select("id", "lang", "label", "held", "x")
    model = LogisticRegression(featuresCol="x", labelCol="label", maxIter=30, regParam=1e-4).fit(z.filter("not held"))
    p = cut(model.transform(z).select("id", "lang", "label", "held", "prediction"), rows)
    acc = p.filter("held").agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    return p.select("id", "lang", F.get(F.array(*[F.lit(n) for n in names]), F.col("prediction").cast("int")).alias("pred"), "held"), acc or 0.0


def vector_head(vectors: DataFrame, label: str, held_out: Column, balanced: bool = True, reg: float = 1e-3) -> DataFrame:
    """vec_id, gold, pred, held: multinomial logistic regression on vectors, class-weighted, fitted on rows that aren't held out. Labels are 0 .. n - 1."""
    df = vectors.select("vec_id", F.col(label).cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("x")).withColumn("held", held_out)
    train = class_weights(df.filter("not held"), "label") if balanced else df.filter("not held").withColumn("weight", F.lit(1.0))
    m = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", maxIter=30, regParam=reg).fit(train)
    return m.transform(df).select("vec_id", F.col("label").cast("int").alias("gold"), F.col("prediction").cast("int").alias("pred"), "held")


def router_head(vectors: DataFrame, targets: DataFrame, held_out: Column, reg: float = 1e-3) -> DataFrame:
    """vec_id, gold, pred, leaf, held: a distribution over an attribute's nodes, whose sum over the nodes of a class (the exponential of the log-sum-exp of their scores) is the class's.

    targets: vec_id, value (null: not labelled, masked from the fit), leaf ('' trains the class's own node). Rows weigh half as they come and half so that nodes weigh the same.
    pred is the class with the greatest sum, leaf its most probable node.
    """
    t = targets.select("vec_id", "value", F.concat_ws("/", "value", F.nullif("leaf", F.lit(""))).alias("node"))
    nodes = [(r["node"], r["value"]) for r in t.filter("value is not null").select("node", "value").distinct().orderBy("node").collect()]  # a row per node of the attribute
    at = F.array_position(F.array(*[F.lit(n) for n, _ in nodes]), F.col("node")) - 1
    df = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x")).withColumn("held", held_out).join(t.hint("merge"), "vec_id", "left")
    known = df.filter("value is not null").withColumn("label", at.cast("double"))
    train = class_weights(known.filter("not held"), "label").withColumn("weight", 0.5 + 0.5 * F.col("weight"))
    m = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", maxIter=30, regParam=reg, family="multinomial").fit(train)
    p = m.transform(df).withColumn("p", vector_to_array("probability"))
    values = sorted({v for _, v in nodes})
    mass = F.array(*[F.struct(sum((F.get("p", F.lit(i)) for i, (_, w) in enumerate(nodes) if w == v), F.lit(0.0)).alias("s"), F.lit(v).alias("v")) for v in values])
    best = F.array_max(mass)["v"]
    leaf = F.array_max(F.filter(F.array(*[F.struct(F.get("p", F.lit(i)).alias("p"), F.lit(n).alias("n"), F.lit(v).alias("v")) for i, (n, v) in enumerate(nodes)]), lambda s: s["v"] == F.col("pred")))["n"]
    return p.select("vec_id", F.col("value").alias("gold"), best.alias("pred"), "p", "held").withColumn("leaf", leaf).select("vec_id", "gold", "pred", "leaf", "held")


def property_heads(vectors: DataFrame, fields: DataFrame, held_out: Column, least: int = 10) -> DataFrame:
    """vec_id, field, gold, pred, held: a class-weighted head for each form field over its classes with at least `least` rows; fields with one such class have none. fields: vec_id, field, value."""
    n = fields.groupBy("field", "value").agg(F.countDistinct("vec_id").alias("n")).filter(F.col("n") >= least)
    classes: dict = {}
    for r in n.orderBy("field", "value").collect():  # a row per class of the form
        classes.setdefault(r["field"], []).append(r["value"])
    out = None
    for field, names in classes.items():
        if len(names) < 2:
            continue
        lit = F.array(*[F.lit(x) for x in names])
        own = fields.filter((F.col("field") == field) & F.col("value").isin(names)).select("vec_id", (F.array_position(lit, F.col("value")) - 1).alias("y"))
        p = vector_head(vectors.join(own.hint("merge"), "vec_id"), "y", held_out)
        p = p.select("vec_id", F.lit(field).alias("field"), F.get(lit, F.col("gold")).alias("gold"), F.get(lit, F.col("pred")).alias("pred"), "held")
        out = p if out is None else out.unionByName(p)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "vec_id long, field string, gold string, pred string, held boolean")


def question_heads(vectors: DataFrame, targets: DataFrame, held_out: Column, least: int = 20, reg: float = 1e-3) -> DataFrame:
    """vec_id, attr, y, p, held: a balanced sigmoid for each attribute with at least `least` positives among the rows that aren't held out (hold out whole splits), all fitted at once. targets: vec_id, attr, y (0 or 1)."""
    x = vectors.select("vec_id", "embedding").withColumn("held", held_out)
    t = targets.join(x.filter("not held").select("vec_id").hint("merge"), "vec_id", "left_semi").select("vec_id", "attr", "y")
    n = t.groupBy("attr").agg(F.sum("y").alias("_pos"), F.sum(1 - F.col("y")).alias("_neg")).filter((F.col("_pos") >= least) & (F.col("_neg") > 0))
    # positives weigh neg / pos of a negative, so that both sides weigh the same
    t = t.join(F.broadcast(n), "attr").select("vec_id", "attr", F.lit("").alias("value"), F.lit("").alias("leaf"), "y", (F.col("_neg") / F.col("_pos")).alias("weight"))
    model = fitted(x, t, reg)
    if model is None:
        return targets.join(x.hint("merge"), "vec_id").select("vec_id", "attr", "y", F.lit(0.0).alias("p"), "held").limit(0)
    p = model.node_scores(x, "vec_id", "held").select("vec_id", "held", "attr", (1 / (1 + F.exp(-F.col("logit")))).alias("p"))
    return targets.select("vec_id", "attr", "y").join(p.hint("merge"), ["vec_id", "attr"]).select("vec_id", "attr", "y", "p", "held")


def fitted(rows: DataFrame, targets: DataFrame, reg: float, family: str = "sigmoid", **how) -> NodeHeadsModel | None:
    """Heads on the targets of rows (vec_id, embedding), or None where there is none."""
    table, nodes = training_table(rows, targets)
    return NodeHeads(nodes, family=family, regParam=reg, **how).fit(table) if nodes else None


def identity_heads(vectors: DataFrame, targets: DataFrame, held_out: Column, reg: float = 1e-3) -> tuple[NodeHeadsModel | None, DataFrame]:
    """(model, scores) of identity heads from fractional targets (vec_id, attr, value, leaf, y), as soft_targets gives them: scores are vec_id, attr, value, leaf, p, held for all rows and nodes.

    Which pairs enter the fit, and with which weight, is identity_pairs'. A class's p is that of its attribute times its own, a leaf's is its class's times its own.
    """
    x = vectors.select("vec_id", "embedding").withColumn("held", held_out)
    seen = targets.join(x.filter("not held").select("vec_id").hint("merge"), "vec_id", "left_semi")
    model = fitted(x, identity_pairs(seen), reg)
    if model is None:
        return None, targets.select("vec_id", "attr", "value", "leaf", F.lit(0.0).alias("p"), F.lit(False).alias("held")).limit(0)
    return model, joint_scores(model.node_scores(x, "vec_id", "held"), "vec_id", "held")


def domain_head(vectors: DataFrame, k: int, none: int, held_out: Column) -> DataFrame:
    """vec_id, gold, pred, held: at most k training rows of each class, by id, and all of the background class `none`, class-weighted. vectors: vec_id, label, embedding."""
    r = F.row_number().over(W.partitionBy("label", "held").orderBy("vec_id"))
    few = vectors.withColumn("held", held_out).withColumn("_r", r).filter(F.col("held") | (F.col("label") == none) | (F.col("_r") <= k)).drop("_r")
    return vector_head(few.drop("held"), "label", held_out)

"""Calibration, thresholds and accuracies over long score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workers import cut


def softmax(scores: DataFrame, by: tuple[str, ...], score: str = "logit", to: str = "p") -> DataFrame:
    """Adds the softmax within each group, shifted by the group's maximum."""
    w = W.partitionBy(*by)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return scores.withColumn("_e", e).withColumn(to, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def predictions(scores: DataFrame, by: tuple[str, ...] = ("vec_id",), gold: str = "gold") -> DataFrame:
    """by, gold, pred: the class with the greatest logit, ties to the least."""
    return scores.groupBy(*by, gold).agg(F.min_by("k", F.struct(-F.col("logit"), "k")).alias("pred"))


def class_metrics(preds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per group of `by`: n, accuracy, balanced accuracy (mean recall over classes present), majority share. Two aggregations, the second over classes."""
    c = preds.groupBy(*by, "gold").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("hit"))
    return c.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("balanced"), (F.max("n") / F.sum("n")).alias("majority"))


def split_metrics(preds: DataFrame) -> DataFrame:
    """part (all, first, other), n, clips and class_metrics: over all rows, those of the first set, and the others. preds: gold, pred, clip, first."""
    p = preds.withColumn("part", F.explode(F.array(F.lit("all"), F.when(F.col("first"), "first").otherwise("other"))))
    return class_metrics(p, ("part",)).join(p.groupBy("part").agg(F.countDistinct("clip").alias("clips")).hint("merge"), "part")


def skill_score(preds: DataFrame, classes: int) -> DataFrame:
    """One row: balanced accuracy, and its gain over chance as a share of the possible gain."""
    return class_metrics(preds).select("balanced", ((F.col("balanced") - 1 / classes) / (1 - 1 / classes)).alias("skill"))


def leaf_metrics(records: DataFrame) -> DataFrame:
    """One row: leaf accuracy where the class is right, and end to end. records: class_ok, leaf_ok."""
    return records.agg(F.avg(F.when(F.col("class_ok"), F.col("leaf_ok").cast("double"))).alias("given_class"), F.avg((F.col("class_ok") & F.col("leaf_ok")).cast("double")).alias("end_to_end"))


def fit_leaf_threshold(records: DataFrame, grid: list[float], least: int = 10, precision: float = 0.75) -> DataFrame:
    """One row: the smallest threshold of the grid with `least` records served at the precision (1.01 if none), and its coverage. records: conf, right."""
    n = F.count("*").alias("n")
    cols = [c for i, t in enumerate(grid) for c in (F.count_if(F.col("conf") >= t).alias(f"s{i}"), F.count_if((F.col("conf") >= t) & F.col("right")).alias(f"r{i}"))]
    a = records.agg(n, *cols)  # one pass for the whole grid
    ok = lambda i: (F.col(f"s{i}") >= least) & (F.col(f"r{i}") >= precision * F.col(f"s{i}"))
    order = sorted(range(len(grid)), key=lambda i: grid[i])
    t, cover = F.lit(1.01), F.lit(0.0)
    for i in reversed(order):
        t, cover = F.when(ok(i), F.lit(grid[i])).otherwise(t), F.when(ok(i), F.col(f"s{i}") / F.col("n")).otherwise(cover)
    return a.select(t.alias("threshold"), cover.alias("coverage"))


def temperature_grid(scores: DataFrame, temperatures: list[float], by: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """temperature, nll by temperature, `best` marking the least (ties to the lower): mean negative log-likelihood of softmax(logits / T)."""
    g = scores.groupBy(*by).agg(F.collect_list("logit").alias("z"), F.max(F.when(F.col("k") == F.col("gold"), F.col("logit"))).alias("zg"))
    t = g.withColumn("temperature", F.explode(F.array(*[F.lit(float(x)) for x in temperatures])))
    top = F.array_max("z")
    lse = F.log(F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp((x - top) / F.col("temperature")))) + top / F.col("temperature")
    t = t.groupBy("temperature").agg(F.avg(lse - F.col("zg") / F.col("temperature")).alias("nll"))
    return t.withColumn("best", F.row_number().over(W.orderBy("nll", "temperature")) == 1)


def f1_threshold(scores: DataFrame, grid: list[float]) -> DataFrame:
    """threshold, f1 of each grid value over all (item, class) cells, `best` marking the first greatest. scores: p, y."""
    t = scores.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in grid])))
    hit = F.col("p") >= F.col("threshold")
    t = t.groupBy("threshold").agg((2.0 * F.count_if(hit & (F.col("y") == 1)) / F.greatest(F.count_if(hit) + F.count_if(F.col("y") == 1), F.lit(1))).alias("f1"))
    return t.withColumn("best", F.row_number().over(W.orderBy(F.desc("f1"), "threshold")) == 1)


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with running sums (new name -> column) of each group of `by` in the given order, which should leave few ties; a group may span many tasks.

    Rows are range-partitioned on both, summed inside each range, and shifted by the totals of the ranges before: one row for each range and group.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    x = cut(df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("_at", at)).withColumn("_pid", F.shiftright("_at", 33))
    inner = W.partitionBy("_pid", *by).orderBy("_at")
    before = W.partitionBy(*by).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    total = x.groupBy("_pid", *by).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    base = total.select("_pid", *by, *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    x = x.withColumns({k: F.sum(c).over(inner) for k, c in sums.items()}).join(base.hint("merge"), ["_pid", *by])
    return x.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_pid", "_at", *[f"_{k}" for k in sums])


def average_precision(scores: DataFrame, least: int = 5) -> DataFrame:
    """k, ap for classes with at least `least` positives; rows of equal score enter together. scores: k, p, y."""
    s = scores.groupBy("k", "p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    s = running(s, ["k"], [F.desc("p")], {"cn": "n", "cp": "pos"})
    return s.groupBy("k").agg(F.sum("pos").alias("all"), F.sum(F.col("pos") * F.col("cp") / F.col("cn")).alias("t")).filter(F.col("all") >= least).select("k", (F.col("t") / F.col("all")).alias("ap"))


def serving_encoder(metrics: DataFrame) -> DataFrame:
    """attr, encoder: the source with the greater mean of two metrics (NaN ignored), earlier order on ties. metrics: attr, encoder, ord, m1, m2."""
    v = F.filter(F.array("m1", "m2"), lambda x: x.isNotNull() & ~F.isnan(x))
    mean = F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(-1.0)
    return metrics.groupBy("attr").agg(F.min_by("encoder", F.struct(-mean, "ord")).alias("encoder"))


def soft_targets(hard: DataFrame, soft: DataFrame, least: float = 0.02) -> DataFrame:
    """item, value, leaf, y: 1 for hard labels and their classes; else the sum of soft scores >= least, at most 1."""
    h = hard.select("item", "value", "leaf").unionByName(hard.select("item", "value", F.lit("").alias("leaf"))).distinct().withColumn("y", F.lit(1.0))
    s = soft.filter(F.col("s") >= least).groupBy("item", "value", "leaf").agg(F.least(F.sum("s"), F.lit(1.0)).alias("y"))
    return h.unionByName(s).groupBy("item", "value", "leaf").agg(F.max("y").alias("y"))


def unknown_mask(targets: DataFrame) -> DataFrame:
    """Adds `known`: false for a leaf whose class is positive on the item while none of its leaves is."""
    w = W.partitionBy("item", "value")
    cls, leaf = F.max(F.when(F.col("leaf") == "", F.col("y"))).over(w), F.max(F.when(F.col("leaf") != "", F.col("y"))).over(w)
    return targets.withColumn("known", ~((F.col("leaf") != "") & (F.coalesce(cls, F.lit(0.0)) >= 0.5) & (leaf < 0.5)))


def conditional_weights(targets: DataFrame) -> DataFrame:
    """value, leaf, pos, neg, weight: over items where the class is present; weight is the root of neg / pos, clipped to 1 .. 30."""
    w = W.partitionBy("item", "value")
    t = targets.withColumn("_c", F.max("y").over(w)).filter("_c > 0")
    g = t.groupBy("value", "leaf").agg(F.count_if(F.col("y") >= 0.5).alias("pos"), F.count_if(F.col("y") < 0.5).alias("neg"))
    return g.withColumn("weight", F.sqrt(F.greatest(F.lit(1.0), F.least(F.lit(30.0), F.col("neg") / F.greatest("pos", F.lit(1))))))


def answers(letters: DataFrame, weight: float = 0.1) -> DataFrame:
    """id, gold, grp, dev, ours, prior, blind: the letter with the greatest score in each condition, ties to the smallest letter."""
    best = lambda c: F.min_by("k", F.struct(-c, F.col("k")))
    o, b = F.col("ours"), F.col("blind")
    return letters.groupBy("id", "gold", "grp", "dev").agg(best(o).alias("a_ours"), best(o + weight * b).alias("a_prior"), best(b).alias("a_blind"))


def answer_accuracy(answered: DataFrame) -> DataFrame:
    """grp (null: all), part (all / test), n and the three accuracies."""
    acc = lambda c: F.avg((F.col(c) == F.col("gold")).cast("double")).alias(c)
    x = answered.withColumn("part", F.explode(F.when(F.col("dev"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("test")))))
    g = x.groupingSets([[F.col("part"), F.col("grp")], [F.col("part")]], F.col("part"), F.col("grp"))
    return g.agg(F.count("*").alias("n"), acc("a_ours"), acc("a_prior"), acc("a_blind"))


def select_template(scores: DataFrame) -> DataFrame:
    """template, mean: the candidate with the best mean score over benchmarks, ties by name. scores: template, benchmark, score."""
    m = scores.groupBy("template").agg(F.avg("score").alias("mean"))
    return m.orderBy(F.desc("mean"), "template").limit(1)


def items_summary(items: DataFrame, bench: str, group: str, clip: str) -> DataFrame:
    """bench, n_items, n_clips (distinct), groups: `group=n` by name."""
    c = items.groupBy(bench, group).agg(F.count("*").alias("n"))
    g = c.groupBy(bench).agg(F.sum("n").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(group, "n"))), lambda x: F.concat(x[group].cast("string"), F.lit("="), x["n"].cast("string"))), ", ").alias("groups"))
    return g.join(items.groupBy(bench).agg(F.countDistinct(clip).alias("n_clips")).hint("merge"), bench)


def probe_metrics(scores: DataFrame, options: DataFrame, nearest: DataFrame, none: int) -> DataFrame:
    """gold, n, accuracy, restricted, abstained, centroid per class: over all classes, over an item's options only, how often `none` wins, and by the closest centroid.

    scores: vec_id, k, gold, logit; options: vec_id, k (an item without any counts as wrong); nearest: vec_id, nearest.
    """
    every = predictions(scores)
    few = predictions(scores.join(options.hint("merge"), ["vec_id", "k"], "left_semi")).select("vec_id", F.col("pred").alias("chosen"))
    j = every.join(few.hint("merge"), "vec_id", "left").join(nearest.select("vec_id", "nearest").hint("merge"), "vec_id", "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return j.groupBy("gold").agg(
        F.count("*").alias("n"), share(F.col("gold") == F.col("pred")).alias("accuracy"), share(F.col("gold") == F.col("chosen")).alias("restricted"), share(F.col("pred") == none).alias("abstained"), share(F.col("gold") == F.col("nearest")).alias("centroid")
    )

"""Label records: assembly, votes, reports and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def assemble_label_table(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Chunk rows with their label records as an array `fired`, ordered by seq; empty where there are none."""
    rec = F.struct("seq", "attr", "value", "leaf", "tool", "score")
    by = labels.groupBy("row_id").agg(F.array_sort(F.collect_list(rec)).alias("fired"))
    empty = F.expr("cast(array() as array<struct<seq:int,attr:string,value:string,leaf:string,tool:string,score:double>>)")
    return rows.join(by.hint("merge"), "row_id", "left").withColumn("fired", F.coalesce("fired", empty))


def completed_only(labels: DataFrame, done: DataFrame) -> DataFrame:
    """Records of clips whose annotator has finished (done: clip, tool)."""
    return labels.join(done.hint("merge"), ["clip", "tool"], "left_semi")


def todo_rows(rows: DataFrame, finished: DataFrame, key: str = "row_id") -> DataFrame:
    return rows.join(finished.select(key).hint("merge"), key, "left_anti")


def completeness(clips: DataFrame, done: DataFrame) -> DataFrame:
    """tool, missing: clips that lack the tool's marker."""
    n = clips.select("clip").distinct().count()
    return done.join(clips.select("clip").distinct().hint("merge"), "clip", "left_semi").groupBy("tool").agg((F.lit(n) - F.countDistinct("clip")).alias("missing"))


def gate_rows(rows: DataFrame, labels: DataFrame, fired: Column) -> DataFrame:
    """Rows on which a label fired."""
    return rows.join(labels.filter(fired).select("row_id").hint("merge"), "row_id", "left_semi")


def label_report(labels: DataFrame, top: int = 6) -> DataFrame:
    """tool, attr, n_labels, n_clips, top_values: the most frequent classes, ties by name."""
    by = labels.groupBy("tool", "attr").agg(F.count("*").alias("n_labels"), F.countDistinct("clip").alias("n_clips"))
    v = labels.groupBy("tool", "attr", "value").agg(F.count("*").alias("n"))
    r = F.row_number().over(W.partitionBy("tool", "attr").orderBy(F.desc("n"), "value"))
    v = v.withColumn("r", r).filter(F.col("r") <= top).groupBy("tool", "attr").agg(F.array_sort(F.collect_list(F.struct("r", F.concat_ws("=", "value", "n").alias("s")))).alias("o"))
    return by.join(v, ["tool", "attr"]).select("tool", "attr", "n_labels", "n_clips", F.array_join(F.transform("o", lambda x: x["s"]), "; ").alias("top_values"))


def vote_single(labels: DataFrame, floor: float, key: tuple[str, ...] = ("clip", "attr"), expert: str = "expert", annotator: str = "annotator") -> DataFrame:
    """One class per key: the expert's best label at or above the floor, else the annotator's first (by seq); its leaves, and whether both agree.

    Ties in score go to the least seq. Keys with neither are dropped. One aggregation finds the class; a join brings its leaves.
    """
    ok = (F.col("tool") == expert) & (F.coalesce("score", F.lit(0.0)) >= floor)
    win = labels.groupBy(*key).agg(
        F.min_by(F.when(ok, F.col("value")), F.when(ok, F.struct(-F.col("score"), F.col("seq"), F.col("value")))).alias("ex"),
        F.min_by(F.when(F.col("tool") == annotator, F.col("value")), F.when(F.col("tool") == annotator, F.struct("seq", "value"))).alias("an"),
    )
    win = win.filter("ex is not null or an is not null").select(*key, F.coalesce("ex", "an").alias("value"), F.when(F.col("ex").isNotNull() & F.col("an").isNotNull(), F.col("ex") == F.col("an")).alias("agree"))
    # the class is a filter, not a key, so that both sides keep the partitioning of the first aggregation
    own = labels.join(win.withColumnRenamed("value", "_v").hint("merge"), list(key)).filter(F.col("value") == F.col("_v"))
    return own.groupBy(*key, "value", "leaf").agg(F.array_sort(F.collect_set("tool")).alias("tools"), F.max("agree").alias("agree"))


def vote_multi(labels: DataFrame, floor: float, key: tuple[str, ...] = ("clip", "attr"), expert: str = "expert") -> DataFrame:
    """All annotator labels and expert labels at or above the floor, once per (value, leaf), with their tools."""
    keep = (F.col("tool") != expert) | (F.coalesce("score", F.lit(0.0)) >= floor)
    return labels.filter(keep).groupBy(*key, "value", "leaf").agg(F.array_sort(F.collect_set("tool")).alias("tools"))


def vote_stats(labels: DataFrame, floor: float, key: tuple[str, ...] = ("clip", "attr"), expert: str = "expert", annotator: str = "annotator") -> DataFrame:
    """One row: keys where both agree, disagree, where neither counts, and annotator leaves outside the winning class."""
    ok = (F.col("tool") == expert) & (F.coalesce("score", F.lit(0.0)) >= floor)
    win = labels.groupBy(*key).agg(
        F.min_by(F.when(ok, F.col("value")), F.when(ok, F.struct(-F.col("score"), F.col("seq"), F.col("value")))).alias("ex"),
        F.min_by(F.when(F.col("tool") == annotator, F.col("value")), F.when(F.col("tool") == annotator, F.struct("seq", "value"))).alias("an"),
        F.collect_list(F.when((F.col("tool") == annotator) & (F.col("leaf") != ""), F.col("value"))).alias("vs"),
    )
    won = F.coalesce("ex", "an")
    return win.agg(F.count_if(F.col("ex") == F.col("an")).alias("agree"), F.count_if(F.col("ex") != F.col("an")).alias("disagree"), F.count_if(won.isNull()).alias("below_floor"), F.sum(F.when(won.isNotNull(), F.size(F.filter("vs", lambda v: v != won))).otherwise(0)).alias("orphaned"))


def propagate_clip_labels(labels: DataFrame, chunks: DataFrame, space: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_id, attr, value, leaf, origin) and (reason, n) of the labels that aren't used.

    A label on a chunk of its attribute's grid stays (own); one on a clip row goes to the clip's chunks of that grid, unless the attribute is judged per chunk (clip). Of several copies of a class on a
    chunk its own counts first, then one with a leaf, then the first leaf by name. labels: row_id, clip, grid, attr, value, leaf; chunks: row_id, clip, grid; space: attr, grid, scope.
    """
    l = labels.join(F.broadcast(space.select("attr", F.col("grid").alias("_g"), "scope")), "attr", "left")  # the schema's attributes
    have = chunks.select("clip", F.col("grid").alias("_g"), F.lit(True).alias("_has")).distinct()
    l = l.join(have.hint("merge"), ["clip", "_g"], "left")
    why = F.when(F.col("_g").isNull(), "attribute not in the schema").when(F.col("grid") == F.col("_g"), None).when(F.col("grid") != "clip", "label on another grid").when(F.col("scope") == "local", "clip label of a per-chunk attribute")
    l = l.withColumn("reason", why.when(F.col("_has").isNull(), "clip label without chunks"))
    used = l.filter("reason is null")
    own = used.filter("grid = _g").select("row_id", "attr", "value", "leaf", F.lit("own").alias("origin"))
    far = used.filter("grid != _g").select("clip", F.col("_g").alias("grid"), "attr", "value", "leaf").join(chunks.select("row_id", "clip", "grid").hint("merge"), ["clip", "grid"])
    every = own.unionByName(far.select("row_id", "attr", "value", "leaf", F.lit("clip").alias("origin")))
    best = F.min_by(F.struct("leaf", "origin"), F.struct(F.when(F.col("origin") == "own", 0).otherwise(1), F.when(F.col("leaf") != "", 0).otherwise(1), "leaf"))
    kept = every.groupBy("row_id", "attr", "value").agg(best.alias("b")).select("row_id", "attr", "value", "b.leaf", "b.origin")
    return kept, l.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def training_pairs(pairs: DataFrame, multi: DataFrame) -> DataFrame:
    """row_id, attr, classes, origin: one class for single-choice attributes (own before clip, with a leaf before without, then by name), all for others. multi: attr, multi."""
    p = pairs.join(F.broadcast(multi.select("attr", "multi").distinct()), "attr")
    best = F.min_by("value", F.struct(F.when(F.col("origin") == "own", 0).otherwise(1), F.when(F.col("leaf") != "", 0).otherwise(1), "value"))
    g = p.groupBy("row_id", "attr", "multi").agg(best.alias("one"), F.array_sort(F.collect_set("value")).alias("every"), F.max("origin").alias("origin"))
    return g.select("row_id", "attr", F.when(F.col("multi"), F.array_join("every", "|")).otherwise(F.col("one")).alias("classes"), "origin")


def space_counts(labels: DataFrame, split: Column) -> DataFrame:
    """attr, value, pairs, clips, train_pairs."""
    return labels.withColumn("_s", split).groupBy("attr", "value").agg(F.count("*").alias("pairs"), F.countDistinct("clip").alias("clips"), F.count_if(F.col("_s") == "train").alias("train_pairs"))


def head_nodes(train: DataFrame, least: int) -> DataFrame:
    """attr, node, kind: classes seen, and leaves with at least `least` clips (named class/leaf)."""
    c = train.select("attr", F.col("value").alias("node"), F.lit("class").alias("kind")).distinct()
    leaf = train.filter("leaf != ''").groupBy("attr", "value", "leaf").agg(F.countDistinct("clip").alias("n")).filter(F.col("n") >= least)
    return c.unionByName(leaf.select("attr", F.concat_ws("/", "value", "leaf").alias("node"), F.lit("leaf").alias("kind")))


def leaf_targets(train: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each label's target node: its leaf where that is a node, else its class."""
    n = nodes.filter("kind = 'leaf'").select("attr", F.col("node").alias("_n"), F.col("node").alias("target"))
    t = train.withColumn("_n", F.concat_ws("/", "value", "leaf")).join(n.hint("merge"), ["attr", "_n"], "left")
    return t.withColumn("target", F.coalesce("target", "value")).drop("_n")


def gold_agreement(labels: DataFrame, gold: DataFrame) -> DataFrame:
    """tool, attr, n, class_accuracy, leaf_accuracy of each tool's majority class per clip against gold (clip, attr, gold_value, gold_leaf); the leaf counts if it is part of the gold leaf or holds it."""
    n = labels.groupBy("tool", "attr", "clip", "value").agg(F.count("*").alias("n"), F.min("leaf").alias("leaf"))
    r = F.row_number().over(W.partitionBy("tool", "attr", "clip").orderBy(F.desc("n"), "value"))
    m = n.withColumn("r", r).filter("r = 1").join(gold.hint("merge"), ["clip", "attr"])
    leaf = F.contains("gold_leaf", F.col("leaf")) | F.contains("leaf", F.col("gold_leaf"))
    return m.groupBy("tool", "attr").agg(F.count("*").alias("n"), F.avg((F.col("value") == F.col("gold_value")).cast("double")).alias("class_accuracy"), F.avg(leaf.cast("double")).alias("leaf_accuracy"))


def union_sets(sets: dict[str, tuple[DataFrame, list[str] | None]]) -> DataFrame:
    """Several label sets as one, each restricted to some attributes or not; `set` names the origin."""
    out = None
    for name, (df, attrs) in sets.items():
        df = (df.filter(F.col("attr").isin(attrs)) if attrs is not None else df).withColumn("set", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def balanced_weights(pairs: DataFrame, share: float = 0.5) -> DataFrame:
    """attr, node, weight: the expected number of draws of a row when an attribute is drawn in proportion to the root of its pairs, and `share` of its draws are uniform over nodes."""
    c = pairs.groupBy("attr", "node").agg(F.count("*").alias("n"))
    a = W.partitionBy("attr")
    c = c.withColumns({"m": F.sum("n").over(a), "k": F.count("*").over(a)})
    root = c.select("attr", "m").distinct().agg(F.sum(F.sqrt("m")).alias("roots"))
    c = c.join(F.broadcast(root), F.lit(True))
    return c.select("attr", "node", (F.sqrt("m") / F.col("roots") * (share / (F.col("k") * F.col("n")) + (1 - share) / F.col("m"))).alias("weight"))


def quality_gates(checks: list[tuple[str, DataFrame, str, float]]) -> DataFrame:
    """name, measured, threshold, ok for one-row frames with a column `measured`; op is >= , <= or =."""
    out = None
    for name, df, op, limit in checks:
        m = F.col("measured").cast("double")
        ok = {">=": m >= limit, "<=": m <= limit, "=": m == limit}[op]
        row = df.select(F.lit(name).alias("name"), m.alias("measured"), F.lit(float(limit)).alias("threshold"), F.coalesce(ok, F.lit(False)).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def require(gates: DataFrame) -> None:
    """Raises if a gate has failed."""
    if failed := [r["name"] for r in gates.filter("not ok").collect()]:
        raise ValueError(f"quality gates failed: {', '.join(failed)}")


def observed_write(df: DataFrame, path: str, checks: list[tuple[str, Column, str, float]]) -> DataFrame:
    """Writes df as Parquet at path behind gates that are measured while it is written, in the same pass; name, measured, threshold, ok as quality_gates gives them. Raises if one fails.

    checks: name, an aggregate without distinct, `>=`, `<=` or `=`, limit. Rows go to a folder beside path first and move to it when all gates hold; a table that was there stays where one fails, and the rejected rows lie in
    `<path>-rejected` with the gates that failed in `_FAILED`.
    """
    spark, seen = df.sparkSession, Observation()
    draft, rejected = f"{path}-draft", f"{path}-rejected"
    # in a session of its own: one that has observed anything can't be part of a fitted classifier any more, and those hold their session
    view, apart = f"gated_{uuid.uuid4().hex}", spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            apart.conf.set(k, v)
    df.createGlobalTempView(view)
    try:
        rows = apart.table(f"global_temp.{view}")
        rows.observe(seen, *[m.cast("double").alias(f"m{i}") for i, (_, m, _, _) in enumerate(checks)]).write.mode("overwrite").parquet(draft)
        got = seen.get
    finally:
        spark.catalog.dropGlobalTempView(view)
    rows = []
    for i, (name, _, op, limit) in enumerate(checks):
        m = got[f"m{i}"]
        rows.append((name, m, float(limit), m is not None and {">=": m >= limit, "<=": m <= limit, "=": m == limit}[op]))
    gates = spark.createDataFrame(rows, "name string, measured double, threshold double, ok boolean")
    failed = [r[0] for r in rows if not r[3]]
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    to = rejected if failed else path
    fs.delete(at(to), True)
    if not fs.rename(at(draft), at(to)):
        raise OSError(f"{draft} can't be moved to {to}")
    if failed:
        fs.create(at(f"{to}/_FAILED")).close()
        raise ValueError(f"quality gates failed: {', '.join(failed)}")
    return gates


def write_report(report: DataFrame, columns: list[str]) -> DataFrame:
    """One text column `line`: the rows as lines of a Markdown table."""
    return report.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("line"))

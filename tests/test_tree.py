"""The whole tree with meaning, cleaning, experts by attribute and its own rules."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import tree as T

LABEL = "row_id string, clip string, source string, attr string, value string, leaf string, tool string, score double, seq int"


def frame(spark, rows):
    """rows: clip, attr, value, leaf, tool, score."""
    return spark.createDataFrame([(f"{c}:0", c, f"s{int(c[1:]) % 3}", a, v, leaf, tool, score, i) for i, (c, a, v, leaf, tool, score) in enumerate(rows)], LABEL)


@pytest.fixture(scope="module")
def labels(spark):
    rows = []
    for i in range(12):
        c = f"c{i}"
        leaf = ["hound", "dog", "dog barking", "guard dog", "wolf", "pup"][i % 6]
        rows += [(c, "sound.animal", "dog", leaf if leaf != "dog" else "dog sound effect", "annotator", None), (c, "speech.accent", "european", ["german", "dutch"][i % 2], "annotator", None)]
        rows += [(c, "music.genre", "rock", "hard rock", "genres", 0.4 if i % 2 else 0.9), (c, "music.genre", "pop", "", "annotator", None), (c, "noise.kind", "x", "y", "annotator", None)]
    return frame(spark, rows)


def unit(*x):
    v = np.array(x, float)
    return (v / np.linalg.norm(v)).tolist()


def test_tree_by_meaning_and_cleaning(spark, labels):
    vectors = spark.createDataFrame([("hound", unit(1, 0.1, 0)), ("guard dog", unit(1, 0.3, 0.1)), ("wolf", unit(1, 0.12, 0)), ("pup", unit(0, 1, 0)), ("dog barking", unit(0, 0, 1)), ("german", unit(1, 0)), ("dutch", unit(1, 0))], "name string, x array<double>")
    table = spark.createDataFrame(
        [("pruned", "noise.kind", None, None, None), ("dropped", "sound.animal", "dog", "pup", None), ("generic", "sound.animal", "dog", "guard dog", "dog barking")], "kind string, attr string, value string, leaf string, to string"
    )
    multi = spark.createDataFrame([(a, False) for a in ("sound.animal", "speech.accent", "music.genre", "noise.kind")], "attr string, multi boolean")
    how = {"vectors": vectors, "apart": ["speech.accent"], "table": table, "experts": {"music.genre": ("genres", 0.5)}, "extra": {"sound.animal": ["effect"]}, "min_sources": 1}
    t = T.build_tree(labels, 0.3, multi, F.split_part("attr", F.lit("."), F.lit(1)), [], **how)
    nodes = {(r.attr, r.value, r.leaf): r for r in t["nodes"].collect()}
    canon = {(r.attr, r.leaf): r.canon for r in t["canon"].collect()}
    assert not any(a == "noise.kind" for a, _, _ in nodes)
    assert canon["sound.animal", "wolf"] == "hound" == canon["sound.animal", "hound"]  # one by meaning, in order of support, then name
    assert canon["speech.accent", "dutch"] == "dutch"  # accents are never merged by vectors
    assert ("sound.animal", "pup") not in canon  # dropped: its rows keep the class
    assert nodes["sound.animal", "dog", ""].clips == 12
    links = {(r.leaf, r.generic) for r in t["links"].collect()}
    assert links == {("guard dog", "dog barking")}  # from the table; no generic of fewer words is close enough
    assert nodes["sound.animal", "dog", "guard dog"].parent == "dog barking" and nodes["sound.animal", "dog", "dog barking"].clips == 4
    # the genre's expert counts from 0.5 on: six rows are rock, six what the annotator says
    assert (nodes["music.genre", "rock", ""].clips, nodes["music.genre", "pop", ""].clips) == (6, 6)


def test_tree_keys_with_attribute_fillers(spark):
    df = spark.createDataFrame([("a.b", "dog effect"), ("c.d", "dog effect"), ("a.b", "dog")], "attr string, leaf string")
    keys = [r[0] for r in df.select(T.tree_key({"a.b": ["dog"], "e.f": ["x"]})).collect()]
    assert keys[0] != keys[1] and keys[2] == "dog"


def test_tree_rules_are_checked(spark):
    n = lambda rows: spark.createDataFrame(rows, "attr string, value string, leaf string, clips long")
    T.checked_tree(n([("a.b", "v", "", 3), ("a.b", "v", "x", 2), ("c.d", "w", "x", 2)]), 2)
    for rows, what in (([("a.b", "v", "", 0)], "without clips"), ([("a.b", "v", "x 2", 5)], "digit"), ([("a.b", "v", "x", 1)], "too few"), ([("a.b", "v", "x", 2), ("a.b", "w", "x", 2)], "several classes")):
        with pytest.raises(ValueError, match=what):
            T.checked_tree(n(rows), 2)


def test_clean_labels_meets_rows_once(spark):
    """What becomes of a node is found for distinct nodes, and rows meet that in one join; leaves that are null or not admitted fall back to the class."""
    rows = spark.createDataFrame([("r1", "a", "v", "x one"), ("r1", "a", "v", "x one"), ("r2", "a", "v", "y"), ("r3", "a", "v", None), ("r4", None, "v", "x"), ("r5", "a", "v", "z"), ("r6", "a", "w", "x one")], "row_id string, attr string, value string, leaf string")
    canon = spark.createDataFrame([("a", "v", "z", "x one"), ("a", "v", "z", "x")], "attr string, value string, leaf string, to_leaf string")
    ok = spark.createDataFrame([("a", "v", "x one"), ("a", "v", "x"), ("a", "v", "")], "attr string, value string, leaf string")
    links = spark.createDataFrame([("a", "v", "x one", "y"), ("a", "v", "y", "x")], "attr string, value string, leaf string, generic string")
    out = T.clean_labels(rows, canon, ok, links)
    assert {tuple(x) for x in out.collect()} == {("r1", "a", "v", "x one"), ("r1", "a", "v", "x"), ("r2", "a", "v", ""), ("r3", "a", "v", ""), ("r4", None, "v", ""), ("r5", "a", "v", "x one"), ("r5", "a", "v", "x"), ("r6", "a", "w", "")}
    assert out.count() == 8
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "to_json" not in plan


def test_names_cost_once_not_by_row(spark):
    """Words and stems are those of distinct names, so no plan over rows has them, and only counts of distinct clips read the table of clips."""
    rows = frame(spark, [(f"c{i}", "a.x", "v", leaf, tool, None) for i in range(4) for leaf, tool in (("barking dogs", "expert"), ("dog bark", "annotator"))] + [("c9", "a.y", "w", "dog bark", "annotator", None)])
    out = T.cofire_aliases(rows)
    assert [tuple(x) for x in out.collect()] == [("a.x", "v", "barking dogs", "dog bark")]
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    moves = T.plan_moves(rows, F.lit("a"), [])
    assert [tuple(x) for x in moves.collect()] == [("a.y", "w", "dog bark", "a.x", "v", "dog bark")]
    plan = moves._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert len([p for p in plan if "Relation [" in p and "clip#" in p]) <= 2


def test_tree_rows_are_dealt_once(spark):
    """Rows lie by clip once the votes are in: no plan over them has an exchange, and the shuffle files of the steps are gone. A row's clip is its least, labels without a class stay where they are."""
    files = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if x.endswith(".data") and "shuffle_" in x}
    rows = [(f"r{i}", f"c{i // 2}", "s", "a.x", "v", leaf, tool, 0.9, j) for i in range(40) for j, (leaf, tool) in enumerate((("barking dogs", "expert"), ("dog bark", "annotator"), ("", "annotator")))]
    rows += [("r0", "c00", "s", "a.y", "w", "dog bark", "annotator", None, 9), ("r1", "c0", "s", "a.x", None, "", "annotator", None, 9), (None, "c1", "s", "a.x", "v", "dog bark", "annotator", None, 9)]
    multi = spark.createDataFrame([("a.x", True), ("a.y", False)], "attr string, multi boolean")
    before = files()
    t = T.build_tree(spark.createDataFrame(rows, LABEL), 0.3, multi, F.lit("a"), [], min_sources=1)
    left = sum(os.path.getsize(x) for x in files() - before if os.path.exists(x))
    for name, col in (("labels", "leaf"), ("members", "node")):
        plan = t[name]._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
        assert t[name].filter(F.col(col).isNull()).count() == 0
    assert left < 20_000
    assert [tuple(r) for r in t["aliases"].collect()] == [("a.x", "v", "barking dogs", "dog bark")]
    assert {tuple(r) for r in t["moves"].collect()} == {("a.y", "w", "dog bark", "a.x", "v", "dog bark")}
    nodes = {(r.attr, r.value, r.leaf): (r.clips, r.chunks) for r in t["nodes"].unionByName(t["refused"], allowMissingColumns=True).collect()}
    # r0 has the clips c0 and c00, of which c0 counts; the row without an id counts nowhere
    assert nodes["a.x", "v", ""] == nodes["a.x", "v", "dog bark"] == (20, 40) and nodes["a.y", "w", ""] == (1, 1)
    assert ("r1", "a.x", None, "") in {tuple(r) for r in t["labels"].collect()} and t["labels"].filter("row_id is null").count() == 0


def test_dealt_and_cut_free_their_shuffles(spark):
    """Buckets are known when read, a table made from them stays in them, the setting is put back, and discarded tables are gone."""
    from canopy import workers as K

    df = spark.range(1000).select((F.col("id") % 50).alias("clip"), "id")
    was = spark.conf.get(K.FREES, None)
    a = K.dealt(df, "clip", 3)
    b = K.dealt(a.groupBy("clip", "id").agg(F.count("*").alias("n")), "clip", 3, again=False)
    assert "Exchange" not in b.groupBy("clip").count()._jdf.queryExecution().executedPlan().toString()
    assert b.count() == 1000 and spark.conf.get(K.FREES, None) == was
    K.discard(b)
    assert not spark.catalog.tableExists(b._named) and not os.path.exists(b._cut_at.removeprefix("file://"))
    assert K.cut(a.groupBy("id").count()).count() == 1000 and spark.conf.get(K.FREES, None) == was

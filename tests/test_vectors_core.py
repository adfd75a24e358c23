"""Similarity joins that rule out blocks, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import vectors as V


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(1)
    base = r.normal(size=(12, 16))
    x = np.repeat(base, 50, 0) + r.normal(size=(600, 16)) * 0.25
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_pairs_within_skips_blocks(spark, clustered):
    """Equal to all pairs, with most pairs of blocks never compared on clustered vectors."""
    rows = [("g" if i % 3 else None, f"n{i}", x.tolist()) for i, x in enumerate(clustered)] + [("g", "null", None), ("h", "alone", clustered[0].tolist())]
    v = spark.createDataFrame(rows, "grp string, id string, x array<double>")
    got = {(r.grp, r.a, r.b): r.cos for r in V.pairs_within(v, ("grp",), 0.9, block=20).collect()}
    want = {}
    for i, x in enumerate(clustered):
        for j in range(i + 1, len(clustered)):
            if bool(i % 3) == bool(j % 3) and (c := float(x @ clustered[j])) >= 0.9:
                want[("g" if i % 3 else None, *sorted((f"n{i}", f"n{j}")))] = c
    assert got.keys() == want.keys() and len(want) > 500 and max(abs(got[k] - want[k]) for k in want) < 1e-9
    r = np.random.default_rng(2)
    tight = np.repeat(r.normal(size=(12, 16)), 50, 0) + r.normal(size=(600, 16)) * 0.05
    named = spark.createDataFrame([("all", f"n{i}", (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(tight)], "k string, id string, x array<double>")
    cells, pivots = V.celled(named, 20, "string")
    blocks = cells.select("pivot", "sub").distinct().count()
    met = V.block_pairs(cells, pivots, float(np.arccos(0.9)), "string").count()
    assert blocks >= 20 and met < 0.5 * blocks**2  # over half of all pairs of blocks are ruled out
    assert V.block_pairs(cells, pivots, float(np.pi), "string").count() == blocks**2


def test_contained(spark, clustered):
    rows = [(i, x.tolist(), "clash") for i, x in enumerate(clustered)]
    c = spark.createDataFrame([*rows[:400], (900, None, ""), (901, [None] * 16, ""), (None, rows[0][1], ""), rows[0]], "vec_id long, embedding array<double>, side string")
    e = spark.createDataFrame([(i % 400, x, s) for i, x, s in rows[400:]], "vec_id long, embedding array<double>, side string")
    for tau in (0.3, 0.85, 0.99):
        want = {i for i in range(400) if (clustered[400:] @ clustered[i]).max() >= tau}
        assert {r.vec_id for r in V.contained(c, e, tau, block=15).collect()} == want
    kept = [r.vec_id for r in V.containment_filter(c, e, 0.85).collect()]
    assert {900, 901, None} <= set(kept)
    assert V.contained(c, e.limit(0), 0.5).count() == 0 and V.contained(c.limit(0), e, 0.5).count() == 0


def test_nearest_centroid_beyond_a_broadcast(spark, clustered):
    """Few centroids by broadcast and the same ones in blocks."""
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(clustered)], "vec_id long, embedding array<double>")
    c = spark.createDataFrame([(f"c{i:03d}", clustered[i * 2].tolist()) for i in range(300)], "label string, centroid array<double>")
    flat = lambda df: sorted((r.vec_id, r.nearest, round(r.cos, 6), round(r.margin, 6)) for r in df.collect())
    few = flat(V.nearest_centroid(v, c))
    assert few == flat(V.nearest_centroid(v, c, most=0)) and len(few) == 600
    o = spark.createDataFrame([(i, f"c{(i * 7 + j) % 300:03d}") for i in range(600) for j in range(3)], "vec_id long, label string")
    assert flat(V.nearest_centroid(v, c, options=o)) == flat(V.nearest_centroid(v, c, options=o, most=0))
    s = clustered @ clustered[::2].T
    assert [r[1] for r in few] == [f"c{k:03d}" for k in s.argmax(1)]


def test_contained_meets_the_rest_only(spark, clustered, monkeypatch):
    """Equal to all pairs over several broadcast parts; evaluation vectors after the first part meet only candidates that it left alone, and no vector is shuffled once a block that it meets."""
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(clustered[:400])], "vec_id long, embedding array<double>")
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(clustered[400:])], "vec_id long, embedding array<double>")
    met, own = [], V._reach
    monkeypatch.setattr(V, "_reach", lambda c, e, *a: met.append((c.count(), e.count())) or own(c, e, *a))
    got = {r.vec_id for r in V.contained(c, e, 0.3, block=20, group_bytes=4096).collect()}
    assert got == {i for i in range(400) if (clustered[400:] @ clustered[i]).max() >= 0.3}
    assert len(met) == 2 and met[0][0] == 400 and met[0][1] + met[1][1] == 200 and met[1][0] < 400
    both = V.meeting(*[df.selectExpr("'all' k", "vec_id", "embedding x") for df in (c, e)])
    assert all("BroadcastHashJoin" in (plan := b._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in plan for b in both)


def test_a_task_packs_about_a_block(spark):
    """Partitions of vectors that meet others grow in number, not in size, however the table's files lie."""
    v = spark.range(3 * V.BLOCK).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding")).coalesce(1)
    sizes = V.dealt(v, 3 * V.BLOCK, ["vec_id"]).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(sizes) == 6 and max(r["count"] for r in sizes) < V.BLOCK
    top = {r.vec_id: r.ref_id for r in V.pairwise_top1(v.limit(3000), v.filter("vec_id between 5000 and 5003")).collect()}
    assert len(top) == 3000 and set(top.values()) == {5000}


def test_synonym_merge_in_ranges(spark, clustered):
    """Equal to one name after another, in many ranges; names of no group are left alone."""
    from canopy.operators.entity import synonym_merge

    names = [(("g" if i % 3 else "h") if i % 50 else None, "n" + "".join("abcdefghij"[int(d)] for d in str(i)), i % 7, x.tolist()) for i, x in enumerate(clustered[::2])]
    df = spark.createDataFrame(names, "grp string, name string, support int, x array<double>")
    heads, want = [], {}
    for g, n, s, x in sorted(names, key=lambda r: (-r[2], r[1])):
        to = next((h for k, h, y in heads if k == g and g is not None and float(np.dot(x, y)) >= 0.6), n)
        want[g, n] = to
        if to == n:
            heads.append((g, n, x))
    assert 20 < len(heads) < 250
    for first in (16, 10_000):
        assert {(r.grp, r["name"]): r["head"] for r in synonym_merge(df, ("grp",), 0.6, 0.6, first).collect()} == want
    assert synonym_merge(df.limit(0)).count() == 0

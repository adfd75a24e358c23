"""Heads as an estimator and a saved model, against plain numpy fits."""

import numpy as np
import pytest

from canopy.learn import heads as H
from canopy.learn import models as L

DIM, ROWS = 6, 240


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(3)
    x = r.normal(size=(ROWS, DIM)) * [1, 1, 3, 0.2, 1, 1] + 2
    soft = 1 / (1 + np.exp(-(x[:, :1] - x[:, 1:2] + r.normal(size=(ROWS, 4)))))
    return x, np.clip(soft, 0, 1), r.random((ROWS, 4)) < 0.8, np.array([1.0, 2.5, 1.0, 4.0])


def frames(spark, x, y, known, weight):
    v = spark.createDataFrame([(i, row.tolist(), "clash") for i, row in enumerate(x)], "vec_id long, embedding array<double>, node string")
    t = [(i, "a" if j < 2 else "b", f"v{j}", "", float(y[i, j]), bool(known[i, j]), float(weight[j])) for i in range(len(x)) for j in range(4)]
    return v, spark.createDataFrame(t, "vec_id long, attr string, value string, leaf string, y double, known boolean, weight double")


def sigmoid_fit(x, pos, neg, reg):
    """One masked head by damped Newton steps on standardised components, in plain numpy."""
    mean, std = x.mean(0), x.std(0)
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    w, d, total = np.zeros(z.shape[1]), np.diag([reg] * x.shape[1] + [0]), (pos + neg).sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        g = z.T @ ((pos + neg) * p - pos) / total + d @ w
        h = (z * ((pos + neg) * p * (1 - p))[:, None]).T @ z / total + d
        w = w - np.linalg.solve(h, g)
    return w[:-1] / std, w[-1] - (w[:-1] / std) @ mean


@pytest.mark.parametrize("bends", [1 << 21, 0])
def test_soft_labels_against_numpy(spark, data, monkeypatch, bends):
    """Fractional targets under a mask, by Newton steps and by L-BFGS."""
    monkeypatch.setattr(L, "BENDS", bends)
    x, y, known, weight = data
    v, t = frames(spark, x, y, known, weight)
    table, nodes = L.training_table(v.repartition(3), t)
    m = L.NodeHeads(nodes, regParam=0.01, maxIter=300, tol=1e-7).fit(table)
    assert nodes == [("a", "v0", ""), ("a", "v1", ""), ("b", "v2", ""), ("b", "v3", "")]
    for j in range(4):
        k = known[:, j]
        w, b = sigmoid_fit(x, np.where(k, weight[j] * y[:, j], 0), np.where(k, 1 - y[:, j], 0), 0.01)
        assert np.abs(m.coefficients[j] - w).max() < 1e-4 and abs(m.intercepts[j] - b) < 1e-4


def test_softmax_against_numpy(spark, data):
    x, y, _, _ = data
    y = y / y.sum(1, keepdims=True)
    v, t = frames(spark, x, y, np.ones_like(y, bool), np.ones(4))
    table, nodes = L.training_table(v, t)
    m = L.NodeHeads(nodes, family="softmax", regParam=0.05, maxIter=300, tol=1e-7).fit(table)
    mean, std = x.mean(0), x.std(0)
    z = np.hstack([(x - mean) / std, np.ones((ROWS, 1))])
    w = np.zeros((4, DIM + 1))
    for _ in range(20_000):  # plain gradient steps
        p = np.exp(z @ w.T - (z @ w.T).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - y).T @ z / ROWS + 0.05 * np.hstack([w[:, :-1], np.zeros((4, 1))])
        w -= 0.5 * g
    want = z @ w.T
    got = x @ m.coefficients.T + m.intercepts
    centred = lambda a: a - a.mean(1, keepdims=True)  # noqa: E731  a shift of all scores of a row changes nothing
    assert np.abs(centred(got) - centred(want)).max() < 1e-3


def test_saved_model(spark, data, tmp_path):
    x, y, known, weight = data
    v, t = frames(spark, x, y, known, weight)
    m = H.fitted(v, t, 0.01)
    gold = spark.createDataFrame([(i, a, f"v{int(y[i, j] < y[i, j + 1]) + j}", "") for i in range(ROWS) for a, j in (("a", 0), ("b", 2))], "vec_id long, attr string, value string, leaf string")
    m = L.calibrated(m, L.calibrate(m.node_scores(v, "vec_id"), gold, multi=("b",)))
    m.write().overwrite().save(str(tmp_path / "m"))
    again = L.NodeHeadsModel.load(str(tmp_path / "m"))
    assert again.uid == m.uid and again.nodes == m.nodes and again.calibration == m.calibration and (again.coefficients == m.coefficients).all()
    odd = v.unionByName(spark.createDataFrame([(-1, None, "x")], v.schema))
    one, two = (sorted((r.vec_id, r.attr, r.value, r.logit) for r in k.node_scores(odd, "vec_id").collect()) for k in (m, again))
    assert one == two and len(one) == 4 * ROWS and {r[0] for r in one} == set(range(ROWS))
    assert again.transform(odd).filter("vec_id = -1").first().logits is None
    with pytest.raises(Exception, match="exists|overwrite"):
        again.write().save(str(tmp_path / "m"))


def test_calibration_values(spark):
    """Two attributes by hand: one always right and too sure of itself, one no better than chance."""
    rows, gold = [], []
    for i in range(40):
        g = i % 2
        rows += [(i, "good", f"c{k}", leaf, (8.0 if k == g else 0.0) + (3.0 if leaf and i % 4 else -3.0)) for k in (0, 1) for leaf in ("", "x")]
        rows += [(i, "weak", f"c{k}", "", 5.0 if k == (i // 2) % 2 else 0.0) for k in (0, 1)]
        gold += [(i, "good", f"c{g}", "x" if i % 4 else ""), (i, "weak", f"c{g}", ""), (i, "weak", "elsewhere", "")]
    s = spark.createDataFrame(rows, "vec_id long, attr string, value string, leaf string, logit double")
    g = spark.createDataFrame(gold, "vec_id long, attr string, value string, leaf string")
    c = {r.attr: r for r in L.calibrate(s, g).collect()}
    assert (c["good"].rows, c["good"].balanced, c["good"].skill, c["good"].floor, c["good"].temperature) == (40, 1.0, 1.0, 0.0, 0.5)
    assert (c["weak"].balanced, c["weak"].skill, c["weak"].floor, c["weak"].temperature, c["weak"].leaf_threshold) == (0.5, 0.0, 0.5, 30.0, 1.01)
    assert c["good"].leaf_threshold == 0.3  # every leaf that is served is right
    always = {r.attr: r.floor for r in L.calibrate(s, g, always=("weak",)).collect()}
    assert always == {"good": 0.0, "weak": 0.0}


def test_heads_edges(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<double>")
    t = spark.createDataFrame([], "vec_id long, attr string, value string, leaf string, y double")
    assert H.fitted(v, t, 0.1) is None
    with pytest.raises(ValueError, match="family"):
        L.NodeHeads([("a", "b", "")], family="odd").fit(spark.createDataFrame([([1.0], [])], "embedding array<double>, targets array<struct<node:int,pos:double,neg:double>>"))


def test_feature_store_joins_without_moving_the_store(spark, tmp_path):
    from canopy.sources.features import FeatureStore

    store = FeatureStore(spark, f"file://{tmp_path}/store", "plan_features", buckets=4)
    rows = spark.createDataFrame([(f"r{i}", f"t {i}") for i in range(50)], "row_id string, text string")
    embed = lambda batch: [[float(t.split(" ")[1]), 1.0] for t in batch]
    store.upsert(rows.filter("row_id < 'r3'"), "e", "s", embed)
    plan = store.missing(rows, "e", "s")._jdf.queryExecution().executedPlan().toString()
    scans = [i for i, line in enumerate(plan.splitlines()) if "plan_features" in line]
    side = plan.splitlines()[scans[0] - 3 : scans[0]]
    assert len(scans) == 1 and "Bucketed: true" in plan.splitlines()[scans[0]] and not any("Exchange" in x for x in side), plan
    store.upsert(rows.unionByName(rows), "e", "s", embed)
    asked = spark.createDataFrame([("r7", 0), ("r41", 1), ("none", 2), ("r7", 3), ("r0", 4)], "row_id string, ord int")
    got = [(r.row_id, None if r.x is None else round(r.x[0] / r.x[1], 3)) for r in store.read(asked, "e", "s").collect()]
    assert got == [("r7", 7.0), ("r41", 41.0), ("none", None), ("r7", 7.0), ("r0", 0.0)]
    assert spark.table("plan_features").count() == 50
    # another session's view of the same folder
    spark.sql("drop table plan_features")
    again = FeatureStore(spark, f"file://{tmp_path}/store", "plan_features", buckets=4)
    assert again.stored("e", "s").count() == 50 and again.stored("e", "t").count() == 0


def test_gates_on_the_write(spark, tmp_path):
    from pyspark.sql import functions as F

    from canopy.operators.labels import observed_write

    at = f"file://{tmp_path}/table"
    few = F.count(F.lit(1))
    assert observed_write(spark.range(10), at, [("rows", few, ">=", 5)]).collect()[0].measured == 10
    with pytest.raises(ValueError, match="rows"):
        observed_write(spark.range(3), at, [("rows", few, ">=", 5), ("greatest", F.max("id"), "<=", 9)])
    assert spark.read.parquet(at).count() == 10 and spark.read.parquet(f"{at}-rejected").count() == 3 and (tmp_path / "table-rejected" / "_FAILED").exists() and not (tmp_path / "table-draft").exists()


def test_gates_leave_the_session_as_it_was(spark, tmp_path):
    """Classifiers that are fitted after a gated write can still be applied."""
    from pyspark.sql import functions as F

    from canopy.operators.labels import observed_write

    observed_write(spark.range(10), f"file://{tmp_path}/t", [("rows", F.count(F.lit(1)), ">=", 5)])
    r = np.random.default_rng(2)
    v = spark.createDataFrame([(i, (r.normal(size=4) + i % 2 * 3).tolist(), i % 2) for i in range(40)], "vec_id long, embedding array<double>, label int")
    assert H.vector_head(v, "label", F.col("vec_id") % 5 == 0).count() == 40


def test_shards_newer_than_a_mark(spark, tmp_path):
    import os

    from canopy.sources import readers as R

    for name, when in (("old", 1_000_000_000), ("new", 1_700_000_000)):
        (tmp_path / name).mkdir()
        f = tmp_path / name / "a.jsonl"
        f.write_text(f'{{"row_id": "{name}:1", "attr": "a.b", "value": "v"}}\n{{"done": "{name}"}}\n{{"row_id": "cut')
        os.utime(f, (when, when))
    every = R.read_label_shards(spark, str(tmp_path))
    assert {(r.row_id, r.shard) for r in every.collect()} == {("old:1", "old"), ("new:1", "new")}
    later = R.read_label_shards(spark, str(tmp_path), newer_than="2010-01-01 00:00:00")
    assert [r.shard for r in later.collect()] == ["new"] and len(later.inputFiles()) >= 1


def test_registries(spark):
    from canopy import registry as G

    r = G.Registry("embedder", "embed(texts)")

    @r.register("lengths")
    def lengths(texts):
        return [[float(len(t))] for t in texts]

    assert r.get("lengths")(["abc"]) == [[3.0]] and list(r) == ["lengths"] and "lengths" in r
    with pytest.raises(KeyError, match="lengths"):
        r.get("other")
    with pytest.raises(ValueError, match="already"):
        r.register("lengths", lengths)
    with pytest.raises(TypeError, match="embed"):
        r.register("text", "no function")
    G.ANNOTATORS.register("test-upper", lambda rows: rows.selectExpr("row_id", "'a.b' attr", "upper(row_id) value", "cast(null as string) leaf", "0.123456 score"))
    got = G.annotate(spark.createDataFrame([("x:1",)], "row_id string"), "test-upper").first()
    assert (got.value, got.leaf, float(got.score), got.tool) == ("x:1", "", 0.1235, "test-upper")
    assert G.Domain("birds.kind", "sound", ("a", "none")).abstains and not G.Domain("birds.kind", "sound", ("a",)).abstains


def test_loaded_heads_serve(spark, tmp_path):
    """Heads are fitted, calibrated, saved and loaded; the loaded ones and their calibration drive the router's decisions on rows that the fit never saw."""
    from pyspark.sql import functions as F

    from canopy.operators import serve as S

    r = np.random.default_rng(8)
    base = r.normal(size=(6, 8)) * 2
    x = [(i, (base[i % 6] + r.normal(size=8) * 0.5).tolist(), i % 6) for i in range(360)]
    v = spark.createDataFrame(x, "vec_id long, embedding array<double>, label int")
    gold = v.select("vec_id", F.lit("sound.kind").alias("attr"), F.concat(F.lit("c"), F.floor(F.col("label") / 2).cast("string")).alias("value"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("leaf"), F.lit(1.0).alias("y"))
    train = v.filter("vec_id % 5 > 1")
    bare = gold.withColumn("leaf", F.when(F.col("vec_id") % 10 == 0, "").otherwise(F.col("leaf")))
    m = H.fitted(train, bare, 1e-3, "softmax", maxIter=60)
    held = v.filter("vec_id % 5 = 0")
    m = L.calibrated(m, L.calibrate(m.node_scores(held, "vec_id"), gold.join(held.select("vec_id"), "vec_id", "left_semi")))
    m.write().save(str(tmp_path / "m"))
    again = L.NodeHeadsModel.load(str(tmp_path / "m"))
    cal = again.calibration[0]
    assert cal["skill"] > 0.9 and cal["floor"] == 0.0 and cal["leaf_threshold"] < 1
    rows = v.filter("vec_id % 5 = 1").select(F.col("vec_id").alias("clip"), F.col("vec_id").alias("row_id"), F.lit("g3").alias("grid"), F.lit("r").alias("router"), "embedding")
    scores = again.node_scores(rows, "clip", "row_id", "grid", "router")
    attrs = spark.createDataFrame([("sound.kind", "r", "g3", False, "clip", False, False, cal["temperature"], cal["floor"], 0.0, cal["leaf_threshold"])], "attr string, router string, grid string, multi boolean, scope string, many boolean, leaves boolean, temperature double, floor double, threshold double, leaf_threshold double")
    got = S.decided(scores, attrs).collect()
    assert len(got) == 72 and np.mean([g.value == f"c{g.clip % 6 // 2}" for g in got]) > 0.95
    served = [g for g in got if g.leaf]
    assert len(served) > 40 and np.mean([g.leaf == f"l{g.clip % 6}" for g in served]) > 0.9


def test_language_head_counts_grams_once(spark):
    """Grams and weights against a plain count; a text that is null or empty has none and is answered all the same."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from canopy.learn import heads as H

    texts = ["Abab a", "", None, "x", "\U0001f600\U0001f600b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["l"] * 5), pa.array([0.0] * 5), pa.array([False] * 5), pa.array(texts)], ["id", "lang", "label", "held", "text"])
    (out,) = H._grams(iter([batch]))
    for text, g, n in zip(texts, out.column("g").to_pylist(), out.column("n").to_pylist(), strict=True):
        a = [ord(c) for c in (text or "").lower()]
        assert dict(zip(g, n, strict=True)) == Counter(a + [(x + 1 << 21) | y for x, y in zip(a, a[1:])]) and g == sorted(g)
    known = np.array(sorted([ord("a"), ord("b"), (ord("a") + 1 << 21) | ord("b")]), "<i8")
    (w,) = H._weighed(known)(iter([out]))
    rows = w.column("tf").to_pylist()
    assert [r["indices"] for r in rows] == [[0, 1, 2], [], [], [], [1]] and np.allclose(rows[0]["values"], 1 + np.log([3, 2, 2])) and {r["size"] for r in rows} == {3}
    t = spark.createDataFrame([(i, ("abc " if i % 2 else "xyz ") * 3 if i else None, "ab" if i % 2 else "xy") for i in range(40)], "id long, text string, lang string")
    p, acc = H.language_head(t, t.id % 7 == 0)
    assert p.count() == 40 and acc > 0.8

"""Queries against their SQL on the small tables, and worked values of single operators."""

import math
import os
from decimal import Decimal

import pytest

from canopy.plans import catalog, label_queries, model_queries, serve_queries, text_queries  # noqa: F401

SF = "/root/testdata/sf0.001"

def flat(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return None if math.isnan(float(v)) else round(float(v), 5) + 0.0
    return str(v)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    want = con.execute(catalog.ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    key = lambda r: tuple(map(str, r))
    rows = sorted((tuple(flat(r[c]) for c in cols) for r in got.collect()), key=key)
    assert rows == sorted((tuple(map(flat, r)) for r in want.fetchall()), key=key)
    assert rows, "a comparison of nothing with nothing"


def test_split_numbers_few_rows(spark):
    """The window sees the first ids only, and the parts are those of the SQL, nulls last."""
    df = spark.createDataFrame([(i,) for i in [None, *range(300, 0, -1), 5, 5]], "id long")
    out = serve_queries.dev_shot_split(df)
    assert "GlobalLimit 103" in out._jdf.queryExecution().optimizedPlan().toString()
    want = {i: "select" if i <= 100 else "shots" if i <= 103 else "test" for i in range(1, 301)} | {None: "test"}
    assert sorted((str(r.id), r.part) for r in out.collect()) == sorted((str(i), p) for i, p in want.items())


def test_registry():
    assert len(catalog.QUERIES) > 170 and set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_chunk_grid_values(spark):
    from pyspark.sql import functions as F

    from canopy.operators.chunks import chunk_grid

    df = spark.createDataFrame([(10.0,), (11.0,), (2.0,), (0.3,), (200.0,)], "d double")
    n = [len(r[0]) for r in df.select(chunk_grid(F.col("d"), 3.0)).collect()]
    assert n == [3, 4, 1, 0, 20]


def test_segment_events_closes_gaps(spark):
    from canopy.operators.intervals import segment_events

    p = [0.1, 0.5, 0.5, 0.5, 0.1, 0.1, 0.4, 0.4, 0.4, 0.2, 0.0, 0.0, 0.0, 0.0, 0.9]
    f = spark.createDataFrame([(1, "x", i, v) for i, v in enumerate(p)], "clip long, label string, t int, p double")
    got = [(round(r.t0, 2), round(r.t1, 2), r.peak) for r in segment_events(f, 0.3, 0.15).collect()]
    assert got == [(0.1, 1.0, 0.5)]  # the last frame alone is too short


def test_closure_survives_cycles(spark):
    from canopy.operators.graph import closure, resolve_chains

    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8), (8, 9)], "child long, parent long")
    got = {(r.child, r.ancestor): r.depth for r in closure(e).collect()}
    assert got[7, 9] == 2 and got[1, 3] == 2 and (1, 1) not in got
    r = {x.name: x.target for x in resolve_chains(e.selectExpr("child name", "parent `to`")).collect()}
    assert r[7] == 9 and r[1] == 2


def test_names(spark):
    from pyspark.sql import functions as F

    from canopy.functions import text as X

    df = spark.createDataFrame([("glass shattering", "shattering glass"), ("door slam", "door slamming"), ("rock music", "rock"), ("announcement", "announcing")], "a string, b string")
    assert all(r[0] == r[1] for r in df.select(X.norm_key(F.col("a")), X.norm_key(F.col("b"))).collect())
    leaf = spark.createDataFrame([("Small Dog, barking", "dog"), ("dog", "dog"), ("3 dogs", "x"), ("one two three four five", "x"), (None, "x")], "l string, p string")
    assert [r[0] for r in leaf.select(X.clean_leaf(F.col("l"), F.col("p"))).collect()] == ["small dog", "", "", "", ""]
    why = spark.createDataFrame([("low tone", "high tone"), ("two 2", "two 3"), ("no bell", "bell"), ("bell", "bells")], "a string, b string")
    assert [r[0] for r in why.select(X.may_merge(F.col("a"), F.col("b"), [(["low"], ["high"])])).collect()] == ["polarity", "numeric", "negation", None]


def test_missing_path_has_no_rows(spark, tmp_path):
    from canopy.sources.readers import read_jsonl

    got = read_jsonl(spark, str(tmp_path / "none"), "a long, b string")
    assert got.columns == ["a", "b"] and got.count() == 0


def test_batches_stay_apart(spark):
    from canopy.sources.readers import upsert_features

    rows = spark.createDataFrame([(i, f"{'abc'[i % 3]} {i}", "abc"[i % 3]) for i in range(200)], "row_id long, text string, clip string")

    def embed(texts):
        if len({t[0] for t in texts}) > 1 or len(texts) > 20:
            raise ValueError(texts)
        return [[1.0, 2.0] for _ in texts]

    assert upsert_features(rows, None, embed, apart=("clip",), most=20).count() == 200


def test_gates_raise(spark):
    from canopy.operators.labels import quality_gates, require

    g = quality_gates([("enough", spark.range(3).selectExpr("count(*) measured"), ">=", 5)])
    with pytest.raises(ValueError, match="enough"):
        require(g)


def test_empty_inputs(spark):
    from canopy.operators import intervals as I
    from canopy.operators import tree as T

    f = spark.createDataFrame([], "clip long, label string, t int, p double")
    assert I.segment_events(f, 0.3, 0.15).count() == 0
    l = spark.createDataFrame([], "row_id string, clip long, source long, attr string, value string, leaf string, tool string, score double, seq int")
    assert T.admit_nodes(T.node_support(l)).count() == 0


def test_merge_guards(spark):
    from pyspark.sql import functions as F

    from canopy.functions import text as X

    cases = [
        ("fast tempo", "slow tempo", "polarity"), ("3/4 time signature", "4/4 time signature", "numeric"), ("gunshot", "no gunshot", "negation"), ("synth", "dark synth", None), ("soft murmur", "quiet murmur", None),
        ("four-on-the-floor", "4 on the floor", None), ("low-pitched high-volume", "low-pitched", "polarity"),
    ]
    df = spark.createDataFrame(cases, "a string, b string, why string")
    norm = lambda c: X.guard_normalise(F.col(c))
    assert [r[0] for r in df.select(X.may_merge(norm("a"), norm("b"))).collect()] == [c[2] for c in cases]
    words = spark.createDataFrame([(w,) for w in ("announcements", "announcing", "announcer", "chatting", "running", "houses", "sandpapering", "sandpaper", "kids", "hens")], "w string")
    assert [r[0] for r in words.select(X.stem(F.col("w"))).collect()] == ["announc", "announc", "announc", "chat", "run", "hous", "sandpap", "sandpap", "child", "chicken"]


def test_synonym_merge(spark):
    """The rounds give what one pass in order of support gives."""
    import numpy as np

    from canopy.functions import text as X
    from canopy.operators.entity import near_misses, synonym_merge

    r = np.random.default_rng(2)
    rows = []
    for g in ("a", "b"):
        base = r.normal(size=(8, 12))
        for i in range(40):
            v = base[i % 8] + r.normal(size=12) * r.choice([0.05, 0.3, 0.6])
            rows.append((g, f"{'two ' if i % 9 == 4 else ''}word{chr(97 + i % 26)}{chr(97 + i // 26)}", int(r.integers(1, 6)), (v / np.linalg.norm(v)).tolist()))
    df = spark.createDataFrame(rows, "grp string, name string, support int, x array<double>")
    got = {(x.grp, x["name"]): x.head for x in synonym_merge(df, ("grp",), 0.8, 0.9).collect()}
    want, numbered = {}, lambda n: n.startswith("two ")
    for g in ("a", "b"):
        heads = []
        for _, n, _, v in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], x[1])):
            hit = next((h for h, u in heads if float(np.dot(u, v)) >= 0.9 and numbered(h) == numbered(n)), None)
            want[g, n] = hit or n
            heads += [] if hit else [(n, v)]
    assert got == want and any(a[1] != b for a, b in got.items()) and X.AXES
    assert {x.why for x in near_misses(df, ("grp",), 0.8, 0.12, 0.9).collect()} >= {"near miss", "not synonyms"}


def test_group_occurrences(spark):
    from canopy.operators.intervals import group_occurrences

    ev = [("a", 0.0, 2.0, 0.9), ("b", 0.1, 2.1, 0.8), ("c", 5.0, 6.0, 0.7), ("a", 5.1, 6.0, 0.6), ("d", 0.9, 2.9, 0.5), ("e", 9.0, 9.5, 0.4)]
    got = {(x.label, x.t0, x.t1, x.peak) for x in group_occurrences(spark.createDataFrame([(1, *e) for e in ev], "clip long, label string, t0 double, t1 double, peak double")).collect()}
    groups = []
    iou = lambda x, y: max(0.0, min(x[2], y[2]) - max(x[1], y[1])) / max(1e-6, max(x[2], y[2]) - min(x[1], y[1]))
    for e in sorted(ev, key=lambda e: -e[3]):
        at = next((g for g in groups if any(iou(e, m) >= 0.5 for m in g)), None)
        groups.append([e]) if at is None else at.append(e)
    assert got == {(" / ".join(sorted(m[0] for m in g)), min(m[1] for m in g), max(m[2] for m in g), max(m[3] for m in g)) for g in groups}


def test_heads_learn(spark):
    """Heads beat chance by far on rows that the fits never see."""
    import numpy as np
    from pyspark.sql import functions as F

    from canopy.learn import heads as H

    r = np.random.default_rng(5)
    base = r.normal(size=(10, 16))
    v = spark.createDataFrame([(i, (base[i % 10] + r.normal(size=16) * 0.7).tolist(), i % 10) for i in range(400)], "vec_id long, embedding array<double>, label int")
    share = lambda df: df.filter("held").selectExpr("avg(cast(gold = pred as double))").first()[0]
    held = F.col("vec_id") % 7 == 0
    fields = v.select("vec_id", F.inline(F.array(F.struct(F.lit("half").alias("field"), F.when(F.col("label") < 5, "low").otherwise("high").alias("value")), F.struct(F.lit("few").alias("field"), F.concat(F.lit("x"), F.floor(F.col("vec_id") / 5).cast("string")).alias("value")))))
    p = H.property_heads(v, fields, held)
    assert share(p) > 0.8 and {x.field for x in p.select("field").distinct().collect()} == {"half"}  # `few` has no class of ten rows
    assert share(H.domain_head(v, 8, 9, held)) > 0.7
    leaf = F.when(F.col("vec_id") % 9 == 1, "").otherwise(F.concat(F.lit("leaf "), (F.col("label") % 2).cast("string")))
    t = v.select("vec_id", F.when(F.col("vec_id") % 11 == 2, F.lit(None)).otherwise(F.concat(F.lit("class "), F.floor(F.col("label") / 2).cast("string"))).alias("value"), leaf.alias("leaf"))
    p = H.router_head(v, t, held)
    assert p.count() == 400 and share(p.filter("gold is not null")) > 0.8 and p.filter("not startswith(leaf, pred)").count() == 0
    t = v.select("vec_id", F.inline(F.array(*[F.struct(F.lit(a).alias("attr"), y.cast("int").alias("y")) for a, y in (("odd", F.col("label") % 2 == 1), ("rare", F.col("vec_id") < 5))])))
    q = H.question_heads(v, t, held)
    assert {x.attr for x in q.select("attr").distinct().collect()} == {"odd"}
    assert q.filter("held").selectExpr("avg(case when y = 1 then p end) - avg(case when y = 0 then p end)").first()[0] > 0.5
    n = catalog.QUERIES["language_head"](spark, SF).filter("held")
    assert n.selectExpr("avg(cast(lang = pred as double))").first()[0] > 0.85


def test_stream_closes_open_events(spark, tmp_path):
    """Frames in shuffled files, an event that is still open at the end, and a flush."""
    import random

    from pyspark.sql import functions as F

    from canopy.operators.intervals import segment_events
    from canopy.streaming.jobs import segment_stream, state_store

    r = random.Random(1)
    rows = [(c, lab, t, r.choice([0.05, 0.2, 0.4, 0.8])) for c in range(3) for lab in ("x", "y") for t in range(60)] + [(9, "z", t, 0.9) for t in range(5)]
    r.shuffle(rows)
    f = spark.createDataFrame(rows, "clip long, label string, t int, p double").withColumn("ts", F.timestamp_millis(F.col("t") * 100 + 10**12))
    at = str(tmp_path / "in")
    f.repartition(3).write.parquet(at)
    f.limit(1).select(F.lit(-1).cast("long").alias("clip"), F.lit("").alias("label"), F.lit(0).alias("t"), F.lit(None).cast("double").alias("p"), F.timestamp_millis(F.lit(2 * 10**12)).alias("ts")).write.mode("append").parquet(at)
    s = segment_stream(spark.readStream.schema(f.schema).parquet(at), 0.3, 0.15)
    with state_store(spark):
        q = s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    flat_ = lambda df: sorted((x.clip, x.label, round(x.t0, 4), round(x.t1, 4), x.peak) for x in df.collect())
    got = flat_(spark.read.schema(s.schema).parquet(str(tmp_path / "out")))
    assert got == flat_(segment_events(f, 0.3, 0.15)) and (9, "z", 0.0, 0.5, 0.9) in got


def test_vocabulary_of_many_names(spark):
    """100,000 names against brute force: overlaps, names inside names, punctuation, and matches that touch."""
    import random
    import re

    from canopy.operators.items import vocabulary, vocabulary_match

    r = random.Random(3)
    words = [a + b + c for a in "ka lo mi ne ru ta wi zu".split() for b in "ban del fir gon hul jam".split() for c in ("", "e", "s", "o")]
    names = list({" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(140_000)})[:100_000]
    nodes = spark.createDataFrame([("a.b", n.upper() + " (kind)", None) for n in names] + [("a.b", "Sound", "ox"), ("c.d", names[0], "other")], "attr string, value string, leaf string")
    texts = [(i, " ".join(r.choice(words) + r.choice(["", "", "", ",", " -", "."]) for _ in range(120))) for i in range(30)] + [(100, None), (101, ""), (102, "...")]
    v = vocabulary(nodes)
    assert v.count() == len(names) and len(v.filter(v["name"] == names[0]).first().hits) == 2
    got = sorted((x.id, x.place, x.name) for x in vocabulary_match(spark.createDataFrame(texts, "id long, text string"), v).collect())
    known, want = set(names), []
    for i, t in texts:
        p, at = re.sub("[^a-z0-9 ]+", " ", (t or "").lower()).strip(" ").split(" "), 0
        while at < len(p):
            hit = next((m for m in (4, 3, 2, 1) if " ".join(p[at : at + m]) in known and at + m <= len(p)), None)
            want += [(i, at + 1, " ".join(p[at : at + hit]))] if hit else []
            at += hit or 1
    assert got == sorted(want) and len(want) > 500
    assert vocabulary_match(spark.createDataFrame(texts, "id long, text string"), v.limit(0)).count() == 0


def test_vocabulary_match_shuffles_texts_only(spark):
    """Matches stay in their text's task: texts are dealt once by id, and no exchange of matches follows; long texts in which names run into each other are settled whole."""
    import re

    from canopy.operators.items import asked_attributes, vocabulary_match

    names = ["aa", "bb", "aa bb", "bb aa cc", "cc"]
    words = [["aa", "bb", "cc", "dd"][(i * i + i // 7) % 4] for i in range(3000)]
    v = spark.createDataFrame([(n, [(f"k{i % 2}", n)]) for i, n in enumerate(names)], "name string, hits array<struct<attr:string,value:string>>")
    texts = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "dd")], "id long, text string")
    got = vocabulary_match(texts, v)
    plan = got._jdf.queryExecution().executedPlan().toString()
    want, i = [], 0
    while i < len(words):
        m = max((len(n.split()) for n in names if words[i : i + len(n.split())] == n.split()), default=0)
        want += [(1, i + 1, " ".join(words[i : i + m]))] if m else []
        i += m or 1
    assert sorted(tuple(r) for r in got.collect()) == want
    assert re.findall(r"Exchange hashpartitioning\((?:id|place|name)#", plan) == ["Exchange hashpartitioning(id#"]
    assert sorted((r.id, r.attrs) for r in asked_attributes(texts, v).collect()) == [(1, ["k0", "k1"]), (2, []), (3, [])]


@pytest.mark.parametrize("most", [0, 5, 60, 150])
def test_vocabulary_beyond_the_broadcast(spark, monkeypatch, most):
    """Names above the limit give the rows of a loop, too, and no exchange deals places: only texts, and runs that are marked as names left over, are shuffled."""
    import random
    import re

    from canopy.operators import items as Q

    r = random.Random(5)
    words = [a + b for a in "ka lo mi ne ru".split() for b in "ban del fir gon".split()]
    names = sorted({" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(200)})
    texts = [(i, " ".join(r.choice(words) for _ in range(150))) for i in range(20)] + [(100, None), (101, "")]
    want = []
    for i, t in texts:
        p, at = (t or "").split(" "), 0
        while at < len(p):
            hit = next((m for m in (4, 3, 2, 1) if at + m <= len(p) and " ".join(p[at : at + m]) in names), None)
            want += [(i, at + 1, " ".join(p[at : at + hit]))] if hit else []
            at += hit or 1
    monkeypatch.setattr(Q, "NAMES", most)
    v = spark.createDataFrame([(n, [(f"k{i % 3}", n)]) for i, n in enumerate(names)], "name string, hits array<struct<attr:string,value:string>>")
    df = spark.createDataFrame(texts, "id long, text string")
    got = Q.vocabulary_match(df, v)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) and len(want) > 300
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "hashpartitioning(w#" not in plan
    assert len(re.findall(r"Exchange hashpartitioning\(id#\d+L, \d+\), REPARTITION_BY_NUM", plan)) == plan.count("Exchange hashpartitioning(id#") <= 3
    kinds = {n: f"k{i % 3}" for i, n in enumerate(names)}
    attrs = {i: sorted({kinds[n] for j, _, n in want if j == i}) for i, _ in texts}
    assert {x.id: x.attrs for x in Q.asked_attributes(df, v).collect()} == attrs
    kept = {x.name for x in Q._marked(v.select("name"), v.filter("name >= 'm'").select("name")).collect()}
    assert {n for n in names if n >= "m"} <= kept


@pytest.mark.parametrize("name", ["label_durations", "node_time_spans", "derived_lines"])
def test_interval_sql_leaves_ties_no_choice(spark, con, tmp_path, name):
    """Many spans of equal times: SQL and query give the same rows on a table that DuckDB sorts in several threads."""
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("create table events as select i event_id, timestamp '2026-01-01' ts, (hash(i) % 9000)::bigint user_id, ['click','view','buy','add','look'][1 + (hash(i + 1000000) % 5)::int] event_type, 0.5::double as value, '' props from range(0, 600000) r(i)")
    c.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    want = c.execute(catalog.ORACLES[name])
    cols = [d[0] for d in want.description]
    rows = sorted(tuple(map(flat, r)) for r in want.fetchall())
    assert rows == sorted(tuple(flat(r[k]) for k in cols) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())


def test_manifest_without_refusals(spark):
    """A list of reasons is null where nothing is refused, as in the SQL, and that of sources where there are no rows."""
    from canopy.operators.tree import publish_manifest

    labels = spark.createDataFrame([("1:1", 1, 3, "a")], "row_id string, clip long, source long, attr string")
    nodes = spark.createDataFrame([("v", "", None), ("v", "l", None)], "value string, leaf string, refused string")
    r = publish_manifest(labels, nodes).first()
    assert (r.clips, r.classes, r.leaves, r.refused, r.by_source, r.by_reason) == (1, 1, 1, 0, "3=1", None)
    assert publish_manifest(labels.limit(0), nodes).first().by_source is None


def test_open_windows_hold_no_spans(spark):
    """Equal to a loop, on a clip with many windows and spans; no row or group holds a clip's spans."""
    from canopy.operators import serve as S

    windows = [(i % 3 if i % 7 else 3, f"e{i % 2}", i, float(i % 40), float(i % 40 + 3 + i % 2)) for i in range(300)]
    spans = [(0, float(i), i + 1.5) for i in range(2, 30, 9)] * 3 + [(1, 5.0, 5.0), (1, 100.0, 101.0), (2, 60.0, 61.0)]
    asked = [(0, True), (1, False), (2, True), (3, True), (3, None)]
    out = S.open_windows(spark.createDataFrame(windows, "clip long, encoder string, row_id long, t0 double, t1 double"), spark.createDataFrame(spans, "clip long, t0 double, t1 double"), spark.createDataFrame(asked, "clip long, asked boolean"))
    hit = {w for w in windows if any(c == w[0] and w[3] < b and a < w[4] for c, a, b in spans)}
    some = {w[:2] for w in hit}
    want = {(w[0], w[1], w[2], w[0] == 3) for w in windows if w in hit or (w[:2] not in some and w[0] in (0, 2, 3))}
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want) and 0 < len(hit) < 200
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan

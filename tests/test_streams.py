"""Streams with state that ends."""

import random

from canopy.sources import readers as R
from canopy.streaming import jobs as J


def test_ingest_frees_state(spark, tmp_path):
    """Files come one by one: records before, with and after their clip's marker, repeated ones, and a clip that is never finished."""
    rec = lambda clip, i, tool="t": (f"{clip}:{i}", "a.b", "v", None if i % 2 else "leaf", 0.5, tool, None)
    mark = lambda clip: (None, None, None, None, None, None, clip)
    files = [
        [rec(c, i) for c in "xyz" for i in range(20)] + [rec("x", 1)],  # held, one record twice
        [rec("x", 3), rec("x", 20), mark("x")],  # repeated, new, and x's end
        [mark("y"), mark("q")],  # y ends with what is held, q has nothing
        [rec("x", 5), rec("x", 21), rec("y", 0, "other"), mark("x")],  # after the end: repeated, new, of another tool
    ]
    src, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for no, rows in enumerate(files):
        spark.createDataFrame(rows, R.RECORD).coalesce(1).write.mode("append").json(src)
        q = J.label_ingest(spark, src, R.RECORD, sink, state)
        q.awaitTermination()
        last = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        held = last if no == 0 else held
        if no == 2:
            assert last < held  # only z still holds its records
    keys = [(f"x:{i}", "t") for i in range(22)] + [(f"y:{i}", "t") for i in range(20)] + [("y:0", "other")]
    got = sorted((x.row_id, x.tool) for x in spark.read.schema(R.RECORD).parquet(f"{sink}/*").collect())
    assert got == sorted(keys)
    # a restart finds nothing to do
    q = J.label_ingest(spark, src, R.RECORD, sink, state)
    q.awaitTermination()
    assert sorted((x.row_id, x.tool) for x in spark.read.schema(R.RECORD).parquet(f"{sink}/*").collect()) == sorted(keys)
    assert spark.conf.get(J.PROVIDER) != J.STORE


def test_segments_over_many_batches(spark, tmp_path):
    """Frames that come out of order over several batches, and state that is gone once series are closed."""
    import random

    from pyspark.sql import functions as F

    from canopy.operators.intervals import segment_events

    r = random.Random(4)
    rows = [(c, "x", t, r.choice([0.05, 0.2, 0.4, 0.8])) for c in range(2) for t in range(200)]
    rows.sort(key=lambda x: x[2] // 40 + r.random() * 0.9)  # shuffled inside about forty frames
    f = spark.createDataFrame(rows, "clip long, label string, t int, p double").withColumn("ts", F.timestamp_millis(F.col("t") * 100 + 10**12))
    src, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = f.schema
    for lo in range(0, len(rows), 80):
        spark.createDataFrame(rows[lo : lo + 80], "clip long, label string, t int, p double").withColumn("ts", F.timestamp_millis(F.col("t") * 100 + 10**12)).coalesce(1).write.mode("append").parquet(src)
    f.limit(1).select(F.lit(-1).cast("long").alias("clip"), F.lit("").alias("label"), F.lit(0).alias("t"), F.lit(None).cast("double").alias("p"), F.timestamp_millis(F.lit(2 * 10**12)).alias("ts")).write.mode("append").parquet(src)
    s = J.segment_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), 0.3, 0.15, late="10 seconds")
    with J.state_store(spark):
        q = s.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(sink)
    q.awaitTermination()
    flat = lambda df: sorted((x.clip, x.label, round(x.t0, 4), round(x.t1, 4), x.peak) for x in df.collect())
    assert flat(spark.read.schema(s.schema).parquet(sink)) == flat(segment_events(f, 0.3, 0.15))
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1  # the row that closes the others


def test_segments_of_many_series_in_a_call(spark, tmp_path):
    """Series share calls by their bucket. One that ends gives its events out and is freed while frames of its bucket's other series, of the same batch, are not due yet."""
    from pyspark.sql import functions as F

    from canopy.operators.intervals import segment_events

    r = random.Random(5)
    rows = [(c, "xy"[c % 2], t, r.choice([0.05, 0.2, 0.4, 0.8])) for c in range(40) for t in range(30)] + [(40, "x", t, 0.8 if t % 9 > 3 else 0.0) for t in range(3000)] + [(41, 'a "b" \\é', t, 0.8) for t in range(5)]
    r.shuffle(rows)
    f = spark.createDataFrame(rows, "clip long, label string, t int, p double").withColumn("ts", F.timestamp_millis(F.col("t") * 100 + 10**12))
    src, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    f.repartition(3).write.parquet(src)
    s = J.segment_stream(spark.readStream.schema(f.schema).parquet(src), 0.3, 0.15, late="100 seconds", buckets=2)
    with J.state_store(spark):
        q = s.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(sink)
    q.awaitTermination()
    flat = lambda df: sorted((x.clip, x.label, round(x.t0, 4), round(x.t1, 4), x.peak) for x in df.collect())
    got = flat(spark.read.schema(s.schema).parquet(sink))
    want = flat(segment_events(f, 0.3, 0.15))
    assert [e for e in got if e[0] != 40] == [e for e in want if e[0] != 40]
    assert 0 < len([e for e in got if e[0] == 40]) < len([e for e in want if e[0] == 40])  # the last 100 seconds still wait
    assert set(got) <= set(want)


def test_ingest_settles_many_clips_in_a_call(spark, tmp_path):
    """Clips share calls by their bucket, so calls don't grow with the clips, and each clip keeps records, marker and repeats of its own."""
    rows = [(f"{c}:{i}", "a.b", "v", None, 0.5, "t", None) for c in range(300) for i in range(2)] + [(None,) * 6 + (str(c),) for c in range(0, 300, 2)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, R.RECORD).repartition(3).write.json(src)
    s = J.finished_records(spark.readStream.schema(R.RECORD).json(src), buckets=2)
    with J.state_store(spark, idle=False):
        q = s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = sorted(x.row_id for x in spark.read.schema(s.schema).parquet(str(tmp_path / "out")).collect())
    assert got == sorted(f"{c}:{i}" for c in range(0, 300, 2) for i in range(2))

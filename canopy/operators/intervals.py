"""Frame scores to events, interval algebra, and the timeline's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("clip", "label")


def median_smooth(frames: DataFrame, size: int = 5) -> DataFrame:
    """p replaced by the centred median over `size` frames, the edge frames repeated; series shorter than that stay."""
    h = size // 2
    w = W.partitionBy(*KEY).orderBy("t")
    near = F.collect_list("p").over(w.rowsBetween(-h, h))
    at, n = F.row_number().over(w), F.count("*").over(W.partitionBy(*KEY))
    first, last = F.first("p").over(w.rowsBetween(-h, h)), F.last("p").over(w.rowsBetween(-h, h))
    pad = lambda v, k: F.array_repeat(v, F.greatest(k, F.lit(0)).cast("int"))
    full = F.concat(pad(first, F.lit(h + 1) - at), near, pad(last, at + h - n))
    return frames.withColumn("p", F.when(n < size, F.col("p")).otherwise(F.element_at(F.array_sort(full), h + 1)))


def segment_events(frames: DataFrame, tau_on: float, tau_off: float, frame_s: float = 0.1, gap: float = 0.3, least: float = 0.2) -> DataFrame:
    """clip, label, t0, t1, peak: hysteresis runs (on from tau_on, off below tau_off), gaps under `gap` seconds closed, events under `least` seconds dropped.

    The state after a frame is that of the last decisive one. Series that never reach tau_on are dropped before any window.
    """
    loud = frames.groupBy(*KEY).agg(F.max("p").alias("_m")).filter(F.col("_m") >= tau_on).select(*KEY)
    f = frames.join(loud, list(KEY), "left_semi")
    w = W.partitionBy(*KEY).orderBy("t")
    mark = F.when(F.col("p") >= tau_on, 1).when(F.col("p") < tau_off, 0)
    f = f.withColumn("on", F.coalesce(F.last(mark, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    f = f.withColumn("start", F.when((F.col("on") == 1) & (F.coalesce(F.lag("on").over(w), F.lit(0)) == 0), 1).otherwise(0))
    runs = f.withColumn("run", F.sum("start").over(w)).filter("on = 1").groupBy(*KEY, "run").agg(F.min("t").alias("a"), (F.max("t") + 1).alias("b"), F.max("p").alias("peak"))
    u = W.partitionBy(*KEY).orderBy("a")
    runs = runs.withColumn("new", F.when((F.col("a") - F.lag("b").over(u)) * frame_s < gap, 0).otherwise(1))
    runs = runs.withColumn("island", F.sum("new").over(u)).groupBy(*KEY, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("peak").alias("peak"))
    return runs.filter((F.col("b") - F.col("a")) * frame_s >= least).select(*KEY, (F.col("a") * frame_s).alias("t0"), (F.col("b") * frame_s).alias("t1"), "peak")


def top_events(events: DataFrame, k: int = 10) -> DataFrame:
    """The k strongest events of each clip."""
    r = F.row_number().over(W.partitionBy("clip").orderBy(F.desc("peak"), "t0", "t1", "label"))
    return events.withColumn("_r", r).filter(F.col("_r") <= k).drop("_r")


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over the common extent of two intervals."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / F.greatest(F.lit(1e-6), F.greatest(a1, b1) - F.least(a0, b0))


def collapse_ancestors(events: DataFrame, ancestors: DataFrame, least: float = 0.5) -> DataFrame:
    """Events without those whose label is an ancestor of a co-occurring event's label (IoU >= least > 0). ancestors: label, ancestor. Events meet in seconds that both touch."""
    cell = lambda a, b: F.explode(F.sequence(F.floor(a), F.floor(b)))
    e = events.select("clip", "label", "t0", "t1").distinct().withColumn("_b", cell("t0", "t1"))
    o = events.select("clip", F.col("label").alias("_l"), F.col("t0").alias("_0"), F.col("t1").alias("_1")).distinct()
    o = o.join(ancestors.select(F.col("label").alias("_l"), F.col("ancestor").alias("label")).distinct().hint("merge"), "_l").withColumn("_b", cell("_0", "_1"))
    gone = e.join(o.hint("merge"), ["clip", "label", "_b"]).filter(iou(F.col("t0"), F.col("t1"), F.col("_0"), F.col("_1")) >= least).select("clip", "label", "t0", "t1").distinct()
    return events.join(gone.hint("merge"), ["clip", "label", "t0", "t1"], "left_anti").select(events.columns)


def label_durations(spans: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """Seconds that each label covers: the length of its intervals' union."""
    w = W.partitionBy(*by).orderBy("t0", "t1")
    s = spans.withColumn("_e", F.max("t1").over(w.rowsBetween(W.unboundedPreceding, -1)))
    s = s.withColumn("_i", F.sum(F.when(F.col("t0") > F.col("_e"), 1).otherwise(0)).over(w))
    return s.groupBy(*by, "_i").agg((F.max("t1") - F.min("t0")).alias("d")).groupBy(*by).agg(F.sum("d").alias("covered_s"))


def merged_spans(spans: DataFrame, by: tuple[str, ...], touch: float = 1e-6) -> DataFrame:
    """Touching or overlapping spans of a group as one, with the greatest p when there is such a column."""
    w = W.partitionBy(*by).orderBy("t0", "t1")
    s = spans.withColumn("_e", F.max("t1").over(w.rowsBetween(W.unboundedPreceding, -1)))
    s = s.withColumn("_i", F.sum(F.when(F.col("t0") > F.col("_e") + touch, 1).otherwise(0)).over(w))
    more = [F.max("p").alias("p")] if "p" in spans.columns else []
    return s.groupBy(*by, "_i").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), *more).drop("_i")


def first_appearance_order(events: DataFrame) -> DataFrame:
    """clip, labels in order of first onset, for clips with two or more."""
    f = events.groupBy(*KEY).agg(F.min("t0").alias("t0"))
    o = f.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("t0", "label"))).alias("o")).filter(F.size("o") >= 2)
    return o.select("clip", F.array_join(F.transform("o", lambda x: x["label"]), ", then ").alias("ordering"))


def frame_runs(frames: DataFrame, tau: float) -> DataFrame:
    """clip, label, a, b: runs of consecutive frames with p >= tau, end exclusive."""
    w = W.partitionBy(*KEY).orderBy("t")
    f = frames.filter(F.col("p") >= tau).withColumn("_g", F.col("t") - F.row_number().over(w))
    return f.groupBy(*KEY, "_g").agg(F.min("t").alias("a"), (F.max("t") + 1).alias("b")).drop("_g")


def event_cells(events: DataFrame) -> DataFrame:
    """(clip, label, second) cells that events touch."""
    return events.select(*KEY, F.explode(F.sequence(F.floor("t0"), F.greatest(F.ceil("t1") - 1, F.floor("t0")))).alias("second")).distinct()


def event_cell_f1(got: DataFrame, want: DataFrame) -> DataFrame:
    """F1 on (second, label) cells of two event lists, per clip and overall (clip null)."""
    a, b = event_cells(got).withColumn("g", F.lit(1)), event_cells(want).withColumn("w", F.lit(1))
    j = a.join(b.hint("merge"), [*KEY, "second"], "full_outer").rollup("clip").agg(F.count(F.when(F.col("g").isNotNull() & F.col("w").isNotNull(), 1)).alias("hit"), F.count("g").alias("n_got"), F.count("w").alias("n_want"))
    return j.withColumn("f1", 2.0 * F.col("hit") / (F.col("n_got") + F.col("n_want")))


def region_threshold(frames: DataFrame, windows: DataFrame, frame_s: float, thresholds: DataFrame) -> DataFrame:
    """row_id, label, score: the greatest p of a label within each window, where it reaches the label's threshold. Frames meet windows through a time bucket."""
    f = frames.select("clip", "label", "p", (F.col("t") * frame_s).alias("_t")).withColumn("_b", F.floor("_t"))
    w = windows.select("row_id", "clip", "t0", "t1").withColumn("_b", F.explode(F.sequence(F.floor("t0"), F.floor("t1"))))
    s = f.join(w.hint("merge"), ["clip", "_b"]).filter((F.col("_t") >= F.col("t0")) & (F.col("_t") < F.col("t1"))).groupBy("row_id", "label").agg(F.max("p").alias("score"))
    return s.join(thresholds.hint("merge"), "label").filter(F.col("score") >= F.col("threshold")).drop("threshold")


def strong_frames(spans: DataFrame, hop: float) -> DataFrame:
    """(clip, label, frame): floor(t0 / hop) to ceil(t1 / hop) - 1, at least one."""
    a, b = F.floor(F.col("t0") / hop), F.ceil(F.col("t1") / hop) - 1
    return spans.select(*KEY, F.explode(F.sequence(a, F.greatest(a, b))).alias("frame")).distinct()


def events_to_nodes(events: DataFrame, names: DataFrame) -> DataFrame:
    """Events renamed by the first node of their label (label, node, ord); others keep their label."""
    first = names.groupBy("label").agg(F.min_by("node", F.struct("ord", "node")).alias("node"))
    return events.join(first, "label", "left").withColumn("node", F.coalesce("node", "label"))


def _one(t: Column) -> Column:
    return F.format_string("%.1f", F.bround(t, 1))


def render_timeline(events: DataFrame) -> DataFrame:
    """clip, line: `[a-bs] label` by onset, one decimal, halves to even."""
    part = F.concat(F.lit("["), _one(F.col("t0")), F.lit("-"), _one(F.col("t1")), F.lit("s] "), F.col("label"))
    o = events.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("t0", "t1", part.alias("s")))).alias("o"))
    return o.select("clip", F.array_join(F.transform("o", lambda x: x["s"]), "; ").alias("line"))


def wanted_lines(spans: DataFrame, wants: DataFrame) -> DataFrame:
    """clip, lines: what a question wants of a timeline: longest and shortest label by covered seconds (ties by name), labels in order of first onset, numbers of events. wants: clip, duration, order, count.

    Lines that aren't wanted, and an order of fewer than two labels, are left out; clips without spans have none.
    """
    cover = label_durations(spans)
    first = spans.groupBy(*KEY).agg(F.min(F.struct("t0", "t1")).alias("at"), F.count("*").alias("n"))
    by = cover.join(first.hint("merge"), list(KEY)).groupBy("clip").agg(
        F.min_by(F.struct("label", "covered_s"), F.struct(-F.col("covered_s"), "label")).alias("hi"), F.min_by(F.struct("label", "covered_s"), F.struct("covered_s", "label")).alias("lo"),
        F.array_sort(F.collect_list(F.struct("at", "label", "n"))).alias("o"),
    )
    timed = lambda c: F.concat(F.col(f"{c}.label"), F.lit(" ("), _one(F.col(f"{c}.covered_s")), F.lit(" s)"))
    long = F.concat(F.lit("Longest: "), timed("hi"), F.when(F.col("lo.label") != F.col("hi.label"), F.concat(F.lit("; shortest: "), timed("lo"))).otherwise(""), F.lit("."))
    order = F.concat(F.lit("Order: "), F.array_join(F.transform("o", lambda x: x["label"]), ", then "), F.lit("."))
    n = F.concat(F.lit("Occurrences: "), F.array_join(F.transform("o", lambda x: F.concat(x["label"], F.lit(" x"), x["n"].cast("string"))), ", "), F.lit(" ("), F.size("o").cast("string"), F.when(F.size("o") == 1, " distinct sound).").otherwise(" distinct sounds)."))
    out = by.join(wants.hint("merge"), "clip")
    return out.select("clip", F.concat_ws(" ", F.when(F.col("duration"), long), F.when(F.col("order") & (F.size("o") >= 2), order), F.when(F.col("count"), n)).alias("lines"))


def group_occurrences(events: DataFrame, least: float = 0.5) -> DataFrame:
    """Greedy by peak: an event joins the first group with a member at IoU >= least. One fold over each clip's sorted events, which top_events() bounds."""
    e = F.struct((-F.col("peak")).alias("q"), "t0", "t1", "label")
    by = events.groupBy("clip").agg(F.array_sort(F.collect_list(e)).alias("es"))
    none = F.expr("cast(array() as array<array<struct<q:double,t0:double,t1:double,label:string>>>)")
    near = lambda g, x: F.exists(g, lambda m: iou(m["t0"], m["t1"], x["t0"], x["t1"]) >= least)

    def put(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda g: near(g, x)), True)
        return F.when(at > 0, F.transform(acc, lambda g, i: F.when(i + 1 == at, F.array_append(g, x)).otherwise(g))).otherwise(F.array_append(acc, F.array(x)))

    g = by.select("clip", F.explode(F.aggregate("es", none, put)).alias("g"))
    return g.select("clip", F.array_join(F.array_sort(F.transform("g", lambda m: m["label"])), " / ").alias("label"), F.array_min(F.transform("g", lambda m: m["t0"])).alias("t0"), F.array_max(F.transform("g", lambda m: m["t1"])).alias("t1"), F.array_max(F.transform("g", lambda m: -m["q"])).alias("peak"))

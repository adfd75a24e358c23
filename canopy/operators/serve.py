"""Serving: gates, ranked choices, back-off, and the text context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workers import attach, cut


def region_gate(scores: DataFrame, chunk_at: float = 0.5, clip_at: float = 0.5) -> DataFrame:
    """clip, row_id (null: the clip), region: chunks whose sigmoid reaches chunk_at, and clips whose mean does. scores: clip, row_id, region, logit."""
    p = scores.withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))
    rows = p.filter(F.col("p") >= chunk_at).select("clip", "row_id", "region")
    clips = p.groupBy("clip", "region").agg(F.avg("p").alias("m")).filter(F.col("m") >= clip_at).select("clip", F.lit(None).cast("long").alias("row_id"), "region")
    return rows.unionByName(clips)


def decide_single(scores: DataFrame, temperature: float | Column, floor: float | Column, by: tuple[str, ...] = ("clip",), row: str = "row_id", leaves: DataFrame | None = None, leaf_at: float = 0.5) -> DataFrame:
    """by, value, p: softmax per row at the temperature, the mean log-probability over rows, its exponential (not renormalised), the best class if it reaches the floor (its skill's).

    With leaves (by, value, leaf, p) also `leaf`: the class's best leaf if it reaches leaf_at, else '' (the class itself).
    """
    z = scores.withColumn("_z", F.col("logit") / temperature)
    w = W.partitionBy(*by, row)
    m = F.max("_z").over(w)
    z = z.withColumn("_m", m).withColumn("_lp", F.col("_z") - F.col("_m") - F.log(F.sum(F.exp(F.col("_z") - F.col("_m"))).over(w)))
    c = z.groupBy(*by, "value").agg(F.exp(F.avg("_lp")).alias("p"))
    best = c.groupBy(*by).agg(F.min_by(F.struct("value", "p"), F.struct(-F.col("p"), "value")).alias("b"))
    best = best.select(*by, "b.value", "b.p").filter(F.col("p") >= floor)
    if leaves is None:
        return best
    top = leaves.groupBy(*by, "value").agg(F.min_by(F.struct("leaf", "p"), F.struct(-F.col("p"), "leaf")).alias("_l")).filter(F.col("_l.p") >= leaf_at)
    return best.join(top.hint("merge"), [*by, "value"], "left").select(*by, "value", "p", F.coalesce("_l.leaf", F.lit("")).alias("leaf"))


def decide_multi(scores: DataFrame, threshold: float, leaves: DataFrame) -> DataFrame:
    """vec_id, value, p, leaf: classes at or above the threshold, each with its leaves or once without. leaves: vec_id, value, leaf."""
    return scores.filter(F.col("p") >= threshold).join(leaves.hint("merge"), ["vec_id", "value"], "left")


def domain_abstain(scores: DataFrame, none: int, sure: float = 0.995) -> DataFrame:
    """vec_id, k: the best class; the none class only from `sure` on, else the best other."""
    order = F.struct(-F.col("p"), "k")
    g = scores.groupBy("vec_id").agg(F.max(F.when(F.col("k") == none, F.col("p"))).alias("pn"), F.min_by(F.when(F.col("k") != none, F.col("k")), F.when(F.col("k") != none, order)).alias("other"))
    return g.select("vec_id", F.when(F.col("pn") >= sure, none).otherwise(F.col("other")).alias("k"))


def top_classes(scores: DataFrame, k: int = 3, threshold: float = 0.2, by: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The best class always and up to k - 1 others at or above the threshold."""
    r = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("p"), "k"))
    return scores.withColumn("rank", r).filter((F.col("rank") <= k) & ((F.col("rank") == 1) | (F.col("p") >= threshold)))


def top_nodes(scores: DataFrame, k: int = 4, threshold: float = 0.05, by: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """top_classes over nodes; a class's own node goes when one of its leaves is served. scores: value, is_leaf, k, p."""
    t = top_classes(scores, k, threshold, by)
    has = F.max(F.col("is_leaf").cast("int")).over(W.partitionBy(*by, "value"))
    return t.withColumn("_h", has).filter((F.col("_h") == 0) | F.col("is_leaf")).drop("_h")


def top_leaves(scores: DataFrame, k: int = 3, threshold: float = 0.2, by: tuple[str, ...] = ("vec_id", "value")) -> DataFrame:
    """Up to k leaves of a class by softmax inside the class. scores: by, k, logit."""
    from .metrics import softmax

    p = softmax(scores, by)
    r = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("p"), "k"))
    return p.withColumn("rank", r).filter((F.col("rank") <= k) & (F.col("p") >= threshold))


def best_leaf(scores: DataFrame, threshold: float, by: tuple[str, ...] = ("vec_id", "value")) -> DataFrame:
    """by, k: the argmax inside the class if it is a leaf (k > 0) at or above the threshold, else 0 for the class itself. scores: k, p."""
    g = scores.groupBy(*by).agg(F.min_by(F.struct("k", "p"), F.struct(-F.col("p"), "k")).alias("b"))
    return g.select(*by, F.when((F.col("b.k") > 0) & (F.col("b.p") >= threshold), F.col("b.k")).otherwise(0).alias("k"))


def sound_identity(scores: DataFrame, windows: DataFrame, tau: float, classes: int = 2, leaves: int = 2) -> DataFrame:
    """clip, value, leaf, p: over a clip's open windows (all if none is open), the greatest joint probability by node, the top classes at or above tau, each with its top leaves at or above tau, else
    itself (leaf ''). scores: clip, row_id, value, leaf ('' for the class), p; windows: clip, row_id, open.
    """
    any_ = F.max(F.col("open").cast("int")).over(W.partitionBy("clip"))
    use = windows.withColumn("_a", any_).filter(F.col("open") | (F.col("_a") == 0)).select("clip", "row_id")
    m = scores.join(use.hint("merge"), ["clip", "row_id"], "left_semi").groupBy("clip", "value", "leaf").agg(F.max("p").alias("p")).filter(F.col("p") >= tau)
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("p"), "value", "leaf"))
    top = m.filter("leaf = ''").withColumn("_r", rank("clip")).filter(F.col("_r") <= classes).drop("_r")
    low = m.filter("leaf != ''").join(top.select("clip", "value").hint("merge"), ["clip", "value"], "left_semi").withColumn("_r", rank("clip", "value")).filter(F.col("_r") <= leaves).drop("_r")
    return top.join(low.select("clip", "value").hint("merge"), ["clip", "value"], "left_anti").unionByName(low).select("clip", "value", "leaf", "p")


def threshold_heads(scores: DataFrame, open_clips: DataFrame, at: float = 0.5) -> DataFrame:
    """clip, head, value, p: the best class of each head if it reaches `at`, for clips whose region is open."""
    b = scores.join(open_clips.select("clip").hint("merge"), "clip", "left_semi").groupBy("clip", "head").agg(F.min_by(F.struct("value", "p"), F.struct(-F.col("p"), "value")).alias("b"))
    return b.select("clip", "head", "b.value", "b.p").filter(F.col("p") >= at)


def chunk_region_filter(served: DataFrame, gate: DataFrame) -> DataFrame:
    return served.join(gate.select("row_id", "region").hint("merge"), ["row_id", "region"], "left_semi")


def transcript_override(served: DataFrame, heads: DataFrame, attr: str, least_chars: int = 8, at: float = 0.5) -> DataFrame:
    """One attribute's nodes replaced by the text head's class where the transcript is long enough and the head sure. heads: clip, text, value, p."""
    h = heads.filter((F.length("text") >= least_chars) & (F.col("p") >= at)).select("clip", F.lit(attr).alias("attr"), "value")
    return served.join(h.select("clip", "attr").hint("merge"), ["clip", "attr"], "left_anti").select("clip", "attr", "value").unionByName(h)


def question_fallback(items: DataFrame, asked_at: float = 0.5) -> DataFrame:
    """clips with any item score at or above asked_at. items: clip, score."""
    return items.groupBy("clip").agg(F.bool_or(F.col("score") >= asked_at).alias("asked"))


def item_nodes(items: DataFrame, nodes: DataFrame, asked_at: float = 0.5) -> DataFrame:
    """id and a clip's nodes for each of its items; nodes that the question fallback opened only for items whose own score reaches asked_at. items: id, clip, score; nodes: clip, fallback, .."""
    j = items.groupBy("id", "clip").agg(F.max("score").alias("_s")).join(nodes.hint("merge"), "clip")
    return j.filter(~F.col("fallback") | (F.col("_s") >= asked_at)).drop("_s", "fallback")


def owner_resolution(predicted: DataFrame) -> DataFrame:
    """clip, attr, value of the router with the greatest order that predicts the attribute. predicted: clip, attr, value, ord."""
    return predicted.groupBy("clip", "attr").agg(F.max_by("value", F.struct("ord", "value")).alias("value"))


def joint_probability(scores: DataFrame) -> DataFrame:
    """p of a leaf is p(class) times p(leaf); of a class p(attribute) times p(class). scores: vec_id, node, parent (null: root), p."""
    up = scores.select("vec_id", F.col("node").alias("parent"), F.col("p").alias("_pp"))
    return scores.join(up.hint("merge"), ["vec_id", "parent"], "left").withColumn("joint", F.col("p") * F.coalesce("_pp", F.lit(1.0))).select("vec_id", "node", "joint")


def trace_order(rows: DataFrame) -> DataFrame:
    """Adds seq: the clip row first, then by grid, then by start."""
    return rows.withColumn("seq", F.row_number().over(W.partitionBy("clip").orderBy((F.col("grid") != "clip").cast("int"), "grid", "t0")))


#: The lines of a context, its sizes, and where a served vocals node stands. Fixed values.
HEAD, NODES, MAX_NODES, MAX_TIMELINE = "Audio analysis of the recording:", "Audio graph nodes matched to this recording:", 2400, 600
SPOKEN, VOCALS, NO_VOCALS = "speech present", r"music vocals: ([^;\n]*)", "no vocals"


def label_text(attr: str = "attr", value: str = "value", leaf: str = "leaf"):
    """`class`, or `class (leaf)` where a leaf of another name is served."""
    return F.when((F.col(leaf) != "") & (F.col(leaf) != F.col(value)), F.concat(value, F.lit(" ("), leaf, F.lit(")"))).otherwise(F.col(value))


def clause_head(attr: str = "attr"):
    """`region attribute` of region.some_attribute."""
    return F.translate(F.col(attr), "._", "  ")


def nodes_line(served: DataFrame, last: tuple[str, ...] = (), most: int = MAX_NODES) -> DataFrame:
    """clip, line: each node once in order of arrival, grouped by attribute in order of arrival, cut at `most` characters; the attributes of `last` follow uncut. served: clip, attr, value, leaf, seq."""
    n = served.withColumn("s", label_text()).groupBy("clip", "attr", "s").agg(F.min("seq").alias("seq"))
    a = n.groupBy("clip", "attr").agg(F.min("seq").alias("q"), F.array_sort(F.collect_list(F.struct("seq", "s"))).alias("o"))
    text = F.concat(clause_head(), F.lit(": "), F.array_join(F.transform("o", lambda x: x["s"]), ", "))
    a = a.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("q", "attr", text.alias("s")))).alias("o"))
    part = lambda late: F.array_join(F.transform(F.filter("o", lambda x: x["attr"].isin(list(last)) == late), lambda x: x["s"]), "; ")
    a = a.select("clip", F.trim(F.substring(part(False), 1, most)).alias("m"), part(True).alias("d"))
    return a.select("clip", F.when(F.col("d") == "", F.col("m")).when(F.col("m") == "", F.col("d")).otherwise(F.concat(F.regexp_replace("m", r"\.$", ""), F.lit("; "), "d")).alias("line"))


def drop_clauses(lines: DataFrame, attrs: list[str]) -> DataFrame:
    """Rendered lines without the clauses of some attributes; a full stop at the end stays if a clause does."""
    heads = F.array(*[F.lit(a.replace(".", " ").replace("_", " ")) for a in attrs])
    dot = F.when(F.col("line").rlike(r"\.\s*$"), ".").otherwise("")
    clauses = F.split(F.regexp_replace(F.rtrim("line"), r"\.$", ""), "; ")
    keep = F.filter(clauses, lambda c: ~F.array_contains(heads, F.split_part(F.trim(c), F.lit(":"), F.lit(1))))
    return lines.withColumn("line", F.when(F.size(keep) == F.size(clauses), F.col("line")).when(F.size(keep) == 0, "").otherwise(F.concat(F.array_join(keep, "; "), dot)))


def hears_voice(text):
    """A context tells of speech, or of a served vocals node other than `no vocals`."""
    values = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(VOCALS), F.lit(1)), lambda v: F.split(v, ",")))
    named = F.transform(values, lambda v: F.regexp_replace(v, r"^[ .]+|[ .]+$", ""))
    return F.contains(text, F.lit(SPOKEN)) | F.exists(named, lambda v: (v != "") & (v != NO_VOCALS))


def render_context(nodes: DataFrame, timeline: DataFrame, transcript: DataFrame | None = None, most: int = MAX_TIMELINE, gate: bool = True) -> DataFrame:
    """clip, context: a head, the nodes, the timeline cut at `most` characters, and the transcript if a voice is heard (or gate is off); '' for clips of which nothing is known.

    nodes: clip, line; timeline: clip, line; transcript: clip, text.
    """
    c = nodes.select("clip", F.col("line").alias("n")).join(timeline.select("clip", F.col("line").alias("t")).hint("merge"), "clip", "full_outer")
    if transcript is not None:
        c = c.join(transcript.select("clip", F.col("text").alias("x")).hint("merge"), "clip", "full_outer")
    else:
        c = c.withColumn("x", F.lit(None).cast("string"))
    n = F.when(F.col("n") != "", F.concat(F.lit(NODES + " "), "n", F.when(F.endswith("n", F.lit(".")), "").otherwise(".")))
    t = F.when(F.col("t") != "", F.concat(F.substring(F.trim("t"), 1, most), F.lit(".")))
    head = F.concat_ws("\n", F.lit(HEAD), n, t)
    c = c.select("clip", "x", F.when(n.isNotNull() | t.isNotNull() | F.col("x").isNotNull(), head).alias("h"))
    full = F.concat("h", F.coalesce(F.concat(F.lit('\nTranscript: "'), "x", F.lit('"')), F.lit("")))
    quiet = F.col("x").isNotNull() & ~hears_voice(full) if gate else F.lit(False)
    return c.select("clip", F.when(F.col("h").isNull(), "").when(quiet, F.col("h")).otherwise(F.concat(full, F.lit("\n\n"))).alias("context"))


#: The grid whose chunks have a gate.
GATED = "g3"


def owners(attrs: DataFrame) -> DataFrame:
    """One row per attribute: that of the router with the greatest `ord`, as a later router takes an attribute over. attrs: attr, router, ord, .."""
    rest = [c for c in attrs.columns if c != "attr"]
    return attrs.groupBy("attr").agg(F.max_by(F.struct(*rest), "ord").alias("_o")).select("attr", "_o.*")


def open_windows(windows: DataFrame, spans: DataFrame, asked: DataFrame) -> DataFrame:
    """clip, encoder, row_id, by_question: of each clip and encoder the windows that overlap a span in which the gate heard sound; where there is none, all of them if an item asks about sound.

    windows: clip, encoder, row_id, t0, t1; spans: clip, t0, t1; asked: clip, asked. by_question: the clip has no span at all.
    """
    cell = F.explode(F.sequence(F.floor("t0"), F.floor("t1"))).alias("_b")
    windows = cut(windows.select("clip", "encoder", "row_id", "t0", "t1"))  # three steps read them
    spans = cut(spans.select("clip", "t0", "t1").distinct())
    # distinct times meet in seconds that both touch; no row holds a clip's spans
    mine = windows.select("clip", "t0", "t1").distinct().select("clip", "t0", "t1", cell)
    theirs = spans.select("clip", F.col("t0").alias("_0"), F.col("t1").alias("_1"), cell)
    met = mine.join(theirs.hint("merge"), ["clip", "_b"]).filter((F.col("t0") < F.col("_1")) & (F.col("_0") < F.col("t1")))
    hit = cut(met.select("clip", "t0", "t1", F.lit(True).alias("_hit")).distinct())
    some = spans.select("clip", F.lit(True).alias("_span")).distinct()
    q = asked.groupBy("clip").agg(F.bool_or("asked").alias("_q"))
    any_ = windows.join(hit.drop("_hit").hint("merge"), ["clip", "t0", "t1"], "left_semi").select("clip", "encoder", F.lit(True).alias("_any")).distinct()
    facts = cut(windows.select("clip", "encoder").distinct().join(some.hint("merge"), "clip", "left").join(q.hint("merge"), "clip", "left").join(any_.hint("merge"), ["clip", "encoder"], "left"))
    w = attach(attach(windows, hit, ["clip", "t0", "t1"]), facts, ["clip", "encoder"])
    return w.filter(F.col("_hit").isNotNull() | (F.col("_any").isNull() & F.coalesce("_q", F.lit(False)))).select("clip", "encoder", "row_id", F.col("_span").isNull().alias("by_question"))


def sound_nodes(sounds: DataFrame, windows: DataFrame, served: DataFrame, classes: int = 2, leaves: int = 2) -> DataFrame:
    """clip, attr, value, leaf, p, by_question: sound identity of every attribute by its own encoder and threshold: the greatest joint probability over the clip's windows, the top classes that reach the threshold, each
    with its top leaves that do, else itself. Attributes of context aren't served by a question alone.

    sounds: clip, encoder, row_id, attr, value, leaf ('' for the class), p; windows: as open_windows gives them; served: attr, encoder, tau, context (a row per attribute).
    """
    m = sounds.join(F.broadcast(served), ["attr", "encoder"]).join(windows.hint("merge"), ["clip", "encoder", "row_id"]).filter(~(F.col("by_question") & F.col("context")))
    m = m.groupBy("clip", "attr", "value", "leaf", "by_question").agg(F.max("p").alias("p"), F.first("tau").alias("tau")).filter(F.col("p") >= F.col("tau"))
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("p"), "value", "leaf"))
    top = m.filter("leaf = ''").withColumn("_r", rank("clip", "attr")).filter(F.col("_r") <= classes)
    key = ["clip", "attr", "value"]
    low = m.filter("leaf != ''").join(top.select(*key).hint("merge"), key, "left_semi").withColumn("_r", rank(*key)).filter(F.col("_r") <= leaves)
    out = top.join(low.select(*key).distinct().hint("merge"), key, "left_anti").unionByName(low)
    return out.select(*key, "leaf", "p", "by_question")


def decided(scores: DataFrame, attrs: DataFrame, none_at: float = 0.995, top: int = 3, top_at: float = 0.2) -> DataFrame:
    """clip, row_id (null: the clip), grid, attr, value, leaf, p: what the owners of all attributes say of each clip or chunk, before any gate.

    scores: clip, row_id, grid, router, attr, value, leaf ('' for a class's own node), logit; attrs: a row per attribute: attr, router, grid, multi, scope (`clip` or `local`), many, leaves, temperature, floor, threshold, leaf_threshold.
    Classes weigh the log-sum-exp of their nodes. One choice: softmax at the temperature, the mean log-probability over the unit's rows; the best class if it reaches the floor, with `many` up to `top` classes from
    top_at on; a best class `none` abstains from none_at on, else the best other counts. Several choices: each class of a chunk at or above the threshold. A leaf is the most probable node of its class if that is a leaf
    at or above leaf_threshold, else ''; attributes with `leaves` have up to `top` leaves from top_at on.
    """
    from ..learn.models import class_logits, within_class

    a = F.broadcast(attrs)  # the schema's attributes
    own = scores.join(a.select("attr", "router", "grid", "multi", "scope"), ["attr", "router", "grid"])
    node = own.withColumn("unit", F.when(F.col("multi") | (F.col("scope") == "local"), F.col("row_id")))
    c = class_logits(node, "clip", "row_id", "unit").join(a, "attr")
    one = c.filter("not multi").withColumn("_z", F.col("logit") / F.col("temperature"))
    row = W.partitionBy("clip", "attr", "row_id")
    one = one.withColumn("_m", F.max("_z").over(row)).withColumn("_lp", F.col("_z") - F.col("_m") - F.log(F.sum(F.exp(F.col("_z") - F.col("_m"))).over(row)))
    one = one.groupBy("clip", "attr", "unit", "value").agg(F.exp(F.avg("_lp")).alias("p"))
    order, known = F.struct(-F.col("p"), "value"), F.col("value") != "none"
    best = one.groupBy("clip", "attr", "unit").agg(F.min_by(F.struct("value", "p"), order).alias("_b"), F.min_by(F.when(known, F.struct("value", "p")), F.when(known, order)).alias("_o"))
    best = best.filter(~((F.col("_b.value") == "none") & (F.col("_b.p") >= none_at))).withColumn("_c", F.when(F.col("_b.value") == "none", F.col("_o")).otherwise(F.col("_b")))
    best = best.select("clip", "attr", "unit", F.col("_c.value").alias("value"), F.col("_c.p").alias("p")).join(a, "attr").filter(F.col("p") >= F.col("floor"))
    r = F.row_number().over(W.partitionBy("clip", "attr", "unit").orderBy(F.desc("p"), "value"))
    several = one.withColumn("_r", r).filter((F.col("_r") <= top) & ((F.col("_r") == 1) | (F.col("p") >= top_at))).withColumn("_u", F.coalesce("unit", F.lit(-1)))
    several = several.join(best.filter("many").select("clip", "attr", F.coalesce("unit", F.lit(-1)).alias("_u")).hint("merge"), ["clip", "attr", "_u"], "left_semi")
    every = c.filter("multi").withColumn("p", 1 / (1 + F.exp(-F.col("logit")))).filter(F.col("p") >= F.greatest("threshold", "floor"))
    key = ["clip", "attr", "unit", "value"]
    chosen = best.filter("not many").select(*key, "p").unionByName(several.select(*key, "p")).unionByName(every.select(*key, "p")).withColumn("_u", F.coalesce("unit", F.lit(-1)))
    # leaves inside the class, pooled over the unit's rows
    inside = within_class(node, "clip", "unit").withColumn("_u", F.coalesce("unit", F.lit(-1))).drop("unit")
    inside = inside.join(a.select("attr", "leaves", "leaf_threshold"), "attr").withColumn("_r", F.row_number().over(W.partitionBy("clip", "attr", "_u", "value").orderBy(F.desc("p"), "leaf")))
    inside = inside.withColumn("_n", F.row_number().over(W.partitionBy("clip", "attr", "_u", "value").orderBy(F.expr("leaf = ''"), F.desc("p"), "leaf")))
    fits = F.when(F.col("leaves"), (F.col("_n") <= top) & (F.col("p") >= top_at)).otherwise((F.col("_r") == 1) & (F.col("p") >= F.col("leaf_threshold")))
    leaf = inside.filter((F.col("leaf") != "") & fits).select("clip", "attr", "_u", "value", "leaf")
    out = chosen.join(leaf.hint("merge"), ["clip", "attr", "_u", "value"], "left").join(a.select("attr", "grid"), "attr")
    return out.select("clip", F.col("unit").alias("row_id"), "grid", "attr", "value", F.coalesce("leaf", F.lit("")).alias("leaf"), "p")


def route_clips(
    gate: DataFrame, attrs: DataFrame, scores: DataFrame, heads: DataFrame, properties: DataFrame, sounds: DataFrame, windows: DataFrame, served: DataFrame, asked: DataFrame, *, gate_at: float = 0.5, language: str = "speech.language",
    language_at: float = 0.5, property_at: float = 0.5, none_at: float = 0.995, top: int = 3, top_at: float = 0.2,
) -> DataFrame:
    """clip, row_id (null: the clip), attr, value, leaf, p, stage, by_question: the nodes that all routers serve, in the order of the stages.

    1. gate: regions of 3 s chunks and of clips (gate: clip, row_id, t0, t1, region, logit). 2. routers: attributes of open regions, decided by their owners on their own grid (attrs: as for `decided`, with region, ord, late,
    domain and skip, a row per router and attribute; scores: as for `decided`, for instance from loaded heads). 3. language: a sure text head instead, where speech is open (heads: clip, text, value, leaf, p). 4. properties: the best
    class of each head, where music is open (properties: clip, head, value, p). 5. sounds: identity by attribute, over the windows that overlap chunks which hear sound, or over all where an item asks
    (sounds, windows, served: as for sound_nodes and open_windows; asked: clip, asked). 6. a 3 s chunk keeps what its own gate opened; chunks of other grids have no gate and keep theirs. 7. late: attributes judged
    after that, in the chunks that opened their region. 8. domains: attributes with a class `none`, which abstain by themselves whatever the gate says. Attributes with `skip` are left to the sound heads.
    """
    own = owners(attrs).filter("not skip")
    facts = F.broadcast(own.select("attr", "region", "late", "domain"))  # the schema's attributes
    p = gate.withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))
    mean = p.groupBy("clip", "region").agg(F.avg("p").alias("p"))
    none = F.lit(None).cast("long")
    cols = lambda df, stage, leaf=F.lit(""), asked_=F.lit(False): df.select("clip", "row_id", "attr", "value", leaf.alias("leaf"), "p", F.lit(stage).alias("stage"), asked_.alias("by_question"))
    row_on = p.filter(F.col("p") >= gate_at)
    first = row_on.select("clip", "row_id", "region", "p").unionByName(mean.filter(F.col("p") >= gate_at).select("clip", none.alias("row_id"), "region", "p"))
    first = cols(first.withColumns({"attr": F.lit("gate"), "value": F.col("region")}), 1)
    clip_on = mean.filter(F.col("p") >= gate_at).select("clip", "region")
    shut = mean.filter(F.col("p") < gate_at).select("clip", "region")  # regions without a gate are open
    chunk_on = row_on.select("row_id", "region").distinct()
    said = cut(decided(scores, own, none_at, top, top_at).join(facts, "attr"))  # three stages read it
    open_ = said.filter("not domain").join(shut.hint("merge"), ["clip", "region"], "left_anti")
    # 2. and 3.: the text head's language
    speech = heads.join(shut.filter("region = 'speech'").select("clip").hint("merge"), "clip", "left_anti").filter(F.length("text") >= 8)
    second = open_.filter("not late").join(speech.select("clip", F.lit(language).alias("attr")).hint("merge"), ["clip", "attr"], "left_anti")
    third = speech.filter(F.col("p") >= language_at).select("clip", none.alias("row_id"), F.lit(language).alias("attr"), "value", "leaf", "p")
    # 4. and 5.
    fourth = threshold_heads(properties, clip_on.filter("region = 'music'"), property_at).select("clip", none.alias("row_id"), F.col("head").alias("attr"), "value", "p")
    spans = row_on.filter("region = 'sound'").select("clip", "t0", "t1")
    fifth = sound_nodes(sounds, open_windows(windows, spans, asked), served).withColumn("row_id", none)
    # 6. and 7.
    gated = (F.col("grid") == GATED) & F.col("row_id").isNotNull()
    inside = lambda df: df.filter(~gated).unionByName(df.filter(gated).join(chunk_on.hint("merge"), ["row_id", "region"], "left_semi").select(df.columns))
    leaf = F.col("leaf")
    out = first.unionByName(cols(inside(second), 2, leaf)).unionByName(cols(third, 3, leaf)).unionByName(cols(fourth, 4)).unionByName(cols(fifth, 5, leaf, F.col("by_question")))
    return out.unionByName(cols(inside(open_.filter("late")), 7, leaf)).unionByName(cols(said.filter("domain"), 8, leaf))


#: What a reader is told. Fixed values.
ASK = "Answer with only the letter of the correct option."
EXPLAIN = (
    "You cannot hear the audio recording. Instead you are given information that was extracted from it automatically:\n- a traversal of an audio knowledge tree: lines of the form 'region attribute: value (leaf)', "
    "naming what was detected in the recording, from general to specific (for example 'sound animal: dog (Bark)');\n- a speech transcript, if the recording contains speech;\n"
    "- for some questions, a timed list of sound events.\nThese are the only evidence about the recording."
)
STRICT = "Deduce the answer only from the information provided above; do not assume anything that is not stated there."
GIVEN, NOTHING = "Information extracted from the recording:\n", "No information was extracted from the recording.\n"
TEMPLATES = ("ours", "plain", "strict", "fewshot")


def prompt_text(items: DataFrame, template: str = "ours", shots: DataFrame | None = None) -> DataFrame:
    """id, prompt: the text of an item in one of TEMPLATES. items: id, question, choices (`(a) ..  (b) ..`), context ('' or null: nothing known); shots: ord, question, choices, context, gold.

    ours: context, question, choices. plain: an explanation, the context, the question. strict: that, and to keep to it. fewshot: strict, after worked examples with their letters (a few rows).
    """
    if template not in TEMPLATES:
        raise ValueError(f"no template {template}")
    context = F.coalesce("context", F.lit(""))
    info = F.when(F.trim(context) != "", F.concat(F.lit(GIVEN), context)).otherwise(NOTHING)
    asked = F.concat("question", F.lit("\n"), "choices", F.lit("\n\n"))
    told = F.lit((STRICT + " " if template in ("strict", "fewshot") else "") + ASK)
    text = F.concat(context, asked, F.lit(ASK)) if template == "ours" else F.concat(F.lit(EXPLAIN + "\n\n"), info, F.lit("\nQuestion: "), asked, told)
    if template != "fewshot" or shots is None:
        return items.select("id", text.alias("prompt"))
    worked = shots.select("ord", F.concat(text, F.lit("\n("), "gold", F.lit(")\n\n")).alias("t")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), "").alias("_w"))
    return items.join(F.broadcast(worked), F.lit(True)).select("id", F.concat("_w", text).alias("prompt"))

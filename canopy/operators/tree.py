"""The label tree: aliases, moves, re-parenting, support, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..workers import BROADCAST_ROWS, attach, cut, dealt

#: Words too general to tell a leaf from its class. Fixed values.
GENERIC = ["clear", "clean", "normal", "standard", "regular", "general", "plain", "typical", "good", "simple", "basic", "audio", "voice", "sound", "speech", "music", "tone", "style", "quality", "weather", "recording", "background", "noise"]
#: Ending of the last word of a name that says who acts. Fixed value.
AGENT = r"(er|or|ist|ian|ant|ee|man|woman|person|host|guide|coach|judge|chef|pilot)$"
#: What names a node; label rows in a bucket of a tree's tables.
NODE, BUCKET_ROWS = ["attr", "value", "leaf"], 500_000


def static_alias(labels: DataFrame, names: dict[str, str], only: Column | None = None) -> DataFrame:
    """Leaves renamed by a fixed map, on rows where `only` holds."""
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    new = F.coalesce(F.element_at(m, F.col("leaf")), F.col("leaf"))
    return labels.withColumn("leaf", new if only is None else F.when(only, new).otherwise(F.col("leaf")))


def per_name(df: DataFrame, on: list[str], cols: dict[str, Column]) -> DataFrame:
    """df with columns that depend on its columns `on` alone (rows with nulls there have none): computed for each distinct name, not for each row."""
    return attach(df, cut(df.select(*on).distinct().withColumns(cols)), on)


def stems(name: Column) -> Column:
    """Distinct stems of a name's words."""
    return F.array_distinct(F.transform(X.words(name), lambda w: X.stem(w)))


def cofire_aliases(labels: DataFrame, ancestors: DataFrame | None = None, expert: str = "expert", annotator: str = "annotator", key: tuple[str, ...] = ("clip", "attr", "value")) -> DataFrame:
    """attr, value, leaf, alias: an expert leaf and the annotator's leaf of the same key that share most stems; the single best per key, then the majority (at least half), ties by name.

    The expert leaf's stems are those of its own and its ancestors' words (ancestors: child, ancestor), without those of its class.
    """
    t = labels.filter("leaf != ''").dropna(subset=list(key))
    by = lambda tool: F.collect_set(F.when(F.col("tool") == tool, F.col("leaf")))
    g = t.groupBy(*key).agg(by(expert).alias("e"), F.array_sort(by(annotator)).alias("others")).withColumn("e", F.array_except("e", "others"))
    return _aliases(_said(g), ancestors)


def _said(keys: DataFrame) -> DataFrame:
    """attr, value, leaf, others, n: on how many keys experts alone give a leaf and the annotator these others. keys: attr, value, e (the experts' leaves), others."""
    return keys.filter((F.size("e") > 0) & (F.size("others") > 0)).select("attr", "value", F.explode("e").alias("leaf"), "others").groupBy("attr", "value", "leaf", "others").agg(F.count("*").alias("n"))


def _aliases(said: DataFrame, ancestors: DataFrame | None) -> DataFrame:
    """The aliases of cofire_aliases from what was said of equal keys (_said)."""
    said = cut(said)
    p = said.withColumn("alias", F.explode("others"))
    # words are those of distinct names, not of rows
    own, w = stems(F.col("leaf")), said.select("value", "leaf").distinct()
    if ancestors is not None:
        up = ancestors.groupBy(F.lower("child").alias("_c")).agg(F.array_distinct(F.flatten(F.collect_set(stems(F.col("ancestor"))))).alias("_up"))
        w = w.join(up.hint("merge"), F.lower("leaf") == F.col("_c"), "left")
        own = F.array_union(own, F.coalesce("_up", F.array().cast("array<string>")))
    p = attach(p, cut(w.select("value", "leaf", F.array_except(own, stems(F.col("value"))).alias("w"))), ["value", "leaf"])
    p = per_name(p, ["alias"], {"w2": stems(F.col("alias"))})
    p = p.withColumn("s", F.size(F.array_intersect("w", "w2"))).filter("s > 0")
    best = p.groupBy("attr", "value", "leaf", "others", "n").agg(F.max_by("alias", "s").alias("alias"), F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, 2).alias("top"))
    best = best.filter((F.size("top") == 1) | (F.get("top", F.lit(0)) > F.get("top", F.lit(1))))
    v = best.groupBy("attr", "value", "leaf", "alias").agg(F.sum("n").alias("n"))
    h = W.partitionBy("attr", "value", "leaf")
    v = v.withColumns({"all": F.sum("n").over(h), "r": F.row_number().over(h.orderBy(F.desc("n"), "alias"))})
    return v.filter("r = 1 and n >= 0.5 * all").select("attr", "value", "leaf", "alias")


def homes(counts: DataFrame, identity: list[str], role: str | None = None) -> DataFrame:
    """region, key, first, acts, most for keys that several attributes hold: the first of `identity` among them, whether `role` is, that with most clips. counts: region, key, attr, n."""
    at = F.array_position(F.array(*[F.lit(i) for i in identity]), F.col("attr")) if identity else F.lit(0)
    g = counts.groupBy("region", "key").agg(
        F.min_by("attr", F.when(at > 0, at)).alias("first"), F.coalesce(F.bool_or(F.col("attr") == F.lit(role)), F.lit(False)).alias("acts"), F.min_by("attr", F.struct(-F.col("n"), "attr")).alias("most"), F.count("*").alias("k")
    )
    return g.filter("k > 1").drop("k")


def home(leaf: Column, role: str | None = None) -> Column:
    """The home attribute of a leaf in a row of homes: the first of the identity attributes, else `role` for a name whose last word says who acts, else the one with most clips."""
    return F.coalesce("first", F.when(F.col("acts") & F.element_at(F.split(leaf, " "), -1).rlike(AGENT), F.lit(role)), "most")


def plan_moves(labels: DataFrame, region: Column, identity: list[str], key: Column | None = None, vocab: DataFrame | None = None, role: str | None = None) -> DataFrame:
    """attr, value, leaf, to_attr, to_value, to_leaf: leaves of a region that several attributes hold go to one home (see home), to the class with most clips there and the commonest form there,
    ties by name. Leaves with equal `key` (by default the leaf) are one. A leaf that stays, but is a closed value of another attribute of its region (vocab: attr, value), becomes that value.
    """
    x = labels.filter("leaf != ''").withColumns({"region": region, "key": F.col("leaf") if key is None else key})
    # one table of distinct clips gives all counts, one of nodes what needs no clips
    x = cut(x.groupBy("region", "key", "attr", "value", "leaf", "clip").agg(F.count("*").alias("n")))
    every = cut(x.groupBy("region", "key", "attr", "value", "leaf").agg(F.sum("n").alias("n")))
    c = x.groupBy("region", "key", "attr").agg(F.countDistinct("clip").alias("n"))
    v = x.groupBy("region", "key", "attr", "value").agg(F.countDistinct("clip").alias("n"))
    return _planned(every, c, v, region, identity, vocab, role)


def _planned(every: DataFrame, c: DataFrame, v: DataFrame, region: Column, identity: list[str], vocab: DataFrame | None, role: str | None) -> DataFrame:
    """The moves of plan_moves from counts n: rows of region, key, attr, value, leaf (every), clips of region, key, attr (c) and with the value (v)."""
    v = v.withColumnRenamed("attr", "to_attr")
    hv = v.groupBy("region", "key", "to_attr").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("to_value"))
    f = every.groupBy("region", "key", F.col("attr").alias("to_attr"), "leaf").agg(F.sum("n").alias("n"))
    hf = f.groupBy("region", "key", "to_attr").agg(F.min_by("leaf", F.struct(-F.col("n"), "leaf")).alias("to_leaf"))
    out = every.join(homes(c, identity, role).hint("merge"), ["region", "key"]).withColumn("to_attr", home(F.col("leaf"), role)).filter("attr != to_attr")
    out = out.join(hv.hint("merge"), ["region", "key", "to_attr"]).join(hf.hint("merge"), ["region", "key", "to_attr"]).select("attr", "value", "leaf", "to_attr", "to_value", "to_leaf")
    if vocab is None:
        return out
    out = cut(out)
    closed = vocab.select("attr", F.col("value").alias("leaf")).distinct().withColumn("region", region).withColumnRenamed("attr", "_a")
    named = every.join(closed.hint("merge"), ["region", "leaf"]).filter(F.col("attr") != F.col("_a")).groupBy("attr", "value", "leaf").agg(F.min("_a").alias("to_attr"))
    named = named.join(out.select("attr", "value", "leaf").hint("merge"), ["attr", "value", "leaf"], "left_anti")
    return out.unionByName(named.select("attr", "value", "leaf", "to_attr", F.col("leaf").alias("to_value"), F.lit("").alias("to_leaf")))


def apply_moves(labels: DataFrame, plan: DataFrame, multi: DataFrame, key: str = "clip") -> DataFrame:
    """key, attr, value, leaf after the moves: a leaf lands at its home if that is multi-valued, empty or equal on the row; its class stays without the leaf. multi: attr, multi."""
    l = labels.select(key, "attr", "value", "leaf").distinct().join(plan.hint("merge"), ["attr", "value", "leaf"], "left")
    stay = l.filter("to_attr is null").select(key, "attr", "value", "leaf")
    go = l.filter("to_attr is not null")
    cur = l.filter("to_attr is null or leaf = ''").groupBy(key, F.col("attr").alias("to_attr")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    go = go.join(cur.hint("merge"), [key, "to_attr"], "left").join(F.broadcast(multi.filter("multi").select(F.col("attr").alias("to_attr"), F.lit(True).alias("many")).distinct()), "to_attr", "left")
    fits = F.col("many").isNotNull() | F.col("lo").isNull() | ((F.col("lo") == F.col("to_value")) & (F.col("hi") == F.col("to_value")))
    landed = go.filter(fits).select(key, F.col("to_attr").alias("attr"), F.col("to_value").alias("value"), F.col("to_leaf").alias("leaf"))
    left = go.select(key, "attr", "value", F.lit("").alias("leaf"))
    return stay.unionByName(landed).unionByName(left).distinct()


def reparent(labels: DataFrame, key: Column | None = None) -> DataFrame:
    """Each leaf of an attribute (all with equal `key`, by default the leaf) under one class: that with most clips, ties by name."""
    l = labels.withColumn("_k", F.col("leaf") if key is None else key)
    return _under(l, l.filter("leaf != ''").groupBy("attr", "_k", "value").agg(F.countDistinct("clip").alias("n"))).drop("_k")


def _under(l: DataFrame, c: DataFrame) -> DataFrame:
    """Names (attr, _k, value, leaf) under the class with most clips of their attr and _k. c: attr, _k, value, n."""
    best = c.groupBy("attr", "_k").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("_v"), F.count("*").alias("k")).filter("k > 1").drop("k")
    return l.join(best.hint("merge"), ["attr", "_k"], "left").withColumn("value", F.when(F.col("leaf") != "", F.coalesce("_v", "value")).otherwise(F.col("value"))).drop("_v")


def node_support(labels: DataFrame) -> DataFrame:
    """attr, value, leaf ('' for the class), clips, sources, tools, chunks: counts of distinct values, each row counted once under a class. No sets are kept.

    A row belongs to one clip, so chunks are summed over a node's clips; sources and tools are counted from distinct pairs, which partial aggregation makes few.
    """
    own = ["attr", "value"]
    both = F.array(F.lit(""), F.when(F.col("leaf") != "", F.col("leaf")))
    x = labels.select(*own, F.explode(F.array_compact(both)).alias("leaf"), "clip", "source", "tool", "row_id")
    node = [*own, "leaf"]
    d = x.groupBy(*node, "clip", "row_id").agg(F.lit(1))
    rows = d.groupBy(*node, "clip").agg(F.count("*").alias("n")).groupBy(*node).agg(F.count("*").alias("clips"), F.sum("n").alias("chunks"))
    few = x.select(*node, F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("source").cast("string").alias("v")), F.struct(F.lit(1).alias("k"), F.col("tool").alias("v")))).alias("e")).groupBy(*node, "e").agg(F.lit(1))
    few = few.groupBy(*node).agg(F.count_if((F.col("e.k") == 0) & F.col("e.v").isNotNull()).alias("sources"), F.count_if((F.col("e.k") == 1) & F.col("e.v").isNotNull()).alias("tools"))
    return rows.join(few.hint("merge"), node).select(*node, "clips", "sources", "tools", "chunks")


def members(labels: DataFrame) -> DataFrame:
    """(node, row_id), the node as attr/value/leaf or attr/value."""
    n = F.when(F.col("leaf") != "", F.concat_ws("/", "attr", "value", "leaf")).otherwise(F.concat_ws("/", "attr", "value"))
    return labels.select(n.alias("node"), "row_id").unionByName(labels.select(F.concat_ws("/", "attr", "value").alias("node"), "row_id")).distinct()


def admit_nodes(
    support: DataFrame, min_clips: int = 2, min_sources: int = 2, hub_clips: int = 25, hub_share: float = 0.4, expert_only: Column | None = None, *, region: Column | None = None, identity: list[str] | None = None,
    role: str | None = None, vocab: DataFrame | None = None, shared: list[tuple[str, str]] | None = None, languages: tuple[str, str, list[str]] | None = None, examples: dict[str, list[str]] | None = None,
    example_share: float = 0.04, backed: list[str] | None = None, hub_exempt: list[str] | None = None,
) -> DataFrame:
    """Support with `refused`: null if admitted, else the first reason that applies. Classes are always admitted.

    Reasons in order: belongs to its home attribute in its region (region, identity, role: see home); names the language, not an accent (languages: the accents' attribute, the languages', words
    that say nothing there); prompt example copied as a filler (examples by attribute, also in the column `forms` if there is one, which hold `example_share` of the attribute's leaf clips; not
    where an attribute of `backed` has the column `expert`); covers most of its parent; says no more than its parent (only general words and those of class and attribute, unless it is one
    of the things that the class lists); numeric; belongs to an attribute that has it as a closed value (vocab: attr, value; but for pairs of `shared`); seen on one clip; seen in one source.
    """
    nodes = support.columns
    parent = F.max(F.when(F.col("leaf") == "", F.col("clips"))).over(W.partitionBy("attr", "value"))
    s = support.withColumn("_parent", parent)
    leaf, no = F.col("leaf"), F.lit(False)
    other = tongue = copied = closed = no
    if region is not None:
        s = s.withColumn("_region", region)
        c = s.filter("leaf != ''").groupBy(F.col("_region").alias("region"), leaf.alias("key"), "attr").agg(F.sum("clips").alias("n"))
        h = homes(c, identity or [], role).select(F.col("region").alias("_region"), F.col("key").alias("leaf"), home(F.col("key"), role).alias("_home"))
        s = s.join(h.hint("merge"), ["_region", "leaf"], "left")
        other = F.col("_home").isNotNull() & (F.col("_home") != F.col("attr"))
    else:
        s = s.withColumn("_home", F.lit(None).cast("string"))
    if languages is not None:
        accent, language, filler = languages
        core = F.filter(X.words(leaf), lambda w: ~w.isin(filler))
        s = s.withColumn("_core", F.get(core, F.lit(0))).withColumn("_words", F.size(core))
        s = s.join(support.filter((F.col("attr") == language) & (leaf != "")).select(leaf.alias("_core"), F.lit(True).alias("_tongue")).distinct().hint("merge"), "_core", "left")
        tongue = (F.col("attr") == accent) & ((F.col("_words") == 0) | ((F.col("_words") == 1) & F.col("_tongue").isNotNull()))
    if examples:
        mass = support.filter(leaf != "").groupBy("attr").agg(F.sum("clips").alias("_mass"))  # a row for each attribute of the schema
        s = s.join(F.broadcast(mass), "attr", "left")
        own = F.coalesce(F.element_at(F.create_map(*[x for a, ws in examples.items() for x in (F.lit(a), F.array(*[F.lit(w) for w in ws]))]), F.col("attr")), F.array().cast("array<string>"))
        forms = F.array_union(F.array(leaf), F.coalesce("forms", F.array().cast("array<string>"))) if "forms" in nodes else F.array(leaf)
        safe = F.col("attr").isin(backed or []) & (F.col("expert") if "expert" in nodes else no)
        copied = F.arrays_overlap(forms, own) & (F.col("clips") >= example_share * F.greatest("_mass", F.lit(1))) & ~safe
    if vocab is not None:
        v = vocab.select(F.col("value").alias("leaf"), F.col("attr").alias("_a")).distinct().join(s.select("leaf", "attr").distinct().hint("merge"), "leaf")
        pair = F.array_sort(F.array("attr", "_a"))
        v = v.filter((F.col("_a") != F.col("attr")) & ~F.arrays_overlap(F.array(pair), F.array(*[F.array(*[F.lit(x) for x in sorted(p)]) for p in shared]))) if shared else v.filter(F.col("_a") != F.col("attr"))
        s = s.join(v.groupBy("leaf", "attr").agg(F.min("_a").alias("_closed")).hint("merge"), ["leaf", "attr"], "left")
        closed = F.col("_closed").isNotNull()
    else:
        s = s.withColumn("_closed", F.lit(None).cast("string"))
    hub = (F.col("_parent") >= hub_clips) & (F.col("clips") >= hub_share * F.col("_parent")) & ~F.col("attr").isin(hub_exempt or [])
    parts = F.filter(F.transform(F.split("value", ",| and | or "), F.trim), lambda m: m != "")
    member = (F.size(parts) > 1) & F.array_contains(parts, leaf)
    plain = F.array_union(F.array_union(F.array(*[F.lit(w) for w in GENERIC]), X.words(F.col("value"))), X.words(F.col("attr")))
    tokens = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    same = ~member & ((leaf == F.col("value")) | (F.size(F.array_except(tokens(leaf), tokens(F.col("value")))) == 0))
    general = ~member & (F.size(F.array_except(X.words(leaf), plain)) == 0)
    one_source = F.col("sources") < min_sources
    if expert_only is not None:
        one_source &= ~expert_only
    why = F.when(leaf == "", None).when(other, F.concat(F.lit("belongs to "), "_home")).when(tongue, "names the language, not an accent").when(copied, "prompt example copied as a filler").when(hub, "covers most of its parent")
    why = why.when(general, "says no more than its parent").when(leaf.rlike("[0-9]"), "numeric").when(same, "says no more than its parent").when(closed, F.concat(F.lit("belongs to "), "_closed"))
    return s.withColumn("refused", why.when(F.col("clips") < min_clips, "seen on one clip").when(one_source, "seen in one source")).select(*nodes, "refused")


def tree_key(extra: dict[str, list[str]] | None = None) -> Column:
    """The norm_key of `leaf`, with further filler words for some attributes."""
    leaf, out = F.col("leaf"), None
    for attr, ws in (extra or {}).items():
        own = X.norm_key(leaf, extra=tuple(ws))
        out = F.when(F.col("attr") == attr, own) if out is None else out.when(F.col("attr") == attr, own)
    return X.norm_key(leaf) if out is None else out.otherwise(X.norm_key(leaf))


def merge_by_meaning(canon: DataFrame, leaves: DataFrame, vectors: DataFrame, k: Column, apart: list[str], near: float, sure: float) -> tuple[DataFrame, DataFrame]:
    """(canon, links): canonical leaves merged further where their vectors and the guards agree, and each specific's closest generic at cosine `near`. Attributes of `apart` are neither merged nor linked.

    canon: attr, value, leaf, canon; leaves: attr, value, leaf, clips; vectors: name, x (unit vectors; a leaf without one is left alone).
    """
    from .entity import generic_links, synonym_merge
    from .vectors import pairs_within

    by = ["attr", "value"]
    heads = canon.filter("leaf = canon").select(*by, F.col("leaf").alias("name")).join(leaves.select(*by, F.col("leaf").alias("name"), F.col("clips").alias("support")).hint("merge"), [*by, "name"])
    named = cut(heads.filter(~F.col("attr").isin(apart)).join(vectors.select("name", "x").hint("merge"), "name").select(*by, "name", "support", "x"))
    merged = cut(synonym_merge(named, tuple(by), near, sure))
    out = canon.join(merged.select(*by, F.col("name").alias("canon"), "head").hint("merge"), [*by, "canon"], "left").select(*by, "leaf", F.coalesce("head", "canon").alias("canon"))
    kept = named.join(merged.filter("name = head").select(*by, "name").hint("merge"), [*by, "name"], "left_semi")
    p = pairs_within(kept.select(*by, F.col("name").alias("id"), "x"), tuple(by), near)
    both = p.select(*by, F.col("a").alias("leaf"), F.col("b").alias("generic"), "cos").unionByName(p.select(*by, F.col("b").alias("leaf"), F.col("a").alias("generic"), "cos"))
    return out, generic_links(kept.select(*by, F.col("name").alias("leaf")), tuple(by), key=k, cosines=cut(both), least=near)


def checked_tree(nodes: DataFrame, min_clips: int) -> None:
    """Raises unless every admitted node has clips, no admitted leaf has a digit or too few clips, and each leaf of an attribute has one class. nodes: attr, value, leaf, clips."""
    leaf = nodes.filter("leaf != ''")
    bad = nodes.agg(F.count_if(F.coalesce("clips", F.lit(0)) <= 0).alias("nodes without clips"), F.count_if((F.col("leaf") != "") & F.col("leaf").rlike("[0-9]")).alias("leaves with a digit"), F.count_if((F.col("leaf") != "") & (F.col("clips") < min_clips)).alias("leaves with too few clips"))
    twice = leaf.groupBy("attr", "leaf").agg(F.countDistinct("value").alias("n")).filter("n > 1").agg(F.count("*").alias("leaves under several classes"))
    found = [f"{n} {what}" for what, n in {**bad.first().asDict(), **twice.first().asDict()}.items() if n]
    if found:
        raise ValueError(f"the tree breaks its rules: {', '.join(found)}")


def numbered(nodes: DataFrame) -> DataFrame:
    """attr, value, leaf, id: distinct nodes, each with a number; rows carry the numbers and not the names."""
    return cut(nodes.select(*NODE).distinct().withColumn("id", F.monotonically_increasing_id()))


def _met(df: DataFrame, nodes: DataFrame, name: str, names: list[str] = NODE, *more: str) -> DataFrame:
    """df with the number of the node that its columns `names` state, nulls too, and further columns of nodes."""
    n = nodes.select(*[F.col(c).alias(f"_{c}") for c in NODE], F.col("id").alias(name), *more)
    few = nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    on = [F.col(c).eqNullSafe(F.col(f"_{k}")) for c, k in zip(names, NODE, strict=True)]
    return df.join(F.broadcast(n) if few else n.hint("merge"), on[0] & on[1] & on[2]).drop(*[f"_{c}" for c in NODE])


def _first_of(cols: list[str]) -> Column:
    """The least number among nodes with equal columns: a number for their group."""
    return F.min("id").over(W.partitionBy(*cols))


def _clips(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """groups (id, g and what goes with g), one row each, with n: distinct clips of their nodes' rows. rows: clip, nodes, dealt by clip, so that no pair of them is shuffled."""
    n = attach(rows.select("clip", F.explode("nodes").alias("id")), groups.select("id", "g"), ["id"], "inner").select("g", "clip").distinct().groupBy("g").agg(F.count("clip").alias("n"))
    return groups.drop("id").distinct().join(n.hint("merge"), "g").drop("g")


def _voted(labels: DataFrame, nodes: DataFrame, floor: Column, who: Column, annotator: str, parts: int) -> DataFrame:
    """row_id, clip, source, id, tools, kept, expert, annotator, dealt by clip: a row's nodes, with the tools that count, if the vote keeps them (vote_single, or vote_multi where `many`); expert and annotator mark who named those of
    many-valued attributes, kept or not. A row's clip and source are its least. labels: row_id, clip, source, attr, value, leaf, tool, score, seq; nodes: attr, value, leaf, id, many.

    Labels are shuffled once by row and what is left once by clip, with numbers instead of names; labels, and the files of the first shuffle, go before the second.
    """
    l = _met(labels.filter("row_id is not null"), nodes, "id").select("row_id", "clip", "source", "id", "tool", "score", "seq").repartition(parts, "row_id")
    l = attach(l, nodes, ["id"], "inner")
    enough, an = F.coalesce("score", F.lit(0.0)) >= floor, F.col("tool") == annotator
    ok, row = (F.col("tool") == who) & enough, W.partitionBy("row_id", "attr")
    best = lambda on, *by: F.min(F.when(on, F.struct(*by, F.col("value").alias("v")))).over(row)["v"]
    l = l.withColumn("_v", F.coalesce(best(ok, (-F.col("score")).alias("s"), "seq"), best(an, "seq")))
    l = l.withColumns({"clip": F.min("clip").over(W.partitionBy("row_id")), "source": F.min("source").over(W.partitionBy("row_id"))})
    counts = F.coalesce(F.col("attr").isNotNull() & F.when(F.col("many"), (F.col("tool") != who) | enough).otherwise(F.col("value") == F.col("_v")), F.lit(False))
    said = lambda c: F.coalesce(F.bool_or(F.col("many") & c), F.lit(False))
    l = l.withColumn("_in", counts).groupBy("row_id", "clip", "source", "id").agg(
        F.array_sort(F.collect_set(F.when(F.col("_in"), F.col("tool")))).alias("tools"), F.bool_or("_in").alias("kept"), said(F.col("tool") == who).alias("expert"), said(an).alias("annotator")
    )
    l = cut(l.filter("kept or expert or annotator"), labels)
    return dealt(l, "clip", parts, l)


def build_tree(
    labels: DataFrame, floor: float, multi: DataFrame, region: Column, identity: list[str], *, names: dict[str, str] | None = None, ancestors: DataFrame | None = None, pruned: list[str] | None = None, vocab: DataFrame | None = None,
    role: str | None = None, annotator: str = "annotator", expert: str = "expert", experts: dict[str, tuple[str, float]] | None = None, extra: dict[str, list[str]] | None = None, vectors: DataFrame | None = None,
    apart: list[str] | None = None, near: float = 0.8, sure: float = 0.93, table: DataFrame | None = None, check: bool = True, **admission,
) -> dict[str, DataFrame]:
    """The chain vote, alias, move, re-parent, merge, link, admit over labels (row_id, clip, source, attr, value, leaf, tool, score, seq).

    nodes (attr, value, leaf, clips, sources, chunks, forms, parent: the nearest admitted generic), refused (with the reason), members (node, row_id), canon (attr, value, leaf, canon), links (attr, value,
    leaf, generic), labels (row_id, attr, value, leaf: see clean_labels), aliases, moves. Leaves are one where their norm_key is. Experts' leaves are renamed by `names`, then by what the annotator says of the same row (cofire_aliases). A node's rows
    count for every generic above it. Intermediate tables are written to the shared folder.

    experts: the expert's tool and floor of an attribute, where it isn't `expert` and `floor`. extra: further filler words of an attribute. vectors (name, x): leaves are merged and linked by meaning (merge_by_meaning, but for
    attributes of `apart`); without them by words alone. table (kind, attr, value, leaf, to): what cleaning found, matched by key: `pruned` attributes go, `dropped` leaves fall back to their class, `moved` ones change it,
    `canon` composes on the merges and `generic` adds links where there is none. check: raise where the result breaks the tree's rules (checked_tree).
    """
    from .entity import generic_links, light_canon
    from .graph import closure

    k = tree_key(extra)
    labels = cut(labels.select("row_id", "clip", "source", *NODE, "tool", "score", "seq"))
    parts = max(labels.sparkSession.sparkContext.defaultParallelism, labels.count() // BUCKET_ROWS + 1)
    floor, who = F.lit(floor), F.lit(expert)
    if experts:
        own = lambda i: F.create_map(*[F.lit(x) for a, v in experts.items() for x in (a, v[i])])[F.col("attr")]
        floor, who = F.coalesce(own(1), floor), F.coalesce(own(0), who)
    found = {kind: cut(table.filter(F.col("kind") == kind).select("attr", "value", tree_key(extra).alias("_key"), "to").distinct()) for kind in ("dropped", "moved", "canon", "generic")} if table is not None else {}
    many = cut(multi.filter("multi").select("attr", F.lit(True).alias("many")).distinct())  # the schema's attributes
    nodes = cut(numbered(labels).join(F.broadcast(many), "attr", "left").select(*NODE, "id", F.coalesce("many", F.lit(False)).alias("many")))
    voted = _voted(labels, nodes, floor, who, annotator, parts)
    said = attach(voted.filter("expert or annotator"), nodes, ["id"], "inner").filter("leaf != '' and value is not null")
    said = said.groupBy("clip", "row_id", "attr", "value").agg(F.collect_set(F.when(F.col("expert") & ~F.col("annotator"), F.col("leaf"))).alias("e"), F.array_sort(F.collect_set(F.when(F.col("annotator"), F.col("leaf")))).alias("others"))
    aliases = cut(_aliases(_said(said), ancestors))
    # what becomes of a node, with (an) or without the annotator among its tools
    m = nodes.select("id", F.explode(F.array(F.lit(True), F.lit(False))).alias("an"), *NODE)
    if table is not None:
        m = m.join(F.broadcast(table.filter("kind = 'pruned'").select("attr").distinct()), "attr", "left_anti")  # attributes of the schema
    if pruned:
        m = m.filter(~F.col("attr").isin(pruned))
    if names:
        m = static_alias(m, names, ~F.col("an"))
    m = m.join(aliases.hint("merge"), NODE, "left").withColumn("leaf", F.coalesce("alias", "leaf")).drop("alias")
    if found:
        at = ["attr", "value", "_key"]
        m = m.withColumn("_key", F.when(F.col("leaf") != "", k))
        m = m.join(found["dropped"].select(*at, F.lit(True).alias("_drop")).hint("merge"), at, "left").join(found["moved"].select(*at, F.col("to").alias("_to")).hint("merge"), at, "left")
        m = m.withColumns({"leaf": F.when(F.col("_drop"), "").otherwise(F.col("leaf")), "value": F.when(F.col("_drop"), F.col("value")).otherwise(F.coalesce("_to", "value"))})
    m = cut(m.select("id", "an", *NODE).distinct())
    nodes = numbered(m)
    becomes = cut(_met(m, nodes, "node").select("id", "an", "node"))
    # a row of voted is a row of the tree from here on: its clip, source, tools and nodes; the tables of rows lie by clip, so no step shuffles them
    voted = dealt(
        attach(voted.filter("kept").withColumn("an", F.array_contains("tools", annotator)), becomes, ["id", "an"], "inner").groupBy("clip", "row_id", "source")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tools")))).alias("tools"), F.collect_set("node").alias("nodes")),
        "clip", parts, voted, again=False,
    )
    keyed = cut(nodes.filter("leaf != ''").withColumns({"region": region, "key": k}))
    n = voted.select(F.explode("nodes").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    of = lambda *cols: _clips(voted, cut(keyed.select("id", _first_of(cols).alias("g"), *cols)))
    moves = cut(_planned(cut(keyed.join(n.hint("merge"), "id")), of("region", "key", "attr"), of("region", "key", "attr", "value"), region, identity, vocab, role))
    # what becomes of a node that stays or goes (apply_moves): where it lands, the group of that attribute and class, the bare class that it leaves
    to = ["to_attr", "to_value", "to_leaf"]
    bare = moves.dropna(subset=NODE).withColumn("_bare", F.lit(""))  # rows of a node without a class stay
    places = numbered(nodes.select(*NODE).unionByName(moves.select(*[F.col(c).alias(n) for c, n in zip(to, NODE, strict=True)])).unionByName(moves.select("attr", "value", F.lit("").alias("leaf"))))
    places = cut(places.withColumns({"a": _first_of(["attr"]), "c": F.when(F.col("value").isNotNull(), _first_of(["attr", "value"]))}))
    go = _met(_met(_met(bare, nodes, "id"), places, "land", to, "a", "c"), places, "bare", ["attr", "value", "_bare"])
    go = go.join(F.broadcast(many.withColumnRenamed("attr", "to_attr")), "to_attr", "left").select("id", "land", "a", "c", "bare", F.coalesce("many", F.lit(False)).alias("many"))
    stay = _met(nodes.join(moves.select(*NODE).hint("merge"), NODE, "left_anti"), places, "land", NODE, "a", "c").select("id", "land", "a", "c", F.lit(None).cast("long").alias("bare"), F.lit(False).alias("many"))
    row, left = W.partitionBy("clip", "row_id", "a"), F.when(F.col("bare").isNull(), F.col("c"))
    moved = attach(voted.select("clip", "row_id", "source", "tools", F.explode("nodes").alias("id")), cut(go.unionByName(stay)), ["id"], "inner").withColumns({"lo": F.min(left).over(row), "hi": F.max(left).over(row)})
    fits = F.col("many") | F.col("lo").isNull() | ((F.col("lo") == F.col("c")) & (F.col("hi") == F.col("c")))
    moved = moved.withColumn("nodes", F.when(F.col("bare").isNull(), F.array("land")).when(fits, F.array("land", "bare")).otherwise(F.array("bare")))
    rows = dealt(moved.groupBy("clip", "row_id", "source", "tools").agg(F.array_distinct(F.flatten(F.collect_set("nodes"))).alias("nodes")).filter(F.size("tools") > 0), "clip", parts, voted, again=False)
    # each leaf of an attribute under one class
    named = cut(places.withColumn("_k", k))
    placed = cut(_under(named, _clips(rows, cut(named.filter("leaf != ''").select("id", _first_of(["attr", "_k", "value"]).alias("g"), "attr", "_k", "value")))).select("id", *NODE))
    # merge forms of one name, link specifics to generics
    leaves = cut(_clips(rows, cut(placed.filter("leaf != ''").select("id", _first_of(NODE).alias("g"), *NODE))).select(*NODE, F.col("n").alias("clips")))
    canon = cut(light_canon(leaves, k))
    if vectors is not None:
        canon, links = (cut(x) for x in merge_by_meaning(canon, leaves, vectors, k, apart or [], near, sure))
    else:
        links = cut(generic_links(canon.select("attr", "value", F.col("canon").alias("leaf")).distinct(), key=k))
    if found:
        at = ["attr", "value", "_key"]
        to = lambda df, name: found["canon"].select(*at, F.col("to").alias(name)).hint("merge")
        keyed = lambda df, col: df.join(df.select("attr", "value", F.col(col).alias("leaf")).distinct().withColumn("_key", k).withColumnRenamed("leaf", col).hint("merge"), ["attr", "value", col])
        c = keyed(canon, "canon").join(to(canon, "_far"), at, "left").drop("_key").withColumn("_key", k).join(to(canon, "_own"), at, "left")
        canon = cut(c.select("attr", "value", "leaf", F.coalesce("_far", "_own", "canon").alias("canon")))
        left = canon.select("attr", "value", F.col("canon").alias("leaf")).distinct()
        more = left.withColumn("_key", k).join(found["generic"].hint("merge"), at).filter("leaf != to").select("attr", "value", "leaf", F.col("to").alias("generic"))
        kept = links.join(left.hint("merge"), ["attr", "value", "leaf"], "left_semi")
        links = cut(kept.unionByName(more.join(kept.select("attr", "value", "leaf").hint("merge"), ["attr", "value", "leaf"], "left_anti")))
    # the nodes that a row counts for: its own, and the generics above them
    own = placed.join(canon.hint("merge"), NODE, "left").select("id", "attr", "value", F.coalesce("canon", F.lit("")).alias("leaf"))
    above = closure(links.select(_named("leaf").alias("child"), _named("generic").alias("parent")))
    up = above.select(F.from_json("child", "attr string, value string, leaf string").alias("c"), F.from_json("ancestor", "attr string, value string, leaf string").alias("a"), "depth").select("c.*", F.col("a.leaf").alias("up"), "depth")
    every = cut(own.unionByName(own.join(up.hint("merge"), NODE).select("id", "attr", "value", F.col("up").alias("leaf"))).distinct())
    support = _support(rows, every, annotator)
    forms = canon.groupBy("attr", "value", F.col("canon").alias("leaf")).agg(F.array_sort(F.collect_set("leaf")).alias("forms"))
    support = support.join(forms.hint("merge"), NODE, "left")
    nodes = cut(admit_nodes(support, expert_only=~F.coalesce("_an", F.lit(False)), region=region, identity=identity, role=role, vocab=vocab, **admission))
    good = nodes.filter("refused is null")
    if check:
        checked_tree(good, admission.get("min_clips", 2))
    parent = up.join(good.select("attr", "value", F.col("leaf").alias("up")).hint("merge"), ["attr", "value", "up"], "left_semi").groupBy("attr", "value", "leaf").agg(F.min_by("up", F.struct("depth", "up")).alias("parent"))
    shape = ["attr", "value", "leaf", "clips", "sources", "chunks", F.coalesce("forms", F.array().cast("array<string>")).alias("forms")]
    per_row = rows.select("clip", "row_id", F.explode("nodes").alias("id"))
    last = _cleaned(placed.select(*NODE).distinct(), canon.withColumnRenamed("canon", "to_leaf"), good, above)
    last = cut(placed.join(last.hint("merge"), NODE, "left").select("id", "attr", "value", F.explode(F.coalesce("_to", F.array(F.lit("")))).alias("leaf")).distinct())
    held = every.join(good.hint("merge"), NODE, "left_semi")
    top = F.concat_ws("/", "attr", "value")
    held = cut(held.select("id", F.explode(F.array_distinct(F.array(top, F.when(F.col("leaf") != "", F.concat_ws("/", "attr", "value", "leaf")).otherwise(top)))).alias("node")).distinct())
    return {
        "nodes": good.join(parent.hint("merge"), ["attr", "value", "leaf"], "left").select(*shape, "parent"), "refused": nodes.filter("refused is not null").select(*shape, "refused"),
        "labels": attach(per_row, last, ["id"], "inner").select("clip", "row_id", *NODE).distinct().drop("clip"),
        "members": attach(per_row, held, ["id"], "inner").select("clip", "row_id", "node").distinct().select("node", "row_id"),
        "canon": canon, "links": links, "aliases": aliases, "moves": moves,
    }


def _support(rows: DataFrame, every: DataFrame, annotator: str) -> DataFrame:
    """node_support of a tree's rows, with _an and expert: whether the annotator or others named a row of the node. rows: clip, row_id, source, tools, nodes, dealt by clip; every: id, and the nodes that it counts for."""
    both = F.array_compact(F.array(F.lit(""), F.when(F.col("leaf") != "", F.col("leaf"))))
    t = cut(every.filter("attr is not null and value is not null").select("id", "attr", "value", F.explode(both).alias("leaf")).distinct())
    named = numbered(t)
    x = attach(rows.select("clip", "row_id", "source", "tools", F.explode("nodes").alias("id")), cut(_met(t, named, "g").select("id", "g")), ["id"], "inner")
    n = x.select("g", "clip", "row_id").distinct().groupBy("g", "clip").agg(F.count("*").alias("n")).groupBy("g").agg(F.count("*").alias("clips"), F.sum("n").alias("chunks"))
    few = cut(x.select("g", "source", "tools").distinct())
    tool = F.col("tool")
    by = few.select("g", F.explode("tools").alias("tool")).groupBy("g").agg(F.countDistinct(tool).alias("tools"), F.bool_or(tool == annotator).alias("_an"), F.bool_or(tool != annotator).alias("expert"))
    out = named.withColumnRenamed("id", "g").join(n.hint("merge"), "g").join(few.groupBy("g").agg(F.countDistinct("source").alias("sources")).hint("merge"), "g").join(by.hint("merge"), "g")
    return out.select(*NODE, "clips", "sources", "tools", "chunks", "_an", "expert")


def tree_agreement(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """attr, value, leaf, node_clips, table_clips where the tree and the label table differ; null where one of them lacks the node."""
    t = node_support(labels).select("attr", "value", "leaf", F.col("clips").alias("table_clips"))
    j = nodes.select("attr", "value", "leaf", F.col("clips").alias("node_clips")).join(t.hint("merge"), ["attr", "value", "leaf"], "full_outer")
    return j.filter(~F.col("node_clips").eqNullSafe(F.col("table_clips")))


def publish_manifest(labels: DataFrame, support: DataFrame) -> DataFrame:
    """One row: clips, rows, attributes, classes, leaves, refused, by_source (`source=clips`) and by_reason (`reason=leaves`), both by name, null where there are none."""
    line = lambda k, n: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(k).cast("string").alias("k"), F.col(n).alias("n")))), lambda x: F.concat(x["k"], F.lit("="), x["n"].cast("string"))), "; ")
    listed = lambda k, n: F.nullif(line(k, n), F.lit(""))
    a = labels.agg(F.countDistinct("clip").alias("clips"), F.countDistinct("row_id").alias("n_rows"), F.countDistinct("attr").alias("attributes"))
    b = support.agg(F.count_if(F.col("leaf") == "").alias("classes"), F.count_if((F.col("leaf") != "") & F.col("refused").isNull()).alias("leaves"), F.count_if(F.col("refused").isNotNull()).alias("refused"))
    c = labels.groupBy("source").agg(F.countDistinct("clip").alias("n")).agg(listed("source", "n").alias("by_source"))  # a row per source
    d = support.filter("refused is not null").groupBy("refused").agg(F.count("*").alias("n")).agg(listed("refused", "n").alias("by_reason"))  # a row per reason
    out = a
    for one in (b, c, d):
        out = out.join(F.broadcast(one), F.lit(True))
    return out


def tree_summary(nodes: DataFrame, region: Column, owner: str | None = None) -> DataFrame:
    """region, attr, classes, leaves with totals (nulls). With `owner`, a column that orders the trees that nodes come from, an attribute counts in the last tree that has it only."""
    if owner is not None:
        nodes = nodes.join(nodes.groupBy("attr").agg(F.max(owner).alias(owner)).hint("merge"), ["attr", owner], "left_semi")
    return nodes.withColumn("region", region).rollup("region", "attr").agg(F.count_if(F.col("leaf") == "").alias("classes"), F.count_if(F.col("leaf") != "").alias("leaves"))


def canonical_leaf(labels: DataFrame, forms: DataFrame) -> DataFrame:
    """Leaves replaced by the canonical one of (attr, value, form); unmatched ones become ''."""
    f = forms.select("attr", "value", F.col("form").alias("leaf"), F.col("canonical").alias("_c"))
    return labels.join(f.hint("merge"), ["attr", "value", "leaf"], "left").withColumn("leaf", F.coalesce("_c", F.lit(""))).drop("_c")


def attribute_prune(labels: DataFrame, attrs: list[str]) -> DataFrame:
    return labels.filter(~F.col("attr").isin(attrs))


def apply_groups(labels: DataFrame, canon: DataFrame) -> DataFrame:
    """Leaves replaced by their group's (attr, value, leaf, to_leaf); '' drops the leaf and keeps the class."""
    return labels.join(canon.hint("merge"), ["attr", "value", "leaf"], "left").withColumn("leaf", F.coalesce("to_leaf", "leaf")).drop("to_leaf")


def place_by_rules(names: DataFrame, closure: DataFrame, rules: DataFrame) -> DataFrame:
    """name, kind: the first rule (rule_no, name, kind) that names the label or an ancestor, else `unplaced`. closure: child, ancestor."""
    up = names.select("name", F.col("name").alias("_n")).unionByName(closure.select(F.col("child").alias("name"), F.col("ancestor").alias("_n")).join(names.select("name").hint("merge"), "name", "left_semi"))
    hit = up.join(F.broadcast(rules.select(F.col("name").alias("_n"), "kind", "rule_no")), "_n").groupBy("name").agg(F.min_by("kind", F.struct("rule_no", "kind")).alias("kind"))
    return names.select("name").join(hit.hint("merge"), "name", "left").withColumn("kind", F.coalesce("kind", F.lit("unplaced")))


def events_to_labels(events: DataFrame, rows: DataFrame, named: DataFrame, kinds: DataFrame, skip: list[str], attr: str = "sound.event") -> DataFrame:
    """row_id, attr, value, leaf, score, t0, t1: detected events as labels of their clip's row and of the chunks they overlap.

    A label of `named` (label, attr, value) gives that attribute's class; all labels but the families of `skip` give `attr` the kind of the label (kinds: label, kind; else `other`), with its name as leaf.
    events: clip, label, t0, t1, peak; rows: row_id, clip, grid, t0, t1.
    """
    from .chunks import project_spans

    e = events.select("clip", "t0", "t1", F.struct("label", "t0", "t1", "peak").alias("span_id"))
    on_clip = e.select("span_id", "clip").join(rows.filter("grid = 'clip'").select("clip", "row_id").hint("merge"), "clip").select("span_id", "row_id")
    hit = project_spans(e, rows).unionByName(on_clip).select("row_id", "span_id.*")
    first = hit.join(named.hint("merge"), "label").select("row_id", "attr", "value", F.lit("").alias("leaf"), F.col("peak").alias("score"), "t0", "t1")
    rest = hit.filter(~F.col("label").isin(skip)).join(kinds.hint("merge"), "label", "left")
    return first.unionByName(rest.select("row_id", F.lit(attr).alias("attr"), F.coalesce("kind", F.lit("other")).alias("value"), F.lower("label").alias("leaf"), F.col("peak").alias("score"), "t0", "t1"))


def node_index(leaves: DataFrame) -> DataFrame:
    """source, name, value, node: the tree nodes that a label of an external vocabulary stands for: the leaf it is the same as, if that is a node of the class, else itself.

    leaves: value, name, source, same_as (null, or a name of the class). A leaf that is the same as another of its class is no node of its own.
    """
    known = leaves.select("value", F.col("name").alias("same_as"), F.lit(True).alias("_k")).distinct()
    l = leaves.join(known.hint("merge"), ["value", "same_as"], "left").withColumn("_own", F.col("_k").isNull())
    canon = l.filter("_own").select("value", F.col("name").alias("same_as"), F.lit(True).alias("_c")).distinct()
    l = l.join(canon.hint("merge"), ["value", "same_as"], "left")
    return l.select("source", "name", "value", F.when(F.col("_c"), F.col("same_as")).otherwise(F.col("name")).alias("node")).distinct()


def clean_labels(labels: DataFrame, canon: DataFrame, admitted: DataFrame, links: DataFrame) -> DataFrame:
    """row_id, attr, value, leaf: each label's most specific admitted node after its canonical form, and that node's admitted generics; a leaf that isn't admitted becomes ''.

    canon: attr, value, leaf, to_leaf; admitted: attr, value, leaf; links: attr, value, leaf, generic.
    """
    from .graph import closure

    # what becomes of a node is found once for each distinct node, so rows meet one table
    to = _cleaned(cut(labels.select(*NODE).distinct()), canon, admitted, closure(links.select(_named("leaf").alias("child"), _named("generic").alias("parent"))))
    out = attach(labels.select("row_id", *NODE), to, NODE).withColumn("_to", F.coalesce("_to", F.array(F.lit(""))))
    return out.select("row_id", "attr", "value", F.explode("_to").alias("leaf")).distinct()


def _named(leaf: str) -> Column:
    """A node as one string."""
    return F.to_json(F.struct("attr", "value", F.col(leaf).alias("leaf")))


def _cleaned(nodes: DataFrame, canon: DataFrame, admitted: DataFrame, up: DataFrame) -> DataFrame:
    """attr, value, leaf, _to: the leaves that clean_labels gives a node. nodes: attr, value, leaf; up: the closure of links between nodes as strings."""
    l = apply_groups(nodes.withColumn("_own", F.col("leaf")), canon)
    ok = admitted.filter("leaf != ''").select(*NODE, F.lit(True).alias("_ok")).distinct()
    l = cut(l.join(ok.hint("merge"), NODE, "left").withColumn("leaf", F.when(F.col("_ok"), F.col("leaf")).otherwise("")).select("attr", "value", "_own", "leaf"))
    far = l.withColumn("child", _named("leaf")).join(up.hint("merge"), "child").select("_own", F.from_json("ancestor", "attr string, value string, leaf string").alias("a")).select("_own", "a.*")
    far = far.join(ok.drop("_ok").hint("merge"), NODE, "left_semi").select("attr", "value", "_own", "leaf")
    return cut(l.unionByName(far).filter("attr is not null and value is not null and _own is not null").groupBy("attr", "value", F.col("_own").alias("leaf")).agg(F.collect_set("leaf").alias("_to")))

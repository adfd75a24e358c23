"""Names that are one: canonical forms, synonym merges, generic links."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..workers import cut
from .metrics import running
from .vectors import meeting, pairs_within, similar


def light_canon(names: DataFrame, key: Column, by: tuple[str, ...] = ("attr", "value")) -> DataFrame:
    """by, leaf, canon: names with equal keys take the best supported of them, ties by name. names: by, leaf, clips."""
    n = names.withColumn("_k", key)
    first = F.first("leaf").over(W.partitionBy(*by, "_k").orderBy(F.desc("clips"), "leaf"))
    return n.withColumn("canon", first).select(*by, "leaf", "canon")


def in_class_merge(names: DataFrame, content: Column, own: Column, by: tuple[str, ...] = ("attr", "value")) -> DataFrame:
    """by, leaf, canon: leaves with equal content words, those of the class left out, share the best supported one; leaves without any are on their own."""
    rest = F.array_join(F.array_except(content, own), " ")
    return light_canon(names, F.when(rest == "", F.concat(F.lit("\n"), "leaf")).otherwise(rest), by)


#: Names that end in one of these are about something, not a kind of it. Fixed values.
ABOUT = ["announcement", "discussion", "talk", "review", "lesson", "commentary", "report", "advertisement", "class", "broadcast", "interview", "tutorial", "lecture", "story", "debate"]


def similar_names(names: DataFrame, by: tuple[str, ...], near: float, axes: list | None = None, sure: float = 0.93) -> DataFrame:
    """by, a, b, cos, why: pairs of names of a class at cosine >= near, a before b in order of support (then name); why: null if they may be one, else the reason.

    Reasons: the guards of may_merge; `not synonyms` where their keys differ in the number of words or the cosine stays below `sure`. names: by, name, support, x (unit vector), one row per name.
    """
    n = names.withColumn("r", F.struct((-F.col("support")).alias("s"), "name"))
    p = pairs_within(n.select(*by, F.col("name").alias("id"), "x"), by, near)
    right = lambda s: n.select(*by, F.col("name").alias(s), F.col("r").alias(f"r{s}"))
    p = p.join(right("a").hint("merge"), [*by, "a"]).join(right("b").hint("merge"), [*by, "b"])
    first = F.col("ra") < F.col("rb")
    p = p.select(*by, F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), "cos", F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb"))
    words = lambda c: F.size(F.split(X.norm_key(F.col(c)), " "))
    guard = X.may_merge(F.col("a"), F.col("b"), X.AXES if axes is None else axes)
    return p.withColumn("why", F.coalesce(guard, F.when((words("a") != words("b")) | (F.col("cos") < sure), "not synonyms")))


#: Names that are settled at first; each round takes four times as many places of the order.
PREFIX = 8192


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _synonyms(names: DataFrame, before: DataFrame, near: float) -> DataFrame:
    """a, b: pairs of names (b) with those of `before` (a) that come earlier and with which they may be one. names, before: no, k, name, x, f, w."""
    side = lambda df: df.filter("k is not null and x is not null").select("k", F.col("no").alias("vec_id"), "x")
    p = _union([both.mapInArrow(similar(near), "vec_id long, ref_id long, cos double") for both in meeting(side(names), side(before))]).filter("ref_id < vec_id").select(F.col("ref_id").alias("a"), F.col("vec_id").alias("b"))
    fact = lambda df, s: df.select(F.col("no").alias(s), F.col("f").alias(f"f{s}"), F.col("w").alias(f"w{s}"))
    p = p.join(fact(before, "a").hint("merge"), "a").join(fact(names, "b").hint("merge"), "b")
    return p.filter(X.merge_why(F.col("fa"), F.col("fb")).isNull() & (F.col("wa") == F.col("wb"))).select("a", "b")


def _heads(nos: DataFrame, e: DataFrame) -> DataFrame:
    """no, head: each of some names and its first head among them, by the pairs a, b (a before b). A name without a possible head before it is a head, one with a sure head isn't."""
    state = cut(nos.select("no", F.lit(None).cast("boolean").alias("head")))
    while True:
        before = e.join(state.select(F.col("no").alias("a"), F.col("head").alias("ha")).hint("merge"), "a").groupBy(F.col("b").alias("no")).agg(F.coalesce(F.bool_or("ha"), F.lit(False)).alias("_taken"), F.bool_or(F.col("ha").isNull()).alias("_open"))
        new = state.join(before.hint("merge"), "no", "left")
        taken, free = F.coalesce("_taken", F.lit(False)), ~F.coalesce("_open", F.lit(False))
        state = cut(new.select("no", F.when(F.col("head").isNotNull(), F.col("head")).when(taken, False).when(free, True).alias("head")), state)
        if not state.filter("head is null").limit(1).count():
            break
    to = e.join(state.filter("head").select(F.col("no").alias("a")).hint("merge"), "a", "left_semi").groupBy(F.col("b").alias("no")).agg(F.min("a").alias("_h"))
    return cut(state.join(to.hint("merge"), "no", "left").select("no", F.when(F.col("head"), F.col("no")).otherwise(F.col("_h")).alias("head")), state)


def synonym_merge(names: DataFrame, by: tuple[str, ...] = ("grp",), near: float = 0.8, sure: float = 0.93, first: int = PREFIX) -> DataFrame:
    """by, name, head: names in order of support (then name) join the first head before them with which they may be one (similar_names); else they are heads.

    The order is worked off in ranges, each four times as long as all before. A range's names are settled among themselves, then its heads take what they may of all later names; only names that no head took enter the next range. So pairs
    become rows with heads, and inside a range of names that are left, but never between all names that are similar. Vectors meet in blocks, all names and the heads of a range at a time.
    names: by, name, support, x (unit vector), one row per name.
    """
    least = max(near, sure)
    key = F.when(F.forall(F.array(*[F.col(c).isNotNull() for c in by]), lambda c: c), F.to_json(F.struct(*by)))
    facts = {"k": key, "x": F.col("x").cast("array<double>"), "f": X.merge_features(F.col("name"), X.AXES), "w": F.size(F.split(X.norm_key(F.col("name")), " ")), "_one": F.lit(1)}
    order = [(-F.col("support")).asc(), F.col("name").asc()]
    n = cut(running(names.select(*by, "name", "support", "x").withColumns(facts), [], order, {"no": "_one"}).withColumn("no", F.col("no").cast("long")).drop("_one", "support"))
    left, total, hi, parts = n, n.count(), first, []
    open_ = total
    while open_:
        hi = total if open_ <= first else min(hi, total)
        now = left.filter(F.col("no") <= hi)
        parts.append(_heads(now, cut(_synonyms(now, now, least))))
        if hi >= total:
            break
        later = left.filter(F.col("no") > hi)
        heads = cut(now.join(parts[-1].filter("no = head").select("no").hint("merge"), "no", "left_semi"))
        parts.append(cut(_synonyms(later, heads, least).groupBy(F.col("b").alias("no")).agg(F.min("a").alias("head"))))
        left = cut(later.join(parts[-1].select("no").hint("merge"), "no", "left_anti"), *([left] if left is not n else []))
        open_, hi = left.count(), 4 * hi
    if not parts:
        return names.select(*by, "name", F.col("name").alias("head"))
    named = n.select(F.col("no").alias("head"), F.col("name").alias("_h"))
    out = n.select("no", *by, "name").join(_union(parts).hint("merge"), "no").join(named.hint("merge"), "head")
    return out.select(*by, "name", F.col("_h").alias("head"))


def near_misses(names: DataFrame, by: tuple[str, ...] = ("grp",), near: float = 0.8, below: float = 0.12, sure: float = 0.93) -> DataFrame:
    """by, a, b, cos, why: pairs that weren't merged although they are similar, or lie less than `below` under the limit (`near miss`)."""
    p = similar_names(names, by, near - below, sure=sure)
    return p.select(*by, "a", "b", "cos", F.when(F.col("cos") < near, "near miss").otherwise(F.col("why")).alias("why")).filter("why is not null")


def generic_links(names: DataFrame, by: tuple[str, ...] = ("attr", "value"), key: Column | None = None, cosines: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """by, leaf, generic: another leaf of the class whose words (those of `key`, by default as written) are a strict part of a leaf's: the longest, ties by name; with cosines (by, leaf, generic, cos)
    the closest at or above `least`. Names whose last word is of ABOUT have none.

    Leaves meet on shared words, not in all pairs: a generic is found through its rarest word. names: by, leaf.
    """
    n = names.select(*by, "leaf", F.array_distinct(F.split(F.col("leaf") if key is None else key, " ")).alias("w"))
    e = n.select(*by, "leaf", "w", F.explode("w").alias("t"))
    f = e.groupBy(*by, "t").agg(F.count("*").alias("f"))
    rare = e.join(f.hint("merge"), [*by, "t"]).groupBy(*by, "leaf", "w").agg(F.min_by("t", F.struct("f", "t")).alias("t"))
    about = F.element_at(F.split("leaf", " "), -1).isin(ABOUT)
    p = e.filter(~about).join(rare.select(*by, F.col("leaf").alias("generic"), F.col("w").alias("gw"), "t").hint("merge"), [*by, "t"])
    p = p.filter((F.col("generic") != F.col("leaf")) & (F.size("gw") < F.size("w")) & (F.size(F.array_except("gw", "w")) == 0))
    order = F.struct(-F.size("gw"), "generic")
    if cosines is not None:
        p = p.join(cosines.hint("merge"), [*by, "leaf", "generic"]).filter(F.col("cos") >= least)
        order = F.struct(-F.col("cos"), "generic")
    return p.groupBy(*by, "leaf").agg(F.min_by("generic", order).alias("generic"))


def rule_folds(names: DataFrame, filler: list[str], by: tuple[str, ...] = ("attr", "value"), identity: Column | None = None, links: DataFrame | None = None, key: Column | None = None, done: DataFrame | None = None) -> DataFrame:
    """by, leaf, into: a leaf that is a sibling plus one word folds into it, by its first such word, where the guards of may_merge allow it; where `identity` holds (by default everywhere) only if the
    word is a filler. Elsewhere a linked specific (links: by, leaf, generic) folds into its generic. Chains end at their last name. names: by, leaf; words are those of `key`, by default as written.

    With a key, whose words are stems, fillers count by their stems, and the guards judge the keys. done (by, leaf, to_leaf): leaves that groups have merged already; they neither fold nor take folds in, and chains run on through them.
    """
    from .graph import resolve_chains

    identity = F.lit(True) if identity is None else identity
    named = F.col("leaf") if key is None else key
    fillers = F.array(*[F.lit(f) if key is None else X.stem(F.lit(f)) for f in filler])
    free = names if done is None else names.join(done.select(*by, "leaf").distinct().hint("merge"), [*by, "leaf"], "left_anti")
    w = free.select(*by, "leaf", named.alias("k"), F.array_distinct(F.split(named, " ")).alias("w")).withColumn("bag", F.array_join(F.array_sort("w"), " "))
    cut_ = F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.array_join(F.array_sort(F.array_remove("w", x)), " ").alias("bag")))
    less = w.filter(F.size("w") > 1).select(*by, "leaf", "k", F.inline(cut_)).filter(~identity | F.array_contains(fillers, F.col("x")))
    into = w.select(*by, F.col("leaf").alias("into"), F.col("k").alias("k2"), "bag")
    judged = (F.col("leaf"), F.col("into")) if key is None else (X.guard_normalise(F.col("k")), X.guard_normalise(F.col("k2")))
    p = less.join(into.hint("merge"), [*by, "bag"]).filter((F.col("leaf") != F.col("into")) & X.may_merge(*judged).isNull())
    f = p.groupBy(*by, "leaf").agg(F.min_by("into", F.struct("i", "into")).alias("into"))
    if links is not None:
        more = links.filter(~identity).groupBy(*by, "leaf").agg(F.min("generic").alias("into"))
        more = more if done is None else more.join(done.select(*by, "leaf").distinct().hint("merge"), [*by, "leaf"], "left_anti")
        f = f.unionByName(more.join(f.select(*by, "leaf").hint("merge"), [*by, "leaf"], "left_anti"))
    f = cut(f)
    name = lambda c: F.to_json(F.struct(*by, F.col(c).alias("leaf")))
    chain = f if done is None else f.unionByName(done.select(*by, "leaf", F.col("to_leaf").alias("into")).distinct())
    end = resolve_chains(chain.select(name("leaf").alias("name"), name("into").alias("to")))
    shape = ", ".join(f"{b} {dict(names.dtypes)[b]}" for b in by) + ", leaf string"
    out = end.select(F.from_json("name", shape).alias("n"), F.from_json("target", shape).alias("t")).select("n.*", F.col("t.leaf").alias("into"))
    return out if done is None else out.join(f.select(*by, "leaf").hint("merge"), [*by, "leaf"], "left_semi")


#: What a name that a model wrote is taken for.
_SAID = r"^[ .]+|[ .]+$"
_PROPOSED = ["attr", "value", "group_id"]


def _settled(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The groups of one class in order of their clips: each takes the members that no earlier one took, and stands if its name and another member are left."""
    taken: set[str] = set()
    out = []
    for _, g in rows.sort_values(["clips_all", "group_id", "leaf"], ascending=[False, True, True]).groupby("group_id", sort=False):
        left = g[~g["leaf"].isin(taken)]
        if len(left) >= 2 and (left["leaf"] == left["name"]).any():
            taken |= set(left["leaf"])
            out.append(left)
    cols = [*_PROPOSED, "name", "leaf"]
    return pd.concat(out)[cols] if out else rows.iloc[:0][cols]


def checked_proposals(groups: DataFrame, generic: DataFrame, misplaced: DataFrame, names: DataFrame, values: DataFrame, key, shares, identity: list[str], axes: list | None = None) -> dict[str, DataFrame]:
    """What a model proposed for the leaves of classes, after the checks: `groups` (attr, value, group_id, name, leaf), `generic` (attr, value, generic, leaf), `moved` (attr, value, leaf, to), `dropped` (attr, value, leaf).

    groups: attr, value, group_id, name, members; generic: attr, value, generic, specifics; misplaced: attr, value, leaf, move_to; names: attr, value, leaf, clips, admitted (one row a leaf); values: attr, value.
    key(leaf): the column that guards judge; shares(a, b): whether two names share a source, asked for the attributes of `identity`.

    Names are known apart from case and dots. A group needs two known members; its name is one of them, else the best one (admitted first, then by clips, then name). Members stay that may be one with the name and share its
    source; nodes of generic links go, but the name. Of groups of a class that hold a leaf, the one with more clips (then the smaller id) keeps it. A misplaced leaf is dropped on `drop`, moved to another
    known value of its attribute, else left alone.
    """
    said = lambda c: F.regexp_replace(F.lower(F.trim(c)), _SAID, "")
    known = names.select("attr", "value", F.lower("leaf").alias("_low"), "leaf", "clips", "admitted")

    def find(df: DataFrame, said_col: Column, to: str) -> DataFrame:
        """df with the known leaf `to` that a column names; rows without one have null."""
        k = known.select("attr", "value", F.col("_low").alias("_said"), F.col("leaf").alias(to))
        return df.withColumn("_said", said(said_col)).join(k.hint("merge"), ["attr", "value", "_said"], "left").drop("_said")

    # generic links
    g = find(generic.select("attr", "value", "generic", F.explode_outer("specifics").alias("_s")), F.col("generic"), "_g")
    g = find(g, F.col("_s"), "leaf").filter(F.col("_g").isNotNull() & F.col("leaf").isNotNull() & (F.col("leaf") != F.col("_g")))
    links = cut(g.select("attr", "value", F.col("_g").alias("generic"), "leaf").distinct())
    # groups: known members, then the name among them
    m = find(groups.select(*_PROPOSED, "name", F.explode("members").alias("_m")), F.col("_m"), "leaf").filter("leaf is not null")
    m = find(m.select(*_PROPOSED, F.col("name").alias("_n"), "leaf").distinct(), F.col("_n"), "_named").drop("_n")
    m = m.join(known.select("attr", "value", "leaf", "clips", "admitted").hint("merge"), ["attr", "value", "leaf"])
    of = W.partitionBy(*_PROPOSED)
    best = F.first("leaf").over(of.orderBy(F.desc("admitted"), F.desc("clips"), "leaf").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    m = m.withColumns({"_size": F.count("*").over(of), "_in": F.max((F.col("leaf") == F.col("_named")).cast("int")).over(of), "_best": best}).filter("_size >= 2")
    m = m.withColumn("name", F.when(F.col("_in") == 1, F.col("_named")).otherwise(F.col("_best")))
    why = X.may_merge(X.guard_normalise(key(F.col("leaf"))), X.guard_normalise(key(F.col("name"))), X.AXES if axes is None else axes)
    fits = why.isNull() & (~F.col("attr").isin(identity) | shares(F.col("leaf"), F.col("name")))
    m = m.filter((F.col("leaf") == F.col("name")) | fits).select(*_PROPOSED, "name", "leaf", "clips")
    m = m.withColumns({"_n": F.count("*").over(of), "clips_all": F.sum("clips").over(of)}).filter("_n >= 2")
    nodes = links.select("attr", "value", "leaf").unionByName(links.select("attr", "value", F.col("generic").alias("leaf"))).distinct().withColumn("_link", F.lit(True))
    m = m.join(nodes.hint("merge"), ["attr", "value", "leaf"], "left").filter(F.col("_link").isNull() | (F.col("leaf") == F.col("name")))
    m = m.withColumn("_n", F.count("*").over(of)).filter("_n >= 2").select(*_PROPOSED, "name", "leaf", "clips_all")
    kind = dict(groups.dtypes)["group_id"]
    kept = m.groupBy("attr", "value").applyInPandas(_settled, f"attr string, value string, group_id {kind}, name string, leaf string")  # what a model said of one class
    # leaves in a wrong place
    x = find(misplaced.select("attr", "value", F.col("leaf").alias("_l"), F.lower(F.trim("move_to")).alias("to")), F.col("_l"), "leaf").filter("leaf is not null")
    there = values.select("attr", F.col("value").alias("to")).distinct()
    moved = x.filter((F.col("to") != "drop") & (F.col("to") != F.col("value"))).join(there.hint("merge"), ["attr", "to"], "left_semi").select("attr", "value", "leaf", "to").distinct()
    return {"groups": kept, "generic": links, "moved": moved, "dropped": x.filter("to = 'drop'").select("attr", "value", "leaf").distinct()}


def cleaning_table(checked: dict[str, DataFrame], separation: DataFrame, judged: list[str], identity: list[str], folds, pruned: list[str]) -> DataFrame:
    """kind, attr, value, leaf, to: what the tree applies. `canon`: members of groups to the group's name, unless the vectors speak against it (separation: attr, value, group_id, separation; attributes of `judged` need a positive one, others
    go by the checks), and the folds; `generic`: links of identity attributes; `pruned`: attributes that go. folds(done): rule_folds with the leaves that groups merged."""
    g = checked["groups"].filter("leaf != name").join(separation.hint("merge"), _PROPOSED, "left")
    g = cut(g.filter(~F.col("attr").isin(judged) | F.coalesce(F.col("separation") > 0, F.lit(False))).groupBy("attr", "value", "leaf").agg(F.min("name").alias("to_leaf")))
    f = folds(g)
    row = lambda df, kind, to: df.select(F.lit(kind).alias("kind"), "attr", "value", "leaf", F.col(to).alias("to"))
    out = row(g, "canon", "to_leaf").unionByName(row(f, "canon", "into")).unionByName(row(checked["generic"].filter(F.col("attr").isin(identity)), "generic", "generic"))
    gone = g.sparkSession.createDataFrame([("pruned", a, None, None, None) for a in pruned], "kind string, attr string, value string, leaf string, to string")
    return out.unionByName(gone)


def proposal_guards(groups: DataFrame, names: DataFrame, why: Column, by: tuple[str, ...] = (), links: DataFrame | None = None) -> DataFrame:
    """by, group_id, canon, leaf: proposed groups after the checks. groups: by, group_id, canon, leaf; names: by, leaf, clips; links: by, leaf (nodes of generic links); why: null if leaf and canon may be one.

    Members are known names; the group's name is one of them. Members that may not be one with the name go, as do nodes of generic links but the name itself. Of two groups that hold a leaf the
    one with more clips keeps it. Groups need two members, the name among them.
    """
    by = list(by)
    known = names.select(*by, "leaf", "clips").distinct()
    g = groups.select(*by, "group_id", "canon", "leaf").unionByName(groups.select(*by, "group_id", "canon", F.col("canon").alias("leaf"))).distinct()
    g = g.join(known.hint("merge"), [*by, "leaf"]).join(known.select(*by, F.col("leaf").alias("canon")).hint("merge"), [*by, "canon"], "left_semi")
    of = W.partitionBy(*by, "group_id")
    two = lambda d: d.withColumn("_n", F.count("*").over(of)).filter("_n >= 2").drop("_n")
    g = two(g.filter((F.col("leaf") == F.col("canon")) | why.isNull()))
    if links is not None:
        node = links.select(*by, "leaf", F.lit(True).alias("_l")).distinct()
        g = two(g.join(node.hint("merge"), [*by, "leaf"], "left").filter((F.col("leaf") == F.col("canon")) | F.col("_l").isNull()).drop("_l"))
    g = g.withColumn("_m", F.sum("clips").over(of))
    g = g.withColumn("_r", F.row_number().over(W.partitionBy(*by, "leaf").orderBy(F.desc("_m"), "group_id"))).filter("_r = 1")
    g = two(g.withColumn("_own", F.max((F.col("leaf") == F.col("canon")).cast("int")).over(of)).filter("_own = 1"))
    return g.select(*by, "group_id", "canon", "leaf")


def apply_table(groups: DataFrame, flags: DataFrame, folds: DataFrame, by: tuple[str, ...] = (), judged: Column | None = None) -> DataFrame:
    """by, leaf, to_leaf: members of groups whose separation is positive, or which nothing can judge (`judged` false), to the group's name, and the folds (by, leaf, into) of other leaves.

    groups: by, group_id, canon, leaf; flags: by, group_id, separation (null or no row: not scored).
    """
    by = list(by)
    g = groups.filter("leaf != canon").join(flags.hint("merge"), [*by, "group_id"], "left")
    ok = F.coalesce(F.col("separation") > 0, F.lit(False))
    g = g.filter(ok | ~judged if judged is not None else ok).groupBy(*by, "leaf").agg(F.min("canon").alias("to_leaf"))
    return g.unionByName(folds.join(g.select(*by, "leaf").hint("merge"), [*by, "leaf"], "left_anti").select(*by, "leaf", F.col("into").alias("to_leaf")))


def placement_checks(placed: DataFrame, attrs: DataFrame, generic: DataFrame, known: DataFrame, routed: list[str]) -> DataFrame:
    """id, attr, value, same_as, verdict of proposed placements (id, name, attr, value, new_value, same_as, yes).

    verdict: `generic` (id in generic), a name of `routed` where that is the attribute, `unresolved` (attribute not in attrs, or no class; a new class wins over the listed one), `removed` (the check said no),
    else `placed`. A merge is kept only if its target lies in the same place (known: name, attr, value), or both names share a content word; then the target's place wins.
    """
    p = placed.withColumn("value", F.coalesce(F.lower(F.trim("new_value")), "value"))
    p = p.join(generic.select("id", F.lit(True).alias("_g")).distinct().hint("merge"), "id", "left").join(attrs.select("attr", F.lit(True).alias("_a")).distinct().hint("merge"), "attr", "left")
    p = p.join(known.select(F.col("name").alias("same_as"), F.col("attr").alias("_ta"), F.col("value").alias("_tv")).hint("merge"), "same_as", "left")
    agree = (F.col("_ta") == F.col("attr")) & (F.col("_tv") == F.col("value"))
    share = F.arrays_overlap(X.content_words(F.col("name")), X.content_words(F.col("same_as")))
    move = F.coalesce(share & ~agree & F.col("_ta").isNotNull(), F.lit(False))
    keep = F.coalesce(agree, F.lit(False)) | F.coalesce(share, F.lit(False))
    verdict = F.when(F.col("_g").isNotNull(), "generic").when(F.col("attr").isin(routed), F.col("attr")).when(F.col("_a").isNull() | F.col("value").isNull() | (F.col("value") == ""), "unresolved").when(~F.col("yes"), "removed").otherwise("placed")
    return p.select("id", F.when(move, F.col("_ta")).otherwise(F.col("attr")).alias("attr"), F.when(move, F.col("_tv")).otherwise(F.col("value")).alias("value"), F.when(keep, F.col("same_as")).alias("same_as"), verdict.alias("verdict"))

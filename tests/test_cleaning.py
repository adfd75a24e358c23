"""The cleaning chain from proposals to the table that the tree applies, against plain loops over the same guards."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from canopy.functions import text as X
from canopy.operators import entity as E

GENERIC = ["loud", "small"]
KEY = lambda c: X.norm_key(c)
SHARES = lambda a, b: X.shares_source(a, b, GENERIC)
NAMES = ["dog", "dogs barking", "small dog", "no dog", "two dogs", "3 dogs", "siren", "alarm siren", "police siren", "goat bleating", "sheep bleating", "rain", "rain recording", "heavy rain", "light rain", "fast beat", "slow beat", "beat", "beat music", "horn"]


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(6)
    places = [("sound.event", "a"), ("sound.event", "b"), ("music.mood", "c")]
    names = [(a, v, n, r.randint(1, 30), r.random() < 0.6) for a, v in places for n in NAMES if r.random() < 0.85]
    case_of = lambda n: r.choice([n, n.upper(), f" {n}. "])
    groups = [(*r.choice(places), i, case_of(r.choice([*NAMES, "unheard"])), [case_of(r.choice([*NAMES, "unheard"])) for _ in range(r.randint(1, 6))]) for i in range(60)]
    generic = [(*r.choice(places), case_of(r.choice(["rain", "siren", "unheard"])), [case_of(r.choice(NAMES)) for _ in range(r.randint(0, 2))]) for _ in range(4)]
    misplaced = [(*r.choice(places), case_of(r.choice([*NAMES, "unheard"])), r.choice(["drop", "A", "b ", "c", "nowhere"])) for _ in range(30)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    frames = [
        frame(groups, "attr string, value string, group_id int, name string, members array<string>"), frame(generic, "attr string, value string, generic string, specifics array<string>"),
        frame(misplaced, "attr string, value string, leaf string, move_to string"), frame(names, "attr string, value string, leaf string, clips long, admitted boolean"), frame(places, "attr string, value string"),
    ]
    pairs = frame([(a, b) for a in NAMES for b in NAMES], "a string, b string")
    verdicts = {(p.a, p.b): (p.why is None, p.same) for p in pairs.select("a", "b", X.may_merge(X.guard_normalise(KEY(F.col("a"))), X.guard_normalise(KEY(F.col("b")))).alias("why"), SHARES(F.col("a"), F.col("b")).alias("same")).collect()}
    return names, groups, generic, misplaced, places, frames, verdicts


def brute(names, groups, generic, misplaced, places, verdicts):
    said = lambda s: s.strip().lower().strip(" .")
    at = {}
    for a, v, n, c, ok in names:
        at.setdefault((a, v), {})[n] = (c, ok)
    kept, links = [], set()
    for a, v, g, sp in generic:
        g = said(g)
        links |= {(a, v, g, said(s)) for s in sp if g in at[a, v] and said(s) in at[a, v] and said(s) != g}
    nodes = {(a, v, x) for a, v, g, s in links for x in (g, s)}
    for a, v, i, name, members in groups:
        known = at[a, v]
        m = {said(x) for x in members if said(x) in known}
        if len(m) < 2:
            continue
        n = said(name) if said(name) in m else min(m, key=lambda x: (not known[x][1], -known[x][0], x))
        m = {x for x in m if x == n or (verdicts[x, n][0] and (a == "music.mood" or verdicts[x, n][1]))}
        if len(m) < 2:
            continue
        clips = sum(known[x][0] for x in m)
        m = {x for x in m if x == n or (a, v, x) not in nodes}
        if len(m) >= 2:
            kept.append((-clips, i, a, v, n, m))
    out, taken = set(), set()
    for _, i, a, v, n, m in sorted(kept):
        m = {x for x in m if (a, v, x) not in taken}
        if n in m and len(m) >= 2:
            taken |= {(a, v, x) for x in m}
            out |= {(a, v, i, n, x) for x in m}
    moved = {(a, v, said(x), to.strip().lower()) for a, v, x, to in misplaced if said(x) in at[a, v] and to != "drop" and (a, to.strip().lower()) in places and to.strip().lower() != v}
    return out, links, moved, {(a, v, said(x)) for a, v, x, to in misplaced if said(x) in at[a, v] and to == "drop"}


def test_checked_proposals(case):
    names, groups, generic, misplaced, places, frames, verdicts = case
    got = E.checked_proposals(*frames, KEY, SHARES, ["sound.event"])
    want = brute(names, groups, generic, misplaced, places, verdicts)
    for k, w in zip(("groups", "generic", "moved", "dropped"), want, strict=True):
        assert {tuple(r) for r in got[k].collect()} == w, k
        assert w, k
    assert max(Counter((a, v, x) for a, v, _, _, x in want[0]).values()) == 1


def test_folds_by_stems(spark):
    """`rain recording` folds into `rain` though its key says `record`; identity classes fold by fillers only; merged leaves are left out, and chains run on through them."""
    n = spark.createDataFrame([("sound.event", "w", x) for x in ("rain", "rain recording", "acid rain", "two rain")] + [("music.mood", "c", x) for x in ("calm", "very calm", "calm piano", "no calm")], "attr string, value string, leaf string")
    identity = F.col("attr") == "sound.event"
    got = {(r.attr, r.leaf): r.into for r in E.rule_folds(n, X.FOLD_FILLER, identity=identity, key=KEY(F.col("leaf"))).collect()}
    assert got["sound.event", "rain recording"] == "rain" and ("sound.event", "acid rain") not in got and ("sound.event", "two rain") not in got
    assert got["music.mood", "calm piano"] == "calm" and ("music.mood", "no calm") not in got
    done = spark.createDataFrame([("sound.event", "w", "rain", "acid rain"), ("music.mood", "c", "calm piano", "calm")], "attr string, value string, leaf string, to_leaf string")
    after = {(r.attr, r.leaf): r.into for r in E.rule_folds(n, X.FOLD_FILLER, identity=identity, key=KEY(F.col("leaf")), done=done).collect()}
    assert ("sound.event", "rain recording") not in after and ("music.mood", "calm piano") not in after
    links = spark.createDataFrame([("music.mood", "c", "no calm", "calm piano")], "attr string, value string, leaf string, generic string")
    linked = {r.leaf: r.into for r in E.rule_folds(n, X.FOLD_FILLER, identity=identity, key=KEY(F.col("leaf")), done=done, links=links).collect()}
    assert linked["no calm"] == "calm"  # through the group that merged calm piano


def test_cleaning_table(spark, case):
    *_, frames, _ = case
    checked = E.checked_proposals(*frames, KEY, SHARES, ["sound.event"])
    g = checked["groups"].select("attr", "value", "group_id").distinct()
    sep = g.withColumn("separation", F.when(F.col("group_id") % 3 == 0, 0.2).when(F.col("group_id") % 3 == 1, -0.1)).filter("group_id % 4 != 2")
    names = frames[3].select("attr", "value", "leaf")
    t = E.cleaning_table(checked, sep, ["sound.event"], ["sound.event"], lambda done: E.rule_folds(names, X.FOLD_FILLER, identity=F.col("attr") == "sound.event", key=KEY(F.col("leaf")), done=done), ["speech.x"]).collect()
    kinds = Counter(r.kind for r in t)
    assert kinds["pruned"] == 1 and kinds["canon"] > 3 and {r.attr for r in t if r.kind == "generic"} <= {"sound.event"}
    sure = {(r.attr, r.value, r.group_id) for r in sep.filter("separation > 0").collect()}
    canon = {(r.attr, r.value, r.leaf): r.to for r in t if r.kind == "canon"}
    for r in checked["groups"].filter("leaf != name").collect():
        applied = canon.get((r.attr, r.value, r.leaf)) == r.name
        assert applied or not (r.attr == "music.mood" or (r.attr, r.value, r.group_id) in sure)


def labels_of(aspects):
    """The rules in a plain loop."""
    import re

    from canopy.functions import aspects as A

    a, out = [x.lower().strip() for x in aspects], set()
    whole, any_ = " | ".join(a), lambda xs, ws: any(re.search(A.words(*ws), x) for x in xs)
    voiced = [x for x in a if (not x.startswith("no ") and re.search(A.VOICE, x)) or re.search(A.words("rap", "rapping", "choir", "choral"), x)]
    out |= {("music.instrument", c) for c, ws in A.INSTRUMENT if re.search(A.words(*ws), whole)} | {("music.vocal_style", c) for c, ws in A.VOCAL_STYLE if any_(voiced, ws)}
    male, female = any_(voiced, ["male", "man", "men", "boy", "boys"]), any_(voiced, ["female", "woman", "women", "girl", "girls"])
    rules = [("rap vocals", any_(voiced, ["rap", "rapping", "rapper"])), ("choir", any_(voiced, ["choir", "choral"])), ("mixed vocals", (male and female) or any("duet" in x for x in a)), ("male vocals", male), ("female vocals", female), ("no vocals", not voiced and any(x in A.NO_VOCALS for x in a))]
    out |= {("music.vocals", c) for c in [c for c, yes in rules if yes][:1]}
    hits = [c for x in a if not re.search(A.VOICE_ANYWHERE, x) for c, ws in A.MOOD if re.search(A.words(*ws), x)]
    out |= {("music.mood", c) for c in sorted(dict.fromkeys(hits), key=lambda c: (-hits.count(c), hits.index(c)))[:1]}
    production = [c for c, ws in A.PRODUCTION if re.search(A.words(*ws), whole)][:1]
    fidelity = [c for c, ws in A.FIDELITY if re.search(A.words(*ws), whole)][:1] or ([] if production else ["clean recording"])
    return out | {("music.production", c) for c in production} | {("music.fidelity", c) for c in fidelity}


def test_music_labels(spark):
    from canopy.operators.items import music_labels
    from canopy.plans.text_queries import aspects_of

    a = aspects_of(spark.range(1, 1500))
    by = {}
    for r in a.orderBy("id", "ord").collect():
        by.setdefault(r.id, []).append(r.aspect)
    want = sorted((i, *x) for i, xs in by.items() for x in labels_of(xs))
    assert sorted(map(tuple, music_labels(a).collect())) == want and len({x[2] for x in want}) > 45

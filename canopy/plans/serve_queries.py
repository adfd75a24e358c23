"""Queries over scores, vectors, graphs and serving, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import metrics as M
from ..operators import serve as S
from ..operators import vectors as V
from .catalog import query

P = "pr as (select *, exp(logit - m) / sum(exp(logit - m)) over (partition by vec_id) p from (select *, max(logit) over (partition by vec_id) m from logits)), pd as (select vec_id, gold, arg_min(k, (-logit, k)) pred from logits group by 1,2)"


NV = "nv as (select vec_id, label, side, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) x from vectors)"
CEN = f"{NV}, dm as (select label, unnest(range(1, 65)) d, x from nv), mv as (select label, d, avg(x[d]) v from dm group by 1,2), cl as (select label, list(v order by d) c from mv group by 1), cn as (select label, list_transform(c, lambda z: z / sqrt(list_inner_product(c, c))) c from cl)"


def _r(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


def _p(logits):
    return M.softmax(logits, ("vec_id",))


@query("class_metrics", "logits", sql=f"with {P}, x as (select *, 'all' part from pd union all select *, case when vec_id % 3 = 0 then 'first' else 'other' end from pd), c as (select part, gold, count(*) n, sum(case when gold = pred then 1 else 0 end) hit from x group by 1,2), k as (select part, count(distinct vec_id % 50) clips from x group by 1) select part, sum(n)::bigint n, any_value(clips) clips, round(sum(hit)::double / sum(n), 6) accuracy, round(avg(hit::double / n), 6) balanced, round(max(n)::double / sum(n), 6) majority from c join k using (part) group by 1")
def class_metrics(logits):
    p = M.predictions(logits).withColumns({"clip": F.col("vec_id") % 50, "first": F.col("vec_id") % 3 == 0})
    return _r(M.split_metrics(p), "accuracy", "balanced", "majority")


@query("skill_score", "logits", sql=f"with {P}, c as (select gold, count(*) n, sum(case when gold = pred then 1 else 0 end) hit from pd group by 1) select round(avg(hit::double / n), 6) balanced, round((avg(hit::double / n) - 0.1) / 0.9, 6) skill from c")
def skill_score(logits):
    return _r(M.skill_score(M.predictions(logits), 10), "balanced", "skill")


REC = "rec as (select vec_id, max(p) conf, max(gold) gold, arg_min(k, (-logit, k)) pred from pr group by 1)"


def _records(logits):
    return _p(logits).groupBy("vec_id").agg(F.max("p").alias("conf"), (F.max("gold") == F.min_by("k", F.struct(-F.col("logit"), "k"))).alias("right"))


@query("leaf_metrics", "logits", sql=f"with {P}, {REC} select round(avg(case when gold % 3 = pred % 3 then case when gold = pred then 1.0 else 0.0 end end), 6) given_class, round(avg(case when gold = pred then 1.0 else 0.0 end), 6) end_to_end from rec")
def leaf_metrics(logits):
    p = M.predictions(logits).select((F.col("gold") % 3 == F.col("pred") % 3).alias("class_ok"), (F.col("gold") == F.col("pred")).alias("leaf_ok"))
    return _r(M.leaf_metrics(p), "given_class", "end_to_end")


TS = [round(0.95 - 0.05 * i, 2) for i in range(16)]


@query("fit_leaf_threshold", "logits", sql=f"with {P}, {REC}, t as (select 0.20 + 0.05 * i t from range(0, 16) r(i)), s as (select round(t, 2)::double t, sum(case when conf >= round(t, 2)::double then 1 else 0 end) s, sum(case when conf >= round(t, 2)::double and gold = pred then 1 else 0 end) r, count(*) n from t, rec group by 1), ok as (select * from s where s >= 10 and r >= 0.08 * s) select coalesce(min(t), 1.01)::double threshold, round(coalesce(arg_min(s::double / n, t), 0.0), 6) coverage from ok")
def fit_leaf_threshold(logits):
    return _r(M.fit_leaf_threshold(_records(logits), TS, 10, 0.08), "coverage")


@query("temperature_grid", "logits", sql="with t as (select unnest([0.5, 1.0, 1.5, 2.0, 3.0])::double temperature), z as (select vec_id, temperature, ln(sum(exp(logit / temperature))) - max(case when k = gold then logit end) / temperature nll from logits, t group by 1,2), a as (select temperature, avg(nll) nll from z group by 1) select temperature, round(nll, 6) nll, row_number() over (order by nll, temperature) = 1 best from a")
def temperature_grid(logits):
    return _r(M.temperature_grid(logits, [0.5, 1.0, 1.5, 2.0, 3.0]), "nll")


@query("f1_threshold", "logits", sql=f"with {P}, t as (select unnest([0.05, 0.1, 0.15, 0.2, 0.3, 0.5])::double threshold), a as (select threshold, 2.0::double * sum(case when p >= threshold and k = gold then 1 else 0 end) / greatest(sum(case when p >= threshold then 1 else 0 end) + sum(case when k = gold then 1 else 0 end), 1) f1 from pr, t group by 1) select threshold, round(f1, 6) f1, row_number() over (order by f1 desc, threshold) = 1 best from a")
def f1_threshold(logits):
    return _r(M.f1_threshold(_p(logits).withColumn("y", (F.col("k") == F.col("gold")).cast("int")), [0.05, 0.1, 0.15, 0.2, 0.3, 0.5]), "f1")


@query("average_precision", "logits", sql="with s as (select k, logit p, count(*) n, sum(case when k = gold then 1 else 0 end) pos from logits group by 1,2), c as (select *, sum(n) over (partition by k order by p desc) cn, sum(pos) over (partition by k order by p desc) cp, sum(pos) over (partition by k) al from s) select k, round(sum(pos::double / al * cp / cn), 6) ap from c where al >= 5 group by 1")
def average_precision(logits):
    return _r(M.average_precision(logits.select("k", F.col("logit").alias("p"), (F.col("k") == F.col("gold")).cast("int").alias("y"))), "ap")


@query("serving_encoder", "logits", sql="with m as (select k attr, gold % 3 as ord, avg(logit) m1, avg(logit * logit) m2 from logits where gold % 3 <> 1 or k % 2 = 0 group by 1,2) select attr, arg_min(ord, (-(m1 + m2) / 2, ord)) encoder from m group by 1")
def serving_encoder(logits):
    m = logits.filter("gold % 3 <> 1 or k % 2 = 0").groupBy(F.col("k").alias("attr"), (F.col("gold") % 3).alias("ord")).agg(F.avg("logit").alias("m1"), F.avg(F.col("logit") * F.col("logit")).alias("m2"))
    return M.serving_encoder(m.withColumn("encoder", F.col("ord")))


SOFT = "h as (select item, tag1 as value, tag2 as leaf, 1.0::double y from tags where item % 3 = 0 union all select item, tag1, '', 1.0 from tags where item % 3 = 0), sf as (select item, value, leaf, least(sum(s), 1.0) y from (select item, tag1 as value, tag2 as leaf, soft s from tags union all select item, tag1, '', soft / 2 from tags) where s >= 0.05 group by 1,2,3), tg as (select item, value, leaf, max(y) y from (select * from h union all select * from sf) group by 1,2,3)"


def _targets(tags):
    hard = tags.filter("item % 3 = 0").select("item", F.col("tag1").alias("value"), F.col("tag2").alias("leaf"))
    soft = tags.select("item", F.col("tag1").alias("value"), F.col("tag2").alias("leaf"), F.col("soft").alias("s")).unionByName(tags.select("item", F.col("tag1").alias("value"), F.lit("").alias("leaf"), (F.col("soft") / 2).alias("s")))
    return M.soft_targets(hard, soft, 0.05)


@query("soft_targets", "tags", sql=f"with {SOFT} select item, value, leaf, round(y, 6) y from tg")
def soft_targets(tags):
    return _r(_targets(tags), "y")


@query("unknown_mask", "tags", sql=f"with {SOFT} select item, value, leaf, not (leaf <> '' and coalesce(c, 0) >= 0.5 and l < 0.5) known from (select *, max(case when leaf = '' then y end) over (partition by item, value) c, max(case when leaf <> '' then y end) over (partition by item, value) l from tg)")
def unknown_mask(tags):
    return M.unknown_mask(_targets(tags)).select("item", "value", "leaf", "known")


@query("conditional_mask", "tags", sql=f"with {SOFT}, g as (select value, leaf, sum(case when y >= 0.5 then 1 else 0 end)::bigint pos, sum(case when y < 0.5 then 1 else 0 end)::bigint neg from (select *, max(y) over (partition by item, value) c from tg) where c > 0 group by 1,2) select *, round(sqrt(greatest(1.0, least(30.0, neg::double / greatest(pos, 1)))), 6) weight from g")
def conditional_mask(tags):
    return _r(M.conditional_weights(_targets(tags)), "weight")


ANS = "an as (select id, gold, grp, dev, arg_min(k, (-ours, k)) a_ours, arg_min(k, (-(ours + 0.1 * blind), k)) a_prior, arg_min(k, (-blind, k)) a_blind from letters group by 1,2,3,4)"


@query("answer_with_prior", "letters", sql=f"with {ANS} select * from an")
def answer_with_prior(letters):
    return M.answers(letters)


@query("answer_accuracy", "letters", sql=f"with {ANS}, x as (select *, 'all' part from an union all select *, 'test' from an where not dev) select part, grp, count(*) n, round(avg(case when a_ours = gold then 1.0 else 0.0 end), 6) a_ours, round(avg(case when a_prior = gold then 1.0 else 0.0 end), 6) a_prior, round(avg(case when a_blind = gold then 1.0 else 0.0 end), 6) a_blind from x group by grouping sets ((part, grp), (part))")
def answer_accuracy(letters):
    return _r(M.answer_accuracy(M.answers(letters)), "a_ours", "a_prior", "a_blind")


@query("select_template", "letters", sql="select k as template, round(avg(ours), 6) mean from letters group by 1 order by avg(ours) desc, 1 limit 1")
def select_template(letters):
    return _r(M.select_template(letters.select(F.col("k").alias("template"), F.col("grp").alias("benchmark"), F.col("ours").alias("score"))), "mean")


@query("items_summary", "items", sql="with c as (select genus, grp, count(*) n from items group by 1,2), k as (select genus, count(distinct gold_name) n_clips from items group by 1) select genus, sum(n)::bigint n_items, any_value(n_clips) n_clips, string_agg(grp || '=' || cast(n as varchar), ', ' order by grp) groups from c join k using (genus) group by 1")
def items_summary(items):
    return M.items_summary(items, "genus", "grp", "gold_name")


PROBE = "od as (select vec_id, gold, arg_min(k, (-logit, k)) pred from logits where k = gold or k % 3 = vec_id % 3 group by 1,2)"


@query("probe_metrics", "logits", "vectors", sql=f"with {P}, {PROBE}, {CEN}, ne as (select vec_id, arg_min(cn.label, (-list_inner_product(x, c), cn.label)) nearest from nv, cn group by 1) select pd.gold, count(*) n, round(avg(case when pd.gold = pd.pred then 1.0 else 0.0 end), 6) accuracy, round(avg(case when pd.gold = od.pred then 1.0 else 0.0 end), 6) restricted, round(avg(case when pd.pred = 9 then 1.0 else 0.0 end), 6) abstained, round(avg(case when pd.gold = nearest then 1.0 else 0.0 end), 6) centroid from pd left join od on od.vec_id = pd.vec_id left join ne on ne.vec_id = pd.vec_id group by 1")
def probe_metrics(logits, vectors):
    options = logits.filter("k = gold or k % 3 = vec_id % 3").select("vec_id", "k")
    near = V.nearest_centroid(vectors, V.centroids(vectors))
    return _r(M.probe_metrics(logits, options, near, 9), "accuracy", "restricted", "abstained", "centroid")


@query("dev_shot_split", "letters", sql="select id, case when r <= 100 then 'select' when r <= 103 then 'shots' else 'test' end part from (select id, row_number() over (order by id) r from (select distinct id from letters))")
def dev_shot_split(letters):
    from pyspark.sql import Window as W

    ids = letters.select("id").distinct()
    first = ids.orderBy(F.asc_nulls_last("id")).limit(103)  # the window never numbers more
    first = first.select(F.col("id").alias("_id"), F.row_number().over(W.orderBy(F.asc_nulls_last("id"))).alias("r"))
    part = F.when(F.col("r") <= 100, "select").when(F.col("r") <= 103, "shots").otherwise("test")
    return ids.join(F.broadcast(first), F.col("id").eqNullSafe(F.col("_id")), "left").select("id", part.alias("part"))


# serving -----------------------------------------------------------------------------------------


@query("region_gate", "logits", sql="with p as (select vec_id % 50 clip, vec_id row_id, k region, 1/(1+exp(-logit)) p from logits) select clip, row_id, region from p where p >= 0.5 union all select clip, null, region from p group by 1,3 having avg(p) >= 0.5")
def region_gate(logits):
    return S.region_gate(logits.select((F.col("vec_id") % 50).alias("clip"), F.col("vec_id").alias("row_id"), F.col("k").alias("region"), "logit"))


@query("decide_single", "logits", sql="with z as (select vec_id % 50 clip, vec_id, k as value, logit / 0.5 z from logits), l as (select *, z - ln(sum(exp(z)) over (partition by clip, vec_id)) lp from z), c as (select clip, value, exp(avg(lp)) p from l group by 1,2), b as (select clip, arg_min(value, (-p, value)) as value, max(p) p from c group by 1), f as (select vec_id % 50 clip, k as value, 'n' || cast(gold as varchar) as leaf, avg(exp(logit) / (1 + exp(logit))) p from logits group by 1,2,3), t as (select clip, value, arg_min(leaf, (-p, leaf)) as leaf, max(p) p from f group by 1,2) select b.clip, b.value, round(b.p, 6) p, case when t.p >= 0.52 then t.leaf else '' end as leaf from b left join t on t.clip = b.clip and t.value = b.value where b.p >= 0.11")
def decide_single(logits):
    s = logits.select((F.col("vec_id") % 50).alias("clip"), F.col("vec_id").alias("row_id"), F.col("k").alias("value"), "logit", "gold")
    leaves = s.groupBy("clip", "value", F.concat(F.lit("n"), F.col("gold").cast("string")).alias("leaf")).agg(F.avg(F.exp("logit") / (1 + F.exp("logit"))).alias("p"))
    return _r(S.decide_single(s.drop("gold"), 0.5, 0.11, leaves=leaves, leaf_at=0.52), "p")


LEAF = "lf as (select vec_id, k % 5 as value, k, exp(logit) / sum(exp(logit)) over (partition by vec_id, k % 5) p from logits), tl as (select vec_id, value, k, p, row_number() over (partition by vec_id, value order by p desc, k) r from lf)"


def _leaves(logits):
    return S.top_leaves(logits.select("vec_id", (F.col("k") % 5).alias("value"), "k", "logit"), 3, 0.3)


@query("top_leaves", "logits", sql=f"with {LEAF} select vec_id, value, k, round(p, 6) p from tl where r <= 3 and p >= 0.3")
def top_leaves(logits):
    return _r(_leaves(logits).select("vec_id", "value", "k", "p"), "p")


@query("decide_multi", "logits", sql=f"with {P}, {LEAF}, c as (select vec_id, k as value, p from pr where p >= 0.11 and k < 5) select c.vec_id, c.value, round(c.p, 6) p, t.k as leaf from c left join (select * from tl where r <= 3 and p >= 0.3) t on c.vec_id = t.vec_id and c.value = t.value")
def decide_multi(logits):
    c = _p(logits).filter("k < 5").select("vec_id", F.col("k").alias("value"), "p")
    return _r(S.decide_multi(c, 0.11, _leaves(logits).select("vec_id", "value", F.col("k").alias("leaf"))), "p")


@query("domain_abstain", "logits", sql=f"with {P} select vec_id, case when max(case when k = 9 then p end) >= 0.11 then 9 else arg_min(case when k <> 9 then k end, (-p, k)) filter (where k <> 9) end k from pr group by 1")
def domain_abstain(logits):
    return S.domain_abstain(_p(logits), 9, 0.11)


RANKED = "rk as (select *, row_number() over (partition by vec_id order by p desc, k) as rnk from pr)"


@query("top_classes", "logits", sql=f"with {P}, {RANKED} select vec_id, k, rnk as rank, round(p, 6) p from rk where rnk <= 3 and (rnk = 1 or p >= 0.115)")
def top_classes(logits):
    return _r(S.top_classes(_p(logits), 3, 0.115).select("vec_id", "k", "rank", "p"), "p")


@query("top_nodes", "logits", sql=f"with {P}, {RANKED}, t as (select *, k % 5 as value, k >= 5 is_leaf from rk where rnk <= 4 and (rnk = 1 or p >= 0.1)) select vec_id, k from (select *, max(case when is_leaf then 1 else 0 end) over (partition by vec_id, value) h from t) where h = 0 or is_leaf")
def top_nodes(logits):
    return S.top_nodes(_p(logits).withColumns({"value": F.col("k") % 5, "is_leaf": F.col("k") >= 5}), 4, 0.1).select("vec_id", "k")


@query("best_leaf", "logits", sql=f"with {P} select vec_id, case when arg_min(k, (-p, k)) > 0 and max(p) >= 0.12 then arg_min(k, (-p, k)) else 0 end k from pr group by 1")
def best_leaf(logits):
    return S.best_leaf(_p(logits), 0.12, ("vec_id",))


@query("sound_identity", "logits", sql=f"with {P}, w as (select distinct vec_id % 40 clip, vec_id row_id, vec_id % 7 = 0 open from logits), u as (select clip, row_id from (select *, max(case when open then 1 else 0 end) over (partition by clip) a from w) where open or a = 0), m as (select u.clip, k % 5 as value, case when k >= 5 then 'l' || cast(k as varchar) else '' end as leaf, max(p) p from pr join u on pr.vec_id = u.row_id group by 1,2,3 having max(p) >= 0.115), c as (select * from (select *, row_number() over (partition by clip order by p desc, value) r from m where leaf = '') where r <= 2), f as (select m.* from m join c on c.clip = m.clip and c.value = m.value where m.leaf <> '') select clip, value, leaf, round(p, 6) p from f union all select clip, value, leaf, round(p, 6) from c where not exists (select 1 from f where f.clip = c.clip and f.value = c.value)")
def sound_identity(logits):
    leaf = F.when(F.col("k") >= 5, F.concat(F.lit("l"), F.col("k").cast("string"))).otherwise("")
    s = _p(logits).select((F.col("vec_id") % 40).alias("clip"), F.col("vec_id").alias("row_id"), (F.col("k") % 5).alias("value"), leaf.alias("leaf"), "p")
    w = logits.select((F.col("vec_id") % 40).alias("clip"), F.col("vec_id").alias("row_id"), (F.col("vec_id") % 7 == 0).alias("open")).distinct()
    return _r(S.sound_identity(s, w, 0.115), "p")


@query("threshold_heads", "logits", sql=f"with {P}, b as (select vec_id clip, k % 2 head, arg_min(k, (-p, k)) as value, max(p) p from pr where vec_id % 3 = 0 group by 1,2) select clip, head, value, round(p, 6) p from b where p >= 0.13")
def threshold_heads(logits):
    s = _p(logits).select(F.col("vec_id").alias("clip"), (F.col("k") % 2).alias("head"), F.col("k").alias("value"), "p")
    return _r(S.threshold_heads(s, logits.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("clip")).distinct(), 0.13), "p")


@query("chunk_region_filter", "logits", sql="select vec_id row_id, k region, gold from logits where 1/(1+exp(-logit)) >= 0.5")
def chunk_region_filter(logits):
    s = logits.select(F.col("vec_id").alias("row_id"), F.col("k").alias("region"), "gold", "logit")
    return S.chunk_region_filter(s.drop("logit"), s.filter(1 / (1 + F.exp(-F.col("logit"))) >= 0.5))


@query("transcript_override", "label_rows", "qa", sql="with s as (select distinct clip, attr, value from label_rows), h as (select conv_id clip, max(text) text, 'spoken' as value from qa group by 1 having length(max(text)) >= 8) select * from s where not (attr = 'Brand#11' and clip in (select clip from h)) union all select clip, 'Brand#11', value from h")
def transcript_override(label_rows, qa):
    h = qa.groupBy(F.col("conv_id").alias("clip")).agg(F.max("text").alias("text")).withColumns({"value": F.lit("spoken"), "p": F.lit(0.9)})
    return S.transcript_override(label_rows.select("clip", "attr", "value").distinct(), h, "Brand#11")


@query("question_fallback", "letters", sql="with a as (select grp clip, bool_or(ours >= 0.3) asked from letters group by 1), i as (select id, grp clip, max(ours) s from letters group by 1,2), n as (select distinct grp clip, k node, k % 2 = 1 fb from letters) select i.id, node, asked from i join n on n.clip = i.clip join a on a.clip = i.clip where not fb or s >= 0.3")
def question_fallback(letters):
    items = letters.select("id", F.col("grp").alias("clip"), F.col("ours").alias("score"))
    nodes = letters.select(F.col("grp").alias("clip"), F.col("k").alias("node"), (F.col("k") % 2 == 1).alias("fallback")).distinct()
    return S.item_nodes(items, nodes, 0.3).join(S.question_fallback(items, 0.3).hint("merge"), "clip").select("id", "node", "asked")


@query("owner_resolution", "label_rows", sql="select clip, attr, arg_max(value, (seq, value)) as value from label_rows group by 1,2")
def owner_resolution(label_rows):
    return S.owner_resolution(label_rows.select("clip", "attr", "value", F.col("seq").alias("ord")))


@query("joint_probability", "logits", sql=f"with {P} select c.vec_id, c.k node, round(c.p * coalesce(u.p, 1.0), 8) joint from pr c left join pr u on c.vec_id = u.vec_id and c.k >= 5 and u.k = c.k - 5")
def joint_probability(logits):
    s = _p(logits).select("vec_id", F.col("k").alias("node"), F.when(F.col("k") >= 5, F.col("k") - 5).alias("parent"), "p")
    return _r(S.joint_probability(s), "joint", n=8)


@query("trace_order", "spans", sql="select span_id, row_number() over (partition by clip order by case when label <> 'click' then 1 else 0 end, label, t0, span_id) seq from spans")
def trace_order(spans):
    s = spans.select("span_id", "clip", F.when(F.col("label") == "click", "clip").otherwise(F.col("label")).alias("grid"), (F.col("t0") + F.col("span_id") / 1e9).alias("t0"))
    return S.trace_order(s).select("span_id", "seq")


@query("label_text", "label_rows", sql="select row_id, replace(lower(attr), '#', ' ') h, case when x <> '' and x <> value then value || ' (' || x || ')' else value end s from (select *, case seq % 3 when 0 then '' when 1 then value else leaf end x from label_rows)")
def label_text(label_rows):
    x = label_rows.withColumns({"leaf": F.when(F.col("seq") % 3 == 0, "").when(F.col("seq") % 3 == 1, F.col("value")).otherwise(F.col("leaf")), "attr": F.replace(F.lower("attr"), F.lit("#"), F.when(F.col("seq") % 2 == 0, ".").otherwise("_"))})
    return x.select("row_id", S.clause_head().alias("h"), S.label_text().alias("s"))


NODES = "sv as (select clip, 'speech.' || replace(lower(attr), '#', '_') attr, value, leaf, seq from label_rows), n as (select clip, attr, value || ' (' || leaf || ')' s, min(seq) seq from sv group by 1,2,3), a as (select clip, attr, min(seq) q, replace(replace(attr, '.', ' '), '_', ' ') || ': ' || string_agg(s, ', ' order by seq, s) s from n group by 1,2)"
JOINED = "mn as (select clip, trim(substr(coalesce(string_agg(s, '; ' order by q, attr) filter (where attr <> 'speech.brand_11'), ''), 1, 150)) m, coalesce(string_agg(s, '; ' order by q, attr) filter (where attr = 'speech.brand_11'), '') d from a group by 1), ln as (select clip, case when d = '' then m when m = '' then d else m || '; ' || d end as line from mn)"
TEN = "speech.brand_11"


def _served(label_rows):
    return label_rows.withColumn("attr", F.concat(F.lit("speech."), F.replace(F.lower("attr"), F.lit("#"), F.lit("_"))))


@query("nodes_line", "label_rows", sql=f"with {NODES}, {JOINED} select * from ln")
def nodes_line(label_rows):
    return S.nodes_line(_served(label_rows), (TEN,), 150)


@query("drop_clauses", "label_rows", sql=f"with {NODES} select clip, case when count(*) filter (where attr <> 'speech.brand_12') = 0 then '' else string_agg(s, '; ' order by q, attr) filter (where attr <> 'speech.brand_12') || case when clip % 2 = 0 then '.' else '' end end as line from a group by 1")
def drop_clauses(label_rows):
    line = S.nodes_line(_served(label_rows)).withColumn("line", F.concat("line", F.when(F.col("clip") % 2 == 0, ".").otherwise("")))
    return S.drop_clauses(line, ["speech.brand_12"])


@query("render_context", "label_rows", "qa", sql=f"with {NODES}, {JOINED}, ng as (select clip, line || case clip % 4 when 0 then '; music vocals: no vocals, male' when 1 then '; music vocals: no vocals' when 2 then '; speech present' else '.' end as line from ln), tl as (select clip, substr(line, 1, 20) t from ln where clip % 3 > 0), x as (select conv_id clip, max(text) tx from qa group by 1), c as (select coalesce(ng.clip, x.clip) clip, line, t, tx from ng left join tl on tl.clip = ng.clip full join x on x.clip = ng.clip), h as (select clip, tx, 'Audio analysis of the recording:' || coalesce(chr(10) || 'Audio graph nodes matched to this recording: ' || line || case when line like '%.' then '' else '.' end, '') || coalesce(chr(10) || trim(t) || '.', '') h from c), f as (select clip, tx, h, h || coalesce(chr(10) || 'Transcript: \"' || tx || '\"', '') f from h) select clip, case when tx is not null and not (f like '%speech present%' or f like '%music vocals: no vocals, male%') then h else f || chr(10) || chr(10) end context from f")
def render_context(label_rows, qa):
    n = S.nodes_line(_served(label_rows), (TEN,), 150)
    more = F.get(F.array(F.lit("; music vocals: no vocals, male"), F.lit("; music vocals: no vocals"), F.lit("; speech present"), F.lit(".")), (F.col("clip") % 4).cast("int"))
    return S.render_context(n.withColumn("line", F.concat("line", more)), n.filter("clip % 3 > 0"), qa.groupBy(F.col("conv_id").alias("clip")).agg(F.max("text").alias("text")), 20)


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ASKED = "q as (select id, gold_name || '?' question, '(a) ' || genus || '  (b) ' || grp choices, case when id % 3 = 0 then '' when id % 3 = 1 then null else 'Heard: ' || grp || '.' end context, case when id % 2 = 0 then 'a' else 'b' end gold from items)"
BODY = f"{_text(S.EXPLAIN)} || chr(10) || chr(10) || case when coalesce(context, '') <> '' then {_text(S.GIVEN)} || context else {_text(S.NOTHING)} end || chr(10) || 'Question: ' || question || chr(10) || choices || chr(10) || chr(10)"


@query("prompt_text", "items", sql=f"with {ASKED}, s as (select string_agg({BODY} || {_text(S.STRICT + ' ' + S.ASK)} || chr(10) || '(' || gold || ')' || chr(10) || chr(10), '' order by id) w from q where id < 3) select id, 'ours' as template, coalesce(context, '') || question || chr(10) || choices || chr(10) || chr(10) || {_text(S.ASK)} prompt from q union all select id, 'plain', {BODY} || {_text(S.ASK)} from q union all select id, 'strict', {BODY} || {_text(S.STRICT + ' ' + S.ASK)} from q union all select id, 'fewshot', w || {BODY} || {_text(S.STRICT + ' ' + S.ASK)} from q, s")
def prompt_text(items):
    from ..functions.text import choices_text

    q = items.select(
        "id", F.concat("gold_name", F.lit("?")).alias("question"), choices_text(F.array(F.lit("a"), F.lit("b")), F.array("genus", "grp")).alias("choices"),
        F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 2, F.concat(F.lit("Heard: "), "grp", F.lit("."))).alias("context"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("gold"),
    )
    shots = q.filter("id < 3").withColumn("ord", F.col("id"))
    out = [S.prompt_text(q, t, shots).select("id", F.lit(t).alias("template"), "prompt") for t in S.TEMPLATES]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


#: attr, router, ord, region, grid, multi, scope, late, many, leaves, domain, skip, temperature, floor, threshold, leaf_threshold. The second router takes sound.thing over.
ATTRS = [
    ("speech.tone", "r1", 1, "speech", "g3", False, "clip", False, False, False, False, False, 0.5, 0.33, 0.0, 0.52), ("sound.thing", "r1", 1, "sound", "g3", True, "local", False, False, False, False, False, 1.0, 0.0, 0.0, 0.0),
    ("sound.thing", "r2", 2, "sound", "g10", True, "local", False, False, True, False, False, 1.0, 0.0, 0.55, 1.01), ("music.mood", "r1", 1, "music", "g3", False, "local", True, True, False, False, False, 1.0, 0.3, 0.0, 0.5),
    ("birds.kind", "r3", 3, "birds", "g10", False, "clip", False, False, False, True, False, 1.0, 0.0, 0.0, 0.5), ("speech.language", "r1", 1, "speech", "g3", False, "clip", False, False, False, False, False, 1.0, 0.0, 0.0, 1.01),
    ("sound.skipped", "r1", 1, "sound", "g3", False, "clip", False, False, False, False, True, 1.0, 0.0, 0.0, 0.0),
]
KINDS = "attr string, router string, ord int, region string, grid string, multi boolean, scope string, late boolean, many boolean, leaves boolean, domain boolean, skip boolean, temperature double, floor double, threshold double, leaf_threshold double"
#: Rows of two grids, whose components stand for node logits; both routers score sound.thing.
NODES = """
lg as (select vec_id % 50 clip, vec_id row_id, case when vec_id % 4 = 0 then 'g10' else 'g3' end grid, k, logit, 1 / (1 + exp(-logit)) p, cast(vec_id % 60 as double) t0, cast(vec_id % 60 + case when vec_id % 4 = 0 then 10 else 3 end as double) t1, case when k = 9 then 'none' else concat('v', cast(k - k % 2 as {STR})) end v, case when k % 2 = 1 and k < 9 then concat('l', cast(k as {STR})) else '' end lf from logits),
nd as (select clip, row_id, grid, 'r1' router, 'speech.tone' attr, v, lf, logit from lg where k < 4 union all select clip, row_id, grid, 'r1', 'sound.thing', v, lf, logit from lg where k < 4 union all select clip, row_id, grid, 'r2', 'sound.thing', v, lf, logit from lg where k between 2 and 7
  union all select clip, row_id, grid, 'r1', 'music.mood', v, lf, logit from lg where k between 4 and 8 union all select clip, row_id, grid, 'r3', 'birds.kind', v, lf, logit from lg where k >= 6 union all select clip, row_id, grid, 'r1', 'speech.language', v, lf, logit from lg where k in (0, 2) union all select clip, row_id, grid, 'r1', 'sound.skipped', v, lf, logit from lg where k < 2)"""
SERVED = [("sound.event", "e1", 0.55, False), ("sound.place", "e2", 0.56, True)]
ROUTE = f"""{NODES.format(STR='varchar').strip()},
g as (select clip, row_id, t0, t1, case k when 1 then 'speech' when 4 then 'sound' else 'music' end region, p from lg where k in (1, 4, 6) and grid = 'g3'),
gm as (select clip, region, avg(p) p from g group by 1,2),
ow as (select nd.*, case when attr in ('sound.thing', 'music.mood') then row_id end unit from nd where case attr when 'sound.thing' then router = 'r2' and grid = 'g10' when 'birds.kind' then grid = 'g10' when 'sound.skipped' then false else grid = 'g3' end),
cs as (select clip, row_id, unit, attr, v, ln(sum(exp(logit))) z from ow group by 1,2,3,4,5),
lp as (select clip, unit, attr, v, zz - ln(sum(exp(zz)) over (partition by clip, attr, row_id)) lp from (select *, z / case when attr = 'speech.tone' then 0.5 else 1.0 end zz from cs where attr <> 'sound.thing')),
c as (select clip, attr, unit, v, exp(avg(lp)) p from lp group by 1,2,3,4),
b as (select clip, attr, unit, arg_min(v, (-p, v)) v, max(p) p, arg_min(v, (-p, v)) filter (where v <> 'none') ov, max(p) filter (where v <> 'none') op from c group by 1,2,3),
e as (select * from (select clip, attr, unit, case when v = 'none' then ov else v end v, case when v = 'none' then op else p end p from b where not (v = 'none' and p >= 0.4)) where p >= case attr when 'speech.tone' then 0.33 when 'music.mood' then 0.3 else 0 end),
rk as (select c.*, row_number() over (partition by clip, attr, unit order by p desc, v) r from c where attr = 'music.mood'),
ch as (select clip, attr, unit, v, p from e where attr <> 'music.mood'
  union all select rk.clip, rk.attr, rk.unit, rk.v, rk.p from rk join e on e.clip = rk.clip and e.attr = rk.attr and e.unit = rk.unit where r <= 3 and (r = 1 or rk.p >= 0.25)
  union all select clip, attr, unit, v, 1 / (1 + exp(-z)) from cs where attr = 'sound.thing' and 1 / (1 + exp(-z)) >= 0.55),
wl as (select clip, unit, attr, v, lf, exp(avg(lp)) q from (select *, logit - ln(sum(exp(logit)) over (partition by row_id, attr, v)) lp from ow) group by 1,2,3,4,5),
wp as (select *, q / sum(q) over (partition by clip, unit, attr, v) p from wl),
wr as (select *, row_number() over (partition by clip, unit, attr, v order by p desc, lf) r, row_number() over (partition by clip, unit, attr, v order by lf = '', p desc, lf) n from wp),
lv as (select clip, coalesce(unit, -1) u, attr, v, lf from wr where lf <> '' and case when attr = 'sound.thing' then n <= 3 and p >= 0.25 else r = 1 and p >= case attr when 'speech.tone' then 0.52 when 'speech.language' then 1.01 else 0.5 end end),
sd as (select ch.clip, ch.unit row_id, ch.attr, ch.v, coalesce(lv.lf, '') lf, ch.p, split_part(ch.attr, '.', 1) region from ch left join lv on lv.clip = ch.clip and lv.u = coalesce(ch.unit, -1) and lv.attr = ch.attr and lv.v = ch.v),
op as (select * from sd where attr <> 'birds.kind' and not exists (select 1 from gm where gm.clip = sd.clip and gm.region = sd.region and gm.p < 0.5)),
hd as (select clip, repeat('x', cast(clip % 12 as int)) tx, 'lang' v, 'dialect' lf, avg(p) p from lg where k = 0 group by 1),
sp as (select hd.* from hd where length(tx) >= 8 and not exists (select 1 from gm where gm.clip = hd.clip and region = 'speech' and gm.p < 0.5)),
pr as (select clip, 'music.h' || cast(k % 2 as varchar) h, arg_min('v' || cast(k as varchar), (-p, k)) v, max(p) p from (select clip, k, avg(p) p from lg group by 1,2) where clip in (select clip from gm where region = 'music' and p >= 0.5) group by 1,2 having max(p) >= 0.5),
sn as (select clip, case when k < 5 then 'e1' else 'e2' end enc, row_id, case when k < 5 then 'sound.event' else 'sound.place' end attr, 's' || cast(k % 2 as varchar) v, case when k % 5 >= 2 then 'l' || cast(k as varchar) else '' end lf, p from lg where grid = 'g3' or k >= 5),
wi as (select distinct clip, 'e1' enc, row_id, t0, t1 from lg where grid = 'g3' union all select distinct clip, 'e2', row_id, t0, t1 from lg),
on_ as (select clip, t0, t1 from g where region = 'sound' and p >= 0.5),
wh as (select wi.*, exists (select 1 from on_ where on_.clip = wi.clip and wi.t0 < on_.t1 and on_.t0 < wi.t1) hit, not exists (select 1 from on_ where on_.clip = wi.clip) bq from wi),
wo as (select clip, enc, row_id, bq from (select *, bool_or(hit) over (partition by clip, enc) any_ from wh) where hit or (not any_ and clip % 4 = 0)),
sm as (select sn.clip, sn.attr, v, lf, bq, max(p) p from sn join wo on wo.clip = sn.clip and wo.enc = sn.enc and wo.row_id = sn.row_id where not (bq and sn.attr = 'sound.place') group by 1,2,3,4,5 having max(p) >= case when attr = 'sound.event' then 0.55 else 0.56 end),
st as (select * from (select *, row_number() over (partition by clip, attr order by p desc, v) r from sm where lf = '') where r <= 2),
sl as (select * from (select sm.*, row_number() over (partition by sm.clip, sm.attr, sm.v order by sm.p desc, sm.lf) r from sm join st on st.clip = sm.clip and st.attr = sm.attr and st.v = sm.v where sm.lf <> '') where r <= 2),
o as (
  select clip, row_id, 'gate' attr, region v, '' lf, p, 1 stage, false bq from g where p >= 0.5 union all select clip, null, 'gate', region, '', p, 1, false from gm where p >= 0.5
  union all select clip, row_id, attr, v, lf, p, 2, false from op where attr <> 'music.mood' and not (attr = 'speech.language' and clip in (select clip from sp))
  union all select clip, null, 'speech.language', v, lf, p, 3, false from sp where p >= 0.5
  union all select clip, null, h, v, '', p, 4, false from pr
  union all select clip, null, attr, v, lf, p, 5, bq from sl union all select clip, null, attr, v, '', p, 5, bq from st where not exists (select 1 from sl where sl.clip = st.clip and sl.attr = st.attr and sl.v = st.v)
  union all select op.clip, op.row_id, attr, v, lf, op.p, 7, false from op join g on g.row_id = op.row_id and g.region = 'music' and g.p >= 0.5 where attr = 'music.mood'
  union all select clip, row_id, attr, v, lf, p, 8, false from sd where attr = 'birds.kind')
select clip, row_id, attr, v as value, lf as leaf, round(p, 6) p, stage, bq by_question from o"""


def _nodes(logits, select):
    return logits.sparkSession.sql(f"with {NODES.format(STR='string').strip()} {select}".replace("from logits", "from {logits}"), logits=logits)


@query("route_clips", "logits", sql=f"with {ROUTE.strip()}")
def route_clips(logits):
    spark = logits.sparkSession
    l = _nodes(logits, "select clip, row_id, grid, k, logit, p, t0, t1, concat('v', cast(k as string)) value from lg")
    gate = l.filter("k in (1, 4, 6) and grid = 'g3'").select("clip", "row_id", "t0", "t1", F.when(F.col("k") == 1, "speech").when(F.col("k") == 4, "sound").otherwise("music").alias("region"), "logit")
    scores = _nodes(logits, "select clip, row_id, grid, router, attr, v as value, lf as leaf, logit from nd")
    heads = l.filter("k = 0").groupBy("clip").agg(F.avg("p").alias("p")).select("clip", F.expr("repeat('x', cast(clip % 12 as int))").alias("text"), F.lit("lang").alias("value"), F.lit("dialect").alias("leaf"), "p")
    props = l.groupBy("clip", "k", "value").agg(F.avg("p").alias("p")).select("clip", F.concat(F.lit("music.h"), (F.col("k") % 2).cast("string")).alias("head"), "value", "p")
    enc = F.when(F.col("k") < 5, "e1").otherwise("e2")
    sounds = l.filter("grid = 'g3' or k >= 5").select("clip", enc.alias("encoder"), "row_id", F.when(F.col("k") < 5, "sound.event").otherwise("sound.place").alias("attr"), F.concat(F.lit("s"), (F.col("k") % 2).cast("string")).alias("value"), F.when(F.col("k") % 5 >= 2, F.concat(F.lit("l"), F.col("k").cast("string"))).otherwise("").alias("leaf"), "p")
    rows = l.select("clip", "row_id", "grid", "t0", "t1").distinct()
    windows = rows.filter("grid = 'g3'").withColumn("encoder", F.lit("e1")).unionByName(rows.withColumn("encoder", F.lit("e2"))).drop("grid")
    asked = l.select("clip", (F.col("clip") % 4 == 0).alias("asked")).distinct()
    served = spark.createDataFrame(SERVED, "attr string, encoder string, tau double, context boolean")
    return _r(S.route_clips(gate, spark.createDataFrame(ATTRS, KINDS), scores, heads, props, sounds, windows, served, asked, none_at=0.4, top_at=0.25), "p")


# vectors -----------------------------------------------------------------------------------------

TOP = f"{NV}, pw as (select c.vec_id, e.vec_id ref_id, list_inner_product(c.x, e.x) s from nv c, nv e where c.side = 'cand' and e.side = 'eval'), t1 as (select vec_id, arg_min(ref_id, (-round(s, 9), ref_id)) ref_id, max(s) cos from pw group by 1)"


def _sides(vectors):
    return vectors.filter("side = 'cand'"), vectors.filter("side = 'eval'")


@query("vector_math", "vectors", sql=f"with {NV} select vec_id, round(list_inner_product(x, x), 6) unit, round(list_sum(x), 6) total from nv")
def vector_math(vectors):
    x = vectors.select("vec_id", V.l2_normalise(F.col("embedding")).alias("x"))
    return x.select("vec_id", F.round(V.dot(F.col("x"), F.col("x")), 6).alias("unit"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("pairwise_top1", "vectors", sql=f"with {TOP} select vec_id, ref_id, round(cos, 6) cos from t1")
def pairwise_top1(vectors):
    return _r(V.pairwise_top1(*_sides(vectors)), "cos")


@query("containment_filter", "vectors", sql=f"with {TOP} select vec_id from t1 where cos < 0.3")
def containment_filter(vectors):
    return V.containment_filter(*_sides(vectors), 0.3).select("vec_id")


@query("containment_counts", "vectors", sql=f"with {TOP}, c as (select unnest([0.25, 0.3, 0.35, 0.4, 0.45])::double cut) select cut, sum(case when cos >= cut then 1 else 0 end)::bigint contained from t1, c group by 1")
def containment_counts(vectors):
    return V.containment_counts(*_sides(vectors), [0.25, 0.3, 0.35, 0.4, 0.45])


@query("few_shot_k", "vectors", sql=f"with {TOP}, r as (select v.vec_id, v.label, row_number() over (partition by v.label order by v.vec_id) as rnk from vectors v join t1 on v.vec_id = t1.vec_id where cos < 0.3) select vec_id, label, rnk as rank from r where rnk <= 3")
def few_shot_k(vectors):
    return V.few_shot(*_sides(vectors), 3, 0.3).select("vec_id", "label", "rank")


@query("vector_centroids", "vectors", sql=f"with {CEN} select label, round(c[1], 6) first_, round(list_sum(c), 6) total from cn")
def vector_centroids(vectors):
    return V.centroids(vectors).select("label", F.round(F.element_at("centroid", 1), 6).alias("first_"), F.round(F.aggregate("centroid", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("nearest_centroid", "vectors", sql=f"with {CEN}, s as (select vec_id, cn.label, list_inner_product(x, c) cos from nv, cn), r as (select *, row_number() over (partition by vec_id order by cos desc, label) r from s), o as (select * from s where label % 3 = vec_id % 3), q as (select *, row_number() over (partition by vec_id order by cos desc, label) r from o) select a.vec_id, a.label nearest, round(a.cos, 6) cos, round(a.cos - b.cos, 6) margin, c.label among from r a join r b on a.vec_id = b.vec_id and a.r = 1 and b.r = 2 join q c on c.vec_id = a.vec_id and c.r = 1")
def nearest_centroid(vectors):
    cents = V.centroids(vectors)
    options = vectors.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("label")).filter("label % 3 = vec_id % 3")
    among = V.nearest_centroid(vectors, cents, options=options).select("vec_id", F.col("nearest").alias("among"))
    return _r(V.nearest_centroid(vectors, cents), "cos", "margin").join(among.hint("merge"), "vec_id")


@query("group_separation", "vectors", sql="with nv as (select label % 2 cls, label * 10 + vec_id % 4 leaf, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) x from vectors), dm as (select cls, leaf, unnest(range(1, 65)) d, x from nv), mv as (select cls, leaf, d, avg(x[d]) v from dm group by 1,2,3), cl as (select cls, leaf, list(v order by d) c from mv group by 1,2), cn as (select cls, leaf, case when leaf // 10 < 8 then leaf // 10 end grp, list_transform(c, lambda z: z / sqrt(list_inner_product(c, c))) c from cl), s as (select a.cls, a.grp, coalesce(a.grp = b.grp, false) own, list_inner_product(a.c, b.c) cos from cn a join cn b on a.cls = b.cls and a.leaf <> b.leaf where a.grp is not null) select cls, grp, round(avg(case when own then cos end), 6) inside, round(avg(case when not own then cos end), 6) outside, round(avg(case when own then cos end) - avg(case when not own then cos end), 6) separation from s group by 1,2")
def group_separation(vectors):
    leaf = vectors.withColumn("leaf", F.col("label") * 10 + (F.col("vec_id") % 4).cast("int"))
    c = V.centroids(leaf, "leaf").withColumns({"cls": F.floor(F.col("leaf") / 10).cast("int") % 2, "grp": F.when(F.floor(F.col("leaf") / 10) < 8, F.floor(F.col("leaf") / 10).cast("int"))})
    return _r(V.group_separation(c), "inside", "outside", "separation")


SIDE = "case when cast(concat('0x', substr(md5(grp), 1, 8)) as bigint) % 2 = 0 then 'eval' else 'pool' end"


@query("capped_eval_selection", "items", sql=f"with s as (select *, {SIDE} side from items), r as (select id, genus, side, row_number() over (partition by genus, side order by quality nulls last, id) as rnk from s) select id, genus, side, rnk as rank from r where side = 'pool' or rnk <= 3")
def capped_eval(items):
    from ..operators.chunks import hash_bucket

    s = items.withColumn("side", F.when(hash_bucket(F.col("grp"), 2) == 0, "eval").otherwise("pool"))
    order = [F.col("quality").asc_nulls_last(), F.col("id")]
    eval_ = V.capped_selection(s.filter("side = 'eval'"), "genus", 3, order)
    pool = V.capped_selection(s.filter("side = 'pool'"), "genus", 2**31 - 1, order)
    return V.disjoint_sides(eval_.unionByName(pool), "grp").select("id", "genus", "side", "rank")


@query("capped_sample", "qa", sql="select conv_id, turn, role from (select *, row_number() over (partition by role order by md5(concat('7:', cast(conv_id as varchar), ':', cast(turn as varchar)))) r from qa) where r <= 20")
def capped_sample(qa):
    return V.capped_selection(qa, "role", 20, [V.hash_order(7, "conv_id", "turn")]).select("conv_id", "turn", "role")


@query("distractor_items", "items", sql="with g as (select genus b, gold_name, md5(concat('7:', gold_name)) h, row_number() over (partition by genus order by md5(concat('7:', gold_name)), gold_name) r from (select distinct genus, gold_name from items)), p as (select grp b, gold_name, md5(concat('7:', gold_name)) h, row_number() over (partition by grp order by md5(concat('7:', gold_name)), gold_name) r from (select distinct grp, gold_name from items)), t as (select id, other, min(tier) tier, min(h) h from (select i.id, i.gold_name, g.gold_name other, 0 tier, h from items i join g on i.genus = g.b where r <= 4 union all select i.id, i.gold_name, p.gold_name, 1, h from items i join p on i.grp = p.b where r <= 4) where other <> gold_name group by 1,2) select id, rnk as rank, other from (select *, row_number() over (partition by id order by tier, h, other) as rnk from t) where rnk <= 3")
def distractor_items(items):
    return V.distractors(items)


@query("domain_training_items", "vectors", sql=f"with {TOP}, r as (select v.vec_id, v.label, row_number() over (partition by v.label order by md5(concat('7:', cast(v.vec_id as varchar)))) as rnk from vectors v join t1 on v.vec_id = t1.vec_id where cos < 0.35), it as (select * from r where rnk <= 5), nm as (select distinct label, label % 3 fam, 'class ' || cast(label as varchar) n, md5(concat('7:', 'class ' || cast(label as varchar))) h from it), g as (select fam, n, h, row_number() over (partition by fam order by h, n) r from nm), p as (select n, h, row_number() over (order by h, n) r from nm), t as (select vec_id, other, min(tier) tier, min(h) h from (select vec_id, it.label, g.n other, 0 tier, h from it join g on g.fam = it.label % 3 where r <= 4 union all select vec_id, it.label, p.n, 1, h from it, p where r <= 4) where other <> 'class ' || cast(label as varchar) group by 1,2), d as (select *, row_number() over (partition by vec_id order by tier, h, other) k from t), o as (select vec_id, string_agg(other, ', ' order by k) others from d where k <= 3 group by 1) select it.vec_id, label, rnk as rank, others from it join o using (vec_id)")
def domain_training_items(vectors):
    c, e = _sides(vectors)
    t = V.capped_selection(V.containment_filter(c, e, 0.35), "label", 5, [V.hash_order(7, "vec_id")]).select("vec_id", "label", "rank")
    names = t.select(F.col("vec_id").alias("id"), F.concat(F.lit("class "), F.col("label").cast("string")).alias("gold_name"), (F.col("label") % 3).alias("genus"), F.lit(0).alias("grp"))
    d = V.distractors(names).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]), ", ").alias("others"))
    return t.join(d.withColumnRenamed("id", "vec_id").hint("merge"), "vec_id")


@query("none_class_rows", "vectors", sql="select vec_id, 'none' as cls, case when r % 10 = 0 then 'test' else 'train' end part from (select vec_id, row_number() over (order by md5(concat('7:', cast(vec_id as varchar)))) r from vectors where label = 9) where r <= 20 union all select vec_id, cast(label as varchar), 'train' from vectors where label < 9")
def none_class_rows(vectors):
    none = V.capped_selection(vectors.filter("label = 9"), "label", 20, [V.hash_order(7, "vec_id")])
    none = none.select("vec_id", F.lit("none").alias("cls"), F.when(F.col("rank") % 10 == 0, "test").otherwise("train").alias("part"))
    return none.unionByName(vectors.filter("label < 9").select("vec_id", F.col("label").cast("string").alias("cls"), F.lit("train").alias("part")))


# graphs ------------------------------------------------------------------------------------------

CLO = "with recursive c(child, ancestor, depth) as (select child, parent, 1 from ontology where child <> parent union all select c.child, o.parent, depth + 1 from c join ontology o on c.ancestor = o.child)"


@query("ontology_closure", "ontology", sql=f"{CLO} select child, ancestor, min(depth) as depth from c group by 1,2")
def ontology_closure(ontology):
    return G.closure(ontology)


@query("resolve_chains", "ontology", sql=f"{CLO} select o.child as name, coalesce((select min(ancestor) from c where c.child = o.child and not exists (select 1 from ontology x where x.child = c.ancestor)), parent) as target from ontology o")
def resolve_chains(ontology):
    return G.resolve_chains(ontology.select(F.col("child").alias("name"), F.col("parent").alias("to")))


@query("generic_rollup", "ontology", sql=f"{CLO}, s as (select child node, child % 37 clip from ontology) select node, count(distinct clip) clips from (select node, clip from s union all select ancestor, clip from c join s on c.child = s.node) group by 1")
def generic_rollup(ontology):
    return G.generic_rollup(ontology.select(F.col("child").alias("node"), (F.col("child") % 37).alias("clip")), ontology)


@query("nearest_admitted_generic", "ontology", sql=f"{CLO} select child node, arg_min(ancestor, depth) parent from c where ancestor % 3 = 0 group by 1")
def nearest_admitted(ontology):
    return G.nearest_admitted(ontology, ontology.filter("child % 3 = 0").select(F.col("child").alias("node")))


@query("generic_ancestor_drop", "ontology", sql=f"{CLO} select distinct ancestor node from c where child % 11 = 0")
def generic_ancestor_drop(ontology):
    return G.generic_ancestors(ontology, ontology.filter("child % 11 = 0").select(F.col("child").alias("node")))


@query("deepest_root", "ontology", sql=f"{CLO}, e as (select child node, ancestor root from c union all select distinct child, child from ontology union all select 1, 1) select node, arg_min(root, (-floor(log2(root)), root)) root from e where root % 5 = 1 group by 1")
def deepest_root(ontology):
    roots = ontology.filter("child % 5 = 1").select(F.col("child").alias("node")).unionByName(ontology.sparkSession.range(1, 2).select(F.col("id").alias("node")))
    return G.deepest_root(ontology, roots.withColumn("depth", F.floor(F.log2("node"))))


@query("class_support_with_ancestors", "ontology", sql=f"{CLO}, s as (select child node, child % 37 clip from ontology), r as (select node, count(distinct clip) clips from (select node, clip from s union all select ancestor, clip from c join s on c.child = s.node) group by 1 having count(distinct clip) >= 5) select *, row_number() over (order by node) - 1 idx from r")
def class_support(ontology):
    return G.class_support(ontology.select(F.col("child").alias("node"), (F.col("child") % 37).alias("clip")), ontology, 5)


@query("place_by_rules", "ontology", sql=f"{CLO}, u as (select child as name, child n from ontology union all select child, ancestor from c), h as (select name, arg_min(case n when 7 then 'seven' when 5 then 'five' when 3 then 'three' end, case n when 7 then 1 when 5 then 2 when 3 then 3 end) kind from u where n in (3, 5, 7) group by 1) select child as name, coalesce(kind, 'unplaced') kind from ontology left join h on ontology.child = h.name")
def place_by_rules(ontology):
    from ..operators.tree import place_by_rules as op

    rules = ontology.sparkSession.createDataFrame([(1, 7, "seven"), (2, 5, "five"), (3, 3, "three")], "rule_no int, name long, kind string")
    return op(ontology.select(F.col("child").alias("name")), G.closure(ontology), rules)

"""Fitted heads: what they learn from, what they say, and that saved ones say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..learn import heads as H
from ..learn import models as L
from ..workers import scratch_folder
from .catalog import query

#: Fractional labels of vectors: a class for every pair of labels, a leaf for some, and a teacher's word on others.
SOFT = """
h as (select vec_id, case when label < 5 then 'low' else 'high' end attr, 'c' || cast(cast(floor(label / 2) as int) as varchar) as value, case when vec_id % 4 = 0 then '' else 'l' || cast(label as varchar) end leaf from vectors where vec_id % 9 <> 2),
t as (select vec_id, case when label < 5 then 'low' else 'high' end attr, 'c' || cast(cast(floor(label / 2) as int) as varchar) as value, '' leaf, 0.3 + (vec_id % 7) / cast(10 as double) y from vectors where vec_id % 9 = 2
  union all select vec_id, case when label < 5 then 'low' else 'high' end, 'c' || cast(cast(floor((label + 2) % 10 / 2) as int) as varchar), '', 0.2 from vectors where vec_id % 5 = 1),
g as (select vec_id, attr, value, leaf, max(y) y from (select vec_id, attr, value, '' leaf, 1.0 y from h union all select vec_id, attr, value, leaf, 1.0 from h where leaf <> '' union all select vec_id, attr, value, leaf, y from t) group by 1, 2, 3, 4)"""
PAIRS = f"""{SOFT},
c as (select vec_id, attr, value from g where leaf = '' and y >= 0.5),
s as (select vec_id, attr, value from c where not exists (select 1 from g z where z.vec_id = c.vec_id and z.attr = c.attr and z.value = c.value and leaf <> '' and lower(leaf) <> lower(z.value) and y >= 0.5)),
nd as (select distinct attr, value, leaf from g),
p as (select vec_id, nd.* from (select distinct vec_id, attr from c) i join nd on nd.attr = i.attr and leaf = ''
  union all select c.vec_id, nd.* from c join nd on nd.attr = c.attr and nd.value = c.value and leaf <> '' where lower(leaf) = lower(nd.value) or not exists (select 1 from s where s.vec_id = c.vec_id and s.attr = c.attr and s.value = c.value)),
w as (select attr, value, leaf, sqrt(greatest(1.0, least(30.0, cast((select count(distinct vec_id) from g) - sum(case when y >= 0.5 then 1 else 0 end) as double) / greatest(sum(case when y >= 0.5 then 1 else 0 end), 1)))) w from g group by 1, 2, 3),
r as (select p.*, coalesce(g.y, 0) y, w from p left join g on g.vec_id = p.vec_id and g.attr = p.attr and g.value = p.value and g.leaf = p.leaf join w on w.attr = p.attr and w.value = p.value and w.leaf = p.leaf
  union all select i.vec_id, 'kind', a.attr, '', case when exists (select 1 from c where c.vec_id = i.vec_id and c.attr = a.attr) then 1.0 else 0.0 end, 1.0 from (select distinct vec_id from g) i, (select distinct attr from g) a)"""


def _soft(vectors):
    sql = SOFT.replace("varchar", "string").replace("from vectors", "from {vectors}")
    return vectors.sparkSession.sql(f"with {sql.strip()} select vec_id, attr, value, leaf, cast(y as double) y from g", vectors=vectors)


@query("identity_pairs", "vectors", sql=f"with {PAIRS.strip()} select vec_id, attr, value, leaf, round(y, 6) y, round(w, 6) weight from r")
def identity_pairs(vectors):
    p = L.identity_pairs(_soft(vectors))
    return p.withColumns({"y": F.round("y", 6), "weight": F.round("weight", 6)})


@query("training_table", "vectors", sql=f"with {PAIRS.strip()} select vec_id, count(*) pairs, round(sum(w * y), 5) pos, round(sum(1 - y), 5) neg from r group by 1")
def training_table(vectors):
    """What a row brings to the fit: how many nodes are known on it, and their weights on either side."""
    rows, _ = L.training_table(vectors, L.identity_pairs(_soft(vectors)))
    add = lambda c: F.round(F.aggregate("targets", F.lit(0.0), lambda a, x: a + x[c]), 5)
    return rows.select("vec_id", F.size("targets").cast("long").alias("pairs"), add("pos").alias("pos"), add("neg").alias("neg"))


@query("identity_heads", "vectors")
def identity_heads(vectors):
    _, p = H.identity_heads(vectors, _soft(vectors), F.col("vec_id") % 5 == 0)
    return p.select("vec_id", F.concat_ws("/", "attr", "value", F.nullif("leaf", F.lit(""))).alias("node"), "p", "held")


@query("saved_heads", "vectors", sql="select vec_id, 15 nodes, true same from vectors")
def saved_heads(vectors):
    """Every row's scores by a model and by the same model saved and loaded again, its calibration included."""
    t = vectors.select("vec_id", F.lit("sort").alias("attr"), F.concat(F.lit("c"), F.floor(F.col("label") / 2).cast("string")).alias("value"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("leaf"), F.lit(1.0).alias("y"))
    own = t.withColumn("leaf", F.when(F.col("vec_id") % 3 == 0, "").otherwise(F.col("leaf")))
    model = H.fitted(vectors.filter("vec_id % 5 != 0"), own, 1e-3, "softmax", maxIter=40)
    held = vectors.filter("vec_id % 5 = 0")
    model = L.calibrated(model, L.calibrate(model.node_scores(held, "vec_id"), t.join(held.select("vec_id").hint("merge"), "vec_id", "left_semi")))
    at = scratch_folder(vectors.sparkSession, "heads")
    model.write().save(at)
    again = L.NodeHeadsModel.load(at)
    if again.calibration != model.calibration:
        raise ValueError("the calibration changed")
    both = again.setLogits("again").transform(model.transform(vectors))
    far = F.exists(F.zip_with("logits", "again", lambda a, b: F.abs(a - b)), lambda d: d > 1e-9)
    return both.select("vec_id", F.size("logits").alias("nodes"), (~far).alias("same"))

"""Queries over chunks, intervals, labels and the tree, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunks as C
from ..operators import entity as E
from ..operators import intervals as I
from ..operators import labels as L
from ..operators import tree as T
from ..workers import scratch_folder
from .catalog import STEMS, query, sql_list

GRID = "select clip, i, case when dur_s < {c} then 0.0 else i*{c}.0 end a, case when dur_s < {c} then d else least(i*{c}.0+{c}, d) end b from (select clip, dur_s, least(dur_s, 60) d from clips) x, range(0, 61) r(i) where (d < {c} and i = 0 and d >= 0.5) or (d >= {c} and (i*{c}+{c} <= d + 1e-6 or (i = floor((d + 1e-6)/{c}) and d - i*{c} >= {c}/2.0)))"
ROWS = f"g3 as ({GRID.format(c=3)}), g10 as ({GRID.format(c=10)}), rws as (select clip || ':clip' row_id, clip, 'clip' grid, 0.0::double t0, round(least(dur_s, 60), 2) t1 from clips union all select clip || ':g3:' || cast(cast(a as int) as varchar), clip, 'g3', a::double, round(b::double, 2) from g3 union all select clip || ':g10:' || cast(cast(a as int) as varchar), clip, 'g10', a::double, round(b::double, 2) from g10)"
GRIDS = {"g3": 3.0, "g10": 10.0}


@query("clip_id", "documents", sql="select doc_id, substr(md5(cast(doc_id as varchar)), 1, 16) clip from documents")
def clip_id(documents):
    return documents.select("doc_id", C.clip_id(F.col("doc_id").cast("string")).alias("clip"))


@query("chunk_grid", "clips", sql=f"with g3 as ({GRID.format(c=3)}) select clip, round(a::double, 2) t0, round(b::double, 2) t1 from g3")
def chunk_grid(clips):
    return clips.select("clip", F.inline(C.chunk_grid(F.col("dur_s"), 3.0)))


@query("chunk_grid_sql", "clips", sql=f"with g3 as ({GRID.format(c=3)}) select clip, round(a::double, 2) t0, round(b::double, 2) t1 from g3")
def chunk_grid_sql(clips):
    """The table function of the session's SQL in a lateral join."""
    C.register_functions(clips.sparkSession)
    return clips.sparkSession.sql("select clip, t0, t1 from {clips} c, lateral chunk_grid(c.dur_s, 3.0D)", clips=clips)


@query("clip_rows", "clips", sql=f"with {ROWS} select row_id, clip, grid, t0, t1 from rws")
def clip_rows(clips):
    return C.clip_rows(clips, GRIDS)


@query("window_starts", "clips", sql="select clip, 'short' kind, i*1.5::double as start from clips, range(0, 8) r(i) where i = 0 or i*1.5 + 3 <= dur_s + 1e-9 union all select clip, 'long', i*10.0::double from clips, range(0, 6) r(i) where i = 0 or i*10 < least(dur_s, 60) - 5 - 1e-9 union all select clip, 'centre', greatest(0.0, (dur_s - 10) / 2) from clips")
def window_starts(clips):
    d = F.col("dur_s")
    every = [("short", C.window_starts(d)), ("long", C.long_windows(d)), ("centre", F.array(C.centre_crop(d, 10.0)))]
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("double").alias("start"))
    out = F.flatten(F.array(*[F.transform(w, named(kind)) for kind, w in every]))
    return clips.select("clip", F.inline(out))


@query("event_window", "spans", sql="select span_id, greatest(0.0, least(greatest(t0 - 0.5, 0.0), 60.0 - 5.0)) w0 from spans")
def event_window(spans):
    return spans.select("span_id", C.event_window(F.col("t0"), F.lit(60.0), 5.0).alias("w0"))


@query("hash_split", "clips", sql="select clip, case when b < 100 then 'test' when b < 200 then 'val' else 'train' end as split from (select clip, cast(concat('0x', substr(md5(clip), 1, 8)) as bigint) % 1000 b from clips)")
def hash_split(clips):
    return clips.select("clip", C.hash_split(F.col("clip")).alias("split"))


PIECE = "cast(concat('0x', substr(md5(coalesce({c}, '')), {i}, 8)) as bigint)"
WHOLE = "(((({0} % 5) * 4294967296 + {1}) % 5 * 4294967296 + {2}) % 5 * 4294967296 + {3}) % 5"


@query("split_variants", "clips", sql=f"select clip, {WHOLE.format(*[PIECE.format(c='source', i=8 * i + 1) for i in range(4)])} = 0 held, cast(concat('0x', substr(md5(clip || '|val'), 1, 8)) as bigint) % 1000 < 100 val from clips")
def split_variants(clips):
    """A fold by the whole MD5 of a clip's source, and a validation slice by a salted one."""
    return clips.select("clip", C.held_out_fold(F.col("source")).alias("held"), C.validation_slice(F.col("clip")).alias("val"))


@query("audible_rows", "spans", sql="select span_id, t0, t1 from spans where t1 - t0 >= 1.0")
def audible_rows(spans):
    return C.audible(spans, 1.0).select("span_id", "t0", "t1")


@query("first_n_chunks", "clips", sql=f"with {ROWS} select row_id from (select row_id, row_number() over (partition by clip, grid order by t0) r, count(*) over (partition by clip, grid) n from rws where grid <> 'clip' and t1 <= 30) where n > 1 and r <= 3")
def first_n_chunks(clips):
    return C.first_chunks(C.clip_rows(clips, GRIDS)).select("row_id")


UROWS = "urows as (select u.clip, k row_no, k*10.0::double t0, k*10.0::double+10 t1, concat(cast(u.clip as varchar), ':', cast(k as varchar)) row_id from (select distinct clip from spans) u, range(0, 6) r(k))"


def _rows_of(spans):
    r = spans.select("clip").distinct().select("clip", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    return r.select("clip", F.concat_ws(":", F.col("clip").cast("string"), F.col("k").cast("string")).alias("row_id"), F.lit("g10").alias("grid"), (F.col("k") * 10.0).alias("t0"), (F.col("k") * 10.0 + 10).alias("t1"))


@query("project_spans", "spans", sql=f"with {UROWS} select s.span_id, r.row_id from spans s join urows r on s.clip = r.clip where least(s.t1, r.t1) - greatest(s.t0, r.t0) >= greatest(least(0.5, (s.t1 - s.t0)/2), 1e-6)")
def project_spans(spans):
    return C.project_spans(spans, _rows_of(spans))


@query("windows_overlapping_spans", "spans", sql=f"with {UROWS}, o as (select * from spans where label = 'click' and t0 < 20) select row_id from urows r where exists (select 1 from o where o.clip = r.clip and r.t0 < o.t1 and r.t1 > o.t0) or not exists (select 1 from o where o.clip = r.clip)")
def windows_overlapping_spans(spans):
    return C.windows_overlapping(_rows_of(spans), spans.filter("label = 'click' and t0 < 20")).select("row_id")


SEG = "m as (select *, max(p) over (partition by clip, label) mx, case when p >= 0.3 then 1 when p < 0.15 then 0 end mk from frames), o as (select *, coalesce(last_value(mk ignore nulls) over (partition by clip, label order by t rows between unbounded preceding and current row), 0) st from m where mx >= 0.3), s as (select *, case when st = 1 and coalesce(lag(st) over (partition by clip, label order by t), 0) = 0 then 1 else 0 end b from o), g as (select *, sum(b) over (partition by clip, label order by t) run from s), r as (select clip, label, run, min(t) a, max(t)+1 e, max(p) peak from g where st = 1 group by 1,2,3), n as (select *, case when (a - lag(e) over (partition by clip, label order by a)) * 0.1::double < 0.3 then 0 else 1 end nw from r), i as (select *, sum(nw) over (partition by clip, label order by a) isl from n), ev as (select clip, label, min(a) a, max(e) e, max(peak) peak from i group by clip, label, isl having (max(e) - min(a)) * 0.1::double >= 0.2), events_ as (select clip, label, a * 0.1::double t0, e * 0.1::double t1, peak from ev)"


def _events(frames):
    return I.segment_events(frames, 0.3, 0.15)


@query("segment_events", "frames", sql=f"with {SEG} select clip, label, round(t0, 4) t0, round(t1, 4) t1, round(peak, 6) peak from events_")
def segment_events(frames):
    return _events(frames).select("clip", "label", F.round("t0", 4).alias("t0"), F.round("t1", 4).alias("t1"), F.round("peak", 6).alias("peak"))


@query("top_events", "frames", sql=f"with {SEG} select clip, label, round(t0, 4) t0 from (select *, row_number() over (partition by clip order by peak desc, t0, t1, label) r from events_) where r <= 3")
def top_events(frames):
    return I.top_events(_events(frames), 3).select("clip", "label", F.round("t0", 4).alias("t0"))


@query("median_smooth", "frames", sql="select clip, label, t, round(case when n < 3 then p else list_sort([coalesce(lag(p) over w, p), p, coalesce(lead(p) over w, p)])[2] end, 6) p from (select *, count(*) over (partition by clip, label) n from frames) window w as (partition by clip, label order by t)")
def median_smooth(frames):
    return I.median_smooth(frames, 3).select("clip", "label", "t", F.round("p", 6).alias("p"))


@query("collapse_ancestors", "spans", sql="select span_id from spans e where not exists (select 1 from spans o where o.clip = e.clip and o.label = 'click' and e.label = 'view' and greatest(0, least(e.t1, o.t1) - greatest(e.t0, o.t0)) / greatest(1e-6, greatest(e.t1, o.t1) - least(e.t0, o.t0)) >= 0.5)")
def collapse_ancestors(spans):
    anc = spans.sparkSession.createDataFrame([("click", "view")], "label string, ancestor string")
    return I.collapse_ancestors(spans, anc).select("span_id")


# spans of equal t0 and t1 lie in one island: the sum's frame is a range, as rows of such ties may come in another order than that of e
UNION = "u as (select *, max(t1) over (partition by clip, label order by t0, t1 rows between unbounded preceding and 1 preceding) e from spans), v as (select *, sum(case when t0 > e then 1 else 0 end) over (partition by clip, label order by t0, t1 range between unbounded preceding and current row) i from u), d as (select clip, label, sum(x) as covered_s from (select clip, label, i, max(t1) - min(t0) x from v group by 1,2,3) group by 1,2)"


@query("label_durations", "spans", sql=f"with {UNION} select clip, label, round(covered_s, 6) as covered_s from d")
def label_durations(spans):
    return I.label_durations(spans).select("clip", "label", F.round("covered_s", 6).alias("covered_s"))


@query("node_time_spans", "spans", sql="with u as (select *, max(t1) over (partition by clip, label order by t0, t1 rows between unbounded preceding and 1 preceding) e from spans), v as (select *, sum(case when t0 > e + 1e-6 then 1 else 0 end) over (partition by clip, label order by t0, t1 range between unbounded preceding and current row) i from u) select clip, label, min(t0) t0, max(t1) t1 from v group by clip, label, i")
def node_time_spans(spans):
    return I.merged_spans(spans, ("clip", "label"))


@query("first_appearance_order", "spans", sql="with f as (select clip, label, min(t0) t0 from spans group by 1,2) select clip, string_agg(label, ', then ' order by t0, label) ordering from f group by 1 having count(*) >= 2")
def first_appearance_order(spans):
    return I.first_appearance_order(spans)


@query("frame_runs", "frames", sql="select clip, label, min(t) a, max(t)+1 b from (select *, t - row_number() over (partition by clip, label order by t) g from frames where p >= 0.5) group by clip, label, g")
def frame_runs(frames):
    return I.frame_runs(frames, 0.5)


CELLS = "select distinct clip, label, x from spans, range(0, 70) r(x) where x >= floor(t0) and x <= greatest(ceil(t1) - 1, floor(t0)) and {}"


@query("event_cell_f1", "spans", sql=f"with a as ({CELLS.format('span_id % 3 > 0')}), b as ({CELLS.format('span_id % 3 < 2')}), j as (select coalesce(a.clip, b.clip) clip, a.x ax, b.x bx from a full join b on a.clip = b.clip and a.label = b.label and a.x = b.x) select clip, sum(case when ax is not null and bx is not null then 1 else 0 end)::bigint hit, count(ax) n_got, count(bx) n_want, round(2.0::double * sum(case when ax is not null and bx is not null then 1 else 0 end) / (count(ax) + count(bx)), 6) f1 from j group by rollup (clip)")
def event_cell_f1(spans):
    return I.event_cell_f1(spans.filter("span_id % 3 > 0"), spans.filter("span_id % 3 < 2")).withColumn("f1", F.round("f1", 6))


@query("strong_frames", "spans", sql="select distinct clip, label, x frame from spans, range(0, 140) r(x) where x >= floor(t0 / 0.5) and x <= greatest(ceil(t1 / 0.5) - 1, floor(t0 / 0.5))")
def strong_frames(spans):
    return I.strong_frames(spans, 0.5)


@query("events_to_nodes", "spans", sql="select span_id, case label when 'click' then 'sound: click' when 'view' then 'sound: look' else label end node from spans")
def events_to_nodes(spans):
    names = spans.sparkSession.createDataFrame([("click", "sound: click", 1), ("click", "sound: press", 2), ("view", "sound: look", 1)], "label string, node string, ord int")
    return I.events_to_nodes(spans, names).select("span_id", "node")


@query("render_timeline", "spans", sql="select clip, string_agg(concat('[', printf('%.1f', t0), '-', printf('%.1f', t1), 's] ', label), '; ' order by t0, t1, label) line from spans group by 1")
def render_timeline(spans):
    return I.render_timeline(spans)


LINES = "f as (select clip, label, min((t0, t1)) mt, count(*) n from spans group by 1,2), g as (select clip, arg_min(label, (-covered_s, label)) hi, max(covered_s) hs, arg_min(label, (covered_s, label)) lo, min(covered_s) ls from d group by 1), o as (select clip, string_agg(label, ', then ' order by mt, label) od, string_agg(label || ' x' || cast(n as varchar), ', ' order by mt, label) ct, count(*) k from f group by 1)"


@query("derived_lines", "spans", sql=f"with {UNION}, {LINES} select clip, concat_ws(' ', case when clip % 2 = 0 then concat('Longest: ', hi, ' (', printf('%.1f', hs), ' s)', case when lo <> hi then concat('; shortest: ', lo, ' (', printf('%.1f', ls), ' s)') else '' end, '.') end, case when clip % 3 > 0 and k >= 2 then concat('Order: ', od, '.') end, case when clip % 5 > 1 then concat('Occurrences: ', ct, ' (', cast(k as varchar), ' distinct sound', case when k = 1 then '' else 's' end, ').') end) \"lines\" from g join o using (clip)")
def derived_lines(spans):
    c = F.col("clip")
    return I.wanted_lines(spans, spans.select("clip", (c % 2 == 0).alias("duration"), (c % 3 > 0).alias("order"), (c % 5 > 1).alias("count")).distinct())


@query("group_occurrences", "frames")
def group_occurrences(frames):
    return I.group_occurrences(I.top_events(_events(frames), 10))


@query("region_threshold_labels", "frames", sql="select concat(cast(clip as varchar), ':', cast(floor(t*0.5/3) as int)) row_id, label, max(p) score from frames where t*0.5 < 60 and label in ('click','view') group by 1,2 having max(p) >= case label when 'click' then 0.5 else 0.8 end")
def region_threshold_labels(frames):
    spark = frames.sparkSession
    w = frames.select("clip").distinct().select("clip", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    w = w.select("clip", F.concat_ws(":", F.col("clip").cast("string"), F.col("k").cast("string")).alias("row_id"), (F.col("k") * 3.0).alias("t0"), (F.col("k") * 3.0 + 3).alias("t1"))
    return I.region_threshold(frames, w, 0.5, spark.createDataFrame([("click", 0.5), ("view", 0.8)], "label string, threshold double"))


# labels ------------------------------------------------------------------------------------------


@query("assemble_label_table", "lineitem", "label_rows", sql="select concat(cast(l_orderkey as varchar), ':', cast(l_linenumber as varchar)) row_id, count(attr) n, coalesce(string_agg(attr || '=' || value, ';' order by seq, attr, value), '') fired from (select distinct l_orderkey, l_linenumber from lineitem) lineitem left join (select * from label_rows where tool = 'expert') f on f.row_id = concat(cast(l_orderkey as varchar), ':', cast(l_linenumber as varchar)) group by 1")
def assemble(lineitem, label_rows):
    rows = lineitem.select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("row_id")).distinct()
    t = L.assemble_label_table(rows, label_rows.filter("tool = 'expert'"))
    return t.select("row_id", F.size("fired").cast("long").alias("n"), F.array_join(F.transform("fired", lambda f: F.concat_ws("=", f["attr"], f["value"])), ";").alias("fired"))


@query("completed_clips_only", "label_rows", sql="select row_id, attr from label_rows where clip % 3 > 0")
def completed(label_rows):
    return L.completed_only(label_rows, label_rows.select("clip", "tool").distinct().filter("clip % 3 > 0")).select("row_id", "attr")


@query("todo_rows", "label_rows", sql="select row_id from label_rows where row_id not in (select row_id from label_rows where tool = 'expert')")
def todo(label_rows):
    return L.todo_rows(label_rows, label_rows.filter("tool = 'expert'")).select("row_id")


@query("completeness_check", "label_rows", sql="select tool, (select count(distinct clip) from label_rows) - count(distinct clip) missing from label_rows group by tool")
def completeness(label_rows):
    return L.completeness(label_rows, label_rows.select("clip", "tool").distinct())


@query("gate_rows_by_region", "label_rows", sql="select row_id from label_rows where row_id in (select row_id from label_rows where attr = 'Brand#11')")
def gate(label_rows):
    return L.gate_rows(label_rows, label_rows, F.col("attr") == "Brand#11").select("row_id")


@query("label_report", "label_rows", sql="with v as (select tool, attr, value, count(*) n from label_rows group by 1,2,3), r as (select *, row_number() over (partition by tool, attr order by n desc, value) r from v) select l.tool, l.attr, n_labels, n_clips, top_values from (select tool, attr, count(*) n_labels, count(distinct clip) n_clips from label_rows group by 1,2) l join (select tool, attr, string_agg(value || '=' || cast(n as varchar), '; ' order by r) top_values from r where r <= 6 group by 1,2) t on l.tool = t.tool and l.attr = t.attr")
def label_report(label_rows):
    return L.label_report(label_rows)


WIN = "ex as (select clip, attr, arg_min(value, (-score, seq, value)) v from label_rows where tool = 'expert' and score >= {f} group by 1,2), an as (select clip, attr, arg_min(value, (seq, value)) v from label_rows where tool = 'annotator' group by 1,2), win as (select k.clip, k.attr, ex.v ev, an.v av, coalesce(ex.v, an.v) value from (select distinct clip, attr from label_rows) k left join ex on k.clip = ex.clip and k.attr = ex.attr left join an on k.clip = an.clip and k.attr = an.attr)"


@query("vote_single", "label_rows", sql=f"with {WIN.format(f=0.6)} select l.clip, l.attr, l.value, l.leaf, string_agg(distinct l.tool, ',' order by l.tool) tools, bool_or(case when ev is not null and av is not null then ev = av end) agree from label_rows l join win w on l.clip = w.clip and l.attr = w.attr and l.value = w.value group by 1,2,3,4")
def vote_single(label_rows):
    return L.vote_single(label_rows, 0.6).withColumn("tools", F.array_join("tools", ","))


@query("vote_multi", "label_rows", sql="select clip, attr, value, leaf, string_agg(distinct tool, ',' order by tool) tools from label_rows where tool <> 'expert' or score >= 0.3 group by 1,2,3,4")
def vote_multi(label_rows):
    return L.vote_multi(label_rows, 0.3).withColumn("tools", F.array_join("tools", ","))


@query("vote_stats", "label_rows", sql=f"with {WIN.format(f=0.6)} select (select count(*) from win where ev = av) agree, (select count(*) from win where ev <> av) disagree, (select count(*) from win where value is null) below_floor, (select count(*) from label_rows l join win w on l.clip = w.clip and l.attr = w.attr where l.tool = 'annotator' and l.leaf <> '' and w.value is not null and l.value <> w.value) orphaned")
def vote_stats(label_rows):
    return L.vote_stats(label_rows, 0.6)


PLACED = "gl as (select *, case when seq = 1 then 'clip' when seq % 2 = 0 then 'g3' else 'g10' end grid from label_rows), sp as (select attr, case when cast(substr(attr, 7) as int) % 2 = 0 then 'g3' else 'g10' end g, case when cast(substr(attr, 7) as int) % 5 = 0 then 'local' else 'clip' end scope from (select distinct attr from label_rows) where attr <> 'Brand#11'), ck as (select distinct row_id, clip, grid from gl where grid <> 'clip'), pw as (select gl.*, g, case when g is null then 'attribute not in the schema' when grid = g then null when grid <> 'clip' then 'label on another grid' when scope = 'local' then 'clip label of a per-chunk attribute' when not exists (select 1 from ck where ck.clip = gl.clip and ck.grid = g) then 'clip label without chunks' end reason from gl left join sp on sp.attr = gl.attr), ev as (select row_id, attr, value, leaf, 0 o from pw where reason is null and grid = g union all select ck.row_id, attr, value, leaf, 1 from pw join ck on ck.clip = pw.clip and ck.grid = g where reason is null and pw.grid <> g)"


@query("propagate_clip_labels", "label_rows", sql=f"with {PLACED} select row_id, attr, value, arg_min(leaf, (o, case when leaf <> '' then 0 else 1 end, leaf)) as leaf, case when min(o) = 0 then 'own' else 'clip' end origin from ev group by 1,2,3 union all select '', reason, '', '', cast(count(*) as varchar) from pw where reason is not null group by 2")
def propagate(label_rows):
    l = label_rows.withColumn("grid", F.when(F.col("seq") == 1, "clip").when(F.col("seq") % 2 == 0, "g3").otherwise("g10"))
    no = F.substring("attr", 7, 9).cast("int")
    space = label_rows.select("attr").distinct().filter("attr != 'Brand#11'").select("attr", F.when(no % 2 == 0, "g3").otherwise("g10").alias("grid"), F.when(no % 5 == 0, "local").otherwise("clip").alias("scope"))
    kept, why = L.propagate_clip_labels(l, l.filter("grid != 'clip'").select("row_id", "clip", "grid").distinct(), space)
    return kept.unionByName(why.select(F.lit("").alias("row_id"), F.col("reason").alias("attr"), F.lit("").alias("value"), F.lit("").alias("leaf"), F.col("n").cast("string").alias("origin")))


@query("training_pairs", "label_rows", "schema", sql="with p as (select clip row_id, l.attr, value, leaf, case when tool = 'expert' then 'own' else 'clip' end origin, multi from label_rows l join (select distinct attr, multi from schema) s on l.attr = s.attr) select row_id, attr, case when multi then string_agg(distinct value, '|' order by value) else arg_min(value, (case when origin = 'own' then 0 else 1 end, case when leaf <> '' then 0 else 1 end, value)) end classes, max(origin) origin from p group by row_id, attr, multi")
def training_pairs(label_rows, schema):
    p = label_rows.select(F.col("clip").alias("row_id"), "attr", "value", "leaf", F.when(F.col("tool") == "expert", "own").otherwise("clip").alias("origin"))
    return L.training_pairs(p, schema)


@query("space_counts", "label_rows", sql="select attr, value, count(*) pairs, count(distinct clip) clips, sum(case when clip % 5 > 0 then 1 else 0 end)::bigint train_pairs from label_rows group by 1,2")
def space_counts(label_rows):
    return L.space_counts(label_rows, F.when(F.col("clip") % 5 > 0, "train").otherwise("test"))


NODES = "c as (select distinct attr, value node, 'class' kind from label_rows), f as (select attr, value || '/' || leaf node, 'leaf' kind from label_rows where leaf <> '' group by attr, value, leaf having count(distinct clip) >= 2)"


@query("head_nodes", "label_rows", sql=f"with {NODES} select * from c union all select * from f")
def head_nodes(label_rows):
    return L.head_nodes(label_rows, 2)


@query("leaf_targets", "label_rows", sql=f"with {NODES} select row_id, l.attr, coalesce(node, value) target from label_rows l left join f on l.attr = f.attr and l.value || '/' || l.leaf = f.node")
def leaf_targets(label_rows):
    return L.leaf_targets(label_rows, L.head_nodes(label_rows, 2)).select("row_id", "attr", "target")


@query("gold_agreement", "label_rows", sql="with n as (select tool, attr, clip, value, count(*) n, min(leaf) leaf from label_rows group by 1,2,3,4), m as (select *, row_number() over (partition by tool, attr, clip order by n desc, value) r from n), g as (select clip, attr, min(value) gv, min(leaf) gl from label_rows group by 1,2) select tool, m.attr, count(*) n, round(avg(case when value = gv then 1.0 else 0.0 end), 6) class_accuracy, round(avg(case when contains(gl, leaf) or contains(leaf, gl) then 1.0 else 0.0 end), 6) leaf_accuracy from m join g on m.clip = g.clip and m.attr = g.attr where r = 1 group by 1,2")
def gold_agreement(label_rows):
    gold = label_rows.groupBy("clip", "attr").agg(F.min("value").alias("gold_value"), F.min("leaf").alias("gold_leaf"))
    return L.gold_agreement(label_rows, gold).withColumns({c: F.round(c, 6) for c in ("class_accuracy", "leaf_accuracy")})


@query("union_sets", "label_rows", sql="select row_id, attr, 'a' as \"set\" from label_rows where tool = 'expert' and attr in ('Brand#11', 'Brand#12') union all select row_id, attr, 'b' from label_rows where tool = 'annotator'")
def union_sets(label_rows):
    return L.union_sets({"a": (label_rows.filter("tool = 'expert'"), ["Brand#11", "Brand#12"]), "b": (label_rows.filter("tool = 'annotator'"), None)}).select("row_id", "attr", "set")


@query("balanced_weights", "label_rows", sql="with c as (select attr, value node, count(*) n from label_rows group by 1,2), m as (select *, sum(n) over (partition by attr) m, count(*) over (partition by attr) k from c), t as (select sum(sqrt(m)) roots from (select distinct attr, m from m)) select attr, node, round(1e6 * sqrt(m) / roots * (0.5 / (k * n) + 0.5 / m), 6) weight from m, t")
def balanced_weights(label_rows):
    return L.balanced_weights(label_rows.select("attr", F.col("value").alias("node"))).withColumn("weight", F.round(1e6 * F.col("weight"), 6))


@query("quality_gates", "label_rows", sql="select 'labels' as name, count(*)::double measured, 10.0::double threshold, count(*) >= 10 ok from label_rows union all select 'repeated rows', (count(*) - count(distinct row_id))::double, 0.0, count(*) = count(distinct row_id) from label_rows")
def quality_gates(label_rows):
    return L.quality_gates([("labels", label_rows.agg(F.count("*").alias("measured")), ">=", 10), ("repeated rows", label_rows.agg((F.count("*") - F.countDistinct("row_id")).alias("measured")), "=", 0)])


@query("observed_gates", "label_rows", sql="select 'labels' as name, count(*)::double measured, 10.0::double threshold, count(*) >= 10 ok from label_rows union all select 'greatest score', max(score)::double, 10.0, max(score) <= 10 from label_rows union all select 'rows without a class', sum(case when value is null then 1 else 0 end)::double, 0.0, sum(case when value is null then 1 else 0 end) = 0 from label_rows")
def observed_gates(label_rows):
    """Gates that are measured while the table is written."""
    checks = [("labels", F.count(F.lit(1)), ">=", 10), ("greatest score", F.max("score"), "<=", 10), ("rows without a class", F.count_if(F.col("value").isNull()), "=", 0)]
    return L.observed_write(label_rows, scratch_folder(label_rows.sparkSession, "gated"), checks)


@query("write_report", "label_rows", sql="select '| ' || attr || ' | ' || cast(count(*) as varchar) || ' |' as line from label_rows group by attr")
def write_report(label_rows):
    return L.write_report(label_rows.groupBy("attr").agg(F.count("*").alias("n")), ["attr", "n"])


@query("disjointness_check", "label_rows", sql="select (select count(*) from (select clip from label_rows where clip % 2 = 0 intersect select clip from label_rows where clip % 2 = 1)) common_clips, (select count(*) - count(distinct row_id) from label_rows) repeated_rows")
def disjointness(label_rows):
    common = label_rows.filter("clip % 2 = 0").select("clip").intersect(label_rows.filter("clip % 2 = 1").select("clip")).agg(F.count("*").alias("common_clips"))
    return common.join(F.broadcast(label_rows.agg((F.count("*") - F.countDistinct("row_id")).alias("repeated_rows"))), F.lit(True))


# tree --------------------------------------------------------------------------------------------

SUP = "sup as (select attr, value, coalesce(leaf, '') leaf, clips, sources, tools, chunks from (select attr, value, leaf, grouping(leaf) g, count(distinct clip) clips, count(distinct source) sources, count(distinct tool) tools, count(distinct row_id) chunks from label_rows group by grouping sets ((attr, value, leaf), (attr, value))) where g = 1 or leaf is not null)"
# why a node is refused, by the rules that need no more than its support
MORE = f"len(list_filter(regexp_extract_all(leaf, '[a-z]+'), lambda x: not list_contains(regexp_extract_all(lower(value), '[a-z]+'), x) and not list_contains(regexp_extract_all(lower(attr), '[a-z]+'), x) and not list_contains({sql_list(T.GENERIC)}, x))) = 0"
SAME = "(leaf = value or len(list_filter(string_split_regex(leaf, '\\s+'), lambda x: x <> '' and not list_contains(string_split_regex(value, '\\s+'), x))) = 0)"
MEMBER = "(len(list_filter(list_transform(string_split_regex(value, ',| and | or '), lambda x: trim(x)), lambda x: x <> '')) > 1 and list_contains(list_transform(string_split_regex(value, ',| and | or '), lambda x: trim(x)), leaf))"
WHY = f"adm as (select *, case when leaf = '' then null when parent_clips >= 25 and clips >= 0.4 * parent_clips then 'covers most of its parent' when not {MEMBER} and {MORE} then 'says no more than its parent' when regexp_matches(leaf, '[0-9]') then 'numeric' when not {MEMBER} and {SAME} then 'says no more than its parent' when clips < 2 then 'seen on one clip' when sources < 2 then 'seen in one source' end refused from (select *, max(case when leaf = '' then clips end) over (partition by attr, value) parent_clips from sup))"


@query("node_support", "label_rows", sql=f"with {SUP} select * from sup")
def node_support(label_rows):
    return T.node_support(label_rows)


@query("admit_nodes", "label_rows", sql=f"with {SUP}, {WHY} select attr, value, leaf, clips, sources, refused from adm")
def admit_nodes(label_rows):
    return T.admit_nodes(T.node_support(label_rows)).select("attr", "value", "leaf", "clips", "sources", "refused")


@query("publish_manifest", "label_rows", sql=f"with {SUP}, {WHY} select (select count(distinct clip) from label_rows) clips, (select count(distinct row_id) from label_rows) n_rows, (select count(distinct attr) from label_rows) attributes, (select count(*) from adm where leaf = '') classes, (select count(*) from adm where leaf <> '' and refused is null) leaves, (select count(*) from adm where refused is not null) refused, (select string_agg(cast(source as varchar) || '=' || cast(n as varchar), '; ' order by cast(source as varchar)) from (select source, count(distinct clip) n from label_rows group by 1)) by_source, (select string_agg(refused || '=' || cast(n as varchar), '; ' order by refused) from (select refused, count(*) n from adm where refused is not null group by 1)) by_reason")
def publish_manifest(label_rows):
    return T.publish_manifest(label_rows, T.admit_nodes(T.node_support(label_rows)))


@query("tree_summary", "label_rows", sql=f"with {SUP}, t as (select *, 0 o from sup union all select attr, value, leaf, clips, sources, tools, chunks, 1 from sup where attr like '%1' and leaf <> ''), l as (select t.* from t join (select attr, max(o) o from t group by 1) m on m.attr = t.attr and m.o = t.o) select substr(attr, 1, 7) region, attr, sum(case when leaf = '' then 1 else 0 end)::bigint classes, sum(case when leaf <> '' then 1 else 0 end)::bigint leaves from l group by rollup (1, 2)")
def tree_summary(label_rows):
    s = T.node_support(label_rows)
    both = s.withColumn("o", F.lit(0)).unionByName(s.filter("attr like '%1' and leaf != ''").withColumn("o", F.lit(1)))
    return T.tree_summary(both, F.substring("attr", 1, 7), "o")


@query("tree_table_agreement", "label_rows", sql=f"with {SUP} select attr, value, leaf, case when clips <> 3 then clips + 1 end node_clips, clips table_clips from sup where clips >= 3 union all select attr, value, 'zz', 1, null from sup where leaf = ''")
def tree_agreement(label_rows):
    s = T.node_support(label_rows)
    nodes = s.filter("clips != 3").withColumn("clips", F.when(F.col("clips") > 3, F.col("clips") + 1).otherwise(F.col("clips")))
    extra = s.filter("leaf = ''").select("attr", "value", F.lit("zz").alias("leaf"), F.lit(1).cast("long").alias("clips"))
    return T.tree_agreement(nodes.select(extra.columns).unionByName(extra), label_rows)


@query("static_alias", "label_rows", sql="select row_id, attr, case when tool = 'expert' and value = 'small plated' then 'little' else value end as leaf from label_rows")
def static_alias(label_rows):
    named = label_rows.withColumn("leaf", F.col("value"))
    return T.static_alias(named, {"small plated": "little"}, F.col("tool") == "expert").select("row_id", "attr", "leaf")


STEMMED = f"w0 as (select distinct unnest(regexp_extract_all(lower(l), '[a-z]+')) w from (select leaf l from label_rows union select substr(attr, 1, 7) from label_rows union select split_part(gold_name, ' ', 2) || ' lace' from items)), {STEMS}"


@query("cofire_aliases", "label_rows", "items", sql=f"with recursive {STEMMED}, lw as (select l, list(distinct s) w from (select l, unnest(regexp_extract_all(lower(l), '[a-z]+')) w from (select leaf l from label_rows union select split_part(gold_name, ' ', 2) || ' lace' from items)) join stems using (w) group by 1), up as (select lower(gold_name) c, list_distinct(flatten(list(w))) w from items join lw on l = split_part(gold_name, ' ', 2) || ' lace' group by 1), t as (select distinct clip, 'x' attr, substr(attr, 1, 7) value, leaf, tool from label_rows where leaf <> ''), p as (select e.clip, e.attr, e.value, e.leaf, a.leaf alias, len(list_intersect(list_filter(list_distinct(list_concat(ew.w, coalesce(up.w, []))), lambda x: x <> 'brand'), aw.w)) s from t e join t a on e.clip = a.clip and e.attr = a.attr and e.value = a.value join lw ew on ew.l = e.leaf join lw aw on aw.l = a.leaf left join up on up.c = e.leaf where e.tool = 'expert' and a.tool = 'annotator' and not exists (select 1 from t b where b.tool = 'annotator' and b.clip = e.clip and b.attr = e.attr and b.value = e.value and b.leaf = e.leaf)), q as (select *, max(s) over (partition by clip, attr, value, leaf) m from p where s > 0), z as (select *, count(*) over (partition by clip, attr, value, leaf) ties from q where s = m), v as (select attr, value, leaf, alias, count(*) n from z where ties = 1 group by 1,2,3,4), r as (select *, sum(n) over (partition by attr, value, leaf) al, row_number() over (partition by attr, value, leaf order by n desc, alias) r from v) select attr, value, leaf, alias from r where r = 1 and n >= 0.5 * al")
def cofire_aliases(label_rows, items):
    x = label_rows.select("clip", F.lit("x").alias("attr"), F.substring("attr", 1, 7).alias("value"), "leaf", "tool")
    up = items.select(F.lower("gold_name").alias("child"), F.concat(F.split_part("gold_name", F.lit(" "), F.lit(2)), F.lit(" lace")).alias("ancestor"))
    return T.cofire_aliases(x, up)


MOVES = "c as (select substr(attr, 1, 7) region, leaf, attr, count(distinct clip) n from label_rows where leaf <> '' group by 1,2,3), h as (select region, leaf, arg_min(attr, (case attr when 'Brand#11' then 1 when 'Brand#21' then 2 else 1073741824 end, -n, attr)) to_attr from c group by 1,2 having count(*) > 1), hv as (select substr(attr, 1, 7) region, leaf, attr, arg_min(value, (-n, value)) to_value from (select attr, leaf, value, count(distinct clip) n from label_rows where leaf <> '' group by 1,2,3) group by 1,2,3), plan_ as (select distinct l.attr, l.value, l.leaf, h.to_attr, hv.to_value, l.leaf to_leaf from label_rows l join h on substr(l.attr, 1, 7) = h.region and l.leaf = h.leaf join hv on hv.region = h.region and hv.leaf = h.leaf and hv.attr = h.to_attr where l.attr <> h.to_attr)"
FIRST = ["Brand#11", "Brand#21"]


@query("plan_moves", "label_rows", sql=f"with {MOVES} select * from plan_")
def plan_moves(label_rows):
    return T.plan_moves(label_rows, F.substring("attr", 1, 7), FIRST)


@query("apply_moves", "label_rows", "schema", sql=f"with {MOVES}, m as (select distinct attr from schema where multi), l as (select distinct l.clip, l.attr, l.value, l.leaf, p.to_attr, p.to_value from label_rows l left join plan_ p on l.attr = p.attr and l.value = p.value and l.leaf = p.leaf), cur as (select clip, attr, min(value) lo, max(value) hi from l where to_attr is null group by 1,2), go as (select l.*, lo, hi from l left join cur on l.clip = cur.clip and l.to_attr = cur.attr where l.to_attr is not null) select clip, attr, value, leaf from l where to_attr is null union select clip, to_attr, to_value, leaf from go where lo is null or (lo = to_value and hi = to_value) or to_attr in (select attr from m) union select clip, attr, value, '' from go")
def apply_moves(label_rows, schema):
    return T.apply_moves(label_rows, T.plan_moves(label_rows, F.substring("attr", 1, 7), FIRST), schema)


@query("reparent_leaves", "label_rows", sql="with c as (select attr, leaf, value, count(distinct clip) n from label_rows group by 1,2,3), b as (select attr, leaf, arg_min(value, (-n, value)) v from c group by 1,2 having count(*) > 1) select row_id, l.attr, coalesce(v, value) as value, l.leaf from label_rows l left join b on l.attr = b.attr and l.leaf = b.leaf")
def reparent(label_rows):
    return T.reparent(label_rows).select("row_id", "attr", "value", "leaf")


# the whole chain ---------------------------------------------------------------------------------

CLOSED = [("sound.b1", "ring"), ("sound.b1", "gear"), ("sound.b3", "widget"), ("speech.b4", "bolts"), ("speech.b4", "gizmo")]
HOW = {"languages": ("speech.b5", "speech.b4", ["standard", "native"]), "examples": {"sound.b3": ["small bolt", "red widget", "blue ring", "hot gear"]}, "example_share": 0.005, "hub_clips": 8, "hub_share": 0.3, "hub_exempt": ["sound.b1"], "shared": [("sound.b3", "sound.b1"), ("sound.b3", "sound.b2")]}
RENAMED = {"bolts": "screw"}
TREE = f"""
w0 as (select distinct unnest(regexp_extract_all(l, '[a-z]+')) w from (select leaf l from tree_rows union select value from tree_rows union select 'screw')),
{STEMS},
lf as (select distinct leaf from tree_rows where leaf <> '' union select 'screw'),
k0 as (select leaf, list_filter(regexp_extract_all(leaf, '[a-z]+'), lambda x: not list_contains({sql_list(X.FILLER)}, x)) ws from lf),
k1 as (select leaf, case when len(ws) > 1 and list_contains({sql_list(X.TAIL)}, ws[len(ws)]) then ws[1:len(ws) - 1] else ws end ws from k0),
nk as (select k1.leaf, coalesce(string_agg(s, ' ' order by s), k1.leaf) k from k1 left join (select leaf, unnest(ws) w from k1) u on u.leaf = k1.leaf left join stems using (w) group by 1),
many as (select unnest(['sound.b2', 'speech.b4']) attr),
win as (select row_id, attr, coalesce(arg_min(value, (-score, seq, value)) filter (where tool = 'expert' and score >= 0.3), arg_min(value, (seq, value)) filter (where tool = 'annotator')) wv from tree_rows where attr not in (from many) group by 1,2),
v1 as (select t.row_id, t.attr, t.value, t.leaf, list(distinct tool) tools from tree_rows t join win w on t.row_id = w.row_id and t.attr = w.attr and t.value = wv group by 1,2,3,4
  union all select row_id, attr, value, leaf, list(distinct tool) from tree_rows where attr in (from many) and (tool <> 'expert' or score >= 0.3) group by 1,2,3,4),
v2 as (select row_id, attr, value, case when leaf = 'bolts' and not list_contains(tools, 'annotator') then 'screw' else leaf end leaf, tools from v1),
lw as (select l, list(distinct s) w from (select l, unnest(regexp_extract_all(l, '[a-z]+')) w from (select leaf l from tree_rows union select value from tree_rows)) join stems using (w) group by 1),
ct as (select distinct row_id, attr, value, leaf, tool from tree_rows where leaf <> '' and attr in (from many)),
cp as (select e.row_id, e.attr, e.value, e.leaf, a.leaf alias, len(list_intersect(list_filter(ew.w, lambda x: not list_contains(vw.w, x)), aw.w)) s from ct e join ct a on e.row_id = a.row_id and e.attr = a.attr and e.value = a.value join lw ew on ew.l = e.leaf join lw aw on aw.l = a.leaf join lw vw on vw.l = e.value where e.tool = 'expert' and a.tool = 'annotator' and not exists (select 1 from ct b where b.tool = 'annotator' and b.row_id = e.row_id and b.attr = e.attr and b.value = e.value and b.leaf = e.leaf)),
cq as (select *, max(s) over (partition by row_id, attr, value, leaf) m from cp where s > 0),
cz as (select *, count(*) over (partition by row_id, attr, value, leaf) ties from cq where s = m),
cv as (select attr, value, leaf, alias, count(*) n from cz where ties = 1 group by 1,2,3,4),
al as (select attr, value, leaf, alias from (select *, sum(n) over (partition by attr, value, leaf) al, row_number() over (partition by attr, value, leaf order by n desc, alias) r from cv) where r = 1 and n >= 0.5 * al),
rows_ as (select row_id, min(clip) clip, min(source) source from tree_rows group by 1),
v3 as (select row_id, v2.attr, v2.value, coalesce(alias, v2.leaf) leaf, list_distinct(flatten(list(tools))) tools from v2 left join al on al.attr = v2.attr and al.value = v2.value and al.leaf = v2.leaf group by 1,2,3,4),
v as (select v3.*, clip, source from v3 join rows_ using (row_id)),
x as (select v.*, k, split_part(attr, '.', 1) region from v join nk using (leaf)),
c as (select region, k, attr, count(distinct clip) n from x group by 1,2,3),
h as (select region, k, max(case when attr = 'sound.b2' then attr end) f, bool_or(attr = 'speech.b5') acts, arg_min(attr, (-n, attr)) most from c group by 1,2 having count(*) > 1),
hv as (select region, k, attr, arg_min(value, (-n, value)) to_value from (select region, k, attr, value, count(distinct clip) n from x group by 1,2,3,4) group by 1,2,3),
hf as (select region, k, attr, arg_min(leaf, (-n, leaf)) to_leaf from (select region, k, attr, leaf, count(*) n from x group by 1,2,3,4) group by 1,2,3),
p0 as (select distinct x.region, x.k, x.attr, value, leaf, coalesce(f, case when acts and regexp_matches(string_split(leaf, ' ')[-1], '{T.AGENT}') then 'speech.b5' end, most) to_attr from x join h on x.region = h.region and x.k = h.k),
p1 as (select p0.attr, value, leaf, p0.to_attr, to_value, to_leaf from p0 join hv on hv.region = p0.region and hv.k = p0.k and hv.attr = p0.to_attr join hf on hf.region = p0.region and hf.k = p0.k and hf.attr = p0.to_attr where p0.attr <> p0.to_attr),
voc(attr, value) as (values {", ".join(f"('{a}', '{v}')" for a, v in CLOSED)}),
p2 as (select x.attr, x.value, x.leaf, min(voc.attr) to_attr from x join voc on voc.value = x.leaf and voc.attr <> x.attr and split_part(voc.attr, '.', 1) = x.region where not exists (select 1 from p1 where p1.attr = x.attr and p1.value = x.value and p1.leaf = x.leaf) group by 1,2,3),
mv as (select * from p1 union all select attr, value, leaf, to_attr, leaf, '' from p2),
l as (select row_id, v.attr, v.value, v.leaf, to_attr, to_value, to_leaf from v left join mv on mv.attr = v.attr and mv.value = v.value and mv.leaf = v.leaf),
cur as (select row_id, attr, min(value) lo, max(value) hi from l where to_attr is null group by 1,2),
go as (select l.*, lo, hi from l left join cur on l.row_id = cur.row_id and l.to_attr = cur.attr where l.to_attr is not null),
md as (select row_id, attr, value, leaf from l where to_attr is null union select row_id, to_attr, to_value, to_leaf from go where lo is null or (lo = to_value and hi = to_value) or to_attr in (from many) union select row_id, attr, value, '' from go),
mk as (select md.*, k, clip, source from md join rows_ using (row_id) left join nk using (leaf)),
rp as (select attr, k, arg_min(value, (-n, value)) bv from (select attr, k, value, count(distinct clip) n from mk where leaf <> '' group by 1,2,3) group by 1,2 having count(*) > 1),
pl as (select row_id, mk.attr, coalesce(bv, value) as value, leaf, mk.k, clip, source from mk left join rp on rp.attr = mk.attr and rp.k = mk.k),
tl as (select row_id, list_distinct(flatten(list(tools))) tools from v group by 1),
lv as (select attr, value, leaf, k, count(distinct clip) clips from pl where leaf <> '' group by 1,2,3,4),
cn as (select attr, value, leaf, first_value(leaf) over (partition by attr, value, k order by clips desc, leaf) canon from lv),
nm as (select distinct attr, value, canon leaf, list_distinct(string_split(k, ' ')) w from cn join nk on nk.leaf = canon),
gl as (select a.attr, a.value, a.leaf, arg_min(b.leaf, (-len(b.w), b.leaf)) g from nm a join nm b on a.attr = b.attr and a.value = b.value and len(b.w) < len(a.w) and len(list_filter(b.w, lambda t: not list_contains(a.w, t))) = 0 where not list_contains({sql_list(E.ABOUT)}, string_split(a.leaf, ' ')[-1]) group by 1,2,3),
up(attr, value, leaf, up, depth) as (select attr, value, leaf, g, 1 from gl union all select up.attr, up.value, up.leaf, g, depth + 1 from up join gl on gl.attr = up.attr and gl.value = up.value and gl.leaf = up.up),
own as (select pl.attr, pl.value, coalesce(canon, '') leaf, row_id, clip, source from pl left join cn on cn.attr = pl.attr and cn.value = pl.value and cn.leaf = pl.leaf),
ev as (select * from own union select own.attr, own.value, up.up, row_id, clip, source from own join up on up.attr = own.attr and up.value = own.value and up.leaf = own.leaf union select attr, value, '', row_id, clip, source from own),
su as (select attr, value, leaf, count(distinct clip) clips, count(distinct source) sources, count(distinct row_id) chunks from ev group by 1,2,3),
an as (select attr, value, leaf, bool_or(list_contains(tools, 'annotator')) an from ev join tl using (row_id) group by 1,2,3),
fo as (select attr, value, canon leaf, string_agg(leaf, ',' order by leaf) forms, list(leaf) fl from cn group by 1,2,3),
s0 as (select su.*, an, coalesce(forms, '') forms, fl, max(case when leaf = '' then clips end) over (partition by attr, value) pc, sum(case when leaf <> '' then clips end) over (partition by attr) mass, sum(case when leaf <> '' then clips end) over (partition by attr, leaf) mine, split_part(attr, '.', 1) region from su join an using (attr, value, leaf) left join fo using (attr, value, leaf)),
hm as (select region, leaf, coalesce(max(case when attr = 'sound.b2' then attr end), case when bool_or(attr = 'speech.b5') and regexp_matches(string_split(leaf, ' ')[-1], '{T.AGENT}') then 'speech.b5' end, arg_min(attr, (-mine, attr))) hm from (select distinct region, leaf, attr, mine from s0 where leaf <> '') group by 1,2 having count(*) > 1),
cl as (select leaf, s0.attr, min(voc.attr) cl from s0 join voc on voc.value = leaf and voc.attr <> s0.attr and not (s0.attr || voc.attr in ('sound.b3sound.b1', 'sound.b1sound.b3', 'sound.b3sound.b2', 'sound.b2sound.b3')) group by 1,2),
co as (select attr, value, leaf, list_filter(regexp_extract_all(leaf, '[a-z]+'), lambda t: not list_contains(['standard', 'native'], t)) cw from s0),
ad as (select s0.*, case when leaf = '' then null when hm is not null and hm <> attr then 'belongs to ' || hm
  when attr = 'speech.b5' and (len(cw) = 0 or (len(cw) = 1 and exists (select 1 from s0 z where z.attr = 'speech.b4' and z.leaf = cw[1] and z.leaf <> ''))) then 'names the language, not an accent'
  when attr = 'sound.b3' and len(list_intersect(list_concat([leaf], coalesce(fl, [])), ['small bolt', 'red widget', 'blue ring', 'hot gear'])) > 0 and clips >= 0.005 * greatest(mass, 1) then 'prompt example copied as a filler'
  when attr <> 'sound.b1' and pc >= 8 and clips >= 0.3 * pc then 'covers most of its parent'
  when not {MEMBER} and {MORE} then 'says no more than its parent' when regexp_matches(leaf, '[0-9]') then 'numeric' when not {MEMBER} and {SAME} then 'says no more than its parent'
  when cl is not null then 'belongs to ' || cl when clips < 2 then 'seen on one clip' when an and sources < 2 then 'seen in one source' end refused
  from s0 join co using (attr, value, leaf) left join hm using (region, leaf) left join cl using (leaf, attr)),
pa as (select up.attr, up.value, up.leaf, arg_min(up.up, (depth, up.up)) parent from up join ad on ad.attr = up.attr and ad.value = up.value and ad.leaf = up.up and ad.refused is null group by 1,2,3)
"""


def _tree(tree_rows):
    multi = tree_rows.select("attr").distinct().withColumn("multi", F.col("attr").isin("sound.b2", "speech.b4"))
    vocab = tree_rows.sparkSession.createDataFrame(CLOSED, "attr string, value string")
    return T.build_tree(tree_rows, 0.3, multi, F.split_part("attr", F.lit("."), F.lit(1)), ["sound.b2"], names=RENAMED, vocab=vocab, role="speech.b5", **HOW)


@query("build_tree", "tree_rows", sql=f"with recursive {TREE} select ad.attr, ad.value, ad.leaf, clips, sources, chunks, forms, parent from ad left join pa on pa.attr = ad.attr and pa.value = ad.value and pa.leaf = ad.leaf where refused is null")
def build_tree(tree_rows):
    return _tree(tree_rows)["nodes"].withColumn("forms", F.array_join("forms", ","))


@query("build_tree_refused", "tree_rows", sql=f"with recursive {TREE} select attr, value, leaf, clips, refused from ad where refused is not null")
def build_tree_refused(tree_rows):
    return _tree(tree_rows)["refused"].select("attr", "value", "leaf", "clips", "refused")


@query("build_tree_labels", "tree_rows", sql=f"with recursive {TREE}, ok as (select attr, value, leaf from ad where refused is null and leaf <> '') select distinct row_id, own.attr, own.value, coalesce(ok.leaf, '') as leaf from own left join ok on ok.attr = own.attr and ok.value = own.value and ok.leaf = own.leaf union select row_id, own.attr, own.value, up.up from own join ok on ok.attr = own.attr and ok.value = own.value and ok.leaf = own.leaf join up on up.attr = own.attr and up.value = own.value and up.leaf = own.leaf join ok g on g.attr = up.attr and g.value = up.value and g.leaf = up.up")
def build_tree_labels(tree_rows):
    return _tree(tree_rows)["labels"]


@query("canonical_leaf_lookup", "label_rows", sql="with n as (select attr, value, leaf, substr(leaf, 1, 5) cf from label_rows group by 1,2,3 having count(*) > 1) select l.row_id, l.attr, coalesce(cf, '') as leaf from label_rows l left join n on l.attr = n.attr and l.value = n.value and l.leaf = n.leaf")
def canonical_leaf(label_rows):
    forms = label_rows.groupBy("attr", "value", F.col("leaf").alias("form")).agg(F.count("*").alias("n")).filter("n > 1").withColumn("canonical", F.substring("form", 1, 5))
    return T.canonical_leaf(label_rows, forms).select("row_id", "attr", "leaf")


@query("attribute_prune", "label_rows", sql="select row_id, attr from label_rows where attr not in ('Brand#11', 'Brand#12')")
def prune(label_rows):
    return T.attribute_prune(label_rows, ["Brand#11", "Brand#12"]).select("row_id", "attr")


@query("apply_groups", "label_rows", sql="with g as (select attr, value, leaf from label_rows group by 1,2,3 having count(*) = 2) select row_id, l.attr, l.value, case when g.leaf is not null then upper(l.leaf) else l.leaf end as leaf from label_rows l left join g on l.attr = g.attr and l.value = g.value and l.leaf = g.leaf")
def apply_groups(label_rows):
    canon = label_rows.groupBy("attr", "value", "leaf").count().filter("count = 2").select("attr", "value", "leaf", F.upper("leaf").alias("to_leaf"))
    return T.apply_groups(label_rows, canon).select("row_id", "attr", "value", "leaf")


INDEXED = "select item % 3 source, tag1 as value, tag2 || cast(item % 5 as varchar) as name, case when item % 4 = 0 then tag2 || cast((item + 1) % 5 as varchar) when item % 9 = 0 then 'nowhere' end same_as from tags"


@query("node_index", "tags", sql=f"with l as ({INDEXED}), k as (select l.*, exists (select 1 from l z where z.value = l.value and z.name = l.same_as) linked from l), c as (select distinct value, name from k where not linked) select distinct source, k.name, k.value, case when exists (select 1 from c where c.value = k.value and c.name = k.same_as) then same_as else k.name end node from k")
def node_index(tags):
    return T.node_index(tags.sparkSession.sql(INDEXED.replace("varchar", "string").replace("from tags", "from {tags}"), tags=tags))


@query("events_to_labels", "frames", sql=f"with {SEG}, w as (select distinct clip, k, concat(cast(clip as varchar), ':', cast(k as varchar)) row_id, k * 0.5 a, k * 0.5 + 0.5 b from events_, range(-1, 6) r(k)), h as (select row_id, label, t0, t1, peak from events_ e join w on w.clip = e.clip where k = -1 or least(e.t1, b) - greatest(e.t0, a) >= greatest(least(0.5, (e.t1 - e.t0) / 2), 1e-6)) select row_id, 'speech.kind' attr, 'pressed' as value, '' as leaf, round(peak, 6) score, round(t0, 4) t0 from h where label = 'click' union all select row_id, 'sound.event', case label when 'purchase' then 'till' else 'other' end, label, round(peak, 6), round(t0, 4) from h where label <> 'view'")
def events_to_labels(frames):
    e, spark = _events(frames), frames.sparkSession
    rows = e.select("clip").distinct().select("clip", F.explode(F.sequence(F.lit(-1), F.lit(5))).alias("k"))
    rows = rows.select("clip", F.concat_ws(":", F.col("clip").cast("string"), F.col("k").cast("string")).alias("row_id"), F.when(F.col("k") < 0, "clip").otherwise("g").alias("grid"), (F.col("k") * 0.5).alias("t0"), (F.col("k") * 0.5 + 0.5).alias("t1"))
    named = spark.createDataFrame([("click", "speech.kind", "pressed")], "label string, attr string, value string")
    kinds = spark.createDataFrame([("purchase", "till")], "label string, kind string")
    out = T.events_to_labels(e, rows, named, kinds, ["view"])
    return out.select("row_id", "attr", "value", "leaf", F.round("score", 6).alias("score"), F.round("t0", 4).alias("t0"))


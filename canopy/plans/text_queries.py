"""Queries over names, items, forms, files, learned columns and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import aspects as A
from ..functions import text as X
from ..learn import heads as H
from ..operators import entity as E
from ..operators import items as Q
from ..operators import tree as G
from ..sources import readers as R
from ..sources.features import FeatureStore
from ..streaming import jobs as J
from ..workers import cut
from ..workers import scratch_folder as _folder
from .catalog import STEMS, query, sql_list
from .label_queries import SEG


# sources -----------------------------------------------------------------------------------------

REC = "select cast(l_orderkey as varchar) || ':' || cast(l_linenumber as varchar) row_id"


@query("read_jsonl_tolerant", "events", sql="select event_id, event_type, value from events")
def read_jsonl(events):
    at = _folder(events.sparkSession, "jsonl")
    lines = events.select(F.to_json(F.struct("event_id", "event_type", "value")).alias("value"))
    lines.unionByName(lines.filter("value like '%7%'").select(F.lit('{"event_id": 1, "event_t').alias("value"))).write.text(at)
    return R.read_jsonl(events.sparkSession, at, "event_id long, event_type string, value double").filter("event_id is not null and event_type is not null")


#: Gold answers in all shapes: a string, an object, an object with a leaf, a list of both, nothing, and a number (which is none).
GOLD_SHAPES = """case n_ % 6 when 0 then concat('"', lang, '"') when 1 then concat('{"is": "', lang, '"}') when 2 then concat('{"is": "', lang, '", "leaf": "a \\\\"b\\\\" ', source, '"}') when 3 then concat('["', lang, '", {"is": "x", "leaf": "', source, '"}]') when 4 then 'null' else '7' end"""


@query("read_manifest", "clips", sql="with g as (select audio_path as path, source, lang, ascii(clip) n_, unnest([1, 2]) i from clips) select path, source, i, case when i = 1 then lang else 'x' end gold_is, case when i = 2 then source when n_ % 6 = 2 then 'a \"b\" ' || source end leaf from g where n_ % 6 = 3 or (i = 1 and n_ % 6 < 3)")
def read_manifest(clips):
    at = _folder(clips.sparkSession, "manifest")
    c = clips.withColumn("n_", F.ascii("clip"))
    line = F.concat(F.lit('{"path": "'), "audio_path", F.lit('", "source": "'), "source", F.lit('", "gold": {"other": 1, "lang": '), F.expr(GOLD_SHAPES), F.lit("}}"))
    c.select(line.alias("value")).unionByName(c.limit(1).select(F.lit('{"path": "cut').alias("value"))).write.text(at)
    m = R.read_manifest(clips.sparkSession, at).filter("path is not null")
    return m.select("path", "source", F.posexplode(F.element_at("gold", "lang")).alias("i", "g")).select("path", "source", (F.col("i") + 1).alias("i"), F.col("g.is").alias("gold_is"), "g.leaf")


def _shards(label_rows):
    at = _folder(label_rows.sparkSession, "shards")
    rec = label_rows.select("row_id", "attr", "value", "leaf", "score", "tool", F.lit(None).cast("string").alias("done"))
    for tool in ("annotator", "expert"):
        mine = rec.filter(F.col("tool") == tool)
        done = label_rows.filter((F.col("tool") == tool) & (F.col("clip") % 3 > 0)).select(F.col("clip").cast("string").alias("done")).distinct()
        mine.unionByName(done, allowMissingColumns=True).write.json(f"{at}/{tool}")
    return at


@query("read_label_shards", "label_rows", sql="select row_id, attr, value, leaf, tool, tool as shard from label_rows")
def read_label_shards(label_rows):
    """All shards with a resume point before any of them."""
    return R.read_label_shards(label_rows.sparkSession, _shards(label_rows), newer_than="2001-01-01 00:00:00").select("row_id", "attr", "value", "leaf", "tool", "shard")


@query("repair_shard", "label_rows", sql="select row_id, attr, tool from label_rows where clip % 3 > 0")
def repair_shard(label_rows):
    spark, at = label_rows.sparkSession, _shards(label_rows)
    return R.repair_shard(R.read_label_shards(spark, at), R.done_markers(spark, at)).select("row_id", "attr", "tool")


@query("read_strong_segments", "spans", sql="select cast(clip as varchar) clip, count(*) n, min(t0) first_, max(t1) last_ from spans group by 1")
def read_segments(spans):
    at = _folder(spans.sparkSession, "segments")
    spans.select(F.concat_ws("_", F.col("clip").cast("string"), F.col("span_id").cast("string")).alias("segment_id"), "t0", "t1", "label").write.option("sep", "\t").option("header", "true").csv(at)
    s = R.read_segments(spans.sparkSession, at)
    return s.select("clip", F.size("spans").cast("long").alias("n"), F.array_min(F.transform("spans", lambda x: x["t0"])).alias("first_"), F.array_max(F.transform("spans", lambda x: x["t1"])).alias("last_"))


@query("read_multilabel_csv", "tags", sql="select cast(item as varchar) id, tag1 as label from tags union all select cast(item as varchar), tag2 from tags")
def read_multilabel(tags):
    at = _folder(tags.sparkSession, "multilabel")
    tags.select(F.col("item").alias("id"), F.concat_ws(",", "tag1", "tag2").alias("labels")).write.option("header", "true").csv(at)
    return R.read_multilabel_csv(tags.sparkSession, at)


@query("read_ontology", "ontology", sql="select cast(child as varchar) child, cast(parent as varchar) parent from ontology")
def read_ontology(ontology):
    at = _folder(ontology.sparkSession, "ontology")
    ontology.groupBy(F.col("parent").cast("string").alias("id")).agg(F.max("parent").cast("string").alias("name"), F.collect_list(F.col("child").cast("string")).alias("child_ids")).write.json(at)
    return R.read_ontology(ontology.sparkSession, at, multi_line=False)[1]


@query("read_aspect_list", "tags", sql="select cast(item as varchar) id, tag1 as aspect from tags union all select cast(item as varchar), tag2 from tags")
def read_aspects(tags):
    at = _folder(tags.sparkSession, "aspects")
    tags.select(F.col("item").alias("id"), F.concat(F.lit("['"), "tag1", F.lit("', '"), "tag2", F.lit("']")).alias("aspects")).write.option("header", "true").option("escape", '"').csv(at)
    return R.read_aspects(tags.sparkSession, at)


@query("read_tab_log", "events", sql="select 'w' || cast(event_id as varchar) wav, event_type utterance, cast(user_id as varchar) code from events where event_id % 2 = 0")
def read_tab_log(events):
    at = _folder(events.sparkSession, "log")
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("[1] w"), F.col("event_id").cast("string"), F.lit("\t"), "event_type", F.lit("\t"), F.col("user_id").cast("string"))).otherwise("[1] broken line")
    events.select(line.alias("value")).write.text(at)
    return R.read_tab_log(events.sparkSession, at)


@query("reference_sentences", "text", sql="select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by doc_id) r from (select min(doc_id) doc_id, lang, text from text group by 2,3)) where r <= 20")
def reference_sentences(text):
    return R.reference_sentences(text, 20).select("doc_id", "lang")


@query("place_language", "text", sql="select doc_id, case when lang in ('de', 'en') then 'germanic' when lang = 'fr' then 'romance' else 'unplaced' end grp from text")
def place_language(text):
    return R.place_language(text, {"en": "eng"}, {"eng": "germanic", "de": "germanic", "fr": "romance"}).select("doc_id", "grp")


@query("write_table", "items", sql="select genus, count(*) n from items group by 1")
def write_table(items):
    at = _folder(items.sparkSession, "table")
    R.write_table(items, at, ["id"])
    return items.sparkSession.read.parquet(at).groupBy("genus").agg(F.count("*").alias("n"))


@query("load_items_filtered", "items", sql="with o as (select id, 'a' k, gold_name t from items union all select id, 'b', grp from items), r as (select *, row_number() over (partition by id order by md5(concat('7:', cast(id as varchar), ':', k))) r from o) select id, genus, chr(cast(96 + r as int)) gold from r join items using (id) where k = 'b' and genus <> 'Brand#11' and id % 5 > 0 and id % 7 > 0")
def load_items_filtered(items):
    at = _folder(items.sparkSession, "items")
    files = F.when(F.col("id") % 5 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x")))
    choices = F.when(F.col("id") % 7 == 0, F.array("gold_name")).otherwise(F.array("gold_name", "grp"))
    items.select("id", "genus", F.col("genus").alias("category"), files.alias("audio_path"), choices.alias("choices"), F.col("grp").alias("answer")).write.parquet(at)
    kept = R.read_items(items.sparkSession, at, ["Brand#11"])
    options = Q.with_gold(Q.letter_choices(kept), kept.select("id", "answer"))
    gold = Q.shuffle_options(options).join(options.select("id", F.col("letter").alias("was"), "gold").hint("merge"), ["id", "was"]).filter("was = gold")
    return kept.select("id", "genus").join(gold.select("id", F.col("letter").alias("gold")).hint("merge"), "id")


@query("load_items_multihop", "items", sql="select id, 'h1' hop, gold_name || '?' question, genus || '|' || grp options from items union all select id, 'h2', grp || '?', grp || '|' || genus from items")
def load_items_multihop(items):
    q = lambda a, b, c: F.concat(F.col(a), F.lit("? A. "), F.col(b), F.lit(" B. "), F.col(c))
    m = items.select("id", F.create_map(F.lit("h1"), q("gold_name", "genus", "grp"), F.lit("h2"), q("grp", "grp", "genus")).alias("hops"))
    return R.multihop_items(m).withColumn("options", F.array_join("options", "|"))


# items -------------------------------------------------------------------------------------------


def _options(items):
    o = items.select("id", F.array(F.concat(F.lit("(A) "), "genus"), F.concat(F.lit("(B) "), "gold_name"), F.concat(F.lit("(C) "), "grp")).alias("choices"))
    return Q.letter_choices(o)


OPT = "o as (select id, 'a' letter, genus text from items union all select id, 'b', gold_name from items union all select id, 'c', grp from items)"


ANSWER = "case id % 6 when 0 then upper(gold_name) when 1 then 'zz ' || grp when 2 then 'nothing of it' when 3 then split_part(gold_name, ' ', 1) || ' ' || split_part(gold_name, ' ', 2) || ' else' when 4 then grp || ' ' || gold_name else gold_name || chr(10) || grp end"
def _match(answer: str, options: str = "o") -> str:
    """Tables that lead to m(id, gold), the option that an answer names."""
    return f"""
w as (select o.id, letter, lower(trim(text)) v, lower(trim(a)) a, contains(a, chr(10)) two from {options} o join (select id, {answer} a from items) x on x.id = o.id),
f as (select *, v = a same, contains(v, a) or contains(a, v) part, len(list_intersect(list_distinct(regexp_extract_all(a, '[a-z0-9]+')), list_distinct(regexp_extract_all(v, '[a-z0-9]+')))) / greatest(1, len(list_distinct(regexp_extract_all(a, '[a-z0-9]+')))) share from w),
r as (select *, row_number() over (partition by id order by share desc, letter desc) r, lead(share) over (partition by id order by share desc, letter desc) nxt from f),
m as (select id, case when not bool_or(two) then coalesce(min(letter) filter (where same), case when count(*) filter (where part) = 1 then min(letter) filter (where part) end, min(letter) filter (where r = 1 and share >= 0.5 and (nxt is null or share - nxt >= 0.2))) end gold from r group by 1)"""


@query("match_gold_fuzzy", "items", sql=f"with {OPT}, {_match(ANSWER)} select * from m")
def match_gold(items):
    return Q.match_gold(items.select("id", F.expr(ANSWER).alias("answer")), _options(items))


GOLD = "case id % 4 when 0 then '(B) whatever' when 1 then upper(gold_name) when 2 then grp else 'none of these' end"


@query("load_items_letters", "items", sql=f"with {OPT}, {_match(GOLD)} select o.id, letter, text, case when o.id % 4 = 0 then 'b' else gold end gold from o join m on m.id = o.id")
def load_items_letters(items):
    return Q.with_gold(_options(items), items.select("id", F.expr(GOLD).alias("answer")), keep=True)


@query("load_items_list", "items", sql=f"with {OPT}, ab as (select * from o where letter < 'c'), {_match(GOLD, 'ab')} select o.id, letter, text, case when o.id % 4 = 0 then 'b' else gold end gold from ab o join m on m.id = o.id where o.id % 4 = 0 or gold is not null")
def load_items_list(items):
    o = Q.letter_choices(items.select("id", F.array("genus", "gold_name").alias("choices")))
    return Q.with_gold(o, items.select("id", F.expr(GOLD).alias("answer")))


@query("shuffle_options", "items", sql=f"with {OPT}, r as (select *, row_number() over (partition by id order by md5(concat('7:', cast(id as varchar), ':', letter))) r from o) select id, chr(cast(96 + r as int)) letter, text, letter was from r")
def shuffle_options(items):
    return Q.shuffle_options(_options(items))


@query("choice_norm", "items", sql="select id, trim(regexp_replace(lower(gold_name || ' (' || genus || ')!'), '[^a-z0-9 ]', '', 'g')) norm, '(a) ' || genus || '  (b) ' || grp both_ from items")
def choice_norm(items):
    return items.select("id", X.choice_norm(F.concat("gold_name", F.lit(" ("), "genus", F.lit(")!"))).alias("norm"), X.choices_text(F.array(F.lit("a"), F.lit("b")), F.array("genus", "grp")).alias("both_"))


FORM = "f as (select form_id, attr, lower(json_extract_string(regexp_extract(raw, '\\{.*\\}', 0), '$.is')) v, json_extract_string(regexp_extract(raw, '\\{.*\\}', 0), '$.detail') d from forms)"


@query("parse_json_answer", "forms", sql=f"with {FORM} select form_id, v, d from f")
def parse_json_answer(forms):
    j = forms.withColumn("j", X.json_object(F.col("raw")))
    return j.select("form_id", F.lower(F.element_at("j", "is")).alias("v"), F.element_at("j", "detail").alias("d"))


# answered forms with two fields: kind (one of the classes) and tone (any of four), in all shapes an answer can have
TONES = ["small", "red", "blue", "hot"]
ANSWERED = """concat('so: ', chr(123), concat_ws(', ',
  case form_id % 6 when 0 then concat('"kind": ', chr(123), '"is": "', upper(v), '", "detail": "', d, '"', chr(125)) when 1 then concat('"kind": "', v, ', zzz"') when 2 then '"kind": "unsure"' when 4 then concat('"kind": ["zzz", ', chr(123), '"is": "', v, '", "detail": "Nice 2"', chr(125), ']') when 5 then concat('"kind": ', chr(123), '"is": "none"', chr(125)) end,
  case form_id % 5 when 0 then concat('"tone": ["small", ', chr(123), '"is": "red", "detail": "dark one"', chr(125), ']') when 1 then '"tone": "red, blue, purple"' when 2 then concat('"tone": [', chr(123), '"is": "small", "detail": "a bit"', chr(125), ', ', chr(123), '"is": "small", "detail": ""', chr(125), ']') when 4 then concat('"tone": ', chr(123), '"is": "unsure", "detail": "x"', chr(125)) end), case when form_id % 11 = 0 then '' else chr(125) end, ' ok')"""
CLEANED = "regexp_replace(regexp_replace(regexp_replace(replace(string_split_regex(lower(coalesce(t, '')), ' and | with |[,;/]')[1], '_', ' '), '[^a-z'' -]', ' ', 'g'), '\\s+', ' ', 'g'), '^[ ''-]+|[ ''-]+$', '', 'g')"
VALID = f"""{FORM}, r as (select form_id, regexp_extract({ANSWERED}, '(?s)\\{{.*\\}}', 0) j from f), k as (select form_id, try_cast(j as json) j from r where try_cast(j as json) is not null and j <> ''),
sp(attr, value) as (select 'kind', v from (select distinct v from f) union all select 'tone', unnest({sql_list(TONES)})),
fl as (select unnest(['kind', 'tone']) attr), x as (select form_id, attr, json_extract(j, '$.' || attr) a from k, fl),
el as (select form_id, attr, unnest(case json_type(a) when 'ARRAY' then json_extract(a, '$[*]') else [a] end) e, unnest(range(1, 20)) i from x where a is not null),
pa as (select form_id, attr, i * 100 i, lower(trim(coalesce(json_extract_string(e, '$.is'), ''))) v, coalesce(json_extract_string(e, '$.detail'), '') t from el where json_type(e) = 'OBJECT' union all select form_id, attr, i * 100 + j, lower(trim(v)), '' from (select form_id, attr, i, unnest(string_split(json_extract_string(e, '$'), ',')) v, unnest(range(1, 20)) j from el where json_type(e) = 'VARCHAR') where trim(v) <> ''),
pb as (select pa.*, sp.value is not null ok, {CLEANED} c from pa left join sp on sp.attr = pa.attr and sp.value = pa.v where v <> ''),
pc as (select *, case when c = '' or c in ('unsure', 'none', 'n a') or c = v or regexp_matches(t, '[0-9]') or len(string_split(c, ' ')) > 4 then '' else c end leaf, min(case when ok then i end) over (partition by form_id, attr) mi from pb),
pd as (select *, max(case when i = mi then v end) over (partition by form_id, attr) v1 from pc),
vv as (select form_id, attr, list(v order by i) filter (where ok and (attr = 'tone' or i = mi)) vs, list(v || ':' || leaf order by i) filter (where ok and leaf <> '' and (attr = 'tone' or v = v1)) ls, list(v order by i) filter (where not ok and v not in ('unsure', 'none')) off, bool_or(ok) ok, bool_or(v = 'unsure') un from pd group by 1,2)"""


def _forms(forms):
    x = forms.select("form_id", X.json_object(F.col("raw")).alias("j")).select("form_id", F.lower(F.element_at("j", "is")).alias("v"), F.element_at("j", "detail").alias("d"))
    kinds = x.select(F.lit("kind").alias("attr"), F.col("v").alias("value"), F.lit(False).alias("multi")).distinct()
    tones = forms.sparkSession.createDataFrame([("tone", t, True) for t in TONES], "attr string, value string, multi boolean")
    return Q.validate_forms(x.select("form_id", F.expr(ANSWERED).alias("raw")), kinds.unionByName(tones))


@query("validate_form", "forms", sql=f"with {VALID} select x.form_id, x.attr, case when a is null then 'missing' when ok then 'ok' when un then 'unsure' else 'none' end status, coalesce(array_to_string(vs, ','), '') \"values\", coalesce(array_to_string(ls, ','), '') leaves, coalesce(array_to_string(off, ','), '') off from x left join vv on vv.form_id = x.form_id and vv.attr = x.attr")
def validate_form(forms):
    v = _forms(forms)
    return v.select("form_id", "attr", "status", F.array_join("values", ",").alias("values"), F.array_join(F.transform("leaves", lambda p: F.concat(p["value"], F.lit(":"), p["leaf"])), ",").alias("leaves"), F.array_join("off", ",").alias("off"))


@query("form_to_labels", "forms", sql=f"with {VALID}, l as (select form_id, attr, split_part(p, ':', 1) as value, split_part(p, ':', 2) as leaf from (select form_id, attr, unnest(ls) p from vv)), n as (select form_id, attr, v as value, count(*) n from (select form_id, attr, unnest(vs) v from vv) group by 1,2,3), m as (select form_id, attr, value, count(*) m from l group by 1,2,3) select * from l union all select n.form_id, n.attr, n.value, '' from n left join m on m.form_id = n.form_id and m.attr = n.attr and m.value = n.value where n > coalesce(m, 0)")
def form_to_labels(forms):
    return Q.form_labels(_forms(forms))


@query("music_form_filter", "forms", sql="with l as (select form_id % 50 as k, arg_max(attr, form_id) cls, arg_max(raw, form_id) tx from forms group by 1), n as (select *, count(*) over (partition by cls) n from l where tx not like '%BRASS%') select k as \"key\", cls from n where n >= 2")
def music_form_filter(forms):
    f = forms.select((F.col("form_id") % 50).alias("key"), F.col("form_id").alias("ord"), F.col("attr").alias("cls"), F.col("raw").alias("text"))
    return Q.form_filter(f, 2, "BRASS").select("key", "cls")


VERDICT = "case id % 5 when 0 then '1: Yes' || chr(10) || '2) no, not it' || chr(10) || 'maybe so 3: yes' when 1 then ' 12. NO' || chr(10) || '7 yes' when 2 then '1: yesterday' || chr(10) || '  2 : no' when 3 then '- 4 - **Yes**' || chr(10) || chr(10) || '#5.no' else gold_name end"
LISTED = "case id % 4 when 0 then concat('here: [', chr(123), '\"name\": \"', upper(gold_name), '\", \"attr\": \"', genus, '\"', chr(125), ', ', chr(123), '\"name\": \"other\"', chr(125), '] done') when 1 then '[broken' when 2 then concat('[', chr(123), '\"name\": \" ', grp, ' \", \"attr\": \"x\"', chr(125), ', 7]') else null end"


@query("parse_verdicts", "items", sql=f"with l as (select id, unnest(string_split({VERDICT}, chr(10))) l from items), v as (select id, cast(regexp_extract(l, '^\\D{{0,3}}(\\d+)', 1) as int) n, lower(regexp_extract(l, '(?i)(yes|no)', 1)) = 'yes' yes from l where regexp_matches(l, '(?i)^\\D{{0,3}}\\d+\\s*[:.)-]\\s*\\**\\s*(yes|no)\\b')) select id, n, yes, null placed from v union all select id, null, null, case id % 4 when 0 then genus || '|' else '|unparsed' end from items union all select id, null, null, case id % 4 when 2 then 'x|' else '|unparsed' end from items")
def parse_verdicts(items):
    v = Q.parse_verdicts(items.select("id", F.expr(VERDICT).alias("text"))).withColumn("placed", F.lit(None).cast("string"))
    asked = items.select("id", F.col("gold_name").alias("name")).unionByName(items.select("id", F.col("grp").alias("name")))
    p = Q.parse_placements(items.select("id", F.expr(LISTED).alias("text")), asked)
    return v.unionByName(p.select("id", F.concat(F.coalesce("attr", F.lit("")), F.lit("|"), F.when(F.col("parsed"), "").otherwise("unparsed")).alias("placed")), allowMissingColumns=True)


TALKS = "tk as (select conv_id, turn, role, case when role = 'user' then '<sound> ' || text || ' Output the answer with one letter.' when turn % 4 = 1 then text || ' So <CONCLUSION>' || substr(text, 1, 20) || '</CONCLUSION> it is.' else text end as text from qa)"
NONSPACE = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query("answer_question_text", "qa", sql=f"with {TALKS}, g as (select conv_id, arg_min(text, turn) filter (where role = 'user') q, coalesce(string_agg(text, chr(10) order by turn) filter (where role <> 'user'), '') a from tk group by 1) select conv_id, {NONSPACE.format("split_part(replace(q, '<sound>', ''), 'Output the answer with', 1)")} question, case when regexp_matches(a, '(?s)<CONCLUSION>(.*?)</CONCLUSION>') then regexp_extract(a, '(?s)<CONCLUSION>(.*?)</CONCLUSION>', 1) else list_extract(string_split(regexp_replace({NONSPACE.format('a')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), -1) end answer from g")
def answer_question_text(qa):
    """Questions with a recording's mark and an instruction; a part of the answers states its conclusion."""
    return Q.conversation_pairs(qa.sparkSession.sql(f"with {TALKS} select * from tk".replace("from qa", "from {qa}"), qa=qa))


#: A vocabulary of the texts' own first words, alone, in twos with what stands between them, and with a bracket.
FIRST_WORDS = r"""nd as (select distinct coalesce(lang, 'none') attr, lower(split_part(text, ' ', 1)) as value, case when doc_id % 2 = 0 then split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) else split_part(text, ' ', 4) || ' (of ' || lang || ')' end leaf from text)"""
VOCAB = rf"""{FIRST_WORDS},
vn as (select attr, value, trim(regexp_replace(lower(split_part(n, '(', 1)), '[^a-z0-9 ]+', ' ', 'g')) as name from (select attr, value, unnest([value, leaf]) n from nd)),
vo as (select name, list_sort(list(distinct attr || '/' || value)) hits from vn where length(name) >= 3 and name not in ('sound', 'sounds', 'noise', 'other', 'generic', 'specific', 'surface', 'type', 'effect', 'background') group by 1)"""
#: All matches of all names, then from the left the longest that starts no earlier than the last one ended.
MATCHED = rf"""{VOCAB},
pc as (select doc_id id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g')), ' ') p from text),
mm as (select distinct len(string_split(name, ' ')) m from vo),
rn as (select id, i, m, array_to_string(p[i : i + m - 1], ' ') as name from (select id, p, unnest(range(1, len(p) + 1)) i from pc), mm where i + m - 1 <= len(p) and p[i] <> '' and p[i + m - 1] <> ''),
ht as materialized (select id, i, max(m) m, arg_max(name, m) as name from rn where name in (select name from vo) group by 1, 2),
kp(id, i, m, name) as (select id, min(i), arg_min(m, i), arg_min(name, i) from ht group by 1 union all select ht.id, min(ht.i), arg_min(ht.m, ht.i), arg_min(ht.name, ht.i) from kp join ht on ht.id = kp.id and ht.i >= kp.i + kp.m group by ht.id)"""


def _vocabulary(text):
    return Q.vocabulary(text.sparkSession.sql(f"with {FIRST_WORDS} select attr, value, leaf from nd".replace("from text", "from {text}"), text=text))


@query("vocabulary", "text", sql=f"with {VOCAB.strip()} select name, array_to_string(hits, ',') hits from vo")
def vocabulary(text):
    return _vocabulary(text).select("name", F.array_join(F.array_sort(F.transform("hits", lambda h: F.concat_ws("/", h["attr"], h["value"]))), ",").alias("hits"))


@query("vocabulary_match", "text", sql=f"with recursive {MATCHED.strip()} select id, i place, name from kp")
def vocabulary_match(text):
    return Q.vocabulary_match(text.select(F.col("doc_id").alias("id"), "text"), _vocabulary(text))


@query("asked_attributes", "text", sql=f"with recursive {MATCHED.strip()}, av as (select kp.id, split_part(unnest(hits), '/', 1) a from kp join vo using (name)) select doc_id id, coalesce((select string_agg(distinct a, ',' order by a) from av where av.id = text.doc_id), '') attrs from text")
def asked_attributes(text):
    """The attributes that each text names."""
    return Q.asked_attributes(text.select(F.col("doc_id").alias("id"), "text"), _vocabulary(text)).select("id", F.array_join("attrs", ",").alias("attrs"))


@query("render_form", "schema", sql="with s as (select attr, list(value order by value) vs, bool_or(multi) multi, cast(substr(attr, 7) as int) i from (select distinct * from schema) group by 1), l as (select i % 3 region, i, '- \"' || attr || '\"' || case when i % 2 = 0 then case when multi then ' [a LIST of such objects, one per thing you hear]' else '' end || case when i % 5 = 0 then ' (if any)' else '' end || ': ' || chr(123) || '\"is\": one of ' || array_to_string(vs, ' | ') || ', \"detail\": \"...\"' || chr(125) || case when i % 4 = 0 then ' -- detail = kind' else '' end else case when multi then ' [list ALL that apply]' else '' end || ': ' || array_to_string(vs, ' | ') end l from s) select region, string_agg(l, chr(10) order by i) as \"lines\" from l group by 1")
def render_form(schema):
    i = F.substring("attr", 7, 9).cast("int")
    f = schema.groupBy("attr").agg(F.array_sort(F.collect_set("value")).alias("values"), F.bool_or("multi").alias("multi"))
    return Q.render_form(f.select((i % 3).alias("region"), i.alias("ord"), F.col("attr").alias("name"), "values", "multi", (i % 2 == 0).alias("open"), F.when(i % 4 == 0, "kind").alias("hint"), F.when(i % 5 == 0, "if any").alias("na_hint")))


@query("attr_space", "schema", sql="select 'r' || cast(cast(substr(attr, 7) as int) % 2 as varchar) || '.' || attr attr, 'r' || cast(cast(substr(attr, 7) as int) % 2 as varchar) region, case when cast(substr(attr, 7) as int) % 3 = 0 then 'g10' else 'g3' end grid, case when cast(substr(attr, 7) as int) % 5 = 0 then 'local' else 'clip' end scope, bool_or(multi) multi, string_agg(distinct value, ',' order by value) \"values\" from schema group by schema.attr")
def attr_space(schema):
    i = F.substring("attr", 7, 9).cast("int")
    s = schema.select(F.concat(F.lit("r"), (i % 2).cast("string"), F.lit("."), "attr").alias("attr"), "value", F.col("value").alias("ord"), "multi", F.when(i % 3 == 0, "g10").otherwise("g3").alias("grid"), F.when(i % 5 == 0, "local").otherwise("clip").alias("scope"))
    return Q.attr_space(s).withColumn("values", F.array_join("values", ","))


@query("proposal_batches", "label_rows", sql="with l as (select attr, value, leaf, count(distinct clip) clips from label_rows group by 1,2,3), r as (select *, row_number() over (partition by attr, value order by leaf) r, count(*) over (partition by attr, value) n from l) select attr, value, case when n > 10 and r > floor(n / 2) then 2 else 1 end part, count(*) n, string_agg(leaf || ' (' || cast(clips as varchar) || ')', chr(10) order by leaf) as \"lines\" from r group by 1,2,3")
def proposal_batches(label_rows):
    return Q.proposal_batches(label_rows.groupBy("attr", "value", "leaf").agg(F.countDistinct("clip").alias("clips")), 10)


# names -------------------------------------------------------------------------------------------


LEAVES = "case id % 8 when 0 then gold_name || ' 7' when 1 then gold_name || ' and more' when 2 then 'Two_' || split_part(gold_name, ' ', 1) || '; x' when 3 then ' - ' || grp || chr(39) when 4 then 'Unsure' when 5 then null when 6 then split_part(gold_name, ' ', 1) || ' é/x' else 'N/A' end"
CLEAN = f"""
r as (select id, grp, {LEAVES} l from items),
x as (select *, regexp_replace(regexp_replace(regexp_replace(replace(string_split_regex(lower(coalesce(l, '')), ' and | with |[,;/]')[1], '_', ' '), '[^a-z'' -]', ' ', 'g'), '\\s+', ' ', 'g'), '^[ ''-]+|[ ''-]+$', '', 'g') x from r)
select id, case when l is null or x = '' or x in ('unsure', 'none', 'n a') or x = grp or regexp_matches(l, '[0-9]') or len(string_split(x, ' ')) > 4 then '' else x end as leaf from x"""


@query("clean_leaf", "items", sql=f"with {CLEAN.strip()}")
def clean_leaf(items):
    return items.select("id", X.clean_leaf(F.expr(LEAVES), F.col("grp")).alias("leaf"))


@query("stem_word", "qa", sql=f"with recursive w0 as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) w from qa), {STEMS} select w, s as stem from stems")
def stem_word(qa):
    return qa.select(F.explode(X.words(F.col("text"))).alias("w")).distinct().select("w", X.stem(F.col("w")).alias("stem"))


ADDED = ["music", "voices", "barking dogs", "of the announcements", "planes", "ruffled"]
NAMED = f"nm as (select id, gold_name || ' ' || {sql_list(ADDED)}[id % {len(ADDED)} + 1] as name from items)"


@query("norm_key", "items", sql=f"with recursive {NAMED}, k0 as (select id, name, list_filter(regexp_extract_all(lower(name), '[a-z]+'), lambda x: not list_contains({sql_list(X.FILLER)}, x)) ws from nm), k1 as (select id, name, case when len(ws) > 1 and list_contains({sql_list(X.TAIL)}, ws[len(ws)]) then ws[1:len(ws) - 1] else ws end ws from k0), w0 as (select distinct unnest(ws) w from k1), {STEMS}, u as (select id, unnest(ws) w from k1) select k1.id, coalesce(string_agg(s, ' ' order by s), any_value(name)) norm from k1 left join u on u.id = k1.id left join stems on stems.w = u.w group by 1")
def norm_key(items):
    name = F.concat("gold_name", F.lit(" "), F.get(F.array(*[F.lit(x) for x in ADDED]), (F.col("id") % len(ADDED)).cast("int")))
    return items.select("id", X.norm_key(name).alias("norm"))


FORMS = ["The {} dogs barking.", "some  {} cities,", "{} chatting", "a {} buses!", "{} sings in the wings", "An ox is {}"]
FORMED = f"nm as (select id, replace({sql_list(FORMS)}[id % {len(FORMS)} + 1], chr(123) || chr(125), gold_name) as name from items)"
TOKENS = f"tk as (select id, unnest(list_filter(string_split(regexp_replace(regexp_replace(trim(regexp_replace(lower(name), '\\s+', ' ', 'g')), '^[.,;:!?]+|[.,;:!?]+$', '', 'g'), '^(a|an|the|some|any)\\s+', ''), ' '), lambda t: t <> '')) t, unnest(range(1, 40)) i from nm), tg as (select id, i, case when regexp_matches(t, '[a-z][a-z][a-z]ing$') and length(t) > 5 then left(t, length(t) - 3) else t end g, t from tk where t is not null), td as (select id, i, case when g <> t and right(g, 1) = substr(g, length(g) - 1, 1) and contains('{X.DOUBLED}', right(g, 1)) then left(g, length(g) - 1) else g end g from tg)"


@query("guard_normalise", "items", sql=f"with {FORMED}, {TOKENS} select id, string_agg(case when length(g) > 3 then regexp_replace(g, '([a-z])(ies|es|s)$', '\\1') else g end, ' ' order by i) s from td group by 1")
def guard_normalise(items):
    form = F.get(F.array(*[F.lit(x) for x in FORMS]), (F.col("id") % len(FORMS)).cast("int"))
    return items.select("id", X.guard_normalise(F.replace(form, F.lit("{}"), F.col("gold_name"))).alias("s"))


# pairs of names that differ in a number, a denial or a side of an axis, or in nothing of these
PAIRS = [("fast {}", "slow {}"), ("{}", "no {}"), ("two {} in 3.5", "2 {} in 3.5"), ("soft {}", "quiet {}"), ("{}", "dark {}"), ("low-pitched high-volume {}", "low {}"), ("3/4 {}", "4/4 {}"), ("male {} ending", "{} woman"), ("{} at 2 and 3", "{} at 3 and 2"), ("absent-minded {}", "{} mind"), ("near {}", "far {} never")]
SIDES = "(values " + ", ".join(f"('{w}', '{s}')" for w, s in X.axis_sides().items()) + ") ax(w, p)"
NUMBERS = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in X.NUMBER_WORDS.items()) + "}"
PAIRED = "pr as (select id, " + ", ".join(f"replace({sql_list(x[i] for x in PAIRS)}[id % {len(PAIRS)} + 1], chr(123) || chr(125), lower(gold_name)) as {n}" for i, n in enumerate("ab")) + " from items)"
FEATURES = f"nm as (select id, 0 k, a as name from pr union all select id, 1, b from pr), tk as (select id, k, name, list_filter(string_split_regex(replace(name, '-', ' '), '\\s+'), lambda t: t <> '') ts from nm), nu as (select id, k, regexp_extract_all(list_aggregate(list_transform(ts, lambda t: coalesce(map_extract({NUMBERS}, t)[1], t)), 'string_agg', ' '), '[0-9]+(?:\\.[0-9]+)?') numbers, regexp_matches(name, '(?:^|[\\s-])({'|'.join(X.NEGATIONS)})(?:$|[\\s-])') negated from tk), po as (select distinct id, k, p from (select id, k, unnest(ts) t from tk) join {SIDES} on ax.w = t)"


def _pair(items):
    side = lambda i: F.replace(F.get(F.array(*[F.lit(x[i]) for x in PAIRS]), (F.col("id") % len(PAIRS)).cast("int")), F.lit("{}"), F.lower("gold_name"))
    return side(0), side(1)


@query("merge_features", "items", sql=f"with {PAIRED}, {FEATURES} select nu.id, array_to_string(numbers, ',') numbers, negated, coalesce(string_agg(p, ',' order by p), '') poles from nu left join po on po.id = nu.id and po.k = nu.k where nu.k = 0 group by all")
def merge_features(items):
    f = X.merge_features(_pair(items)[0])
    return items.select("id", F.array_join(f["numbers"], ",").alias("numbers"), f["negated"].alias("negated"), F.array_join(f["poles"], ",").alias("poles"))


@query("may_merge", "items", sql=f"with {PAIRED}, {FEATURES}, sd as (select id, k, split_part(p, ':', 1) x, string_agg(p, ',' order by p) s from po group by 1,2,3), cf as (select distinct a.id from sd a join sd b on a.id = b.id and a.x = b.x and a.k = 0 and b.k = 1 where a.s <> b.s) select a.id, case when a.numbers <> b.numbers then 'numeric' when a.negated <> b.negated then 'negation' when cf.id is not null then 'polarity' end why from nu a join nu b on a.id = b.id and a.k = 0 and b.k = 1 left join cf on cf.id = a.id")
def may_merge(items):
    return items.select("id", X.may_merge(*_pair(items)).alias("why"))


SOURCED = "case id % 6 when 0 then split_part(gold_name, ' ', 1) || ' barking' when 1 then gold_name || ' noises' when 2 then grp || ' / ' || split_part(gold_name, ' ', 2) || 's' when 3 then 'clear loud sounds' when 4 then 'heavy ' || split_part(gold_name, ' ', 1) || '-bees' else split_part(gold_name, ' ', 1) end"
TOKEN = f"sr as (select id, {SOURCED} s0 from items), tk as (select id, unnest(list_filter(string_split_regex(lower(s0), '[\\s,/-]+'), lambda t: t <> '' and t not like '%ing' and not list_contains({sql_list([*G.GENERIC, *X.SOUND_WORDS])}, t))) w from sr), k0 as (select id, s0, list_filter(regexp_extract_all(lower(s0), '[a-z]+'), lambda x: not list_contains({sql_list(X.FILLER)}, x)) ws from sr), k1 as (select id, s0, case when len(ws) > 1 and list_contains({sql_list(X.TAIL)}, ws[len(ws)]) then ws[1:len(ws) - 1] else ws end ws from k0), w0 as (select w from tk union select unnest(ws) from k1)"


@query("source_tokens", "items", sql=f"with recursive {TOKEN}, {STEMS}, tt as (select id, case when length(s) >= 4 and s like '%s' and s not like '%ss' then left(s, length(s) - 1) else s end t from tk join stems using (w)), g as (select id, list(distinct t) ts from tt group by 1), nk as (select k1.id, coalesce(string_agg(s, ' ' order by s), any_value(s0)) k from k1 left join (select id, unnest(ws) w from k1) u on u.id = k1.id left join stems on stems.w = u.w group by 1), z as (select nk.id, k, coalesce(ts, []) ts from nk left join g on g.id = nk.id) select a.id, array_to_string(list_sort(a.ts), ',') tokens, coalesce(len(list_intersect(a.ts, b.ts)) > 0 or contains(a.k, b.k) or contains(b.k, a.k), false) shared from z a left join z b on b.id = (a.id // 6) * 6 + 5")
def source_tokens(items):
    x = items.select("id", F.expr(SOURCED).alias("s"))
    j = x.join(x.select(F.col("id").alias("_o"), F.col("s").alias("t")).hint("merge"), F.expr("(id div 6) * 6 + 5 = _o"), "left")
    return j.select("id", F.array_join(F.array_sort(X.source_tokens(F.col("s"), G.GENERIC)), ",").alias("tokens"), F.coalesce(X.shares_source(F.col("s"), F.col("t"), G.GENERIC), F.lit(False)).alias("shared"))


SECOND = "case when w like '%ing' and length(w) >= 6 then left(w, length(w) - 3) when w like '%ed' and length(w) >= 5 then left(w, length(w) - 2) when w like '%es' and length(w) >= 5 then left(w, length(w) - 2) when w like '%s' and length(w) >= 4 then left(w, length(w) - 1) else w end"


@query("content_words", "qa", sql=f"with w as (select distinct conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) w from qa), k as (select * from w where not list_contains({sql_list(X.STOP)}, w)), a as (select conv_id, turn, string_agg(distinct substr(w, 1, 4), ',' order by substr(w, 1, 4)) ws from k where length(w) > 3 group by 1,2), s1 as (select conv_id, turn, {SECOND} w from k where length(w) > 2), s2 as (select conv_id, turn, case when length(w) > 3 and right(w, 1) = substr(w, length(w) - 1, 1) then left(w, length(w) - 1) else w end w from s1), s3 as (select conv_id, turn, case when length(w) > 3 and w like '%e' then left(w, length(w) - 1) else w end w from s2), s4 as (select distinct conv_id, turn, case when w like '%i' then left(w, length(w) - 1) || 'y' else w end w from s3), b as (select conv_id, turn, string_agg(w, ',' order by w) ws2 from s4 group by 1,2) select qa.conv_id, qa.turn, coalesce(ws, '') ws, coalesce(ws2, '') ws2 from qa left join a on a.conv_id = qa.conv_id and a.turn = qa.turn left join b on b.conv_id = qa.conv_id and b.turn = qa.turn")
def content_words(qa):
    t = F.col("text")
    return qa.select("conv_id", "turn", F.array_join(X.content_words(t), ",").alias("ws"), F.array_join(X.class_words(t), ",").alias("ws2"))


@query("light_canon", "items", sql="with n as (select genus, lower(gold_name) leaf, count(*) clips from items group by 1,2) select genus, leaf, first_value(leaf) over (partition by genus, substr(leaf, 1, 4) order by clips desc, leaf) canon from n")
def light_canon(items):
    n = items.groupBy("genus", F.lower("gold_name").alias("leaf")).agg(F.count("*").alias("clips"))
    return E.light_canon(n, F.substring("leaf", 1, 4), ("genus",))


# leaves of a class: pairs that are one but for an ending or a word of the class
IN_CLASS = "select grp, lower(case id % 4 when 0 then gold_name when 1 then gold_name || 's' when 2 then grp || ' ' || split_part(gold_name, ' ', 1) else split_part(gold_name, ' ', 1) || 'ing' end) leaf from items"


@query("in_class_merge", "items", sql=f"with n as (select grp, leaf, count(*) clips from ({IN_CLASS}) group by 1,2), w as (select distinct grp, leaf, unnest(regexp_extract_all(leaf, '[a-z]+')) w from n), c as (select distinct grp, unnest(regexp_extract_all(lower(grp), '[a-z]+')) w from n), x as (select grp, leaf, w from w union all select grp, null, w from c), k as (select * from x where length(w) > 2 and not list_contains({sql_list(X.STOP)}, w)), s1 as (select grp, leaf, {SECOND} w from k), s2 as (select grp, leaf, case when length(w) > 3 and right(w, 1) = substr(w, length(w) - 1, 1) then left(w, length(w) - 1) else w end w from s1), s3 as (select grp, leaf, case when length(w) > 3 and w like '%e' then left(w, length(w) - 1) else w end w from s2), s4 as (select distinct grp, leaf, case when w like '%i' then left(w, length(w) - 1) || 'y' else w end w from s3), r as (select a.grp, a.leaf, string_agg(a.w, ' ' order by a.w) k from s4 a where a.leaf is not null and not exists (select 1 from s4 b where b.leaf is null and b.grp = a.grp and b.w = a.w) group by 1,2) select n.grp, n.leaf, case when k is null then n.leaf else first_value(n.leaf) over (partition by n.grp, k order by clips desc, n.leaf) end canon from n left join r on r.grp = n.grp and r.leaf = n.leaf")
def in_class_merge(items):
    n = items.select(F.expr("grp"), F.expr("lower(case id % 4 when 0 then gold_name when 1 then gold_name || 's' when 2 then grp || ' ' || split_part(gold_name, ' ', 1) else split_part(gold_name, ' ', 1) || 'ing' end)").alias("leaf"))
    return E.in_class_merge(n.groupBy("grp", "leaf").agg(F.count("*").alias("clips")), X.class_words(F.col("leaf")), X.class_words(F.col("grp")), ("grp",))


# leaves of one to four words; the shorter ones generalise the longer
NESTED = "select distinct genus, leaf from (select genus, lower(gold_name) leaf from items union all select genus, split_part(lower(gold_name), ' ', 2) from items where id % 3 = 0 union all select genus, lower(gold_name) || ' ' || grp from items where id % 2 = 0 union all select genus, grp || ' ' || split_part(lower(gold_name), ' ', 1) || ' review' from items where id % 5 = 0 union all select genus, grp from items where id % 7 = 0)"


@query("generic_links", "items", sql=f"with n as (select genus, leaf, list_distinct(string_split(leaf, ' ')) w from ({NESTED})), p as (select a.genus, a.leaf, b.leaf generic, len(b.w) k, a.w from n a join n b on a.genus = b.genus and len(b.w) < len(a.w) and len(list_filter(b.w, lambda t: not list_contains(a.w, t))) = 0) select genus, leaf, arg_min(generic, (-k, generic)) generic from p where not list_contains({sql_list(E.ABOUT)}, string_split(leaf, ' ')[-1]) group by 1,2")
def generic_links(items):
    return E.generic_links(items.sparkSession.sql(f"select * from ({NESTED.replace('from items', 'from {items}')})", items=items), ("genus",))


@query("synonym_merge", "vectors")
def synonym_merge(vectors):
    from ..operators.vectors import l2_normalise

    n = vectors.select((F.col("label") % 3).alias("grp"), F.concat(F.lit("name "), F.translate(F.col("vec_id").cast("string"), "0123456789", "abcdefghij")).alias("name"), (F.col("vec_id") % 17).alias("support"), l2_normalise(F.col("embedding")).alias("x"))
    return E.synonym_merge(n, ("grp",), 0.3, 0.3)


# folds: one word more than a sibling; on the identity class only a filler; linked specifics elsewhere
FOLD_LINKS = "select distinct genus, lower(gold_name) leaf, grp generic from items where id % 3 = 0 and genus <> 'Brand#11'"


@query("rule_folds", "items", sql=f"with n as (select genus, leaf, list_sort(list_distinct(string_split(leaf, ' '))) w from ({NESTED} union select distinct genus, lower(gold_name) || ' style' from items where id % 2 = 0)), d as (select genus, leaf, w, unnest(w) x from n where len(w) > 1), r as (select d.genus, d.leaf, d.x, b.leaf base from d join n b on b.genus = d.genus and b.leaf <> d.leaf and b.w = list_filter(d.w, lambda t: t <> d.x) where d.genus <> 'Brand#11' or list_contains({sql_list(X.FOLD_FILLER)}, d.x)), f as (select genus, leaf, arg_min(base, (list_position(string_split(leaf, ' '), x), base)) t, 0 k from r group by 1,2), l as (select genus, leaf, generic t, 1 k from ({FOLD_LINKS}) q where not exists (select 1 from f where f.genus = q.genus and f.leaf = q.leaf)), a as (select * from f union all select * from l), c(genus, leaf, t, i) as (select genus, leaf, t, 0 from a union all select c.genus, c.leaf, a.t, i + 1 from c join a on a.genus = c.genus and a.leaf = c.t where i < 10) select genus, leaf, arg_max(t, i) into_ from c group by 1,2".replace("with n as", "with recursive n as"))
def rule_folds(items):
    spark = items.sparkSession
    put = lambda q: spark.sql(f"select * from ({q.replace('from items', 'from {items}')})", items=items)
    names = put(f"{NESTED} union select distinct genus, lower(gold_name) || ' style' from items where id % 2 = 0")
    return E.rule_folds(names, X.FOLD_FILLER, ("genus",), F.col("genus") == "Brand#11", put(FOLD_LINKS)).withColumnRenamed("into", "into_")


# proposals of groups: name and members, some unknown, some that may not be one with the name, some that are generic-link nodes, some in two groups
GROUPS = "select quality % 20 grp_no, genus, case when id % 11 = 0 then 'no ' || grp when id % 13 = 0 then 'unheard of' else grp end member, grp nm, id from items"
PROPOSED = f"pg as (select genus, grp_no, member, min(nm) over (partition by genus, grp_no) nm from ({GROUPS}) g), kn as (select genus, grp leaf, count(*) clips from items group by 1,2 union all select genus, 'no ' || grp, 1 from items where id % 11 = 0 group by 1,2), lk as (select distinct genus, grp leaf from items where id % 17 = 0)"


@query("proposal_guards", "items", sql=f"with {PROPOSED}, m as (select distinct pg.genus, grp_no, member, nm, kn.clips from pg join kn on kn.genus = pg.genus and kn.leaf = pg.member where exists (select 1 from kn z where z.genus = pg.genus and z.leaf = pg.nm)), n as (select * from m union select m.genus, grp_no, nm, nm, kn.clips from m join kn on kn.genus = m.genus and kn.leaf = nm), g as (select * from n where (member like 'no %') = (nm like 'no %')), h as (select g.*, count(*) over (partition by genus, grp_no) k from g), u as (select * from h where k >= 2), v as (select u.* from u where member = nm or not exists (select 1 from lk where lk.genus = u.genus and lk.leaf = u.member)), s as (select *, sum(clips) over (partition by genus, grp_no) mass, count(*) over (partition by genus, grp_no) k2 from v), r as (select *, row_number() over (partition by genus, member order by mass desc, grp_no) r from s where k2 >= 2), w as (select * from r where r = 1), x as (select *, count(*) over (partition by genus, grp_no) k3, max(case when member = nm then 1 else 0 end) over (partition by genus, grp_no) own from w) select genus, grp_no, nm canon, member leaf from x where k3 >= 2 and own = 1")
def proposal_guards(items):
    spark = items.sparkSession
    put = lambda q: spark.sql(q.replace("from items", "from {items}"), items=items)
    from pyspark.sql import Window as W

    g = put(GROUPS).select("genus", F.col("grp_no").alias("group_id"), F.min("nm").over(W.partitionBy("genus", "grp_no")).alias("canon"), F.col("member").alias("leaf")).distinct()
    names = put("select genus, grp leaf, count(*) clips from items group by 1, 2 union all select genus, 'no ' || grp, 1 from items where id % 11 = 0 group by 1, 2")
    links = put("select distinct genus, grp leaf from items where id % 17 = 0")
    return E.proposal_guards(g, names, X.may_merge(F.col("leaf"), F.col("canon")), ("genus",), links).withColumnRenamed("group_id", "grp_no")


@query("apply_table", "items", sql=f"with {PROPOSED}, g as (select distinct genus, grp_no, member, nm from pg where member <> nm), s as (select *, case grp_no % 4 when 0 then -0.1 when 1 then null else 0.2 end sep, genus <> 'Brand#11' judged from g) select genus, member leaf, min(nm) to_leaf from s where not judged or sep > 0 group by 1,2")
def apply_table(items):
    from pyspark.sql import Window as W

    g = items.sparkSession.sql(GROUPS.replace("from items", "from {items}"), items=items)
    g = g.select("genus", F.col("grp_no").alias("group_id"), F.min("nm").over(W.partitionBy("genus", "grp_no")).alias("canon"), F.col("member").alias("leaf")).distinct()
    flags = g.select("genus", "group_id").distinct().withColumn("separation", F.when(F.col("group_id") % 4 == 0, -0.1).when(F.col("group_id") % 4 > 1, 0.2))
    none = g.filter("1 = 0").select("genus", "leaf", F.col("canon").alias("into"))
    return E.apply_table(g, flags, none, ("genus",), F.col("genus") != "Brand#11")


PLACES = "select id, gold_name as name, case id % 7 when 0 then 'drop' when 1 then 'elsewhere' else genus end attr, case when id % 5 = 0 then null else grp end val, case when id % 6 = 0 then upper(gold_name) end new_value, case id % 4 when 0 then split_part(gold_name, ' ', 2) || ' x' when 1 then 'zz ' || grp when 2 then 'nowhere' end same_as, quality % 2 > 0 yes from items"


@query("placement_checks", "items", sql=f"with p as ({PLACES}), t as (select distinct 'zz ' || grp as name, genus attr, grp val from items where id % 2 = 0), t1 as (select name, min(attr) attr, min(val) val from t group by 1), q as (select p.id, p.attr, p.same_as, p.yes, coalesce(lower(new_value), p.val) v, t1.attr ta, t1.val tv, exists (select 1 from (select unnest(regexp_extract_all(lower(p.name), '[a-z]+')) a) x join (select unnest(regexp_extract_all(lower(p.same_as), '[a-z]+')) b) y on substr(a, 1, 4) = substr(b, 1, 4) where length(a) > 3 and length(b) > 3 and not list_contains({sql_list(X.STOP)}, a) and not list_contains({sql_list(X.STOP)}, b)) ov from p left join t1 on t1.name = same_as) select id, case when id % 9 = 0 then 'generic' when attr = 'drop' then 'drop' when attr not like 'Brand#%' or v is null then 'unresolved' when not yes then 'removed' else 'placed' end verdict, case when id % 9 > 0 and attr like 'Brand#%' and v is not null and same_as is not null and yes and ov and ta is not null and not (ta = attr and tv = v) then ta || '/' || tv when id % 9 > 0 and attr like 'Brand#%' and v is not null and yes then attr || '/' || v end place, case when id % 9 > 0 and attr like 'Brand#%' and v is not null and yes and same_as is not null and ((ta = attr and tv = v) or ov) then same_as end merged from q")
def placement_checks(items):
    spark = items.sparkSession
    p = spark.sql(PLACES.replace("from items", "from {items}"), items=items).withColumnRenamed("val", "value")
    known = items.filter("id % 2 = 0").groupBy(F.concat(F.lit("zz "), "grp").alias("name")).agg(F.min("genus").alias("attr"), F.min("grp").alias("value"))
    v = E.placement_checks(p, p.filter("attr like 'Brand#%'").select("attr").distinct(), p.filter("id % 9 = 0").select("id"), known, ["drop"])
    return v.select("id", "verdict", F.when(F.col("verdict") == "placed", F.concat_ws("/", "attr", "value")).alias("place"), F.when(F.col("verdict") == "placed", F.col("same_as")).alias("merged"))


FINAL = "case id % 5 when 0 then 'analysis (c) final the answer: (B).' when 1 then '(d) final none' when 2 then 'a or b' when 3 then 'final (a) final: k, not ' || gold_name else 'final answer ' || grp || ' (x) C' end"


@query("parse_final_letter", "items", sql=f"with t as (select id, regexp_extract_all(string_split({FINAL}, 'final')[-1], '\\(([a-kA-K])\\)|\\b([a-kA-K])\\b') f from items) select id, coalesce(lower(regexp_replace(f[-1], '[()]', '', 'g')), 'a') letter from t")
def parse_final_letter(items):
    return items.select("id", X.final_letter(F.expr(FINAL)).alias("letter"))


# answers that meet one rule after the other; options a: genus, b: name, c: class, d: a fixed text
FREE = "case id % 11 when 0 then 'It is (C), not (a).' when 1 then ' b) ' || grp when 2 then gold_name || '!' when 3 then 'so it is: c. ' || genus when 4 then 'surely ' || grp || ' I think' when 5 then 'maybe a or b' when 6 then 'not a ' || split_part(grp, ' ', 1) || ' one' when 7 then '<think>(a)</think><Conclusion> (B) <br></Conclusion> (d)' when 8 then 'e.' when 9 then 'zz9' else 'other' end"
NORMED = "lower(trim(regexp_replace(lower({}), '[^a-z0-9 ]', '', 'g')))"
LETTER = f"""
o as (select id, 'a' k, {NORMED.format("genus")} t from items union all select id, 'b', {NORMED.format("gold_name")} from items union all select id, 'c', {NORMED.format("grp")} from items union all select id, 'd', 'an other thing' from items),
r as (select id, case when regexp_matches({FREE}, '(?i)<conclu[^>]*>') then regexp_extract({FREE}, '(?is)<Conclu[^>]*>(.*?)(?:</Conclu|$)', 1) else {FREE} end x from items),
c as (select id, regexp_replace(trim(x), '<[^>]+>', ' ', 'g') c from r),
n as (select id, c, {NORMED.format("c")} n from c),
m as (select n.id, c, n, min(k) filter (where t <> '' and n = t) same, min(k) filter (where t <> '' and length(n) >= 3 and (contains(n, t) or contains(t, n))) part, arg_min(k, (-len(list_intersect(list_distinct(string_split(n, ' ')), string_split(t, ' '))), k)) mk, max(len(list_intersect(list_distinct(string_split(n, ' ')), list_filter(string_split(t, ' '), lambda w: w <> '')))) mn from n join o on o.id = n.id group by 1,2,3)
select id, coalesce(nullif(lower(regexp_extract(c, '\\(([a-dA-D])\\)', 1)), ''), nullif(lower(regexp_extract(c, '^\\s*([a-dA-D])(?:[.):]|\\s*$)', 1)), ''), same, nullif(lower(regexp_extract(c, '(?:^|[^a-zA-Z])([a-dA-D])[.):]', 1)), ''), part, lower(regexp_extract_all(c, '(?:^|[^a-zA-Z])([a-dA-D])(?:[^a-zA-Z]|$)', 1)[-1]), case when mn > 0 then mk end) letter from m"""


@query("extract_letter", "items", sql=f"with {LETTER.strip()}")
def extract_letter(items):
    options = F.create_map(F.lit("a"), X.choice_norm(F.col("genus")), F.lit("b"), X.choice_norm(F.col("gold_name")), F.lit("c"), X.choice_norm(F.col("grp")), F.lit("d"), F.lit("an other thing"))
    return items.select("id", X.extract_letter(F.expr(FREE), options).alias("letter"))


MARKED = "case id % 4 when 0 then '<|0.50|> ' || gold_name || '<|2.25|>' || grp || ' <|4.00|>' when 1 then '<|en|> ' || gold_name when 2 then '<|28.40|>a <|nospeech|> b<|31.06|>  ' else '  ' end"


@query("transcript_segments", "items", sql="select id, id % 3 \"window\", start, text, concat('[', cast((cast(id % 3 * 30 + start as double)::int - case when id % 3 * 30 + start < cast(id % 3 * 30 + start as double)::int then 1 else 0 end) // 60 as varchar), ':', printf('%04.1f', (id % 3 * 30 + start) % 60), '] ', text) line from (select id, 0.5::double start, gold_name text from items where id % 4 = 0 union all select id, 2.25, grp from items where id % 4 = 0 union all select id, 0.0, gold_name from items where id % 4 = 1 union all select id, 28.4, 'a   b' from items where id % 4 = 2)")
def transcript_segments(items):
    x = items.select("id", (F.col("id") % 3).alias("window"), F.inline(X.transcript_segments(F.expr(MARKED))))
    return x.withColumn("line", X.timed_line(F.col("window") * 30 + F.col("start"), F.col("text")))


@query("strip_timestamps", "items", sql="select id, lower(gold_name) || ' ' || grp s from items")
def strip_timestamps(items):
    return items.select("id", X.strip_timestamps(F.concat(F.lit("[0:01.0] "), "gold_name", F.lit(" [0:02.5]\n"), "grp")).alias("s"))


@query("tempo_word", "items", sql="select id, case when id % 4 = 0 then null when quality * 5 < 80 then 'slow' when quality * 5 < 120 then 'moderate' when quality * 5 < 160 then 'fast' else 'very fast' end w from items")
def tempo_word(items):
    return items.select("id", X.tempo_word(F.col("quality") * 5, F.when(F.col("id") % 4 == 0, 0.1).otherwise(0.9)).alias("w"))


ASKED = ["", "What is heard from 2.9 to 4.3?", "between 1:10 and 1:02", "Which sound ends it, 3-9 sec in?", "In the first 5 seconds?", "Which comes last at the end?", "How many bells ring?", "What chord follows the note?", "Which is the longest event?", "Is it absent before the horn?", "Who said it?", "from 0 to 9000", "in what order do they occur?", "What plays at the very end?", "how long is it"]
GATES = f"""
q as (select conv_id, turn, text || ' ' || {sql_list(ASKED)}[(conv_id + turn) % {len(ASKED)} + 1] q from qa),
e as (select *, case when regexp_matches(q, '{X.TIME_SPAN}') then [regexp_extract(q, '{X.TIME_SPAN}', 1), regexp_extract(q, '{X.TIME_SPAN}', 2)] when regexp_matches(q, '{X.TIME_BARE}') then [regexp_extract(q, '{X.TIME_BARE}', 1), regexp_extract(q, '{X.TIME_BARE}', 2)] end e from q),
s as (select *, list_transform(e, lambda t: case when contains(t, ':') then try_cast(split_part(t, ':', 1) as double) * 60 + try_cast(split_part(t, ':', 2) as double) else try_cast(t as double) end) s from e),
t as (select *, coalesce(s[2] > s[1] and s[2] - s[1] <= {X.LONGEST_SPAN}, false) or regexp_matches(q, '{X.TIME_EDGE}') or regexp_matches(q, '{X.POSITION}') as tm, regexp_matches(q, '{X.COUNTING}') cn from s),
v as (select *, tm or cn or regexp_matches(q, '{X.TEMPORAL}') or regexp_matches(q, '{X.EVENTS.replace("'", "''")}') ev from t)
select conv_id, turn, tm "time", ev as event, ev and not regexp_matches(q, '{X.NOT_EVENTS}') timeline, regexp_matches(q, '{X.DURATIONS}') duration, regexp_matches(q, '{X.ORDERING}') "order", cn "count" from v"""


@query("question_gates", "qa", sql=f"with {GATES.strip()}")
def question_gates(qa):
    asked = F.get(F.array(*[F.lit(x) for x in ASKED]), ((F.col("conv_id") + F.col("turn")) % len(ASKED)).cast("int"))
    return qa.select("conv_id", "turn", F.inline(F.array(X.question_gates(F.concat("text", F.lit(" "), asked)))))


RULES = [("metal", "steel", r"\bsteel\b", "first"), ("metal", "brass", r"\bbrass\b", "first"), ("tone", "bright", "^(al|go)", "most"), ("tone", "dark", "(um|ue)$", "most"), ("form", "long", "^.{6,}$", "all")]


@query("aspect_rules", "tags", sql="with a as (select item id, 1 o, tag1 a from tags union all select item, 2, tag2 from tags), h as (select id, 'metal' attr, case when a = 'steel' then 'steel' when a = 'brass' then 'brass' end cls, case when a = 'steel' then 0 else 1 end no, 0 n from a where a in ('steel', 'brass')), t as (select id, 'tone' attr, cls, count(*) n, min(o) o, min(no) no from (select id, o, 'bright' cls, 2 no from a where a like 'al%' or a like 'go%' union all select id, o, 'dark', 3 from a where a like '%um' or a like '%ue') group by 1,2,3) select distinct id, 'form' attr, 'long' cls from a where length(a) >= 6 union all select id, attr, arg_min(cls, no) from h group by 1,2 union all select id, attr, arg_min(cls, (-n, o, no)) from t group by 1,2")
def aspect_rules(tags):
    a = tags.select(F.col("item").alias("id"), F.lit(1).alias("ord"), F.col("tag1").alias("aspect")).unionByName(tags.select(F.col("item").alias("id"), F.lit(2).alias("ord"), F.col("tag2").alias("aspect")))
    return Q.aspect_rules(a, RULES)


@query("align_external_labels", "tags", sql="select distinct item, tag1 as value, tag2 as leaf from tags where item % 2 = 0 union select item, upper(tag1), '' from tags where item % 2 = 1")
def align_external_labels(tags):
    nodes = tags.select(F.concat_ws("/", "tag1", "tag2").alias("name"), F.col("tag1").alias("value"), F.col("tag2").alias("leaf")).distinct()
    classes = tags.select(F.col("tag1").alias("category"), F.upper("tag1").alias("value")).distinct()
    return Q.align_external(tags.filter("item % 2 = 0").select("item", F.concat_ws("/", "tag1", "tag2").alias("name")), tags.filter("item % 2 = 1").select("item", F.col("tag1").alias("category")), nodes, classes)


@query("clean_labels", "label_rows", sql="with s as (select attr, value, leaf, count(distinct clip) n from label_rows group by 1,2,3), c as (select row_id, l.attr, l.value, case when n >= 2 then l.leaf else '' end as leaf from label_rows l join s on l.attr = s.attr and l.value = s.value and l.leaf = s.leaf) select distinct * from c union select c.row_id, c.attr, c.value, substr(c.leaf, 1, length(c.leaf) - 2) from c where regexp_matches(c.leaf, ' [a-z]$') and exists (select 1 from s where s.attr = c.attr and s.value = c.value and s.leaf = substr(c.leaf, 1, length(c.leaf) - 2) and n >= 2)")
def clean_labels(label_rows):
    from ..operators.tree import clean_labels as op

    n = cut(label_rows.groupBy("attr", "value", "leaf").agg(F.countDistinct("clip").alias("n")))
    links = n.filter("leaf rlike ' [a-z]$'").select("attr", "value", "leaf", F.regexp_replace("leaf", " [a-z]$", "").alias("generic"))
    canon = n.filter("1 = 0").select("attr", "value", "leaf", F.col("leaf").alias("to_leaf"))
    return op(label_rows, canon, n.filter("n >= 2"), links)


@query("domain_head", "vectors")
def domain_head(vectors):
    return H.domain_head(vectors, 16, 9, F.col("vec_id") % 5 == 0)


#: Aspects made of the rules' own words, in pairs that parts choose.
SPOKEN_OF = [w.replace("s?", "s").replace("(?! drum)", "") for rules in (A.INSTRUMENT, A.MOOD, A.PRODUCTION, A.FIDELITY, A.VOCAL_STYLE) for _, ws in rules for w in ws]
SINGERS = ["male vocal", "female voice", "rap", "choir singing", "no vocals", "duet", "soft female vocals", "instrumental", "a man talking", "bass drum"]


def aspects_of(items):
    word = lambda n, ws: F.element_at(F.array(*[F.lit(w) for w in ws]), (F.col("id") * n % len(ws) + 1).cast("int"))
    some = F.array(word(7, SPOKEN_OF), F.concat(F.lit(" Warm "), word(13, SPOKEN_OF), F.lit(" sound")), F.when(F.col("id") % 3 > 0, word(3, SINGERS)), F.concat(word(29, SPOKEN_OF), F.lit("-like")), F.when(F.col("id") % 5 == 0, word(11, SINGERS)))
    return items.select("id", F.posexplode(F.array_compact(some)).alias("ord", "aspect"))


@query("music_labels", "items")
def music_labels(items):
    """Compared with a plain loop over the rules in the tests: one pattern looks ahead, which not every SQL can."""
    return Q.music_labels(aspects_of(items))


# learned columns and streams ---------------------------------------------------------------------


@query("language_head", "text")
def language_head(text):
    t = text.select(F.col("doc_id").alias("id"), "text", "lang")
    return H.language_head(t, F.col("id") % 7 == 0)[0]


@query("question_head", "vectors")
def question_head(vectors):
    """Two questions on each vector, the second too rare to be learnt; whole splits are held out."""
    t = vectors.select("vec_id", F.inline(F.array(*[F.struct(F.lit(a).alias("attr"), y.cast("int").alias("y")) for a, y in (("low", F.col("label") < 3), ("odd", F.col("label") % 2 == 1), ("rare", F.col("vec_id") < 5))])))
    return H.question_heads(vectors, t, F.col("vec_id") % 5 == 0)


@query("property_heads", "vectors")
def property_heads(vectors):
    f = vectors.select("vec_id", F.inline(F.array(F.struct(F.lit("label").alias("field"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("value")), F.struct(F.lit("half").alias("field"), F.when(F.col("label") < 5, "low").otherwise("high").alias("value")))))
    return H.property_heads(vectors, f, F.col("vec_id") % 5 == 0)


@query("router_heads", "vectors")
def router_heads(vectors):
    """Classes of two leaves; some rows name the class only, some nothing."""
    leaf = F.when(F.col("vec_id") % 7 == 1, F.lit("")).otherwise(F.concat(F.lit("leaf "), (F.col("label") % 2).cast("string")))
    t = vectors.select("vec_id", F.when(F.col("vec_id") % 11 == 2, F.lit(None)).otherwise(F.concat(F.lit("class "), F.floor(F.col("label") / 2).cast("string"))).alias("value"), leaf.alias("leaf"))
    return H.router_head(vectors, t, F.col("vec_id") % 10 == 0)


@query("batch_embed", "text", sql="select doc_id row_id, true unit, true short from text where doc_id % 2 = 1")
def batch_embed(text):
    """The stand-in for a model tells how many texts its batch had, and how many sources they came from."""
    rows = text.select(F.col("doc_id").alias("row_id"), F.concat_ws("|", F.coalesce("source", F.lit("?")), "text").alias("text"), "source")

    def sizes(batch):
        if len(sources := {t.split("|")[0] for t in batch}) > 1:
            raise ValueError(f"a batch mixes {sources}")
        return [[float(len(sources)), float(len(batch))] for _ in batch]

    x = R.upsert_features(rows, rows.filter("row_id % 2 = 0").select("row_id"), sizes, apart=("source",), most=16)
    return x.select("row_id", (F.abs(x["x"][0] * x["x"][0] + x["x"][1] * x["x"][1] - 1) < 1e-4).alias("unit"), (x["x"][1] <= 16 * x["x"][0] * 1.0001).alias("short"))


@query("feature_store_upsert", "text", sql="with v as (select doc_id, doc_id % 3 s, length(text)::double a, 1 + doc_id % 4 b from text) select doc_id::varchar row_id, 'long' encoder, round(a / sqrt(a * a + 1), 4) x0, round(1 / sqrt(a * a + 1), 4) x1 from v where s <> 2 union all select doc_id::varchar, 'flat', round(1 / sqrt(1 + b * b), 4), round(b / sqrt(1 + b * b), 4) from v union all select doc_id::varchar, 'replaced', 0.6, 0.8 from v where s = 0")
def feature_store(text):
    """Two encoders over sets of rows: a first part, then all (those that are there aren't embedded again), and a set that is replaced; read back in the order asked for."""
    spark = text.sparkSession
    store = FeatureStore(spark, _folder(spark, "features"), f"features_{uuid.uuid4().hex[:8]}", buckets=8)
    rows = text.select(F.col("doc_id").cast("string").alias("row_id"), F.concat_ws(" ", F.col("doc_id").cast("string"), "text").alias("text"), "doc_id")
    long = lambda batch: [[float(len(t.split(" ", 1)[1])), 1.0] for t in batch]
    flat = lambda batch: [[1.0, 1.0 + int(t.split(" ", 1)[0]) % 4] for t in batch]
    first = rows.filter("doc_id % 3 = 0")
    store.upsert(first, "long", "some", long)
    store.upsert(rows.filter("doc_id % 3 != 2"), "long", "some", long)
    store.upsert(first, "replaced", "some", long)
    store.upsert(rows, "flat", "all", flat)
    store.replace(first.select("row_id", F.array(F.lit(0.6), F.lit(0.8)).alias("x")), "replaced", "some")
    asked = rows.select("row_id", F.col("doc_id").alias("ord"))
    parts = [store.read(asked, e, s).select("row_id", F.lit(e).alias("encoder"), F.round(F.col("x")[0].cast("double"), 4).alias("x0"), F.round(F.col("x")[1].cast("double"), 4).alias("x1")) for e, s in (("long", "some"), ("flat", "all"), ("replaced", "some"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("x0 is not null")


@query("stream_label_ingest", "label_rows", sql="select distinct row_id, attr, value, leaf, tool from label_rows where clip in (select clip from label_rows where clip % 3 > 0)")
def stream_label_ingest(label_rows):
    spark, at = label_rows.sparkSession, _shards(label_rows)
    sink = _folder(spark, "ingested")
    J.label_ingest(spark, f"{at}/*", R.RECORD, sink, _folder(spark, "ingest-state")).awaitTermination()
    return spark.read.schema(R.RECORD).parquet(f"{sink}/*").select("row_id", "attr", "value", "leaf", "tool")


@query("stream_segment_events", "frames", sql=f"with {SEG} select clip, label, round(t0, 4) t0, round(t1, 4) t1, round(peak, 6) peak from events_")
def stream_segment_events(frames):
    """All events of the stream: a last row with a later time stamp closes those that are open."""
    spark, at = frames.sparkSession, _folder(frames.sparkSession, "frames")
    f = frames.select(F.col("clip").cast("long").alias("clip"), "label", F.col("t").cast("int").alias("t"), F.timestamp_millis(F.col("t") * 100 + 10**12).alias("ts"), F.col("p").cast("double").alias("p"))
    f.write.parquet(at)
    last = f.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).select(F.lit(-1).cast("long").alias("clip"), F.lit("").alias("label"), F.lit(0).alias("t"), "ts", F.lit(None).cast("double").alias("p"))
    last.write.mode("append").parquet(at)
    s = J.segment_stream(spark.readStream.schema(f.schema).parquet(at), 0.3, 0.15)
    sink = _folder(spark, "segments")
    with J.state_store(spark):
        q = s.writeStream.format("parquet").option("checkpointLocation", _folder(spark, "segments-state")).trigger(availableNow=True).start(sink)
    q.awaitTermination()
    out = spark.read.schema(s.schema).parquet(sink)
    return out.select("clip", "label", F.round("t0", 4).alias("t0"), F.round("t1", 4).alias("t1"), F.round("peak", 6).alias("peak"))


@query("stream_event_sessions", "events", sql="with f as (select user_id clip, event_type label, ts, least(value / 100, 1.0) p from events where least(value / 100, 1.0) >= 0.3), g as (select *, case when ts - lag(ts) over w < interval 10 minute then 0 else 1 end b from f window w as (partition by clip, label order by ts)), s as (select *, sum(b) over (partition by clip, label order by ts rows unbounded preceding) i from g) select clip, label, count(*) n, round(max(p), 6) peak from s group by clip, label, i")
def stream_event_sessions(events):
    """Sessions of loud frames, all of them: a last row closes those that are open."""
    spark, at = events.sparkSession, _folder(events.sparkSession, "frames")
    f = events.select(F.col("user_id").alias("clip"), F.col("event_type").alias("label"), F.col("ts").cast("timestamp").alias("ts"), F.least(F.col("value") / 100, F.lit(1.0)).alias("p"))
    last = f.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).select(F.lit(-1).cast(dict(f.dtypes)["clip"]).alias("clip"), F.lit("").alias("label"), "ts", F.lit(1.0).alias("p"))
    f.write.parquet(at)
    last.write.mode("append").parquet(at)
    s = J.event_sessions(spark.readStream.schema(f.schema).parquet(at), 0.3, "10 minutes", "1 hour")
    sink = _folder(spark, "sessions")
    s.writeStream.format("parquet").option("checkpointLocation", _folder(spark, "sessions-state")).trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.schema(s.schema).parquet(sink).select("clip", "label", "n", F.round("peak", 6).alias("peak"))

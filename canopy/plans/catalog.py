"""Registry of queries: an operator applied to whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as X
from ..workers import reachable

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Derived input tables, in SQL that Spark and other engines read alike; {STR} is the string type, {elem} the element function.
FIXTURES = {
    "clips": "select substr(md5(cast(doc_id as {STR})),1,16) clip, concat('audio/',cast(doc_id as {STR}),'.wav') audio_path, source, lang, least(cast(n_chars as double)/100, 90) dur_s from {documents}",
    "label_rows": "select concat(cast(l_orderkey as {STR}),':',cast(l_linenumber as {STR})) row_id, l_orderkey clip, l_suppkey % 7 source, p_brand attr, lower(p_type) value, case when l_orderkey % 2 = 0 then lower(p_name) else concat(lower(p_name),' ',chr(cast(97 + l_orderkey % 26 as int))) end leaf, case when l_linenumber % 2 = 0 then 'annotator' else 'expert' end tool, l_discount*10 score, l_linenumber seq from {lineitem} join {part} on l_partkey=p_partkey",
    "tree_rows": "select concat(cast(l_orderkey as {STR}),':',cast(l_linenumber % 3 as {STR})) row_id, l_orderkey clip, l_suppkey % 7 source, concat(case when cast(substr(p_brand,7) as int) % 5 < 3 then 'sound.b' else 'speech.b' end, cast(cast(substr(p_brand,7) as int) % 5 + 1 as {STR})) attr, concat(lower(p_type),' sort') value, case when l_partkey % 30 = 7 then concat(split_part(lower(p_name),' ',2),' 7') when l_partkey % 30 = 13 then 'recording' when l_partkey % 6 = 0 then split_part(lower(p_name),' ',2) when l_partkey % 6 = 1 then concat(split_part(lower(p_name),' ',2),'s') when l_partkey % 6 = 2 then lower(p_name) when l_partkey % 6 = 3 then '' when l_partkey % 6 = 4 then concat(split_part(lower(p_name),' ',2),'s ',split_part(lower(p_name),' ',1)) when l_partkey % 5 = 0 then lower(p_type) else concat(split_part(lower(p_name),' ',1),' maker') end leaf, case when l_linenumber % 2 = 0 then 'annotator' else 'expert' end tool, cast(l_discount as double)*10 score, l_linenumber seq from {lineitem} join {part} on l_partkey=p_partkey",
    "schema": "select distinct p_brand attr, lower(p_type) value, cast(substr(p_brand,7) as int) % 2 = 0 multi from {part}",
    "frames": "select user_id clip, event_type label, row_number() over (partition by user_id,event_type order by ts,event_id)-1 t, least(value/cast(100 as double), 1) p from {events}",
    "spans": "select event_id span_id, user_id clip, event_type label, cast(event_id % 60 as double) t0, cast(event_id % 60 as double)+0.5+(event_id % 7)*0.25 t1 from {events}",
    "ontology": "select vec_id child, cast(floor(vec_id/2) as bigint) parent from {embeddings} where vec_id > 1",
    "text": "select doc_id, text, lang, source from {documents}",
    "tags": "select p_partkey item, lower(split_part(p_name,' ',1)) tag1, lower(split_part(p_name,' ',2)) tag2, cast(p_size as double)/50 soft from {part}",
    "forms": "select p_partkey form_id, p_brand attr, concat('answer: ',chr(123),'\"is\": \"',lower(p_type),'\", \"detail\": \"',p_name,'\"',chr(125),' end') raw from {part}",
    "items": "select p_partkey id, p_name gold_name, lower(p_type) grp, p_brand genus, p_size quality from {part}",
    "qa": "select conv_id, turn, role, text from {conversations}",
    "vectors": "select vec_id, embedding, label, case when vec_id % 10 = 0 then 'eval' else 'cand' end side from {embeddings}",
    "logits": "select vec_id, k, label gold, cast({elem}(embedding,cast(k+1 as int)) as double) logit from {embeddings} cross join (select 0 k union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8 union all select 9) ks",
    "letters": "select vec_id id, k, cast({elem}(embedding,cast(k+1 as int)) as double) ours, cast({elem}(embedding,cast(k+5 as int)) as double) blind, label % 4 gold, label grp, vec_id % 10 < 3 dev from {embeddings} cross join (select 0 k union all select 1 union all select 2 union all select 3) ks",
}



def sql_list(items) -> str:
    """An SQL list of strings."""
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + "]"


# the stemmer in SQL: from a table w0(w) of words to stems(w, s); one pass takes an ending off, then what is done to a stable word
_CUT = "case " + " ".join(f"when s like '%{e}' and length(s) >= {len(e) + 4} then left(s, length(s) - {len(e)})" for e in X.ENDINGS) + " else s end"
_SYN = "coalesce(map_extract(map {" + ", ".join(f"'{a}': '{b}'" for a, b in X.SYNONYMS.items()) + "}, w)[1], w)"
STEMS = f"st(w, s) as (select w, {_SYN} from w0 union select w, {_CUT} from st where {_CUT} <> s), sm as (select w, arg_min(s, length(s)) s from st group by 1), sd as (select w, case when length(s) > 3 and right(s, 1) = substr(s, length(s) - 1, 1) and not contains('aeiouls', right(s, 1)) then left(s, length(s) - 1) else s end s from sm), stems as (select w, case when length(s) > 4 and s like '%e' then left(s, length(s) - 1) else s end s from sd)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a base table by its own name."""
    if name not in FIXTURES:
        return base(spark, sf_dir, name)
    sql = FIXTURES[name]
    used = {t: base(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    marks = {t: "{" + t + "}" for t in used}
    return spark.sql(sql.format(STR="string", elem="element_at", **marks), **used)


def _oracle(inputs: tuple[str, ...], sql: str) -> str:
    with_ = [f"{n} as ({FIXTURES[n].format(STR='varchar', elem='list_extract', **{t: t for t in TABLES})})" for n in inputs if n in FIXTURES]
    body = sql.strip()
    recursive = "recursive " if body.lower().startswith("with recursive") else ""
    if recursive:
        body = body[len("with recursive") :].lstrip()
    elif body.lower().startswith("with "):
        body = body[5:]
    else:
        return f"with {', '.join(with_)} {body}" if with_ else body
    return f"with {recursive}{', '.join([*with_, body])}"


def query(name: str, *inputs: str, sql: str | None = None):
    """Registers a function of the input tables as query `name`; sql, over the same inputs, is its oracle."""

    def add(f: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(*[fixture(spark, sf_dir, n) for n in inputs])
        if sql is not None:
            ORACLES[name] = _oracle(inputs, sql)
        return f

    return add

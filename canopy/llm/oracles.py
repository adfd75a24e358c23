"""SQL over the base tables that must give the same rows as the query of the same name, where SQL can express it."""

from __future__ import annotations

from .common import WORD

#: Links on full sets and the least id reachable; the sketches leave no trace in the result.
NEAR_DEDUP = rf"""
with recursive
words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] end) s from words),
sizes as (select doc_id, count(*) n from shingles group by 1),
-- equal sets meet once
sets as (select doc_id, md5(string_agg(s, chr(10) order by s)) h from shingles group by 1),
class as (select h, min(doc_id) rep from sets group by 1),
rare as (select s.doc_id a, s.s from shingles s join class c on c.rep = s.doc_id),
pairs as (select x.a, y.a b, count(*) k from rare x join rare y on x.s = y.s and x.a < y.a group by 1, 2),
links as (select a, b from pairs join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * k >= 80 * (p.n + q.n - k)),
edges as (select a, b from links union select b, a from links),
reach(a, b) as (select rep, rep from class union select r.a, e.b from reach r join edges e on e.a = r.b),
label as (select a, min(b) comp from reach group by 1)
select w.doc_id, cast(coalesce(z.n, 0) as bigint) n_shingles, coalesce(l.comp, w.doc_id) component_id, w.doc_id = coalesce(l.comp, w.doc_id) kept
from words w left join sizes z using (doc_id) left join sets using (doc_id) left join class c using (h) left join label l on l.a = c.rep
"""

WARC = """
with p as (select page_id, coalesce(html, '') html from pages),
q as (select page_id, octet_length(encode(html)) n, sha256(html) d, min(page_id) over (partition by html) first from p)
select page_id, cast(n as bigint) payload_bytes, d payload_digest,
  case when n >= 100 and page_id <> first then 'revisit' else 'response' end record_type, case when n >= 100 and page_id <> first then first end refers_to
from q
"""

TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) e from embeddings
  where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(embedding) > 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) score from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


def clusters_sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2") -> str:
    """The rounds written out: plain distances instead of transforms."""
    assign = "a{r} as materialized (select vec_id, min_by(k, (d, k)) k, min(d) d from (select v.vec_id, c.k, v.s - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e) d from v join c{r} c on true) group by 1)"
    move = f"m{{r}} as (select k, i, floor(sum(v.e[i]) / count(*)) x from a{{r}} join v using (vec_id), range(1, {dim + 1}) t(i) group by 1, 2), c{{n}} as materialized (select c.k, coalesce(m.e, c.e) e from c{{r}} c left join (select k, list(x order by i) e from m{{r}} group by 1) m using (k))"
    loop = ", ".join(f"{assign.format(r=r)}, {move.format(r=r, n=r + 1)}" for r in range(rounds))
    return f"""
with v0 as (select vec_id, list_transform(embedding, lambda x: floor({scale} * cast(x as double))) e from embeddings
  where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (select *, list_inner_product(e, e) s from v0),
c0 as materialized (select e, row_number() over (order by sha256('{salt}:' || vec_id)) - 1 k from v qualify k < {k}),
{loop}, {assign.format(r=rounds)},
h as (select k, sha256(array_to_string(list_transform(e, lambda x: cast(cast(x as bigint) as varchar)), ',')) sha from c{rounds})
select vec_id, cast(k as int) as cluster, cast(d as bigint) distance, cast(sum(d) over (partition by k) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia, sha centroid_sha256
from a{rounds} join h using (k)"""


def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """The rounds written out: plain distances instead of transforms. Vectors of one length that is a multiple of the parts."""
    assign = "a{r} as materialized (select vec_id, p, min_by(k, (d, k)) k, min(d) d from (select v.vec_id, p, c.k, v.s - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e) d from v join c{r} c using (p)) group by 1, 2)"
    move = "m{r} as (select p, k, i, floor(sum(v.e[i]) / count(*)) x from a{r} join v using (vec_id, p), range(1, 1 + (select max(len(e)) from v)) t(i) group by 1, 2, 3), c{n} as materialized (select c.p, c.k, coalesce(m.e, c.e) e from c{r} c left join (select p, k, list(x order by i) e from m{r} group by 1, 2) m using (p, k))"
    loop = ", ".join(f"{assign.format(r=r)}, {move.format(r=r, n=r + 1)}" for r in range(rounds))
    return f"""
with v0 as (select vec_id, label, list_transform(embedding, lambda x: floor({scale} * cast(x as double))) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v1 as (select vec_id, label, p, e[p * len(e) // {parts} + 1 : (p + 1) * len(e) // {parts}] e from v0, range({parts}) t(p)),
v as materialized (select *, list_inner_product(e, e) s from v1),
c0 as materialized (select p, e, row_number() over (partition by p order by vec_id) - 1 k from v qualify k < {entries}),
{loop}, {assign.format(r=rounds)},
h as (select sha256(string_agg(array_to_string(list_transform(e, lambda x: cast(cast(x as bigint) as varchar)), ','), ',' order by p, k)) sha from c{rounds}),
r as (select vec_id, string_agg(printf('%02x', k), '' order by p) code, sum(d) error from a{rounds} group by 1)
select vec_id, code, cast(error as bigint) error, cast(sum(error) over (partition by label) as bigint) label_error, sha codebooks_sha256 from r join v0 using (vec_id), h"""


ORACLE_SQL = {"op1_near_dedup": NEAR_DEDUP, "op6_warc": WARC, "op8_top_k": TOP_K, "op11_centroid_clustering": clusters_sql(), "op13_vector_codes": codes_sql()}

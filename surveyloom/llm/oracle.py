"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

from surveyloom.llm.url_rules import SPAM_PHRASES

OP1 = r"""
with l as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
w as (
  select doc_id, i, md5(lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2]) as h
  from (select doc_id, lines, unnest(range(1, len(lines) - 1)) as i from l)),
later as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) as rn from w) where rn > 1),
gone as (
  select distinct doc_id, i + k as i from later, (select unnest([0, 1, 2]) as k)),
each as (
  select doc_id, unnest(range(1, len(lines) + 1)) as i, unnest(lines) as line, len(lines) as n from l)
select e.doc_id, cast(max(n) as bigint) as n_lines, cast(count(g.i) as bigint) as n_removed,
       md5(coalesce(string_agg(e.line, chr(10) order by e.i) filter (where g.i is null), '')) as kept_md5
from each e left join gone g on e.doc_id = g.doc_id and e.i = g.i
group by e.doc_id
"""

_PHRASES = "\n  union all ".join(f"select '{p}' as phrase" for p in SPAM_PHRASES)

OP2 = rf"""
with p as (
  select page_id, coalesce(url, '') as url,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
  from pages),
r(rh, rp, v) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
site as (
  select page_id, url, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(v, length(rh || rp)) as verdict
  from p join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
  group by page_id, url),
f as (
  {_PHRASES}),
pattern as (
  select page_id, url, arg_max(phrase, (length(phrase), phrase)) as phrase
  from p join f on regexp_matches(p.url, '(?i)(^|[^A-Za-z0-9])' || replace(phrase, ' ', '[-_./]') || '($|[^A-Za-z0-9])')
  group by page_id, url)
select p.page_id, p.host, p.path, s.rule,
       coalesce(s.verdict, case when t.phrase is not null then 'block' end, 'allow') as verdict,
       coalesce(s.rule, t.phrase) as matched
from p left join site s on p.page_id = s.page_id and p.url = s.url
left join pattern t on p.page_id = t.page_id and p.url = t.url
"""

OP5 = r"""
with d as (
  select doc_id, source, coalesce(text, '') as text from documents),
w as (
  select doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
trip as (
  select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as c
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
rep as (
  select doc_id, count(distinct i + k) as n from trip, (select unnest([0, 1, 2]) as k) where c > 1 group by doc_id),
dup as (
  select doc_id, count(*) - count(distinct line) as n
  from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (
  select w.doc_id, source, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from w left join rep on w.doc_id = rep.doc_id left join dup on w.doc_id = dup.doc_id),
j as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
h as (
  select source, count(*) as docs, count(*) filter (where base_failed) as failed from j where source is not null group by source),
mv as (
  select avg(failed / docs) as mu, var_pop(failed / docs) as v from h),
s as (
  select mu, case when v > 0 and mu * (1 - mu) > v then mu * (1 - mu) / v - 1 else 1e12 end as strength from mv),
bad as (
  select source from h, s where (failed + mu * strength) / (docs + strength) > 0.5)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and (source is null or source not in (select source from bad)) as kept
from j
"""


def _nearest(r: int) -> str:
    """Assignment ``a{r}`` of every vector to the nearest of the centroids ``c{r}``."""
    return f"""
p{r} as (
  select v.vec_id, v.v, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
  from v cross join c{r} c),
a{r} as (
  select vec_id, v, c, d from p{r} qualify row_number() over (partition by vec_id order by d, c) = 1),"""


def _centroids(r: int) -> str:
    """Centroids ``c{r}`` from the assignment of the round before; floors of means, also of negative sums."""
    return f"""
s{r} as (
  select c, i, sum(x) as s, count(*) as n
  from (select c, unnest(range(1, 65)) as i, unnest(v) as x from a{r - 1}) group by c, i),
m{r} as (
  select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as v from s{r} group by c),
c{r} as (
  select c{r - 1}.c, coalesce(m{r}.v, c{r - 1}.v) as v from c{r - 1} left join m{r} on c{r - 1}.c = m{r}.c),"""


OP11 = f"""
with v as (
  select vec_id, list_transform(embedding::double[], lambda x: floor(64 * x)::bigint) as v
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as (
  select row_number() over (order by sha256('1:' || vec_id), v) - 1 as c, v from v order by 1 limit 16),
{_nearest(0)}{"".join(_centroids(r) + _nearest(r) for r in (1, 2, 3))}
own as (
  select c, sum(d)::bigint as own from a3 group by c)
select a3.vec_id, a3.c::int as cluster, a3.d as distance, own.own as cluster_inertia,
       (select sum(d)::bigint from a3) as inertia, sha256(array_to_string(c3.v, ',')) as centroid_sha256
from a3 join own on a3.c = own.c join c3 on a3.c = c3.c
"""

ORACLES = {"op1_line_dedup": OP1, "op2_url_filters": OP2, "op5_quality_rules": OP5, "op11_centroid_clustering": OP11}

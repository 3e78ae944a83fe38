"""Registered queries of the corpus operators and their SQL.

SQL is given where it can express the result on whole tables; the other
queries are tested against brute force, the library or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import lexical_search, mixing, packing, suffix_dedup
from tideline.llm.language_id import op3_language_id
from tideline.llm.lexical_search import op13_lexical_search
from tideline.llm.line_dedup import op2_line_dedup
from tideline.llm.mixing import op12_mixing
from tideline.llm.packing import op4_packing
from tideline.llm.quality_classifier import op9_quality_classifier
from tideline.llm.quality_rules import op5_quality_rules
from tideline.llm.sentencepiece_codec import op1_sentencepiece
from tideline.llm.simhash_dedup import op6_simhash
from tideline.llm.suffix_dedup import op7_suffix_dedup
from tideline.llm.url_filters import op8_url_filters
from tideline.llm.vector_search import op10_vector_search
from tideline.llm.whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sentencepiece, op2_line_dedup, op3_language_id, op4_packing, op5_quality_rules, op6_simhash,
        op7_suffix_dedup, op8_url_filters, op9_quality_classifier, op10_vector_search, op11_whitening,
        op12_mixing, op13_lexical_search)
}

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_OP2 = f"""
with l as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line, unnest(string_split(text, chr(10))) as t
  from documents where text is not null),
s as (select doc_id, line, list_sort(list_distinct({_WORDS.format(text="t")})) as ws from l),
firsts as (select ws, min((doc_id, line)) as place, len(ws) as n from s where len(ws) > 0 group by ws),
f as (select w, count(*) as c from (select unnest(ws) as w from firsts) group by w),
tok as (select place, n, ws, unnest(ws) as w from firsts),
ranked as (select place, n, ws, w, row_number() over (partition by place order by c, w) as p from tok join f using (w)),
pre as (select * from ranked where p <= n - cast(ceil(n * 4 / 5) as bigint) + 1),
cand as (select distinct x.place as xa, y.place as ya, x.ws as xw, y.ws as yw from pre x join pre y
         on x.w = y.w and y.place < x.place and least(x.n, y.n) * 5 >= greatest(x.n, y.n) * 4),
lost as (select distinct xa from (select xa, len(list_intersect(xw, yw)) as o, len(xw) + len(yw) as both_n from cand)
         where o * 5 >= (both_n - o) * 4),
gone as (select s.doc_id, s.line from s join firsts using (ws)
         where (s.doc_id, s.line) <> firsts.place or firsts.place in (select xa from lost)),
per as (select doc_id, list_sort(list(cast(line as integer))) as removed from gone group by doc_id)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) as n_lines,
       coalesce(len(per.removed), 0) as n_removed, coalesce(array_to_string(per.removed, ','), '') as removed
from documents d left join per using (doc_id)
"""

_OP4 = rf"""
with recursive words as (
  select doc_id, cast(len({_WORDS.format(text="coalesce(text, '')")}) as bigint) as words from documents),
pieces as (
  select doc_id, piece, least({packing.MAX_LEN}, words - piece * {packing.MAX_LEN}) as n_words
  from (select doc_id, words, unnest(range((words + {packing.MAX_LEN - 1}) // {packing.MAX_LEN})) as piece from words where words > 0)),
h as (select n_words as len, count(*) as c, row_number() over (order by n_words) as j from pieces group by n_words),
cum as (select 0 as j, 0::bigint as len, 0::hugeint as n, 0::hugeint as total
        union all select j, len, sum(c) over (order by j), sum(c * len) over (order by j) from h),
dp(k, j, cost, cut) as (
  select 0, 0::bigint, 0::hugeint, 0::bigint
  union all
  select k + 1, b, min(cost), arg_min(a, (cost, a)) from (
    select dp.k, y.j as b, x.j as a, dp.cost + y.len * (y.n - x.n) - (y.total - x.total) as cost
    from dp join cum x on x.j = dp.j join cum y on y.j > x.j where dp.k < {packing.BUCKETS}) group by k, b),
m as (select max(j) as m from h),
best as (select min(k) filter (cost = 0) as zero, max(k) as most from dp, m where dp.j = m.m),
walk(k, j) as (
  select coalesce(zero, most), m from best, m where m is not null
  union all
  select walk.k - 1, dp.cut from walk join dp on dp.k = walk.k and dp.j = walk.j where walk.k > 1),
bounds as (select h.len as bucket from walk join h on h.j = walk.j),
placed as (select p.*, (select min(bucket) from bounds where bucket >= p.n_words) as bucket from pieces p),
per as (select bucket, greatest(1, (count(*) + {packing.SLICE_ROWS - 1}) // {packing.SLICE_ROWS}) as slices from placed group by bucket),
sliced as (select placed.*, cast(cast('0x' || substr(md5(concat_ws('/', coalesce(cast(doc_id as varchar), ''), piece, n_words)), 1, 8) as bigint) % slices as bigint) as slice
           from placed join per using (bucket))
select doc_id, piece, n_words, bucket, slice,
       (row_number() over (partition by bucket, slice order by doc_id, piece, n_words) - 1) // greatest(1, {packing.BUDGET} // bucket) as batch,
       bucket - n_words as padding
from sliced
"""

_OP7 = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
s as (select doc_id, h, unnest(range(len(h) // 2 - {suffix_dedup.LENGTH - 1})) as s from d where len(h) >= {2 * suffix_dedup.LENGTH}),
g as (select doc_id, s, md5_number(substr(h, 2 * s + 1, {2 * suffix_dedup.LENGTH})) as g from s),
dup as (select doc_id, s from (select doc_id, s, row_number() over (partition by g order by doc_id, s) as r from g) where r > 1),
gaps as (select doc_id, s, case when s <= lag(s) over w + {suffix_dedup.LENGTH} then 0 else 1 end as starts from dup
         window w as (partition by doc_id order by s)),
runs as (select doc_id, s, sum(starts) over (partition by doc_id order by s) as run from gaps),
spans as (select doc_id, run, min(s) as a, max(s) + {suffix_dedup.LENGTH} as b from runs group by doc_id, run),
kept as (select spans.doc_id, run, b, substr(h, 2 * coalesce(lag(b) over w, 0) + 1, 2 * (a - coalesce(lag(b) over w, 0))) as part
         from spans join d using (doc_id) window w as (partition by doc_id order by run)),
per as (select doc_id, string_agg(part, '' order by run) as head, max(b) as b from kept group by doc_id),
n as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from spans group by doc_id)
select d.doc_id, len(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(head || substr(h, 2 * per.b + 1), h))) as kept_sha256
from d left join per using (doc_id) left join n using (doc_id)
"""

_OP8 = r"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
hp as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
              regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') as path from u),
rules(rule, host_part, path_part, verdict) as (values
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
  ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
fit as (select page_id, arg_max(rule, len(rule)) as rule, arg_max(verdict, len(rule)) as verdict
        from hp join rules on (host = host_part or ends_with(host, '.' || host_part)) and starts_with(path, path_part) group by page_id)
select hp.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from hp left join fit using (page_id)
"""

_OP12 = f"""
with d as (select doc_id, source, cast(len({_WORDS.format(text="coalesce(text, '')")}) as bigint) as size, md5(coalesce(text, '')) as digest
           from documents),
src as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from d group by source),
w as (select *, {list(mixing.WEIGHTS)}[(place - 1) % {len(mixing.WEIGHTS)} + 1] as weight, source_size * {mixing.CAP} as most from src),
p as (select *, (sum(source_size) over () * {mixing.SHARE[0]}
                 - coalesce(sum(most) over (o rows between unbounded preceding and 1 preceding), 0) * {mixing.SHARE[1]})::double
             / (sum(weight) over (o rows between current row and unbounded following) * {mixing.SHARE[1]})::double as part,
      row_number() over o as turn from w window o as (order by most::double / weight, place)),
lv as (select arg_min(part, turn) as level from p where part * weight <= most),
t as (select source, source_size, place, least(most::double, level * weight) as target from p, lv),
r as (select *, case when source_size > 0 then cast(floor(target / source_size * {float(mixing.UNIT)}) as hugeint) else 0 end as rate,
             cast('0x' || substr(md5('{mixing.SEED}/' || place), 1, 8) as bigint) as shift from t),
c as (select d.*, r.* exclude (source), case when size < {mixing.CLASSES} then size
        else length(bin(size)) * {mixing.CLASSES} + ((size >> (length(bin(size)) - {mixing.CLASSES.bit_length()})) & {mixing.CLASSES - 1}) end as class,
        cast('0x' || substr(md5(coalesce(doc_id::varchar, '') || '/' || digest), 1, 8) as bigint) as spread
      from d join r on d.source is not distinct from r.source),
k as (select place, class, greatest(1, ceil(count(*) / {mixing.SLICE_ROWS}))::bigint as slices from c group by place, class),
n as (select c.*, row_number() over (partition by place order by class, spread % slices, size, doc_id nulls last, digest) as nr
      from c join k using (place, class)),
f as (select *, cast((nr * rate + shift) // {mixing.UNIT} - ((nr - 1) * rate + shift) // {mixing.UNIT} as bigint) as copies from n)
select doc_id, size, source_size, target, size * copies as taken, copies, source from f
"""

_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

_OP13 = f"""
with t as (select doc_id, unnest({_TERMS}) as term from documents),
tf as (select doc_id, term, count(*) as tf from t group by all),
n as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
s as (select count(*) as docs, sum(n)::bigint as len from n),
df as (select term, count(*) as df from tf group by term),
q as (select item_id, unnest({_TERMS}) as term from benchmark),
qt as (select item_id, term, count(*) as times from q group by all),
w as (select item_id, term, times, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w from qt join df using (term), s),
m as (select doc_id, 100 - 25 + ((25 * n * docs) // len) as m from n, s),
sc as (select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
       from w join tf using (term) join m using (doc_id) group by item_id, doc_id),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
      from sc where score > 0)
select item_id, rank, doc_id, score from r where rank <= {lexical_search.TOP}
"""

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": _OP2, "op4_packing": _OP4, "op7_suffix_dedup": _OP7, "op8_url_filters": _OP8,
    "op12_mixing": _OP12, "op13_lexical_search": _OP13,
}

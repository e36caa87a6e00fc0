"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import line_dedup as ld
from . import mixing as mx
from . import quality_rules as qr


def _jsd(counts: str, share: str) -> str:
    total = f"list_sum({counts})"
    half = lambda a, b: f"case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0.0::double end"
    pair = f"list_transform(list_zip({counts}, {share}), lambda z: {half(f'(z[1]::double / {total})', 'z[2]')} + {half('z[2]', f'(z[1]::double / {total})')})"
    return f"case when {total} > 0 then sqrt(greatest(0.0::double, 0.5::double * list_sum({pair}))) end"


def op1(rules: qr.Rules = qr.Rules(), source: str = "documents") -> str:
    k = rules.window
    listed = "[" + ",".join(f"'{w}'" for w in qr.COMMON) + "]"
    n = len(qr.COMMON) + 1
    langs = ",".join(f"'{x}'" for x in qr.LANGUAGES)
    med = lambda kind, m: "[" + ",".join(f"quantile_cont({kind}[{i}], 0.5)" for i in range(1, m + 1)) + "]"
    return rf"""
with d as (
  select doc_id, lang, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
         regexp_replace(coalesce(text, ''), '\p{{Ll}}+', '', 'g') r from {source}),
m as (
  select doc_id, lang, len(w) n_words, length(t) n_all, length(r) n_rest,
         length(regexp_replace(r, '[^\x20\x09-\x0D]+', '', 'g')) n_space,
         length(regexp_replace(r, '[^#*$%&|<>]+', '', 'g')) n_sym,
         length(regexp_replace(r, '\P{{Lu}}+', '', 'g')) n_upper,
         length(regexp_replace(r, '\P{{Nd}}+', '', 'g')) n_digit,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l, w,
         case when len(w) >= {k} then list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) else [] end g
  from d),
x as (select doc_id, unnest(g) s, generate_subscripts(g, 1) i from m where len(list_distinct(g)) < len(g)),
y as (select doc_id, i, count(*) over (partition by doc_id, s) c from x),
z as (select doc_id, lead(i) over (partition by doc_id order by i) - i gap from y where c > 1),
rep as (select doc_id, sum(least(coalesce(gap, {k}), {k}))::bigint n from z group by 1),
f as (
  select m.doc_id, lang, n_words::bigint n_words, (n_all - n_space)::bigint word_chars, n_sym::bigint n_symbols,
         (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words,
         [n_all - n_rest, n_upper, n_digit, n_space, n_sym, n_rest - n_upper - n_digit - n_space - n_sym] chars,
         list_transform({listed}, lambda c: len(list_filter(w, lambda v: v = c))) hits
  from m left join rep on rep.doc_id = m.doc_id),
h as (
  select * exclude (hits), list_append(hits, (n_words - list_sum(hits))::bigint) common,
         n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words base_failed from f),
s as (
  select lang, list_transform(chars, lambda v: round(1000.0::double * v / list_sum(chars))) chars,
         list_transform(common, lambda v: round(1000.0::double * v / list_sum(common))) common
  from h where lang in ({langs}) and not base_failed),
q as (select lang, {med('chars', 6)} a, {med('common', n)} b from s group by lang),
p as (select lang, list_transform(a, lambda v: v / list_sum(a)) a, list_transform(b, lambda v: v / list_sum(b)) b from q),
j as (
  select h.doc_id, any_value(h.n_words) n_words, any_value(word_chars) word_chars, any_value(n_symbols) n_symbols,
         any_value(n_dup_lines) n_dup_lines, any_value(n_repeat_words) n_repeat_words, any_value(base_failed) base_failed,
         min({_jsd('h.chars', 'p.a')}) cd, min({_jsd('h.common', 'p.b')}) wd
  from h left join p on true group by h.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (n_words >= {rules.guard_words} and coalesce(cd > {rules.max_char_distance}, false))
         and not (n_words >= {rules.guard_words} and coalesce(wd > {rules.max_word_distance}, false))
         and not coalesce(cd > {rules.short_char_distance}, false) as kept,
       round(cd, 6) char_distance, round(wd, 6) word_distance
from j"""


def op2(every: int = 50, k: int = 5, scale: int = 256, source: str = "embeddings") -> str:
    finite = "x is not null and isfinite(x)"
    return f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) v from {source}
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: {finite})) = len(embedding)),
q as (select distinct * from v where vec_id % {every} = 0),
s as (
  select q.vec_id query_id, v.vec_id, list_inner_product(q.v::double[], v.v::double[])::bigint score
  from q join v on q.vec_id <> v.vec_id and len(q.v) = len(v.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) "rank" from s)
select query_id, "rank"::int "rank", vec_id, score from r where "rank" <= {k}"""


def op5(p: ld.Lines = ld.Lines(), source: str = "documents") -> str:
    return rf"""
with r as (select distinct doc_id, text from {source} where doc_id is not null and text is not null),
l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no from r),
s as (select doc_id, line_no, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) w from l),
c as (select w, min((doc_id, line_no)) place, len(w) n from s where len(w) >= {p.min_words} group by w),
i as (select row_number() over () id, w, place, n from c),
t as (select id, unnest(w) x from i),
f as (select x, count(*) df from t group by x having count(*) > 1),
g as (select t.id, t.x, i.n, row_number() over (partition by t.id order by f.df, t.x) rare
      from t join f using (x) join i using (id)),
h as (select id, x, n from g where rare <= n - ceil({p.percent} * n / 100.0)::bigint + 1),
k as (select distinct a.id a, b.id b from h a join h b on a.x = b.x and a.id < b.id
      and 100 * least(a.n, b.n) >= {p.percent} * greatest(a.n, b.n)),
m as (select k.a, k.b, len(list_intersect(p.w, q.w)) common, p.n + q.n total from k join i p on p.id = k.a join i q on q.id = k.b),
e as (select a, b from m where 100 * common >= {p.percent} * (total - common)),
y as (select a, b from e union all select b, a from e),
z as (select y.a id, min(o.place) other, count(*) n_links from y join i o on o.id = y.b group by y.a),
j as (select i.w, i.place, least(i.place, coalesce(z.other, i.place)) hit, coalesce(z.n_links, 0) n_links from i left join z using (id))
select distinct s.doc_id, s.line_no::int line_no, len(s.w)::bigint n_words, hit[1] match_doc_id, hit[2]::int match_line_no, n_links::bigint n_links
from s join j on j.w = s.w where (s.doc_id, s.line_no) <> hit"""


def op10(m: mx.Mix = mx.Mix(), source: str = "documents") -> str:
    """For the default budget and no target entropy."""
    key = f"md5(concat('{m.seed}:', {{}}::varchar, ':', coalesce(doc_id::varchar, '')))"
    return rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint n from {source}),
s as (select source, sum(n)::bigint n_tokens from d group by source),
p as (select *, n_tokens / (select sum(n_tokens) from s)::double share from s),
a as (select min(i) / 1048576.0::double - 1 e from range(0, 1048577) t(i)
      where pow((select min(share) from p where share > 0) / (select max(share) from p), i / 1048576.0::double - 1) <= {m.max_repeats}),
r as (select *, case when n_tokens > 0 then pow(share / (select max(share) from p), (select e from a)) else 1 end repeats from p),
q as (select *, floor(repeats)::int epochs, floor((repeats - floor(repeats)) * n_tokens)::bigint rest from r),
k as (select d.*, q.epochs, q.rest, {key.format('epochs')} k from d join q on d.source is not distinct from q.source),
u as (select *, sum(n) over (partition by source order by k) upto from k),
t as (select *, epochs + case when upto <= rest then 1 else 0 end times from u),
x as (select doc_id, source, n, unnest(range(0, times)) epoch from t)
select doc_id, source, n n_tokens, epoch::int epoch, substr({key.format('epoch')}, 1, {m.block_digits}) block from x"""

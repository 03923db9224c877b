"""DuckDB SQL for the attempt queries, from the numbers and not from the texts."""

from __future__ import annotations

#: Signals, label and type of every order under the kinds ``k`` of table ``kinds`` (key, variant, k).
SCORED = """
ranked as (
  select l_orderkey as key, cast(l_quantity as int) as q, cast(1 + l_partkey % 97 as int) as p,
         row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as rn
  from lineitem),
kinds as (
  select o_orderkey as key, o_orderpriority as priority, 'first' as variant, o_orderkey % 8 as k from orders
  union all select o_orderkey, o_orderpriority, 'clean', 0 from orders),
ln as (
  select key, variant, priority, k, rn, q, p, q * p as r, count(*) over w as n, sum(q * p) over w as t, sum((q + 1) * p) over w as t7
  from ranked join kinds using (key) window w as (partition by key, variant)),
head as (select key, variant, priority, k, count(rn) as n, coalesce(sum(q * p), 0) as t, coalesce(sum((q + 1) * p), 0) as t7
  from kinds left join ranked using (key) group by all),
shown as (
  select key, variant, k, rn, 0 as copy, case when k = 7 then q + 1 else q end as q, p,
         case when k = 1 and rn = n then r + 7 when k = 7 then (q + 1) * p else r end as c
  from ln where k in (0, 1, 4, 5, 7) or (k = 2 and rn <= n // 3) or (k = 6 and rn < n)
  union all select key, variant, k, rn, copy, q, p, r from ln, (select unnest([-2, -1]) as copy) where k = 5 and rn = 1),
terms as (
  select key, variant, rn, case when k = 1 and rn = n then r + 7 when k = 7 then (q + 1) * p else r end as v
  from ln where k in (0, 1, 4, 5, 6, 7)),
ends as (
  select key, variant, priority, k, n, t,
         case k when 1 then t + 7 when 2 then t + 1 when 3 then t + 3 when 4 then t + 5 when 7 then t7 else t end as answer,
         case when n = 0 then null when k in (0, 4, 5, 6) then t when k = 1 then t + 7 when k = 7 then t7 end as summed
  from head),
left_side as (select key, variant, string_agg(v, ' + ' order by rn) as l from terms group by all),
tail as (select key, variant, regexp_replace(substr(l, greatest(1, length(l) - 48)), '^[^0-9]+', '') as l from left_side),
eqs as (
  select key, variant, rn, q, p, c, (q * p = c) as is_true from shown
  union all select key, variant, 1000000, null, null, summed, abs(list_sum(list_transform(string_split(l, ' + '), lambda x: x::bigint)) - summed) <= 1e-4::double * summed from ends join tail using (key, variant) where summed is not null and n >= 2 and not regexp_matches(l, '^0+[1-9]')),
vals as (
  select key, variant, q as v from shown union select key, variant, p from shown union select key, variant, c from shown
  union select key, variant, v from terms union select key, variant, summed from ends where summed is not null
  union select key, variant, answer from ends),
eq_sum as (
  select key, variant, count(*) as n_equations, count(*) filter (is_true) as n_true, max_by(c, rn) as last_c from eqs group by all),
gold as (
  select key, variant,
    count(*) filter (exists (select 1 from vals v where v.key = ln.key and v.variant = ln.variant and v.v = ln.r)) as e_hits,
    count(*) filter (exists (select 1 from eqs e where e.key = ln.key and e.variant = ln.variant and e.c = ln.r)) as a_hits,
    count(*) filter (exists (select 1 from shown s where s.key = ln.key and s.variant = ln.variant and s.c = ln.r and s.q * s.p = s.c
      and least(s.q, s.p) = least(ln.q, ln.p) and greatest(s.q, s.p) = greatest(ln.q, ln.p))) as s_hits
  from ln group by all),
asked as (select key, variant, q as v from ln union select key, variant, p from ln),
grounded as (
  select a.key, a.variant, count(*) as n_asked, count(v.v) as n_found
  from asked a left join vals v on v.key = a.key and v.variant = a.variant and v.v = a.v group by all),
step_rows as (
  select key, variant, copy * 10 + rn + 1000 as line, [cast(q as varchar), cast(p as varchar), cast(c as varchar)] as toks from shown
  union all select e.key, e.variant, 100000000, list_append(list(cast(t.v as varchar) order by t.rn), cast(any_value(e.summed) as varchar))
  from ends e join terms t using (key, variant) where e.summed is not null group by e.key, e.variant
  union all select key, variant, 1, [] from ends where k = 3),
step_n as (select key, variant, count(*) as n_steps from step_rows group by all),
tf as (
  select key, variant, line, tok, count(*) as tf from (select key, variant, line, unnest(toks) as tok from step_rows) where length(tok) >= 2 group by all),
weighted as (
  select tf.*, tf * (ln((1 + n_steps) / (1 + df)::double) + 1) as w
  from tf join step_n using (key, variant)
  join (select key, variant, tok, count(*) as df from tf group by all) using (key, variant, tok)),
normed as (select *, w / sqrt(sum(w * w) over (partition by key, variant, line)) as u from weighted),
dups as (
  select key, variant, count(*) as n_dup from (
    select key, variant, line from (
      select a.key, a.variant, a.line, b.line as other, sum(a.u * b.u) as cos
      from normed a join normed b on a.key = b.key and a.variant = b.variant and a.tok = b.tok and b.line < a.line group by all)
    where cos > 0.9 group by all) group by all),
sig as (
  select key, variant, priority, k, e.n as n_checkpoints, coalesce(e_hits / e.n::double, 0) as E, coalesce(a_hits / e.n::double, 0) as A, coalesce(s_hits / e.n::double, 0) as E_struct, coalesce(s_hits / e.n::double, 0) as A_struct,
    coalesce(n_found / n_asked::double, 1) as G, e.n - coalesce(e_hits, 0) as misses, coalesce(n_equations, 0) as n_equations, coalesce(n_true / n_equations::double, 0) as V,
    coalesce(n_equations - n_true, 0) as bad_eqs, last_c = answer as coherent, answer = t as correct, cast(answer as double) as final_answer, cast(t as double) as gold_answer,
    coalesce(n_steps, 0) as n_steps, case when coalesce(n_steps, 0) < 2 then 1.0 else 1 - coalesce(n_dup, 0) / (n_steps - 1)::double end as R
  from ends e left join gold using (key, variant) left join grounded using (key, variant)
  left join eq_sum using (key, variant) left join step_n using (key, variant) left join dups using (key, variant)),
labelled as (
  select *, case when correct and misses = 0 and bad_eqs = 0 and coalesce(coherent, false) and R >= 0.6::double then 'GOOD' when correct then 'MEDIUM_CORRECT'
    when misses <= 1 and bad_eqs <= 1 and coalesce(coherent, false) and G >= 0.5::double then 'MEDIUM_WRONG' else 'BAD_WRONG' end as label
  from sig),
scored as (
  select *, 'p1_' || lpad(cast(key as varchar), 8, '0') as id, case when label = 'GOOD' then null
    when E < 0.3::double and n_equations = 0 then 'NR'
    when n_checkpoints >= 2 and n_steps < 0.6::double * n_checkpoints and E < 0.6::double then 'ST'
    when abs(E - 0.3::double) < 0.05::double then 'UNCLASSIFIED'
    when E < 0.3::double and V > 0.4::double and n_steps >= 0.7::double * n_checkpoints and G >= 0.5::double and coalesce(coherent, false) then 'SM'
    when E >= 0.3::double and V < 0.85::double and n_steps >= 0.7::double * n_checkpoints then 'CE'
    else 'UNCLASSIFIED' end as diagnosis,
    label <> 'GOOD' and not (E < 0.3::double and n_equations = 0) and not (n_checkpoints >= 2 and n_steps < 0.6::double * n_checkpoints and E < 0.6::double)
      and abs(E - 0.3::double) < 0.05::double as in_band
  from labelled),
cat as (
  select distinct key, case priority when '1-URGENT' then 'monetary' when '2-HIGH' then 'time' when '3-MEDIUM' then 'rate' when '4-NOT SPECIFIED' then 'counting' else 'percentage' end as category from head),
first_tries as (select s.*, category from scored s join cat using (key) where variant = 'first')
"""

#: Questions and traces of the first attempts as texts, after ``SCORED``.
TEXTS = """asked_items as (
  select key, string_agg(q || case priority when '1-URGENT' then ' boxes at $' || p when '2-HIGH' then ' rounds of ' || p || ' minutes' when '3-MEDIUM' then ' trips of ' || p || ' miles'
    when '4-NOT SPECIFIED' then ' bags of ' || p || ' beads' else ' rows of ' || p || ' pins' end, ', ' order by rn) as items from ln where variant = 'first' group by key),
trace_lines as (select key, list(q || ' * ' || p || ' = ' || c order by copy, rn) as ls from shown where variant = 'first' group by key),
texts as (
  select e.key, priority, e.n, 'p1_' || lpad(cast(e.key as varchar), 8, '0') as id,
    case priority when '1-URGENT' then 'A shop buys ' || coalesce(items, '') || '. What is the total cost?' when '2-HIGH' then 'A job has ' || coalesce(items, '') || '. Find the full duration.'
      when '3-MEDIUM' then 'A van goes ' || coalesce(items, '') || ' at constant speed. Find the full distance.' when '4-NOT SPECIFIED' then 'How many beads are in ' || coalesce(items, '') || '?'
      else 'A box holds ' || coalesce(items, '') || '. Ignore the percent sign.' end as question,
    case when k = 3 then 'We think about it and guess.' else array_to_string(list_concat(coalesce(ls, []), case when summed is not null then [l || ' = ' || summed] else [] end), chr(10)) end || chr(10) || '#### ' || answer as trace
  from ends e left join asked_items using (key) left join trace_lines using (key) left join left_side s on s.key = e.key and s.variant = 'first' where e.variant = 'first')"""


def scored(select: str) -> str:
    return f"with {SCORED} {select}"

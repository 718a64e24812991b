"""DuckDB SQL over whole tables for the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {}

SQL["op2_repetition_rules"] = rf"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
sized as (select *, len(w) as n from docs),
w3 as (select r, i, w[i:i+2] as g from (select r, w, unnest(range(1, greatest(n - 1, 1))) as i from sized)),
r3 as (select r, count(distinct p) as n_repeat_words from (
  select r, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by r, g) as c from w3) where c > 1) group by r),
w8 as (select r, i, w[i:i+7] as g from (select r, w, unnest(range(1, greatest(n - 6, 1))) as i from sized)),
r8 as (select r, count(distinct p) as covered_words from (
  select r, unnest(range(i, i + 8)) as p from (select *, count(*) over (partition by r, g) as c from w8) where c > 1) group by r),
w201 as (select r, bool_or(c > 1) as too_long from (
  select r, count(*) as c from (select r, md5(array_to_string(w[i:i+200], ' ')) as g from (select r, w, unnest(range(1, n - 199)) as i from sized where n > 201)) group by r, g) group by r),
lines as (select r, sum(c - 1)::bigint as n_dup_lines from (
  select r, line, count(*) as c from (select r, unnest(string_split(text, chr(10))) as line from sized) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r, line) group by r),
joined as (select s.*, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(covered_words, 0) as covered_words,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(too_long, false) as too_long
  from sized s left join r3 using (r) left join r8 using (r) left join w201 using (r) left join lines using (r)),
rated as (select *, n < 50 or 100 * n_repeat_words > 50 * n as base_failed from joined)
select doc_id, n::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  covered_words::bigint as covered_words, base_failed, not base_failed and 10 * covered_words <= 4 * n and not too_long as kept
from rated
"""

_FOLDED = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op3_benchmark_overlap"] = rf"""
with docs as (select row_number() over () as r, doc_id, {_FOLDED.format("text")} as w from documents),
items as (select item_id::varchar as item, {_FOLDED.format("text")} as w from benchmark where item_id is not null),
windows as (select distinct item, least(len(w), 10) as n, w[i:i+9] as g from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)),
sizes as (select distinct n from windows),
placed as (select r, i, n, w[i:i+n-1] as g from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n)),
found as (select p.r, p.i, p.n, v.item from placed p join windows v on p.n = v.n and p.g = v.g),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from found) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, item from found) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (r) left join named using (r)
"""

_REST = "case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end"

SQL["op5_url_verdicts"] = rf"""
with rules(verdict, rh, rp) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p as (select row_number() over () as r, page_id,
  translate(regexp_extract(coalesce({_REST}, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce({_REST}, ''), '^[^/?#]*([^?#]*)', 1) as path from pages),
best as (select r, rh || rp as rule, verdict, row_number() over (partition by r order by length(rh || rp) desc, length(rp) desc, verdict desc) as k
  from p join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join (select * from best where k = 1) using (r)
"""

SQL["op8_source_mix"] = rf"""
with docs as (select doc_id, source, len({_WORDS})::bigint as size, md5('mix:' || coalesce(doc_id::varchar, '')) as k from documents),
s1 as (select source, sum(size)::bigint as source_size from docs group by source),
s2 as (select *, [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w, 3 * source_size as cap from s1),
s3 as (select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
  sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as ws from s2),
s4 as (select *, rest * w < cap * ws as free from s3),
s5 as (select *, first_value(rest) over f as rest0, first_value(ws) over f as ws0 from s4 window f as (order by free desc, cap / w, source nulls last)),
s6 as (select source, source_size, case when free then rest0::double * w / ws0::double else cap::double end as target from s5),
d as (select doc_id, size, source_size, target, sum(size) over (partition by docs.source order by k, size, doc_id rows unbounded preceding) as upto,
  case when source_size > 0 then floor(target / source_size)::bigint else 0 end as e
  from docs join s6 on docs.source is not distinct from s6.source)
select doc_id, size, source_size, target, (e * size + greatest(0, least(size, floor(target)::bigint - e * source_size - (upto - size))))::bigint as taken from d
"""

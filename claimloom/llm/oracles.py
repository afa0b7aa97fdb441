"""DuckDB SQL of the queries over n-grams, conversation tries and repairs."""

from __future__ import annotations

#: CRC-32 of short ASCII texts: the table of all bytes, made by the rule of its polynomial, and the running value.
CRC_TABLE = """crc as materialized (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
  lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t)"""


def crc32(text: str) -> str:
    """SQL of the crc32 of a SQL text; ``crc`` must be among the tables."""
    codes = f"list_transform(list_filter(string_split({text}, ''), lambda x: x <> ''), lambda x: cast(ascii(x) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(crc.t[1 + xor(c, b) % 256], c // 256)), 4294967295)"


LM_SCORING = rf"""
with recursive {CRC_TABLE},
d as materialized (
  select row_number() over () as n, doc_id, {crc32("coalesce(cast(doc_id as varchar), '')")} % 10 = 0 as held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) as w
  from documents, crc
), t as materialized (select n, held_out, unnest(w) as word, unnest(list_prepend(null, w[:-2])) as prev from d),
c1 as materialized (select word, count(*) as c from t where not held_out group by 1),
c2 as materialized (select prev, word, count(*) as c from t where not held_out and prev is not null group by 1, 2),
k as (select coalesce(sum(c), 0) as tokens, count(*) as words, (select count(*) from c2 where c = 1) as once, (select coalesce(sum(c), 0) from c2) as pairs from c1),
classes as materialized (select floor(8 * log2(c)) as class, cast(count(*) as double) as histories, cast(sum(c) as double) as tokens from c1 where word <> chr(10) group by 1),
halved(i, low, high) as (
  select 0, -2.0::double, 12.0::double
  union all
  select i + 1, case when share < once then (low + high) / 2 else low end, case when share < once then high else (low + high) / 2 end
  from (
    select i, low, high, once, (select sum(c.tokens * pow(10, (low + high) / 2) / (c.tokens / c.histories + pow(10, (low + high) / 2))) from classes c) as share from halved, k where i < 60
  )
), m as (select case when pairs > 0 then pow(10, (low + high) / 2) else 1.0 end as m from halved, k where i = 60),
p as (
  select t.n, c1.c is not null as known, (coalesce(c1.c, 0) + 0.1::double) / (k.tokens + 0.1::double * (k.words + 1)) as base, t.prev is not null as inner_, coalesce(c2.c, 0) as c, coalesce(h.c, 0) as h
  from t join k on true left join c1 on c1.word = t.word left join c2 on c2.prev = t.prev and c2.word = t.word left join c1 h on h.word = t.prev
), s as (
  select n, count(*) as n_tokens, count(*) filter (where known) as n_known, sum(log10(base)) as base_score, sum(log10(case when inner_ then (c + m * base) / (h + m) else base end)) as score
  from p, m group by n
)
select doc_id, held_out, n_tokens, n_known, cast(k.tokens as bigint) as train_tokens, base_score, score from d join s using (n), k
"""

CONVERSATION_TRIE = rf"""
with {CRC_TABLE},
t as (
  select conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest, strlen(coalesce(text, '')) as size from conversations where conv_id is not null
), own as materialized (
  select conv_id, list({{'digest': digest, 'size': size}} order by turn nulls first, digest) as turns, {crc32("cast(conv_id as varchar)")} % 9 as h from t, crc group by conv_id, crc.t
), r as (
  select o.conv_id, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:]) as path from own o left join own b on b.conv_id = o.conv_id - o.conv_id % 5
), p as materialized (
  select conv_id, len(path) as n, d, md5(array_to_string(list_transform(path[1:d], lambda x: x.digest), ',')) as node, md5(array_to_string(list_transform(path[1:d - 1], lambda x: x.digest), ',')) as up, path[d].size as size
  from (select *, unnest(range(0, len(path) + 1)) as d from r)
), g as materialized (
  select d, node, case when d > 0 then any_value(up) end as up, min(conv_id) as conv_id, count(*) as n_convs, coalesce(any_value(size), 0) as size,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where n = d), '')) as ends_sha256
  from p group by d, node
), kids as (select d - 1 as d, up as node, count(*) as n from g where d > 0 group by 1, 2),
every as materialized (select g.*, coalesce(kids.n, 0) as n_children from g left join kids on kids.d = g.d and kids.node = g.node),
below as (
  select a.d, a.node, sum(case when e.n_children = 0 then 1 else 0 end) as n_leaves, sum((e.n_convs - 1) * e.size) as saved
  from every e join p a on a.conv_id = e.conv_id and a.d <= e.d group by 1, 2
)
select e.conv_id, e.d as depth, u.conv_id as parent_conv_id, e.n_convs, e.n_children, cast(b.n_leaves as bigint) as n_leaves, cast(b.saved as bigint) as saved_tokens, e.ends_sha256
from every e join below b on b.d = e.d and b.node = e.node left join every u on u.d = e.d - 1 and u.node = e.up
"""

#: Cheapest repair of one more turn: options of each state (nothing yet, system, user, assistant), then up to two inserted turns.
_OPTIONS = """list_transform([1, 2, 3, 4], lambda s: list_min(list_filter([
    {'c': 2 + best[s].c, 'a': 'D' || best[s].a},
    case when x <> 'x' then {'c': 1 + late + best[[3, 3, 4, 3][s]].c, 'a': 'R' || best[[3, 3, 4, 3][s]].a} end,
    case when role = [3, 3, 4, 3][s] or (role = 2 and s = 1) then {'c': late + best[role].c, 'a': 'K' || best[role].a} end
  ], lambda o: o is not null)))"""
_INSERTED = """list_transform([1, 2, 3, 4], lambda s: list_min([
    {'c': base[s].c, 'a': base[s].a},
    {'c': 5 + base[[3, 3, 4, 3][s]].c, 'a': 'I' || base[[3, 3, 4, 3][s]].a},
    {'c': 10 + base[[4, 4, 3, 4][s]].c, 'a': 'II' || base[[4, 4, 3, 4][s]].a}
  ]))"""

CONVERSATION_REPAIR = rf"""
with recursive {CRC_TABLE},
f as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as fate from conversations, crc
), t as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role, case when fate = 1 then '' when fate = 2 then translate(text, '.!?', '') else text end as text, unnest(case when fate = 3 then [0, 1] else [0] end) as again
  from f where fate <> 0 and conv_id is not null
), o as (
  select *, row_number() over (partition by conv_id, role, text order by i) as nth from (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last from t
  )
), n as materialized (
  select *, last = '' as blank, last <> '' and nth > 1 as duplicate, last not in ('', '.', '!', '?') and nth = 1 as truncated,
    lag(role[1:1]) over (partition by conv_id order by i) || role[1:1] not in ('su', 'ua', 'au') as illegal,
    case role[1:1] when 's' then 2 when 'u' then 3 when 'a' then 4 end as role_state
  from o
), letters as materialized (
  select conv_id, i, case when blank or duplicate then 'x' else 'o' end as x, case when truncated then 5 else 0 end as late, case when not blank and not duplicate then role_state end as role from n
), step(conv_id, i, best) as (
  select conv_id, max(i), [{{'c': 0::bigint, 'a': ''}}, {{'c': 10::bigint, 'a': 'II'}}, {{'c': 5::bigint, 'a': 'I'}}, {{'c': 0::bigint, 'a': ''}}] from letters group by conv_id
  union all
  select conv_id, i - 1, {_INSERTED} from (select s.conv_id, s.i, {_OPTIONS} as base from step s join letters l on l.conv_id = s.conv_id and l.i = s.i)
), solved as materialized (select conv_id, best[1].c as cost, best[1].a as audit from step where i = 0),
edits as (
  select conv_id, j, audit[j:j] as edit, len(replace(audit[1:j], 'I', '')) as i, len(replace(audit[1:j], 'D', '')) as place from (select conv_id, audit, unnest(range(1, len(audit) + 1)) as j from solved)
), played as (
  select e.*, n.role, n.text, coalesce(max(case when e.edit = 'K' and e.place = 1 and n.role_state = 2 then 1 end) over (partition by e.conv_id), 0) as system
  from edits e left join n on n.conv_id = e.conv_id and n.i = e.i and e.edit <> 'I' where e.edit <> 'D'
), repaired as (
  select conv_id, string_agg(case when edit = 'K' then role when (place - system) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by j) as whole from played group by conv_id
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where duplicate) as duplicate,
    count(*) filter (where truncated) as truncated, count(*) filter (where illegal) as illegal from n group by conv_id
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id from conversations where conv_id is not null) c left join counts using (conv_id) left join solved using (conv_id) left join repaired using (conv_id)
"""

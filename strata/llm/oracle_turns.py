"""DuckDB SQL of the queries over conversations, and of the audit of filters."""

from __future__ import annotations

# a text in the template: one character more for each backslash and each control string, and the marks around it
_ESCAPED = r"length({0}) + len(regexp_extract_all({0}, '\\|</?s>|\[/?INST\]'))"
_ROLE, _TEXT = (_ESCAPED.format(c) for c in ("role", "text"))

OP11 = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first) filter (where role = 'assistant'), '')) as loss_sha256,
    sum({_ROLE} + {_TEXT} + length('[INST][/INST]</s>'))::bigint as formatted_chars
from t group by conv_id"""

# CRC-32 of a short ASCII string, bit by bit
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::ubigint)), lambda a, b: "
    "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda c, x: xor(c >> 1, (c & 1) * 3988292384::ubigint))), 4294967295::ubigint)"
)


def _after(q: int) -> int:
    """The state that an inserted or renamed turn leads to."""
    return 3 if q == 2 else 2


def op12() -> str:
    """Costs to go by a recursion from the last turn, then a walk by a recursion from the first. Turns are numbered from 1 a conversation."""
    keeps = {0: "case ini when 's' then j1 when 'u' then j2 end", 1: "case ini when 'u' then j2 end", 2: "case ini when 'a' then j3 end", 3: "case ini when 'u' then j2 end"}
    stay = "case when fault not in ('blank', 'duplicate') then {0} end"
    base = lambda q: f"least(2 + j{q}, {stay.format(f'trunc + {keeps[q]}')}, {stay.format(f'1 + trunc + j{_after(q)}')}) as b{q}"
    target = "case when q = 2 then 3 else 2 end"
    return rf"""
with recursive r as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {_CRC.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations),
g as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(range(case when kind = 3 then 2 else 1 end)) as copy from r where kind <> 0),
p as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as k,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last from g),
f as (select *, case when last = '' then 'blank' when k > 1 then 'duplicate' when last not in ('.', '!', '?') then 'truncated' else '' end as fault, left(role, 1) as ini,
        lag(left(role, 1)) over (partition by conv_id order by i) as ini_before from p),
m as (select *, case when fault = 'truncated' then 5 else 0 end as trunc from f),
n as (select conv_id, coalesce(max(i), 0) as n from (select distinct conv_id from conversations) left join m using (conv_id) group by 1),
back as (select conv_id, n + 1 as i, 0 as j0, 10 as j1, 5 as j2, 0 as j3 from n union all
    select conv_id, i, least(b0, 5 + b2, 10 + b3), least(b1, 5 + b2, 10 + b3), least(b2, 5 + b3), least(b3, 5 + b2) from
        (select m.conv_id, m.i, {", ".join(map(base, range(4)))} from back join m on m.conv_id = back.conv_id and m.i = back.i - 1)),
j as (select back.conv_id, back.i, [j0, j1, j2, j3] as here, lead([j0, j1, j2, j3]) over (partition by back.conv_id order by back.i) as next, role, text, ini, fault, trunc
    from back left join m on m.conv_id = back.conv_id and m.i = back.i),
walk as (select conv_id, 1::bigint as i, 0 as q, '' as audit, []::varchar[] as said from n union all
    select conv_id, i + case when edit = 'I' then 0 else 1 end, case edit when 'D' then q when 'K' then case ini when 's' then 1 when 'u' then 2 else 3 end else {target} end, audit || edit,
        case edit when 'D' then said when 'K' then list_append(said, role || ':' || text) when 'R' then list_append(said, forced || ':' || text) else list_append(said, forced || ':') end from
        (select *, case when q = 2 then 'assistant' else 'user' end as forced, case when next is not null and 2 + next[q + 1] = here[q + 1] then 'D'
            when 5 + here[{target} + 1] = here[q + 1] then 'I' when q in (0, 1, 3) and ini = 'u' and fault not in ('blank', 'duplicate') and trunc + next[3] = here[q + 1] then 'K'
            when q = 0 and ini = 's' and fault not in ('blank', 'duplicate') and trunc + next[2] = here[1] then 'K' when q = 2 and ini = 'a' and fault not in ('blank', 'duplicate') and trunc + next[4] = here[3] then 'K'
            else 'R' end as edit from walk join j using (conv_id, i) where not (next is null and here[q + 1] = 0))),
done as (select conv_id, arg_max(audit, length(audit)) as audit, arg_max(said, length(audit)) as said from walk group by 1)
select n.conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
    count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where ini_before is not null and ini_before || ini not in ('su', 'ua', 'au')) as illegal,
    any_value(back.j0)::bigint as cost, any_value(audit) as audit, sha256(coalesce(array_to_string(any_value(said), chr(10)), '')) as repaired_sha256
from n join done using (conv_id) join back on back.conv_id = n.conv_id and back.i = 1 left join m on m.conv_id = n.conv_id group by n.conv_id"""


OP13 = r"""
with recursive d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
k as (select doc_id, part, case when len(w) < 100 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end
    + case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) then 4 else 0 end + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end as mask from d),
l as (select doc_id, max((quality is not distinct from 1)::int) as good, max((toxic is not distinct from 1)::int) as toxic from labels group by 1),
c as (select part, mask, count(*) as n, coalesce(sum(good), 0) as n_good, coalesce(sum(toxic), 0) as n_toxic from k left join l using (doc_id) group by 1, 2),
o as (select '' as filter_order union all select filter_order || f from o, unnest(['A', 'B', 'C', 'D', 'E']) t(f) where not contains(filter_order, f)),
s as (select filter_order, unnest(range(1, 6)) as step from o where length(filter_order) = 5),
b as (select filter_order, step, substr(filter_order, step, 1) as f, (1 << (ascii(substr(filter_order, step, 1)) - 65))::int as bit,
    coalesce(list_sum(list_transform(string_split(left(filter_order, step - 1), ''), lambda x: case when x = '' then 0 else 1 << (ascii(x) - 65) end)), 0)::int as earlier from s),
a as (select part, filter_order, step, f, sum(n) filter (where mask & (bit | earlier) = 0) as kept, sum(n) filter (where mask & bit > 0 and mask & earlier = 0) as removed,
    sum(n) filter (where mask & bit > 0 and mask & earlier > 0) as redundant, sum(n) filter (where mask = bit) as unique_fails,
    sum(n_good) filter (where mask & bit > 0 and mask & earlier = 0) as good_lost, sum(n_toxic) filter (where mask & bit > 0 and mask & earlier = 0) as toxic_lost
    from c cross join b group by 1, 2, 3, 4)
select part, filter_order, step::integer as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
    coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, coalesce(sum(removed) over (partition by part, f), 0)::bigint as shapley from a"""

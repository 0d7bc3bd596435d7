"""DuckDB SQL of the queries that SQL can express, over whole tables and texts."""

from __future__ import annotations

from strata.llm.mixing import Mix
from strata.llm.oracle_turns import OP11, OP13, op12
from strata.llm.quality_rules import Limits

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
with recursive d as (select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, array_to_string(list_slice(w, i, least(i + 2, len(w))), ' ') as s from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
r as (select doc_id as a, doc_id as c from d union select r.a, e.b from r join e on e.a = r.c)
select doc_id, coalesce(n.n, 0) as n_shingles, c as component_id, doc_id = c as kept from d left join n using (doc_id) join (select a, min(c) as c from r group by 1) on a = doc_id"""


def op4(mix: Mix = Mix()) -> str:
    weights = ", ".join(map(str, mix.weights))
    hashed = lambda *parts: f"substr(md5(concat_ws('|', '{mix.seed}', {', '.join(parts)})), 1, 16)"
    return rf"""
with d as (select doc_id, source, len({WORDS}) as size, substr(md5(concat_ws('|', '{mix.seed}', doc_id)), 1, 16) as h from documents),
k as (select *, substr(h, 1, {mix.block_digits}) as block from d),
s as (select source, sum(size)::bigint as source_size, list_value({weights})[cast((row_number() over (order by source nulls last) - 1) % {len(mix.weights)} + 1 as integer)]::double as weight from k group by 1),
m as (select *, ({mix.max_passes} * source_size)::double as most from s),
l as (select *, (sum(source_size) over () * {mix.percent} / 100.0 - coalesce(sum(most) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level from m
    window w as (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding)),
v as (select first(level order by most / weight, source nulls last) as level from l where level * weight <= most),
t as (select source, source_size, least(most, coalesce((select level from v) * weight, most)) as target from l),
b as (select source, block, sum(size)::bigint as size from k group by 1, 2),
q as (select b.*, source_size, target, case when source_size > 0 then floor(target / source_size) else 0 end as passes from b join t on b.source is not distinct from t.source),
u as (select *, target - passes * source_size as rest from q),
o as (select *, rest - (sum(size) over (partition by source order by substr(md5(concat_ws('|', '{mix.seed}', coalesce(source, ''), block)), 1, 16), block rows unbounded preceding) - size) as room from u),
z as (select *, case when room >= size and rest > 0 then 'all' when room > 0 then 'cut' end as part from o),
c as (select z.source, z.block, room, h, sum(k.size) as size from k join z on k.source is not distinct from z.source and k.block = z.block and part = 'cut' group by 1, 2, 3, 4),
x as (select source, block, max(h) as cut, max(upto) as got from (select *, sum(size) over (partition by source, block order by h rows unbounded preceding) as upto from c) where upto - size / 2 <= room group by 1, 2),
y as (select z.*, case part when 'all' then 'g' when 'cut' then x.cut end as cut, case part when 'all' then size when 'cut' then coalesce(got, 0) else 0 end as got from z left join x on z.source is not distinct from x.source and z.block = x.block),
a as (select *, rest - sum(got) over (partition by source) as short from y),
f as (select k.source, k.block, k.h, k.size, short from k join a on k.source is not distinct from a.source and k.block = a.block where rest > 0 and (cut is null or h > cut)),
i as (select source, short, min((abs(short - size), h, block)) as best from f group by 1, 2),
j as (select f.source, f.block, f.h as last, f.short from f join i on f.source is not distinct from i.source and f.h = best[2] and f.block = best[3] group by all having abs(f.short - sum(f.size)) < abs(f.short)),
    pl as (select a.source, a.block, passes, cut, last from a left join j on a.source is not distinct from j.source and a.block = j.block),
    un as (select source, block, draw from (select *, unnest(range(0, passes::bigint + 1)) as draw from pl) where draw < passes or cut is not null or last is not null),
    rk as (select *, row_number() over (partition by source order by {hashed("'unit'", "coalesce(source, '')", "block", "draw")}, block, draw) as place from un),
    t0 as (select 0 as shard, list({{'source': source, 'n': n}} order by source nulls last) as q from (select source, count(*) as n from un group by 1)),
    {_tree(mix, hashed)},
    sq as (select shard, x.source as source, sum(x.n) over (partition by x.source order by shard) as fin, x.n as n from (select shard, unnest(q) as x from t{mix.shards.bit_length() - 1})),
    us as (select rk.source, block, draw, shard from rk join sq on rk.source is not distinct from sq.source and place > fin - n and place <= fin),
    dl as (select source, block, list(shard order by draw) as shards from us group by 1, 2),
    e as (select k.doc_id, k.size, k.source, passes + case when h <= cut or h = last then 1 else 0 end as times, shards, s.source_size, t.target from k join pl on k.source is not distinct from pl.source and k.block = pl.block
        left join dl on k.source is not distinct from dl.source and k.block = dl.block join s on k.source is not distinct from s.source join t on k.source is not distinct from t.source)
    select doc_id, size, source_size, target, (size * times)::bigint as taken, coalesce(array_to_string(list_sort(shards[:times::bigint]), ','), '') as shards, source from e"""


def _hypergeometric(total: str, n: str, left: str, u: str) -> str:
    """The quantile that ``mixing.hypergeometric`` gives: weights from one number to the next, and the first that reaches the share."""
    mean = f"({left} * {n} / {total})"
    spread = f"(ceil(12 * sqrt({mean} * (1 - {n} / {total}) * ({total} - {left}) / greatest({total} - 1, 1))) + 12)"
    numbers = f"range(greatest(0, {left} - ({total} - {n}), floor({mean}) - {spread})::bigint, least({n}, {left}, floor({mean}) + {spread})::bigint + 1)"
    weight = f"b.w * (({n} - z.k)::double * ({left} - z.k)) / ((z.k + 1)::double * ({total} - {n} - {left} + z.k + 1))"

    def fold(goal: str) -> str:
        state = f"{{'k': case when b.k < 0 and b.s + b.w >= {goal} then z.k else b.k end, 'w': {weight}, 's': b.s + b.w}}"
        rows = f"list_transform({numbers}, lambda i: {{'k': i, 'w': 0.0::double, 's': 0.0::double}})"
        return f"list_reduce({rows}, lambda b, z: {state}, {{'k': -1::bigint, 'w': 1.0::double, 's': 0.0::double}})"

    return f"({fold(f'({u} * ' + fold('1e308::double') + '.s)')}).k"


def _tree(mix: Mix, hashed) -> str:
    """The splitting tree, level by level: at each node the sources in turn draw what the left half gets."""
    out, width = [], mix.shards
    for level in range(mix.shards.bit_length() - 1):
        width //= 2
        draw = hashed("'split'", str(width), "shard", "coalesce(x.source, '')")
        u = f"((('0x' || {draw}[:12])::bigint::double + 0.5) / 281474976710656.0)"
        k = f"case when acc.total = 0 then 0 else {_hypergeometric('acc.total', 'x.n', 'acc.rest', u)} end"
        state = "{{'source': {0}, 'n': {1}, 'total': {2}, 'rest': {3}, 'got': {4}}}".format
        rows = f"list_transform(q, lambda y: {state('y.source', 'y.n::bigint', '0::bigint', '0::bigint', '[]::bigint[]')})"
        begin = state("null::varchar", "0::bigint", "total::bigint", "half::bigint", "[]::bigint[]")
        fold = f"list_reduce({rows}, lambda acc, x: {state('null::varchar', '0::bigint', 'acc.total - x.n', f'(acc.rest - {k})::bigint', f'list_append(acc.got, ({k})::bigint)')}, {begin}).got"
        odd = f"(('0x' || {hashed(str(width), 'shard')}[:1])::bigint % 2)"
        out.append(f"""c{level} as (select shard, q, total, ((total + {odd}) // 2)::bigint as half from (select *, list_sum(list_transform(q, lambda y: y.n))::bigint as total from t{level})),
    g{level} as (select shard, q, {fold} as got from c{level}),
    t{level + 1} as (select shard, list_transform(list_zip(q, got), lambda z: {{'source': z[1].source, 'n': z[2]::bigint}}) as q from g{level}
        union all select shard + {width}, list_transform(list_zip(q, got), lambda z: {{'source': z[1].source, 'n': (z[1].n - z[2])::bigint}}) from g{level})""")
    return ",\n    ".join(out)


OP5 = rf"""
with w as (select item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
n as (select item_id, w, least(13, len(w)) as n from w where len(w) > 0),
v as (select distinct item_id::varchar as item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as s from (select *, unnest(generate_series(1, len(w) - n + 1)) as i from n)),
d as (select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d cross join (select distinct n from v) where len(w) >= n),
m as (select doc_id, i, p.n, item_id from p join v on v.n = p.n and v.s = array_to_string(list_slice(w, i, i + p.n - 1), ' ')),
h as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as k from m) group by 1),
t as (select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256 from (select distinct doc_id, item_id from m) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join h using (doc_id) left join t using (doc_id)"""

OP6 = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= 100 and page_id <> first then first end as refers_to from f"""

OP8 = rf"""
with d as (select doc_id, {WORDS} as w from documents),
v as (select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as s from (select *, unnest(generate_series(1, len(w) - 12)) as i from d where len(w) > 12)),
f as (select s, min(doc_id) as first from v group by 1),
c as (select distinct doc_id, unnest(generate_series(i, i + 12)) as k from v join f using (s) where doc_id > first),
e as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as k from d),
g as (select doc_id, count(c.k) as n_removed, string_agg(word, ' ' order by e.k) filter (where c.k is null) as kept from e left join c using (doc_id, k) group by 1)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join g using (doc_id)"""


def op10(limits: Limits = Limits()) -> str:
    classes = [r"\p{Ll}", r"\p{Lu}", "[0-9]", r"[\x09-\x0D\x20]", r"[.,;:!?''\"()\-]", "[#*$%&|<>]"]
    chars = ", ".join(f"length(text) - length(regexp_replace(text, '{c}+', '', 'g'))" for c in classes)
    share = lambda v: f"list_transform({v}, lambda x: floor(x * 1000000 / greatest(list_sum({v}), 1)))"
    sums = lambda v, n: "[" + ", ".join(f"sum({v}[{i + 1}])" for i in range(n)) + "]"
    term = "(case when x > 0 then x * log2(x / ((x + y) / 2)) else 0 end + case when y > 0 then y * log2(y / ((x + y) / 2)) else 0 end) / 2"
    distance = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {term.replace('x', 'z[1]/greatest(list_sum(' + p + '),1)').replace('y', 'z[2]/greatest(list_sum(' + q + '),1)')}))))"
    w, n = limits.window, limits.common + 1
    part, fewer = limits.least_common, f"list_transform(rw[:{n - 1}], lambda i: i * {limits.least_common})"
    return rf"""
with d as (select doc_id, lang, coalesce(text, '') as text, {WORDS} as w from documents),
t as (select *, regexp_extract_all(lower(text), '\p{{L}}+') as t, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
nl as (select lang, count(*) as n from documents where lang is not null group by 1),
wc as (select lang, word, count(*) as n from (select lang, unnest(list_distinct(t)) as word from t where lang is not null) group by 1, 2),
ll as (select lang, list(word order by place) as listed from (select *, row_number() over (partition by lang order by n desc, word) as place from wc) where place <= {limits.common}
    and lang in (select lang from nl where n * {limits.most_languages} >= (select sum(n) from nl)) group by 1),
bl as (select doc_id, max((hits, ll.lang)) as best from (select doc_id, t from t where lang is null) o cross join ll cross join lateral (select len(list_filter(o.t, lambda x: list_contains(ll.listed, x))) as hits) group by 1),
l as (select t.*, case when t.lang in (select lang from ll) then t.lang when best[1] > 0 then best[2] end as l from t left join bl using (doc_id)),
c as (select l.*, [{chars}] as cc, listed || list_transform(range({limits.common} - len(listed)), lambda x: '') as common from l left join ll on l.l = ll.lang),
h as (select *, list_append(cc, length(text) - list_sum(cc)) as chars, list_transform(common, lambda k: len(list_filter(t, lambda x: x = k))) as hit from c),
m as (select *, list_append(hit, len(t) - list_sum(hit)) as words from h),
r as (select l as rl, {sums(share('chars'), len(classes) + 1)} as rc, {sums(share('words'), n)} as rw from m where l is not null and len(t) >= {limits.min_judged} group by 1),
v as (select doc_id, i, array_to_string(list_slice(w, i, i + {w - 1}), ' ') as s from (select doc_id, w, unnest(generate_series(1, len(w) - {w - 1})) as i from d where len(w) >= {w})),
o as (select doc_id, count(distinct k) as n_repeat from (select doc_id, unnest(generate_series(i, i + {w - 1})) as k from (select *, count(*) over (partition by doc_id, s) as n from v) where n > 1) group by 1),
b as (select m.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat, 0) as n_repeat_words, case when rl is not null and len(w) >= {limits.min_judged} then {distance('chars', 'rc')} end as dc,
    case when rl is not null and len(w) >= {limits.min_judged} then {distance('words', 'rw')} end as dw,
    1 - rw[{n}] / greatest(list_sum(rw), 1) as ref_share, len(t) as n_letters, 1 - words[{n}] / greatest(len(t), 1) as own_share, {distance('lw', 'rw')} as lim from m left join (select *, list_append({fewer}, list_sum(rw) - list_sum({fewer})) as lw from r) r on l = rl left join o on o.doc_id = m.doc_id),
f as (select *, n_words < {limits.min_words} or 100 * n_repeat_words > {limits.max_repeat_percent} * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(dc, 0) <= {limits.max_char_distance} and coalesce(dw, 0) <= case when ref_share * n_letters >= {limits.min_expected} and own_share < ref_share then least(lim, {limits.max_word_distance}) else {limits.max_word_distance} end as kept from f"""


ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": OP1, "op4_mixing": op4(), "op5_decontamination": OP5, "op6_warc": OP6, "op8_substring_dedup": OP8, "op10_quality_rules": op10(),
    "op11_chat_tree": OP11, "op12_structure_repair": op12(), "op13_filter_audit": OP13,
}

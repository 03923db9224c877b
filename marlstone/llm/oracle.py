"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

NEAR_DUP = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
sets as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as s from w),
items as (select doc_id, len(s) as n, unnest(s) as v from sets),
shared as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k from items a join items b on a.v = b.v and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from shared where 100 * k >= 85 * (na + nb - k)),
both_ways as (select a, b from links union select b, a from links),
reach as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a)
select sets.doc_id, len(s)::bigint as n_shingles, least(sets.doc_id, coalesce(m, sets.doc_id)) as component_id, least(sets.doc_id, coalesce(m, sets.doc_id)) = sets.doc_id as kept
from sets left join (select a, min(b) as m from reach group by a) on a = doc_id
"""


# The table of crc32 for four bits at a time.
CRC_OF_FOUR_BITS = (
    0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
)


def crc32(text: str) -> str:
    """SQL for the crc32 of an ASCII text."""
    step = f"xor(c >> 4, {list(CRC_OF_FOUR_BITS)}[(xor(c, x) & 15) + 1])"
    bits = f"flatten(list_transform(string_split({text}, ''), lambda d: [ascii(d) & 15, ascii(d) >> 4]))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {bits}), lambda c, x: {step}))"


def _tree(name: str, group: str, first: str, levels: int) -> str:
    """The levels of a tree over ``first`` (group, idx, hash, n); each node of several has a parent 16 times up."""
    by = f"{group}, " if group else ""
    tables = [f"{name}0 as materialized ({first})"]
    for k in range(levels):
        preimage = "string_agg(hash, '' order by idx)"
        tables.append(f"{name}{k + 1} as materialized (select {by}idx // 16 as idx, (max(n) + 15) // 16 as n, {preimage} as preimage, sha256({preimage}) as hash from {name}{k} where n > 1 group by {by}idx // 16)")
    return ",\n".join(tables)


def _climb(name: str, group: str, start: str, levels: int) -> str:
    """From ``start`` (…, idx, n, sibs, fold) to the last node, level by level."""
    on = f"p.{group} is not distinct from c.{group} and " if group else ""
    tables = [f"{name}c0 as ({start})"]
    for k in range(levels):
        before, after = "substr(preimage, 1, 64 * (c.idx % 16))", "substr(preimage, 64 * (c.idx % 16) + 65)"
        tables.append(
            f"{name}c{k + 1} as materialized (select c.* exclude (idx, n, sibs, fold), c.idx // 16 as idx, coalesce(p.n, c.n) as n, c.sibs || coalesce({before} || {after}, '') as sibs, "
            f"coalesce(sha256({before} || c.fold || {after}), c.fold) as fold from {name}c{k} c left join {name}{k + 1} p on c.n > 1 and {on}p.idx = c.idx // 16)"
        )
    return ",\n".join(tables)


LEVELS, TOP_LEVELS = 6, 4
_FRAMED = "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MERKLE = f"""
with leaves as (
  select doc_id, source, {_FRAMED.format(text="text")} as leaf, case when coalesce({crc32("doc_id::varchar")} % 5 = 0, false) then {_FRAMED.format(text=_LOWERED)} end as tampered from documents),
{_tree("s", "source", "select *, leaf as hash, row_number() over (partition by source order by doc_id, leaf) - 1 as idx, count(*) over (partition by source) as n from leaves", LEVELS)},
subroots as (select source, hash as subroot from ({" union all ".join(f"select source, hash, n from s{k}" for k in range(LEVELS + 1))}) where n = 1),
{_tree("t", "", "select *, subroot as hash, row_number() over (order by source nulls first) - 1 as idx, count(*) over () as n from subroots", TOP_LEVELS)},
roots as (select hash as root from ({" union all ".join(f"select hash, n from t{k}" for k in range(TOP_LEVELS + 1))}) where n = 1),
{_climb("s", "source", "select doc_id, source, leaf, idx, n, '' as sibs, coalesce(tampered, leaf) as fold from s0", LEVELS)},
{_climb("t", "", f"select c.doc_id, c.leaf, t0.subroot, t0.idx, t0.n, c.sibs, c.fold from sc{LEVELS} c join t0 on t0.source is not distinct from c.source", TOP_LEVELS)}
select doc_id, leaf, subroot, root, sha256(sibs) as proof_sha256, fold as folded_root, fold = root as verified from tc{TOP_LEVELS}, roots
"""

WARC = """
with p as (select page_id, coalesce(html, '') as payload, min(page_id) over (partition by coalesce(html, '')) as first from pages),
d as (select *, strlen(payload) >= 100 and page_id is distinct from first as again from p)
select page_id, strlen(payload)::bigint as payload_bytes, sha256(payload) as payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then first end as refers_to from d
"""


def _clusters(rounds: int) -> str:
    far = "list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    tables = [
        "kept as materialized (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        "c0 as materialized (select row_number() over (order by sha256('3:' || vec_id), v) - 1 as k, v as c from kept qualify k < 8)",
    ]
    for i in range(rounds + 1):
        best = "arg_min(c.k, [dist, c.k])"
        tables.append(f"a{i} as materialized (select row, any_value(vec_id) as vec_id, any_value(v) as v, {best}::int as cluster, min(dist) as distance from (select v.row, v.vec_id, v.v, c.k, {far} as dist from kept v cross join c{i} c) c group by row)")
        if i < rounds:
            parts = f"select cluster, place, sum(x)::bigint as s, count(*) as n from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as place from a{i}) group by cluster, place"
            tables.append(f"m{i} as (select cluster, list((s - ((s % n) + n) % n) // n order by place) as c from ({parts}) group by cluster)")
            tables.append(f"c{i + 1} as materialized (select o.k, coalesce(m.c, o.c) as c from c{i} o left join m{i} m on m.cluster = o.k)")
    return (
        "with "
        + ",\n".join(tables)
        + f"\nselect vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from a{rounds} join c{rounds} on k = cluster"
    )


CLUSTERS = _clusters(10)

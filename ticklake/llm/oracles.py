"""SQL of the queries that SQL can state whole."""

from __future__ import annotations


def _tree(of: str, leaves: str) -> str:
    """CTEs over ``leaves`` (tree, pos, digest, n): all nodes, and the digests left and right of each that isn't a root."""
    return f"""{of}_nodes(tree, level, pos, digest, n) as (
  select tree, 0, pos, digest, n from {leaves}
  union all
  select tree, level + 1, pos // 16, sha256(string_agg(digest, '' order by pos)), (n + 15) // 16 from {of}_nodes where n > 1 group by tree, level, pos // 16, n
), {of}_roots as (
  select tree, digest from {of}_nodes where n = 1
), {of}_sides as (
  select tree, level, pos, coalesce(string_agg(digest, '') over (run rows between unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(digest, '') over (run rows between 1 following and unbounded following), '') as r
  from {of}_nodes where n > 1 window run as (partition by tree, level, pos // 16 order by pos)
)"""


_FIELDS = "".join(f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end || " for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT = "case when {0} is null then '-' else strlen({0}) || ':' || {0} end"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = f"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), docs as (
  select doc_id, source as tree, sha256({_FIELDS}{_TEXT.format("text")}) as leaf,
    doc_id is not null and xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 5 = 0 as tampered,
    sha256({_FIELDS}{_TEXT.format(_LOWER)}) as lowered
  from documents, crc
), leaves as (
  select tree, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, leaf as digest, count(*) over (partition by tree) as n, doc_id, case when coalesce(tampered, false) then lowered else leaf end as now from docs
), {_tree("low", "leaves")}, tops as (
  select 0 as tree, row_number() over (order by tree nulls first) - 1 as pos, digest, count(*) over () as n, tree as name from low_roots
), {_tree("top", "tops")}, climb(tree, leaf_pos, level, pos, proof, own) as (
  select tree, pos, 0, pos, '', now from leaves
  union all
  select c.tree, c.leaf_pos, c.level + 1, c.pos // 16, c.proof || s.l || s.r, sha256(s.l || c.own || s.r) from climb c join low_sides s on s.tree is not distinct from c.tree and s.level = c.level and s.pos = c.pos
), grown as (
  select tree, leaf_pos, arg_max(proof, level) as proof, arg_max(own, level) as own from climb group by tree, leaf_pos
), ascend(tree, leaf_pos, level, pos, proof, own) as (
  select g.tree, g.leaf_pos, 0, t.pos, g.proof, g.own from grown g join tops t on t.name is not distinct from g.tree
  union all
  select c.tree, c.leaf_pos, c.level + 1, c.pos // 16, c.proof || s.l || s.r, sha256(s.l || c.own || s.r) from ascend c join top_sides s on s.level = c.level and s.pos = c.pos
), done as (
  select tree, leaf_pos, arg_max(proof, level) as proof, arg_max(own, level) as own from ascend group by tree, leaf_pos
)
select l.doc_id, l.digest as leaf, b.digest as subroot, r.digest as root, sha256(d.proof) as proof_sha256, d.own as folded_root, d.own = r.digest as verified
from leaves l join low_roots b on b.tree is not distinct from l.tree join done d on d.tree is not distinct from l.tree and d.leaf_pos = l.pos, top_roots r
"""

OP13_SQL = """
with rows as (
  select page_id, coalesce(html, '') as body from pages
), bits as (
  select page_id, body, sha1(body) as hex, list_aggregate(list_transform(string_split(sha1(body), ''), lambda h: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', h)]), 'string_agg', '') as bits from rows
), named as (
  select page_id, strlen(body) as payload_bytes, min(page_id) over (partition by body) as first,
    list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(string_split(substr(bits, 5 * k + 1, 5), ''), lambda b: b::int), lambda a, b: 2 * a + b), 1)), 'string_agg', '') as payload_digest
  from bits
)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from named
"""

OP11_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), numbered as (
  select lang, row_number() over () as p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces
), grams as (
  select lang, k, w[i:i + k - 1] as g from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from (select lang, w, unnest([1, 2, 3, 4, 5]) as k from numbered) where len(w) >= k)
), counts as (
  select lang, k, g, count(*) as f from grams group by all
), totals as (
  select lang, sum(f)::bigint as n from counts where k = 1 group by lang
), found as (
  select lang, k, g, f from counts where k > 1 and f >= 100
), inner_ as (
  select lang, part, max(f) as longer from (select lang, f, unnest([g[1:k - 1], g[2:k]]) as part from found where k > 2) group by all
), cuts as (
  select c.lang, c.g, c.f as a, t.n, j, l.f as l, r.f as r, (1000::hugeint * c.f * t.n) // (l.f::hugeint * r.f) as score
  from (select *, unnest(range(1, k)) as j from found) c join totals t on t.lang = c.lang join counts l on l.lang = c.lang and l.g = c.g[1:j] join counts r on r.lang = c.lang and r.g = c.g[j + 1:]
  left join inner_ i on i.lang = c.lang and i.part = c.g where i.part is null or 100 * i.longer < 100 * c.f
), scored as (
  select lang, array_to_string(g, ' ') as phrase, a, n, min((score, j, l, r)) as best from cuts group by lang, g, a, n
), ranked as (
  select lang, phrase, a, best[3] as l, best[4] as r, n, best[1]::bigint as score, row_number() over (partition by lang order by best[1] desc, a desc, phrase) as rank from scored
)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""

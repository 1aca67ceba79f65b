"""SQL (DuckDB) of the operators over whole documents whose results SQL can say."""

from __future__ import annotations

#: The words of a text, A-Z in lower case.
LOWER_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '')"


def classes(width: int, at_least: int, kept: str = "") -> str:
    """Components of documents whose sets of shingles link; ids are unique."""
    return rf"""
with recursive d as (select doc_id, {LOWER_WORDS} as w from documents),
e as (select doc_id, case when len(w) = 0 then [] when len(w) < {width} then [w] else list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: list_slice(w, i, i + {width} - 1))) end as s from d),
n as (select doc_id, len(s)::bigint as n_shingles from e),
t as (select doc_id, md5_number(array_to_string(unnest(s), ' ')) as x from e),
p as (select a.doc_id as u, b.doc_id as v, count(*) as shared from t a join t b using (x) where a.doc_id <> b.doc_id group by 1, 2),
l as (select u, v from p join n a on a.doc_id = u join n b on b.doc_id = v where 100 * shared >= {at_least} * (a.n_shingles + b.n_shingles - shared)),
r as (select doc_id as node, doc_id as root from n union select l.v, r.root from r join l on l.u = r.node and r.root < l.v)
select node as doc_id, n_shingles, min(root) as component_id{kept} from r join n on n.doc_id = node group by node, n_shingles
"""


#: CRC-32 of an id as text: a step of 0 to 255 takes a byte in, one of 256 shifts.
CRC = "(4294967295 - list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda c: [ascii(c)::bigint, 256, 256, 256, 256, 256, 256, 256, 256]))), lambda h, x: case when x < 256 then xor(h, x) when h % 2 = 1 then xor(h // 2, 3988292384) else h // 2 end))"


def leaf(text: str) -> str:
    part = lambda c: f"case when {c} is null then '-' else octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar end"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Trees level by level, the digests beside each node, and a walk from every claimed leaf to the root of all.
MERKLE = f"""
with recursive raw as (
  select doc_id, coalesce('s' || source, '') as g, {leaf('text')} as leaf, {CRC} % 2 = 0 as cut,
         {leaf("replace(text, chr(10), '')")} as other from documents),
leaves as (select *, case when cut then other else leaf end as claimed, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as n, leaf as h from raw),
nodes as (
  select g, 0 as level, pos, n, h from leaves
  union all
  select g, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from nodes where n > 1 group by g, level, pos // 3, n),
tops as (select g, h as subroot, row_number() over (order by g) - 1 as pos, count(*) over () as n from nodes where n = 1),
above as (
  select 0 as level, pos, n, subroot as h from tops
  union all
  select level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from above where n > 1 group by level, pos // 3, n),
steps as (
  select a.g, 0 as tree, a.level, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as before, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as after
  from nodes a join nodes b on a.g = b.g and a.level = b.level and a.pos // 3 = b.pos // 3 where a.n > 1 group by a.g, a.level, a.pos
  union all
  select null, 1, a.level, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), ''), coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '')
  from above a join above b on a.level = b.level and a.pos // 3 = b.pos // 3 where a.n > 1 group by a.level, a.pos),
walk as (
  select l.g, l.pos as own, 0 as tree, 0 as level, l.pos, l.n, t.pos as place, t.n as groups, l.claimed as node, '' as seen from leaves l join tops t using (g)
  union all
  select w.g, own, case when w.n = 1 then 1 else w.tree end, case when w.n = 1 then 0 else w.level + 1 end, case when w.n = 1 then place else w.pos // 3 end,
         case when w.n = 1 then groups else (w.n + 2) // 3 end, place, groups, case when w.n = 1 then node else sha256(s.before || node || s.after) end, case when w.n = 1 then seen else seen || s.before || s.after end
  from walk w left join steps s on s.tree = w.tree and s.level = w.level and s.pos = w.pos and (s.g = w.g or w.tree = 1) where not (w.tree = 1 and w.n = 1)),
ends as (select g, own, node, seen from walk where tree = 1 and n = 1)
select doc_id, leaf, subroot, root, sha256(seen) as proof_sha256, node as folded_root, node = root as verified
from ends join leaves on leaves.g = ends.g and leaves.pos = own join tops on tops.g = ends.g, (select h as root from above where n = 1)
"""

#: Terms, kept ones by language, shares, pairs of sources and terms in which a source exceeds its language.
DIVERGENCE = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') as w from documents),
o as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*) as n from o group by lang, term having count(distinct r) >= 30),
l as (select lang, count(*) as v, sum(n) as n from k group by lang),
c as (select o.lang, source, term, count(*) as n from o join k using (lang, term) group by all),
m as (select lang, source, sum(n) as n from c group by all),
g as (select distinct d.lang, d.source, coalesce(m.n, 0)::hugeint as n, coalesce(v, 0)::hugeint as v from d left join m using (lang, source) left join l on l.lang = d.lang),
s as (select g.lang, g.source, term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) as p, 1 + (1000000000::hugeint * (k.n + 5)) // (l.n + 5 * g.v) as q
  from g join k using (lang) join l using (lang) left join c using (lang, source, term)),
f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from s where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 50
"""

from llm.prefix_trie import prefix_trie


def trie(spark, sf_dir):
    """Every node of the prefix trie of all rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: CRC-32 of the decimal id, bit by bit: polynomial, start and final value are those of the standard.
CRC = """(list_reduce([4294967295] || list_transform(range(length(cast(conv_id as varchar))),
    lambda k: cast(ascii(substr(cast(conv_id as varchar), cast(k + 1 as bigint), 1)) as bigint)),
  lambda c, b: list_reduce([xor(c, b)] || range(8),
    lambda r, _k: case when r % 2 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)))"""
TRIE_SQL = f"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, cast(row_number() over (partition by conv_id
    order by turn nulls first, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) as bigint) - 1 as pos
  from conversations where conv_id is not null
), c as (
  select conv_id, conv_id - conv_id % 20 as base, xor({CRC}, 4294967295) % 4 as h from (select distinct conv_id from t)
), r as (
  select c.conv_id, 0 as part, t.pos, t.role, t.text from c join t on t.conv_id = c.base where t.pos < c.h
  union all
  select c.conv_id, 1, t.pos, t.role, t.text from c join t on t.conv_id = c.conv_id where t.pos >= c.h
), s as (
  select c.conv_id, coalesce(list({{'role': r.role, 'text': r.text}} order by r.part, r.pos) filter (where r.part is not null), []) as turns
  from c left join r using (conv_id) group by c.conv_id
), m as (
  select conv_id, d, turns[1:d] as path, turns[1:d - 1] as up, len(turns) = d as ends, case when d = 0 then '' else turns[d].text end as last
  from s, unnest(range(len(turns) + 1)) as u(d)
), n as (
  select path, cast(d as bigint) as depth, any_value(up) as up, any_value(last) as last, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from m group by path, d
), k as (
  select a.path, a.depth, count(b.depth) as n_children from n a left join n b on b.depth = a.depth + 1 and b.up = a.path group by a.path, a.depth
), v as (
  select n.*, k.n_children, (n_convs - 1) * len(regexp_extract_all(last, '[^\\x20\\x09-\\x0D]+')) as saved from n join k using (path, depth)
), sums as (
  select a.path, a.depth, cast(sum(case when b.n_children = 0 then 1 else 0 end) as bigint) as n_leaves, cast(sum(b.saved) as bigint) as saved_tokens
  from v a join v b on b.depth >= a.depth and b.path[1:a.depth] = a.path group by a.path, a.depth
)
select v.conv_id, v.depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, sums.n_leaves, sums.saved_tokens, v.ends_sha256
from v join sums using (path, depth) left join n p on p.depth = v.depth - 1 and p.path = v.up
"""

QUERIES = {"op12_prefix_trie": trie}
ORACLE = {"op12_prefix_trie": TRIE_SQL}

"""The registered queries of the operators and, where SQL can express one, its DuckDB SQL.

Token ids, XXH64 fingerprints and trained models are not expressible; the
approximate search is, but only as the exact one. tests/llm holds them against
the tokenizers library, brute force and held-out rows.
"""
from __future__ import annotations

from corpusgate.llm.alignment import op13_token_alignment
from corpusgate.llm.ann import op7_multi_index
from corpusgate.llm.brown import op2_brown_lm
from corpusgate.llm.debruijn import op5_debruijn_dedup
from corpusgate.llm.decontaminate import op9_decontaminate
from corpusgate.llm.jaccard import PERCENT, op12_ngram_jaccard
from corpusgate.llm.language_id import op10_language_id
from corpusgate.llm.mixing import op8_pareto_mix
from corpusgate.llm.simhash import op4_simhash
from corpusgate.llm.token_counts import op1_token_counts
from corpusgate.llm.toxicity import op6_toxicity
from corpusgate.llm.trie import op11_prefix_trie
from corpusgate.llm.wavelet import op3_wavelet_files


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_brown_lm, op3_wavelet_files, op4_simhash, op5_debruijn_dedup,
                                    op6_toxicity, op7_multi_index, op8_pareto_mix, op9_decontaminate, op10_language_id,
                                    op11_prefix_trie, op12_ngram_jaccard, op13_token_alignment)}


WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
NORMAL = (r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])")

ORACLES = {
    "op5_debruijn_dedup": f"""
with w as (select doc_id, {WORDS} as ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13),
win as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as t from p),
f as (select t, min(doc_id) as first_id from win group by t),
cov as (select distinct doc_id, unnest(range(i, i + 13)) as j from win join f using (t) where first_id < doc_id),
each as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j from w),
kept as (select doc_id, string_agg(word, ' ' order by j) as t from each anti join cov using (doc_id, j) group by doc_id),
gone as (select doc_id, count(*) as n from cov group by doc_id)
select w.doc_id, len(ws) as n_words, coalesce(gone.n, 0) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from w left join kept using (doc_id) left join gone using (doc_id)""",
    "op8_pareto_mix": f"""
with sz as (select doc_id, source, len({WORDS}) as size,
    (cast('0x' || substr(md5('mix:' || cast(doc_id as varchar)), 1, 13) as bigint) + 0.5e0) / 4503599627370496e0 as u
  from documents),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place
       from sz group by source),
s1 as (select *, [5e0, 2e0, 1e0][(place - 1) % 3 + 1] as weight, 3 * source_size as stop_size from s0),
s2 as (select *, stop_size / weight as stop_level,
         ((select sum(source_size) from s1) - coalesce(sum(stop_size) over (o rows between unbounded preceding and 1 preceding), 0))
           / sum(weight) over (o rows between current row and unbounded following) as level
       from s1 window o as (order by stop_size / weight, place)),
l as (select arg_min(level, [stop_level, place]) as level from s2 where level <= stop_level),
s3 as (select s2.source, source_size, least(stop_size::double, coalesce(l.level * weight, stop_size)) as target
       from s2, l),
s4 as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from s3),
s5 as (select *, target - whole * source_size as rest from s4),
c as (select source, sqrt(pow(2e0, length(bin(size)) - 1)) as w, sum(size) as class_words from sz where size > 0
      group by 1, 2),
k as (select c.source, w, (rest - (source_size - sum(class_words) over o)) / sum(class_words * w) over o as kappa
      from c join s5 on c.source is not distinct from s5.source
      window o as (partition by c.source order by w rows unbounded preceding)),
kk as (select source, greatest(arg_max(kappa, w), 0e0) as kappa from k where kappa * w <= 1 group by source),
r as (select sz.*, s5.source_size, s5.target, s5.whole, s5.rest,
        least(coalesce(kk.kappa, 0e0) * sqrt(pow(2e0, length(bin(size)) - 1)), 1e0) as chance
      from sz join s5 on sz.source is not distinct from s5.source
      left join kk on kk.source is not distinct from sz.source),
q as (select *, case when size > 0 and chance > 0 then u * (1e0 - chance) / (u * (1e0 - chance) + chance * (1e0 - u)) else 1e0 end as p
      from r),
t as (select *, sum(size) over (partition by source order by case when size > 0 then 0 else 1 end, p, doc_id) as upto from q)
select doc_id, size, source_size, target, (case when size > 0 then size
  * (whole + case when rest > 0 and upto - size / 2 <= rest then 1 else 0 end) else 0 end)::bigint as taken
from t""",
    "op9_decontaminate": f"""
with d as (select doc_id, {NORMAL} as ws from documents),
b as (select cast(item_id as varchar) as item_id, {NORMAL} as ws from benchmark),
bw as (select distinct item_id, least(10, len(ws)) as k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') as t
       from (select *, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from b where len(ws) > 0) x),
dw as (select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') as t
       from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i
             from d, (select distinct k from bw) ks where len(ws) >= k) x),
hits as (select distinct dw.doc_id, dw.i, dw.k, bw.item_id from dw join bw using (k, t)),
cov as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + k)) as j from hits) x group by doc_id),
items as (select doc_id, count(distinct item_id) as n, string_agg(distinct item_id, ',' order by item_id) as ids
          from hits group by doc_id)
select d.doc_id, len(ws) as n_words, coalesce(cov.n, 0) as n_hit, coalesce(items.n, 0) as n_items,
  sha256(coalesce(items.ids, '')) as items_sha256, coalesce(cov.n, 0) > 0 as contaminated
from d left join cov using (doc_id) left join items using (doc_id)""",
    # crc32 bit by bit; a node is the list of its turns
    "op11_prefix_trie": """
with t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id
    order by turn nulls first, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as i
  from conversations where conv_id is not null),
k as (select distinct c, c - c % 100 as base, xor(list_reduce(list_concat([4294967295::ubigint],
        list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::ubigint)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda z: 0::ubigint)),
        lambda v, z: case when v % 2 = 1 then xor(v // 2, 3988292384::ubigint) else v // 2 end)), 4294967295::ubigint) % 6 as h from t),
turns as (select k.c, 0 as part, t.i, t.role, t.text from k join t on t.c = k.base where t.i <= k.h
  union all select k.c, 1, t.i, t.role, t.text from k join t on t.c = k.c where t.i > k.h),
seqs as (select k.c, coalesce(list(struct_pack(r := role, x := text) order by part, i) filter (i is not null), []) as s
  from k left join turns using (c) group by k.c),
pre as (select c, d, s[1:d] as node, d = len(s) as ends from (select *, unnest(range(0, len(s) + 1)) as d from seqs) z),
nodes as (select node, any_value(d) as d, min(c) as conv, count(*) as n,
    case when any_value(d) = 0 then 0 else length(any_value(node[len(node)].x)) end as chars,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends from pre group by node),
named as (select pre.c, pre.d, nodes.conv from pre join nodes on nodes.node = pre.node),
up as (select n.conv, n.d, named.conv as parent from nodes n left join named on named.c = n.conv and named.d = n.d - 1),
kids as (select parent as conv, d - 1 as d, count(*) as n_children from up where d > 0 group by 1, 2),
each as (select n.conv, n.d, (n.n - 1) * n.chars as saved, case when kids.n_children is null then 1 else 0 end as leaf
  from nodes n left join kids on kids.conv = n.conv and kids.d = n.d),
sums as (select named.conv, named.d, sum(leaf) as n_leaves, sum(saved) as saved_tokens
  from each join named on named.c = each.conv and named.d <= each.d group by 1, 2)
select n.conv as conv_id, n.d as depth, up.parent as parent_conv_id, n.n as n_convs, coalesce(n_children, 0) as n_children,
  n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, ends as ends_sha256
from nodes n join up on up.conv = n.conv and up.d = n.d join sums on sums.conv = n.conv and sums.d = n.d
left join kids on kids.conv = n.conv and kids.d = n.d""",
    "op12_ngram_jaccard": rf"""
with recursive w as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) end) as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as t from s),
l as (select a.doc_id as a, b.doc_id as b from e a join e b on a.t = b.t and a.doc_id < b.doc_id
    and 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) group by a.doc_id, b.doc_id, a.n, b.n
    having 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
sym as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as other from s union select r.doc_id, sym.b from r join sym on sym.a = r.other)
select s.doc_id, len(sh) as n_shingles, c.component_id
from s join (select doc_id, min(other) as component_id from r group by doc_id) c using (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

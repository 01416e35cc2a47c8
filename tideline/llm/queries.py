"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, chat, language_id, licences, manifest, mixing, near_vectors, ngram_join, quality, sharding, top_k, toxicity
from ._common import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mixing": lambda s, d: mixing.op1(s, table(s, d, "documents")),
        "op2_chat_formatting": lambda s, d: chat.op2(s, table(s, d, "conversations")),
        "op3_ngram_jaccard_join": lambda s, d: ngram_join.op3(s, table(s, d, "documents")),
        "op4_exact_top_k": lambda s, d: top_k.op4(s, table(s, d, "embeddings")),
        "op5_toxicity": lambda s, d: toxicity.op5(s, table(s, d, "documents"), table(s, d, "labels")),
        "op6_quality": lambda s, d: quality.op6(s, table(s, d, "documents"), table(s, d, "labels")),
        "op7_embedding_near_dedup": lambda s, d: near_vectors.op7(s, table(s, d, "embeddings")),
        "op8_sharding": lambda s, d: sharding.op8(s, table(s, d, "documents")),
        "op9_bpe": lambda s, d: bpe.op9(s, table(s, d, "documents"), vocabulary()),
        "op10_language_id": lambda s, d: language_id.op10(s, table(s, d, "documents")),
        "op11_licence_scan": lambda s, d: licences.op11(s, table(s, d, "documents")),
        "op12_merkle_manifest": lambda s, d: manifest.op12(s, table(s, d, "documents")),
        "op13_tokenizer_alignment": lambda s, d: alignment.op13(s, table(s, d, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")),
    }


WORD = r"[^\x20\x09-\x0D]+"

# Every row's place in its source's weighted order, then what the target takes of it. Digests make the keys, so that both
# engines draw the same.
OP1 = rf"""
with d as (select doc_id, source, coalesce(text, '') as t, md5(coalesce(text, '')) as tie from documents),
r as (select doc_id, source, tie, len(regexp_extract_all(t, '{WORD}')) as size,
  (cast('0x' || substr(md5('11|' || coalesce(cast(doc_id as varchar), 'null') || '|' || tie), 1, 13) as bigint) + 0.5::double) / 4503599627370496::double as u,
  1.0::double - 0.9::double * least(1.0::double, coalesce((length(t) - length(translate(t, '!#$%&*|<>{{}}[]=_~^@\/', ''))) * 4 / nullif(length(t), 0)::double, 0)) as quality from d),
k as (select *, -ln(u) / greatest(quality, 1e-6::double) as key from r),
g as (select source, sum(size) as source_size, row_number() over (order by source is null, source) - 1 as rank from k group by source),
c as (select *, [5.0::double, 2.0, 1.0][rank % 3 + 1] as weight, source_size * 3.0::double as cap from g),
s as (select *, (sum(source_size) over ()::double - coalesce(sum(cap) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as share from c
  window before as (order by cap / weight, rank rows between unbounded preceding and 1 preceding)),
l as (select *, cap < share * weight as stops, max(share) filter (cap >= share * weight) over () as level from s),
t as (select source, source_size, rank, case when stops or level is null then cap else least(cap, level * weight) end as target from l),
o as (select k.*, t.source_size, t.rank, t.target, least(3, floor(coalesce(t.target / nullif(t.source_size, 0), 0)))::bigint as full_epochs,
  coalesce(sum(k.size) over (partition by t.rank order by k.key, k.doc_id nulls first, k.size, k.tie rows between unbounded preceding and 1 preceding), 0) as ahead
  from k join t on t.source is not distinct from k.source),
p as (select *, case when full_epochs < 3 then target - full_epochs * source_size else 0 end as rest from o),
q as (select *, ahead + size <= rest as chosen from p),
x as (select *, rest - coalesce(sum(size) filter (chosen) over (partition by rank), 0) as gap from q),
y as (select rank, key, doc_id, tie from x where not chosen and size > 0 and gap > 0 and size < 2 * gap
  qualify row_number() over (partition by rank order by case when size <= gap then size else -size end desc, key desc, doc_id desc nulls last, tie desc) = 1)
select x.doc_id, x.size::bigint as size, x.source_size::bigint as source_size, x.target, (x.size * e)::bigint as taken, e as epochs
from (select x.*, full_epochs + (chosen or (size > 0 and y.rank is not null))::bigint as e
  from x left join y on y.rank = x.rank and y.key = x.key and y.doc_id is not distinct from x.doc_id and y.tie = x.tie) x
"""

OP2 = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all
  select -1, i, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) as v(i, r)),
c as (select *, '\\|<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<\|startoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>' as control from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(32 + length(role) + len(regexp_extract_all(role, control)) + length(text) + len(regexp_extract_all(text, control)))::bigint as formatted_chars
from c group by conv_id
"""

OP3 = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from w),
u as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b from u a join u b on b.g = a.g and b.doc_id <> a.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r as (select doc_id as a, doc_id as b from s union select r.a, p.b from r join p on p.a = r.b)
select s.doc_id, len(s.s)::bigint as n_shingles, m.c as component_id from s join (select a, min(b) as c from r group by a) m on m.a = s.doc_id
"""

OP4 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 100 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s qualify rank <= 10
"""

OP7 = """
with recursive v as (select vec_id, label, embedding::double[] as v from embeddings where label is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on b.label = a.label and b.vec_id <> a.vec_id and len(b.v) = len(a.v) where list_cosine_similarity(a.v, b.v) >= 0.98),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, p.b from r join p on p.a = r.b)
select e.vec_id, (select count(*) from p where p.a = e.vec_id) as n_links, m.c as component_id, m.c = e.vec_id as kept
from embeddings e join (select a, min(b) as c from r group by a) m on m.a = e.vec_id
"""

# Trees level by level; a path is folded from its leaf upwards, first in the source's tree, then in the one over the sources.
OP12 = r"""
with recursive t as (select row_number() over () as row, *, length(regexp_replace(coalesce(text, ''), '[^\n]', '', 'g')) > 0 as lines, coalesce(cast(doc_id as varchar), '') as id from documents),
c as (select *, doc_id is not null and (list_reduce([4294967295::ubigint] || flatten(list_transform(range(length(id)), lambda i: [ascii(id[i + 1])::ubigint, 99999, 99999, 99999, 99999, 99999, 99999, 99999, 99999])),
  lambda s, e: case when e = 99999 then xor(s // 2, (s % 2) * 3988292384::ubigint) else xor(s, e) end) % 2 = 1) as even from t),
f as (select row, doc_id, source, even and lines as changed,
  coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head,
  text, replace(text, chr(10), '') as cut from c),
h as (select row, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
  case when changed then sha256(head || strlen(cut) || ':' || cut) else sha256(head || coalesce(strlen(text) || ':' || text, '-')) end as other from f),
l as (select *, dense_rank() over (order by source nulls first) - 1 as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from h),
n as (select tree, 0 as level, i, leaf as digest from l
  union all
  select tree, any_value(level) + 1, i // 3, sha256(string_agg(digest, '' order by i)) from (select *, count(*) over (partition by tree) as m from n) where m > 1 group by tree, i // 3),
s as (select tree, arg_max(digest, level) as subroot, max(level) as height from n group by tree),
u as (select 0 as level, tree as i, subroot as digest from s
  union all
  select any_value(level) + 1, i // 3, sha256(string_agg(digest, '' order by i)) from (select *, count(*) over () as m from u) where m > 1 group by i // 3),
a as (select -1 as tree, level, i, digest from u union all select tree, level, i, digest from n),
r as (select tree, level, i // 3 as run, list({'i': i, 'd': digest} order by i) as nodes from a group by tree, level, i // 3),
top as (select arg_max(digest, level) as root, max(level) as height from u),
p as (select row, 0 as step, tree, 0 as level, i, other as now, '' as said, false as over from l
  union all
  select p.row, step + 1, case when level = height then -1 else p.tree end, case when level = height then 0 else level + 1 end, case when level = height then p.tree else p.i // 3 end,
    case when level = height then now else sha256(list_reduce([''] || list_transform(nodes, lambda z: case when z.i = p.i then now else z.d end), lambda x, y: x || y)) end,
    case when level = height then said else said || list_reduce([''] || list_transform(nodes, lambda z: case when z.i = p.i then '' else z.d end), lambda x, y: x || y) end, false
  from p join (select tree, height from s union all select -1, height from top) e using (tree) join r using (tree, level)
  where r.run = p.i // 3 and not (p.tree = -1 and level = height))
select l.doc_id, l.leaf, s.subroot, top.root, sha256(z.said) as proof_sha256, z.now as folded_root, z.now = top.root as verified
from l join s using (tree) cross join top join (select row, arg_max(said, step) as said, arg_max(now, step) as now from p group by row) z using (row)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the whole results of six of them. The others learn, propagate or tokenise; tests hold those to brute force."""
    return {"op1_source_mixing": OP1, "op2_chat_formatting": OP2, "op3_ngram_jaccard_join": OP3, "op4_exact_top_k": OP4, "op12_merkle_manifest": OP12, "op7_embedding_near_dedup": OP7}

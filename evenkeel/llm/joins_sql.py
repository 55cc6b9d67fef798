"""SQL for the similarity joins: all pairs, and components by a recursive reach."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) end as s from w),
g as (select doc_id, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * o >= 90 * (len(x.s) + len(y.s) - o)),
e as (select a, b from l union all select b, a from l),
n as (select a as doc_id, count(*) as n_links from e group by a),
r as (select doc_id, doc_id as root from s union select e.b, r.root from r join e on r.doc_id = e.a)
select s.doc_id, any_value(len(s.s))::bigint as n_shingles, coalesce(any_value(n.n_links), 0)::bigint as n_links, min(root)::bigint as component_id from s join r on r.doc_id = s.doc_id left join n on n.doc_id = s.doc_id group by s.doc_id
"""

VECTORS = """
with recursive v as (select vec_id, label, embedding::double[] as x from embeddings),
good as (select * from v where x is not null and label is not null and len(x) > 0 and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(x, lambda c: c <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.x, b.x) >= 0.93),
n as (select a as vec_id, count(*) as n_links from l group by 1),
r as (select vec_id, vec_id as root from v union select l.b, r.root from r join l on r.vec_id = l.a),
c as (select vec_id, min(root) as component_id from r group by 1)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id::bigint as component_id, vec_id = component_id as kept from v join c using (vec_id) left join n using (vec_id)
"""

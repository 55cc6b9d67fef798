"""SQL for line dedup: maximal runs along the diagonals of all pairs of equal lines."""

from .lines import MIN_WORDS

SQL = f"""
with p as (select doc_id, unnest(string_split(text, chr(10))) as part, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents),
w as (select *, regexp_extract_all(part, '\\S+') as w from p),
k as (select doc_id, line_no, row_number() over (partition by doc_id order by line_no) as i, array_to_string(w, ' ') as line, len(w) as n_words from w where len(w) > 0),
-- a line and an equal one before it; on one diagonal both lines move on together
m as (select a.doc_id, a.i, a.line_no, a.n_words, b.doc_id as other, a.i - b.i as diagonal
    from k a join k b on a.line = b.line and (b.doc_id < a.doc_id or b.doc_id = a.doc_id and b.i < a.i)),
g as (select *, i - row_number() over (partition by doc_id, other, diagonal order by i) as run from m),
r as (select doc_id, line_no, sum(n_words) over (partition by doc_id, other, diagonal, run) as in_run from g),
gone as (select distinct doc_id, line_no from r where in_run >= {MIN_WORDS}),
kept as (select p.doc_id, string_agg(part, chr(10) order by p.line_no) filter (g.line_no is null) as text, count(g.line_no) as removed
    from p left join gone g on g.doc_id = p.doc_id and g.line_no = p.line_no group by 1)
select d.doc_id, case when d.text is not null then coalesce(kept.text, '') end as text, coalesce(removed, 0)::int as removed
from documents d left join kept using (doc_id)
"""

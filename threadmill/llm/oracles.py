"""DuckDB SQL for the queries that SQL can express, written from the contracts."""

URL_FILTER = r"""
with u as (
    select page_id,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
    from pages
),
rules(r_host, r_path, r_verdict) as (
    values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
)
select page_id, host, path,
    (select r_host || r_path from rules where (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
     order by length(r_host || r_path) desc, length(r_host) desc limit 1) as rule,
    coalesce((select r_verdict from rules where (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
     order by length(r_host || r_path) desc, length(r_host) desc limit 1), 'allow') as verdict
from u
"""

EXACT_TOPK = """
with v as (select vec_id, [floor(256.0 * x::double)::bigint for x in embedding] as e from embeddings where embedding is not null and vec_id is not null),
pairs as (
    select q.vec_id as query_id, c.vec_id, list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)])::bigint as score
    from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.e) = len(q.e)
),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

MIXING = r"""
with q as (select doc_id, max(quality) as quality from labels where doc_id is not null group by doc_id),
d as (
    select documents.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
        -ln(((('0x' || substr(md5(coalesce(documents.doc_id::varchar, 'null') || ':17'), 1, 12))::bigint) + 0.5::double) / 281474976710656::double)
            / (case q.quality when 1 then 2.0::double when 0 then 0.5::double else 1.0::double end) as key
    from documents left join q on q.doc_id = documents.doc_id
),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (
    select *, [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight,
        (select sum(source_size) from s) as total
    from s
),
-- sources in the order in which a rising share fills them: after the first k are full, the others share what is left
o as (
    select *, row_number() over (order by 2 * source_size / weight, source is null, source) as k,
        sum(source_size) over (order by 2 * source_size / weight, source is null, source) as filled,
        sum(weight) over () - sum(weight) over (order by 2 * source_size / weight, source is null, source) as free
    from w
),
levels as (
    select 0 as k, 1.5::double * max(total) / sum(weight) as unit from w
    union all select k, (1.5::double * total - 2 * filled) / free from o where free > 0
),
level as (
    select unit from levels l
    where not exists (select 1 from o where o.k <= l.k and 2 * source_size > unit * weight)
        and not exists (select 1 from o where o.k > l.k and 2 * source_size <= unit * weight)
    order by k limit 1
),
t as (
    select source, source_size, target, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs
    from (select source, source_size, least(2.0::double * source_size, (select unit from level) * weight) as target from w)
),
p as (
    select d.doc_id, d.size, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size as rest,
        coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id rows between unbounded preceding and 1 preceding), 0) as before
    from d join t on t.source is not distinct from d.source
)
select doc_id, size, source_size::bigint as source_size, target,
    ((epochs + (case when size > 0 and before + size / 2.0::double < rest then 1 else 0 end)) * size)::bigint as taken
from p
"""

FILTER_AUDIT = r"""
with recursive
d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words from d),
lab as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
m as (
    select part, coalesce(lab.good, false) as good, coalesce(lab.toxic, false) as toxic,
        [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
         coalesce(w.doc_id > min(w.doc_id) over (partition by t), false)] as fails
    from w left join lab on lab.doc_id = w.doc_id
),
cells as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by part, fails),
orders as (
    select '' as filter_order
    union all
    select filter_order || c from orders, (values ('A'), ('B'), ('C'), ('D'), ('E')) as v(c) where length(filter_order) < 5 and not contains(filter_order, c)
),
steps as (
    select filter_order, step, filter_order[step] as letter, [ascii(x) - 64 for x in string_split(left(filter_order, step - 1), '') if x <> ''] as earlier
    from orders, range(1, 6) as r(step) where length(filter_order) = 5
),
hits as (
    select part, filter_order, step, letter, n, good, toxic, fails[ascii(letter) - 64] as fail, len([e for e in earlier if fails[e]]) > 0 as gone,
        len([f for f in fails if f]) as n_fails
    from cells, steps
),
out as (
    select part, filter_order, step, letter, sum(case when not gone and not fail then n else 0 end) as kept, sum(case when not gone and fail then n else 0 end) as removed,
        sum(case when gone and fail then n else 0 end) as redundant, sum(case when fail and n_fails = 1 then n else 0 end) as unique_fails,
        sum(case when not gone and fail then good else 0 end) as good_lost, sum(case when not gone and fail then toxic else 0 end) as toxic_lost
    from hits group by all
)
select part, filter_order, step::integer as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
    good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley
from out
"""

#: The checksum goes by half bytes, with the 16 remainders of the polynomial (fixed values of the CRC-32 standard).
SPELLING = r"""
with recursive r as (
    select coalesce(doc_id::varchar, '') as id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
    from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents) where length(run) >= 6 group by all
),
hx as (select *, hex(encode(id || ':' || run)) as x from r),
h as (
    select run, n, xor(list_reduce([instr('0123456789ABCDEF', x[case when i % 2 = 0 then i + 2 else i end]) - 1 for i in range(0, length(x))],
        lambda c, b: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
            3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(c, b) & 15) + 1]), 4294967295::bigint), 4294967295::bigint) as h
    from hx
),
words as (
    select case when h % 199 = 0 then left(run, (h % length(run))::integer) || substr(run, (h % length(run))::integer + 2) else run end as word, sum(n)::bigint as n
    from h group by 1 having length(word) >= 6 and sum(n) >= 5
),
less as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from words, range(1, 1000) as p(i) where i <= length(word)),
near as (
    select distinct a.word, b.word as near, b.n as near_n from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select a.word, b.word, b.n from less a join words b on a.rest = b.word
    union select b.word, a.word, a.n from less a join words b on a.rest = b.word
),
best as (select word, count(*) as n_near, max(near_n) as most, min(near) filter (near_n = top) as best from (select *, max(near_n) over (partition by word) as top from near) group by word),
f as (
    select w.word, w.n, coalesce(b.n_near, 0)::bigint as n_near, case when b.most >= 5 * w.n then b.best end as form, case when b.most >= 5 * w.n then b.most end as form_n
    from words w left join best b on b.word = w.word
),
chain as (
    select word, word as head, 0 as steps from f
    union all
    select c.word, f.form, steps + 1 from chain c join f on f.word = c.head where f.form is not null
)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n::bigint as form_n
from f join (select word, max_by(head, steps) as root from chain group by word) c on c.word = f.word
"""

QUALITY_RULES = r"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
lines as (select doc_id, source, unnest(string_split(t, chr(10))) as raw from d),
l as (select doc_id, source, raw, trim(regexp_replace(lower(raw), '[\x20\x09-\x0D]+', ' ', 'g')) as line from lines where regexp_matches(raw, '[^\x20\x09-\x0D]')),
frequent as (select source, line from l group by source, line having count(distinct doc_id) > 20),
line_counts as (
    select l.doc_id, (count(*) - count(distinct raw))::bigint as n_dup_lines,
        (sum(case when f.line is not null then length(l.line) - length(replace(l.line, ' ', '')) + 1 else 0 end))::bigint as lost_words
    from l left join frequent f on f.line = l.line and f.source is not distinct from l.source group by l.doc_id
),
ws as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
grams as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from ws)),
again as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from grams) where c > 1),
repeats as (select doc_id, count(distinct i + k)::bigint as n_repeat_words from again, range(0, 3) as r(k) group by doc_id),
counts as (
    select ws.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
        coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(lost_words, 0) as lost_words
    from ws left join line_counts lc on lc.doc_id = ws.doc_id left join repeats r on r.doc_id = ws.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, lost_words,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost_words <= 50 * n_words as kept
from counts
"""

ORACLES = {"op2_url_filter": URL_FILTER, "op5_mixing": MIXING, "op8_exact_topk": EXACT_TOPK, "op11_filter_audit": FILTER_AUDIT, "op12_spelling": SPELLING, "op13_quality_rules": QUALITY_RULES}

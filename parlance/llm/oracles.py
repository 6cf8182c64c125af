"""DuckDB SQL for the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES = {
    "op1_decontamination": f"""
with items as (select item_id, {_WORDS} as w from benchmark),
grams as (select distinct item_id, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
          from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from items where len(w) > 0)),
lens as (select distinct k from grams),
docs as (select doc_id, {_WORDS} as w from documents),
wins as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g
         from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from docs, lens where len(w) >= k)),
found as (select doc_id, wins.k, i, item_id from wins join grams on wins.k = grams.k and wins.g = grams.g),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from found) group by 1),
ids as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as s from found group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join hit using (doc_id) left join ids using (doc_id)""",
    "op4_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) as last from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> last then last end as refers_to
from m""",
    "op9_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
wins as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as r from wins) where r > 1),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 20)) as p from later)),
each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select e.doc_id, count(*) as n, string_agg(word, ' ' order by e.p) as s from each e anti join gone g on e.doc_id = g.doc_id and e.p = g.p group by 1)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256
from d left join kept using (doc_id)""",
    "op12_fill_in_middle": """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as s from documents),
h as (select doc_id, t, length(t)::bigint as n, ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2, ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as p, greatest(h1 % (n + 1), h2 % (n + 1)) as q,
             case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
o as (select *, substring(t, 1, p) as a, substring(t, p + 1, q - p) as b, substring(t, q + 1) as z from c)
select doc_id, n, form, case when form <> 'plain' then p end as prefix_chars, case when form <> 'plain' then q - p end as middle_chars,
       sha256(case form when 'psm' then '<P>' || a || '<S>' || z || '<M>' || b when 'spm' then '<S>' || z || '<P>' || a || '<M>' || b else t end) as output_sha256,
       sha256(t) as restored_sha256
from o""",
}

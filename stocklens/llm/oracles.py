"""DuckDB twins of the operators' queries, where SQL can express them."""

from __future__ import annotations

from .chat import CLOSE, OPEN
from .clusters import CENTROIDS, DIMENSIONS, LARGEST, ROUNDS, SCALE
from .licenses import CONTAINMENT, NOTICES, WORD_BREAK
from .mixing import KEY_BITS, MAX_EPOCHS, WEIGHTS
from .quality import MAX_HOST_RATE, MAX_REPEAT_PERCENT, MIN_WORDS, WINDOW

WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as size,
         ('0x' || substr(md5('0:' || coalesce(cast(doc_id as varchar), '')), 1, {KEY_BITS // 4}))::bigint as key
  from documents),
totals as (
  select source, sum(size)::double as s, row_number() over (order by source nulls last) - 1 as turn
  from sized group by source),
weighted as (select *, ([{', '.join(f'{w}.0::double' for w in WEIGHTS)}])[turn % {len(WEIGHTS)} + 1] as w,
                    {MAX_EPOCHS} * s as cap from totals),
ranked as (
  select *, sum(s) over () as words, sum(w) over () as weight,
         coalesce(sum(cap) over (order by cap / w, turn rows between unbounded preceding and 1 preceding), 0) as cap_before,
         coalesce(sum(w) over (order by cap / w, turn rows between unbounded preceding and 1 preceding), 0) as w_before
  from weighted),
marked as (select *, (words - cap_before) * w >= cap * (weight - w_before) as capped from ranked),
targets as (
  select source, s, case when capped then cap else w
         * (words - sum(case when capped then cap else 0.0::double end) over ())
         / sum(case when capped then 0.0::double else w end) over () end as target
  from marked),
placed as (
  select z.doc_id, z.size, t.s::bigint as source_size, t.target,
         coalesce(sum(z.size) over (partition by z.source order by key, z.doc_id, z.size
                                    rows between unbounded preceding and 1 preceding), 0) as before
  from sized z join targets t on z.source is not distinct from t.source),
spent as (
  select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as epochs from placed)
select doc_id, size::bigint as size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::bigint - epochs * source_size - before)))::bigint as taken
from spent"""

_notices = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in NOTICES.items())

OP2 = rf"""
with notices(license, text) as (values {_notices}),
split_notices as (
  select license, list_filter(regexp_split_to_array(lower(text), '{WORD_BREAK}'), lambda w: w <> '') as words from notices),
notice_shingles as (
  select distinct license, list_slice(words, i, i + 4) as shingle
  from (select *, unnest(range(1, greatest(len(words) - 3, 2))) as i from split_notices)),
sizes as (select license, count(*) as n from notice_shingles group by license),
stride as (select max(n) as stride from sizes),
split_docs as (
  select distinct doc_id, text, list_filter(regexp_split_to_array(lower(text), '{WORD_BREAK}'), lambda w: w <> '') as words
  from documents where text is not null),
doc_shingles as (
  select doc_id, text, i - 1 as place, list_slice(words, i, i + 4) as shingle
  from (select *, unnest(range(1, greatest(len(words) - 3, 2))) as i from split_docs)),
hits as (select d.doc_id, d.text, d.place, n.license, n.shingle from doc_shingles d join notice_shingles n using (shingle)),
windowed as (
  select h.*, unnest([place // stride, place // stride - 1]) as win from hits h, stride),
shares as (
  select w.doc_id, w.text, w.license, win, count(distinct w.shingle) / any_value(s.n)::double as share, min(place) as first
  from windowed w join sizes s using (license) where win >= 0 group by w.doc_id, w.text, w.license, win)
select doc_id, license, min(first)::bigint as first_shingle, max(share) as containment
from shares where share >= {CONTAINMENT} group by doc_id, license"""

_escape = "replace(coalesce({}, '{}'), '<|', '< |')".format

OP5 = f"""
with turns as (
  select distinct conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t,
         '{OPEN}' || {_escape('role', 'unknown')} || chr(10) || {_escape('text', '')} || '{CLOSE}' || chr(10) as rendered
  from conversations),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, r, t) as position from turns),
whole as (select conv_id, list([r, t] order by position) as said, count(*) as n_turns from placed group by conv_id),
firsts as (select min(conv_id) as conv_id, said, any_value(n_turns) as n_turns from whole group by said),
prefixes as (select distinct list_slice(said, 1, k) as said
             from (select said, unnest(range(1, n_turns)) as k from firsts)),
kept as (select f.* from firsts f anti join prefixes p on f.said = p.said)
select p.conv_id, p.position, k.n_turns, p.rendered
from placed p join kept k on p.conv_id is not distinct from k.conv_id"""

OP9 = rf"""
with texts as (
  select row_number() over () as id, doc_id, source, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') as words from documents),
lines as (
  select id, count(*) - count(distinct line) as n_dup_lines
  from (select id, unnest(string_split(text, chr(10))) as line from texts)
  where regexp_matches(line, '{WORD}') group by id),
windows as (
  select id, i, count(*) over (partition by id, win) as copies
  from (select id, i, list_slice(words, i, i + {WINDOW - 1}) as win
        from (select id, words, unnest(range(1, len(words) - {WINDOW - 2})) as i from texts where len(words) >= {WINDOW}))),
covered as (
  select id, count(distinct place) as n_repeat_words
  from (select id, unnest(range(i, i + {WINDOW})) as place from windows where copies > 1) group by id),
counted as (
  select t.doc_id, t.source, len(words)::bigint as n_words,
         coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from texts t left join lines using (id) left join covered using (id)),
ruled as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from counted),
hosts as (select source, count(*)::double as n, sum(base_failed::int)::double as f from ruled group by source),
total as (
  select sum(n) as n, sum(f) / sum(n) as m, count(*)::double as k, sum(n * n) as n2, sum(f * f / n) as r2 from hosts),
variance as (
  select m, (r2 - n * m * m - (k - 1) * m * (1 - m)) / nullif(greatest(n - n2 / n, 0), 0) as v from total),
prior as (
  select m, greatest(2.0, least(1e6, case when v > 0 then m * (1 - m) / v - 1 else 1e6 end)) as weight from variance),
rates as (select source, n + weight as n, (f + m * weight) / (n + weight) as rate from hosts, prior),
bad as (select source, rate - 2 * sqrt(rate * (1 - rate) / (n + 1)) > {MAX_HOST_RATE} as bad from rates)
select r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not bad as kept
from ruled r join bad b on r.source is not distinct from b.source"""

_base32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, {10 * g + 1}, 10))::bigint >> {35 - 5 * j}) & 31)::int + 1, 1)"
    for g in range(4) for j in range(8))

OP3 = f"""
with hashed as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
rows as (select page_id, strlen(html)::bigint as payload_bytes, {_base32} as payload_digest,
                min(page_id) over (partition by html) as first from hashed)
select page_id, payload_bytes, payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from rows"""


def _op11() -> str:
    """k-means with every vector compared with every centroid, a pair of common tables for each round."""
    parts = [f"""
kept as (
  select row_number() over () as r, vec_id, embedding from embeddings
  where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x)
        and abs(x::double * {SCALE}) <= {LARGEST})) = {DIMENSIONS}),
parts as materialized (
  select r, i, floor({SCALE} * embedding[i]::double)::bigint as x from kept, range(1, {DIMENSIONS + 1}) as t(i)),
ranked as (
  select r, row_number() over (order by sha256('2:' || coalesce(vec_id::varchar, '')),
         list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint)) - 1 as k from kept),
c0 as materialized (select k, i, x as c from ranked join parts using (r) where k < {CENTROIDS})"""]
    for n in range(ROUNDS + 1):
        parts.append(f"""
d{n} as (
  select r, k, sum((x - c) * (x - c))::bigint as d from parts join c{n} using (i) group by r, k),
a{n} as materialized (
  select r, arg_min(k, (d, k)) as k, min(d) as d from d{n} group by r)""")
        if n < ROUNDS:
            parts.append(f"""
s{n} as (select k, i, sum(x)::bigint as s, count(*) as m from parts join a{n} using (r) group by k, i),
c{n + 1} as materialized (
  select c{n}.k, c{n}.i, case when m is null then c else (s - ((s % m) + m) % m) // m end as c
  from c{n} left join s{n} on c{n}.k = s{n}.k and c{n}.i = s{n}.i)""")
    return f"""
with {",".join(parts)},
hashes as (select k, sha256(string_agg(c::varchar, ',' order by i)) as centroid_sha256 from c{ROUNDS} group by k)
select vec_id, k::int as cluster, d as distance, (sum(d) over (partition by k))::bigint as cluster_inertia,
       (sum(d) over ())::bigint as inertia, centroid_sha256
from a{ROUNDS} join kept using (r) join hashes using (k)"""


LLM_SQL = {
    "op3_warc_segments": OP3,
    "op1_mix_sources": OP1, "op2_license_scan": OP2, "op5_chat_format": OP5, "op9_quality_rules": OP9,
    "op11_ns_bounds_clusters": _op11(),
}

"""DuckDB SQL stating the same rows as the corpus queries that SQL can express."""

from __future__ import annotations

from surveyframe.llm.chat import Template


def _escaped_length(text: str, template: Template) -> str:
    """Length of a text after escaping: one more for each escape character and each control string."""
    more = [f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in ("\\", *template.controls)]
    return f"length({text}) + " + " + ".join(more)


def chat_sql(template: Template, extra: str) -> str:
    marks = "".join(f" when '{name}' then {len(t.before) + len(t.after)}" for name, t in template.turns.items())
    a, b, c = template.other
    other = f"{len(a) + len(b) + len(c)} + {_escaped_length('role', template)}"
    allowed = ", ".join(f"'{s} {r}'" for s, after in template.steps.items() for r in after)
    accepted = ", ".join(f"'{r}'" for r in template.accepted)
    losses = ", ".join(f"'{name}'" for name, t in template.turns.items() if t.loss)
    return f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values {extra}) v(conv_id, turn, role, text)
),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from rows
),
stepped as (
  select *, case when coalesce(lag(role) over (partition by conv_id order by k), 'start') || ' ' || role in ({allowed})
                 then null else k end as broken_at
  from placed
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role in ({losses})), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by k) filter (where role in ({losses})), '')) as loss_sha256,
       ({len(template.start)} + sum({_escaped_length('text', template)}
        + case role{marks} else {other} end))::bigint as formatted_chars,
       min(broken_at) is null and arg_max(role, k) in ({accepted}) as valid,
       coalesce(min(broken_at) - 1, count(*))::bigint as n_taken
from stepped group by conv_id
"""


NEGATIVES_SQL = """
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
         list_sum(list_transform(generate_series(1, len(a.v)), lambda i: a.v[i] * b.v[i]))::bigint as score
  from usable a join usable b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
),
found as (
  select p.anchor_id, p.positive_id, n.other_id as negative_id, p.positive_score, n.score as negative_score,
         row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.other_id)::int as rank
  from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
   and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from found where rank <= 3
"""


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""
near{r} as materialized (
  select n, part, min(distance) as distance, arg_min(entry, (distance, entry)) as entry from (
    select v.n, v.part, b.entry,
           list_sum(list_transform(generate_series(1, len(v.c)), lambda i: (v.c[i] - b.c[i]) * (v.c[i] - b.c[i])))::bigint as distance
    from cut v join book{r} b on b.part = v.part)
  group by n, part
)"""
        )
        if r < rounds:
            steps.append(
                f"""
means{r} as (
  select part, entry, list(floor(total / many)::bigint order by i) as c from (
    select a.part, a.entry, i, sum(v.c[i])::hugeint as total, count(*) as many
    from near{r} a join cut v on v.n = a.n and v.part = a.part, unnest(generate_series(1, len(v.c))) as u(i)
    group by a.part, a.entry, i)
  group by part, entry
),
book{r + 1} as materialized (
  select b.part, b.entry, coalesce(m.c, b.c) as c from book{r} b left join means{r} m on m.part = b.part and m.entry = b.entry
)"""
            )
    return f"""
with kept as materialized (
  select row_number() over (order by vec_id, v) as n, vec_id, label, v from (
    select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
),
cut as materialized (
  select n, part, list_slice(v, part * (len(v) // {parts}) + 1, (part + 1) * (len(v) // {parts})) as c
  from kept, unnest(generate_series(0, {parts - 1})) as u(part)
),
book0 as materialized (select part, n - 1 as entry, c from cut where n <= {entries}),
{",".join(steps)},
codes as (
  select n, string_agg(printf('%02x', entry), '' order by part) as code, sum(distance)::bigint as error from near{rounds} group by n
),
digest as (
  select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from book{rounds}
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from codes join kept using (n), digest
"""


def revisits_sql() -> str:
    """Roles of pages by payload; base32 takes five bits at a time out of two hex digits."""
    nibble = "(instr('0123456789abcdef', substr(sha, {}, 1)) - 1)"
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    chars = []
    for k in range(32):
        at, skip = divmod(5 * k, 4)
        both = f"(16 * {nibble.format(at + 1)} + {nibble.format(at + 2)})"
        chars.append(f"substr('{letters}', (({both} >> {3 - skip}) & 31)::int + 1, 1)")
    return f"""
with read as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as sha from pages
),
placed as (select *, max(page_id) over (partition by sha) as original from read)
select page_id, payload_bytes, {' || '.join(chars)} as payload_digest,
       case when page_id = original then 'response' else 'revisit' end as record_type,
       case when page_id <> original then original end as refers_to
from placed
"""


_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard_sql() -> str:
    """Shingle sets, links by exact counts, and components by spreading the smallest id along links."""
    return f"""
with recursive read as materialized (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') as ws from documents
),
shingles as materialized (
  select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 4], ' ') end as s
  from read, unnest(generate_series(1, greatest(len(ws) - 4, 1))) as u(i) where len(ws) > 0
),
sizes as materialized (select doc_id, count(*) as n from shingles group by doc_id),
links as materialized (
  select a.doc_id as x, b.doc_id as y
  from shingles a join shingles b using (s) join sizes p on p.doc_id = a.doc_id join sizes q on q.doc_id = b.doc_id
  where a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, p.n, q.n having 100 * count(*) >= 80 * (p.n + q.n - count(*))
),
reach(x, y) as (select x, y from links union select r.x, l.y from reach r join links l on l.x = r.y)
select d.doc_id, coalesce(any_value(z.n), 0)::bigint as n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) as component_id
from read d left join sizes z on z.doc_id = d.doc_id left join reach r on r.x = d.doc_id
group by d.doc_id
"""


def spans_sql(window: int = 20) -> str:
    """Windows whose words start earlier elsewhere cover what is removed."""
    return f"""
with read as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
windows as materialized (
  select doc_id, i, md5(array_to_string(ws[i:i + {window - 1}], ' ')) as k from read, unnest(generate_series(1, len(ws) - {window - 1})) as u(i)
),
again as (
  select doc_id, i from windows qualify row_number() over (partition by k order by doc_id, i) > 1
),
covered as (select distinct doc_id, j from again, unnest(generate_series(i, i + {window - 1})) as u(j)),
words as (select doc_id, j, ws[j] as word from read, unnest(generate_series(1, len(ws))) as u(j)),
kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by j) as t from words anti join covered using (doc_id, j) group by doc_id
)
select r.doc_id, len(r.ws)::bigint as n_words, (len(r.ws) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from read r left join kept k using (doc_id)
"""


def quality_sql() -> str:
    """Statistics of each text, lines over their host's limit, and the verdict."""
    return f"""
with read as materialized (
  select row_number() over () as n, doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents
),
windows as (
  select n, i, array_to_string(ws[i:i + 7], ' ') as k from read, unnest(generate_series(1, len(ws) - 7)) as u(i)
),
repeats as (
  select n, count(distinct j) as n_repeat_words
  from (select n, i from windows qualify count(*) over (partition by n, k) > 1), unnest(generate_series(i, i + 7)) as u(j) group by n
),
lines as materialized (
  select n, source, array_to_string(ws, ' ') as text_key, line, regexp_extract_all(line, '{_WORD}') as lw
  from (select *, unnest(string_split(t, chr(10))) as line from read) where regexp_matches(line, '{_WORD}')
),
named as materialized (select *, {_LOWER.format("array_to_string(lw, ' ')")} as norm from lines),
doubled as (select n, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from named group by n),
hosts as (select source, count(distinct text_key) as all_texts from lines group by source),
limited as (
  select m.source, m.norm from named m join hosts h on h.source is not distinct from m.source
  group by m.source, m.norm, h.all_texts having count(distinct m.text_key) > 5 and count(distinct m.text_key) > 0.05::double * h.all_texts
),
gone as (
  select m.n, sum(len(m.lw)) as words from named m join limited l on l.source is not distinct from m.source and l.norm = m.norm group by m.n
),
stats as (
  select r.n, r.doc_id, len(r.ws)::bigint as n_words, coalesce(list_sum(list_transform(r.ws, lambda w: length(w))), 0)::bigint as word_chars,
         (length(r.t) - length(regexp_replace(r.t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         coalesce(d.n_dup_lines, 0)::bigint as n_dup_lines, coalesce(d.n_lines, 0) as n_lines,
         coalesce(p.n_repeat_words, 0)::bigint as n_repeat_words, coalesce(g.words, 0)::bigint as n_line_words_removed
  from read r left join doubled d using (n) left join repeats p using (n) left join gone g using (n)
),
judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, n_words - n_line_words_removed < 0.3::double * n_words as depleted from stats
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not depleted and n_symbols <= 0.06::double * word_chars and n_dup_lines <= 0.5::double * n_lines as kept,
       n_line_words_removed, depleted
from judged
"""

"""DuckDB SQL for the queries that SQL can express, by the same definitions."""

from __future__ import annotations

from canvass.llm import decontaminate, quality_rules, secrets
from canvass.llm.fingerprints import BUCKETS, FACTORS, LANE


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
         r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
W = decontaminate.WINDOW

DECONTAMINATION = f"""
with d as (select row_number() over () as r, doc_id, {WORDS} as ws from documents),
b as (select cast(item_id as varchar) as item, {WORDS} as ws from benchmark),
dw as (select r, unnest(ws) as w, unnest(range(len(ws))) as p from d),
bw as (select item, len(ws) as n, unnest(ws) as w, unnest(range(len(ws))) as p from b),
met as (select r, item, n, dw.p as dp, bw.p as bp, dw.p - bw.p as diagonal from dw join bw using (w)),
runs as (select *, bp - row_number() over (partition by r, item, diagonal order by bp) as run from met),
islands as (select r, item, any_value(n) as n, min(dp) as first, count(*) as long from runs group by r, item, diagonal, run),
good as (select * from islands where long >= least(n, {W})),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(first, first + long)) as p from good) group by r),
best as (select * from good qualify row_number() over (partition by r order by long desc, first, item) = 1),
named as (select r, count(distinct item) as n_items, sha256(array_to_string(list_sort(list(distinct item)), ',')) as items_sha256
  from good group by r)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, n_items is not null as contaminated,
  coalesce(long, 0) as longest, first as longest_at, best.item as longest_item
from d left join hit using (r) left join named using (r) left join best using (r)
"""

_RULES = quality_rules.RULES
_VALUES = {"symbols": ("n_symbols", "n_words"), "repeats": ("n_repeat_words", "n_words"),
           "copied_lines": ("n_dup_lines", "n_lines"), "word_length": ("word_chars", "n_words")}
_BUCKET = "value - value % (cast(1 as bigint) << greatest(length(bin(value)) - 6, 0))"


def _quartiles(name: str, keys: str) -> str:
    by, k = (f"{keys}, rule", f"{keys}, ") if keys else ("rule", "")
    return (f"{name}_s as (select {k}rule, bucket, sum(n) as n from sketch group by all), "
            f"{name}_r as (select *, sum(n) over (partition by {by} order by bucket) as upto, sum(n) over (partition by {by}) as total from {name}_s), "
            f"{name} as (select {k}rule, max(total) as total, "
            + ", ".join(f"min(bucket) filter (upto * 4 >= total * {p}) as q{p}" for p in (1, 2, 3)) + f" from {name}_r group by {by})")


def _pick(c: str) -> str:
    least = quality_rules.LEAST_DOCS
    return f"(case when g.total >= {least} then g.{c} when l.total >= {least} then l.{c} else a.{c} end)"


def _limits() -> str:
    out = []
    for rule, (least, low) in _RULES.items():
        out.append(f"max(case when g.rule = '{rule}' then {_pick('q2')} + {quality_rules.REACH} * greatest({_pick('q3')} - {_pick('q2')}, {least}) end) as most_{rule}")
        if low:
            out.append(f"max(case when g.rule = '{rule}' then {_pick('q2')} - {quality_rules.REACH} * greatest({_pick('q2')} - {_pick('q1')}, {least}) end) as least_{rule}")
    return ", ".join(out)


_SPACE = r"\x20\x09-\x0D"
QUALITY = f"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select r, doc_id, lang, source, t, regexp_extract_all(t, '[^{_SPACE}]+') as ws, string_split(t, chr(10)) as ls from d),
threes as (select r, i, hash(ws[i], ws[i + 1], ws[i + 2]) as h, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as k
  from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w)),
often as (select r, k from threes group by r, k having count(*) > 1),
covered as (select r, count(distinct p) as n_repeat_words from (
  select r, unnest([i, i + 1, i + 2]) as p from threes semi join often using (r, k)) group by r),
lines as (select r, line, count(*) as n from (select r, unnest(ls) as line from w) where regexp_matches(line, '[^{_SPACE}]') group by all),
lined as (select r, sum(n) as n_lines, sum(n - 1) as n_dup_lines from lines group by r),
m as (select r, doc_id, lang, source, cast(len(ws) as bigint) as n_words,
  cast(length(t) - length(regexp_replace(t, '[^{_SPACE}]', '', 'g')) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words from w left join lined using (r) left join covered using (r)),
j as (select *, n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed, """ + ", ".join(
    f"{a} * {quality_rules.SCALE} // greatest({b}, 1) as v_{n}" for n, (a, b) in _VALUES.items()) + """ from m),
each as (""" + " union all ".join(f"select lang, source, '{n}' as rule, v_{n} as value from j where not base_failed" for n in _VALUES) + f"""),
sketch as (select lang, source, rule, {_BUCKET} as bucket, count(*) as n from each group by all),
{_quartiles("g0", "lang, source")}, {_quartiles("l0", "lang")}, {_quartiles("a0", "")},
limits as (select g.lang, g.source, {_limits()} from g0 g left join l0 l on g.lang is not distinct from l.lang and g.rule = l.rule
  left join a0 a on g.rule = a.rule group by g.lang, g.source),
v as (select j.*, list_filter([""" + ", ".join(
    [f"case when v_{n} > most_{n} then '{n}' end" for n in _RULES]
    + [f"case when v_{n} < least_{n} then 'low_{n}' end" for n, r in _RULES.items() if r[1]]) + """], lambda x: x is not null) as failed
  from j left join limits x on j.lang is not distinct from x.lang and j.source is not distinct from x.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and len(failed) = 0 as kept,
  array_to_string(failed, ',') as failed_rules from v
"""


def _kind(nth: int, kind: str, pattern: str, group: int, least: int) -> str:
    whole, inner, gaps = (f"regexp_extract_all(t, {q('(' + pattern + ')')}, {g})" for g in (1, group + 1, 0))
    gaps = f"string_split_regex(t, {q(pattern)})"
    upto = "list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)"
    return (f"select r, {nth} as nth, '{kind}' as kind, {upto} as begin, length(found[i]) as n, inside[i] as value from "
            f"(select r, {whole} as found, {inner} as inside, {gaps} as gaps, unnest(range(1, len({whole}) + 1)) as i from d) "
            f"where length(inside[i]) >= {least}")


SECRETS = """
with d as (select row_number() over () as r, doc_id, source as owner, concat_ws('/', source, lang) as repository, coalesce(text, '') as t from documents),
s as (""" + " union all ".join(_kind(n, *k) for n, k in enumerate(secrets.KINDS)) + f"""),
spans as (select s.*, kind || ':' || cast(begin as bigint) || ':' || cast(begin + n as bigint) as span, owner, repository from s join d using (r)),
owned as (select value, count(distinct coalesce(owner, '(none)')) as owners,
  count(distinct coalesce(owner, '(none)') || '//' || repository) as repositories from spans group by value),
judged as (select spans.*, owners, case when owners >= {secrets.MANY_OWNERS} or repositories >= {secrets.MANY_REPOSITORIES} then 'example'
  when kind = 'maker' or (regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')
  and len(list_distinct(string_split(value, ''))) >= 6) then 'live' else 'weak' end as verdict from spans join owned using (value)),
per as (select r, """ + ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in secrets.BASE) + """,
  array_to_string(list(span order by begin, nth) filter (kind in ('assign', 'access', 'hex')), ',') as base,
  array_to_string(list(span order by begin, nth), ',') as spans, """ + ", ".join(
    f"count(*) filter (verdict = '{v}') as n_{v}" for v in ("live", "example", "weak")) + """, max(owners) as most_owners from judged group by r)
select doc_id, """ + ", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in (*secrets.BASE, "live", "example", "weak")) + """,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(most_owners, 0) as most_owners from d left join per using (r)
"""

def _pairs_vector(of: str) -> str:
    """Lanes of the likeness part for the texts of a table (k, text), as a sum a bucket."""
    return f"""
{of}_words as (
  select k, no, list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'),
                               lambda w: ('0x' || substr(md5(w), 1, 8))::ubigint::uhugeint) as h
  from {of}_lines),
{of}_codes as (
  select k, unnest(list_transform(
    range(greatest(len(h) - 1, least(len(h), 1))),
    lambda i: (h[i + 1] * {FACTORS[0]}::uhugeint + (case when len(h) > 1 then h[i + 2] else 0::uhugeint end)
               * {FACTORS[1]}::uhugeint + {FACTORS[2]}::uhugeint) % 18446744073709551616::uhugeint)) as code
  from {of}_words where len(h) > 0),
{of}_sums as (
  select k, (code // 72057594037927936::uhugeint)::bigint as bucket,
         sum(1 - 2 * ((code // 36028797018963968::uhugeint) % 2::uhugeint)::bigint)::bigint as s
  from {of}_codes group by 1, 2),
{of}_lanes as (
  select k, list(coalesce(s, 0) order by bucket) as lanes
  from (select k, bucket, s from {of}_texts cross join (select unnest(range({BUCKETS})) as bucket) left join {of}_sums using (k, bucket))
  group by k),
{of}_halves as (
  select k, half, sha256(half || line) as h from {of}_lines cross join (values ('0'), ('1')) v(half)),
{of}_wide as (
  select k, string_agg(lane, '' order by half, part) as wide from (
    select k, half, part, lpad(lower(to_hex((sum(('0x' || substr(h, part * 16 + 1, 16))::ubigint::hugeint)
             % 18446744073709551616::hugeint)::ubigint)), 16, '0') as lane
    from {of}_halves cross join (select unnest(range(4)) as part) group by all) group by k),
{of}_made as (
  select k, wide, lanes, to_base64(from_hex(wide || array_to_string(list_transform(
           lanes, lambda x: lpad(lower(to_hex(((x % {LANE}) + {LANE}) % {LANE})), 6, '0')), ''))) as fingerprint
  from {of}_wide join {of}_lanes using (k))"""


#: The lanes are compared as signed numbers below 2 ** 23; no text of the tables goes beyond.
FINGERPRINTS = f"""
with own_texts as (
  select row_number() over (order by doc_id desc) as k, doc_id, coalesce(text, '') as text from documents),
follow as (
  select k, doc_id, text, length(text) as n, length(text) // 2 as cut,
         coalesce(lead(text) over (order by k), first_value(text) over (order by k)) as other,
         coalesce(lead(k) over (order by k), 1) as next
  from own_texts),
edited_texts as (select k, substr(text, 1, (n - cut)::bigint) || substr(other, 1, cut::bigint) as text from follow),
own_lines as (select k, no, line from (select k, unnest(string_split(text, chr(10))) as line, 0 as no from own_texts)),
edited_lines as (select k, no, line from (select k, unnest(string_split(text, chr(10))) as line, 0 as no from edited_texts)),
{_pairs_vector("own")},
{_pairs_vector("edited")},
near as (
  select a.k, t.kind, case when a.wide = b.wide and a.lanes = b.lanes then 1.0
      when list_sum(list_transform(a.lanes, lambda x: x * x)) = 0 or list_sum(list_transform(b.lanes, lambda x: x * x)) = 0 then 0.0
      else least(1.0, greatest(0.0, list_sum(list_transform(list_zip(a.lanes, b.lanes), lambda p: p[1] * p[2]))::double / sqrt(
        list_sum(list_transform(a.lanes, lambda x: x * x))::double * list_sum(list_transform(b.lanes, lambda x: x * x))::double)))
      end as near
  from (select k, next as j, 'next' as kind from follow union all select k, k, 'edited' from follow) t
  join own_made a using (k)
  join (select k, wide, lanes, 'next' as kind from own_made union all select k, wide, lanes, 'edited' from edited_made) b
    on b.k = t.j and b.kind = t.kind)
select f.doc_id, f.n::bigint as n_chars, sha256(e.text) as edited_sha256, o.fingerprint, m.fingerprint as edited_fingerprint,
       ne.near as near_edited, nn.near as near_next
from follow f join edited_texts e using (k) join own_made o using (k) join edited_made m using (k)
join (select k, near from near where kind = 'edited') ne using (k) join (select k, near from near where kind = 'next') nn using (k)
"""

HARD_NEGATIVES = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
         list_inner_product(a.e, b.e)::bigint as score
  from v a join v b on b.vec_id != a.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
windowed as (
  select p.anchor_id, p.positive_id, row_number() over (
           partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id)::int as rank,
         s.other_id as negative_id, p.positive_score, s.score as negative_score
  from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
    and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score)
select * from windowed where rank <= 10
"""


def _cheapest() -> str:
    """The columns of one step of the search, from the last row to the first.

    A state's best repair of what follows is a text: the cost in ten digits, then the audit,
    so the least text is the cheapest repair and, among those, the least audit.
    """
    def more(best: str, cost: str, letter: str) -> str:
        return f"(lpad((substr({best}, 1, 10)::bigint + {cost})::varchar, 10, '0') || '{letter}' || substr({best}, 11))"

    forced = [2, 2, 3, 2]  # states: 0 nothing yet, 1 system, 2 user, 3 assistant
    row = []
    for s in range(4):
        options = [more(f"b{s}", "3", "D"), f"case when not must_go then {more(f'b{forced[s]}', '2 + late', 'R')} end"]
        for initial, state, before in (("s", 1, (0,)), ("u", 2, (0, 1, 3)), ("a", 3, (2,))):
            if s in before:
                options.append(f"case when not must_go and initial = '{initial}' then {more(f'b{state}', 'late', 'K')} end")
        row.append(f"list_min([{', '.join(options)}]) as r{s}")
    once = [f"least(r{s}, {more(f'r{forced[s]}', '2', 'I')}) as o{s}" for s in range(4)]
    twice = [f"least(r{s}, {more(f'o{forced[s]}', '2', 'I')}) as b{s}" for s in range(4)]
    return (f"select conv, i - 1 as i, {', '.join(twice)} from (select *, {', '.join(once)} from ("
            f"select l.conv, l.i, {', '.join(row)} from search l join judged j on j.conv = l.conv and j.i = l.i))")


CONVERSATIONS = f"""
with recursive crc as (
  select list_transform(range(256), lambda n: list_reduce(
    list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) as t),
plain as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') as conv, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
  from conversations),
drawn as (
  select plain.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ascii(c)::bigint)),
           lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 as d from plain cross join crc),
rows as (
  select conv, turn, case when d = 4 then 'user' else role end as role,
         case when d = 1 then '' when d = 2 then translate(text, '.!?', '') else text end as text,
         unnest(range(case when d = 3 then 2 else 1 end)) as copy
  from drawn where d != 0),
placed as (
  select *, row_number() over (partition by conv order by turn nulls first, role, sha256(text), copy) as i,
         left(role, 1) as initial, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) as ending
  from rows),
faults as (
  select *, row_number() over (partition by conv, role, text order by i) > 1 as again,
         lag(initial) over (partition by conv order by i) as before, count(*) over (partition by conv) as n
  from placed),
judged as (
  select *, ending = '' as blank, ending != '' and again as duplicate,
         ending != '' and not again and not regexp_matches(ending, '[.!?]') as truncated,
         ending = '' or again as must_go,
         case when ending != '' and not again and not regexp_matches(ending, '[.!?]') then 1 else 0 end as late
  from faults),
search as (
  select distinct conv, n as i, '0000000000' as b0, '0000000004II' as b1, '0000000002I' as b2, '0000000000' as b3 from judged
  union all
  {_cheapest()}),
best as (select conv, substr(b0, 1, 10)::bigint as cost, substr(b0, 11) as audit from search where i = 0),
letters as (
  select conv, unnest(string_split(audit, '')) as letter, unnest(range(1, length(audit) + 1)) as k from best where audit != ''),
used as (
  select *, sum((letter != 'I')::int) over w as i, sum((letter != 'D')::int) over w as j
  from letters window w as (partition by conv order by k)),
written as (
  select u.conv, u.k, u.letter, u.j, r.role, case when letter = 'I' then '' else r.text end as text,
         max((u.j = 1 and letter = 'K' and initial = 's')::int) over (partition by u.conv) as opened
  from used u left join judged r on r.conv = u.conv and r.i = u.i and u.letter != 'I'),
repaired as (
  select conv, sha256(string_agg(case when letter = 'K' then role when (j - opened) % 2 = 1 then 'user' else 'assistant' end
                                 || ':' || text, chr(10) order by k)) as digest
  from written where letter != 'D' group by conv),
counted as (
  select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum(blank::int) as blank,
         sum(duplicate::int) as duplicate, sum(truncated::int) as truncated,
         sum((before is not null and before || initial not in ('su', 'ua', 'au'))::int) as illegal
  from judged group by conv)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank,
       coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit,
       coalesce(digest, sha256('')) as repaired_sha256
from (select distinct conv_id, conv from plain) c left join counted using (conv) left join best using (conv)
left join repaired using (conv)
"""

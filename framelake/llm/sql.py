"""DuckDB SQL for the operators that SQL can express, over the driver's views."""

from __future__ import annotations

import math

from . import negatives, quality, resampling, sharding

BLANK = r"[\x20\x09-\x0D]+"
WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}'), lambda x: x <> '')"


def _crc_table() -> list[int]:
    """The table of the reflected polynomial 0xEDB88320."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


def _feistel(value: str) -> str:
    """``{a, b}`` in scope; the text of the encrypted value."""
    left, right = f"(({value}) // b)", f"(({value}) % b)"
    mixed = lambda x, key: f"(((({x}) * 1103515 + {key}) % 2147483647 * 48271 + 12345) % 2147483647 // 64)"
    for i, key in enumerate(sharding.DEFAULT_KEYS):
        if i % 2 == 0:
            left = f"(({left} + {mixed(right, key)}) % a)"
        else:
            right = f"(({right} + {mixed(left, key)}) % b)"
    return f"{left} * b + {right}"


def sharding_sql(shards: int = 24) -> str:
    return f"""
with recursive t as (select {_crc_table()}::bigint[] crc),
h as (select doc_id, strlen(coalesce(text, '')) + 8 size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') bytes from documents),
d as (select doc_id, size::bigint size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(bytes, lambda x: ('0x' || x)::bigint)),
    lambda acc, x: xor(acc >> 8, crc[(xor(acc, x) & 255) + 1])), 4294967295::bigint) text_crc32 from h, t),
n as (select *, row_number() over (order by doc_id, text_crc32, size) - 1 row_number, count(*) over () total from d),
s as (select *, ceil(sqrt(total))::bigint a from n), u as (select *, ceil(total / a)::bigint b from s),
w as (select doc_id, total, a, b, row_number, {_feistel("row_number")} position from u
  union all select doc_id, total, a, b, row_number, {_feistel("position")} from w where position >= total)
select u.doc_id, u.size, u.text_crc32, 'rows' law, (w.position % {shards})::int shard, w.position // {shards} slot, null::int grown_shard, u.row_number
from u join w on w.row_number = u.row_number where w.position < u.total"""


SUBSTRINGS = rf"""
with d as (select doc_id, {WORDS} w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 18)) s from d where len(w) >= 20),
q as (select doc_id, s, array_to_string(w[s:s + 19], ' ') k from p),
r as (select doc_id, s, row_number() over (partition by k order by doc_id, s) i from q),
c as (select doc_id, list(distinct s + j) gone from r, range(0, 20) t(j) where i > 1 group by 1)
select d.doc_id, len(w) n_words, coalesce(len(gone), 0) n_removed,
  sha256(array_to_string(case when gone is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(gone, i)), lambda i: w[i]) end, ' ')) kept_sha256
from d left join c using (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES = rf"""
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) lines, string_split({_LOWER}, chr(10)) low, text is null nul from documents),
l as (select doc_id, unnest(low) line, generate_subscripts(low, 1) no from s),
t as (select doc_id, no, list_sort(list_distinct(list_filter(regexp_split_to_array(line, '{BLANK}'), lambda x: x <> ''))) t from l),
r as (select *, row_number() over (partition by t order by doc_id, no) i, hash(t) % 1 z from t where len(t) > 0),
h as (select doc_id, no, t, len(t) n from r where i = 1),
x as (select doc_id, no, n, unnest(t) w from h), f as (select w, count(*) df from x group by 1),
o as (select x.*, row_number() over (partition by doc_id, no order by df, x.w) p from x join f on f.w = x.w),
k as (select * from o where p <= n - ceil(0.8 * n - 1e-9) + 1),
c as (select distinct b.doc_id, b.no, a.doc_id ad, a.no an from k a join k b on a.w = b.w and (a.doc_id, a.no) < (b.doc_id, b.no) and a.n >= 0.8 * b.n and b.n >= 0.8 * a.n),
v as (select distinct c.doc_id, c.no from c join h y on y.doc_id = c.doc_id and y.no = c.no join h e on e.doc_id = ad and e.no = an
  where len(list_intersect(y.t, e.t)) >= 0.8 * (len(y.t) + len(e.t) - len(list_intersect(y.t, e.t))) - 1e-9),
g as (select doc_id, list(no) gone from (select doc_id, no from v union select doc_id, no from r where i > 1) group by 1)
select s.doc_id, case when nul then 0 else len(lines) end n_lines, coalesce(len(gone), 0) n_removed,
  sha256(array_to_string(case when gone is null then lines else list_transform(list_filter(range(1, len(lines) + 1), lambda i: not list_contains(gone, i)), lambda i: lines[i]) end, chr(10))) kept_sha256
from s left join g using (doc_id)"""


def quality_sql() -> str:
    gamma = (1 + quality.ACCURACY) / (1 - quality.ACCURACY)
    none = quality._NONE
    rates = quality.RATES
    long = ", ".join(f"{{'r': '{r}', 'v': {r}}}" for r in rates)
    least = "case rate " + " ".join(f"when '{r}' then {v}" for r, v in rates.items()) + " end"
    value = f"case when bin = {none} then 0.0 else 2 * power({gamma!r}, bin) / ({gamma!r} + 1) end"
    inside = " and ".join(f"coalesce({r} between {r}_low and {r}_high, true)" for r in rates)
    wide = ", ".join(f"max(case when rate = '{r}' then lo end) {r}_low, max(case when rate = '{r}' then hi end) {r}_high" for r in rates)
    return rf"""
with d as (select doc_id, lang, source, coalesce(text, '') text, {WORDS} w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 6)) s from d where len(w) >= 8),
q as (select doc_id, s, count(*) over (partition by doc_id, array_to_string(w[s:s + 7], ' ')) c from p),
e as (select doc_id, sum(least(8, coalesce(nx - s, 8)))::bigint n from (select doc_id, s, lead(s) over (partition by doc_id order by s) nx from q where c > 1) group by 1),
c as (select d.doc_id, lang, source, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, len(lines) nl, (length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g'))) up, coalesce(e.n, 0) n_repeat_words from d left join e using (doc_id)),
r as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed, n_symbols / nullif(n_words, 0) symbol_rate, n_dup_lines / nullif(nl, 0) dup_line_rate,
  word_chars / nullif(n_words, 0) word_length, up / nullif(word_chars, 0) upper_rate from c),
b as (select lang, source, x.r rate, case when x.v > 0 then ceil(ln(x.v) / {math.log(gamma)!r})::int else {none} end bin from (select lang, source, unnest([{long}]) x from r where not base_failed)),
m as (select 2 level, lang, source, rate, bin, count(*) n from b group by all union all select 1, lang, null, rate, bin, count(*) from b group by all union all select 0, null, null, rate, bin, count(*) from b group by all),
k as (select *, sum(n) over (partition by level, lang, source, rate order by bin) below, sum(n) over (partition by level, lang, source, rate) total from m),
z as (select level, lang, source, rate, max(total) total, min(bin) filter (below >= 0.25 * total) b25, min(bin) filter (below >= 0.75 * total) b75 from k group by 1, 2, 3, 4),
v as (select level, lang, source, rate, total, (select {value} from (select b25 bin)) q25, (select {value} from (select b75 bin)) q75 from z),
f as (select level, lang, source, rate, total, q25 - {quality.SPREAD} * greatest(q75 - q25, {least}) lo, q75 + {quality.SPREAD} * greatest(q75 - q25, {least}) hi from v),
g as (select a.lang, a.source, a.rate, case when a.total >= {quality.LEAST_DOCS} then a.lo when l.total >= {quality.LEAST_DOCS} then l.lo else o.lo end lo,
  case when a.total >= {quality.LEAST_DOCS} then a.hi when l.total >= {quality.LEAST_DOCS} then l.hi else o.hi end hi
  from f a left join f l on l.level = 1 and l.rate = a.rate and l.lang is not distinct from a.lang left join f o on o.level = 0 and o.rate = a.rate where a.level = 2),
y as (select lang, source, {wide} from g group by 1, 2)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {inside} kept
from r left join y on y.lang is not distinct from r.lang and y.source is not distinct from r.source"""


MINHASH = rf"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array({_LOWER}, '{BLANK}'), lambda x: x <> '') w from documents),
s as (select doc_id, list_distinct(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) s from d),
k as (select doc_id, len(s) n, unnest(s) k from s),
p as (select a.doc_id a, b.doc_id b, any_value(a.n) na, any_value(b.n) nb, count(*) i from k a join k b on a.k = b.k and a.doc_id < b.doc_id and 100 * b.n >= 80 * a.n and 100 * a.n >= 80 * b.n group by 1, 2),
l as (select a, b from p where 100 * i >= 80 * (na + nb - i)), e as (select a, b from l union all select b, a from l),
r as (select a, b from e union select r.a, e.b from r join e on e.a = r.b),
c as (select a, min(b) b from r group by 1)
select s.doc_id, len(s)::bigint n_shingles, least(s.doc_id, coalesce(c.b, s.doc_id)) component_id, s.doc_id = least(s.doc_id, coalesce(c.b, s.doc_id)) kept from s left join c on c.a = s.doc_id"""


def resampling_sql() -> str:
    n = resampling.BUCKETS
    words = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
    crc = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::bigint)),
    lambda acc, x: xor(acc >> 8, crc[(xor(acc, x) & 255) + 1])), 4294967295::bigint)"""
    return f"""
with t as materialized (select {_crc_table()}::bigint[] crc),
a as (select doc_id id, 0 side, {words} w from documents union all select item_id, 1, {words} from benchmark),
g as (select side, id, len(w) n_words, {runs} f from a),
u as (select side, id, unnest(f) f from g), m as materialized (select side, id, f, count(*) c from u group by all),
x as materialized (select f, {crc} % {n} bucket from (select distinct f from m), t),
y as (select side, id, bucket, sum(c) c from m join x using (f) group by all),
z as (select range bucket, coalesce(s, 0) s, coalesce(t, 0) t from range({n}) left join (select bucket, sum(c) filter (side = 0) s, sum(c) filter (side = 1) t from y group by 1) on bucket = range),
q as (select bucket, floor(1000 * ln(((t + 1) * (sum(s) over () + {n}))::double / ((s + 1) * (sum(t) over () + {n}))::double))::bigint gain from z),
v as (select id, sum(c) n_features, sum(c * gain) weight from y join q using (bucket) where side = 0 group by 1),
h as (select id doc_id, n_words, coalesce(n_features, 0)::bigint n_features, coalesce(weight, 0)::bigint weight,
  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint score
  from g left join v using (id) where side = 0),
o as (select doc_id, row_number() over (order by score desc, doc_id) i, count(*) over () n from h where n_words >= {resampling.LEAST_WORDS})
select h.doc_id, n_features, weight, score, case when i <= {resampling.PERCENT} * n // 100 then i end rank from h left join o using (doc_id)"""


NEGATIVES = f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor({negatives.SCALE} * x::double)) v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id a, a.label la, b.vec_id b, b.label lb, list_inner_product(a.v, b.v)::bigint s from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
y as (select a, b, s from p where la = lb qualify row_number() over (partition by a order by s desc, b) <= {negatives.POSITIVES})
select y.a anchor_id, y.b positive_id, (row_number() over (partition by y.a, y.b order by p.s desc, p.b))::int rank, p.b negative_id, y.s positive_score, p.s negative_score
from y join p on p.a = y.a and p.la <> p.lb and 80 * y.s <= 100 * p.s and p.s <= y.s qualify rank <= {negatives.NEGATIVES}"""


def every() -> dict[str, str]:
    return {
        "op2_line_dedup": LINES, "op5_sharding": sharding_sql(), "op7_substring_dedup": SUBSTRINGS, "op9_quality": quality_sql(),
        "op11_minhash": MINHASH, "op12_resampling": resampling_sql(), "op13_negatives": NEGATIVES,
    }

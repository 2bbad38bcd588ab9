"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import backoff_lm, chat_format, collocations, latent_leaks, license_scan, line_dedup, mixing, ngram_jaccard, private_spans, quality_rules, sharding, substring_dedup, token_alignment


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.license_labels(license_scan.license_spans(docs)).drop("spans")


def op2_poisson_mix(spark, sf_dir):
    mixed = mixing.poisson_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "copy", "n_copies", F.round("rate", 6).alias("rate"), "shuffle_key", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op3_backoff_scores(spark, sf_dir):
    scores = backoff_lm.backoff_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scores.select("doc_id", "n_words", F.round("mean_log_score", 6).alias("mean_log_score"))


def op4_ngram_jaccard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def op5_host_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.host_quality(docs, carry=["doc_id"])


def op6_remove_repeats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring_dedup.remove_repeats(docs)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_line_spread(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    cut = line_dedup.drop_spread_lines(docs, carry=["doc_id"])
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_snapshot_collapse(spark, sf_dir):
    chats = chat_format.maximal_conversations(table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", "n_turns", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op9_feistel_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.feistel_shards(docs, carry=["doc_id"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_latent_leaks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return latent_leaks.find_leaks(docs, table(spark, sf_dir, "benchmark"))


def op11_private_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return private_spans.counted(private_spans.private_spans(docs))


def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_token_alignment(spark, sf_dir):
    return token_alignment.aligned_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_poisson_mix, op3_backoff_scores, op4_ngram_jaccard, op5_host_quality, op6_remove_repeats, op7_line_spread, op8_snapshot_collapse, op9_feistel_shards, op10_latent_leaks, op11_private_spans, op12_collocations, op13_token_alignment)}

ORACLE = {
    "op3_backoff_scores": r"""
with t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'),
    lambda v: v <> '') as ws, row_number() over () as rid from documents),
w as (select rid, doc_id, i, ws[i] as w, case when i > 1 then ws[i - 1] end as v, case when i > 2 then ws[i - 2] end as p from (select *, unnest(range(1, len(ws) + 1)) as i from t)),
u as (select w, count(*) as c from w group by w having count(*) >= 2),
b as (select v, w, count(*) as c from w where v is not null group by v, w having count(*) >= 2),
g as (select p, v, w, count(*) as c from w where p is not null group by p, v, w having count(*) >= 2),
n as (select count(*) as n from w),
s as (select rid, sum(case when g.c is not null then ln(g.c / h.c) when b.c is not null then ln(0.4 * b.c / x.c) else ln(0.16 * coalesce(y.c, 0.5) / n.n) end) as total, count(*) as k
  from w cross join n left join g on g.p = w.p and g.v = w.v and g.w = w.w left join b h on h.v = w.p and h.w = w.v left join b on b.v = w.v and b.w = w.w left join u x on x.w = w.v left join u y on y.w = w.w group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, round(total / k, 6) as mean_log_score from t left join s using (rid)""",
    "op7_line_spread": r"""
with t as (select doc_id, coalesce('s' || source, 'none') as site, string_split(coalesce(text, ''), chr(10)) as ls, row_number() over () as rid from documents),
l as (select rid, site, i, ls[i] as line from (select *, unnest(range(1, len(ls) + 1)) as i from t)),
bad as (select line from l where length(line) >= 12 group by line having count(distinct site) >= 10),
k as (select rid, count(*) filter (where bad.line is not null) as gone, string_agg(l.line, chr(10) order by i) filter (where bad.line is null) as kept
  from l left join bad on bad.line = l.line group by rid)
select doc_id, cast(len(ls) as bigint) as n_lines, cast(gone as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from t join k using (rid)""",
    "op8_snapshot_collapse": r"""
with d as (select distinct conv_id, turn, role, text from conversations),
e as (select *, case when conv_id is null then coalesce(cast(turn as varchar), 'n') || '/' || coalesce('v' || role, 'n') || coalesce('v' || text, 'n') end as own from d),
c as (select conv_id, own, list(struct_pack(r := role, x := text) order by turn nulls first, role nulls first, text nulls first) as ts from e group by conv_id, own),
k as (select conv_id, own, ts, list_transform(ts, lambda t: coalesce('v' || length(t.r) || ':' || t.r, 'n') || coalesce('v' || length(t.x) || ':' || t.x, 'n')) as ks from c),
p as (select distinct array_to_string(ks[1:i], '') as pre, i from (select ks, unnest(range(1, len(ks))) as i from k)),
f as (select *, array_to_string(ks, '') as f, len(ks) as n from k),
o as (select * from (select *, row_number() over (partition by f order by conv_id nulls last, own) as place from f where not exists (select 1 from p where p.pre = f and p.i = n)) q where place = 1),
r as (select conv_id, len(ts) as n, array_to_string(list_transform(ts, lambda t: '<|im_start|>' || coalesce(t.r, 'unknown') || chr(10)
    || replace(replace(coalesce(t.x, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10)), '') as rendered from o)
select conv_id, cast(n as bigint) as n_turns, cast(length(rendered) as bigint) as n_chars, sha256(rendered) as rendered_sha256 from r""",
    "op2_poisson_mix": r"""
with per as (select coalesce('s' || source, 'n') as src, count(*) as n, pow(count(*), 0.5) as w from documents group by 1),
tot as (select sum(n) as tn, sum(w) as tw from per),
rates as (select src, tn * w / tw / n as rate from per, tot),
drawn as (select d.doc_id, d.source, d.text, r.rate, cast('0x' || substr(md5('17:' || coalesce(cast(d.doc_id as varchar), 'null')), 1, 13) as bigint) / cast(4503599627370496 as double) as u
  from documents d join rates r on r.src = coalesce('s' || d.source, 'n')),
counted as (select *, cast(len(list_filter(range(0, cast(ceil(rate + 12 * sqrt(rate) + 20) as bigint) + 1),
    lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(-rate + i * ln(rate) - lgamma(i + 1)))) <= u)) as integer) as n_copies from drawn),
copies as (select doc_id, source, text, rate, n_copies, cast(unnest(range(0, n_copies)) as integer) as copy from counted where n_copies > 0)
select doc_id, source, copy, n_copies, round(rate, 6) as rate,
  cast('0x' || substr(md5('17/' || coalesce(cast(doc_id as varchar), 'null') || '/' || copy), 1, 15) as bigint) as shuffle_key, md5(coalesce(text, '')) as text_md5
from copies""",
    "op4_ngram_jaccard": r"""
with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'),
    lambda v: v <> '') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) end) as g from t),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from t union select r.a, e.b from r join e on e.a = r.b)
select t.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, c.id as component_id
from t left join n using (doc_id) join (select a, min(b) as id from r group by a) c on c.a = t.doc_id""",
    "op6_remove_repeats": r"""
with t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda v: v <> '') as ws, row_number() over () as rid from documents),
w as (select rid, doc_id, i, ws[i] as word, case when i + 49 <= len(ws) then array_to_string(ws[i:i + 49], ' ') end as g
  from (select *, unnest(range(1, len(ws) + 1)) as i from t)),
m as (select g, min(doc_id) as least from w where g is not null group by g),
f as (select rid, i, word, coalesce(least < doc_id, false) as hit from w left join m using (g)),
c as (select rid, i, word, bool_or(hit) over (partition by rid order by i rows between 49 preceding and current row) as gone from f),
k as (select rid, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by i) filter (where not gone) as kept from c group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from t left join k using (rid)""",
    "op5_host_quality": r"""
with t as (select doc_id, source, coalesce(text, '') as x from documents),
w as (select doc_id, source, x, list_filter(regexp_split_to_array(x, '[ \t\n\x0B\f\r]+'), lambda v: v <> '') as ws,
    list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) as ls, row_number() over () as rid from t),
win as (select rid, i, array_to_string(ws[i:i + 4], ' ') as g from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
dup as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from win) where c > 1),
cov as (select rid, cast(sum(least(5, i - coalesce(p, -99))) as bigint) as r from (select rid, i, lag(i) over (partition by rid order by i) as p from dup) group by rid),
s as (select doc_id, source, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
    cast(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(ls) as bigint) as n_lines,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, coalesce(r, 0) as n_repeat_words
  from w left join cov using (rid)),
b as (select *, n_words < 10 or n_repeat_words * 100 > n_words * 20 as base_failed from s),
f as (select *, base_failed or n_symbols * 100 > n_words * 50 or n_dup_lines * 100 > n_lines * 50 as rule_failed from b),
h as (select source, count(*) as n, sum(rule_failed::int) as bad from f where source is not null group by source),
p as (select avg(bad / n) as m, var_samp(bad / n) as v, avg(1 / n) as a from h),
r as (select m, case when v is not null and m > 0 and m < 1 and a < 1 then (v / (m * (1 - m)) - a) / (1 - a) end as rho from p),
q as (select m, case when rho is null then 20.0 else 1 / least(greatest(rho, 1e-6), 0.999) - 1 end as k from r)
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, rule_failed, round((bad + m * k) / (n + k), 6) as host_rate,
  not base_failed and coalesce(round((bad + m * k) / (n + k), 6) <= 0.6, true) as kept
from f left join (select h.*, q.* from h, q) g on g.source = f.source""",
}


def _license_sql() -> str:
    """The scan's labels: each template as a regular expression over words that follow blanks."""
    method = ", ".join(f"case when regexp_matches(j, '{license_scan.template_regex(t)} ') then '{k}' end" for k, t in license_scan.TEMPLATES.items())
    starts = []
    for k, t in license_scan.PHRASES.items():
        words = t.split()
        same = " and ".join(f"ws[i + {n}] = '{w}'" for n, w in enumerate(words))
        starts.append(f"list_transform(list_filter(range(1, len(ws) + 1), lambda i: {same}), lambda i: struct_pack(p := i - 1, l := '{k}'))")
    return rf"""
with w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda v: v <> '') as ws from documents),
s as (select doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' as j, flatten([{", ".join(starts)}]) as b from w),
m as (select doc_id, ws, b, list_filter([{method}], lambda v: v is not null) as ms, list_transform(b, lambda x: x.p) as ps, list_distinct(list_transform(b, lambda x: x.l)) as bl from s)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(b) as bigint) as n_base, list_min(ps) as first_word, list_max(ps) as last_word,
  array_to_string(list_sort(bl), ',') as base_labels, array_to_string(list_sort(list_concat(bl, ms)), ',') as labels,
  cast(case when len(ms) > 0 then 1.0 when len(b) > 0 then 0.5 else 0.0 end as double) as score
from m"""


ORACLE["op1_license_scan"] = _license_sql()
ORACLE["op11_private_spans"] = private_spans.oracle_sql()
ORACLE["op12_collocations"] = collocations.ORACLE

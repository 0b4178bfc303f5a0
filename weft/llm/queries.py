"""Registered queries of the corpus operators, at production parameters, and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import chat_format, exact_dedup, jaccard_join, language_id, mixing, quality_rules, sentencepiece_codec, substring_dedup, suffix_dedup, url_filter
from weft.llm.common import table

#: (host, path, verdict): the fixed rules of the URL query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).withColumn("posterior", F.round("posterior", 6))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(str(rule) for rule in URL_RULES)
    rules = spark.sql(f"select * from values {values} as rules(host, path, verdict)")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_words(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), SENTENCEPIECE_MODEL)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.formatted(chat_format.placed(chat_format.link_quotes(table(spark, sf_dir, "conversations"))))


def _em_sql() -> str:
    """Votes by pattern, and the estimation over them as a recursion of one row: the prior, and each rule's votes in both classes."""
    pairs = [(r, v) for r in range(6) for v in (1, -1)]
    place = lambda r: f"({2 * r} + (3 - v{r}) // 2)"
    odds = "ln(prior / (1 - prior)) + " + " + ".join(f"case when v{r} = 0 then 0 else ln(g[{place(r)}] / b[{place(r)}]) end" for r in range(6))
    learn = lambda p: "[" + ", ".join(f"(0.5::double + coalesce(sum({p} * n) filter (v{r} = {v}), 0)) / (1 + coalesce(sum({p} * n) filter (v{r} <> 0), 0))" for r, v in pairs) + "]"
    start = lambda row: "[" + ", ".join(f"{x}::double" for x in row * 6) + "]"
    names = ", ".join(f"v{r}" for r in range(6))
    return f"""patterns as materialized (select {names}, count(*)::double n from votes group by all),
em(step, prior, g, b) as (select 0, 0.8::double, {start([0.8, 0.2])}, {start([0.2, 0.8])} union all
  select step + 1, least(greatest((sum(p * n) + 0.8::double) / (sum(n) + 1), 1e-6::double), 1 - 1e-6::double), {learn('p')}, {learn('(1 - p)')}
  from (select step, patterns.*, 1 / (1 + exp(-({odds}))) p from em, patterns where step < 50) group by step),
verdict as (select doc_id, 1 / (1 + exp(-({odds}))) posterior from votes, em where step = 50)"""


ORACLES = {
    "op2_quality_rules": r"""
with recursive d as materialized (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from documents),
x as (select doc_id, i, w[i:i + 4] five from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d where len(w) >= 5)),
o as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, five) n from x) where n > 1),
c as (select doc_id, count(*) n from (select distinct doc_id, unnest(range(i, i + 5)) place from o) group by doc_id),
s as materialized (select d.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint n_symbols,
  (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words, len(l) lines, len(list_filter(w, lambda x: regexp_full_match(x, '\p{L}{1,3}([,.;:!?].*)?'))) short from d left join c using (doc_id)),
q as (select doc_id, n_words, lines, short, word_chars::double / greatest(n_words, 1) mean, n_symbols::double / greatest(word_chars, 1) signs, n_dup_lines::double / greatest(lines, 1) dup, n_repeat_words::double / greatest(n_words, 1) rep from s),
votes as materialized (select doc_id, case when n_words >= 50 then 1 when n_words < 10 then -1 else 0 end v0, case when mean >= 3 and mean <= 10 then 1 when mean < 2 or mean > 14 then -1 else 0 end v1,
  case when signs <= 0.01::double then 1 when signs >= 0.08::double then -1 else 0 end v2, case when lines < 3 then 0 when dup <= 0.05::double then 1 when dup >= 0.3::double then -1 else 0 end v3,
  case when rep <= 0.02::double then 1 when rep >= 0.2::double then -1 else 0 end v4, case when n_words < 20 then 0 when short >= 0.15::double * n_words then 1 when short < 0.02::double * n_words then -1 else 0 end v5 from q),
""" + _em_sql() + r"""
select s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and posterior >= 0.5 kept, round(posterior, 6) posterior from s join verdict using (doc_id)
""",
    "op1_exact_dedup": """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
""",
    "op3_url_filter": r"""
with rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest as (select page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end r from pages),
cut as (select page_id, regexp_extract(coalesce(r, ''), '^[^?#]*') r from rest),
parts as (select page_id, lower(regexp_extract(r, '^[^/]*')) host, regexp_extract(r, '^[^/]*(.*)$', 1) path from cut),
fits as (select page_id, h || p rule, v, row_number() over (partition by page_id order by length(h || p) desc, length(h) desc) n
  from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select parts.page_id, host, path, rule, coalesce(v, 'allow') verdict from parts left join fits on parts.page_id = fits.page_id and n = 1
""",
    "op4_suffix_dedup": r"""
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
b as (select doc_id, base, substr(h, 2 * base + 1, 2146) h from (select doc_id, h, unnest(range(0, length(h) // 2, 1024)) base from d)),
w as materialized (select doc_id, base + i i, md5_number(substr(h, 2 * i + 1, 100)) g from (select doc_id, base, h, unnest(range(0, length(h) // 2 - 49)) i from b where length(h) >= 100)),
f as (select g, min(doc_id) owner from w group by g having min(doc_id) < max(doc_id)),
r as materialized (select w.doc_id, i from w join f using (g) where owner < w.doc_id),
j as (select *, coalesce(i > lag(i) over (partition by doc_id order by i) + 50, true) as opens from r),
k as materialized (select doc_id, min(i) lo, max(i) + 50 hi from (select *, sum(opens::int) over (partition by doc_id order by i) run from j) group by doc_id, run),
q as (select doc_id, hi a, lead(lo) over (partition by doc_id order by lo) b, 0 first from k union all select doc_id, 0, min(lo), 1 from k group by doc_id),
o as (select q.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' order by a, first desc) kept from q join d using (doc_id) group by q.doc_id),
t as (select doc_id, sum(hi - lo) gone, count(*) spans from k group by doc_id)
select d.doc_id, (length(h) // 2)::bigint n_bytes, coalesce(gone, 0)::bigint n_removed, coalesce(spans, 0)::bigint n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256 from d left join t using (doc_id) left join o using (doc_id)
""",
    "op5_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
x as (select doc_id, i, w[i:i + 34] words from (select doc_id, w, unnest(range(1, len(w) - 33)) i from d where len(w) >= 35)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by words) n from x) where n > 1),
g as (select distinct doc_id, unnest(range(i, i + 35)) place from r),
p as (select doc_id, w[place] word, place from (select doc_id, w, unnest(range(1, len(w) + 1)) place from d)),
k as (select doc_id, count(*)::bigint n, string_agg(word, ' ' order by place) body from p anti join g using (doc_id, place) group by doc_id)
select d.doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(body, '')) kept_sha256 from d left join k using (doc_id)
""",
    "op6_jaccard_join": r"""
with recursive d as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as materialized (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) g from d),
n as materialized (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
m as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
l as materialized (select a, b from m union all select b, a from m),
c(id, label) as (select doc_id, doc_id from d union select l.b, c.label from c join l on l.a = c.id where c.label < l.b)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, min(c.label) component_id from d left join n using (doc_id) join c on c.id = d.doc_id group by d.doc_id, n.n
""",
    "op7_mix": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, length(text) n, length(translate(text, '#*$%&|<>', ''))::double plain, string_split(text, chr(10)) lines, md5(coalesce(text, '')) m from documents),
u as (select *, (('0x' || substr(md5('7|' || coalesce(doc_id::varchar, '') || '|' || m), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double draw from d),
k as (select *, -ln(draw) / case when n > 0 then greatest((plain / n) * (len(list_distinct(lines))::double / len(lines)), 0.01::double) else 1.0::double end as key from u),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, (((row_number() over (order by source nulls last) - 1) % 3) + 1)::double weight, 3.0::double * source_size cap from s),
v as (select *, greatest(0.0::double, sum(source_size::double) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) lev from w),
t as (select *, least(cap, coalesce((select lev from v where lev <= cap / weight order by cap / weight limit 1), 'inf'::double) * weight) target from v),
e as (select *, case when source_size > 0 then least(3, floor(target / source_size)) else 0 end::bigint epochs from t),
r as (select k.doc_id, k.size, e.source_size, e.target, epochs, target - epochs * e.source_size budget, sum(size) over (partition by k.source order by key, doc_id rows unbounded preceding) upto from k join e on k.source is not distinct from e.source),
c as (select *, epochs + case when budget > 0 and upto - size / 2.0::double <= budget and epochs < 3 then 1 else 0 end copies from r)
select doc_id, size, source_size, target, (size * copies)::bigint taken, copies::bigint copies from c
""",
}

QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_quality_rules, op3_url_filter, op4_suffix_dedup, op5_substring_dedup, op6_jaccard_join, op7_mix, op8_sentencepiece, op9_language_id, op10_chat_format)} | {"pipeline": corpus_pipeline.run}

"""The registered queries of the operators in this folder, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, html_main, mixing, ngram_join, pii, quality_rules, sharding, suffix_dedup, token_store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


def tokenizer_path() -> str:
    """The default vocabulary file; operators take the path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), end=2)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs.select("doc_id", "text"), rules, name="judged")
    j = F.col("judged")
    return judged.select("doc_id", *[j.counts[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], j.base_failed.alias("base_failed"), j.kept.alias("kept"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.report(decontamination.find(docs, table(spark, sf_dir, "benchmark")))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.format_and_read(rows.unionByName(probe))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_token_store, op3_quality_rules, op4_decontamination, op5_chat, op6_html, op7_sharding, op8_ngram_join, op9_suffix_dedup, op10_mixing)
}

ORACLE: dict[str, str] = {
    "op4_decontamination": r"""
with docs as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
items as (
  select coalesce(cast(item_id as varchar), '') as item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
wins as (
  select distinct item, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as s
  from (select item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from items where len(w) > 0)),
sizes as (select distinct n from wins),
dwins as (
  select r, n, i, array_to_string(w[i:i + n - 1], ' ') as s
  from (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from docs, sizes where len(w) >= n)),
hits as (select d.r, d.i, d.n, k.item from dwins d join wins k on d.n = k.n and d.s = k.s),
cover as (select r, count(distinct p) as n_hit from (select r, unnest(generate_series(i, i + n - 1)) as p from hits) group by r),
found as (select r, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, item from hits) group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(f.n_items, 0)::bigint as n_items,
  sha256(coalesce(f.names, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from docs d left join cover c using (r) left join found f using (r)""",
    # enough for the markup that these pages have, which is simple
    "op6_html": r"""
with cut as (
  select page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:h[1-6]|p|div|section|ul|ol|li|blockquote|pre)>') as b from pages),
plain as (select page_id, url, list_transform(b, lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')) as b from cut),
decoded as (
  select page_id, url, list_transform(b, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(x,
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&#x27;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as b from plain),
found as (select page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) as text from decoded)
select page_id, url, text, length(text)::bigint as n_chars from found""",
    "op8_ngram_join": r"""
with recursive docs as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select distinct r, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') as s
  from (select r, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) as i from docs where len(w) > 0)),
sizes as (select r, count(*) as n from sets group by r),
shared as (select a.r as a, b.r as b, count(*) as k from sets a join sets b on a.s = b.s and a.r <> b.r group by all),
links as (select a, b from shared join sizes x on x.r = a join sizes y on y.r = b where 100 * k >= 70 * (x.n + y.n - k)),
reach as (select r as a, r as b from docs union select reach.a, links.b from reach join links on reach.b = links.a),
roots as (select reach.a as r, min(docs.doc_id) as component_id from reach join docs on docs.r = reach.b group by reach.a),
near as (select a as r, count(*) as n from links group by a)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, coalesce(k.n, 0)::bigint as n_similar, c.component_id
from docs d left join sizes s using (r) left join near k using (r) join roots c using (r)""",
    "op5_chat": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
formatted as (
  select *, 14 + length(regexp_replace(role, '(\\|###|</turn>|<\||:)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>|<\|)', '\\\1', 'g')) as chars from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
from formatted group by conv_id""",
    "op9_suffix_dedup": r"""
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select r, doc_id::hugeint * 1000000000 + i as k, i, substr(h, 2 * i + 1, 200) as s from (select *, unnest(generate_series(0, n - 100)) as i from d where n >= 100)),
dup as (select r, i from (select r, i, k, min(k) over (partition by s) as m from w) where k > m),
isl as (select r, i, case when i - lag(i) over (partition by r order by i) <= 100 then 0 else 1 end as new from dup),
grp as (select r, i, sum(new) over (partition by r order by i) as g from isl),
spans as (select r, min(i) as a, max(i) + 100 as b from grp group by r, g),
parts as (
  select r, coalesce(lag(b) over (partition by r order by a), 0) as p, a as q from spans
  union all select d.r, coalesce(max(b), 0), any_value(n) from d left join spans using (r) group by d.r),
kept as (select r, string_agg(substr(h, 2 * p + 1, 2 * (q - p)), '' order by p) as k from parts join d using (r) where q > p group by r),
sums as (select r, sum(b - a) as removed, count(*) as spans from spans group by r)
select doc_id, n::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(coalesce(unhex(k), ''::blob)) as kept_sha256
from d left join kept using (r) left join sums using (r)""",
}

"""Registered queries over the star-schema and text tables, with the DuckDB SQL that each must agree with.

Columns of doubles are rounded on both sides, as sums depend on their order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import vectors as V
from .operators import frequencies, hashing, neighbours, ranks, relations, stats, suggest, vocab, weights, words
from .plans import pipelines
from .sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


#: tokens of documents, in SQL
TOKENS = "(select doc_id, lang, source, unnest(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) as token from documents)"
FREQ = f"(select token, count(distinct doc_id) as doc_freq, count(*) as term_freq from {TOKENS} group by token)"
LANG = f"(select lang, token, count(distinct doc_id) as doc_freq, count(*) as term_freq from {TOKENS} group by lang, token)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _freq(spark: SparkSession, d: str, *by: str) -> DataFrame:
    return frequencies.frequencies(_docs(spark, d), X.tokens(F.col("text")), *by)


# --- frequencies -----------------------------------------------------------------------------------------------------


@query(f"select token, doc_freq, term_freq from {FREQ}")
def token_freq(spark, d):
    return _freq(spark, d)


@query(f"select lang, token, doc_freq, term_freq from {LANG}")
def token_freq_by_lang(spark, d):
    return _freq(spark, d, "lang")


@query(f"""
with f as (select doc_freq from {FREQ}), q as (select quantile_cont(doc_freq, [0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99, 1.0]) as v from f)
select unnest([0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99, 1.0]::double[]) as percent, unnest(list_transform(v, lambda x: cast(trunc(x) as bigint))) as value from q""")
def freq_percentiles(spark, d):
    return frequencies.percentiles(_freq(spark, d), "doc_freq")


@query(f"with f as {FREQ}, b as (select greatest(20, cast(trunc(quantile_cont(doc_freq, 0.85)) as bigint)) as bar from f) select token, doc_freq, term_freq from f, b where doc_freq >= bar")
def vocab_threshold(spark, d):
    return frequencies.above_threshold(_freq(spark, d))


@query("select count(*) as n_docs, coalesce(sum(len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))), 0)::bigint as n_tokens from documents")
def corpus_counts(spark, d):
    return frequencies.corpus_counts(_docs(spark, d), X.tokens(F.col("text")))


@query(f"with p as (select doc_id % 3 as k, token as word, count(distinct doc_id) as doc_freq, count(*) as term_freq from {TOKENS} group by all) select word, sum(doc_freq)::bigint as doc_freq, sum(term_freq)::bigint as term_freq from p group by word having sum(doc_freq) >= 2")
def merge_partials(spark, d):
    docs = _docs(spark, d)
    parts = [frequencies.frequencies(docs.where(F.col("doc_id") % 3 == k), X.tokens(F.col("text"))).withColumnRenamed("token", "word") for k in range(3)]
    return frequencies.merge_parts(parts, 2)


@query(f"select token, doc_freq, term_freq from {FREQ} where doc_freq >= 5")
def min_freq_filter(spark, d):
    return frequencies.at_least(_freq(spark, d), 5)


@query(f"select token as word, count(*) as n from {TOKENS} group by token having count(*) >= 3")
def word_counts(spark, d):
    return frequencies.word_counts(_docs(spark, d), X.tokens(F.col("text")), 3)


@query(f"select token, doc_freq, term_freq from {FREQ} order by doc_freq desc, term_freq desc, token limit 100")
def top_tokens(spark, d):
    return frequencies.ordered(_freq(spark, d)).limit(100)


# --- filters, projections, joins -------------------------------------------------------------------------------------


@query("select region, count(*) as n from (select doc_id, unnest(list_filter([case when lang = 'en' then 'english' end, case when lang in ('fr', 'es') then 'romance' end, case when source = 'src0' or n_chars >= 5000 then 'large' end], lambda x: x is not null)) as region from documents) group by region")
def region_filters(spark, d):
    tests = {"english": F.col("lang") == "en", "romance": F.col("lang").isin("fr", "es"), "large": (F.col("source") == "src0") | (F.col("n_chars") >= 5000)}
    return relations.by_region(_docs(spark, d), tests).groupBy("region").agg(F.count("*").alias("n"))


@query("select doc_id, lang from documents where lang not in ('en', 'fr') or lang is null")
def reverse_filter(spark, d):
    return relations.apply(_docs(spark, d), relations.field_filter("lang", ["en", "fr"], reverse=True)).select("doc_id", "lang")


@query("select doc_id, lang, source from documents where lang = 'de' or source in ('src1', 'src2')")
def or_merge(spark, d):
    test = relations.any_of([relations.field_filter("lang", "de"), None, relations.field_filter("source", ["src1", "src2"])])
    return relations.apply(_docs(spark, d), test).select("doc_id", "lang", "source")


@query("select o_orderkey, o_totalprice from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01' and o_totalprice > 250")
def date_range(spark, d):
    return relations.apply(table(spark, d, "orders"), relations.between("o_orderdate", dt.datetime(1995, 1, 1), dt.datetime(1996, 1, 1))).where("o_totalprice > 250").select("o_orderkey", "o_totalprice")


@query("select p_partkey, concat_ws(' | ', nullif(p_name, ''), nullif(p_brand, ''), nullif(p_type, ''), nullif(p_name, '')) as sentence from part")
def field_concat(spark, d):
    return table(spark, d, "part").select("p_partkey", X.joined(*map(F.col, ("p_name", "p_brand", "p_type", "p_name"))).alias("sentence"))


@query("select p_partkey, lower(trim(concat_ws(' | ', nullif(p_name, ''), case when p_size % 2 = 0 then null else p_brand end, nullif(p_type, '')))) as sentence from part")
def field_concat_skip_dash(spark, d):
    dash = F.when(F.col("p_size") % 2 == 0, "-").otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", X.joined_words(F.col("p_name"), dash, F.col("p_type")).alias("sentence"))


@query("select p_partkey, concat('<name>', p_name, '</name>', case when p_size % 2 = 0 then '' else concat('<desc>', p_type, '</desc>') end) as sentence from part")
def tagged_text(spark, d):
    dash = F.when(F.col("p_size") % 2 == 0, "-").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", X.tagged({"name": F.col("p_name"), "desc": dash}).alias("sentence"))


@query("select p_partkey, trim(concat_ws(' ', coalesce(p_name, ''), coalesce(p_type, ''), coalesce(p_brand, ''))) as sentence from part")
def merged_text(spark, d):
    return table(spark, d, "part").select("p_partkey", X.merged(*map(F.col, ("p_name", "p_type", "p_brand"))).alias("sentence"))


@query("select o_orderkey, case when v <= 100 then o_orderpriority else repeat(o_orderpriority || ' ', case when v >= 10000000 then 8 else cast(floor(log10(v + 1)) as int) + 1 end) end as sentence from (select *, cast(floor(o_totalprice) as bigint) as v from orders)")
def replicate_by_view(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.replicated_by_views(F.col("o_orderpriority"), F.floor("o_totalprice")).alias("sentence"))


@query("select o_orderkey, o_custkey, l_linenumber, l_partkey from orders join lineitem on o_orderkey = l_orderkey")
def lookup_unwind(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "key")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey")
    return relations.look_up(orders, lines, "key").select(F.col("key").alias("o_orderkey"), "o_custkey", "l_linenumber", "l_partkey")


@query("select distinct doc_id from documents where exists (select 1 from labels l where l.doc_id = documents.doc_id and l.quality = 1)")
def vectorized_semi(spark, d):
    return relations.done(_docs(spark, d), table(spark, d, "labels").where("quality = 1"), "doc_id").select("doc_id")


@query("select distinct doc_id from documents where not exists (select 1 from labels l where l.doc_id = documents.doc_id)")
def todo_anti(spark, d):
    return relations.to_do(_docs(spark, d), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("select doc_id from documents where doc_id not in (select doc_id from labels) order by doc_id limit 50")
def todo_quota(spark, d):
    return relations.to_do_first(_docs(spark, d), table(spark, d, "labels"), "doc_id", [F.col("doc_id")], 50).select("doc_id")


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_mktsegment is not null and o_custkey in (select s_suppkey from supplier)")
def lookup_join(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "id")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment")
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return relations.look_up_ids(orders, customers, ids, "id", ["c_mktsegment"]).select("o_orderkey", "c_name")


@query("select d.doc_id, l.quality from documents d left join labels l using (doc_id)")
def dictionary_left(spark, d):
    return relations.dictionary(_docs(spark, d).select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("select doc_id, doc_id in (select doc_id from labels) as exists from documents".replace("as exists", 'as "exists"'))
def key_exists(spark, d):
    return relations.exists(_docs(spark, d).select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("select vec_id, i - 1 as place, embedding[i] as x, embedding[i] * 2 as y from (select vec_id, embedding, unnest(generate_series(1, len(embedding))) as i from embeddings)")
def ordered_zip(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x")).withColumn("y", F.transform("x", lambda v: v * 2))
    return relations.zip_lists(rows, "x", "y").withColumn("place", F.col("place").cast("long")).select("vec_id", "place", "x", F.col("y").cast("float").alias("y"))


# --- statistics ------------------------------------------------------------------------------------------------------

_RANGES = [(dt.date(y, 1, 1), dt.date(y + 1, 1, 1)) for y in range(1992, 1999)]
_RANGE_SQL = "(select make_date(y, 1, 1) as lo, make_date(y + 1, 1, 1) as hi, cast(make_date(y, 1, 1) as varchar) as range_start from (select unnest(generate_series(1992, 1998)) as y))"
_POINTS = ", ".join(str(p) for p in stats.POINTS)


@query(f"""
select range_start, count(*) as count, cast(round_even(avg(o_totalprice), 0) as bigint) as o_totalprice_avg, cast(round_even(stddev_pop(o_totalprice), 0) as bigint) as o_totalprice_std,
  quantile_disc(o_totalprice, 0.5) as o_totalprice_median, quantile_disc(o_totalprice, [{_POINTS}]) as o_totalprice_percentile, max(o_totalprice, 10) as o_totalprice_maxn
from orders join {_RANGE_SQL} on o_orderdate >= lo and o_orderdate < hi group by range_start""")
def stat_agg_by_range(spark, d):
    return stats.summaries(table(spark, d, "orders"), F.col("o_orderdate"), ["o_totalprice"], stats.ranges_table(spark, _RANGES))


_BUCKET_SQL = "case " + " ".join(f"when v >= {a:.0f} and v < {b:.0f} then '{a:.0f}'" for a, b in zip(stats.EDGES, stats.EDGES[1:])) + " else 'others' end"


@query(f"""
select bucket, min(v) as view_min, max(v) as view_max, count(*) as count, round_even(avg(r), 4) as ratio_avg, round_even(stddev_pop(r), 4) as ratio_std, round_even(quantile_disc(r, 0.5), 4) as ratio_median
from (select l_extendedprice as v, case when l_extendedprice <= 0 then 0 else l_quantity * 100 / l_extendedprice end as r, {_BUCKET_SQL} as bucket from (select *, l_extendedprice as v from lineitem)) group by bucket""")
def stat_ratio_bucket(spark, d):
    return stats.ratio_buckets(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")


@query("select event_type, user_id, count(*) as count from events group by all")
def tid_counts(spark, d):
    return stats.group_counts(table(spark, d, "events"), "event_type", "user_id")


@query("select shard, sum(n)::bigint as total, list_sort(list(distinct lang)) as regions, count(*) as units from (select lang, source, count(*) as n, hash_ % 4 as shard from (select *, doc_id % 4 as hash_ from documents) group by all) group by shard")
def shard_summary(spark, d):
    units = _docs(spark, d).groupBy("lang", "source", (F.col("doc_id") % 4).alias("shard")).agg(F.count("*").alias("count"))
    return stats.shard_summary(units, "lang")


@query()
def shard_assignment(spark, d):
    return stats.assigned(_docs(spark, d).groupBy(F.concat_ws("/", "lang", "source").alias("region")).agg(F.count("*").alias("count")), 4)


@query("select unnest(['one', 'the', 'long']) as name, unnest([count(*) filter (contains(text, 'one')), count(*) filter (contains(lower(text), 'the')), count(*) filter (n_chars > 3000)]) as doc_count from documents")
def filters_agg(spark, d):
    return stats.predicate_counts(_docs(spark, d), {"one": F.col("text").contains("one"), "the": F.lower("text").contains("the"), "long": F.col("n_chars") > 3000})


# --- words and vocabularies ------------------------------------------------------------------------------------------


@query()
def words_en_extract(spark, d):
    return words.word_records(_docs(spark, d), F.col("text"), least=2)


@query(f"select token, length(regexp_replace(token, '[^a-z]', '', 'g')) as letters, length(regexp_replace(token, '[^aeiou]', '', 'g')) as vowels, length(regexp_replace(token, '[^0-9]', '', 'g')) as numbers, regexp_full_match(token, '[b-df-hj-np-tv-z]{{5,}}') as random from (select distinct token from {TOKENS})")
def words_en_rules(spark, d):
    t = F.col("token")
    n = lambda p: X.count(t, p)
    return _freq(spark, d).select("token", n("[a-z]").alias("letters"), n("[aeiou]").alias("vowels"), n("[0-9]").alias("numbers"), X.no_vowels(t).alias("random"))


@query(f"""
select flag, count(*) as n from (select unnest(case when len(f) = 0 then ['plain'] else f end) as flag from (
  select list_filter([case when regexp_matches(token, '[A-Za-z]') and regexp_matches(token, '[0-9]') then 'mixed' end, case when length(token) <= 3 then 'short' end, case when contains(token, '%') then 'percent' end], lambda x: x is not null) as f
  from (select distinct token from {TOKENS}))) group by flag""")
def flag_counts_simple(spark, d):
    t = F.col("token")
    found = F.array_compact(F.array(F.when(t.rlike("[A-Za-z]") & t.rlike("[0-9]"), "mixed"), F.when(F.length(t) <= 3, "short"), F.when(t.contains("%"), "percent")))
    return _freq(spark, d).select(F.explode(F.when(F.size(found) == 0, F.array(F.lit("plain"))).otherwise(found)).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def _pieces(spark, d) -> DataFrame:
    """Vocabularies of the languages: ranked by frequency, scored by its logarithm; Spanish counts as the wiki."""
    f = relations.numbered(_freq(spark, d, "lang"), [F.desc("term_freq"), F.col("token")], "lang", "rank")
    return f.select(F.col("lang").alias("source"), (F.col("lang") == "es").alias("is_wiki"), F.col("rank").cast("int").alias("rank"), F.col("token").alias("piece"), F.log(F.col("term_freq").cast("double")).alias("score"))


_PIECES = f"(select lang as source, lang = 'es' as is_wiki, row_number() over (partition by lang order by term_freq desc, token) - 1 as rank, token as piece, ln(term_freq) as score from {LANG})"
_NORMAL = f"""(select source, is_wiki, rank, piece, 1 - rank / greatest(n - 1, 1) as rank_score, (score - min(score) over (partition by source)) / greatest(max(score) over (partition by source) - min(score) over (partition by source), 1e-6) as norm_score
 from (select *, greatest(cast(floor(count(*) over (partition by source) * 0.9) as bigint), 1) as n from {_PIECES}) where rank < n)"""
_AGGREGATE = f"(select piece, avg(rank_score) as avg_rank, avg(norm_score) as avg_norm, max(rank_score) as best_rank, count(*) as occurrences, count(distinct source) as sources, count(distinct case when not is_wiki then source end) as videos, count(distinct case when is_wiki then source end) as wikis from {_NORMAL} group by piece)"


@query(f"select source, piece, rank, round(rank_score, 9) as rank_score, round(norm_score, 9) as norm_score from {_NORMAL}")
def sp_rank_norm(spark, d):
    return vocab.rank_normalised(_pieces(spark, d)).select("source", "piece", F.col("rank").cast("long").alias("rank"), V.rounded("rank_score", 9).alias("rank_score"), V.rounded("norm_score", 9).alias("norm_score"))


@query(f"select piece, round(avg_rank, 9) as avg_rank, round(avg_norm, 9) as avg_norm, round(best_rank, 9) as best_rank, occurrences, sources, videos, wikis from {_AGGREGATE}")
def sp_aggregate(spark, d):
    a = vocab.aggregate_pieces(vocab.rank_normalised(_pieces(spark, d)))
    return a.select("piece", *[V.rounded(c, 9).alias(c) for c in ("avg_rank", "avg_norm", "best_rank")], "occurrences", "sources", "videos", "wikis")


_ASCII = "regexp_full_match(piece, '[=._A-Za-z0-9-]+')"


@query(f"""select piece, round(avg_rank * 5 + avg_norm * 2 + videos / 3 * 2.5 + sources / 4 * 1.5
 + case when {_ASCII} then -0.35 + case when length(piece) >= 6 then 0.1 else 0 end + case when regexp_full_match(piece, '[A-Za-z]+') and videos >= 3 then 0.15 else 0 end else 0 end
 + least(videos, 4) * 0.2 + least(wikis, 1) * 0.03, 6) as score from {_AGGREGATE}""")
def sp_score(spark, d):
    a = vocab.aggregate_pieces(vocab.rank_normalised(_pieces(spark, d)))
    return a.select("piece", V.rounded(vocab.piece_score(F.col("piece"), 4, 3), 6).alias("score"))


@query(f"""
with r as (select token, doc_freq, term_freq, row_number() over (partition by lang order by doc_freq desc, term_freq desc, token) as k from {LANG}),
n as (select k, count(*) as new from (select token, min(k) as k from r group by token) group by k),
c as (select k, sum(new) over (order by k) as seen from n),
l as (select coalesce(min(k), 2147483647) as last from c where seen >= 500)
select token, sum(doc_freq)::bigint as doc_freq, sum(term_freq)::bigint as term_freq from r, l where k <= last group by token""")
def vocab_round_robin(spark, d):
    return vocab.merge_round_robin(_freq(spark, d, "lang"), 500, source="lang")


@query(f"select word from (select distinct token as word from {TOKENS} union select distinct unnest(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) from benchmark)")
def vocab_union_sorted(spark, d):
    own = _docs(spark, d).select(F.explode(X.tokens(F.col("text"))).alias("word"))
    return vocab.union_words(own, table(spark, d, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("word")))


@query("select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by n_chars desc, doc_id) as k from documents) where k = 1")
def dedup_keep_first(spark, d):
    return vocab.first_by_key(_docs(spark, d), "lang", [F.desc("n_chars"), F.col("doc_id")]).select("lang", "doc_id")


@query(f"""
with v as (select value, row_number() over (order by value) - 1 as k, count(*) over () as n from events where value is not null), p as (select unnest([{', '.join(map(str, weights.QUANTILES))}]::double[]) as point)
select point, value from v join p on k = round_even((n - 1) * point, 0)""")
def nearest_quantile(spark, d):
    return weights.nearest_quantiles(table(spark, d, "events"), "value")


def _weight_sql(score: str) -> str:
    return f"""
with f as {FREQ}, b as (select min(term_freq) as lo, max(term_freq) as hi, quantile_disc(term_freq, 0.99999) as top from f)
select token, term_freq, round_even(case when term_freq <= lo then 1.0 when term_freq >= top then 0.1 else 0.1 + 0.9 * (1 - ({score})) end, 4) as weight from f, b"""


def _weights(spark, d, method):
    return weights.frequency_weights(_freq(spark, d), method).select("token", "term_freq", "weight")


@query(_weight_sql("(log10(term_freq + 10) - log10(lo + 10)) / (log10(hi + 10) - log10(lo + 10))"))
def token_weight_log(spark, d):
    return _weights(spark, d, "log")


@query(_weight_sql("(term_freq - lo) / (hi - lo)"))
def token_weight_ratio(spark, d):
    return _weights(spark, d, "ratio")


@query(_weight_sql("(sqrt(term_freq) - sqrt(lo)) / (sqrt(hi) - sqrt(lo))"))
def token_weight_power(spark, d):
    return _weights(spark, d, "power")


@query(f"with f as {FREQ}, t as (select sum(term_freq) * 0.001 as t from f) select token, round(least((sqrt(term_freq / t) + 1) * t / term_freq, 1.0), 9) as probability from f, t")
def subsample_prob(spark, d):
    return vocab.subsampled(_freq(spark, d)).select("token", V.rounded("probability", 9).alias("probability"))


@query(f"with f as {FREQ}, n as (select case when count(*) > 200 then min(term_freq) + 1 else 1 end as bar from (select term_freq from f order by term_freq desc, token limit 201)) select token, term_freq from f, n where term_freq >= bar order by term_freq desc, token limit 200")
def retain_vocab(spark, d):
    return vocab.retained(_freq(spark, d), 200).select("token", "term_freq")


# --- vectors ---------------------------------------------------------------------------------------------------------


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_E = "embedding::double[]"


@query(f"select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.{_E}, b.{_E}), 6) as sim from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    v = _vectors(spark, d)
    right = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("w"))
    return v.join(right, "id").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), V.rounded(V.cosine(F.col("vector"), F.col("w")), 6).alias("sim"))


@query(f"""
select query, id, rank, round(sim, 6) as similarity from (select query, id, sim, row_number() over (partition by query order by round(sim, 9) desc, id) as rank from (
  select a.vec_id as query, b.vec_id as id, list_cosine_similarity(a.{_E}, b.{_E}) as sim from embeddings a, embeddings b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)) where rank <= 3""")
def knn_top3(spark, d):
    v = _vectors(spark, d)
    found = neighbours.nearest(v.where("id % 100 = 0"), v, 3, digits=9)
    return found.select("query", "id", F.col("rank").cast("long").alias("rank"), V.rounded("similarity", 6).alias("similarity"))


@query(f"select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id < b.vec_id where list_cosine_similarity(a.{_E}, b.{_E}) >= 0.5")
def similar_pairs(spark, d):
    return neighbours.similar_pairs(_vectors(spark, d), 0.5).select("a", "b")


@query()
def lsh_codes(spark, d):
    return hashing.lsh(_vectors(spark, d), hashing.planes(64, 256))


_PLANES = "(select embedding::double[] as p, vec_id as bit from embeddings where vec_id < 32)"
_BITS = f"(select e.vec_id as id, string_agg(case when list_dot_product(e.{_E}, p) > 0 then '1' else '0' end, '' order by bit) as bits from embeddings e, {_PLANES} group by e.vec_id)"


def _planes(spark, d):
    import numpy as np

    rows = table(spark, d, "embeddings").where("vec_id < 32").orderBy("vec_id").collect()  # 32 rows
    return np.array([r["embedding"] for r in rows], float)


@query(f"select id, bits from {_BITS}")
def lsh_bits(spark, d):
    codes = hashing.lsh(_vectors(spark, d), _planes(spark, d))
    return codes.select("id", F.lpad(F.conv("code", 16, 2), 32, "0").alias("bits"))


@query(f"select id, lower(lpad(printf('%x', list_reduce(list_transform(string_split(bits, ''), lambda x: x::bigint), lambda a, x: a * 2 + x)), 8, '0')) as code from {_BITS}")
def lsh_hex(spark, d):
    codes = hashing.lsh(_vectors(spark, d), _planes(spark, d))
    bits = F.lpad(F.conv("code", 16, 2), 32, "0")
    return codes.select("id", V.bits_hex(bits, 32).alias("code"))


@query(f"""
with c as (select id, list_reduce(list_transform(string_split(bits, ''), lambda x: x::bigint), lambda a, x: a * 2 + x) as v from {_BITS})
select query, id, hamming from (select *, row_number() over (partition by query order by hamming, id) as k from (select a.id as query, b.id as id, bit_count(xor(a.v, b.v))::bigint as hamming from c a, c b where a.id % 100 = 0 and a.id <> b.id)) where k <= 5""")
def hamming_topk(spark, d):
    codes = hashing.lsh(_vectors(spark, d), _planes(spark, d))
    return hashing.nearest_codes(codes.where("id % 100 = 0"), codes, 5).select("query", "id", "hamming")


@query(f"select i::int as bit, round(avg(substr(bits, i + 1, 1)::int), 9) as mean from {_BITS}, (select unnest(generate_series(0, 31)) as i) group by i")
def bit_balance(spark, d):
    codes = hashing.lsh(_vectors(spark, d), _planes(spark, d))
    return hashing.bit_means(codes, 32).select("bit", V.rounded("mean", 9).alias("mean"))


@query()
def hash_diagnostics(spark, d):
    return hashing.diagnostics(hashing.lsh(_vectors(spark, d), hashing.planes(64, 256)), 256)


_MODELS = {"low": (1, 22), "mid": (23, 21), "top": (44, 21)}


def _hits(spark, d) -> DataFrame:
    from pyspark.sql import Window

    v = _vectors(spark, d)
    w = Window.partitionBy("label").orderBy("id")
    return v.select(F.col("label").alias("query"), (F.row_number().over(w) - 1).alias("hit_idx"), *[F.slice("vector", a, n).alias(m) for m, (a, n) in _MODELS.items()])


_RANKS = f"""
with h as (select label as query, row_number() over (partition by label order by vec_id) - 1 as hit_idx, embedding::double[] as e from embeddings),
m as (select 'low' as model, 1 as a, 22 as z union all select 'mid', 23, 43 union all select 'top', 44, 64),
s as (select h.query, x.hit_idx as anchor_idx, h.hit_idx, m.model, round(list_cosine_similarity(x.e[m.a:m.z], h.e[m.a:m.z]), 9) as sim from h join h x on x.query = h.query and x.hit_idx in (0, 1, 4, 9), m),
r as (select query, anchor_idx, hit_idx, model, row_number() over (partition by query, anchor_idx, model order by sim desc, hit_idx) - 1 as rank from s)"""


@query(_RANKS + " select * from r")
def rank_eval(spark, d):
    hits = _hits(spark, d)
    r = pipelines.benchmark(hits, hits, list(_MODELS))
    return r.select("query", *[F.col(c).cast("long").alias(c) for c in ("anchor_idx", "hit_idx")], "model", F.col("rank").cast("long").alias("rank"))


@query(_RANKS + """, med as (select query, anchor_idx, hit_idx, trunc(quantile_cont(rank, 0.5)) as median from r group by all),
g as (select r.query, r.anchor_idx, r.model, sum(abs(rank - median)) as d, sum(median) as m, count(*) as n from r join med using (query, anchor_idx, hit_idx) group by all),
sc as (select query, model, avg(case when n * n - m - 1.85 * n > 0 then 1 - d / (n * n - m - 1.85 * n) end) as score from g group by all)
select model, round(avg(score), 6) as score from sc group by model""")
def rank_scores(spark, d):
    hits = _hits(spark, d)
    s = ranks.rank_scores(pipelines.benchmark(hits, hits, list(_MODELS)))
    return ranks.overall_scores(s).select("model", V.rounded("score", 6).alias("score"))


_PAIRS = f"(select a.vec_id as id, list_cosine_similarity((a.{_E})[1:32], (b.{_E})[1:32]) as x, list_cosine_similarity((a.{_E})[33:64], (b.{_E})[33:64]) as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


def _pairs(spark, d) -> DataFrame:
    v = _vectors(spark, d)
    right = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("w"))
    part = lambda c, a: F.slice(c, a, 32)
    return v.join(right, "id").select("id", V.cosine(part("vector", 1), part("w", 1)).alias("x"), V.cosine(part("vector", 33), part("w", 33)).alias("y"))


@query(f"""with p as (select *, row_number() over (order by x, id) as rx, row_number() over (order by y, id) as ry from {_PAIRS})
select round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman, round(avg(abs(x - y)), 6) as mae, round(avg((x - y) * (x - y)), 6) as mse from p""")
def cos_vs_hash_corr(spark, d):
    a = ranks.agreement(_pairs(spark, d), "x", "y", ["id"])
    return a.select(*[V.rounded(c, 6).alias(c) for c in a.columns])


@query(f"select round(covar_pop(x, y) / var_pop(x), 6) as slope, round(avg(y) - covar_pop(x, y) / var_pop(x) * avg(x), 6) as intercept from {_PAIRS}")
def linear_calibration(spark, d):
    c = ranks.calibration(_pairs(spark, d), "x", "y")
    return c.select(*[V.rounded(n, 6).alias(n) for n in c.columns])


@query(f"""with b as (select unnest(generate_series(0, 7))::int as bin, unnest([-1, -.5, -.2, 0, .2, .4, .6, .8]::double[]) as lo, unnest([-.5, -.2, 0, .2, .4, .6, .8, 1.0001]::double[]) as hi)
select bin, lo, hi, count(id) as n, round(avg(x), 6) as x_mean, round(avg(y), 6) as y_mean, round(stddev_pop(y), 6) as y_std, round(avg(abs(y - x)), 6) as mae from b left join {_PAIRS} p on x >= lo and x < hi group by bin, lo, hi""")
def bucket_report(spark, d):
    r = ranks.bucket_report(_pairs(spark, d), "x", "y")
    return r.select("bin", "lo", "hi", "n", *[V.rounded(c, 6).alias(c) for c in ("x_mean", "y_mean", "y_std", "mae")])


_TOP = "(select a, b, row_number() over (partition by a order by round(s, 9) desc, b) as k from (select a.vec_id as a, b.vec_id as b, list_cosine_similarity((a.embedding::double[])[{0}], (b.embedding::double[])[{0}]) as s from embeddings a, embeddings b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id))"


@query(f"""with x as (select a, b from {_TOP.format('1:32')} where k <= 10), y as (select a, b from {_TOP.format('33:64')} where k <= 10), c as (select x.a, count(y.b) / 10 as o from x left join y on x.a = y.a and x.b = y.b group by x.a)
select round(avg(o), 6) as overlap from c""")
def topk_overlap(spark, d):
    v = _vectors(spark, d)
    near = lambda a: neighbours.nearest(*(t.select("id", F.slice("vector", a, 32).alias("vector")) for t in (v.where("id % 100 = 0"), v)), 10, digits=9)
    return ranks.topk_overlap(near(1), near(33), 10).select(V.rounded("overlap", 6).alias("overlap"))


@query("select vec_id as id, list_transform(list_filter(generate_series(1, 66), lambda i: (i - 1) % 3 < 2), lambda i: coalesce(embedding[i]::double, 0)) as v from embeddings")
def downsample_window(spark, d):
    return _vectors(spark, d).select("id", V.downsample(F.col("vector"), 2, 3).alias("v"))


@query("select vec_id as id, list_transform(generate_series(0, 191), lambda i: embedding[i // 3 + 1]) as v from embeddings")
def stretch_copy(spark, d):
    return _vectors(spark, d).select("id", V.stretch(F.col("vector"), 3).alias("v"))


@query("""
with g as (select vec_id as id, [embedding[1:16]::double[], embedding[17:32]::double[], embedding[33:48]::double[], embedding[49:64]::double[]] as rows from embeddings)
select id, list_transform(generate_series(0, 63), lambda k: round(list_sum(list_transform([0, 1, 2, 3], lambda r: case when ((k - r) + 64) % 64 % 4 = 0 then rows[r + 1][((k - r) + 64) % 64 // 4 + 1] else 0 end)), 6)) as v from g""")
def stretch_shift_add(spark, d):
    rows = F.array(*[F.slice("vector", a, 16).cast("array<double>") for a in (1, 17, 33, 49)])
    return _vectors(spark, d).select("id", F.transform(V.stretch_shift_add(rows, 4), lambda x: V.rounded(x, 6)).alias("v"))


@query("select vec_id as id, list_transform(list_filter(generate_series(1, 63), lambda i: (i - 1) % 21 < 5), lambda i: embedding[i]) as v from embeddings")
def sample_to_dim(spark, d):
    return _vectors(spark, d).select("id", V.head_of_windows(F.col("vector"), 5, 3).alias("v"))


@query("select a.vec_id as id, list_transform(generate_series(1, 64), lambda i: round(a.embedding[i]::double + b.embedding[i]::double * 0.5, 6)) as v from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def weighted_doc_vector(spark, d):
    v = _vectors(spark, d)
    right = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("w"))
    return v.join(right, "id").select("id", F.transform(V.weighted_sum((F.col("vector"), 1.0), (F.col("w"), 0.5)), lambda x: V.rounded(x, 6)).alias("v"))


@query("select label, list_transform(generate_series(1, 64), lambda i: round(list_avg(list_transform(l, lambda e: e[i]::double)), 6)) as v from (select label, list(embedding) as l from embeddings group by label)")
def pooled_vectors(spark, d):
    return weights.pooled(_vectors(spark, d), "label").select("label", F.transform("vector", lambda x: V.rounded(x, 6)).alias("v"))


@query("select vec_id as id, list_transform(embedding, lambda x: round(x::double / (sqrt(list_dot_product(embedding::double[], embedding::double[])) + 1e-12), 6)) as v from embeddings")
def l2_normalised(spark, d):
    return _vectors(spark, d).select("id", F.transform(V.normalised(F.col("vector")), lambda x: V.rounded(x, 6)).alias("v"))


# --- lookups, upserts, keys ------------------------------------------------------------------------------------------


@query("select lang, doc_id, rank from (select lang, doc_id, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from documents) where rank in (1, 2, 3, 4, 5, 10, 20, 30, 40, 50)")
def pick_ranks(spark, d):
    picked = relations.ranked_picks(_docs(spark, d), "lang", [F.desc("n_chars"), F.col("doc_id")])
    return picked.select("lang", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"""select prefix, word, score, rank from (select prefix, token as word, term_freq as score, row_number() over (partition by prefix order by term_freq desc, token) as rank
 from {FREQ} join (select unnest(['th', 'and', 'o', 'schl']) as prefix) on starts_with(token, prefix)) where rank <= 20""")
def prefix_suggest(spark, d):
    prefixes = spark.createDataFrame([("th",), ("and",), ("o",), ("schl",)], "prefix string")
    found = suggest.prefix_matches(_freq(spark, d).select(F.col("token").alias("word"), F.col("term_freq").alias("score")), prefixes, top=20)
    return found.select("prefix", "word", "score", F.col("rank").cast("long").alias("rank"))


_WORDS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query(f"""
with p as (select distinct array_to_string(w, ' ') as phrase from (select {_WORDS.format('text')} as w from benchmark) where len(w) >= 1),
g as (select doc_id, ' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ' as line from documents)
select phrase, count(distinct doc_id) as doc_count from p left join g on contains(line, ' ' || phrase || ' ') group by phrase""")
def phrase_doc_count(spark, d):
    w = F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), lambda t: t != "")
    phrases = table(spark, d, "benchmark").where(F.size(w) >= 1).select(F.array_join(w, " ").alias("phrase")).distinct()
    return suggest.phrase_counts(_docs(spark, d), phrases, [F.col("text")], "doc_id")


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def upsert_latest(spark, d):
    return relations.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("select vec_id as id, 'item:' || vec_id || ':title.f32' as key, cast(vec_id as varchar) as parsed_id, 'title' as field, 'f32' as kind from embeddings")
def key_codec(spark, d):
    keyed = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), X.item_key(F.col("vec_id"), F.lit("title"), F.lit("f32")).alias("key"))
    p = X.parse_item_key(F.col("key"))
    return keyed.select("id", "key", p["id"].alias("parsed_id"), p["field"].alias("field"), p["kind"].alias("kind"))


@query("select doc_id, translate(text, '/[]()!｀^', '') as text from documents")
def delete_chars(spark, d):
    return _docs(spark, d).select("doc_id", X.delete_chars(F.col("text")).alias("text"))


@query("select o_orderkey, o_totalprice, o_orderdate from orders order by o_totalprice desc, o_orderkey limit 40 offset 10")
def skip_limit(spark, d):
    return stats.take_slice(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), [F.desc("o_totalprice"), F.col("o_orderkey")], 10, 40)


@query()
def token_cache(spark, d):
    return pipelines.token_cache(_docs(spark, d), [F.col("source"), F.col("text")], ["doc_id", "lang"])


@query()
def stratified_sample(spark, d):
    return relations.stratified(_freq(spark, d), 50, [F.desc("doc_freq"), F.desc("term_freq"), F.col("token")], "token", 3)

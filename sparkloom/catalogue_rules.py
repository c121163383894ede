"""More registered queries: text rules, vocabularies, text vectors and round trips through files, each with its DuckDB SQL.

DuckDB's regular expressions have no lookarounds and no back-references; the SQL says the same by replacing twice (a match may
begin with the character that ended the one before) or by comparing characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _PIECES, FREQ, ORACLE, QUERIES, _docs, _freq, _pieces, query  # noqa: F401
from .functions import text as X
from .functions import vectors as V
from .operators import neighbours, relations, stats, suggest, vocab, weights
from .plans import pipelines
from .sources import tables
from .sources.tables import table

MASK, HAN, ALNUM = X.MASK, "\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}", X.ALNUM
WIDE = "\\x{1100}-\\x{115F}\\x{2E80}-\\x{303E}\\x{3041}-\\x{33FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{A000}-\\x{A4CF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE6F}\\x{FF00}-\\x{FF60}\\x{FFE0}-\\x{FFE6}"
IDEOGRAPH = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]"
#: texts with what the rules look for, as the tables have little of it
SAMPLES = (
    "第3集 游戏 GTA 5 at 30fps", "王者 荣耀 2023年 12 级", "a b c 1 2 3", "Hello--World - x -y- z", "aaaaaa bbbbb cccc dddddddd", "啊啊啊啊啊啊 ok=====----____", "3.14 1,000 50% 7‰ v1.2.3...", "學習 和 学习",
    "ｆｕｌｌ　ｗｉｄｔｈ ①", "", " ", "每5分钟 10公里 5km 3kg x5", "5 6 7", "a1 1a 1 a", "...5 ..a .", "丨a・b", "A▂B ▂ c", "bv123456 BV1x", "-hello hello- abc__def aaabbbb", "的 的士 了 了不起 了解 的卢", "12345 123年x", "C++ c# a|b \\ ~",
)


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: the documents' texts, and the samples under negative ids
LINES = "(select doc_id as id, text from documents where text is not null union all select -i as id, s as text from (select unnest(generate_series(1, " + str(len(SAMPLES)) + ")) as i, unnest([" + ", ".join(map(_sql_text, SAMPLES)) + "]) as s))"
#: distinct tokens of both
WORDS = f"(select distinct unnest(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) as token from {LINES})"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    own = spark.createDataFrame([(-i - 1, s) for i, s in enumerate(SAMPLES)], "id long, text string")
    return _docs(spark, d).where("text is not null").select(F.col("doc_id").alias("id"), "text").unionByName(own)


def _words(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select(F.explode(X.tokens(F.col("text"))).alias("token")).distinct()


# --- sentence rules --------------------------------------------------------------------------------------------------

_WS = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]"


def _masked(x: str) -> str:
    for _ in range(2):
        x = f"regexp_replace({x}, '([A-Za-z]){_WS}+([0-9A-Za-z])', '\\1{MASK}\\2', 'g')"
    return x


def _spaced(x: str) -> str:
    x = f"regexp_replace({x}, '[^{HAN}〇{ALNUM}_.\\-{MASK}]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\.+(\\.\\p{{Nd}})', ' \\1', 'g')"
    return f"regexp_replace(regexp_replace({x}, '\\.+([^.\\p{{Nd}}]|$)', ' \\1', 'g'), '[丨・]+', ' ', 'g')"


@query(f"select id, {_masked('text')} as masked from {LINES}")
def mask_letter_spaces(spark, d):
    return _lines(spark, d).select("id", X.mask_letter_spaces(F.col("text")).alias("masked"))


@query(f"select id, {_spaced('text')} as spaced from {LINES}")
def non_words_to_space(spark, d):
    return _lines(spark, d).select("id", X.non_words_to_space(F.col("text")).alias("spaced"))


@query()
def drop_char_repeats(spark, d):
    return _lines(spark, d).select("id", X.drop_char_repeats(F.col("text")).alias("kept"))


_BOUND = "[^\\p{L}\\p{M}\\p{N}_\\p{Pc}]"


@query()
def drop_numbers(spark, d):
    return _lines(spark, d).select("id", X.drop_numbers(F.col("text")).alias("t"))


@query(f"""select id, regexp_replace(regexp_replace(text, '([{HAN}]){_WS}+([{HAN}])', '\\1\\2', 'g'), '([{HAN}]){_WS}+([{HAN}])', '\\1\\2', 'g') as closed,
 trim(regexp_replace(text, '{_WS}{{2,}}', ' ', 'g'), ' ') as merged from {LINES}""")
def han_and_merged_spaces(spark, d):
    t = F.col("text")
    return _lines(spark, d).select("id", X.drop_spaces_in_han(t).alias("closed"), X.merge_spaces(t).alias("merged"))


@query(f"select id, translate(text, '學習', '学习') as simple from {LINES}")
def simplified(spark, d):
    return _lines(spark, d).select("id", X.simplify(F.col("text"), {"學": "学", "習": "习"}).alias("simple"))


def _n(pattern: str, x: str = "text") -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))::bigint"


@query(f"""select id, {_n(IDEOGRAPH)} as ideographs, {_n('[A-Za-z]')} as latin, {_n(chr(92) + 'p{Nd}')} as digits, {_n('[.a-z0-9-]')} as token_chars, 3 * {_n(IDEOGRAPH)} + {_n('[.A-Za-z0-9-]')} as units,
 length(text) + {_n('[' + WIDE + ']')} as width from {LINES}""")
def character_counts(spark, d):
    t = F.col("text")
    return _lines(spark, d).select("id", X.ideographs(t).alias("ideographs"), X.latin(t).alias("latin"), X.digits(t).alias("digits"), X.token_chars(t).alias("token_chars"), X.units(t).alias("units"), X.display_length(t).alias("width"))


@query(f"select id, regexp_replace(regexp_replace(text, '-{{2,}}', '|', 'g'), ' - | -|- ', '|', 'g') as barred from {LINES}")
def dashes_to_bars(spark, d):
    return _lines(spark, d).select("id", X.dashes_to_bars(F.col("text")).alias("barred"))


@query(f"select token, regexp_full_match(token, '[a-z0-9]{{6,}}') and {_n('[a-z]', 'token')} >= 4 and {_n('[0-9]', 'token')} between 1 and 3 and {_n('[aeiou]', 'token')} <= 1 as random from {WORDS}")
def random_mixes(spark, d):
    return _words(spark, d).select("token", X.random_mix(F.col("token")).alias("random"))


_SPLIT = "list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


@query(f"select id, list_filter(w, lambda x, i: list_position(w, x) = i) as words from (select id, {_SPLIT} as w from {LINES})")
def first_of_each(spark, d):
    return _lines(spark, d).select("id", X.first_of_each(X.tokens(F.col("text"))).alias("words"))


def _cleaned(x: str) -> str:
    x = f"regexp_replace({x}, '[^{HAN}〇{ALNUM}\\-.%‰{MASK}]+', '', 'g')"
    for sign, after in (("\\.", "\\p{Nd}"), ("-", "a-zA-Z0-9")):
        x = f"regexp_replace(regexp_replace({x}, '{sign}+({sign}[{after}])', '\\1', 'g'), '{sign}+([^{sign}{after}]|$)', '\\1', 'g')"
    return x


@query()
def clean_tokens(spark, d):
    return _lines(spark, d).select("id", X.clean_tokens(X.tokens(F.col("text"))).alias("words"))


@query(f"select id, case when len({_SPLIT}) > 0 then text || ' ' else '' end as text from {LINES}")
def replicate_by_items(spark, d):
    return _lines(spark, d).select("id", X.replicated_by_items(F.col("text"), X.tokens(F.col("text"))).alias("text"))


# --- token flags and vocabularies ------------------------------------------------------------------------------------

_ASCII = "regexp_full_match({0}, '[=._A-Za-z0-9-]+')"
_LINKS = "length(regexp_replace({0}, '[^=._-]', '', 'g'))"
_TRIPLE = "len(list_filter(generate_series(1, length({0}) - 2), lambda i: {0}[i:i] = {0}[i + 1:i + 1] and {0}[i:i] = {0}[i + 2:i + 2])) > 0"


def _malformed(t: str) -> str:
    return f"""((length({t}) >= 2 and (contains({t}, '%') or regexp_matches({t}, '[=._-]{{2,}}') or regexp_matches({t}, '^[=._{MASK}-]|[=._{MASK}-]$')))
 or regexp_matches({t}, '(?i)^bv\\p{{Nd}}') or ({_ASCII.format(t)} and ({_LINKS.format(t)} * 2 >= length({t}) or {_TRIPLE.format(t)})))"""


def _han(t: str) -> str:
    return _n(f"[{HAN}]", t)


def _pruned(t: str) -> str:
    return f"""(case when starts_with({t}, '的') then not regexp_full_match({t}, '的[卢士确]?')
 when starts_with({t}, '了') then not regexp_full_match({t}, '了(?:[不了悟事无若如然却结得解断]|不得|不起(?:的.+)?)?')
 else {_han(t)} > 8 or regexp_full_match({t}, '\\p{{Nd}}+') or {_malformed(t)} end)"""


@query(f"""select token, {_han('token')}::int as cjk_char_len, {_han('token')} > 0 as has_cjk, {_ASCII.format('token')} as is_ascii_token, regexp_full_match(token, '[A-Za-z]+') as is_ascii_alpha,
 regexp_full_match(token, '[A-Za-z0-9]+') as is_ascii_alnum, regexp_full_match(token, '\\p{{Nd}}+') as is_pure_digits, regexp_matches(token, '[=._-]') as has_connector, {_malformed('token')} as malformed, {_pruned('token')} as pruned from {WORDS}""")
def token_profiles(spark, d):
    t = F.col("token")
    return _words(spark, d).select("token", vocab.profile(t).alias("p"), vocab.pruned(t).alias("pruned")).select("token", "p.*", "pruned")


_HAN_T, _LAT, _NUM = f"regexp_matches(token, '{IDEOGRAPH}')", "regexp_matches(token, '[A-Za-z]')", "regexp_matches(token, '\\p{Nd}')"
_FOUND = f"""list_filter([case when {_malformed('token')} then 'malformed' end, case when {_HAN_T} and {_han('token')} > 8 then 'cjk_too_long' end, case when regexp_matches(token, '[#@$%^&*_=+<>\\[\\]{{}}\\\\|~]') then 'special_symbols' end,
 case when {_HAN_T} and {_LAT} then 'cjk_latin_mixed' end, case when {_HAN_T} and {_NUM} then 'cjk_digit_mixed' end, case when not {_HAN_T} and {_LAT} and {_NUM} then 'latin_digit_mixed' end,
 case when token <> trim(regexp_replace(token, '{_WS}+', ' ', 'g'), ' ') then 'spacing_noise' end, case when contains(token, ' ') then 'contains_space' end, case when {_ASCII.format('token')} and length(token) <= 3 then 'short_ascii' end], lambda x: x is not null)"""
_FLAGS = f"(select token, unnest(case when len(f) = 0 then ['looks_meaningful'] else f end) as flag from (select token, {_FOUND} as f from <WORDS>))"


@query(f"select flag, count(*) as n from {_FLAGS.replace('<WORDS>', WORDS)} group by flag")
def flag_counts(spark, d):
    return vocab.flag_counts(_words(spark, d))


@query(f"select token, flag, rank from (select token, flag, row_number() over (partition by flag order by token) as rank from {_FLAGS.replace('<WORDS>', WORDS)}) where rank <= 25")
def flag_samples(spark, d):
    s = vocab.flag_samples(_words(spark, d))
    return s.select("token", "flag", F.col("rank").cast("long").alias("rank"))


_WIDTH = f"(length(piece) + {_n('[' + WIDE + ']', 'piece')})"
_MERGED = f"""
with n as (select * from (select *, greatest(cast(floor(count(*) over (partition by source) * 0.9) as bigint), 1) as n from {_PIECES}) where rank < n),
r as (select source, is_wiki, piece, 1 - rank / greatest(n - 1, 1) as rank_score, (score - min(score) over (partition by source)) / greatest(max(score) over (partition by source) - min(score) over (partition by source), 1e-6) as norm_score from n),
a as (select piece, avg(rank_score) as avg_rank, avg(norm_score) as avg_norm, max(rank_score) as best_rank, count(distinct source) as sources, count(distinct case when not is_wiki then source end) as videos,
  count(distinct case when is_wiki then source end) as wikis from r where not {_pruned('piece')} group by piece),
k as (select * from a where not ({_ASCII.format('piece')} and (videos = 0 or (length(piece) < 3 and videos < 3) or (sources < 2 and (best_rank < 0.995 or videos = 0)) or (regexp_matches(piece, '[=._-]') and videos < 2)))),
m as (select count(distinct source) as models, count(distinct case when not is_wiki then source end) as video_models from {_PIECES}),
s as (select piece, avg_rank * 5 + avg_norm * 2 + videos / greatest(video_models, 1) * 2.5 + sources / greatest(models, 1) * 1.5
  + case when {_han('piece')} > 0 then 0.9 when {_ASCII.format('piece')} then -0.35 + case when length(piece) >= 6 then 0.1 else 0 end + case when regexp_full_match(piece, '[A-Za-z]+') and videos >= 3 then 0.15 else 0 end else 0 end
  + least(videos, 4) * 0.2 + least(wikis, 1) * 0.03 as score from k, m),
f as (select unnest({list(vocab.FLOORS)}) as piece, unnest({list(vocab.FLOORS.values())}::double[]) as floor)
select coalesce(s.piece, f.piece) as piece, round(greatest(s.score, f.floor), 6) as score from s full join f on s.piece = f.piece"""


@query(_MERGED)
def sp_merge(spark, d):
    return vocab.merge_pieces(_pieces(spark, d)).select("piece", V.rounded("score", 6).alias("score"))


@query(f"""
with p as {_PIECES}, l as (select source, coalesce(max(rank) filter (length(piece) > 1), 0) as last from p group by source)
select source, piece, rank from p join l using (source) where rank <= last and not (regexp_full_match(piece, '\\p{{Nd}}+') or regexp_full_match(piece, '\\p{{Nd}}+[^\\p{{Nd}}a-z]+')
  or (length(piece) >= 2 and (regexp_matches(piece, '^[.{MASK}-]|[.{MASK}-]$') or regexp_matches(piece, '%|[.-]{{2,}}'))))""")
def sp_edit(spark, d):
    return vocab.edited(_pieces(spark, d), "source").select("source", "piece", F.col("rank").cast("long").alias("rank"))


@query(f"""with p as (select token as piece from {WORDS} where not regexp_full_match(token, '[ ._0-9A-Za-z-]+') and length(token) > 1)
select piece, replace(piece, '{MASK}', ' ') as word from p where length(trim(replace(piece, '{MASK}', ' '), ' ')) > 1""")
def pieces_to_words(spark, d):
    return vocab.to_words(_words(spark, d).withColumnRenamed("token", "piece")).select("piece", "word")


@query(f"select token as word, doc_freq from {FREQ} where doc_freq >= 20 and not regexp_matches(token, '[#@$%^&*=<>\\[\\]{{}}\\\\|~]') and length(token) + {_n('[' + WIDE + ']', 'token')} <= 32")
def record_words(spark, d):
    return vocab.record_words(_freq(spark, d).withColumnRenamed("token", "word")).select("word", "doc_freq")


@query("select o_orderkey, case when o_orderstatus = 'F' then 'include' when o_orderstatus = 'O' then 'mid' else 'exclude' end as pos, case when o_orderstatus = 'P' then 0.1 when o_orderstatus = 'O' then 0.55 else 1.0 end::double as weight from orders")
def part_of_speech(spark, d):
    p = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", vocab.part_of_speech_group(p, ["F"], ["O"]).alias("pos"), V.rounded(weights.speech_weight(p, ["P"], ["O"]), 6).alias("weight"))


@query("select o_orderkey, floor(k * 2500 / 1000000)::bigint as size, floor(k / 200)::bigint as merged, (floor(k / power(10, greatest(length(k::varchar) - 2, 0))) * power(10, greatest(length(k::varchar) - 2, 0)))::bigint as label from (select o_orderkey, o_orderkey * 997 as k from orders)")
def vocabulary_sizes(spark, d):
    k = F.col("o_orderkey") * 997
    return table(spark, d, "orders").select("o_orderkey", vocab.vocabulary_size(k).alias("size"), vocab.merged_size(k).alias("merged"), vocab.count_label(k).alias("label"))


_QUANTILE = ", ".join(map(str, weights.QUANTILES))


@query(f"""
with f as {FREQ}, b as (select min(term_freq) as lo, max(term_freq) as hi, quantile_disc(term_freq, 0.99999) as top from f),
v as (select term_freq as value, row_number() over (order by term_freq) - 1 as k, count(*) over () as n from f),
q as (select list(struct_pack(p := point, v := value) order by point, value) as q from (select unnest([{_QUANTILE}]::double[]) as point) p join v on k = round_even((n - 1) * point, 0))
select token, term_freq, round_even(case when term_freq <= lo then 1.0 when term_freq >= top then 0.1
  else 0.1 + 0.9 * (1 - q[least(greatest(len(list_filter(q, lambda x: x.v <= term_freq)) - 1, 0), len(q) - 2) + 1].p) end, 4) as weight from f, b, q""")
def token_weight_quantile(spark, d):
    return weights.frequency_weights(_freq(spark, d), "quantile").select("token", "term_freq", "weight")


@query("select lang, list(doc_id order by n_chars, doc_id) as words from documents group by lang")
def inverted_map(spark, d):
    rows = _docs(spark, d).select("lang", F.col("doc_id").alias("word"), F.struct("n_chars", "doc_id").alias("o"))
    return suggest.inverted(rows, "lang", "o")


# --- structs, slices, progress ---------------------------------------------------------------------------------------


@query("select event_id, user_id as who_user_id, event_type as who_event_type, value from events")
def flattened(spark, d):
    rows = table(spark, d, "events").select("event_id", F.struct("user_id", "event_type", "ts").alias("who"), "value")
    return relations.flattened(rows, drop=["who.ts"])


@query("select doc_id, [coalesce(quality, 0), coalesce(toxic, 0)]::bigint[] as values from documents left join labels using (doc_id)".replace("as values", 'as "values"'))
def ordered_values(spark, d):
    rows = _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", relations.ordered_values(["quality", "toxic"]).alias("values"))


@query("select count(*) as shards, count(*) filter (quality = 1) as done, sum(doc_id)::bigint as processed, sum(doc_id * 2)::bigint as total, round_even(sum(doc_id) * 100 / sum(doc_id * 2), 2) as percent from labels")
def shard_progress(spark, d):
    rows = table(spark, d, "labels").select(F.when(F.col("quality") == 1, "done").otherwise("open").alias("state"), F.col("doc_id").alias("processed_docs"), (F.col("doc_id") * 2).alias("total_docs"))
    return stats.progress(rows)


@query("""with n as (select lang, count(*) as n from documents group by lang), s as (select lang, n, unnest(generate_series(0, 3)) as shard, cast(ceil(n / 4) as bigint) as size from n)
select lang, shard, shard * size as skip, least(size, n - shard * size) as take from s where n - shard * size > 0""")
def region_shard_plans(spark, d):
    counts = _docs(spark, d).groupBy("lang").count().collect()  # a row for each language
    plans = [(r["lang"], i, skip, take) for r in counts for i, skip, take in stats.shard_plans(r["count"], 4)]
    return spark.createDataFrame(plans, "lang string, shard long, skip long, take long")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 25 offset 5")
def collection_cursor(spark, d):
    return tables.collection(table(spark, d, "orders"), F.col("o_orderstatus") == "F", ["o_orderkey", "o_totalprice"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5, 25)


@query("select count(*)::bigint as n from lineitem")
def rows_from_footers(spark, d):
    return spark.createDataFrame([(tables.n_rows(table(spark, d, "lineitem")),)], "n long")


# --- text vectors ----------------------------------------------------------------------------------------------------

_D = "embedding::double[]"
_UNIT = f"(select vec_id, label, list_transform({_D}, lambda x: x / sqrt(list_dot_product({_D}, {_D}))) as u from embeddings)"
_AT = "list_transform(generate_series(1, 64), lambda i: {0})"


def _tokens(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("label", "vec_id", F.col("vec_id").cast("string").alias("token"), F.col("embedding").alias("vector"))


def _rounded(v):
    return F.transform(v, lambda x: V.rounded(x, 6))


@query(f"""with s as (select label, {_AT.format('list_sum(list_transform(l, lambda e: e.u[i] * e.w))')} as s from (select label, list(struct_pack(u := u, w := 1 + vec_id % 3)) as l from {_UNIT} group by label))
select label, list_transform(s, lambda x: round(x / sqrt(list_dot_product(s, s)), 6)) as vector from s""")
def text_vectors(spark, d):
    t = _tokens(spark, d)
    weighted = t.select("label", "token", (F.lit(1.0) + F.col("vec_id") % 3).alias("w"))
    return weights.text_vectors(weighted, t, "label", weight="w").select("label", _rounded(F.col("vector")).alias("vector"))


@query(f"select label, {_AT.format('round(list_max(list_transform(l, lambda e: e[i])), 6)')} as top, {_AT.format('round(list_sum(list_transform(l, lambda e: e[i])), 5)')} as total from (select label, list({_D}) as l from embeddings group by label)")
def pooled_max_and_sum(spark, d):
    t = _tokens(spark, d)
    top = weights.pooled(t, "label", how="max").select("label", _rounded(F.col("vector")).alias("top"))
    total = weights.pooled(t, "label", how="sum").select("label", F.transform("vector", lambda x: V.rounded(x, 5)).alias("total"))
    return top.join(total, "label")


@query(f"""with c as (select b.label as sample, power(list_cosine_similarity(a.{_D}, b.{_D}), 2) * (1 + b.vec_id % 2) as s, power(list_cosine_similarity(a.{_D}, b.{_D}), 2) as raw, (1 + b.vec_id % 2) as w from embeddings a, embeddings b where a.vec_id = 0)
select sample, round(sum(case when raw < 0.15 then 0 else raw * w end), 6) as score from c group by sample""")
def pair_scores(spark, d):
    t = _tokens(spark, d)
    samples = t.select(F.col("label").alias("sample"), "token", "vector", (F.lit(1.0) + F.col("vec_id") % 2).alias("weight"))
    return weights.pair_scores(t.where("vec_id = 0").select("vector"), samples).select("sample", V.rounded("score", 6).alias("score"))


@query(f"""with n as (select label, vec_id, {_D} as e, row_number() over (partition by label order by vec_id) as k from embeddings)
select a.vec_id, {_AT.format('round(list_sum(list_transform(l, lambda e: e[i])), 6)')} as sum from (select a.vec_id, list(b.e) as l from n a join n b on a.label = b.label and abs(a.k - b.k) <= 2 group by a.vec_id) a""")
def window_sums(spark, d):
    return weights.window_sums(_tokens(spark, d), "label", "vec_id", 2).select("vec_id", _rounded(F.col("sum")).alias("sum"))


@query(f"""with c as (select a.label, a.vec_id::varchar as token, sum(list_cosine_similarity(a.{_D}, b.{_D})) as s from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id group by all)
select label, token from (select *, row_number() over (partition by label order by s desc, token desc) as k from c) where k = 1""")
def least_important(spark, d):
    return weights.least_important(_tokens(spark, d), "label").select("label", "token")


@query(f"""select a.vec_id::varchar as token, {_AT.format('round(a.e[i] + 0.8 * (b.e[i] + c.e[i]) / 2, 6)')} as vector
from (select vec_id, {_D} as e from embeddings) a join (select vec_id, {_D} as e from embeddings) b on b.vec_id = a.vec_id + 1 join (select vec_id, {_D} as e from embeddings) c on c.vec_id = a.vec_id + 2""")
def blended_vectors(spark, d):
    t = _tokens(spark, d)
    before = lambda n: t.select((F.col("vec_id") - n).alias("vec_id"))
    own = t.join(before(1), "vec_id", "left_semi").join(before(2), "vec_id", "left_semi")  # both parts are there
    splits = own.select("token", F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 2).cast("array<string>")).alias("piece"))
    return weights.blended(t, splits).join(own.select("token"), "token", "left_semi").select("token", _rounded(F.col("vector")).alias("vector"))


@query(f"select vec_id as id, list_transform({_D}, lambda x: case when x < 0.15 then 0 else x end) as cut, list_concat({_D}, list_transform(generate_series(1, 6), lambda i: 0.0::double)) as padded, list_transform(generate_series(0, 15), lambda i: ({_D})[i * 4 + 1]) as stepped from embeddings")
def vector_forms(spark, d):
    e = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(e, lambda x: V.truncate(x, 0.15, 0.0)).alias("cut"), V.pad(e, F.lit(70)).alias("padded"), V.downsample_steps(e, 16).alias("stepped"))


@query(f"""
with s as (select a.vec_id as q, b.vec_id as id, list_cosine_similarity(a.{_D}, b.{_D}) as sim from embeddings a join embeddings b on a.vec_id <> b.vec_id),
r as (select q, id, row_number() over (partition by q order by round(sim, 12) desc, id) as k from s),
l as (select q, list(id order by k) as pos_ids from r where k <= 3 group by q), n as (select q, pos_ids, row_number() over (order by q) - 1 as i from l)
select n.i as sample_idx, n.q as anchor, n.pos_ids, coalesce(b.q, c.q) as neg_id from n left join n b on b.i = n.i - 1 left join n c on c.i = 1 and n.i = 0""")
def triplets(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return neighbours.triplets(rows, 3, "id", digits=12)


# --- files -----------------------------------------------------------------------------------------------------------


@query(f"select token as word, doc_freq, term_freq from {FREQ}")
def frequencies_round_trip(spark, d):
    path = tables.new_folder(spark, "frequencies")
    tables.write_frequencies(_freq(spark, d), path)
    back = tables.read_frequencies(spark, path)
    return back.select(F.col(back.columns[0]).alias("word"), F.col("doc_freq").cast("long").alias("doc_freq"), F.col("term_freq").cast("long").alias("term_freq"))


@query("select doc_id, lang from documents union all select doc_id, lang from documents where lang = 'en'")
def dataset_round_trip(spark, d):
    path = tables.new_folder(spark, "dataset")
    docs = _docs(spark, d).select("doc_id", "lang")
    tables.append(docs, path)
    tables.append(docs.where("lang = 'en'"), path)
    return tables.dataset(spark, path)


@query("select vec_id as sample_idx, label from embeddings where vec_id between 30 and 149")
def samples_round_trip(spark, d):
    path = tables.new_folder(spark, "samples")
    tables.write_samples(table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_idx"), "label"), path, 40)
    return tables.read_samples(spark, path, 30, 150, 40).select("sample_idx", "label")


@query("select l.doc_id as key, d.lang as value from labels l left join (select * from documents where lang <> 'en') d using (doc_id)")
def store_lookup(spark, d):
    store = _docs(spark, d).where("lang <> 'en'").select(F.col("doc_id").alias("key"), F.col("lang").alias("value"))
    return tables.get_many(store, table(spark, d, "labels").select(F.col("doc_id").alias("key")))


@query("select doc_id, source || ' | ' || text as joined from documents where lang = 'en' and source <> '' and text <> ''")
def region_cache(spark, d):
    rows = pipelines.token_cache_by_region(_docs(spark, d), {"english": F.col("lang") == "en", "other": F.col("lang") != "en"}, [F.col("source"), F.col("text")], ["doc_id"], rules=X.SentenceRules())
    shown = rows.where("region = 'english'").select("doc_id", F.col("sentence").alias("lowered"))
    own = _docs(spark, d).where("source <> '' and text <> ''").select("doc_id", X.joined(F.col("source"), F.col("text")).alias("joined"))
    return shown.join(own, "doc_id").where(F.lower("joined") == F.col("lowered")).select("doc_id", "joined")

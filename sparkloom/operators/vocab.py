"""Vocabularies: token profiles, pruning, merging of ranked vocabularies, cleaning and conversion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

ASCII_TOKEN = "^[=._A-Za-z0-9\\-]+$"
FLOORS = {"▂": 80.0, "学": 100.0, "影": 100.0, "游": 100.0}


def han_length(t: Column) -> Column:
    return F.regexp_count(t, F.lit(f"[{X.HAN}]"))


def malformed(t: Column) -> Column:
    ascii_ = t.rlike(ASCII_TOKEN)
    links = F.regexp_count(t, F.lit("[=._\\-]"))
    long_ = F.length(t) >= 2
    return (
        (long_ & (t.contains("%") | t.rlike("[=._\\-]{2,}") | t.rlike(f"^[=._{X.MASK}\\-]|[=._{X.MASK}\\-]$")))
        | t.rlike("(?iU)^bv\\d") | (ascii_ & ((links * 2 >= F.length(t)) | t.rlike("(.)\\1{2,}")))
    )


def profile(t: Column) -> Column:
    """struct of a token's flags."""
    n = han_length(t)
    return F.struct(
        n.cast("int").alias("cjk_char_len"), (n > 0).alias("has_cjk"), t.rlike(ASCII_TOKEN).alias("is_ascii_token"), t.rlike("^[A-Za-z]+$").alias("is_ascii_alpha"),
        t.rlike("^[A-Za-z0-9]+$").alias("is_ascii_alnum"), t.rlike("(?U)^\\d+$").alias("is_pure_digits"), t.rlike("[=._\\-]").alias("has_connector"), malformed(t).alias("malformed"),
    )


def pruned(t: Column, most_han: int = 8) -> Column:
    """Whether a piece is dropped before merging: particles at the start but in set words, long, numeric or malformed."""
    return (
        F.when(t.startswith("的"), ~t.rlike("^的[卢士确]?$"))
        .when(t.startswith("了"), ~t.rlike("^了(?:[不了悟事无若如然却结得解断]|不得|不起(?:的.+)?)?$"))
        .otherwise((han_length(t) > most_han) | t.rlike("(?U)^\\d+$") | malformed(t))
    )


def flags(t: Column) -> Column:
    """Labels that describe a token; "looks_meaningful" if there is no other."""
    han, lat, num = t.rlike(X.IDEOGRAPH), t.rlike("[A-Za-z]"), t.rlike("(?U)\\d")
    found = F.array_compact(F.array(
        F.when(malformed(t), "malformed"), F.when(han & (han_length(t) > 8), "cjk_too_long"), F.when(t.rlike("[#@$%^&*_=+<>\\[\\]{}\\\\|~]"), "special_symbols"),
        F.when(han & lat, "cjk_latin_mixed"), F.when(han & num, "cjk_digit_mixed"), F.when(~han & lat & num, "latin_digit_mixed"),
        F.when(t != F.trim(F.regexp_replace(t, "(?U)\\s+", " ")), "spacing_noise"), F.when(t.contains(" "), "contains_space"), F.when(t.rlike(ASCII_TOKEN) & (F.length(t) <= 3), "short_ascii"),
    ))
    return F.when(F.size(found) == 0, F.array(F.lit("looks_meaningful"))).otherwise(found)


def flag_counts(tokens: DataFrame, token: str = "token") -> DataFrame:
    return tokens.select(F.explode(flags(F.col(token))).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def flag_samples(tokens: DataFrame, token: str = "token", most: int = 25) -> DataFrame:
    """The first tokens of each flag, in token order."""
    w = Window.partitionBy("flag").orderBy(token)
    return tokens.select(token, F.explode(flags(F.col(token))).alias("flag")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


# --- merging of ranked vocabularies ----------------------------------------------------------------------------------


def rank_normalised(pieces: DataFrame, keep: float = 0.9) -> DataFrame:
    """(source, is_wiki, rank from 0, piece, score) with rank_score, 1 for the first down to 0, and norm_score, for the top share of each source."""
    kept = F.greatest(F.floor(F.count("*") * keep), F.lit(1)).alias("_n")
    counts = pieces.groupBy(F.col("source").alias("_own")).agg(kept)  # a row for each vocabulary, as below
    top = pieces.join(F.broadcast(counts), F.col("source").eqNullSafe(F.col("_own")) & (F.col("rank") < F.col("_n"))).drop("_own")
    bounds = top.groupBy(F.col("source").alias("_own")).agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    return top.join(F.broadcast(bounds), F.col("source").eqNullSafe(F.col("_own"))).withColumns({
        "rank_score": 1 - F.col("rank") / F.greatest(F.col("_n") - 1, F.lit(1)),
        "norm_score": (F.col("score") - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-6)),
    }).drop("_n", "_own", "_low", "_high")


def aggregate_pieces(ranked: DataFrame) -> DataFrame:
    """One row for each piece: means, best rank, and how many sources have it; first by source, after one shuffle by piece."""
    wiki = F.col("is_wiki")
    sums = [f(c).alias(f"_{n}_{c}") for c in ("rank_score", "norm_score") for n, f in (("s", F.sum), ("n", F.count))]
    own = ranked.select("piece", "source", "is_wiki", "rank_score", "norm_score").repartition("piece").groupBy("piece", "source").agg(
        *sums, F.max("rank_score").alias("_best"), F.count("*").alias("_all"), F.max(F.when(~wiki, 1)).alias("_video"), F.max(F.when(wiki, 1)).alias("_wiki")
    )
    mean = lambda c: F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}"))
    known = lambda c: F.count(F.when(F.col("source").isNotNull(), F.col(c)))
    return own.groupBy("piece").agg(
        mean("rank_score").alias("avg_rank"), mean("norm_score").alias("avg_norm"), F.max("_best").alias("best_rank"), F.sum("_all").alias("occurrences"),
        F.count("source").alias("sources"), known("_video").alias("videos"), known("_wiki").alias("wikis"),
    )


def dropped(p: Column, a: Mapping[str, Column] | None = None, least_ascii: int = 3, least_videos: int = 2, least_sources: int = 2) -> Column:
    """Whether an aggregated piece is dropped: ASCII needs support by several video sources."""
    c = a or {n: F.col(n) for n in ("videos", "sources", "best_rank")}
    weak = (
        (c["videos"] == 0) | ((F.length(p) < least_ascii) & (c["videos"] < least_videos + 1))
        | ((c["sources"] < least_sources) & ((c["best_rank"] < 0.995) | (c["videos"] == 0))) | (p.rlike("[=._\\-]") & (c["videos"] < 2))
    )
    return pruned(p) | (p.rlike(ASCII_TOKEN) & weak)


def piece_score(p: Column, models: Column | int, video_models: Column | int) -> Column:
    han, ascii_ = han_length(p) > 0, p.rlike(ASCII_TOKEN)
    videos, wikis = F.col("videos"), F.col("wikis")
    at_least_one = lambda x: F.greatest(x if isinstance(x, Column) else F.lit(x), F.lit(1))
    kind = F.when(han, 0.9).when(ascii_, -0.35 + F.when(F.length(p) >= 6, 0.1).otherwise(0.0) + F.when(p.rlike("^[A-Za-z]+$") & (videos >= 3), 0.15).otherwise(0.0)).otherwise(0.0)
    bonus = kind + F.least(videos, F.lit(4)) * 0.2 + F.least(wikis, F.lit(1)) * 0.03
    return F.col("avg_rank") * 5.0 + F.col("avg_norm") * 2.0 + videos / at_least_one(video_models) * 2.5 + F.col("sources") / at_least_one(models) * 1.5 + bonus


def merge_pieces(pieces: DataFrame, keep: float = 0.9, most: int | None = None, floors: Mapping[str, float] = FLOORS) -> DataFrame:
    """One ranked vocabulary from several: pruned, aggregated, scored; set pieces are there with a floor."""
    spark = pieces.sparkSession
    models = pieces.agg(F.count_distinct("source").alias("_models"), F.count_distinct(F.when(~F.col("is_wiki"), F.col("source"))).alias("_videos"))
    grouped = aggregate_pieces(rank_normalised(pieces, keep).where(~pruned(F.col("piece"))))
    kept = grouped.where(~dropped(F.col("piece"))).crossJoin(F.broadcast(models))  # one row
    scored = kept.select("piece", piece_score(F.col("piece"), F.col("_models"), F.col("_videos")).alias("score"))
    if floors:
        table = F.broadcast(spark.createDataFrame([(k, float(v)) for k, v in floors.items()], "piece string, floor double"))
        scored = scored.join(table, "piece", "full").select("piece", F.greatest("score", "floor").alias("score"))
    out = scored.orderBy(F.desc("score"), F.desc(X.display_length(F.col("piece"))), F.desc("piece"))
    return out.limit(most) if most else out


def merge_round_robin(freqs: DataFrame, unique: int, source: str = "source", key: str = "token") -> DataFrame:
    """Vocabularies merged a row of each in turn, best first, until a round in which `unique` tokens have been seen.

    Frequencies of the rows visited are added up. A token's round is the earliest of its ranks, so the last round follows from a
    count by round, and no row is visited in sequence.
    """
    w = Window.partitionBy(source).orderBy(F.desc("doc_freq"), F.desc("term_freq"), key)
    # a source gives as many tokens as it has had rounds, so `unique` rounds are enough, or no source has more rows; Spark takes
    # the first rows of each task before the shuffle
    ranked = freqs.withColumn("_round", F.row_number().over(w)).where(F.col("_round") <= unique)
    first = ranked.groupBy(key).agg(F.min("_round").alias("_round"))
    by_round = first.groupBy("_round").agg(F.count("*").alias("_new"))
    seen = F.sum("_new").over(Window.orderBy("_round"))
    last = by_round.withColumn("_seen", seen).agg(F.coalesce(F.min(F.when(F.col("_seen") >= unique, F.col("_round"))), F.lit(2**31 - 1)).alias("_last"))
    visited = ranked.join(F.broadcast(last), F.col("_round") <= F.col("_last"))  # one row
    return visited.groupBy(key).agg(F.sum("doc_freq").alias("doc_freq"), F.sum("term_freq").alias("term_freq"))


def union_words(*tables: DataFrame, word: str = "word") -> DataFrame:
    """All distinct words by width, then text."""
    every = reduce(DataFrame.unionByName, [t.select(word) for t in tables]).distinct()
    return every.orderBy(X.display_length(F.col(word)), word)


def first_by_key(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


# --- cleaning and conversion -----------------------------------------------------------------------------------------


def edited(pieces: DataFrame, source: str | None = None) -> DataFrame:
    """(rank from 0, piece, …) without the tail of one-character pieces, and without numbers, loose edges and doubled signs; source: of each vocabulary."""
    p = F.col("piece")
    own = F.col(source) if source else F.lit(0)
    last = pieces.groupBy(own.alias("_own")).agg(F.coalesce(F.max(F.when(F.length("piece") > 1, F.col("rank"))), F.lit(0)).alias("_last"))
    edge = f"[.{X.MASK}\\-]"
    bad = p.rlike("(?U)^\\d+$") | p.rlike("(?U)^\\d+[^\\da-z]+$") | ((F.length(p) >= 2) & (p.rlike(f"^{edge}|{edge}$") | p.rlike("%|[.\\-]{2,}")))
    return pieces.join(F.broadcast(last), own.eqNullSafe(F.col("_own")) & (F.col("rank") <= F.col("_last"))).drop("_own", "_last").where(~bad)  # a row for each vocabulary


def to_words(pieces: DataFrame, keep_english: bool = False) -> DataFrame:
    """Pieces as words: no plain ASCII unless asked, no single characters, masks shown as spaces."""
    p = F.col("piece")
    kept = pieces if keep_english else pieces.where(~p.rlike("^[ ._0-9A-Za-z\\-]+$"))
    shown = kept.where(F.length(p) > 1).withColumn("word", F.replace(p, F.lit(X.MASK), F.lit(" ")))
    return shown.where(F.length(F.trim("word")) > 1)


def record_words(records: DataFrame, least: int = 20, width: int = 32) -> DataFrame:
    w = F.col("word")
    return records.where((F.col("doc_freq") >= least) & ~w.rlike("[#@$%^&*=<>\\[\\]{}\\\\|~]") & (X.display_length(w) <= width))


def part_of_speech_group(pos: Column, include: Sequence[str], middle: Sequence[str]) -> Column:
    return F.when(pos.isin(list(include)), "include").when(pos.isin(list(middle)), "mid").otherwise("exclude")


# --- training parameters ---------------------------------------------------------------------------------------------


def vocabulary_size(samples: Column) -> Column:
    """2,500 entries for a million samples."""
    return F.floor(samples * 2500 / 1_000_000).cast("long")


def merged_size(corpus: Column) -> Column:
    return F.floor(corpus / 200).cast("long")


def count_label(n: Column) -> Column:
    """A count with its two leading digits kept."""
    unit = F.pow(F.lit(10), F.greatest(F.length(n.cast("string")) - 2, F.lit(0)))
    return (F.floor(n / unit) * unit).cast("long")


def retained(freqs: DataFrame, most: int, least: int = 1, key: str = "token") -> DataFrame:
    """Tokens above the frequency of the one that would be next after `most`, at most `most` of them."""
    # the next one is found by a top-k, not by a window over all
    nth = freqs.orderBy(F.desc("term_freq"), key).limit(most + 1).agg(F.when(F.count("*") > most, F.min("term_freq") + 1).otherwise(F.lit(least)).alias("_nth"))
    bar = nth.select(F.greatest("_nth", F.lit(least)).alias("_bar"))
    kept = freqs.join(F.broadcast(bar), F.col("term_freq") >= F.col("_bar")).drop("_bar")  # one row
    return kept.orderBy(F.desc("term_freq"), key).limit(most)


def subsampled(freqs: DataFrame, sample: float = 1e-3, ratio: float = 1.0) -> DataFrame:
    """Each token's probability to stay, and that as a 32-bit integer."""
    whole = freqs.agg((F.sum("term_freq") * sample * ratio).alias("_at"))
    share = F.col("_at") / F.col("term_freq")
    p = F.least((F.sqrt(F.col("term_freq") / F.col("_at")) + 1) * share, F.lit(1.0))
    return freqs.crossJoin(F.broadcast(whole)).withColumn("probability", p).withColumn("sample_int", F.floor(F.col("probability") * (2**32 - 1))).drop("_at")  # one row

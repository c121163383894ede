"""Word extraction from English and Chinese text, and word records with frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import frequencies

#: starts with a letter, or with a digit and has a letter before the first space; ends with a letter or digit
ENGLISH = "(?<![A-Za-z0-9])(?:[A-Za-z]|[0-9](?=[.A-Za-z0-9\\-]*[A-Za-z]))[ .A-Za-z0-9\\-]*[A-Za-z0-9](?![A-Za-z0-9])"

SHORT = set("wwe vs vr ui ufc tv rpg re pv ps pc ost op nba mv mmo mmd mc lol ip hd gpu fps edm ed dj cv cpu cf bgm ar ai".split())
STOP = set("with to the or on of my me in for and an a".split())
CALLS = set("watch use subscribe follow click".split())
TEMPLATE = set("utmsource streamsource source redpack postdesc navhide msource meta http-equiv filedetails blackboard".split())
TEMPLATE_PHRASE = set("watching subscribers subscriber subscribe profiles profile playlists playlist following follow channels channel".split())
SINGLE_STOP = set("watch videos video top sub profile playlist page list https http get event details channel app account".split())


def _in(c: Column, words: set[str]) -> Column:
    return c.isin(sorted(words))


def _n(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def english_subpart(p: Column, phrase: Column) -> Column:
    letters, numbers, size, vowels = _n(p, "[a-z]"), _n(p, "[0-9]"), F.length(p), _n(p, "[aeiou]")
    alnum, mixed = p.rlike("^[a-z0-9]+$"), numbers > 0
    bad = (
        ~p.rlike("^[ .a-z0-9\\-]+$") | (letters == 0)
        | (mixed & ((size < 3) | ((letters < 2) & ~_in(p, SHORT)) | (p.rlike("^[0-9]") & (letters < 2)) | ((numbers >= letters) & (size < 5))))
        | (alnum & (size >= 7) & (numbers >= 2) & (letters >= 3) & (vowels <= 1))
        | (alnum & (size >= 12) & mixed)
        | X.random_mix(p)
        | (~mixed & ((size == 1) | ((size == 2) & ~_in(p, SHORT) & ~phrase) | (X.no_vowels(p) & ~_in(p, SHORT))))
    )
    return ~bad


def english_part(p: Column, phrase: Column) -> Column:
    pieces = F.filter(F.split(p, "-"), lambda x: x != "")
    return (
        F.when(p == "", False).when(_in(p, STOP), phrase).when(p.contains("."), False).when(F.size(pieces) == 0, False)
        .otherwise(F.forall(pieces, lambda x: english_subpart(x, phrase)))
    )


def english_token(t: Column) -> Column:
    """Whether a normalised token is a word or phrase worth keeping."""
    parts = F.split(t, " ")
    n = F.size(parts)
    any_of = lambda words: F.exists(parts, lambda p: _in(p, words))
    phrase = n > 1
    bad = (
        ~F.length(t).between(2, 48) | _in(t, SINGLE_STOP) | _in(t, TEMPLATE) | ~t.rlike("^[ .a-z0-9\\-]+$") | t.rlike("^[.\\-]|[.\\-]$")
        | (t.contains(".") & ~t.rlike("^[a-z]{1,10}[0-9]+(?:\\.[0-9]+)+$")) | t.rlike("^(?:[a-z0-9\\-]+\\.)+[a-z]{2,}$")
        | (n > 6) | (X.token_chars(t) > 24) | (phrase & _in(parts[0], CALLS)) | (phrase & any_of(TEMPLATE_PHRASE)) | any_of(TEMPLATE)
        | ((n >= 4) & (F.size(F.filter(parts, lambda p: _in(p, STOP))) >= 2))
    )
    return ~bad & F.forall(parts, lambda p: english_part(p, phrase))


def english_candidates(c: Column) -> Column:
    """Distinct normalised strings that may be words or phrases, in the order of their first occurrence."""
    found = F.regexp_extract_all(X.dashes_to_bars(c), F.lit(ENGLISH), F.lit(0))
    # candidates are ASCII, so compatibility normalisation leaves them as they are
    return F.array_distinct(F.transform(found, lambda t: F.regexp_replace(F.lower(F.trim(F.regexp_replace(t, "\\s+", " "))), "^[ ._\\-]+|[ ._\\-]+$", "")))


def english_words(c: Column) -> Column:
    """Distinct words and phrases in the order of their first occurrence."""
    return F.filter(english_candidates(c), english_token)


_QUESTION = "值不值得|值不值|好不好|怎么回事|怎么看|怎么办|为什么|怎么|什么|哪家|是否|(?:么|呢|吗)$"
_CONNECTOR = "[\\s&+\\-・·、,，:：]+"


def _chinese_normal(t: Column) -> Column:
    t = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    t = F.when(t.rlike(X.IDEOGRAPH), F.translate(t, ",: ", "，：")).otherwise(t)
    t = F.regexp_replace(t, "[…．。～~？?！!]+$", "")
    t = F.regexp_replace(t, "(?U)^[\\s&+\\-・·：:、，,＠@＃#～~？?！!]+", "")
    return F.trim(F.regexp_replace(t, "(?U)\\s+", " "))


def chinese_token(t: Column) -> Column:
    han, lat, num = X.ideographs(t), X.latin(t), X.digits(t)
    connected = t.rlike("(?U)" + _CONNECTOR)
    segments = F.filter(F.transform(F.split(t, "(?U)" + _CONNECTOR), lambda s: F.trim(s)), lambda s: s != "")

    def good(s: Column) -> Column:
        h, a, d = X.ideographs(s), X.latin(s), X.digits(s)
        bad = (
            (h > 12) | ((a > 0) & (d > 0) & (a < 2) & (h < 2)) | ((a > 0) & (h == 0) & ~english_token(F.lower(s)))
            | ((a > 0) & (h > 0) & (((a == 1) & (h < 3)) | (s.rlike("[\\x00-\\x7F]$") & (a < 2)))) | ((d > 4) & (h < 2)) | (X.units(s) > 24)
        )
        return ~bad

    bad = (
        (t == "") | t.rlike("^[ ._0-9A-Za-z\\-]+$") | (han == 0) | t.contains(" ")
        | ~t.rlike(f"(?U)^(?:{X.IDEOGRAPH}|[\\s&+\\-・·、,，:：0-9A-Za-z])+$") | t.rlike("[\"'】【》《><}{\\]\\[\\\\=+_*^%$`～~？?！!]")
        | (han > 8) | (X.units(t) > 24) | t.rlike(_QUESTION) | (F.size(segments) == 0) | (F.size(segments) > 4) | ((lat > 0) & ~connected & (han < 2))
    )
    return ~bad & F.forall(segments, good)


def chinese_candidates(c: Column) -> Column:
    """Distinct tags in the order of their first occurrence; a tag with two commas or more is a list of tags."""
    tags = F.filter(F.transform(F.split(X.nfkc(c, lower=False), "[／/｜|@#]+"), _chinese_normal), lambda t: t != "")
    commas = lambda t: F.regexp_count(t, F.lit("[、，,]")) >= 2
    lists = F.transform(tags, lambda t: F.when(commas(t), F.transform(F.split(t, "[、，,]+"), _chinese_normal)).otherwise(F.array(t)))
    return F.array_distinct(F.filter(F.flatten(lists), lambda t: t != ""))


def chinese_words(c: Column) -> Column:
    return F.filter(chinese_candidates(c), chinese_token)


#: candidates of a text, and the test that each must pass
EXTRACTORS = {"english": (english_candidates, english_token), "chinese": (chinese_candidates, chinese_token)}


def word_records(docs: DataFrame, text: Column, language: str = "english", least: int = 1) -> DataFrame:
    """word, doc_freq, term_freq; extractors give each word once for a document, so both are equal.

    Candidates are counted first, and the tests, which are many regular expressions, see each distinct one once.
    """
    candidates, test = EXTRACTORS[language]
    flat = docs.select(F.explode(candidates(text)).alias("word")).groupBy("word").agg(F.count("*").alias("doc_freq"))
    return frequencies.at_least(flat, least).where(test(F.col("word"))).withColumn("term_freq", F.col("doc_freq"))

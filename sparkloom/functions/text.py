"""Text expressions: normalisation, counting, concatenation and cleaning of sentences and tokens.

All are Column -> Column and stay inside code generation, but for NFKC, which Spark has no built-in for.
Java's \\d, \\b and \\s are ASCII unless (?U) is set, which the patterns here do where it matters.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

MASK = "▂"
HAN = "\\u3040-\\u30FF\\u4E00-\\u9FFF"
ALNUM = "a-zA-Z0-9Α-Ωα-ω"
#: ideographs with their extension and compatibility blocks
IDEOGRAPH = "[\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF]"
_UNIT_CHARS = "亿兆万千百十个分厘毫" + "秒点号夜天日周月岁年" + "亩吋寸尺米平里磅克两升斤吨" + "字词行句张页节回卷部篇章集" + "连枚星倍台箱袋包杀卫厨厅室间套层楼辆架艘位种头件只份人名次届题课期折块元路系级阶季"
_UNIT_WORDS = "|".join(("世纪", "年代", "分钟", "小时", "周[岁年]", "倍[镜速]", "光年", "平方公里", "平方米", "平米", "[海公英]里", "公斤", "英[吋寸尺镑]", "[欧美日]元"))
_UNIT_PAIRS = "[亿兆万千百十个分厘毫][亩吋寸尺米平里磅克两升斤吨]"
_UNIT_LATIN = "kwh|[mk]?hz|[kmc]m|[mk]w|min|h|[mkugn]g|[munk]s"
#: any unit, longest kinds first
UNIT = f"(?:{_UNIT_WORDS}|{_UNIT_PAIRS}|kwh|[km]hz|[mck]m|[km]w|min|h|[ukm]g|[nmu]s|[{_UNIT_CHARS}])"
DIGIT_PREFIX = "[每那这前第]"


def lit_or(c: Column, default: str = "") -> Column:
    """A missing field reads as its default."""
    return F.coalesce(c, F.lit(default))


def drop_char_repeats(c: Column, most: int = 4) -> Column:
    """Removes whole runs of a character that is repeated more than `most` times beyond its first."""
    return F.regexp_replace(c, f"([{ALNUM}{HAN}_.\\-])\\1{{{most},}}", "")


def mask_letter_spaces(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)(?<=[A-Za-z])\\s+(?=[0-9A-Za-z])", MASK)


def non_words_to_space(c: Column) -> Column:
    """A space for each run of characters outside of words.

    The usual letters, and single spaces before them, which would stay as they are, are passed over before the classes are tried.
    """
    return F.regexp_replace(c, f"(?U)(?! ?[a-z0-9])(?:[^{HAN}〇{ALNUM}_.\\-{MASK}]+|\\.+(?!\\d)|[丨・]+)", " ")


def drop_numbers(c: Column) -> Column:
    """Removes digits with a prefix or unit, and digits that stand alone; what begins with neither isn't tried."""
    return F.regexp_replace(c, f"(?U)(?=[\\d{DIGIT_PREFIX[1:-1]}])(?:{DIGIT_PREFIX}?\\d+{UNIT}|(?:^|\\b)\\d+(?:\\b|$))", "")


def drop_spaces_in_han(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)(?<=[{HAN}])\\s+(?=[{HAN}])", "")


def merge_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "(?U)\\s{2,}", " "))


def simplify(c: Column, table: Mapping[str, str] | None = None) -> Column:
    """Maps traditional to simplified characters by a table of single characters; without one, nothing changes."""
    if not table:
        return c
    return F.translate(c, "".join(table), "".join(table.values()))


@dataclass(frozen=True)
class SentenceRules:
    """Which steps of sentence() apply; the order is fixed."""

    repeats: int | None = None
    mask: bool = False
    non_words: bool = False
    numbers: bool = False
    simplified: Mapping[str, str] | None = None


FREQUENCY_RULES = SentenceRules(non_words=True, numbers=True)
PIECE_RULES = SentenceRules(repeats=4, mask=True, non_words=True)


def sentence(c: Column, rules: SentenceRules = FREQUENCY_RULES) -> Column:
    c = F.lower(c)
    if rules.repeats and rules.repeats > 1:
        c = drop_char_repeats(c, rules.repeats)
    if rules.mask:
        c = mask_letter_spaces(c)
    if rules.non_words:
        c = non_words_to_space(c)
    if rules.numbers:
        c = drop_numbers(c)
    return simplify(c, rules.simplified)


def tokens(c: Column) -> Column:
    """White-space tokens; none for a null or blank text."""
    return F.filter(F.split(lit_or(c), "\\s+"), lambda t: t != "")


@pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.str.normalize("NFKC")


def nfkc(c: Column, lower: bool = True) -> Column:
    """Compatibility-normalised, spaces collapsed, and lower-cased on request; pure ASCII never leaves the JVM."""
    full = F.when(c.rlike("^[\\x00-\\x7F]*$"), c).otherwise(_nfkc(c))
    out = F.trim(F.regexp_replace(full, "(?U)\\s+", " "))
    return F.lower(out) if lower else out


# --- counting --------------------------------------------------------------------------------------------------------


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def ideographs(c: Column) -> Column:
    return count(c, IDEOGRAPH)


def digits(c: Column) -> Column:
    return count(c, "(?U)\\d")


def latin(c: Column) -> Column:
    return count(c, "[A-Za-z]")


def token_chars(c: Column) -> Column:
    return count(c, "[.a-z0-9\\-]")


def units(c: Column) -> Column:
    """An ideograph weighs three, an ASCII letter, digit, dot or dash one."""
    return 3 * ideographs(c) + count(c, "[.A-Za-z0-9\\-]")


def display_length(c: Column) -> Column:
    """Width in cells: two for wide characters, one for others."""
    return (F.length(c) + F.regexp_count(c, F.lit("[\\u1100-\\u115F\\u2E80-\\u303E\\u3041-\\u33FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uA000-\\uA4CF\\uAC00-\\uD7A3\\uF900-\\uFAFF\\uFE30-\\uFE6F\\uFF00-\\uFF60\\uFFE0-\\uFFE6]"))).cast("long")


def dashes_to_bars(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "-{2,}", "|"), " - | -|- ", "|")


def no_vowels(c: Column) -> Column:
    """More than four lower-case letters, none of them a vowel."""
    return c.rlike("^[b-df-hj-np-tv-z]{5,}$")


def random_mix(c: Column) -> Column:
    """Six or more letters and digits: at least four letters, one to three digits, and at most one vowel."""
    n = lambda p: F.regexp_count(c, F.lit(p))
    return c.rlike("^[a-z0-9]{6,}$") & (n("[a-z]") >= 4) & n("[0-9]").between(1, 3) & (n("[aeiou]") <= 1)


# --- concatenation ---------------------------------------------------------------------------------------------------


def _full(c: Column, empty: Sequence[str] = ("",)) -> Column:
    for e in empty:
        c = F.nullif(c, F.lit(e))
    return c


def joined(*fields: Column, sep: str = " | ") -> Column:
    """The fields that aren't empty, in order; a field may come twice."""
    return F.concat_ws(sep, *[_full(f) for f in fields])


def joined_words(*fields: Column, sep: str = " | ") -> Column:
    """As joined(), a lone dash counting as empty, trimmed and lower-cased."""
    return F.lower(F.trim(F.concat_ws(sep, *[_full(f, ("", "-")) for f in fields])))


def tagged(fields: Mapping[str, Column], dash_is_empty: Sequence[str] = ("desc",)) -> Column:
    """<tag>field</tag> for each field that isn't empty."""
    parts = []
    for tag, f in fields.items():
        value = _full(f, ("", "-") if tag in dash_is_empty else ("",))
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))))
    return F.concat_ws("", *parts)


def merged(*fields: Column) -> Column:
    return F.trim(F.concat_ws(" ", *[lit_or(f) for f in fields]))


def repeats_by_views(views: Column) -> Column:
    """1 up to 100 views, 8 from ten million, else one more than the decimal logarithm's whole part."""
    v = F.coalesce(views, F.lit(0))
    return F.when(v <= 100, 1).when(v >= 10_000_000, 8).otherwise(F.floor(F.log10(v + 1)) + 1).cast("int")


def replicated_by_views(c: Column, views: Column) -> Column:
    return F.when(F.coalesce(views, F.lit(0)) <= 100, c).otherwise(F.repeat(F.concat(c, F.lit(" ")), repeats_by_views(views)))


def replicated_by_items(c: Column, items: Column) -> Column:
    """Once with a space if there are items, else nothing."""
    return F.when(F.size(items) > 0, F.concat(c, F.lit(" "))).otherwise("")


def segments(c: Column, most: int) -> Column:
    """Words put together with spaces into segments that stay under `most` characters where a word allows."""
    words = tokens(c)
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    joined_ = lambda s, w: F.when(s["open"] == "", w).otherwise(F.concat(s["open"], F.lit(" "), w))

    def step(s: Column, w: Column) -> Column:
        over = (s["open"] != "") & (F.length(s["open"]) + 1 + F.length(w) >= most)
        return F.struct(F.when(over, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"), F.when(over, w).otherwise(joined_(s, w)).alias("open"))

    return F.aggregate(words, state, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


# --- cleaning of token lists -----------------------------------------------------------------------------------------


def clean_tokens(words: Column, drop_non_words: bool = True, drop_blank: bool = True) -> Column:
    if drop_non_words:
        words = F.filter(F.transform(words, lambda t: F.regexp_replace(t, f"[^{HAN}〇{ALNUM}\\-.%‰{MASK}]+|\\.(?!\\d)|-(?![a-zA-Z0-9])", "")), lambda t: t != "")
    if drop_blank:
        words = F.filter(words, lambda t: F.trim(t) != "")
    return F.transform(words, lambda t: F.replace(t, F.lit(MASK), F.lit(" ")))


def first_of_each(words: Column) -> Column:
    return F.array_distinct(words)


def delete_chars(c: Column, chars: str = "^｀!)(][/") -> Column:
    return F.translate(c, chars, "")


def concat_singles(words: Column, separators: Column | None = None) -> Column:
    """Joins neighbouring one-character tokens; a join doesn't cross the places (0-based) in `separators`."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("run"), F.lit(0).alias("i"))

    def step(s: Column, w: Column) -> Column:
        single = F.length(w) == 1
        cut = F.array_contains(separators, s["i"]) if separators is not None else F.lit(False)
        flushed = F.when(s["run"] != "", F.concat(s["done"], F.array(s["run"]))).otherwise(s["done"])
        go_on = single & ~cut
        return F.struct(
            F.when(go_on, s["done"]).when(single, flushed).otherwise(F.concat(flushed, F.array(w))).alias("done"),
            F.when(go_on, F.concat(s["run"], w)).when(single, w).otherwise("").alias("run"),
            (s["i"] + 1).alias("i"),
        )

    return F.aggregate(words, state, step, lambda s: F.when(s["run"] != "", F.concat(s["done"], F.array(s["run"]))).otherwise(s["done"]))


# --- keys ------------------------------------------------------------------------------------------------------------


def item_key(id_: Column, field: Column, kind: Column, head: str = "item") -> Column:
    return F.concat(F.lit(head + ":"), id_.cast("string"), F.lit(":"), field, F.lit("."), kind)


def parse_item_key(key: Column) -> Column:
    """struct(head, id, field, kind) of an item_key."""
    part = lambda i: F.regexp_extract(key, "^([^:]*):([^:]*):(.*)\\.([^.]*)$", i)
    return F.struct(part(1).alias("head"), part(2).alias("id"), part(3).alias("field"), part(4).alias("kind"))

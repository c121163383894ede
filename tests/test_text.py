"""Text expressions against fixed cases and Python's re."""

import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions import tokenize as Z
from sparkloom.operators import vocab, words


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("r")).first()["r"]


def many(spark, column, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, c string").select("i", column(F.col("c")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_char_repeats(spark):
    assert one(spark, X.drop_char_repeats, "aaabbbb啊啊啊啊啊哈哈哈哈哈aaccccc=====----____") == "aaabbbbaa=====----____"


CASES = ["Hello World 123 ok", "第3集 2024年 v2.0 abc", "a  b 1 c3", "多 个 字 x y", "3.14. end...", "no・split丨here", "", "12", "x12y 7"]


def test_same_as_python(spark):
    han, alnum = "一-鿿぀-ヿ", "0-9a-zA-Zα-ωΑ-Ω"
    assert many(spark, X.mask_letter_spaces, CASES) == [re.sub(r"(?<=[a-zA-Z])\s+(?=[a-zA-Z0-9])", "▂", c) for c in CASES]
    assert many(spark, X.non_words_to_space, CASES) == [re.sub(rf"[^{han}〇{alnum}\-._▂]+|\.+(?!\d)|[・丨]+", " ", c) for c in CASES]
    assert many(spark, X.drop_spaces_in_han, CASES) == [re.sub(rf"(?<=[{han}])\s+(?=[{han}])", "", c) for c in CASES]
    assert many(spark, X.drop_numbers, CASES) == [re.sub(rf"{X.DIGIT_PREFIX}?\d+{X.UNIT}|(?:^|\b)\d+(?:\b|$)", "", c) for c in CASES]


def test_english_candidates_same_as_python(spark):
    probe = ["PS5 is out, v1.2.3", "a-b c_d 0a 9 12x", "counting stars!gta5", "über x-ray"]
    pattern = re.compile(words.ENGLISH)
    assert many(spark, lambda c: F.regexp_extract_all(c, F.lit(words.ENGLISH), F.lit(0)), probe) == [pattern.findall(p) for p in probe]


@pytest.mark.parametrize("keep", ["gta5", "counting stars", "ps5", "spacex", "in a nutshell", "back to december", "one two three four five six"])
def test_english_keep(spark, keep):
    assert one(spark, words.english_words, keep) == [keep]


DROP = [
    "bowlroll.net", "0a", "use code", "zxcvbnm", "watch", "wte4kt", "video", "cjbc2009", "syc1664", "dgc2208", "use this code", "one two three four five six seven",
    "meta http-equiv", "super ultra amazing soundtrack",
]


def test_english_drop(spark):
    assert many(spark, words.english_words, DROP) == [[]] * len(DROP)


def test_chinese(spark):
    kept = ["原神，启动", "黑神话：悟空", "严阵以待", "分享", "计划", "创作灵感", "知识分享官"]
    assert many(spark, words.chinese_words, kept) == [[k] for k in kept]
    dropped = ["re：从零开始的异世界生活", "防脱洗发水什么牌子的好", "a玖", "怎么追女生", "值不值得买"]
    assert many(spark, words.chinese_words, dropped) == [[]] * len(dropped)
    assert one(spark, words.chinese_words, "#分享|计划，创作灵感，分享/严阵以待") == ["分享", "计划", "创作灵感", "严阵以待"]


def test_profile(spark):
    assert many(spark, vocab.malformed, ["bv123456", "aaabbbb", "abc__def", "-hello", "hello-"]) == [True] * 5
    assert many(spark, vocab.malformed, ["youtube", "gta5", "王者荣耀"]) == [False] * 3
    p = one(spark, vocab.profile, "王者youtube")
    assert (p["has_cjk"], p["is_ascii_token"], p["cjk_char_len"]) == (True, False, 2)


def test_pruned(spark):
    assert many(spark, vocab.pruned, ["的", "的确", "的人", "了解", "了不起的人", "了一", "九个汉字九个汉字字", "123", "ok"]) == [False, False, True, False, False, True, True, True, False]


def test_replication(spark):
    rows = spark.createDataFrame([(v,) for v in (None, 100, 101, 999, 1000, 9_999_999, 10_000_000)], "v long")
    assert [r[0] for r in rows.select(X.repeats_by_views(F.col("v"))).collect()] == [1, 1, 3, 4, 4, 8, 8]
    assert spark.range(1).select(X.replicated_by_views(F.lit("s"), F.lit(101)).alias("r")).first()["r"] == "s s s "


def test_concatenation(spark):
    df = spark.createDataFrame([("A", "", "-", None)], "a string, b string, c string, d string")
    a, b, c, d = (F.col(x) for x in "abcd")
    r = df.select(X.joined(a, b, d, a).alias("j"), X.joined_words(a, c).alias("w"), X.tagged({"x": a, "desc": c, "y": d}).alias("t"), X.merged(a, b, d).alias("m")).first()
    assert tuple(r) == ("A | A", "a", "<x>A</x>", "A")


def test_segments(spark):
    assert one(spark, lambda c: X.segments(c, 8), "aa bb cccc dddddddddd e") == ["aa bb", "cccc", "dddddddddd", "e"]
    assert one(spark, lambda c: X.segments(c, 8), "") == []


def test_nfkc_and_width(spark):
    assert many(spark, X.nfkc, ["ＡＢＣ  x", "plain  Text", None]) == ["abc x", "plain text", None]
    assert many(spark, X.display_length, ["abc", "王者a", ""]) == [3, 5, 0]


def test_tokenizer():
    model = Z.Unigram({"ab": -1.0, "a": -3.0, "b": -3.0, "王者": -1.0, "荣耀": -1.0, "王者荣耀": -1.5})
    assert model.tokenize("ab王者荣耀x") == ["ab", "王者荣耀", "x"]
    assert model.tokenize_short("王者荣耀", 2) == ["王者", "荣耀"]
    assert "".join(t for t, _ in Z.typed_spans("第3集abc-1 好, 3.5kg")) == "第3集abc-1 好, 3.5kg".replace("c ", "c▂")
    assert Z.join_same_kind(["hb", "k", "0", "8", "是"]) == ["hbk", "08", "是"]
    assert Z.join_numbers_to_words(["abc", "12", "是", "3"]) == ["abc12", "是", "3"]
    assert Z.SentenceTokenizer(model, drop_blank=True)(None) == []


def test_concat_singles(spark):
    df = spark.createDataFrame([(["a", "b", "cc", "d", "e"],)], "t array<string>")
    assert df.select(X.concat_singles(F.col("t")).alias("r")).first()["r"] == ["ab", "cc", "de"]
    assert df.select(X.concat_singles(F.col("t"), F.array(F.lit(1))).alias("r")).first()["r"] == ["a", "b", "cc", "de"]


def test_rules_with_lookarounds(spark):
    """Against Python's re, whose patterns mean the same here."""
    import re

    from sparkloom.catalogue_rules import SAMPLES

    han = "\u3040-\u30FF\u4E00-\u9FFF"
    rules = {
        X.drop_char_repeats: lambda s: re.sub(f"([{X.ALNUM}{han}_.\\-])\\1{{4,}}", "", s),
        X.drop_numbers: lambda s: re.sub(rf"{X.DIGIT_PREFIX}?\d+{X.UNIT}|(?:^|\b)\d+(?:\b|$)", "", s),
        X.non_words_to_space: lambda s: re.sub(rf"[^{han}〇{X.ALNUM}_.\-{X.MASK}]+|\.+(?!\d)|[丨・]+", " ", s),
    }
    rows = spark.createDataFrame([(s,) for s in SAMPLES], "s string").select("s", *[f(F.col("s")).alias(f"r{i}") for i, f in enumerate(rules)]).collect()
    for r in rows:
        assert list(r[1:]) == [f(r["s"]) for f in rules.values()]
    cleaned = lambda t: re.sub(rf"[^{han}〇{X.ALNUM}\-.%‰{X.MASK}]+|\.(?!\d)|-(?![a-zA-Z0-9])", "", t)
    got = spark.createDataFrame([(s,) for s in SAMPLES], "s string").select("s", X.clean_tokens(X.tokens(F.col("s"))).alias("w")).collect()
    for r in got:
        assert r["w"] == [t.replace(X.MASK, " ") for t in map(cleaned, re.split(r"[ \t\n\x0b\f\r]+", r["s"])) if t.strip(" ")]


def test_guards_change_no_match(spark):
    """The guards before the patterns of non-words and numbers only save time."""
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice("  ,.!a\u007azZ19٣年第每_-▂é\n\t\x0b丨・〇한😀Αω　") for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = f"(?U)[^{X.HAN}〇{X.ALNUM}_.\\-{X.MASK}]+|\\.+(?!\\d)|[丨・]+"
    numbers = f"(?U){X.DIGIT_PREFIX}?\\d+{X.UNIT}|(?:^|\\b)\\d+(?:\\b|$)"
    t = F.col("t")
    assert df.where((X.non_words_to_space(t) != F.regexp_replace(t, words, " ")) | (X.drop_numbers(t) != F.regexp_replace(t, numbers, ""))).count() == 0
    # letters and single spaces are not matched one by one any more
    shown = df.select(X.non_words_to_space(t), X.drop_numbers(t))._jdf.queryExecution().optimizedPlan().toString()
    assert "(?! ?[a-z0-9])" in shown and "(?U)(?=[" in shown

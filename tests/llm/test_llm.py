"""Training-data operators against brute force, and their defined cases."""

import hashlib
import random
import tracemalloc
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import chat, decontamination, html_main, mixing, ngram_join, pii, quality_rules, queries, sharding, suffix_dedup, textkit, token_store

SCHEMA = "doc_id long, text string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def corpus(n=60, seed=1):
    """Texts with exact and near copies, shared passages, and edge cases."""
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("th", "en", "Ou", "é", "st", "li") for b in ("a", "er", "ing", "on", "ß", "")]
    passage = " ".join(r.choice(words) for _ in range(40))
    texts = []
    for i in range(n):
        if i % 5 == 1:
            t = texts[r.randrange(len(texts))]
        elif i % 5 == 2:
            w = texts[r.randrange(len(texts))].split()
            for _ in range(max(1, len(w) // 30)):
                w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        else:
            w = [r.choice(words) for _ in range(r.choice([1, 2, 3, 12, 80, 300]))]
            if i % 3 == 0:
                w[len(w) // 2 : len(w) // 2] = [passage]
            t = "\n".join(" ".join(w[k : k + 11]) for k in range(0, len(w), 11))
        texts.append(t)
    return [(i * 2, t) for i, t in enumerate(texts)]


EDGE = [(None, None), (1001, ""), (1003, "  \n\t "), (1005, "one"), (1007, "One"), (1009, "two words"), (1011, "x" * 50_000), (1013, "ab " * 20_000)]


def frame(spark, data, extra=True):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    if extra:  # columns with clashing names
        for c in ("counts", "found", "shard", "_key", "_copies", "spans", "size"):
            df = df.withColumn(c, F.lit(c))
    return df


# --- 1 ---------------------------------------------------------------------------------------------------------------

PRIVATE = [
    ("mail john dot doe at example dot com now", "john dot doe at example dot com", "email"), ("x jane[at]mail[dot]org y", "jane[at]mail[dot]org", "email"),
    ("bob (at) site (dot) co (dot) uk", "bob (at) site (dot) co (dot) uk", "email"), ("call ＋１ ５５５ １２３ ４５６７ ８９", "＋１ ５５５ １２３ ４５６７ ８９", "phone"),
    ("plus one five five five one two three four five six seven", "plus one five five five one two three four five six seven", "phone"),
    ("four one one one one one one one one one one one one one one one", "four one one one one one one one one one one one one one one one", "card"),
    ("ip 192 dot 168 dot 1 dot 20 ok", "192 dot 168 dot 1 dot 20", "ip"), ("10[.]0[.]0[.]1", "10[.]0[.]0[.]1", "ip"), ("аnna@exаmple.com", "аnna@exаmple.com", "email"),
    ("it is one nine two dot one six eight dot zero dot one.", "one nine two dot one six eight dot zero dot one", "ip"),
    ("tel + one (five five five) 012 three four five six now", "+ one (five five five) 012 three four five six", "phone"),
    ("a​b@c​d.com", "a​b@c​d.com", "email"),
    ("call +1 555\u2011123\u20114567 now", "+1 555\u2011123\u20114567", "phone"), ("on 4111\xa01111\xa01111\xa01111.", "4111\xa01111\xa01111\xa01111", "card"),
    ("at 192.168·1·20 ok", "192.168·1·20", "ip"), ("tel +1\u2009555\u202f123\u20134567", "+1\u2009555\u202f123\u20134567", "phone"), ("ip ¹9².168.1.²", "¹9².168.1.²", "ip"),
    ("to jane@mail . org", "jane@mail . org", "email"), ("to jane@mail\tdot\torg", "jane@mail\tdot\torg", "email"), ("10  .  0\t.\t0 . 1", "10  .  0\t.\t0 . 1", "ip"),
    ("to jane_at_mail.org", "jane_at_mail.org", "email"), ("plus one five 5 five 1 two 3 four 5 six 7", "plus one five 5 five 1 two 3 four 5 six 7", "phone"),
    ("192 dot 168 dot one dot 20", "192 dot 168 dot one dot 20", "ip"), ("tel +1 555 123 45 six seven", "+1 555 123 45 six seven", "phone"), ("two 10 dot 0 dot 0 dot 1", "10 dot 0 dot 0 dot 1", "ip"),
]


@pytest.mark.parametrize("text, span, kind", PRIVATE)
def test_disguises(text, span, kind):
    assert [(pii.KINDS[k], text[a:b], p) for a, b, k, p in pii.find(text)] == [(kind, span, False)]


def test_glyph_gate():
    assert pii._TRIGGERS == set(pii.HOMOGLYPHS) and all(pii._FOREIGN[list(c.encode())].any() for c in pii.HOMOGLYPHS)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"a1 \t.@_([,-)]", "dot", "at", "arroba", "punkt", "one", "ocho", "42", "plus ", "double", " ", "1 dot ", "_at_", "a@", " . ", "\t.\t"]), max_size=14).map("".join))
def test_gates_are_weaker(text):
    if not pii._SIGN_TRIGGER.search(text) and not pii._RUN_TRIGGER.search(text):
        assert pii.transduce(text).text == text


@pytest.mark.parametrize("text", ["re at the. Onand erth at example.com", "one two. Three four", "un un un", "meet @ noon", "point by point", ""])
def test_clean(text):
    assert pii.find(text) == []


LONG_TEXTS = [
    "0" * 5000 + ".1.1.1", "1" * 40_000, "a" * 40_000 + " x@y.z", "a@" * 20_000, "1 " * 20_000, "1." * 20_000, "one " * 10_000, "+1" + " ()" * 20_000, "(at) " * 10_000,
    "one" + " " * 40_000 + "x", "a (at) one" + " " * 40_000 + "x", "a" + "\t" * 40_000 + "at b (dot) c", "(dot)" + " " * 40_000 + "(", " dot " * 10_000, "x[at]" + "a-" * 20_000, "one" + " (" * 20_000, "(" + " " * 40_000 + "at",
]


@pytest.mark.parametrize("text", LONG_TEXTS)
def test_long_runs_take_linear_time(text):
    import time

    began = time.process_time()
    pii.find(text)
    assert time.process_time() - began < 2


def brute_base(text):
    """The contract's patterns, as they stand, on the whole text."""
    import re

    found = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            if kind == 0 or (kind == 1 and max(int(x) for x in m.group().split(".")) <= 255) or (kind == 2 and 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0) or (kind == 3 and 10 <= len(digits) <= 15):
                found.append((m.start(), kind, m.end()))
    return [(a, b, k) for a, k, b in sorted(found)]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from([*"ab1@.-+_%() é", "@", "b.co", "1.", "23.", "255", "256", "007", "4111 1111 1111 1111", "4111-1111", "+1 921 555-83", "94", "..", "一"]), max_size=16).map("".join))
def test_base_spans(text):
    assert pii.plain(text) == brute_base(text)
    assert [x[:3] for x in pii.find(text) if x[3]] == brute_base(text)


def test_pii_query_columns(spark):
    data = [(1, "é a@b.co and 1.2.3.4, +1 (921) 555-8394; 4111 1111 1111 1111"), (2, None), (3, "999.1.1.1 4111 1111 1111 1112 +12")]
    got = {r["doc_id"]: r for r in pii.report(pii.detect(frame(spark, data, False))).collect()}
    spans = "email:2:8,ip:13:20,phone:22:39,card:41:60"
    assert got[1]["spans"] == spans and got[1]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    assert [got[1][c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 1, 1, 1]
    assert got[2]["spans"] == got[3]["spans"] == "" and got[2]["n_email"] == 0
    assert pii.redact(frame(spark, data, False)).where("doc_id = 1").first()["text"] == "é <email> and <ip>, <phone>; <card>"


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_token_store(spark):
    data = corpus(40) + [(None, "null"), (2001, None), (2003, "<|endoftext|>x 你好 Ünï\x1cx x́ ΑΣ!! 'S É,.")]
    path = queries.tokenizer_path()
    got = token_store.round_trip(frame(spark, data), path)
    assert rows(got) == sorted(token_store.brute_force(data, path), key=repr)


def test_encoder_joins_cores_and_keeps_words(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "WORDS", 2_000)
    path, rng = queries.tokenizer_path(), random.Random(5)
    words = ["".join(rng.choices("abcdeéÀñstz", k=rng.randint(1, 9))) + rng.choice(["", "", ",", ".", "?!", "...", ")"]) for _ in range(5_000)]
    words += ["K", "İx", "don't", "x.y", ".", "..a", "#", "ſs", "Ａb", "e\u0301", "3a", "<|endoftext|>", "a<|endoftext|>b", "straße", "\u212bb"]
    texts = [" ".join(words[i : i + 900]) for i in range(0, len(words), 900)]
    encode, whole, asked = token_store.Encoder(path, 2), Tokenizer.from_file(path), []
    ids = encode._ids
    encode._ids = lambda x: asked.extend(x) or ids(x)
    for again in range(2):
        for text in texts:
            raw = text.encode()
            assert encode(raw, np.array([0, len(raw)])) == [np.array([*whole.encode(text, add_special_tokens=False).ids, 2], "<u2").tobytes()]
        assert encode.by_core and len(asked) < 200


def test_token_store_repeated_and_missing(spark, tmp_path):
    path, out = queries.tokenizer_path(), f"file://{tmp_path}"
    df = frame(spark, [(0, "z"), (1, "a b"), (1, "a b"), (1, "c"), (None, "n"), (None, "n")], False)
    indexed = token_store.index(token_store.write(df, out, path), out)
    keys = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 3), (5, 0), (None, 0), (None, 1)], "_id long, _row long")
    got = {(r["_id"], r["_row"]): r["n_tokens"] for r in token_store.read(keys, out, indexed).collect()}
    assert [got[1, i] is not None for i in range(4)] == [True, True, True, False] and got[5, 0] is None and got[None, 1] == got[None, 0]
    assert token_store.round_trip(df.limit(0), path).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 2**32))
def test_perfect_hash(n, seed):
    h1, h2 = np.random.default_rng(seed).integers(0, 2**63, (2, n)).astype(np.uint64)
    assert sorted(token_store.PerfectHash.build(h1, h2)(h1, h2).tolist()) == list(range(n))


# --- 3 ---------------------------------------------------------------------------------------------------------------


def brute_counts(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    cover = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_counts(spark):
    data = corpus(50) + EDGE + [(3001, "a b\na b\na b c d e f\n\nx a b c d e f # | é<>"), (3003, "p q r s t " * 9)]
    got = quality_rules.judge(frame(spark, data), [], name="judged").select("doc_id", "text", "judged.*").collect()
    assert len(got) == len(data)
    for r in got:
        assert tuple(r["counts"][c] for c in quality_rules.COUNTS[:5]) == brute_counts(r["text"])
        n, repeats = r["counts"]["n_words"], r["counts"]["n_repeat_words"]
        assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n) and r["kept"] == (not r["base_failed"])


def test_rules_held_out(spark):
    r = random.Random(5)
    good = lambda: " ".join(r.choice(["thon", "erly", "ing", "ouer", "blest"]) + str(r.randrange(99)) for _ in range(60))
    junk = lambda: " ".join(w + r.choice(["***", "$$$"]) for w in good().split())
    data = [(i, junk() if i % 4 == 0 else good()) for i in range(400)]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(0, 200)] + [(None, 0), (7, None)], "doc_id long, quality int")
    df = frame(spark, data)
    rules = quality_rules.fit(df, labels)
    kept = {x["doc_id"] for x in quality_rules.keep(df, labels).collect()}
    assert rules and {i for i in range(200, 400) if i % 4} == {i for i in kept if i >= 200}
    assert quality_rules.keep(df, labels).columns == df.columns
    # rows of a labelled id are learned from once, in whatever order
    assert quality_rules.fit(df.union(df.where("doc_id < 50")).repartition(7), labels) == rules
    assert quality_rules.fit(df, labels.limit(0)) == [] and quality_rules.keep(df.limit(0), labels).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_decontamination(spark):
    data = corpus(40) + EDGE
    items = [(1, " ".join(data[0][1].split()[:30]).upper()), (2, "two, WORDS!"), (3, None), (4, "?!"), (None, "one"), (1, "never seen here at all or anywhere else in it ok"), (10, data[12][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, data)
    want = sorted(decontamination.brute_force(data, items), key=repr)
    assert rows(decontamination.report(decontamination.find(df, bench, name="hits"), name="hits")) == want
    assert rows(decontamination.report(decontamination.find(df, bench, name="hits", block_bytes=300), name="hits")) == want
    clean = decontamination.clean(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not r[-1] for r in want)
    assert decontamination.clean(df, bench.limit(0)).count() == len(data) and decontamination.clean(df.limit(0), bench).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.lists(st.lists(st.sampled_from("abcd"), max_size=200), max_size=4), st.integers(1, 5))
def test_automaton(items, docs, window):
    items = [(i // 2, " ".join(w)) for i, w in enumerate(items)]
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    matcher = decontamination.Matcher([(str(i), t) for i, t in items], window)
    counts, found, names = matcher.scan([t.encode() for _, t in docs])
    got = [(i, n, sum(b - a for a, b in f), len(k), hashlib.sha256(",".join(sorted(k)).encode()).hexdigest(), bool(f)) for (i, _), n, f, k in zip(docs, counts, found, names)]
    assert got == decontamination.brute_force(docs, items, window)


def test_long_items_in_parts(spark):
    long_ = " ".join(f"w{i}" for i in range(700))
    items = [(1, long_), (None, long_[300:900]), (2, "only four words here")]
    data = [(1, long_), (2, " ".join(long_.split()[400:425])), (3, "w1 w2 w3"), (4, "and only four words here too"), (5, " ".join(f"w{i}" for i in range(350, 359)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (400, 1 << 20):
        found = decontamination.find(frame(spark, data), bench, name="hits", block_bytes=block)
        assert rows(decontamination.report(found, name="hits")) == sorted(decontamination.brute_force(data, items), key=repr)


def test_source_spans():
    raw = "é, One—two  THREE".encode()
    assert [decontamination.Matcher([("i", t)], 10).scan([raw])[1] for t in ("two three", "THREE")] == [[[]], [[(2, 3)]]]
    assert decontamination.source_spans(raw, [(1, 2)]) == [(3, 10)]


# --- 5 ---------------------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(*[st.text(alphabet="\\#: <|/turn>a\né")] * 2), max_size=4))
def test_chat_round_trip(turns):
    text = "".join(chat.format_turn(r, [{"type": "text", "text": t}])[0] for r, t in turns)
    assert [(r, chat.unescape(b)) for r, b, _, _ in chat.parse_turns(text)] == turns


def test_chat(spark):
    said = r"\### Assistant: </turn> ok"
    data = [(8, 0, r, t) for r in ("a", "a!", "a:", None) for t in ("\\\\x", "#x", "###", "zz", "<|", "<a")] + [(1, 1, "assistant", "é"), (1, 0, "user", None), (2, 0, None, "x"), (-7, 0, "user", said), (-7, 1, "assistant", said), (None, 0, "assistant", "n"), (1, 1, "assistant", "é")] + [(3, i, "assistant", f"t{i}") for i in range(3000)]
    got = chat.format_and_read(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)))
    assert [r[:5] for r in rows(got)] == sorted(chat.brute_force(data), key=repr)
    assert chat.format_and_read(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_parts():
    parts = [{"type": "text", "text": "see <|image"}, {"type": "image", "uri": "u", "width": 57, "height": 28}, None, {"type": "audio", "uri": "v", "seconds": 2.0}, {"type": "document", "uri": "w", "pages": 3}]
    text, begin, end, files = chat.format_turn("user", parts)
    assert text[begin:end] == "see \\<|image<|image:0|><|audio:1|><|document:2|>"
    assert [(f["kind"], f["uri"], f["tokens"]) for f in files] == [("image", "u", 3), ("audio", "v", 50), ("document", "w", 1536)]
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


# --- 6 ---------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></ul></nav>
<!-- ad 1 --><div class="ad">buy</div><header>top</header><div id="cookie-notice">cookies</div><article><h1>A &amp; B</h1><p><b>bold<br>more<p>x  y&nbsp;z &lt;b&gt;</p><aside>side</aside>
<form><p>f</p></form><ul><li>one<li>two</ul></article><div class="comments"><p>reader</p></div><footer>&copy; f</footer></body></html>"""


def main_lines(html):
    return [t for t, z in html_main.blocks(html) if z == html_main.MAIN]


def test_blocks():
    assert main_lines(PAGE) == ["A & B", "bold more", "x y z <b>", "one", "two"]
    assert [t for t, z in html_main.blocks(PAGE) if z == html_main.OPEN] == []
    cut = PAGE[: PAGE.index("x  y") + 3] + "<b"
    assert main_lines(cut) == ["A & B", "bold more", "x"]


@pytest.mark.parametrize(
    "html, want",
    [
        ('<article><h2 id="related-work">Related work</h2><p id="legal">L</p><p class="notice-period">N</p><p>ok</p></article>', ["Related work", "L", "N", "ok"]),
        ("<article><p class=it's>hello</p><p title='a > b'>world</p></article>", ["hello", "world"]),
        ("<div class='content-sidebar-wrap with-sidebar'><article><p>a</p></article></div>", ["a"]),
        ("<article><p data-x=\"a class=ad b\">kept</p><div class='ad'>gone</div><div class='entry'><p>in</p></div><math>x</math></article>", ["kept", "in", "x"]),
        ("<div id=comments><article class=comment><p>reader</p></article></div><article><p>a &am<b></b>p; b</p></article>", ["a &amp; b"]),
        ("<article><p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p>yes<header><h1>h</h1></header></article>", ["yes", "h"]),
        ("<article><table><tr><td>a<td>b<tr><th>c</table><ul><li>d<p>e<li>f</ul><dl><dt>g<dd>h</dl></article>", ["a", "b", "c", "d", "e", "f", "g", "h"]),
    ],
)
def test_article_text(html, want):
    assert main_lines(html) == want


@pytest.mark.parametrize("html", ["<i>" * 8000 + "</b>" * 8000, "<i>" * 8000 + "x<p>" * 8000, "<i>" + "<div>" * 8000 + "</i>" * 8000, "<u><div>" + "<b>" * 8000 + "</u>" * 8000, "<p>" * 30_000, "<li><i>" * 8000, "a<" * 30_000, "<p " * 30_000, "<!--" * 20_000])
def test_markup_takes_linear_time(html):
    import time

    began = time.process_time()
    html_main.blocks(html)
    assert time.process_time() - began < 1


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30), st.sampled_from([1, 40, 1 << 28]))
def test_shared_lines_is_longest(a, b, most):
    found = sorted(html_main.shared_lines(a, b, most))
    it = iter(b)
    assert len(found) == longest_common(a, b) and all(a[i] in it for i in found)


def test_shared_lines_of_long_pages():
    import time

    began = time.process_time()
    a = ["x"] * 3000
    assert len(html_main.shared_lines(a, a[:2000])) == 2000 and len(html_main.shared_lines(["y", *a, "z"], ["u", *a, "v"])) == 3000
    assert len(html_main.shared_lines([str(i % 7) for i in range(3000)], [str(i % 5) for i in range(3000)])) > 1000
    assert time.process_time() - began < 3


@pytest.mark.parametrize("limits", [{}, {"small_classes": 0}])
def test_differencing(spark, limits):
    plain = lambda t: f"<html><body><div>Home News</div><p>{t}</p><p>second {t}</p><div>All rights</div></body></html>"
    marked = lambda i: f"<div>Home</div><article><p>both</p><div class='x{i}'>Follow us</div><div class=y>own {i}</div><p>{i}</p></article>"
    data = [(i, f"https://h.example.com/a/{i}?q=1", plain(f"own {i}")) for i in range(5)] + [(9, "https://other.example.com/z", plain("lone")), (10, None, None), (11, "u", ""), (12, "https://h.example.com/a/2", PAGE)]
    data += [(20, "http://c.example.com/1", plain("copy")), (21, "http://c.example.com/1?x", plain("copy")), (22, "http://c.example.com/2", plain("other"))] + [(30 + i, f"http://M.example.com/{i}", marked(i)) for i in range(3)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("_lines", F.lit(1))
    found = {r["page_id"]: r for r in html_main.extract(df, **limits).collect()}
    got = {k: r["text"] for k, r in found.items()}
    assert len(found) == len(data) and all(got[i] == f"own {i}\nsecond own {i}" for i in range(5))
    assert got[9] == "Home News\nlone\nsecond lone\nAll rights" and got[10] == got[11] == "" and got[12].startswith("A & B")
    assert got[20] == got[21] == "copy\nsecond copy" and found[20]["n_deleted"] == 2
    assert [got[30 + i] for i in range(3)] == [f"both\nown {i}\n{i}" for i in range(3)] and found[31]["n_shared"] == 3 and found[31]["n_deleted"] == 1
    assert html_main.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pairing_against_brute_force(spark):
    r = random.Random(4)
    data = [(i, f"http://{r.choice('ab')}.example.com/{r.choice('xyz')}/{r.randrange(5)}", "".join(f"<p>{r.choice('abcd')}</p>" for _ in range(r.randrange(1, 8)))) for i in range(60)]
    got = {x["page_id"]: x["text"] for x in html_main.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    import re

    classes = {}
    for _, url, html in data:
        host, path = re.match(r"http://([^/]*)(.*)", url).groups()
        lines = tuple(re.findall(r"<p>(.)</p>", html))
        raw = b"".join(hashlib.blake2b(x.encode(), digest_size=8).digest() for x in lines)
        key = (host, lines)
        place = (path, hashlib.blake2b(host.encode() + b"\0" + raw, digest_size=16).digest())
        classes[key] = min(classes.get(key, place), place)
    order = sorted(classes, key=lambda k: (k[0], *classes[k]))
    for i, url, html in data:
        key = (re.match(r"http://([^/]*)", url).group(1), tuple(re.findall(r"<p>(.)</p>", html)))
        at = order.index(key)
        near = [order[k][1] for k in (at - 1, at + 1) if 0 <= k < len(order) and order[k][0] == key[0]]
        gone = set().union(*(html_main.shared_lines(list(key[1]), list(o)) for o in near)) if near else set()
        assert got[i] == "\n".join(x for k, x in enumerate(key[1]) if k not in gone)


# --- 7 ---------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(1, 8), st.integers(1, 5))
def test_minimax(sizes, shards, per):
    ends = np.cumsum(sizes)
    blocks = ends[per - 1 :: per] if len(ends) % per == 0 else np.append(ends[per - 1 :: per], ends[-1])
    bounds = sharding.Boundaries(blocks, lambda b: ends[b * per : (b + 1) * per]) if per > 1 else sharding.Boundaries(ends)
    capacity, cuts = sharding.minimax(bounds, int(ends[-1]), max(sizes), shards)
    assert capacity == sharding.brute_force(sizes, shards)
    edges = [0, *cuts, int(ends[-1])]
    assert all(b in {0, *ends.tolist()} and 0 <= b - a <= capacity for a, b in zip(edges, edges[1:]))


@pytest.mark.parametrize("blocks", [1 << 20, 7])
def test_sharding(spark, blocks):
    data = corpus(60) + EDGE + [(5001, "hot text")] * 60 + [(6001 + i, "hot text") for i in range(30)]
    got = sharding.assign(frame(spark, data), shards=6, blocks=blocks).collect()
    assert len(got) == len(data)
    by_text = {}
    for r in got:
        if r["size"] > 16:  # null and empty texts are two groups
            by_text.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    want = sorted((d, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t in data if d is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == want
    first, size = {}, {}
    for d, t in data:
        first[t] = min(first.get(t, 10**9), -1 if d is None else d)
        size[t] = size.get(t, 0) + 16 + len((t or "").encode())
    loads = {}
    for r in got:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    assert max(loads.values()) == sharding.brute_force([size[t] for t in sorted(first, key=first.get)], 6)


def test_sharding_empty_and_place(spark):
    assert sharding.assign(frame(spark, [])).count() == 0
    data = corpus(30) + [(4, "dup")] * 3
    df = frame(spark, data)
    out = sharding.place(df, 4)
    assert out.columns == [*df.columns, "_shard"] and out.count() == len(data)


# --- 8 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed, grid", [(1, 100_000), (2, 2)])
def test_similar(spark, seed, grid):
    data = corpus(150, seed) + EDGE[1:] + [(9001, corpus(150, seed)[0][1])] * 2
    assert rows(ngram_join.similar(frame(spark, data), grid=grid, bucket_keys=3000)) == sorted(ngram_join.brute_force(data), key=repr)


def linked(spark):
    """Links between chains, a star, a ring and random pairs, in any order, over several tasks; and the least of each component."""
    r = random.Random(7)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    pairs += [(3000 + r.randrange(400), 3000 + r.randrange(400)) for _ in range(200)] + [(1 << 40, (1 << 40) + 1)]
    names = [*{x for p in pairs for x in p}]
    name = dict(zip(names, r.sample(names, len(names))))
    pairs = [(name[a], name[b]) for a, b in r.sample(pairs, len(pairs)) if a != b]
    least = {x: x for p in pairs for x in p}
    while (changed := {x: m for a, b in pairs for x in (a, b) if (m := min(least[a], least[b])) < least[x]}):
        least |= changed
    return spark.createDataFrame(pairs, "a long, b long").repartition(5), sorted(((x, m) for x, m in least.items() if x != m), key=repr)


@pytest.mark.parametrize("task_edges", [ngram_join.TASK_EDGES, 0])
def test_components_by_one_task_and_by_stars(spark, task_edges):
    links, want = linked(spark)
    assert rows(ngram_join.components(links, task_edges)) == want


def test_a_round_of_stars_is_planned_once(spark, monkeypatch):
    links, want = linked(spark)
    sizes, stored = [], ngram_join.stored

    def counted(df, name):
        sizes.append(df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate"))
        return stored(df, name)

    monkeypatch.setattr(ngram_join, "stored", counted)
    assert rows(ngram_join.components(links, 0)) == want
    assert max(sizes) <= 2  # groups are joined in two ways, each of which planned all before it anew


def test_components_of_few_links_take_few_jobs(spark):
    links, want = linked(spark)
    sc = spark.sparkContext
    sc.setJobGroup("few links", "")
    try:
        assert rows(ngram_join.components(links)) == want
        jobs = len(sc.statusTracker().getJobIdsForGroup("few links"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 8  # by stars there are some in each round, with broadcasts in the driver's memory


def test_keep_first(spark):
    data = corpus(60) + EDGE[:3] + [(0, corpus(60)[0][1])]
    df = frame(spark, data)
    kept = ngram_join.keep_first(df)
    want = {r[3] for r in ngram_join.brute_force(data) if r[1]}
    got = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == df.columns and sorted(x for x in got if x in want) == sorted(want) and len(got) == len(want) + 3
    assert ngram_join.similar(df.limit(0)).count() == 0


def test_keep_first_of_shared_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    # 5 is the first of b's component, and has also a near copy of 3 and texts equal but for case; the null id has near copies
    data = [(3, a), (5, b), (5, a + " more"), (5, b.upper()), (7, b), (None, c), (None, c + " more"), (None, c), (None, ""), (5, " "), (5, " "), (8, None)]
    got = rows(ngram_join.keep_first(frame(spark, data)).select("doc_id", "text"))
    assert len(got) == 7 and sorted((d, (t or "").lower().split()[:1]) for d, t in got if d is not None) == [(3, ["a0"]), (5, []), (5, []), (5, ["b0"]), (8, [])]
    assert [(t or "").split()[:1] for d, t in got if d is None].count(["c0"]) == 1 and (5, b.upper()) in got


def test_level_of_a_band(spark):
    # the first text has too few blocks at level 0; the others have enough there, but not at level 1, where they share none
    data = [(1, "w891 w410 w70 w498 w156 w126 w810"), (2, "w855 w665 w843 w225 w702 w885 w778"), (3, "w855 w665 w843 w225 w702 w885 w778 w10 w20")]
    assert rows(ngram_join.similar(frame(spark, data))) == sorted(ngram_join.brute_force(data), key=repr)


def thue_morse(n, a="a", b="b"):
    s = "0"
    while len(s) < n:
        s += s.translate({48: 49, 49: 48})
    return s.translate({48: ord(a), 49: ord(b)})


def test_words_with_equal_power_sums(spark):
    # such words have one polynomial hash modulo 2**64 whatever the base
    a, b = thue_morse(2048), thue_morse(2048, "b", "a")
    data = [(1, f"x {a} y"), (2, f"x {b} y"), (3, f"X {a.upper()} y"), (4, a), (5, b)]
    assert rows(ngram_join.similar(frame(spark, data))) == sorted(ngram_join.brute_force(data), key=repr)
    got = quality_rules.counts(*textkit.text_bytes(__import__("pyarrow").array([f"{a} {b}\n{b} {a}\n{a} {b}"])))
    assert got["n_dup_lines"].tolist() == [1] and got["n_distinct"].tolist() == [2]


@pytest.mark.parametrize("limits", [{"group_pairs": 3}, {"group_bytes": 400}, {"small_classes": 0, "group_bytes": 2000}])
def test_similar_in_cells(spark, limits):
    base = [f"w{i}" for i in range(30)]
    star = [(100 + i, " ".join(base[:25] + [f"s{i}a", f"s{i}b", f"s{i}c"] + base[25:])) for i in range(40)]  # near the centre, not each other
    data = [(1, " ".join(base))] + star + corpus(60)
    assert rows(ngram_join.similar(frame(spark, data), **limits)) == sorted(ngram_join.brute_force(data), key=repr)


def test_crowds_of_near_copies_are_linked_without_their_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base, data = [str(rng.randrange(10**6)) for _ in range(60)], []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(60)] = str(rng.randrange(10**6))
        data.append((i, " ".join(words)))
    data += [(100 + i, data[i][1]) for i in range(0, 20, 3)] + [(200, None), (201, "a b c d"), (202, "a b c d")]
    seen, made = [], ngram_join.candidates
    monkeypatch.setattr(ngram_join, "candidates", lambda *a: seen.append(made(*a)) or seen[-1])
    assert rows(ngram_join.similar(frame(spark, data))) == sorted(ngram_join.brute_force(data), key=repr)
    assert seen[0].count() < 60  # of over 900 links


def test_meeting_takes_the_memory_of_a_slice(spark, monkeypatch):
    class Plan:  # stands for a frame, to have the functions that it is given
        def __getattr__(self, name):
            return lambda *a: self.__dict__.setdefault("given", []).append(a) or self

        sparkSession = sparkContext = property(lambda self: self)

        def broadcast(self, value):
            return types.SimpleNamespace(value=value)

    plan, bound, rng = Plan(), ngram_join.Bound(70), np.random.default_rng(3)
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: df)
    ngram_join.candidates(plan, 3, bound, dict.fromkeys(range(9), 0), np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8), 1, 1000)
    sign, meet = (a[0] for a in plan.given if callable(a[0]))
    texts = [" ".join(map(str, rng.integers(0, 10**9, 300))) for _ in range(6000)]
    texts[4000:4010] = [f"{t} more" for t in texts[:10]]
    keys = [hashlib.md5(x.tobytes()).digest() for x in ngram_join.shingle_sets(*textkit.text_bytes(pa.array(texts)), 3)]
    signed = list(sign([pa.RecordBatch.from_pydict({"_cid": range(6000), "_key": keys, "_label": [0] * 6000, "_text": texts})]))
    n_keys = sum(sum(b.column("count").to_pylist()) for b in signed)
    tracemalloc.start()
    try:
        found = [(a, b) for x in meet(iter(signed)) for a, b, met, least in zip(*(c.to_pylist() for c in x.columns)) if met >= least]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == [(i, 4000 + i) for i in range(10)]
    assert n_keys > 800_000 and peak < 24 * n_keys  # a key is sent as 12 bytes, which aren't in the peak


@pytest.mark.parametrize("apart", [1, 10**12])  # classes too far apart for a number for each pair are ranked
def test_meetings_are_all_counted(apart):
    rng = np.random.default_rng(4)
    bound, size, label = ngram_join.Bound(70), rng.integers(20, 31, 40).astype(np.uint16), rng.integers(0, 3, 40).astype(np.uint16)
    batches, members = [], {}
    for k in range(6):
        who, key = np.sort(rng.integers(0, 40, 200)), (rng.integers(0, 60, 200) * 71_582_788).astype(np.uint32)
        step = np.diff(who * apart, prepend=who[0] * apart)
        marks = label[who].tobytes() if k else b""
        for w, x in zip(who.tolist(), key.tolist()):
            members.setdefault(x, []).append((w, int(label[w]) if k else 0))
        batches.append(pa.RecordBatch.from_pydict({"base": [int(who[0]) * apart], "count": [200], "sig": [key.tobytes()], "step": [step.astype(np.int32 if apart == 1 else np.int64).tobytes()], "n": [size[who].tobytes()], "label": [marks]}))
    want = {}
    for of_key in members.values():
        for i, (a, la) in enumerate(of_key):
            for b, lb in of_key[:i]:
                if a != b and (la != lb or not la) and 100 * min(size[a], size[b]) >= 70 * max(size[a], size[b]):
                    pair = min(a, b) * apart, max(a, b) * apart
                    want[pair] = want.get(pair, 0) + 1
    for limits in ({}, {"slice_keys": 50, "most": 20}):
        got = {}
        for x in ngram_join.meetings(iter(batches), bound, **limits):
            assert x.schema.types == [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            for a, b, met, least in zip(*(c.to_pylist() for c in x.columns)):
                got[a, b] = got.get((a, b), 0) + met
                assert least == bound.meet(int(min(size[a // apart], size[b // apart])))
        assert got == want and len(want) > 500


@pytest.mark.parametrize("split", [0, 1000])
def test_overlaps_take_little_beside_the_result(split):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 90, False), rng.integers(0, 9999, 20).astype(np.uint64)])) for _ in range(2500)]
    tracemalloc.start()
    try:
        got = ngram_join.overlaps(sets, split)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.shape == ((split, 2500 - split) if split else (2500, 2500)) and peak < got.nbytes + 12_000_000
    for a, b in rng.integers(0, 2500, (2000, 2)).tolist():
        if (a < split <= b) if split else a != b:
            assert got[a, b - split] == len(np.intersect1d(sets[a], sets[b], True))


def test_keys_of_a_set_are_known_from_its_size(spark):
    bound = ngram_join.Bound(70)
    got = spark.range(1, 6000).select("id", bound.all_keys(F.col("id"))).collect()
    assert all(k == len(ngram_join.bands(n, bound)) * bound.keys(n) for n, k in got)


def test_pigeonhole():
    bound = ngram_join.Bound(70)
    r = np.random.default_rng(0)
    for _ in range(300):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = a.copy()
        for k in range(int(r.integers(0, n + 1)) // 4):
            b[r.integers(len(b))] = r.integers(0, 2**63)
        b = np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 70 * (len(a) + len(b) - both):
            shared = False
            for band in set(ngram_join.bands(len(a), bound)) & set(ngram_join.bands(len(b), bound)):
                level = max(ngram_join.level_for(a, band, bound), ngram_join.level_for(b, band, bound))
                x, y = ({*np.sort(ngram_join.tokens(s, band, level, None)[0])[: bound.keys(len(s))].tolist()} for s in (a, b))
                shared |= len(x & y) >= bound.meet(min(len(a), len(b)))
            assert shared


# --- 9 ---------------------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.integers(1, 40))
def test_suffix_ranks(s, reach):
    ranks = suffix_dedup.suffix_ranks(np.array(s), reach)
    suffixes = [tuple(s[i : i + reach]) for i in range(len(s))]
    assert [suffixes[i] for i in np.lexsort((np.arange(len(s)), ranks))] == sorted(suffixes)


#: each limit at its default, and so low that the other way is taken
LIMITS = [{}, {"hot": 2, "bucket_bytes": 5_000}, {"map_bits": 4}, {"map_bits": 4, "hot": 2, "bucket_bytes": 5_000}, {"small_classes": 0, "count_bytes": 10_000}]


@pytest.mark.parametrize("options", LIMITS)
def test_dedup(spark, options):
    alone = "".join(random.Random(3).choices("abcdefgh ", k=442))
    data = corpus(60) + [(None, corpus(60)[3][1]), (7001, "a" * 500), (7003, "ab" * 90 + "x" + "ab" * 90), (7005, corpus(60)[0][1] * 3), (7007, None), (7009, ""), (7011, "a" * 500), (7011, "a" * 500), (7013, "é" * 300)]
    data += [(7021, alone)] * 3 + [(7023, "y" + alone), (7025, alone[:100]), (7025, alone[:100]), (None, None), (None, None), (7007, None)]
    assert rows(suffix_dedup.dedup(frame(spark, data), **options)) == sorted(suffix_dedup.brute_force(data), key=repr)


@pytest.mark.parametrize("options", LIMITS[:3])
def test_dedup_repeated_rows(spark, options):
    a, b = ("".join(random.Random(i).choices("abcdefgh ", k=442)) for i in (1, 2))
    for data in ([(1, a), (1, a), (2, b)], [(5, a)] * 3, [(5, a)] * 3 + [(4, b), (4, b), (None, a)]):
        assert rows(suffix_dedup.dedup(frame(spark, data), **options)) == sorted(suffix_dedup.brute_force(data), key=repr)


def test_only_likely_repeats_are_sorted(monkeypatch):
    raw = np.random.default_rng(7).integers(0, 256, 50_000).astype(np.uint8)
    raw[40_000:40_150] = raw[10_000:10_150]
    raw[30_000:30_400] = 97  # overlapping repeats of a run
    valid = np.flatnonzero(np.arange(len(raw) - 99) % 10_000 < 9_000)
    sizes, whole = [], suffix_dedup.suffix_ranks
    monkeypatch.setattr(suffix_dedup, "suffix_ranks", lambda s, reach: sizes.append(len(s)) or whole(s, reach))
    got = suffix_dedup.repeated(raw, valid, 100)
    assert max(sizes) == 150 + 150 + 400
    seen, data = set(), raw.tobytes()
    assert got.tolist() == [data[k : k + 100] in seen or seen.add(data[k : k + 100]) is not None for k in valid.tolist()]


def test_dedup_shuffles_texts_of_many_classes_once(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = suffix_dedup.dedup(frame(spark, corpus(60)), small_classes=0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # texts come to the last step as the join with their classes has placed them
    assert "Exchange" not in plan[plan.index("MapInArrow finish") : plan.index("SortMergeJoin [unhex(sha2(")]


def test_copies_are_compared_by_bytes():
    raw = np.frombuffer(b"abcabdabc", np.uint8)
    begin, length = np.array([0, 3, 6]), np.array([3, 3, 3])
    assert suffix_dedup.copies(raw, begin, length, np.array([1, 2, 1]), np.array([0, 2, 1])).tolist() == [False, False, True]
    assert not suffix_dedup.copies(raw, begin, length, np.array([1, 1, 1]), np.array([0, 1, 2])).any()


def test_ids_are_whole_numbers(spark):
    df = spark.createDataFrame([("x", "text")], "doc_id string, text string")
    for f in (suffix_dedup.dedup, ngram_join.similar, lambda d: token_store.round_trip(d, queries.tokenizer_path())):
        with pytest.raises(TypeError):
            f(df)


def test_dedup_empty_and_long(spark):
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0
    old = suffix_dedup.SEGMENT
    raw = np.random.default_rng(0).integers(97, 123, 3000).astype(np.uint8)
    suffix_dedup.SEGMENT = 1000
    try:
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([raw.tobytes()], pa.binary())], ["_text"])
        found = [(int(a + base[0]), int(n), int(h)) for r, o, _, base in suffix_dedup.segments(iter([batch]), 100) for a, n, h in zip(*suffix_dedup.anchor_runs(r, o, 100, 32))]
        starts = sorted(s for a, n, _ in found for s in range(a, a + n))
        assert starts == list(range(3000 - 99))
    finally:
        suffix_dedup.SEGMENT = old


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_water_fill():
    assert mixing.water_fill([10, 10], [3, 1], 20, 2) == [15.0, 5.0]
    assert mixing.water_fill([2, 10], [3, 1], 16, 2) == [4.0, 12.0]
    assert mixing.water_fill([], [], 0, 2) == []


def test_flow_spreads_repeats():
    # a pattern that both sources share: the quota of the poor one is met from it, and nothing is repeated that need not be
    flows = mixing.route([(10, [0]), (10, [0, 1]), (2, [1])], [12, 8], 2)
    assert sum(flows) == 20 and flows[0] == 10 and max(f / s for f, s in zip(flows, (10, 10, 2))) <= 1


def test_route_of_many_sources():
    n = 20_000
    sizes = [10 + i % 7 for i in range(n)]
    quotas = mixing.water_fill(sizes, [(3, 1, 2)[i % 3] for i in range(n)], 1.5 * sum(sizes), 2)
    flows = mixing.route([(s, [i]) for i, s in enumerate(sizes)], quotas, 2)
    assert flows == [min(round(q), 2 * s) for q, s in zip(quotas, sizes)] and abs(sum(quotas) - 1.5 * sum(sizes)) < 1e-3
    # overlapping patterns are one network: against all ways to share a few words
    assert sorted(mixing.route([(4, [0, 1]), (3, [1]), (2, [2])], [5, 4, 3], 2)) == [3, 3, 6]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 3)), min_size=1, max_size=8), st.integers(0, 100))
def test_water_fill_rounds(sources, total):
    sizes, weights = zip(*sources)
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:  # the rule as it is stated
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > 2 * sizes[i]]
        for i in full or open_:
            out[i] = float(2 * sizes[i]) if full else left * weights[i] / weight
        left -= sum(out[i] for i in full)
        open_ -= set(full or open_)
    assert mixing.water_fill(sizes, weights, total, 2) == pytest.approx(out)


def test_mix_of_sets(spark):
    data = corpus(60)
    df = frame(spark, data)
    pair = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("b"), F.lit("a"))).when(F.col("doc_id") % 4 == 2, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit(None).cast("string")))
    names, sizes, quotas, flows = mixing.plan(mixing.seeded(df, pair, "doc_id", "text"))
    assert names == ["a", "b"] and list(flows) == [("a", "b")]
    out = mixing.resample(df, pair)
    words = lambda t: len(t.split())
    got = sum(words(r["text"]) for r in out.collect())
    assert abs(got - flows["a", "b"][1]) <= max(words(t) for _, t in data) and mixing.resample(df, F.array().cast("array<string>")).count() == 0


def test_mix(spark):
    data = corpus(120) + EDGE + [(8001, "the same words again and again")] * 60
    df = frame(spark, data).withColumn("source", F.when(F.col("doc_id") % 7 == 0, "b").when(F.col("doc_id") % 7 == 1, None).otherwise("a"))
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(5)).collect()
    assert len(got) == len(data) and sorted(got, key=repr) == sorted(again, key=repr)
    total = sum(r["size"] for r in got)
    sums = {}
    for r in got:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]
        key = (r["source_size"], r["target"])
        sums[key] = sums.get(key, 0) + r["taken"]
    assert len(sums) == 3 and sum(s for s, _ in sums) == total
    # each cut is at a whole document: no source is off by more than half its largest one that fell on the cut
    largest = {}
    for r in got:
        key = (r["source_size"], r["target"])
        largest[key] = max(largest.get(key, 0), r["size"])
    assert all(abs(taken - target) <= largest[k] / 2 + 1 for k, taken in sums.items() for _, target in [k])
    assert mixing.mix(df.limit(0)).count() == 0


def test_resample(spark):
    data = corpus(80) + [(8001, "the same words again and again")] * 40
    df = frame(spark, data).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "b").otherwise("a"))
    out = mixing.resample(df)
    assert out.columns == df.columns
    want = {}
    for r in mixing.mix(df).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + (r["taken"] // r["size"] if r["size"] else 0)
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.resample(df.limit(0)).count() == 0


# --- kernels ---------------------------------------------------------------------------------------------------------


def test_pieces_and_hashes():
    import pyarrow as pa

    texts = ["abc def", None, "", "é ü", "x" * 500, "abc"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    parts = list(textkit.pieces(iter([batch.slice(1), batch]), "t", 8))
    assert sum(p.num_rows for p in parts) == 11 and [x for p in parts for x in p.column("t").to_pylist()] == texts[1:] + texts
    raw, offsets = textkit.text_bytes(batch.column("t"))
    starts, ends, first = textkit.spans(textkit.IS_WORD[raw], offsets)
    assert np.diff(first).tolist() == [2, 0, 0, 2, 1, 1]
    h = textkit.Hasher(raw)(starts, ends)
    assert h[0] == h[-1] and len(set(h.tolist())) == 5

"""Operators on small tables with known results."""

import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import vectors as V
from sparkloom.functions.embed import HashedNgrams, embedding
from sparkloom.operators import frequencies, hashing, neighbours, ranks, relations, stats, suggest, vocab, weights
from sparkloom.plans import pipelines
from sparkloom.sources import tables
from sparkloom.streaming import ingest


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_frequencies(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, []), (4, None)], "id int, w array<string>")
    assert rows(frequencies.frequencies(docs, F.col("w"))) == [("a", 2, 3), ("b", 1, 1)]


def test_merge_parts(spark):
    schema = "word string, doc_freq long, term_freq long"
    a = spark.createDataFrame([("gta5", 3, 5), ("ps5", 1, 1)], schema)
    b = spark.createDataFrame([("gta5", 2, 2), ("elden ring", 4, 6)], schema)
    assert rows(frequencies.merge_parts([a, b], 2)) == [("elden ring", 4, 6), ("gta5", 5, 7)]


def test_shard_plans():
    plans = stats.shard_plans(100, 4, 10)
    assert len(plans) == 4 and plans[0][1:] == (10, 23) and plans[-1][1:] == (79, 21)
    assert stats.shard_plans(3, 5) == [(0, 0, 1), (1, 1, 1), (2, 2, 1)]
    assert stats.shard_plans(0, 4) == []


def test_assign_units():
    shards = stats.assign_units([("a", 10), ("a", 9), ("b", 8), ("b", 1)], 2)
    assert len(set(shards)) == 2


def test_round_robin_against_loop(spark):
    rng = np.random.default_rng(3)
    data = [(s, f"w{i}", int(rng.integers(1, 50)), int(rng.integers(50, 99))) for s in "xyz" for i in rng.choice(30, 12, replace=False)]
    lists = {s: sorted([r for r in data if r[0] == s], key=lambda r: (-r[2], -r[3], r[1])) for s in "xyz"}
    for unique in (1, 5, 12, 100):
        seen, k = {}, 0
        while len(seen) < unique and k < 12:
            for s in "xyz":
                _, t, d, n = lists[s][k]
                old = seen.get(t, (0, 0))
                seen[t] = (old[0] + d, old[1] + n)
            k += 1
        df = spark.createDataFrame(data, "source string, token string, doc_freq long, term_freq long")
        assert rows(vocab.merge_round_robin(df, unique)) == sorted([(t, *v) for t, v in seen.items()], key=repr)


def test_merge_pieces(spark):
    data = []
    for source, wiki, pieces in (("v1", False, ["王者荣耀", "youtube", "ab"]), ("v2", False, ["王者荣耀", "youtube", "cd"]), ("w", True, ["wikionly", "百科", "ef"])):
        data += [(source, wiki, i, p, 10.0 - i) for i, p in enumerate(pieces)]
    df = spark.createDataFrame(data, "source string, is_wiki boolean, rank int, piece string, score double")
    merged = {r["piece"]: r["score"] for r in vocab.merge_pieces(df, keep=1.0).collect()}
    assert "wikionly" not in merged and "youtube" in merged and merged["王者荣耀"] > merged["youtube"]
    assert merged["游"] == 100.0 and merged["▂"] == 80.0


def test_edited(spark):
    pieces = [("good", 0), ("12", 1), ("3个", 2), (".x", 3), ("a%b", 4), ("y", 5), ("fine", 6), ("a", 7), ("b", 8)]
    df = spark.createDataFrame(pieces, "piece string, rank int")
    assert [r[0] for r in rows(vocab.edited(df).select("piece"))] == ["fine", "good", "y"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0],)], "v array<double>")
    v = F.col("v")
    r = df.select(V.head_of_windows(v, 2, 3).alias("a"), V.downsample(v, 2, 4).alias("b"), V.stretch(F.slice(v, 1, 2), 2).alias("c"), V.cosine(v, v).alias("d"), V.replace_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit(1)), F.array(F.array(F.lit("x"), F.lit("y")))).alias("e")).first()
    assert r["a"] == [1, 2, 4, 5, 7, 8] and r["b"] == [1, 2, 5, 6, 9, 0] and r["c"] == [1, 1, 2, 2] and math.isclose(r["d"], 1.0) and r["e"] == ["a", "x", "y", "c"]


def test_stretch_shift_add(spark):
    m = np.random.default_rng(0).standard_normal((3, 4))
    out = np.zeros(4 * 5)
    for i, row in enumerate(m):
        wide = np.zeros(20)
        wide[::5] = row
        out += np.roll(wide, 5 * i // 3)
    df = spark.createDataFrame([(m.tolist(),)], "r array<array<double>>")
    assert np.allclose(df.select(V.stretch_shift_add(F.col("r"), 5).alias("v")).first()["v"], out)


def test_codes(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<double>")
    planes = hashing.planes(32, 256)
    codes = hashing.lsh(df, planes)
    got = {r["id"]: r["code"] for r in codes.collect()}
    want = np.packbits((x @ planes.T > 0).astype(np.uint8), axis=1)
    assert got == {i: w.tobytes().hex() for i, w in enumerate(want)}
    d = hashing.diagnostics(codes, 256).first()
    assert 0.9 < d["entropy_mean"] <= 1 and d["unique_ratio"] == 1.0
    pair = codes.where("id = 0").select(F.col("code").alias("a")).crossJoin(codes.where("id = 1").select(F.col("code").alias("b")))
    h = pair.select(V.hamming(F.col("a"), F.col("b")).alias("h")).first()["h"]
    assert h == int(np.unpackbits(want[0] ^ want[1]).sum()) and 0.4 * 256 < h < 0.6 * 256


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<double>").repartition(3)
    for block in (8192, 16):
        got = {(r["query"], r["rank"]): r["id"] for r in neighbours.nearest(df.where("id < 40"), df, 3, block=block).collect()}
        assert all(got[q, k + 1] == [j for j in np.argsort(-sims[q], kind="stable") if j != q][k] for q in range(40) for k in range(3))
        pairs = {(r["a"], r["b"]) for r in neighbours.similar_pairs(df, 0.4, block=block).collect()}
        assert pairs == {(i, j) for i in range(120) for j in range(i + 1, 120) if sims[i, j] >= 0.4}
    t = neighbours.triplets(df, 2, "id").orderBy("sample_idx").collect()
    assert t[0]["neg_id"] == t[1]["anchor"] and all(t[i]["neg_id"] == t[i - 1]["anchor"] for i in range(1, len(t)))


def test_rank_scores(spark):
    data = [("q", 0, m, i, r) for m, own in (("a", range(8)), ("b", range(8)), ("c", reversed(range(8)))) for i, r in enumerate(own)]
    df = spark.createDataFrame(data, "query string, anchor_idx int, model string, hit_idx int, rank int")
    s = {r["model"]: r["score"] for r in ranks.overall_scores(ranks.rank_scores(df)).collect()}
    assert s["a"] == s["b"] == 1.0 and s["c"] < 0
    few = ranks.rank_scores(df.where("hit_idx < 2 and rank < 2"))
    assert all(r["score"] is None for r in few.collect())


def test_calibration_of_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert tuple(ranks.calibration(df, "x", "y").first()) == (1.0, 0.0)


def test_relations(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, f string")
    assert [r[0] for r in rows(relations.apply(df, relations.field_filter("f", ["a"], reverse=True)).select("id"))] == [2, 3]
    assert relations.field_filter("f", []) is None and relations.any_of([None]) is None
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id int, f string")
    assert rows(relations.upserted(old, [df.where("id = 2"), df.where("id = 3")], "id")) == [(1, "x"), (2, "b"), (3, None)]
    assert rows(relations.to_do(df, old, "id").select("id")) == [(3,)]


def test_suggest(spark):
    w = spark.createDataFrame([("apple", "pingguo", 3), ("apples", None, 5), ("banana", "apx", 1)], "word string, pinyin string, score int")
    p = spark.createDataFrame([("app",), ("ap",), ("",)], "prefix string")
    assert rows(suggest.prefix_matches(w, p, ("word", "pinyin")).select("prefix", "word", "rank")) == [("ap", "apple", 2), ("ap", "apples", 1), ("ap", "banana", 3), ("app", "apple", 2), ("app", "apples", 1)]
    docs = spark.createDataFrame([(1, "a b c"), (2, "b c a b"), (3, None)], "id int, t string")
    ph = spark.createDataFrame([("a b",), ("c",), ("x",)], "phrase string")
    assert rows(suggest.phrase_counts(docs, ph, [F.col("t")], "id")) == [("a b", 2), ("c", 2), ("x", 0)]


def test_weights(spark):
    df = spark.createDataFrame([("a", 1), ("b", 10), ("c", 100)], "token string, term_freq long")
    for method in ("log", "ratio", "power", "quantile"):
        w = {r["token"]: r["weight"] for r in weights.frequency_weights(df, method).collect()}
        assert w["a"] == 1.0 and w["c"] == 0.1 and 0.1 <= w["b"] <= 1.0
    with pytest.raises(ValueError):
        weights.frequency_weights(df, "other")


def test_text_vectors(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "zz")], "id int, token string")
    v = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 2.0])], "token string, vector array<double>")
    assert np.allclose(weights.text_vectors(t, v).first()["vector"], [2**-0.5, 2**-0.5])
    assert np.allclose(weights.text_vectors(t, v, normalise=False, how="sum").first()["vector"], [1, 1])


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("null", 3, 5), ("nan", 2, 2), ('quo"te,', 1, 1)], tables.FREQUENCY)
    tables.write_frequencies(df, str(tmp_path / "f"))
    assert rows(tables.read_frequencies(spark, str(tmp_path / "f"))) == rows(df)
    assert tables.read_frequencies(spark, str(tmp_path / "f"), 1).first()["token"] == "null"
    samples = spark.range(25).withColumnRenamed("id", "sample_idx")
    tables.write_samples(samples, str(tmp_path / "s"), 10)
    assert [r[0] for r in tables.read_samples(spark, str(tmp_path / "s"), 8, 12, 10).select("sample_idx").orderBy("sample_idx").collect()] == [8, 9, 10, 11]
    with pytest.raises(ValueError):
        tables.replace(df, str(tmp_path / "f"))
    assert list(tables.batches(samples.coalesce(1), "sample_idx", 10))[-1] == [20, 21, 22, 23, 24]


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, f string, at int").write.parquet(src)
    schema = "id int, f string, at int"
    for more in ([], [(2, "c", 2), (3, "d", 2)]):
        if more:
            spark.createDataFrame(more, schema).write.mode("append").parquet(src)
        ingest.append_new(ingest.source(spark, src, schema), "id", out, str(tmp_path / "c")).awaitTermination()
        ingest.upsert(ingest.source(spark, src, schema), "id", ["at"], str(tmp_path / "u"), str(tmp_path / "d")).awaitTermination()
    assert rows(spark.read.parquet(out).select("id", "f")) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(spark.read.schema(schema).parquet(str(tmp_path / "u/version=1")).select("id", "f")) == [(1, "a"), (2, "c"), (3, "d")]


def test_workflow():
    order = []
    pipelines.run_workflow({k: (lambda k=k: order.append(k)) for k in ("words", "train", "merge", "convert")}, {"merge": ["words", "train"], "convert": ["merge"]})
    assert set(order[:2]) == {"words", "train"} and order[2:] == ["merge", "convert"]
    assert pipelines.expand_targets(["merge", "all"]) == ["merge", "words", "train", "convert"]


def test_embedding(spark):
    df = spark.createDataFrame([("abc",), ("abc",), (None,)], "t string")
    got = [r[0] for r in df.select(embedding(df, HashedNgrams(32))(F.col("t"))).collect()]
    assert got[0] == got[1] and math.isclose(np.linalg.norm(got[0]), 1, rel_tol=1e-5)


def test_edited_by_source(spark):
    data = [("en", 0, "word"), ("en", 1, "a"), ("de", 0, "x"), ("de", 1, "wort"), ("de", 2, "12"), ("de", 3, "z"), (None, 0, "mot"), (None, 1, "o")]
    got = vocab.edited(spark.createDataFrame(data, "source string, rank int, piece string"), "source").collect()
    assert sorted(((r["source"], r["piece"]) for r in got), key=repr) == sorted([("en", "word"), ("de", "x"), ("de", "wort"), (None, "mot")], key=repr)


def test_rounded_as_duckdb(spark):
    import duckdb

    x = [(k + 0.5) / 1e6 for k in range(-2000, 2000)] + [0.0, -1e-9, 2.5e-6, 0.49999999999999994e-6, 1e300, float("inf"), None]
    got = [r["r"] for r in spark.createDataFrame([(v,) for v in x], "x double").select(V.rounded("x", 6).alias("r")).collect()]
    want = [duckdb.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in x]
    assert list(map(repr, got)) == list(map(repr, want))


def test_blended_with_missing_ids(spark, tmp_path):
    import duckdb

    from sparkloom import catalogue_rules

    rng = np.random.default_rng(5)
    data = [(i, rng.standard_normal(64).tolist(), 0) for i in (0, 1, 2, 3, 5, 6, 8)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = {r["token"]: list(r["vector"]) for r in catalogue_rules.QUERIES["blended_vectors"](spark, str(tmp_path)).collect()}
    assert got == dict(duck.execute(catalogue_rules.ORACLE["blended_vectors"]).fetchall()) and set(got) == {"0", "1"}


def test_least_important_against_pairs(spark):
    rng = np.random.default_rng(6)
    data = [(d, f"t{rng.integers(0, 9)}", rng.standard_normal(5).tolist()) for d in (1, 2) for _ in range(30)]
    data += [(1, "t3", [0.0] * 5), (1, "t4", None), (3, "alone", [1.0] * 5), (3, "alone", [2.0] * 5), (4, "x", [0.0] * 5), (4, "y", [1.0] * 5), (5, "p", [1.0] * 5), (5, "q", [1.0] * 5), (6, None, [1.0] * 5)]
    df = spark.createDataFrame(data, "doc int, token string, vector array<double>").repartition(3)
    want = {}
    for d in {r[0] for r in data}:
        near = {}
        own = [(t, np.array(v or [0.0] * 5)) for x, t, v in data if x == d and t]
        for a, u in own:
            for b, v in own:
                if a != b:
                    near.setdefault(a, [])
                    if u.any() and v.any():
                        near[a].append(u @ v / np.linalg.norm(u) / np.linalg.norm(v))
        if near:
            want[d] = max((bool(c), sum(c), a) for a, c in near.items())[2]
    found = weights.least_important(df, "doc")
    assert {r["doc"]: r["token"] for r in found.collect()} == want and set(want) == {1, 2, 4, 5}
    # a pair of rows is never made: tokens of a document meet its sum only
    few = weights.least_important(spark.range(20_000).select(F.lit(1).alias("doc"), F.col("id").cast("string").alias("token"), F.array(F.cos("id"), F.sin("id")).alias("vector")), "doc")
    assert few.count() == 1


def test_phrases_of_many_lengths(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(list("abcd"), rng.integers(0, 60))) for _ in range(40)] + [None, "", "A-b  C!"]
    phrases = sorted({" ".join(rng.choice(list("abc"), n)) for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17) for _ in range(3)} | {t for t in texts if t and len(t) > 60} | {"B c", "b C", "?"})
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    asked = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    plain = lambda t: " " + " ".join(re.findall("[a-z]+", (t or "").lower())) + " "
    want = sorted([(p, sum(plain(p).strip() != "" and plain(p) in plain(t) for t in texts)) for p in phrases], key=repr)
    for block in (4 << 20, 100):
        assert rows(suggest.phrase_counts(docs, asked, [F.col("text")], "id", block_bytes=block)) == want
    both = suggest.phrase_counts(docs, asked, [F.col("text"), F.lit("b c")], "id")
    assert rows(both.where("phrase = 'B c'")) == [("B c", len(texts))]
    # a long phrase is no longer a window of its length for each word of each text
    assert "Generate" not in suggest.phrase_counts(docs, asked, [F.col("text")], "id")._jdf.queryExecution().executedPlan().toString()


def test_exact_percentiles_by_cells(spark):
    rng = np.random.default_rng(8)
    data = [("a", float(x)) for x in rng.standard_normal(3000)] + [("b", float(x)) for x in rng.integers(0, 4, 500)] + [("c", 1.5), ("d", None), ("a", None), (None, 2.0)]
    df = spark.createDataFrame(data, "g string, x double").repartition(3)
    points = (0.0, 0.001, 0.1, 0.3, 0.5, 0.7, 0.999, 1.0)
    for accuracy in (10_000, 5):  # the second sketch is poor, which must not show
        got = {r["g"]: r["values"] for r in stats.percentiles_disc(df, "g", "x", points, accuracy).collect()}
        for g in ("a", "b", "c", None):
            own = sorted(x for h, x in data if h == g and x is not None)
            assert got[g] == [own[max(1, -(-len(own) * round(p * 1000) // 1000)) - 1] for p in points]
        assert "d" not in got
    lines = spark.createDataFrame([(float(v), float(f)) for v, f in rng.uniform(1, 5000, (400, 2))], "v double, f double")
    for found in (stats.ratio_buckets(lines, "v", "f"), stats.summaries(lines.withColumn("d", F.lit("2020-05-05").cast("date")), F.col("d"), ["f"], stats.ranges_table(spark, [(dt.date(2020, 1, 1), dt.date(2021, 1, 1))]))):
        assert "percentile_disc" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_codes_with_ties(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 2, (300, 20)).astype(np.uint8)
    x[50:90] = x[7]
    for ids in (list(range(300)), [f"n{i}" for i in range(300)]):
        df = spark.createDataFrame([(i, np.packbits(v).tobytes().hex()) for i, v in zip(ids, x)], f"id {'int' if ids[0] == 0 else 'string'}, code string").repartition(3)
        far = (x[:, None] != x[None]).sum(axis=2)
        asked = range(0, 300, 10)
        want = sorted([(ids[q], j, int(h), n + 1) for q in asked for n, (h, j) in enumerate(sorted((far[q, t], ids[t]) for t in range(300) if t != q)[:5])])
        for block in (8192, 7):
            found = hashing.nearest_codes(df.where(F.col("id").isin([ids[q] for q in asked])), df, 5, block=block)
            assert sorted(map(tuple, found.collect())) == want
        assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_nearest_with_equal_vectors(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((60, 8))
    x[20:50] = x[3] * rng.uniform(0.5, 2, (30, 1))  # equal but for rounding
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<double>").repartition(4)
    found = neighbours.nearest(df.where("id in (3, 30)"), df, 4, digits=12)
    assert {q: [r["id"] for r in sorted(found.where(f"query = {q}").collect(), key=lambda r: r["rank"])] for q in (3, 30)} == {3: [20, 21, 22, 23], 30: [3, 20, 21, 22]}


def test_numbered_in_slices(spark):
    rng = np.random.default_rng(11)
    data = [(g, int(x), f"k{i}") for i, (g, x) in enumerate(zip(rng.choice(["a", "b", None], 500), rng.integers(0, 6, 500)))]
    df = spark.createDataFrame(data, "g string, x int, k string").repartition(3)
    for by in (None, "g"):
        found = relations.numbered(df, [F.desc("x"), F.col("k")], by)
        want = {}
        for g in {r[0] for r in data} if by else [0]:
            want |= {r[2]: i for i, r in enumerate(sorted((r for r in data if not by or r[0] == g), key=lambda r: (-r[1], r[2])))}
        assert {r["k"]: r["_rank"] for r in found.collect()} == want
    df = df.where("g is not null").select(F.col("g").alias("source"), (F.col("g") == "b").alias("is_wiki"), (F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1).alias("rank"), F.col("k").alias("piece"), F.col("x").cast("double").alias("score"))
    plan = lambda t: t._jdf.queryExecution().optimizedPlan().toString()
    # none of these has a window over all rows, or all of a source, besides the one above
    assert plan(vocab.rank_normalised(df.localCheckpoint())).count("Window") == 0
    strata = relations.stratified(df.select("piece"), 5, [F.col("piece")], "piece", 3)
    assert strata.count() == 5 and "windowspecdefinition(piece" not in plan(strata)

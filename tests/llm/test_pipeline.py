"""The corpus pipeline, stage by stage, against brute force on a small fixture."""

import random

import corpus_pipeline
import numpy as np
from sparkloom.llm import decontamination, mixing, ngram_join, quality_rules, sharding

from .test_llm import brute_counts, corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fixture(spark, folder):
    r = random.Random(3)
    docs = corpus(150, 4)
    docs += [(5000 + i, " ".join(w + "***" for w in t.split())) for i, (_, t) in enumerate(docs[:30])]
    data = [(d, t, "en", r.choice(["s1", "s2", None]), len(t)) for d, t in docs]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 0 if d >= 5000 else 1, 0) for d, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, " ".join(docs[5][1].split()[:25])), (2, "nothing of this kind is in any of the texts that are here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return data, items


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    data, items = fixture(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "sharding"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rules = quality_rules.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    at = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        assert docs.columns == COLUMNS + ["shard"] * (i == 4)
        at[name] = docs.collect()
    text = {d: t for d, t, *_ in data}

    def passes(t):
        n, chars, symbols, _, repeats = brute_counts(t)
        if n < 10 or 100 * repeats > 20 * n:
            return False
        got = quality_rules.counts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        c = {k: float(v[0]) for k, v in got.items()}
        words, chars = max(c["n_words"], 1), max(c["word_chars"], 1)
        x = {
            "n_words": c["n_words"], "mean_word": c["word_chars"] / words, "longest": c["longest"], "symbols": symbols / words, "upper": c["n_upper"] / chars, "bangs": c["n_bangs"] / words,
            "stops": c["n_stops"] / words, "digits": c["n_digits"] / chars, "dup_lines": c["n_dup_lines"] / max(c["n_lines"], 1), "repeats": c["n_repeat_words"] / words,
            "distinct": c["n_distinct"] / words, "line_words": c["n_words"] / max(c["n_lines"], 1),
        }
        return not any(all(x[n] <= v if s == "<=" else x[n] > v for n, s, v in r.conditions) for r in rules)

    kept = sorted(d for d, t in text.items() if passes(t))
    assert sorted(r["doc_id"] for r in at["quality rules"]) == kept and len(kept) < len(data)
    similar = ngram_join.brute_force([(d, text[d]) for d in kept])
    kept = sorted({r[3] for r in similar})
    assert sorted(r["doc_id"] for r in at["n-gram Jaccard join"]) == kept
    kept = sorted(r[0] for r in decontamination.brute_force([(d, text[d]) for d in kept], items) if not r[-1])
    assert sorted(r["doc_id"] for r in at["benchmark decontamination"]) == kept
    source = {d: s for d, _, _, s, _ in data}
    size = {d: len(text[d].split()) for d in kept}
    names = sorted({source[d] for d in kept}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size[d] for d in kept if source[d] == s) for s in names]
    targets = mixing.water_fill(sizes, [3, 1, 2], 1.5 * sum(sizes), 2)
    times = {}
    for r in at["mixing sources"]:
        assert r["text"] == text[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 2
    for s, target in zip(names, targets):
        taken = sum(n * size[d] for d, n in times.items() if source[d] == s)
        assert abs(taken - target) <= max(size[d] for d in kept if source[d] == s)
    loads, shard = {}, {}
    for r in at["sharding"]:
        n = 16 + len(r["text"].encode())
        loads[r["shard"]] = loads.get(r["shard"], 0) + n
        assert shard.setdefault(r["text"], r["shard"]) == r["shard"] and 0 <= r["shard"] < 40
    groups = {}
    for r in at["sharding"]:
        first, total = groups.get(r["text"], (r["doc_id"], 0))
        groups[r["text"]] = (min(first, r["doc_id"]), total + 16 + len(r["text"].encode()))
    assert max(loads.values()) == sharding.brute_force([n for _, n in sorted(groups.values())], 40)


def test_run(spark, tmp_path):
    fixture(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*COLUMNS, "shard"] and out.count()

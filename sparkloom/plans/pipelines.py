"""Composite datasets: token cache, vector index build, benchmark, and the vocabulary workflow."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import ranks as R
from ..operators import relations

TARGETS = {"all": ("words", "train", "merge", "convert"), "vocab": ("merge", "convert"), "words": ("words",), "train": ("train",), "merge": ("merge",), "convert": ("convert",)}
FIELD_WEIGHTS = {"title": 1.0, "tags": 2.0, "owner": 2.0, "desc": 0.5}


def token_cache(docs: DataFrame, fields: Sequence[Column], keys: Sequence[str], tokenize: Callable[[Column], Column] = X.tokens, rules: X.SentenceRules = X.FREQUENCY_RULES, test: Column | None = None) -> DataFrame:
    """Filter, join fields, normalise, tokenise: the keys, sentence and tokens, in one pass."""
    kept = relations.apply(docs, test)
    return kept.select(*keys, X.sentence(X.joined(*fields), rules).alias("sentence")).withColumn("tokens", tokenize(F.col("sentence")))


def token_cache_by_region(docs: DataFrame, regions: Mapping[str, Column], *args, **options) -> DataFrame:
    """As token_cache() for overlapping regions, in one pass."""
    keys = [*args[1], "region"]
    return token_cache(relations.by_region(docs, regions), args[0], keys, **options)


def index_build(docs: DataFrame, tags: DataFrame, index: DataFrame, vectors: Mapping[str, str], key: str, weights: Mapping[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """Rows for keys that the index hasn't: tags looked up, field vectors added by weight."""
    fresh = relations.to_do(docs, index, key).join(tags, key)
    return fresh.select(key, V.normalised(V.weighted_sum(*[(F.col(c), weights[f]) for f, c in vectors.items()])).alias("vector"))


def benchmark(hits: DataFrame, anchors: DataFrame, models: Sequence[str], query: str = "query", anchor_idxs: Sequence[int] = (0, 1, 4, 9)) -> DataFrame:
    """Long ranks: for each query, anchor among its hits and model, the hits' ranks by cosine with the anchor.

    hits: (query, hit_idx, one vector column for each model); anchors are hits at the given places.
    """
    a = anchors.where(F.col("hit_idx").isin(list(anchor_idxs))).select(query, F.col("hit_idx").alias("anchor_idx"), *[F.col(m).alias(f"_a_{m}") for m in models])
    both = hits.join(a, query)
    sims = F.array(*[F.struct(F.lit(m).alias("model"), V.cosine(F.col(m), F.col(f"_a_{m}")).alias("sim")) for m in models])
    flat = both.select(query, "anchor_idx", "hit_idx", F.explode(sims).alias("_s")).select(query, "anchor_idx", "hit_idx", "_s.model", F.round("_s.sim", 9).alias("sim"))
    return R.hit_ranks(flat, F.col("sim"), [query, "anchor_idx", "model"]).drop("sim")


def expand_targets(names: Sequence[str]) -> list[str]:
    """Aliases expanded, each target once, in order."""
    return list(dict.fromkeys(t for n in names for t in TARGETS.get(n, (n,))))


def run_workflow(steps: Mapping[str, Callable[[], object]], after: Mapping[str, Sequence[str]]) -> dict[str, object]:
    """Runs steps as soon as those before them are done; independent ones submit their jobs side by side."""
    out: dict[str, object] = {}
    left = dict(steps)
    with ThreadPoolExecutor(max(1, len(steps))) as pool:
        while left:
            ready = [s for s in left if all(a in out or a not in steps for a in after.get(s, ()))]
            if not ready:
                raise ValueError(f"steps wait for each other: {sorted(left)}")
            for name, value in zip(ready, pool.map(lambda s: left[s](), ready)):
                out[name] = value
            for name in ready:
                del left[name]
    return out


def word_vectors(tokens: DataFrame, column: str = "tokens", dim: int = 64, window: int = 5, least: int = 5, seed: int = 1, partitions: int = 8) -> DataFrame:
    """(token, vector) by the built-in word2vec, the nearest built-in to subword training."""
    from pyspark.ml.feature import Word2Vec

    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=least, seed=seed, numPartitions=partitions, inputCol=column, outputCol="_v").fit(tokens)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vector"))

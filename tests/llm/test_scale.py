"""What must hold with many partitions, hot keys and repeated rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillmere.llm import ngram_join, suffix_dedup, toxicity


def test_bounds_never_fall_into_one():
    rng = np.random.default_rng(1)
    few = rng.integers(-(2**62), 2**62, (10, 3))
    assert suffix_dedup._bounds(few, 64).tolist() == sorted(few.tolist())
    assert suffix_dedup._bounds(np.repeat(few[:1], 50, 0), 64).tolist() == few[:1].tolist()
    assert suffix_dedup._bounds(few[:0], 64).shape == (0, 3)
    many = rng.integers(-(2**62), 2**62, (20_000, 3))
    bounds = suffix_dedup._bounds(many, 64)
    sizes = np.bincount(suffix_dedup._between(bounds, many), minlength=64)
    assert len(bounds) == 63 and sizes.max() <= 2 * sizes.mean()


def test_segments_are_dealt_evenly(spark):
    rows = spark.range(0, 30_000, 1, 8).selectExpr("xxhash64(id) as core", "xxhash64(id, 1) as context", "id as key", "0L as place")
    for tasks in (64, 5_000):  # the latter asks for more rows than there are
        drawn = suffix_dedup._sample(rows, tasks)
        bounds = suffix_dedup._bounds(drawn, tasks)
        every = np.array([tuple(r) for r in rows.select("core", "context", "key").collect()], np.int64)
        sizes = np.bincount(suffix_dedup._between(bounds, every), minlength=tasks)
        assert len(drawn) >= 20_000 and len(bounds) == tasks - 1 and sizes.max() <= 3 * max(sizes.mean(), 4)


def test_frequencies_of_many_partitions_are_summed_in_a_tree(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, True, i, " ".join(rng.choices("abcd", k=40))) for i in range(60)], "ref long, named boolean, text_key long, text string")
    profile = ngram_join._profile(docs.repartition(11), 5).cache()
    flat, tree = ngram_join._frequencies(profile), ngram_join._frequencies(profile, fan=2)
    assert (flat == tree).all() and flat.sum() == profile.filter("slice < 0").agg(F.sum("size")).first()[0]
    assert (ngram_join._frequencies(profile.filter("false")) == 0).all()


def test_links_through_a_shingle_of_many_documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    hot, docs = "one passage that all of the documents share", []
    for i in range(60):  # different, but for the passage; of every fourth a longer near copy
        own = rng.sample(words, 60)
        docs.append((2 * i, " ".join([*own, hot])))
        if i % 4 == 0:
            docs.append((2 * i + 1, " ".join(["so", *own, "and", hot, "here"])))
    sets = {}
    for k, t in docs:
        w = t.split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = {k: min(j for j in sets if 4 * len(sets[k] & sets[j]) >= 3 * len(sets[k] | sets[j])) for k in sets}
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) == 60


def test_a_repeated_id_is_one_document_of_the_fit(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["you", "are", "kind", "vile"] if i % 3 else ["fine", "day"], k=12))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("vile" in t)) for i, t in rows], "doc_id long, toxic int")
    once, often = toxicity.train(docs, labels), toxicity.train(docs.union(docs).union(docs.filter("doc_id < 20")), labels)
    a, b = ([r["score"] for r in toxicity.score(docs, m).orderBy("doc_id").collect()] for m in (once, often))
    assert a == b

"""The index for BM25: the same ranking as without it, no text read, blocks left out only where nothing is lost."""

import random
import shutil

from quillmere.operators import content as C
from quillmere.operators import retrieval as R


def rows(df):
    return sorted((r["query"], r["rank"], r["id"], r["score"]) for r in df.collect())


def corpus(spark, n=400, seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    data = [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(0, 60)))) for i in range(n)]
    return spark.createDataFrame([*data, (n, None), (n + 1, ""), (n + 2, "hot " * 5000)], "id long, text string")


def asks(spark):
    return spark.createDataFrame(
        [("frequent", "w0 w1 w2"), ("rare", "w250 w251 w0"), ("repeated", "W0, w0! the w0"), ("none", "absent"), ("blank", " ?! "), ("null", None), ("hot", "hot w3")],
        "query string, text string",
    )


def test_same_ranking_as_without_index(spark, tmp_path):
    d = corpus(spark)
    for block in (16, 1024):
        R.build_index(d, f"{tmp_path}/b{block}", block=block)
        for most in (1, 7, 1000):
            assert rows(R.search_index(spark, f"{tmp_path}/b{block}", asks(spark), most)) == rows(C.bm25_many(d, asks(spark), most))
    assert R.search_index(spark, f"{tmp_path}/b16", asks(spark), 0).count() == 0
    many = R.search_index(spark, f"{tmp_path}/b16", asks(spark), 7, least=3.0)
    assert rows(many) == rows(C.bm25_many(d, asks(spark), 7, least=3.0))


def test_terms_are_joined_where_they_are_too_many_to_name(spark, tmp_path, monkeypatch):
    d = corpus(spark)
    R.build_index(d, f"{tmp_path}/i", block=32)
    monkeypatch.setattr(R, "NAMED_TERMS", 2)
    assert rows(R.search_index(spark, f"{tmp_path}/i", asks(spark), 9)) == rows(C.bm25_many(d, asks(spark), 9))
    monkeypatch.setattr(R, "BROADCAST_TERMS", 2)
    assert rows(R.search_index(spark, f"{tmp_path}/i", asks(spark), 9)) == rows(C.bm25_many(d, asks(spark), 9))


def test_a_search_reads_no_text(spark, tmp_path):
    corpus(spark).write.parquet(f"{tmp_path}/docs")
    d = spark.read.parquet(f"{tmp_path}/docs")
    want = rows(C.bm25_many(d, asks(spark), 5))
    R.build_index(d, f"{tmp_path}/i")
    shutil.rmtree(tmp_path / "docs")
    assert rows(R.search_index(spark, f"{tmp_path}/i", asks(spark), 5)) == want


def test_named_terms_reach_the_scan(spark, tmp_path):
    R.build_index(corpus(spark), f"{tmp_path}/i", block=32)
    entries = R._entries(spark, f"{tmp_path}/i", spark.createDataFrame([("w250",), ("w251",)], "term string"))
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [w250,w251])]" in plan or "In(term" in plan.split("PushedFilters", 1)[1]


def test_blocks_below_the_reach_are_not_scored(spark, tmp_path):
    """Long documents hold the word once, short ones are made of it: the blocks of long ones cannot reach those."""
    data = [(i, "key word") for i in range(64)] + [(i, "key " + "other thing " * 200) for i in range(64, 640)]
    d = spark.createDataFrame(data, "id long, text string")
    q = spark.createDataFrame([("x", "key")], "query string, text string")
    R.build_index(d, f"{tmp_path}/i", block=32)
    first, rest, _, _ = R._searched(spark, f"{tmp_path}/i", q, 10, "query", 0.0, 1)
    assert first.count() == 1 and rest.count() <= 1  # of twenty blocks
    assert rows(R.search_index(spark, f"{tmp_path}/i", q, 10)) == rows(C.bm25_many(d, q, 10))


def test_empty_table_and_repeated_ids(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    R.build_index(none, f"{tmp_path}/none")
    assert R.search_index(spark, f"{tmp_path}/none", asks(spark), 5).count() == 0
    d = spark.createDataFrame([(1, "cat"), (1, "cat dog"), (None, "cat cat"), (2, "dog")], "id long, text string")
    R.build_index(d, f"{tmp_path}/same")
    q = spark.createDataFrame([("x", "cat")], "query string, text string")
    got = [(r["id"], r["rank"]) for r in R.search_index(spark, f"{tmp_path}/same", q, 5).orderBy("rank").collect()]
    assert sorted(str(i) for i, _ in got) == ["1", "1", "None"] and [k for _, k in got] == [0, 1, 2]

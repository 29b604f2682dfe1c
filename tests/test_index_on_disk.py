"""What the index for BM25 puts on disk: packed postings, no row for each query and document, no table longer than needed."""

import random
import re

from pyspark.sql import functions as F

from quillmere import scratch
from quillmere.operators import content as C
from quillmere.operators import retrieval as R


def rows(df):
    return sorted((r["query"], r["rank"], str(r["id"]), r["score"]) for r in df.collect())


def corpus(spark):
    rnd = random.Random(8)
    data = [(f"d{i}", " ".join(rnd.choices([f"ünï{k}" for k in range(60)], k=rnd.randint(0, 40)))) for i in range(300)]
    return spark.createDataFrame([*data, (None, "ünï1 " * 70_000), ("x", None), ("y", " ?! "), ("z", "ünï1 ünï2")], "id string, text string")


def asks(spark):
    return spark.createDataFrame([(i, f"ünï{i} ünï{i + 1} ünï1 ünï{50 - i} other") for i in range(30)], "query int, text string")


def test_postings_are_numbers_and_tables_of_the_build_go(spark, tmp_path):
    R.build_index(corpus(spark), f"{tmp_path}/i", block=64)
    postings, documents = spark.read.parquet(f"{tmp_path}/i/postings"), spark.read.parquet(f"{tmp_path}/i/documents")
    # one number for a posting; what a document has stands once
    assert dict(postings.dtypes)["docs"] == "array<bigint>" and documents.agg(F.sum(F.size("docs"))).first()[0] == 303
    assert postings.groupBy("term", "block").count().filter("count > 1").count() == 0
    hot = postings.filter("term = 'ünï1'").select("n", "block", F.explode("docs").alias("p")).selectExpr("block", "shiftright(p, 32) as at", "p & 4294967295 as f").orderBy(F.desc("f")).first()
    assert (hot["block"], hot["at"], hot["f"]) == (302 // 64, 302 % 64, 70_000)
    left = [p for _, p in scratch._MADE if re.search(r"/(index-rows|numbered|index-entries)-[0-9a-f]+$", p)]
    there = [p for p in left if spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    assert there == []


def test_nothing_is_shuffled_for_each_query_and_document(spark, tmp_path):
    R.build_index(corpus(spark), f"{tmp_path}/i", block=64)
    first, rest, _, more = R._searched(spark, f"{tmp_path}/i", asks(spark), 5, "query", 0.0, 1)
    assert first.count() > 0 and rest.count() > 0
    plan = R._best(more, 5)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    # by block before scores are summed; by query only the best of each task
    assert any(re.match(r"block#\d+L?, \d+$", d) for d in dealt) and "WindowGroupLimit" in plan
    by_query = [d for d in dealt if "query#" in d]
    assert by_query and all(re.match(r"query#\d+, \d+$", d) for d in by_query)
    assert rows(R.search_index(spark, f"{tmp_path}/i", asks(spark), 5)) == rows(C.bm25_many(corpus(spark), asks(spark), 5))


def test_shuffle_files_go_with_their_query(spark, tmp_path, monkeypatch):
    before, seen = spark.conf.get(scratch.SHORT), []
    monkeypatch.setattr(R, "written", lambda df, name, f=R.written: seen.append((name, spark.conf.get(scratch.SHORT))) or f(df, name))
    R.build_index(corpus(spark), f"{tmp_path}/i", block=64)
    R.search_index(spark, f"{tmp_path}/i", asks(spark), 5)
    assert {"index-rows", "index-entries", "index-first", "index-rest"} <= {k for k, _ in seen} and {v for _, v in seen} == {"true"}
    assert spark.conf.get(scratch.SHORT) == before

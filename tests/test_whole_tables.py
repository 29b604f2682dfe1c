"""Queries that once ran over a part of their input, on small tables, against plain Python."""

import math
import random

from pyspark.sql import functions as F

from quillmere.operators import quality as Q
from quillmere.plans.queries import QUERIES


def test_candidates_of_all_vectors(spark, tmp_path):
    rng = random.Random(3)
    rows = {i: [rng.uniform(-3, 3) for _ in range(64)] for i in (0, 7, 199, 200, 201, 5000)}
    spark.createDataFrame(sorted(rows.items()), "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {}
    for i, v in rows.items():
        v = [float(f"{x:.1f}") for x in v]
        for w in (0, 1):
            s, e = v[16 * w : 16 * w + 16], v[32 + 16 * w : 48 + 16 * w]
            best = lambda x: sorted(range(16), key=lambda p: (-x[p], p))[:5]
            for a in best(s):
                for b in best(e):
                    if a >= 2 and b >= 2 and 1 <= b - a + 1 <= 8:
                        want[i, w, a, b] = round(s[a] + e[b], 6)
    assert {i for i, *_ in want} == set(rows)
    got = {(r["id"], r["window"], r["start"], r["end"]): r["score"] for r in QUERIES["enumerate_candidates"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)
    spans = QUERIES["decode_spans"](spark, str(tmp_path)).filter("rank = 1").collect()
    assert {r["id"] for r in spans} == set(rows)
    assert all(want[r["id"], r["window"], r["start"], r["end"]] == max(x for k, x in want.items() if k[0] == r["id"]) for r in spans)
    # each example's probabilities, over all its windows
    for i in rows:
        own = {k: math.exp(x) for k, x in want.items() if k[0] == i}
        shares = {(r["id"], r["window"], r["start"], r["end"]): r["p"] for r in QUERIES["softmax"](spark, str(tmp_path)).filter(F.col("id") == i).collect()}
        assert shares.keys() == own.keys() and all(math.isclose(shares[k], own[k] / sum(own.values()), abs_tol=1e-5) for k in own)


def test_audit_finds_every_missing_source(spark):
    n = 10_500
    df = spark.range(n).select(F.lit("train").alias("split"), F.concat(F.lit("s"), "id").alias("source"), F.col("id").alias("k"), F.lit(3).alias("n_tokens"), F.lit(False).alias("truncated"))
    more = df.filter("k % 2 = 0").withColumn("split", F.lit("test")).withColumn("k", F.col("k") + n)
    none = spark.createDataFrame([("validation", "other", -1, 3, False), ("train", None, -2, 3, False)], "split string, source string, k long, n_tokens int, truncated boolean")
    got = Q.audit_dataset(df.union(more).union(none), "k").collect()
    want = {f"test/s{i}" for i in range(1, n, 2)} | {f"validation/s{i}" for i in range(n)} | {"test", "validation"}  # no source counts as one
    assert {r["finding"] for r in got} == {"source_missing"} and len(got) == len(want)
    assert {r["detail"] for r in got} == want

"""Stages of the pipeline, each on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from quillmere.llm import entries, ngram_join

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(60)) + (" vermin scum" if i % 5 == 0 else "") + (" token = 0123456789abcdef0123456789abcdef" if i % 7 == 1 else "")
    rows = [(i, text(i), "en", f"s{i % 2}", len(text(i))) for i in range(400)]
    rows += [(1000 + i, text(i) + " end", "en", "s0", 0) for i in range(1, 5)] + [(2000, None, None, None, None), (2001, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = P.drop_toxic(spark, docs, str(tmp_path)).cache()
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {r[0] for r in rows if not (r[0] < 400 and r[0] % 5 == 0)}
    single = P.drop_near_copies(spark, kept, str(tmp_path)).cache()
    groups = ngram_join.join(kept)
    assert {r["doc_id"] for r in single.collect()} == {r["component_id"] for r in groups.collect()} and single.count() == len(ids) - 4
    clean = P.redact_secrets(spark, single, str(tmp_path)).cache()
    assert clean.count() == single.count() and clean.filter(F.contains("text", F.lit("0123456789abcdef"))).count() == 0
    mixed = P.mix_sources(spark, clean, str(tmp_path)).cache()
    assert mixed.columns == P.COLUMNS and max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    done = P.encode(spark, mixed, str(tmp_path))
    assert done.count() == mixed.count() and done.filter("not round_trip").count() == 0


def test_names():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in entries.QUERIES}
    assert 4 <= len(P.STAGES) <= 5

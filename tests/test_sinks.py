"""A prepared set is replaced as a whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from quillmere.operators import registry as G
from quillmere.sources import readers as R


def rows(spark, place):
    return sorted((r["id"], r["split"]) for r in spark.read.json(place).collect())


def failing(spark):
    """Rows of which one cannot be computed when the others are written."""
    df = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).cast("long").alias("id"))
    return df.withColumn("split", F.lit("train"))


def test_a_failed_write_leaves_the_old_set(spark, tmp_path):
    good = spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string")
    place = R.write_report(str(tmp_path), "exp", "abc", {"kept": 2}, good, spark)
    for write in (lambda: R.write_report(str(tmp_path), "exp", "abc", {"kept": 9}, failing(spark), spark), lambda: R.write_prepared(failing(spark), place)):
        with pytest.raises(Exception, match="broken row"):
            write()
        assert rows(spark, place) == [(1, "train"), (2, "test")] and os.path.exists(f"{place}/dataset.json")
    with pytest.raises(Exception, match="broken row"):
        R.write_report(str(tmp_path), "exp", "new", {}, failing(spark), spark)
    assert os.listdir(tmp_path) == ["exp-abc"]
    assert [f["fingerprint"] for f in R.discover(spark, str(tmp_path))] == ["abc"]


def test_a_set_replaces_an_earlier_one_and_may_be_made_from_it(spark, tmp_path):
    place = f"{tmp_path}/out/"
    R.write_prepared(spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string"), place)
    R.write_prepared(spark.read.json(place).filter("id = 1").select("id", "split"), place)
    assert rows(spark, place) == [(1, "train")] and os.listdir(tmp_path) == ["out"]


def test_folders_in_the_making_are_not_found(spark, tmp_path):
    os.makedirs(f"{tmp_path}/_writing-exp-abc-0/split=train")
    assert R.discover(spark, str(tmp_path)) == []


def test_loaders_by_name(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Head\n\nSome *text*.")
    (tmp_path / "b.txt").write_text("Plain  ")
    for name, file in (("markdown", "a.md"), ("text", "b.txt")):
        assert [r["source_type"] for r in G.find(G.LOADERS, name)(spark, f"{tmp_path}/{file}").collect()] == [name]

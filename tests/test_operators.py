"""Operators against literals and plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmere.functions import text as X
from quillmere.operators import adapters as A
from quillmere.operators import content as C
from quillmere.operators import metrics as M
from quillmere.operators import paper as P
from quillmere.operators import quality as Q
from quillmere.operators import selection as S
from quillmere.operators import windows as Wi
from quillmere.plans import inputs as I
from quillmere.sources import readers as R


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("What is 2 + 2?", "what is 2 plus 2"), ("2 - 2", "2 minus 2"), ("Is x > 5?", "is x greater than 5"), ("The ____ of the cell.", "blank of cell"),
     ("well-known and/or", "wellknown andor"), ("1,000 is 1000", "1000 is 1000"), ("3.5 at 2:1", "3 point 5 at 2 ratio 1"), ("5! <= 3", "5 factorial less than or equal 3"), ("", "")],
)
def test_normalize_question(spark, text, want):
    assert one(spark, text, X.normalize_question) == want


def test_clean_text(spark):
    assert one(spark, "﻿Title\r\n\r\n\r\n\r\nBody ​\x07 ", X.clean_text) == "Title\n\nBody"
    assert one(spark, "   ", X.clean_text) == ""


def test_tighten_span(spark):
    df = spark.createDataFrame([("  ab  ", 0, 6), ("    ", 1, 3)], "t string, s int, e int")
    got = [tuple(r["x"]) for r in df.select(X.tighten_span(F.col("t"), F.col("s"), F.col("e")).alias("x")).collect()]
    assert got == [(2, 4), (1, 1)]


def test_metrics_edges(spark):
    p = spark.createDataFrame([("a", "The cat"), ("b", ""), ("c", "x")], "id string, prediction string")
    r = spark.createDataFrame([("a", ["a dog", "cat!"]), ("b", [""]), ("c", [])], "id string, golds array<string>")
    got = {x["id"]: (x["em"], x["f1"]) for x in M.example_scores(p, r).collect()}
    assert got == {"a": (1.0, 1.0), "b": (1.0, 1.0), "c": (0.0, 0.0)}
    with pytest.raises(Exception, match="no prediction for"):
        M.example_scores(p.filter("id <> 'a'"), r).collect()


def test_adapters(spark):
    q = spark.createDataFrame([("p", ["q1", " ", "q3"], ["a1", "a2", "a3"], None), ("p", ["q"], [], "7"), ("", ["q"], ["a"], "8")], "paragraph string, questions array<string>, answers array<string>, paragraph_id string")
    rows = A.adapt_qag(q).select(F.size("targets").alias("n"), "rejection_reason").collect()
    assert [(r["n"], r["rejection_reason"]) for r in rows] == [(2, None), (0, "questions and answers differ in number"), (1, "no context")]
    m = spark.createDataFrame([("c", "q", ["x", "y", "z"], " Y ", None), ("c", "q", ["x", "y", "z"], "C", None), ("c", "q", ["x", "x", "z"], "x", None), ("c", "q", ["x", "y", "z"], "x", 2), ("c", "q", ["x", "y"], "x", None)], "context string, question string, options array<string>, answer string, correct_index int")
    got = [(r["targets"][0]["correct_option_index"], r["rejection_reason"]) for r in A.adapt_mcq(m).collect()]
    assert got == [(1, None), (2, None), (None, "no correct option"), (2, None), (0, "fewer than three options")]
    race = spark.createDataFrame([("same", "art", "q", ["x", "y", "z"], "B"), ("same", "art2", "q", ["x", "y", "z"], "A")], "id string, article string, question string, options array<string>, answer string")
    assert A.adapt("race", race).select("id").distinct().count() == 2
    with pytest.raises(KeyError):
        A.adapter_for("nothing")
    with pytest.raises(Exception, match="mcq: "):
        A.adapt("mcq", m, skip_invalid=False).collect()


def test_validation_codes(spark):
    t = "array<struct<question_type:string,question:string,answer:string,options:array<string>,correct_option_index:int,difficulty:string,marks:int>>"
    rows = [("1", "c" * 100, [("mcq", "q", "z", ["x", "X ", ""], 5, "easy", 1)]), ("2", "short", [("essay", "", "a", [], None, "odd", 0)]), ("2", "d" * 9000, [])]
    df = spark.createDataFrame(rows, f"id string, context string, targets {t}")
    got = {(r["example_id"], r["code"]) for r in Q.validate_dataset(df).collect()}
    assert {("1", "blank_option"), ("1", "repeated_option"), ("1", "index_out_of_range"), ("2", "context_too_short"), ("2", "unknown_type"), ("2", "empty_question"),
            ("2", "invalid_marks"), ("2", "unknown_difficulty"), ("2", "context_too_long"), ("2", "no_targets"), ("2", "duplicate_id")} <= got
    assert Q.drop_invalid(df, Q.validate_dataset(df)).count() == 0


def test_split_targets_give_the_rest_to_the_later():
    assert S.split_targets(30) == [27, 1, 2]
    assert S.split_targets(180) == [162, 9, 9]


def test_split_groups_like_the_rule(spark):
    import hashlib

    rng = random.Random(3)
    rows = [(i, f"g{rng.randrange(60)}") for i in range(180)]
    got = {r["id"]: r["split"] for r in S.split_groups(spark.createDataFrame(rows, "id int, k string").repartition(5), "k", 42).collect()}
    sizes = {k: sum(g == k for _, g in rows) for k in {g for _, g in rows}}
    aims, have, where = [162, 9, 9], [0, 0, 0], {}
    for k in sorted(sizes, key=lambda k: (hashlib.sha256(f"42\0{k}".encode()).hexdigest(), k)):
        lack = [(a - h) / a for a, h in zip(aims, have)]
        best = max(range(3), key=lambda i: (lack[i], -i))
        best = best if lack[best] > 0 else 0
        have[best] += sizes[k]
        where[k] = S.SPLITS[best]
    assert got == {i: where[g] for i, g in rows}
    df = S.split_groups(spark.createDataFrame(rows, "id int, k string"), "k", 42)
    assert S.leaked_keys(df, "k").count() == 0


def test_selection_guards(spark):
    df = spark.createDataFrame([(1,), (1,)], "id int")
    with pytest.raises(ValueError):
        S.select_hash(df, 0, 1)
    with pytest.raises(Exception, match="repeated id"):
        S.require_unique(df).collect()


def test_windows_tile_like_a_loop(spark):
    rows = [(n, 10) for n in range(1, 120)]
    got = Wi.tile_windows(spark.createDataFrame(rows, "n int, budget int"), "n", "budget", 4).collect()
    want = []
    for n, b in rows:
        at, k = 0, 0
        while True:
            want.append((n, k, at, min(at + b, n)))
            if at + b >= n:
                break
            at, k = at + 6, k + 1
    assert sorted((r["n"], r["window"], r["first"], r["last"]) for r in got) == sorted(want)


def test_alignment(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([("a", text, 8, 18), ("b", text, None, None), ("c", text, 24, 27)], "id string, t string, answer_start int, answer_end int")
    df = df.withColumn("offsets", Wi.token_offsets(F.col("t"))).withColumn("n", F.size("offsets")).withColumn("budget", F.lit(4))
    got = {(r["id"], r["window"]): (r["status"], r["start_token"], r["end_token"]) for r in Wi.align(Wi.tile_windows(df, "n", "budget", 2)).collect()}
    assert got[("a", 0)] == ("aligned", 2, 3) and got[("a", 1)] == ("aligned", 0, 1)
    assert got[("b", 0)][0] == "no_answer" and got[("c", 0)][0] == "outside" and got[("c", 1)] == ("aligned", 3, 3)


def test_labels_and_grounding(spark):
    df = spark.createDataFrame([(1, "cell wall cell wall nucleus", [], []), (2, "other", ["kept"], [])], "id int, text string, topics array<string>, concepts array<string>")
    got = {r["id"]: (r["topics"], r["concepts"]) for r in C.label_chunks(df).collect()}
    assert got == {1: (["cell", "wall", "nucleus"], ["cell wall"]), 2: (["kept"], [])}
    g = spark.createDataFrame([(("s", (0, 1)),), ((" ", (0, 1)),), (("s", None),), (None,)], "g struct<source_id:string,span:struct<a:int,b:int>>")
    assert [r["x"] for r in g.select(C.traceable(F.col("g")).alias("x")).collect()] == [True, False, False, False]


def test_prompts_and_json(spark):
    with pytest.raises(ValueError):
        P.check_template("{context}")
    with pytest.raises(ValueError):
        P.check_template("{context}{output_contract}{subject}")
    t = spark.createDataFrame([("q", [], None)], "question string, options array<string>, explanation string")
    t = t.select(F.struct(F.lit("mcq").alias("question_type"), "question", F.lit("a").alias("answer"), "options", F.lit(None).cast("int").alias("correct_option_index"), F.lit("easy").alias("difficulty"), F.lit(1).alias("marks"), "explanation").alias("t"))
    assert list(json.loads(t.select(P.target_json(F.col("t")).alias("j")).first()["j"])) == ["question_type", "question", "answer", "difficulty", "marks"]
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "z": 2}',), ("[1]",), ("{}",)], "j string")
    assert [r["problem"] for r in P.strict_decode(df, "j", "a int", ["a"], ["a"]).collect()] == [None, "unknown_keys", "not_an_object", "missing_keys"]
    pairs = spark.createDataFrame([(["x", "y", "z"], [(0, 1), (2, 0)])], "l array<string>, p array<struct<left_index:int,right_index:int>>")
    assert pairs.select(P.unpaired_items(F.col("l"), F.col("p")).alias("u")).first()["u"] == [1]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "b.json").write_text('{"data": [{"x": 3}, {"x": 4}], "version": "1"}')
    (tmp_path / "c.md").write_text("Intro\n\n# The **Cell**\n\n> quote [link](u) `code`\n\n```\ncode\n```\n---\n## Wall ##\n")
    (tmp_path / "d.txt").write_text("Hello  \r\n\r\n\r\n\r\nthere")
    assert [r["x"] for r in R.read_records(spark, str(tmp_path / "a.jsonl"), 1).collect()] == [1]
    assert sorted(r["x"] for r in R.read_source(spark, str(tmp_path / "b.json")).collect()) == [3, 4]
    md, tx = R.read_document(spark, str(tmp_path / "c.md")).first(), R.read_document(spark, str(tmp_path / "d.txt")).first()
    assert md["title"] == "The **Cell**" and [h["level"] for h in md["headings"]] == [1, 2] and "quote link code" in md["text"] and "#" not in md["text"]
    assert tx["text"] == "Hello\n\nthere" and tx["id"].startswith("doc-d-txt-")
    for bad, error in (("x.pdf", NotImplementedError), ("x.zip", ValueError)):
        with pytest.raises(error):
            R.source_type(bad)
    with pytest.raises(ValueError):
        R.read_records(spark, "x.csv")
    df = spark.createDataFrame([("1", "train"), ("2", "test")], "id string, split string")
    R.write_prepared(df, str(tmp_path / "out"))
    good, bad = R.read_prepared(spark, str(tmp_path / "out"), "train", "id string")
    assert [r["id"] for r in good.collect()] == ["1"] and bad.count() == 0


def test_order_of_input_does_not_matter(spark):
    sf = "/root/testdata/sf0.001"
    d = I.table(spark, sf, "documents").select("doc_id", "source", "text")
    for f in (lambda x: S.cap_per_source(x.select("doc_id", "source"), 3, 7, "source", "doc_id"), lambda x: C.topics(x, "doc_id")):
        assert sorted(map(tuple, f(d).collect())) == sorted(map(tuple, f(d.repartition(7, "text")).collect()))


def test_library_does_not_import_llm():
    from pathlib import Path

    home = Path(__file__).resolve().parents[1] / "quillmere"
    for p in home.rglob("*.py"):
        if "llm" not in p.relative_to(home).parts[0]:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M), p

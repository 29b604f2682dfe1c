"""Work that must not grow faster than the input, read off plans and long rows."""

import re

from pyspark.sql import functions as F

from quillmere.operators import adapters as A
from quillmere.operators import content as C
from quillmere.operators import features as Fe
from quillmere.operators import prepare as Pr
from quillmere.operators import quality as Q
from quillmere.operators import retrieval as Re


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_windows_of_a_long_context_carry_their_own_tokens_only(spark):
    words = [f"wörd{i}" for i in range(3_000)]
    rows = [(1, "who is it", " \n".join(words)), (2, "who", ""), (3, "who", None)]
    df = Fe.encode_windows(spark.createDataFrame(rows, "id int, question string, context string"), max_length=40, doc_stride=8)
    assert df.columns[:3] == ["id", "question", "context"]
    got = df.filter("id = 1").orderBy("window").collect()
    step, budget = 40 - 3 - 3 - 8, 40 - 3 - 3
    for r in got:
        own = words[r["window"] * step : r["window"] * step + budget]
        assert r["tokens"] == ["[CLS]", "who", "is", "it", "[SEP]", *own, "[SEP]"]
        assert [rows[0][2][o["s"] : o["e"]] for o in r["offsets"] if o] == own
    assert len(got) == -(-(3_000 - budget) // step) + 1 and [r["id"] for r in df.filter("id > 1").collect()] == [2]
    # no token is cut out of the whole context, and behind the explosion stand neither the context nor all its tokens
    plan = _plan(df.select("id", "window", F.size("tokens").alias("n")))
    above = plan[: plan.index("Generate explode")]
    assert "substring(" not in above and "context#" not in above and "__c#" not in above


def test_neighbours_are_tokenized_once(spark):
    df = spark.createDataFrame([(1, "red cars meet blue cars"), (2, ""), (3, None), (4, "cars")], "id int, text string")
    b = C.bigrams(df, "id")
    assert sorted((r["id"], r["term"]) for r in b.collect()) == [(1, "blue cars"), (1, "cars meet"), (1, "meet blue"), (1, "red cars")]
    # a filter that repeats the tokenization below the explosion made it run many times a text
    assert len(re.findall(r"translate\(", _plan(b))) == 1


def test_preparation_fingerprints_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(Pr, "_fingerprint", lambda f=Pr._fingerprint: made.append(1) or f())
    monkeypatch.setattr(Q, "example_fingerprint", lambda *a: made.append(1) or F.lit(None).cast("string"))
    long = lambda w: f"{w} " + "cars drive on roads " * 5
    rows = [("1", long("red")), ("2", long("RED")), ("3", long("blue")), ("3", long("aqua")), ("4", "short"), ("5", long("green")), ("6", long("the red")), ("7", long("white"))]
    s = spark.createDataFrame(rows, "id string, context string").select(
        "id", F.lit("t").alias("title"), "context", F.lit("what drives").alias("question"), F.struct(F.array(F.lit("cars")).alias("text"), F.array(F.lit(0)).alias("answer_start")).alias("answers")
    )
    p = Pr.prepare({"one": A.adapt("squad", s)}, Pr.Plan(seed=7, per_source=3, total=2))
    assert len(made) == 1
    stages = {r["stage"]: r["n"] for r in p.stages.collect()}
    assert stages == {"adapted": 8, "unique_ids": 7, "valid": 6, "deduplicated": 4, "capped_per_source": 3, "capped_total": 2}
    dropped = {r["id"]: r["reason"] for r in p.dropped.collect()}
    assert {k: v for k, v in dropped.items() if not v.endswith("cap")} == {"3": "duplicate_id", "4": "validation_error", "2": "duplicate_content", "6": "duplicate_content"}
    assert sorted(v for v in dropped.values() if v.endswith("cap")) in (["per_source_cap", "total_cap"], ["total_cap"])
    got = p.examples.collect()
    assert len(got) == 2 and "__fp" not in p.examples.columns and {r["id"] for r in got} <= {"1", "3", "5", "7"}
    assert all(r["context"] == long("aqua") for r in got if r["id"] == "3")


def test_repeats_of_a_null_id_leave_the_null_one(spark):
    rows = spark.createDataFrame([(None, "x"), ("a", "x"), ("b", "x"), ("c", None), ("d", None), ("e", "y")], "id string, __fp string")
    assert sorted(r["id"] for r in Pr._repeats(rows).collect()) == ["a", "b", "d"]


def test_the_index_tokenizes_before_it_sorts_by_range(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(Re, "numbered", lambda df, order, f=Re.numbered: plans.append(_plan(df)) or f(df, order))
    docs = spark.createDataFrame([(i, f"w{i % 7} common words w{i}") for i in range(50)], "id int, text string")
    Re.build_index(docs, f"file://{tmp_path}/index", block=8)
    # sorting by range runs what it sorts twice
    assert len(plans) == 1 and "translate(" not in plans[0]
    asked = spark.createDataFrame([(1, "w3 common"), (2, "w49")], "query int, text string")
    got = [tuple(r) for r in Re.search_index(spark, f"file://{tmp_path}/index", asked, 5).select("query", "id", "score", "rank").collect()]
    want = [tuple(r) for r in C.bm25_many(docs, asked, 5).select("query", "id", "score", "rank").collect()]
    assert sorted(got) == sorted(want) and len(got) == 6

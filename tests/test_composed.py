"""Preparation, features, question banks, runs, sources and registries against plain Python."""

import hashlib
import json
import math
import random
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from quillmere.functions import text as X
from quillmere.operators import adapters as A
from quillmere.operators import content as C
from quillmere.operators import features as Fe
from quillmere.operators import paper as P
from quillmere.operators import prepare as Pr
from quillmere.operators import quality as Q
from quillmere.operators import registry as G
from quillmere.operators import runs as R
from quillmere.operators import selection as S
from quillmere.operators import stats as St
from quillmere.operators import windows as Wi
from quillmere.plans import inputs as I
from quillmere.sources import readers as Rd
from quillmere.streaming.dedup import drop_repeats

SF = "/root/testdata/sf0.001"
EXAMPLE = "id string, context string, targets array<struct<question_type:string,question:string,answer:string,options:array<string>,correct_option_index:int,difficulty:string,marks:int,explanation:string>>, source string, topic string, grounding struct<char_start:int,char_end:int,excerpt:string>, group_key string"


def digest(seed, x):
    return hashlib.sha256(f"{seed}\0{x}".encode()).hexdigest()


def fold(groups, seed, ratios=(0.9, 0.05, 0.05)):
    """Splits of groups {key: n}, one after the other."""
    aims, have, out = S.split_targets(sum(groups.values()), ratios), [0, 0, 0], {}
    for k in sorted(groups, key=lambda k: digest(seed, k)):
        lack = [(a - h) / a if a else 0.0 for a, h in zip(aims, have, strict=True)]
        best = max(range(3), key=lambda i: (lack[i], -i))
        best = 0 if lack[best] <= 0 else best
        have[best] += groups[k]
        out[k] = S.SPLITS[best]
    return out


def example(i, context, question="What is it?", answer="thing", source="s", key=None):
    return (str(i), context, [("short_answer", question, answer, [], None, "easy", 1, None)], source, None, None, key)


def test_prepare(spark):
    long = [f"The context number {i} about some thing that is long enough to be taken, with words {i * 7} and {i * 13}." for i in range(60)]
    rows = [example(i, c, source=f"s{i % 2}", key=f"k{i % 17}") for i, c in enumerate(long)]
    rows += [example(0, long[0], source="s0", key="k0"), example(100, "too short"), example(101, long[5], source="s1"), example(102, long[6], answer=" ")]
    df = spark.createDataFrame(rows, EXAMPLE)
    plan = Pr.Plan(seed=3, shuffle_seed=5, per_source=25, total=40)
    got = Pr.prepare({"a": df.filter("source = 's0'"), "b": df.filter("source <> 's0'")}, plan)
    assert [(r["stage"], r["n"]) for r in got.stages.orderBy("place").collect()] == [("adapted", 64), ("unique_ids", 63), ("valid", 61), ("deduplicated", 60), ("capped_per_source", 50), ("capped_total", 40)]
    # 101 repeats the content of 5 with a greater id (as text: "101" < "5"), so 5 goes
    valid = {r[0]: r for r in rows if r[0] not in ("100", "102")}
    by_fp = {}
    for i in sorted(valid):
        by_fp.setdefault(valid[i][1], i)
    kept = sorted(by_fp.values())
    per = [i for s in ("s0", "s1") for i in sorted((k for k in kept if valid[k][3] == s), key=lambda k: (digest(3, k), k))[:25]]
    last = sorted(per, key=lambda k: (digest(3, k), k))[:40]
    out = got.examples.collect()
    assert {r["id"] for r in out} == set(last)
    key = lambda i: valid[i][6] or "ctx:" + hashlib.sha256(" ".join(w for w in re.sub(r"[^a-z0-9 ]", "", valid[i][1].lower()).split() if w not in ("a", "an", "the")).encode()).hexdigest()[:12]
    split = fold(Counter(key(i) for i in last), 3)
    assert {r["id"]: r["split"] for r in out} == {i: split[key(i)] for i in last}
    for s in S.SPLITS:
        mine = sorted((r["position"], r["id"]) for r in out if r["split"] == s)
        assert [i for _, i in mine] == sorted((i for _, i in mine), key=lambda k: (digest(5, k), k)) and [p for p, _ in mine] == list(range(len(mine)))
    dropped = {r["id"]: r["reason"] for r in got.dropped.collect()}
    assert len(dropped) == 20 and dropped["0"] == "duplicate_id" and dropped["100"] == dropped["102"] == "validation_error" and dropped["5"] == "duplicate_content"
    with pytest.raises(ValueError, match="adapted 1"):
        Pr.prepare({"a": df.filter("id = '100'")})


def test_split_groups_null_and_number_keys(spark):
    rows = [(i, i % 23 if i % 5 else None) for i in range(200)]
    got = S.split_groups(spark.createDataFrame(rows, "id int, k int"), "k", 9).collect()
    want = fold(Counter(str(k) if k is not None else "" for _, k in rows), 9)
    assert {(r["id"], r["split"]) for r in got} == {(i, want[str(k) if k is not None else ""]) for i, k in rows}
    assert S.split_groups(spark.createDataFrame([], "id int, k string"), "k", 9).count() == 0


def test_grouping_keys(spark):
    df = spark.createDataFrame([("1", "Some text", "own"), ("2", "Some text", " "), ("3", "Some text", None)], "id string, context string, group_key string")
    get = lambda by: [r["k"] for r in df.select("id", S.grouping_key(by).alias("k")).orderBy("id").collect()]
    assert get("example") == ["id:1", "id:2", "id:3"] and get("context")[0] == "own" and get("context")[1] == get("context")[2]
    assert get("topic")[0] == "own" and get("topic")[1] == " "
    with pytest.raises(ValueError):
        S.grouping_key("letter")


def test_mcq_rules(spark):
    t = lambda options, at, answer: [("mcq", "Q?", answer, options, at, "easy", 1, None)]
    c = "c" * 80
    rows = [("1", c, t(["Paris", "Rome", "Oslo"], 0, "  paris "), "s", None, None, None), ("2", c, t(["a", "", " "], 0, "a"), "s", None, None, None), ("3", c, t(["a", "b", "A "], 0, "\n\t"), "s", None, None, None)]
    got = defaultdict(set)
    for r in Q.validate_dataset(spark.createDataFrame(rows, EXAMPLE)).filter("target_index = 0").collect():
        got[r["example_id"]].add(r["code"])
    assert dict(got) == {"2": {"blank_option"}, "3": {"repeated_option", "empty_answer"}}
    empty = Q.validate_dataset(spark.createDataFrame([], EXAMPLE)).collect()
    assert [(r["example_id"], r["code"], r["severity"]) for r in empty] == [(None, "empty_dataset", "error")]


def test_schema_checks(spark):
    s = I.squad(spark, SF)
    assert Q.check_schema(s) is s
    for bad in (s.drop("title"), s.withColumn("answers", F.lit("x")), s.filter("false")):
        with pytest.raises(ValueError):
            Q.check_schema(bad)
    with pytest.raises(ValueError, match="first 3"):
        Q.require_answers(spark.createDataFrame([(1, (["a"],)), (2, ([],)), (9, (["b"],))], "id int, answers struct<text:array<string>>"), sample_size=3)
    assert Q.require_answers(spark.createDataFrame([(1, (["a"],)), (2, ([],))], "id int, answers struct<text:array<string>>"), sample_size=1).count() == 2


def test_windows_hold_their_tokens(spark):
    s = I.squad(spark, SF)
    rows = Fe.encode_windows(s, max_length=40, doc_stride=8, max_question=6).select("id", "window", "question", "context", "tokens", "offsets", "sequence_ids", "context_mask", "char_start", "char_end").collect()
    for r in rows:
        assert len(r["tokens"]) == len(r["offsets"]) == len(r["sequence_ids"]) == len(r["context_mask"]) <= 40
        for t, o, q in zip(r["tokens"], r["offsets"], r["sequence_ids"], strict=True):
            assert (o is None) == (q != 1) and (o is None or r["context"][o["s"] : o["e"]] == t)
        assert r["tokens"][0] == "[CLS]" and r["tokens"][-1] == "[SEP]" and len(r["question"].split()) <= 6
    by = defaultdict(list)
    for r in rows:
        by[r["id"]].append(r)
    for i, c in {r["id"]: r["context"] for r in rows}.items():
        seen = {o["s"] for r in by[i] for o in r["offsets"] if o}
        assert seen == {m.start() for m in re.finditer(r"\S+", c)}
    bare = spark.createDataFrame([("1", "t", "", "one two", ([], []))], "id string, title string, context string, question string, answers struct<text:array<string>,answer_start:array<int>>")
    only = Fe.validation_features(bare).first()
    assert only["tokens"] == ["[CLS]", "one", "two", "[SEP]", "[SEP]"] and only["status"] == "no_answer" and only["start_position"] == 0
    with pytest.raises(Exception, match="no room"):
        Fe.encode_windows(bare, max_length=5).collect()


def test_labels_point_at_the_answer(spark):
    s = I.squad(spark, SF)
    gold = {r["id"]: r["a"] for r in s.select("id", F.get("answers.text", F.lit(0)).alias("a")).collect()}
    rows = Fe.validation_features(s, max_length=40, doc_stride=8).filter("status = 'aligned'").collect()
    assert rows and all(gold[r["id"]] in " ".join(r["tokens"][r["start_position"] : r["end_position"] + 1]) for r in rows)


def test_answers_without_spans(spark):
    e = spark.createDataFrame([(1, " one two ", ["two"]), (2, "x", ["x"]), (3, "", [])], "id int, context string, golds array<string>")
    f = spark.createDataFrame([(1, 0, [None, (0, 4), (4, 9)]), (2, 0, [None])], "id int, window int, offsets array<struct<s:int,e:int>>")
    w = spark.createDataFrame([(1, 0, [9.0, 1.0, 2.0], [9.0, 1.0, 3.0], [0, 1, 1]), (2, 0, [1.0], [1.0], [0])], "id int, window int, start_logits array<double>, end_logits array<double>, context_mask array<int>")
    got = {r["id"]: r for r in Wi.answers(e, f, Wi.decode(w, 3, 3)).collect()}
    assert got[1]["answer"] == "two" and (got[1]["char_start"], got[1]["char_end"]) == (5, 8) and [s["text"] for s in got[1]["n_best"]] == ["two", "one two", "one"]
    assert (got[2]["has_answer"], got[2]["answer"], got[2]["n_windows"]) == (False, "", 1) and (got[3]["has_answer"], got[3]["n_windows"], got[3]["n_best"]) == (False, 0, [])
    one = Wi.evaluate(e, f, w, 3, 3).first()
    assert one["examples_without_answer"] == 2 and one["total_examples"] == 3 and round(one["exact_match"], 3) == 33.333


def test_decoding_equals_a_plain_loop(spark):
    rng = random.Random(11)
    rows = [(i, w, [float(rng.randint(-6, 6)) / 2 for _ in range(n)], [float(rng.randint(-6, 6)) / 2 for _ in range(n)], [rng.choice((0, 1, 1)) for _ in range(n)]) for i in range(40) for w, n in enumerate(rng.choices((0, 1, 7, 60), k=rng.randint(1, 4)))]
    kind = "id int, window int, start_logits array<double>, end_logits array<double>, context_mask array<int>"
    df = spark.createDataFrame(rows, kind).repartition(3)
    got = {}
    for r in sorted(Wi.decode(df, 6, 9, 10).collect(), key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append((r["window"], r["start"], r["end"], round(r["probability"], 12)))
    want = {}
    for i in range(40):
        pool = []
        for _, w, s, e, m in (r for r in rows if r[0] == i):
            best = lambda x: sorted(range(len(x)), key=lambda p: (-x[p], p))[:6]
            pool += [(s[a] + e[b], w, a, k, b) for a in best(s) for k, b in enumerate(best(e)) if m[a] == m[b] == 1 and 0 <= b - a < 9]
        pool.sort(key=lambda x: (-x[0], *x[1:]))
        z = sum(math.exp(x[0] - pool[0][0]) for x in pool) if pool else 0
        if pool:
            want[i] = [(w, a, b, round(math.exp(x - pool[0][0]) / z, 12)) for x, w, a, _, b in pool[:10]]
    assert got == want
    plan = df._sc._jvm.PythonSQLUtils.explainString(Wi.candidates(df, 6, 9)._jdf.queryExecution(), "simple")
    assert "Exchange hash" not in plan and "Window" not in plan
    with pytest.raises(Exception, match="differ in length"):
        Wi.decode(spark.createDataFrame([(1, 0, [1.0], [1.0, 2.0], [1])], kind)).collect()
    with pytest.raises(ValueError):
        Wi.decode(df, 0)
    assert Wi.decode(df.limit(0)).collect() == []


def test_logits_from_a_model(spark):
    f = spark.createDataFrame([(i, 0, ["a"] * i) for i in range(1, 9)], "id int, window int, tokens array<string>")
    forward = lambda x: ([[float(k) for k in range(len(t))] for t in x["tokens"]], [[0.5] * len(t) for t in x["tokens"]])
    got = Wi.collect_logits(f, forward, ["tokens"], 3).collect()
    assert {r["id"]: r["start_logits"] for r in got} == {i: [float(k) for k in range(i)] for i in range(1, 9)}


def test_tokens_as_offsets(spark):
    df = spark.createDataFrame([("  a bc\n d ",), (None,), ("",)], "t string")
    got = [r["o"] for r in df.select(Wi.token_offsets(F.col("t")).alias("o")).collect()]
    assert [[tuple(x) for x in g] if g is not None else None for g in got] == [[(2, 3), (4, 6), (8, 9)], None, []]


def test_assembly(spark):
    bank = [(i, "mcq" if i % 2 else "short_answer", None if i % 7 == 0 else f"t{i % 3}", ("easy", "medium", "hard")[i % 3], 1 + i % 4, i) for i in range(120)]
    df = spark.createDataFrame(bank, "id int, question_type string, topic string, difficulty string, marks int, pos int").repartition(7)
    plan = [(0, "mcq", 5, "easy", None), (1, "mcq", 50, "easy", ["t1", "t2"]), (2, "short_answer", 9, None, []), (3, "mcq", 40, "hard", None)]
    p = spark.createDataFrame([(a, b, c, 1, d, e) for a, b, c, d, e in plan], "section_index int, question_type string, count int, marks_each int, difficulty string, topics array<string>")
    want, taken = set(), set()
    for s, kind, n, level, topics in plan:
        fit = [(bool(level) and r[3] != level, r[5], r[0]) for r in bank if r[1] == kind and r[0] not in taken and (not topics or r[2] is None or r[2] in topics)]
        for k, (relaxed, _, i) in enumerate(sorted(fit)[:n]):
            want.add((s, k, i, relaxed))
            taken.add(i)
    paper = P.assemble(df, p)
    assert {(r["section_index"], r["position"], r["id"], r["relaxed"]) for r in paper.collect()} == want
    with pytest.raises(ValueError, match="section 1: "):
        P.require_filled(paper, p)
    assert P.assemble(df.filter("false"), p).count() == 0
    codes = Counter(r["code"] for r in P.paper_issues(P.assemble(df.filter("false"), p), p, 5).collect())
    assert codes["empty_paper"] == 1 and codes["empty_section"] == 4 and codes["blueprint_count_mismatch"] == 2


def test_blueprints():
    fine = [{"question_type": "mcq", "count": 2, "marks_each": 5, "topics": ["a"]}]
    assert P.check_blueprint("t", "s", 10, 60, fine, ["a", "b"]) is fine
    for bad in (("", "s", 10, 60, fine), ("t", "s", 11, 60, fine), ("t", "s", 10, 0, fine), ("t", "s", 10, 60, []), ("t", "s", 10, 60, fine, ["b"])):
        with pytest.raises(ValueError):
            P.check_blueprint(*bad)


def test_decoding_of_targets(spark):
    good = {"question_type": "mcq", "question": "q", "answer": "a", "difficulty": "easy", "marks": 2}
    rows = [good, {**good, "marks": "two"}, {**good, "difficulty": "odd"}, {**good, "more": 1}, {"question": "q"}, [1], {**good, "options": ["a", "b"]}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(9, "{no"), (10, None)], "id int, j string")
    got = {r["id"]: r["problem"] for r in P.decode_targets(df, "j").collect()}
    assert got == {0: None, 1: "wrong_type", 2: "unknown_value", 3: "unknown_keys", 4: "missing_keys", 5: "not_an_object", 6: None, 9: "not_an_object", 10: "not_an_object"}
    t = A.target("mcq", F.lit("q"), F.lit("a"), "easy", 2)
    one, two = spark.range(1).select(P.completion(F.array(t)), P.completion(F.array(t, t))).first()
    assert json.loads(one) == good and json.loads(two) == [good, good]


def test_statistics(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "x"), (4, None)], "id int, k string")
    assert {(r["dimension"], r["value"], r["n"]) for r in St.counts_by(df, "k").collect()} == {("k", None, 2), ("k", "x", 2)}
    names = spark.createDataFrame([(f"n{i:03}", i) for i in range(300)], "name string, v int").repartition(9)
    assert sorted((r["__n"], r["name"]) for r in St.numbered(names, ["name"]).collect()) == [(i, f"n{i:03}") for i in range(300)]
    words = spark.createDataFrame([(["b", "a", "b", "b"],), ([],), (None,)], "w array<string>").withColumn("s", F.array_sort("w"))
    assert [r["c"] and [(x["n"], x["term"]) for x in r["c"]] for r in X.counted(words, "s", "c").collect()] == [[(1, "a"), (3, "b")], [], None]


def test_runs():
    configs = {"base": {"model": {"size": 2, "name": "b"}, "seed": 1}, "big": {"extends": "base", "model": {"size": 9}}, "loop": {"extends": "loop"}, "odd": {"modle": 1}}
    known = {"model": {"size": 0, "name": "", "rate": 0.1}, "seed": 0}
    assert R.compose(configs, "big", known, ("model.rate=0.5", "model.name=x y")) == {"model": {"size": 9, "name": "x y", "rate": 0.5}, "seed": 1}
    for name, sets in (("loop", ()), ("odd", ()), ("big", ("model.more=1",)), ("none", ()), ("big", ("seed",))):
        with pytest.raises((KeyError, ValueError)):
            R.compose(configs, name, known, sets)
    assert R.config_hash({"a": 1, "b": [2]}) == R.config_hash({"b": [2], "a": 1}) and re.fullmatch(r"\d{8}T\d{6}Z", R.utc_now())


@dataclass
class Inner:
    n: int
    rates: list[float]


@dataclass
class Outer:
    name: str
    inner: Inner
    note: str | None
    counts: dict[str, int]


def test_records():
    o = Outer("x", Inner(3, [0.5, 1.0]), None, {"a": 1})
    assert R.from_record(Outer, R.to_record(o)) == o
    for bad in ({"name": "x"}, {**json.loads(R.to_record(o)), "more": 1}, {**json.loads(R.to_record(o)), "counts": {"a": "b"}}, [1]):
        with pytest.raises(ValueError):
            R.from_record(Outer, json.dumps(bad))


def test_prepared_folders(spark, tmp_path):
    df = spark.createDataFrame([("1", "train"), ("2", "test")], "id string, split string")
    place = Rd.write_report(str(tmp_path), "exp", "abc123", {"kept": 2}, df, spark)
    assert json.loads((tmp_path / "exp-abc123" / "dataset.json").read_text())["kept"] == 2
    found = Rd.discover(spark, str(tmp_path))
    assert [(f["experiment"], f["fingerprint"], f["splits"]) for f in found] == [("exp", "abc123", ["test", "train"])]
    Rd.write_report(str(tmp_path), "exp", "def456", {}, df, spark)
    with pytest.warns(UserWarning, match="2 prepared"):
        Rd.resolve_prepared(spark, str(tmp_path))
    assert Rd.resolve_prepared(spark, str(tmp_path), fingerprint="abc123")["directory"].endswith("exp-abc123") and Rd.resolve_prepared(spark, "", place)["fingerprint"] == "abc123"
    with pytest.raises(ValueError):
        Rd.resolve_prepared(spark, str(tmp_path), fingerprint="none")
    part = next((tmp_path / "exp-abc123" / "split=train").glob("*.json"))
    (part.parent / ("." + part.name + ".crc")).unlink(missing_ok=True)
    part.write_text('{"id": "1"}\n\n{broken\n')
    good, bad = Rd.read_prepared(spark, place, "train", "id string")
    assert [r["id"] for r in good.collect()] == ["1"] and [(r["line"], r["text"]) for r in bad.collect()] == [(3, "{broken")]


def test_question_rows_from_exports(spark, tmp_path):
    s = I.squad(spark, SF)
    s.write.parquet(str(tmp_path / "v"))
    with pytest.warns(UserWarning, match="has 200 rows"):
        got = Rd.read_squad_all(spark, {"validation": str(tmp_path / "v")}, cap=5)["validation"]
    ids = [r["id"] for r in s.select("id").collect()]
    assert sorted(r["id"] for r in got.collect()) == sorted(sorted(ids, key=lambda i: (digest(42, i), i))[:5])
    plan = Rd.plan_sources([{"source": "a"}, {"source": "b", "path": "x.json"}], {"a": {"limit": 3}, "b": {}})
    assert [(p["how"], p.get("limit")) for p in plan] == [("missing", 3), ("file", None)]
    with pytest.raises(KeyError):
        Rd.plan_sources([{"source": "c"}], {})


def test_registries(spark):
    assert G.find(G.DATASET_SPLITTERS, "groups") is S.split_groups
    with pytest.raises(KeyError):
        G.find(G.RETRIEVERS, "none")
    with pytest.raises(KeyError):
        G.register(G.CHUNKERS, "paragraphs", C.chunk_documents)
    p = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "id long, text string")
    got = G.generate_questions(p, lambda rows: [{"id": r["id"], "question": r["text"] + "?"} for r in rows if r["id"] % 2], ["id", "text"], "id long, question string")
    assert {(r["id"], r["question"]) for r in got.collect()} == {(i, f"text {i}?") for i in range(1, 40, 2)}


def test_retrieval_of_one_query_and_of_many(spark):
    d = spark.createDataFrame([(1, "cats and dogs"), (2, "cats cats"), (3, "birds"), (4, ""), (5, None)], "id int, text string")
    one = [(r["id"], r["rank"]) for r in C.bm25(d, "cats cats birds", 5).orderBy("rank").collect()]
    many = C.bm25_many(d, spark.createDataFrame([("x", "cats cats birds"), ("y", "dogs"), ("z", "none")], "query string, text string"), 5).collect()
    assert [(r["id"], r["rank"]) for r in sorted((r for r in many if r["query"] == "x"), key=lambda r: r["rank"])] == one
    assert {r["query"] for r in many} == {"x", "y"} and one[0][0] == 3


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("2024-01-01 00:00:00", "The cat."), ("2024-01-01 00:01:00", "cat"), ("2024-01-01 00:02:00", "dog")], "at string, text string").selectExpr("timestamp(at) as at", "text").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, text string").parquet(str(tmp_path / "in"))
    q = drop_repeats(stream, "at", "1 hour").writeStream.format("memory").queryName("repeats_seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("repeats_seen").count() == 2

"""Queries for the operators that are made of others: preparation, features, evaluation, question banks, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import adapters as A
from ..operators import content as C
from ..operators import features as Fe
from ..operators import metrics as M
from ..operators import paper as P
from ..operators import prepare as Pr
from ..operators import quality as Q
from ..operators import runs as R
from ..operators import windows as Wi
from ..sources import readers as Rd
from . import inputs as I
from .queries import _CAND, _CT, _ISSUES, _PAPER, CHUNKS, CTX, EXAMPLE_FP, NORM, lengths, plan, query

# ---- quality


_OPTS = "o AS (SELECT list(r_name ORDER BY r_regionkey) AS o FROM region), n AS (SELECT n_nationkey AS k, CAST(n_nationkey AS VARCHAR) AS example_id FROM nation)"


def damaged_mcq(spark, sf_dir) -> DataFrame:
    """Nations as multiple-choice examples; each remainder by 6 of the key has another flaw, 0 only looks like one."""
    m = A.adapter_for("mcq")(I.mcq(spark, sf_dir)).withColumn("t", F.get("targets", F.lit(0))).withColumn("k", F.col("id").cast("int") % 6)
    k, t = F.col("k"), F.col("t")
    two = F.slice(t["options"], 1, 2)
    options = F.when(k == 2, F.concat(t["options"], F.array(F.lower(F.get(t["options"], F.lit(0)))))).when(k == 3, F.concat(t["options"], F.array(F.lit(""), F.lit(" ")))).when(k == 4, two).otherwise(t["options"])
    answer = F.when(k == 0, F.concat(F.lit(" "), F.lower(t["answer"]))).when(k == 5, "Atlantis").when(k == 4, F.get(two, F.lit(0))).otherwise(t["answer"])
    index = F.when(k == 1, 9).when(k == 4, 0).otherwise(t["correct_option_index"])
    target = F.struct(t["question_type"].alias("question_type"), t["question"].alias("question"), answer.alias("answer"), options.alias("options"), index.alias("correct_option_index"), t["difficulty"].alias("difficulty"), F.when(k == 4, 0).otherwise(t["marks"]).alias("marks"), t["explanation"].alias("explanation"))
    return m.withColumn("targets", F.array(target)).drop("t", "k")


@query(f"WITH {_OPTS}, c(r, code) AS (VALUES (1, 'index_out_of_range'), (2, 'repeated_option'), (3, 'blank_option'), (4, 'too_few_options'), (4, 'invalid_marks'), (5, 'answer_not_option')) SELECT example_id, code FROM n JOIN c ON k % 6 = r")
def validate_mcq(spark, sf_dir):
    """Rules for options and for marks."""
    return Q.validate_targets(damaged_mcq(spark, sf_dir)).select("example_id", "code")


@query(f"WITH {_OPTS} SELECT example_id AS id FROM n WHERE k % 6 = 0")
def drop_invalid_mcq(spark, sf_dir):
    """Only flaws that are errors drop an example: an answer that differs in case and blanks is none."""
    m = damaged_mcq(spark, sf_dir).withColumn("context", F.rpad("context", 70, "x"))
    return Q.drop_invalid(m, Q.validate_targets(m)).select("id")


@query(f"WITH {I.SQUAD}, f AS (SELECT * FROM squad ORDER BY id LIMIT 2000) SELECT 'all' AS rows_of, NOT EXISTS (SELECT 1 FROM f WHERE answer = '') AS passes UNION ALL SELECT 'answered', true UNION ALL SELECT 'bare', NOT EXISTS (SELECT 1 FROM squad WHERE answer = '')")
def check_v1(spark, sf_dir):
    """Which rows pass the check of answers: all, those with an answer, those without."""
    rows = Q.check_schema(I.squad(spark, sf_dir), "documents")
    bare = F.size("answers.text") <= 0

    def passes(some: DataFrame) -> bool:
        try:
            Q.require_answers(some, sample_size=2000)
        except ValueError:
            return False
        return True

    found = [(name, passes(some)) for name, some in (("all", rows), ("answered", rows.filter(~bare)), ("bare", rows.filter(bare)))]
    return spark.createDataFrame(found, "rows_of string, passes boolean")


@query(
    f"WITH {I.SQUAD}, c AS (SELECT id, CASE WHEN answer = '' THEN 'no_answer' WHEN CAST(id AS BIGINT) % 11 = 0 THEN CASE WHEN substr(context, answer_start + 2, length(answer)) = answer THEN 'exact' WHEN trim(substr(context, answer_start + 2, length(answer)), ' ' || chr(10)) = answer THEN 'whitespace_only' ELSE 'mismatch' END ELSE 'exact' END AS c FROM squad)"
    " SELECT count(*) AS checked, count(*) FILTER (c = 'exact') AS exact, count(*) FILTER (c = 'mismatch') AS mismatch, count(*) FILTER (c = 'no_answer') AS no_answer, round(count(*) FILTER (c = 'exact') / count(*) FILTER (c <> 'no_answer'), 6) AS exact_rate,"
    " (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM c WHERE c = 'mismatch' ORDER BY id LIMIT 5)) AS samples FROM c"
)
def offset_report(spark, sf_dir):
    """Answers, some of them moved by one place."""
    moved = F.get("answers.answer_start", F.lit(0)) + F.when(F.col("id").cast("long") % 11 == 0, 1).otherwise(0)
    s = I.squad(spark, sf_dir).select("id", "context", moved.alias("start"), F.get("answers.text", F.lit(0)).alias("answer"))
    return Q.offset_report(s).select("checked", "exact", "mismatch", "no_answer", "exact_rate", F.array_join("samples", ",").alias("samples"))


@query(
    f"WITH d AS (SELECT source, {CTX} AS k, CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'validation' ELSE 'other' END AS split, n_chars % 50 AS t, n_chars > 2500 AS cut FROM documents)"
    " SELECT 'leakage' AS finding, k AS detail FROM d GROUP BY k HAVING count(DISTINCT split) > 1 UNION ALL SELECT DISTINCT 'source_missing', s.split || '/' || e.source FROM (SELECT DISTINCT split FROM d WHERE split <> 'train') s, (SELECT DISTINCT source FROM d WHERE split = 'train') e"
    " WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.split = s.split AND x.source = e.source) UNION ALL SELECT 'empty_split', 'test' UNION ALL SELECT 'zero_tokens', CAST(count(*) AS VARCHAR) FROM d WHERE t = 0 HAVING count(*) > 0"
    " UNION ALL SELECT 'truncation', split FROM d GROUP BY split HAVING avg(CASE WHEN cut THEN 1.0 ELSE 0.0 END) > 0.01"
)
def audit_dataset(spark, sf_dir):
    split = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "fr", "validation").otherwise("other")
    d = I.table(spark, sf_dir, "documents").select("source", X.context_fingerprint(F.col("text")).alias("k"), split.alias("split"), (F.col("n_chars") % 50).alias("n_tokens"), (F.col("n_chars") > 2500).alias("truncated"))
    return Q.audit_dataset(d, "k")


# ---- preparation


def adapted(spark, sf_dir) -> dict[str, DataFrame]:
    """Question rows as two sources, the second of which repeats every ninth row of the first."""
    s = I.squad(spark, sf_dir)
    # filtered before it is adapted, so that only these rows' texts are looked at
    return {"first": A.adapt("squad", s), "again": A.adapt("squad", s.filter(F.col("id").cast("long") % 9 == 0))}


PLAN = Pr.Plan(seed=7, per_source=800, total=600)
_ADAPTED = f"{I.SQUAD}, {_ISSUES}, v AS (SELECT * FROM ex WHERE id NOT IN (SELECT example_id FROM issues WHERE severity = 'error')), u AS (SELECT min(id) AS id FROM v GROUP BY {EXAMPLE_FP})"
_KEPT = f"{_ADAPTED}, n AS (SELECT count(*) AS n FROM u)"


@query(
    f"WITH {_KEPT}, s AS (SELECT 0 AS place, 'adapted' AS stage, (SELECT count(*) FROM ex) + (SELECT count(*) FROM ex WHERE CAST(id AS BIGINT) % 9 = 0) AS n UNION ALL SELECT 1, 'unique_ids', (SELECT count(*) FROM ex) UNION ALL SELECT 2, 'valid', (SELECT count(*) FROM v)"
    " UNION ALL SELECT 3, 'deduplicated', n FROM n UNION ALL SELECT 4, 'capped_per_source', least(n, 800) FROM n UNION ALL SELECT 5, 'capped_total', least(n, 600) FROM n) SELECT stage, CAST(n AS BIGINT) AS n FROM s"
)
def prepare(spark, sf_dir):
    """How many examples each stage of the whole preparation leaves."""
    return Pr.prepare(adapted(spark, sf_dir), PLAN).stages.select("stage", "n")


@query(f"WITH {I.SQUAD} SELECT id, 'duplicate_id' AS reason FROM squad WHERE answer <> '' AND CAST(id AS BIGINT) % 9 = 0 ORDER BY id LIMIT 20")
def drop_samples(spark, sf_dir):
    return Pr.prepare(adapted(spark, sf_dir), PLAN).dropped


@query(f"WITH {_ADAPTED}, p AS (SELECT id FROM u ORDER BY sha256('7' || chr(0) || id), id LIMIT 800), q AS (SELECT id FROM p ORDER BY sha256('7' || chr(0) || id), id LIMIT 600) SELECT id FROM q")
def prepare_kept(spark, sf_dir):
    return Pr.prepare(adapted(spark, sf_dir), PLAN).examples.select("id")


@query()
def prepare_examples(spark, sf_dir):
    """The prepared examples with split and position."""
    return Pr.prepare(adapted(spark, sf_dir), PLAN).examples.select("id", "split", "position")


@query(
    "WITH t AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1) SELECT 'fingerprint' AS name, CAST(NULL AS BOOLEAN) AS passed UNION ALL SELECT 'train_examples', sum(n) = 100 FROM t"
    " UNION ALL SELECT 'source ' || coalesce(source, s), coalesce(n, 0) = coalesce(m, 0) FROM t FULL JOIN (VALUES ('nowhere', 3)) v(s, m) ON source = s"
)
def preflight(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents")
    t = A.target("short_answer", F.lit("q"), F.lit("a"), "easy", 1)
    rows = d.select("source", F.col("text").alias("context"), F.array(t).alias("targets"), F.when(F.col("lang") == "en", "train").otherwise("test").alias("split"))
    return Pr.preflight(rows, expect_sources={"nowhere": 3}, expect_train=100).select("name", "passed")


# ---- features

#: Tokens of contexts with their places, from what stands between them; eight words of question, or fewer.
_OFF = (
    "p AS (SELECT id, question, answer, answer_start, string_split_regex(context, '[\\s]+') AS raw, [x FOR x IN string_split_regex(context, '\\s+') IF x <> ''] AS t, [x FOR x IN regexp_extract_all(context, '\\s+')] AS sep, context FROM squad),"
    " l AS (SELECT *, CASE WHEN raw[1] = '' THEN sep ELSE list_concat([''], sep) END AS s FROM p),"
    " o AS (SELECT id, i, sum(length(s[i])) OVER w + coalesce(sum(length(t[i])) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, length(t[i]) AS n FROM l, unnest(range(1, len(t) + 1)) u(i) WINDOW w AS (PARTITION BY id ORDER BY i)),"
    " off AS (SELECT id, CAST(i - 1 AS BIGINT) AS i, CAST(b AS BIGINT) AS b, CAST(b + n AS BIGINT) AS e FROM o),"
    " q AS (SELECT id, answer, answer_start, len(t) AS n, len([x FOR x IN string_split_regex(question, '\\s+') IF x <> '']) AS nq FROM l)"
)


def _windows(budget: str, stride: int) -> str:
    step = f"({budget} - least({stride}, {budget} - 1))"
    return (
        f"w AS (SELECT id, answer, answer_start, n, nq, w AS \"window\", w * {step} AS first, least(w * {step} + {budget}, n) AS last FROM q, unnest(range(CAST(CASE WHEN n <= {budget} THEN 1 ELSE ceil((n - {budget}) / CAST({step} AS DOUBLE)) + 1 END AS BIGINT))) u(w)),"
        " a AS (SELECT w.*, f.b AS low, g.e AS high FROM w LEFT JOIN off f ON f.id = w.id AND f.i = w.first AND w.last > w.first LEFT JOIN off g ON g.id = w.id AND g.i = w.last - 1 AND w.last > w.first),"
        " s AS (SELECT *, CASE WHEN answer = '' THEN 'no_answer' WHEN last <= first THEN 'empty_window' WHEN low > answer_start OR high < answer_start + length(answer) THEN 'outside' ELSE 'aligned' END AS status FROM a),"
        " al AS (SELECT s.*, (SELECT max(o.i) FROM off o WHERE o.id = s.id AND o.i >= s.first AND o.i < s.last AND o.b <= s.answer_start) - first AS st, (SELECT min(o.i) FROM off o WHERE o.id = s.id AND o.i >= s.first AND o.i < s.last AND o.e >= s.answer_start + length(s.answer)) - first AS en FROM s)"
    )


_W64 = _windows("(61 - nq)", 16)
_LEN = {"max_length": 64, "doc_stride": 16, "max_question": 10}


@query(f"WITH {I.SQUAD}, {_OFF}, {_W64} SELECT id, CAST(\"window\" AS INTEGER) AS \"window\", CAST(nq + 3 + last - first AS BIGINT) AS n_tokens, CAST(last - first AS BIGINT) AS n_context, coalesce(low, 0) AS char_start, coalesce(high, 0) AS char_end FROM al")
def encode_windows(spark, sf_dir):
    w = Fe.encode_windows(I.squad(spark, sf_dir), **_LEN)
    n = F.aggregate("context_mask", F.lit(0), lambda a, x: a + x)
    return w.select("id", "window", F.size("tokens").cast("long").alias("n_tokens"), n.cast("long").alias("n_context"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query(f"WITH {I.SQUAD}, {_OFF}, {_W64} SELECT id, CAST(\"window\" AS INTEGER) AS \"window\", status, CAST(CASE WHEN status = 'aligned' THEN st + nq + 2 ELSE 0 END AS INTEGER) AS start_position, CAST(CASE WHEN status = 'aligned' THEN en + nq + 2 ELSE 0 END AS INTEGER) AS end_position FROM al")
def build_features(spark, sf_dir):
    return Fe.train_features(I.squad(spark, sf_dir), **_LEN).select("id", "window", "status", "start_position", "end_position")


@query(f"WITH {I.SQUAD}, {_OFF}, {_W64} SELECT id, CAST(\"window\" AS INTEGER) AS \"window\", CASE WHEN last > first THEN CAST(nq + 2 AS INTEGER) END AS first, CASE WHEN last > first THEN CAST(nq + 1 + last - first AS INTEGER) END AS last FROM al")
def context_range(spark, sf_dir):
    r = Fe.context_range(F.col("sequence_ids"))
    return Fe.encode_windows(I.squad(spark, sf_dir), **_LEN).select("id", "window", r["first"].alias("first"), r["last"].alias("last"))


@query(f"WITH {I.SQUAD}, {_OFF}, {_W64} SELECT id, CAST(\"window\" AS INTEGER) AS \"window\", CAST(nq + 3 AS BIGINT) AS n_masked, low AS first_start FROM al")
def mask_offsets(spark, sf_dir):
    """All positions with the places of some token, those outside the context masked."""
    w = Fe.encode_windows(I.squad(spark, sf_dir), **_LEN)
    bare = F.transform("offsets", lambda o: F.coalesce(o, F.struct(F.lit(0).alias("s"), F.lit(3).alias("e"))))
    m = w.withColumn("m", Fe.mask_offsets(bare, F.col("sequence_ids")))
    first = F.get(F.filter("m", lambda o: o.isNotNull()), F.lit(0))["s"]
    return m.select("id", "window", F.size(F.filter("m", lambda o: o.isNull())).cast("long").alias("n_masked"), first.cast("long").alias("first_start"))


@query(f"WITH {I.SQUAD} SELECT id, array_to_string(list_slice([x FOR x IN string_split_regex(question, '\\s+') IF x <> ''], 1, 5), ' ') AS question FROM squad")
def prepare_question(spark, sf_dir):
    s = I.squad(spark, sf_dir).withColumn("question", F.concat(F.lit(" \t"), F.regexp_replace("question", "^\\s+|\\s+$", "")))
    return s.select("id", Fe.prepare_question(F.col("question"), Wi.token_offsets(F.col("question")), 5).alias("question"))


@query(f"WITH {I.SQUAD}, {_OFF}, {_W64} SELECT id, CAST(\"window\" AS INTEGER) AS \"window\", CAST(CASE WHEN answer <> '' THEN 1 ELSE 0 END AS BIGINT) AS n_golds FROM al")
def join_features_example(spark, sf_dir):
    s = I.squad(spark, sf_dir)
    return Fe.with_examples(Fe.eval_features(s, **_LEN), s.select("id", "context", F.col("answers.text").alias("golds"))).select("id", "window", F.size("golds").cast("long").alias("n_golds"))


@query(f"WITH {I.SQUAD}, {_OFF}, {_W64} SELECT status, count(*) AS n FROM al GROUP BY status")
def feature_bundles(spark, sf_dir):
    """The validation bundle's column beside the model's."""
    return Fe.feature_bundle(I.squad(spark, sf_dir), "validation", **_LEN)[1].groupBy("status").agg(F.count("*").alias("n"))


_W50 = _windows("50", 16)


@query(f"WITH {I.SQUAD}, {_OFF}, {_W50} SELECT id, CAST(\"window\" AS INTEGER) AS \"window\", status, CASE WHEN status = 'aligned' THEN CAST(st AS INTEGER) END AS start_token, CASE WHEN status = 'aligned' THEN CAST(en AS INTEGER) END AS end_token FROM al")
def align_answer(spark, sf_dir):
    from .queries import aligned

    return aligned(spark, sf_dir).select("id", "window", "status", "start_token", "end_token")


@query(
    f"WITH {I.SQUAD}, {_OFF}, {_W50}, per AS (SELECT id, bool_or(status = 'aligned') AS ok, count(*) AS n, count(*) FILTER (status = 'aligned') AS a FROM al GROUP BY id)"
    " SELECT CAST(sum(n) AS BIGINT) AS n_windows, CAST(sum(a) AS BIGINT) AS n_aligned, count(*) FILTER (NOT ok) AS n_unaligned_examples, round(count(*) FILTER (ok) / count(*), 6) AS aligned_fraction FROM per"
)
def alignment_report(spark, sf_dir):
    from .queries import aligned

    return Wi.alignment_report(aligned(spark, sf_dir))


# ---- evaluation


def vectors_as_answers(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Examples, features and logits: each vector stands for an example of 28 three-letter words, read in two windows."""
    logits = I.logits(spark, sf_dir)
    word = lambda j: F.concat(F.lit("t"), F.lpad(j.cast("string"), 2, "0"))
    context = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(27)), word), " ")
    e = I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), context.alias("context"), F.array(word(F.col("vec_id") % 28), F.concat_ws(" ", word(F.col("vec_id") % 28), word(F.col("vec_id") % 28 + 1))).alias("golds"))
    at = lambda p: (F.col("window") * 14 + p - 2) * 4
    place = lambda p: F.when(p >= 2, F.struct(at(p).cast("int").alias("s"), (at(p) + 3).cast("int").alias("e")))
    f = e.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("window")).withColumn("offsets", F.transform(F.sequence(F.lit(0), F.lit(15)), place))
    # vectors that are divisible by 50 have no place in the context, and so no answer
    return e, f, logits.withColumn("context_mask", F.transform("context_mask", lambda m: F.when(F.col("id") % 50 != 0, m).otherwise(0)))


_DECODED = (
    f"{I.LOGITS.replace('k % 16 >= 2 AS inside', 'k % 16 >= 2 AND vec_id % 50 <> 0 AS inside')}, {_CAND}, p AS (SELECT *, round(exp(score - max(score) OVER (PARTITION BY id)), 12) AS x FROM cand), q AS (SELECT *, round(x / sum(x) OVER (PARTITION BY id), 9) AS probability FROM p),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, \"window\", start, end_rank) AS rank FROM q), b AS (SELECT id, (\"window\" * 14 + start - 2) AS f, (\"window\" * 14 + \"end\" - 2) AS l FROM r WHERE rank = 1),"
    " ans AS (SELECT vec_id AS id, b.id IS NOT NULL AS has_answer, coalesce(f * 4, 0) AS char_start, coalesce(l * 4 + 3, 0) AS char_end, coalesce(array_to_string(['t' || lpad(CAST(j AS VARCHAR), 2, '0') FOR j IN range(f, l + 1)], ' '), '') AS answer FROM embeddings LEFT JOIN b ON vec_id = b.id)"
)


@query(f"WITH {_DECODED} SELECT id, has_answer, CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end, answer FROM ans")
def decode_answers(spark, sf_dir):
    e, f, g = vectors_as_answers(spark, sf_dir)
    return Wi.answers(e, f, Wi.decode(g, 5, 8)).select("id", "has_answer", "char_start", "char_end", "answer")


_EVAL = (
    f"{_DECODED}, g AS (SELECT id, answer, has_answer, string_split(answer, ' ') AS p, ['t' || lpad(CAST(id % 28 AS VARCHAR), 2, '0')] AS g1, ['t' || lpad(CAST(id % 28 AS VARCHAR), 2, '0'), 't' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0')] AS g2 FROM ans),"
    f" t AS (SELECT id, has_answer, CASE WHEN p = g1 OR p = g2 THEN 1.0 ELSE 0.0 END AS em, CASE WHEN NOT has_answer THEN 0.0 ELSE greatest({X.f1_sql('p', 'g1')}, {X.f1_sql('p', 'g2')}) END AS f FROM g)"
)


@query(f"WITH {_EVAL} SELECT round(CAST(avg(em) * 100 AS DOUBLE), 6) AS exact_match, round(CAST(avg(f) * 100 AS DOUBLE), 6) AS f1, count(*) AS total_examples, 2 * count(*) AS total_features, count(*) FILTER (NOT has_answer) AS examples_without_answer FROM t")
def evaluate(spark, sf_dir):
    out = Wi.evaluate(*vectors_as_answers(spark, sf_dir), n_best=5, max_length=8)
    return out.select(F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"), "total_examples", "total_features", "examples_without_answer")


@query(
    f"WITH {_EVAL}, s AS (SELECT avg(em) * 100 AS em, avg(f) * 100 AS f, avg(CASE WHEN id % 10 = 0 THEN 0 ELSE em END) * 100 AS em2, avg(CASE WHEN id % 10 = 0 THEN 0 ELSE f END) * 100 AS f2 FROM t)"
    " SELECT 'same' AS predictions, CAST(0 AS DOUBLE) AS exact_match_delta, CAST(0 AS DOUBLE) AS f1_delta, true AS agrees FROM s"
    " UNION ALL SELECT 'a tenth lost', round(CAST(em - em2 AS DOUBLE), 6), round(CAST(f - f2 AS DOUBLE), 6), em - em2 < 0.01 AND f - f2 < 0.01 FROM s"
)
def cross_check(spark, sf_dir):
    """The scores held against a second scorer's, for the same predictions and where it is given a tenth of them empty."""
    e, f, g = vectors_as_answers(spark, sf_dir)
    found = Wi.answers(e, f, Wi.decode(g, 5, 8)).select("id", F.col("answer").alias("prediction")).join(e.select("id", "golds"), "id")
    lost = found.withColumn("prediction", F.when(F.col("id") % 10 == 0, "").otherwise(F.col("prediction")))
    ours = M.corpus_scores(M.example_scores(found.select("id", "prediction"), e.select("id", "golds")))
    rows = [M.cross_check(ours, M.plain_scores(df)).select(F.lit(name).alias("predictions"), "exact_match_delta", "f1_delta", "agrees") for name, df in (("same", found), ("a tenth lost", lost))]
    return rows[0].unionByName(rows[1])


@query(
    f"WITH {_EVAL} SELECT t.id, answer AS prediction, CAST(em AS DOUBLE) AS em, round(CAST(f AS DOUBLE), 6) AS f1, CASE WHEN t.has_answer THEN (SELECT least(count(*), 5) FROM cand c WHERE c.id = t.id) ELSE 0 END AS n_spans FROM t JOIN ans USING (id)"
)
def sink_predictions(spark, sf_dir):
    """What is written about predictions, a row for each reference."""
    e, f, g = vectors_as_answers(spark, sf_dir)
    found = Wi.answers(e, f, Wi.decode(g, 5, 8)).select("id", F.col("answer").alias("prediction"), "n_best")
    return Rd.prediction_dump(found, e).select("id", "prediction", F.round("em", 6).alias("em"), F.round("f1", 6).alias("f1"), F.size("n_best").cast("long").alias("n_spans"))


@query("SELECT o_orderkey AS pos, o_orderstatus AS prediction, o_orderpriority AS reference FROM orders")
def zip_align(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders")
    return M.zip_align(o.select(F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("prediction")), o.select(F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("reference")))


@query("SELECT k AS id, n > 20 AND m IS NOT NULL AS ok, m IS NOT NULL AS mask_present, CASE WHEN m IS NOT NULL THEN m <> 2 END AS mask_contiguous, CASE WHEN m IS NOT NULL THEN CASE WHEN m = 2 THEN 2 ELSE 4 END END AS completion_tokens FROM (SELECT n_nationkey AS k, n_nationkey AS n, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey % 3 END AS m FROM nation)")
def inspect_masks(spark, sf_dir):
    """Ten tokens; masks of the last four, of two apart, or none."""
    n = I.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    k = F.col("id") % 3
    mask = F.when(k == 1, F.array(*map(F.lit, [0] * 6 + [1] * 4))).when(k == 2, F.array(*map(F.lit, [0, 1, 0, 0, 0, 0, 0, 0, 1, 0])))
    c = Fe.inspect_masks(n.select("id", F.sequence(F.lit(1), F.lit(10)).alias("input_ids"), mask.alias("completion_mask")), 512)
    return c.select("id", ((F.col("id") > 20) & F.col("mask_present")).alias("ok"), "mask_present", "mask_contiguous", "completion_tokens")


# ---- question banks

_FLAWS = "c(kind, code) AS (VALUES (0, 'index_out_of_range'), (1, 'missing_accepted_answers'), (2, 'repeated_left_item'), (2, 'unpaired_left_item'), (3, 'empty_scenario'), (3, 'missing_sub_questions'), (4, 'missing_payload'), (5, 'payload_type_mismatch'))"


def payload_bank(spark, sf_dir) -> DataFrame:
    """Parts as questions of six types with their payloads; of every four one has a flaw of its type."""
    k, bad = F.col("id") % 6, F.floor(F.col("id") / 6) % 4 == 0
    kind = F.element_at(F.array(*map(F.lit, ("mcq", "fill_blank", "match", "case", "true_false", "short_answer"))), (k + 1).cast("int"))
    mcq = F.struct(F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("options"), F.when(bad, 5).otherwise(1).alias("correct_index"))
    fill = F.struct(F.array(F.when(bad, "  ").otherwise("x")).alias("accepted_answers"), F.lit("____").alias("blank_marker"))
    three = F.array(F.lit("l"), F.lit("m"), F.lit("n"))
    pair = lambda a, b: F.struct(F.lit(a).alias("left_index"), F.lit(b).alias("right_index"))
    match = F.struct(three.alias("left"), three.alias("right"), F.when(bad, F.array(pair(0, 0), pair(0, 1))).otherwise(F.array(pair(0, 0), pair(1, 1), pair(2, 2))).alias("pairs"))
    none = F.array().cast("array<string>")
    case = F.struct(F.when(bad, " ").otherwise("s").alias("scenario"), F.when(bad, none).otherwise(F.array(F.lit("q"))).alias("sub_questions"))
    payload = F.struct(
        F.when((k == 0) | ((k == 5) & bad), mcq).alias("mcq"), F.when(k == 1, fill).alias("fill"), F.when(k == 2, match).alias("match"),
        F.when((k == 4) & ~bad, F.struct(F.lit(True).alias("correct_answer"))).alias("true_false"), F.when(k == 3, case).alias("case_"),
    )
    b = I.bank(spark, sf_dir).select("id", "pos", "topic", "difficulty", "marks", F.concat(F.col("text"), F.lit(" ____ "), F.col("id").cast("string")).alias("text"))
    return b.select("*", kind.alias("question_type"), F.lit("b").alias("answer"), payload.alias("payload"))


@query(f"WITH {_FLAWS} SELECT p_partkey AS id, code FROM part JOIN c ON p_partkey % 6 = kind WHERE (p_partkey // 6) % 4 = 0")
def validate_payloads(spark, sf_dir):
    return P.validate_payloads(payload_bank(spark, sf_dir))


@query(f"WITH {_FLAWS} SELECT code, count(*) AS n FROM part JOIN c ON p_partkey % 6 = kind WHERE (p_partkey // 6) % 4 = 0 GROUP BY code")
def validate_question(spark, sf_dir):
    """All rules for questions; texts differ, so none repeats another."""
    return P.validate_questions(payload_bank(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))


@query(
    f"WITH {I.BANK}, b AS (SELECT id, text, answer, topic, id % 2 = 0 AS c FROM bank) SELECT id, CASE WHEN c THEN 'case:' ELSE 'mcq:' END || array_to_string([x FOR x IN [{X.norm_question_sql('text')}, CASE WHEN c THEN {X.norm_question_sql('topic')} ELSE '' END, CASE WHEN c THEN {X.norm_question_sql('answer')} ELSE '' END] IF x <> ''], ' | ') AS k FROM b"
)
def question_key(spark, sf_dir):
    b = I.bank(spark, sf_dir)
    kind = F.when(F.col("id") % 2 == 0, "case").otherwise("mcq")
    return b.select("id", X.question_key(kind, F.col("text"), F.col("topic"), F.array("answer")).alias("k"))


@query(f"WITH {I.SQUAD} SELECT id, {EXAMPLE_FP} AS fp FROM squad WHERE answer <> ''")
def example_fp(spark, sf_dir):
    return A.adapt("squad", I.squad(spark, sf_dir)).select("id", X.example_fingerprint(F.col("context"), F.col("targets")).alias("fp"))


@query(f"WITH {I.SQUAD} SELECT id, 'short_answer:' || {X.norm_question_sql('question')} || '|' || {NORM('answer')} AS fp FROM squad WHERE answer <> ''")
def target_fp(spark, sf_dir):
    return A.adapt("squad", I.squad(spark, sf_dir)).select("id", X.target_fingerprint(A.primary("question_type"), A.primary("question"), A.primary("answer")).alias("fp"))


@query(
    f"WITH {I.BANK}, {_PAPER} SELECT 'inconsistent_total_marks' AS code, CAST(sum(marks) AS VARCHAR) AS detail, 'error' AS severity FROM paper UNION ALL SELECT 'topic_out_of_scope', CAST(id AS VARCHAR), 'error' FROM paper WHERE topic <> 'Brand#11'"
)
def paper_issues(spark, sf_dir):
    return P.paper_issues(P.assemble(I.bank(spark, sf_dir), plan(spark)), plan(spark), 1, ["Brand#11"])


@query(f"WITH {I.BANK}, {_PAPER} SELECT 'relaxed_difficulty' AS warning, section_index, count(*) AS n FROM paper WHERE relaxed GROUP BY section_index UNION ALL SELECT 'unused_questions', NULL, (SELECT count(*) FROM bank) - (SELECT count(*) FROM paper)")
def assembly_warnings(spark, sf_dir):
    b = I.bank(spark, sf_dir)
    return P.assembly_warnings(P.require_filled(P.assemble(b, plan(spark)), plan(spark)), b)


@query(f"WITH {I.BANK}, {_PAPER} SELECT question_type, count(*) AS n FROM paper GROUP BY 1")
def type_breakdown(spark, sf_dir):
    return P.type_breakdown(P.assemble(I.bank(spark, sf_dir), plan(spark)))


# ---- content


def _listed(name: str, terms: str) -> str:
    return f"{name} AS (SELECT doc_id, string_agg(term, ',' ORDER BY rank) AS {name} FROM ({terms}) GROUP BY doc_id)"


_RANKED = "SELECT doc_id, term, rank FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) AS rank FROM {} GROUP BY 1, 2 {}) WHERE rank <= {}"
_TERMS = f"(SELECT doc_id, unnest({_CT}) AS term FROM documents)"
_PAIRS = f"(SELECT doc_id, t[k] || ' ' || t[k + 1] AS term FROM (SELECT doc_id, {_CT} AS t FROM documents), unnest(range(1, len(t))) u(k))"


@query(
    f"WITH {_listed('t', _RANKED.format(_TERMS, '', 5))}, {_listed('c', _RANKED.format(_PAIRS, 'HAVING count(*) >= 2', 3))} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'given' ELSE coalesce(t, '') END AS topics, CASE WHEN doc_id % 4 = 0 THEN '' ELSE coalesce(c, '') END AS concepts FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)"
)
def label_chunks(spark, sf_dir):
    """Documents as chunks; every fourth has labels already."""
    none = F.array().cast("array<string>")
    d = I.table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("given"))).otherwise(none).alias("topics"), none.alias("concepts"))
    return C.label_chunks(d, "doc_id").select("doc_id", F.array_join("topics", ",").alias("topics"), F.array_join("concepts", ",").alias("concepts"))


_OF_CHUNKS = lambda sql: sql.replace("doc_id", "id").replace("FROM documents", "FROM named")


@query(
    f"WITH RECURSIVE {CHUNKS}, named AS (SELECT document_id || ':c' || lpad(CAST(\"index\" AS VARCHAR), 4, '0') AS id, * FROM chunks), {_OF_CHUNKS(_listed('t', _RANKED.format(_TERMS, '', 5)))}, {_OF_CHUNKS(_listed('c', _RANKED.format(_PAIRS, 'HAVING count(*) >= 2', 3)))}"
    " SELECT id, document_id, char_start, char_end, coalesce(string_split(t, ','), []) AS topics, coalesce(string_split(c, ','), []) AS concepts FROM named LEFT JOIN t USING (id) LEFT JOIN c USING (id)"
)
def corpus_build(spark, sf_dir):
    return C.build_corpus(I.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id")).select("id", "document_id", "char_start", "char_end", "topics", "concepts")


@query("SELECT CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS INTEGER) AS rank, doc_id, text, CAST(n_chars AS DOUBLE) AS score FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def fetch_passages(spark, sf_dir):
    """The longest documents, ranked, as passages."""
    from pyspark.sql import Window

    d = I.table(spark, sf_dir, "documents")
    top = d.select("doc_id", F.col("n_chars").cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) - 1)  # twenty rows
    return C.fetch_passages(top, d.select("doc_id", "text"), "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ', 2.1' END || ', chars 10-' || CAST(n_chars AS VARCHAR) AS said, doc_id % 5 <> 0 AS ok FROM documents")
def grounding_ref(spark, sf_dir):
    k = F.col("doc_id")
    span = F.struct(F.lit(10).alias("char_start"), F.col("n_chars").alias("char_end"))
    g = F.struct(F.col("source").alias("source_id"), F.when(k % 2 != 0, F.col("lang")).alias("source_title"), F.when(k % 3 != 0, "2.1").alias("chapter"), F.lit(" ").alias("section"), span.alias("span"))
    bare = F.struct(F.when(k % 5 != 0, F.col("source")).otherwise("  ").alias("source_id"), span.alias("span"))
    return I.table(spark, sf_dir, "documents").select("doc_id", C.reference_text(g).alias("said"), C.traceable(bare).alias("ok"))


@query("SELECT doc_id, source AS title, CAST(2 AS BIGINT) AS n_headings, source || chr(10) || lang || ' link' || chr(10) || 'bold quoted' || chr(10) || 'part' AS body FROM documents")
def scan_markdown(spark, sf_dir):
    raw = F.concat(F.lit("# "), "source", F.lit(" #\n"), "lang", F.lit(" [link](http://a.b/c)\n> **bold** `quoted`\n## part"))
    m = Rd.markdown(I.table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")))
    return m.select("doc_id", "title", F.size("headings").cast("long").alias("n_headings"), "body")


# ---- runs


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events")
def utc_stamp(spark, sf_dir):
    return I.table(spark, sf_dir, "events").select("event_id", R.utc_stamp(F.col("ts").cast("timestamp")).alias("stamp"))


_N = "len([w FOR w IN string_split_regex(text, '\\s+') IF w <> ''])"


@query(
    f"WITH s AS (SELECT greatest(0, {_N} - 64) AS c, {_N} > 512 AS cut FROM documents), f AS (SELECT count(*) AS n, min(c) AS least, avg(CASE WHEN cut THEN 1.0 ELSE 0.0 END) AS cut FROM s)"
    " SELECT 'subset_size_mismatch' AS finding, CAST(n AS VARCHAR) AS detail FROM f WHERE n <> 7 UNION ALL SELECT 'empty_completion_tokens', CAST(least AS VARCHAR) FROM f WHERE least <= 0 UNION ALL SELECT 'subset_truncation_high', CAST(round(CAST(cut AS DOUBLE), 6) AS VARCHAR) FROM f WHERE cut > 0.05"
)
def check_subset(spark, sf_dir):
    n = F.col("n_tokens")
    return R.check_subset(lengths(spark, sf_dir).select(F.greatest(F.lit(0), n - 64).alias("completion_tokens"), (n > 512).alias("truncated")), 7)



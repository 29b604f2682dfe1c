"""Quality rules: a table of thresholds compiled into one Spark projection; no user functions.

The projection has two layers: counts over the whole text, then verdicts that compare exact integer products
(100 * part > limit * whole), so no rounding enters a decision.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the be to of and that have with is was are for on this by it from "
    "le la les de des du et un une dans qui que pour par "
    "der die das und ist nicht ein eine mit von zu den "
    "el los las y en una por con para es se del"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails where part / whole, in hundredths, is beyond a bound. whole None: part is compared as it is."""

    name: str
    part: str
    whole: str | None = None
    least: int | None = None
    most: int | None = None


#: The base rules of the verdict: they alone decide base_failed.
BASE = (
    Rule("few_words", "n_words", least=50),
    Rule("repeated_windows", "n_repeat_words", "n_words", most=50),
)

#: The method's table. Ratios are hundredths of the named whole.
TABLE = (
    Rule("many_words", "n_words", most=100_000),
    Rule("short_words", "word_chars", "n_words", least=250),
    Rule("long_words", "word_chars", "n_words", most=1200),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=40),
    Rule("stop_words", "n_stop_words", "n_words", least=2),
    Rule("capitals", "n_capital_words", "n_words", most=30),
)


def failed(rule: Rule) -> Column:
    part = F.col(rule.part) if rule.whole is None else 100 * F.col(rule.part)
    whole = F.lit(1) if rule.whole is None else F.col(rule.whole)
    tests = ([part < rule.least * whole] if rule.least is not None else []) + ([part > rule.most * whole] if rule.most is not None else [])
    return reduce(Column.__or__, tests)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words", "n_lines", "n_dup_lines", "n_capital_words")

#: Names of columns on the way; a caller's columns of these names are replaced and left out.
OWN = ("__words", "__hashes", "__sorted", "__twice", "__starts", "__lines", "__counts")
#: Up to so many different repeated windows are looked up one by one; more are found by sorting.
FEW = 64


def _none() -> Column:
    return F.array().cast("array<int>")


def _starts_by_sorting(hashes: Column) -> Column:
    """Positions of the hashes that occur twice or more: sorted with their positions, equal ones stand side by side."""
    s = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(hashes) - 1
    pairs = F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    return F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts the rules read.

    A null or blank text has no words and every count 0. Texts of any length are taken whole. Repeated rows are judged
    one by one; other columns pass through unless they carry the name of a count, which replaces them, or one in OWN. An
    empty table gives an empty one."""
    given = [c for c in df.columns if c not in OWN]
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.col("__words")
    df = df.withColumn("__words", F.array_remove(F.split(t, BLANK_RUN, -1), ""))
    df = df.withColumn(
        "__hashes",
        F.when(
            F.size(words) > 2,
            F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    hashes = F.col("__hashes")
    df = df.withColumn("__sorted", F.sort_array(hashes))
    s = F.col("__sorted")
    less = F.greatest(F.size(s) - 1, F.lit(0))
    twice = F.filter(F.zip_with(F.slice(s, 1, less), F.slice(s, 2, less), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())
    df = df.withColumn("__twice", F.array_distinct(twice))
    found = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains("__twice", h), i)), lambda x: x.isNotNull())
    df = df.withColumn(
        "__starts",
        F.when(F.size("__twice") == 0, _none()).when(F.size("__twice") <= FEW, found).otherwise(F.sort_array(_starts_by_sorting(hashes))),
    )
    at = F.col("__starts")
    gaps = F.zip_with(
        F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))),
        F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))),
        lambda a, b: F.least(b - a, F.lit(3)),
    )
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]", ""))).cast("long"),
            "n_repeat_words": F.when(F.size(at) == 0, F.lit(0)).otherwise(3 + F.aggregate(gaps, F.lit(0), lambda x, y: x + y)).cast("long"),
            "n_stop_words": F.size(F.filter("__words", lambda w: w.isin(STOP_WORDS))).cast("long"),
            "__lines": lines,
        }
    )
    df = df.withColumns(
        {
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_capital_words": (F.size(F.split(t, r"[A-Z]{4,}", -1)) - 1).cast("long"),
        }
    )
    # a filter on a count would be pushed into the projections above, and word lists would be made anew for each word;
    # an explode of one struct stops it
    kept = [c for c in given if c not in COUNTS]
    df = df.select(*kept, F.explode(F.array(F.struct(*COUNTS))).alias("__counts"))
    return df.select(*kept, *[F.col(f"__counts.{c}").alias(c) for c in COUNTS])


def judge(df: DataFrame, text: str = "text", table: tuple[Rule, ...] = TABLE) -> DataFrame:
    """df with the counts, base_failed, the names of the rules of the table that failed, and kept."""
    df = counts(df, text)
    broken = F.filter(F.array(*[F.when(failed(r), F.lit(r.name)) for r in table]), lambda x: x.isNotNull())
    df = df.withColumn("base_failed", reduce(Column.__or__, [failed(r) for r in BASE])).withColumn("broken_rules", broken)
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents; nulls, ties and empty tables as counts() states."""
    from .common import table as load

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs).select(*cols)


def _sql(table: tuple[Rule, ...]) -> str:
    tests = []
    for r in table:
        part, whole = (r.part, "1") if r.whole is None else (f"100 * {r.part}", r.whole)
        tests += [f"{part} < {r.least} * {whole}"] if r.least is not None else []
        tests += [f"{part} > {r.most} * {whole}"] if r.most is not None else []
    return " OR ".join(tests)


OP8_SQL = f"""
WITH w AS (SELECT doc_id, t, [x FOR x IN string_split_regex(t, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws,
           [x FOR x IN string_split(t, chr(10)) IF NOT regexp_full_match(x, '[\\x20\\x09-\\x0D]*')] AS ls
           FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
three AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) u(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM three) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM again, unnest([i, i + 1, i + 2]) v(p) GROUP BY 1),
c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
      len([x FOR x IN ws IF x IN ({', '.join(f"'{x}'" for x in STOP_WORDS)})]) AS n_stop_words, len(regexp_extract_all(t, '[A-Z]{{4,}}')) AS n_capital_words
      FROM w LEFT JOIN cover USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_sql(BASE)} AS base_failed, NOT ({_sql(BASE)}) AND NOT ({_sql(TABLE)}) AS kept FROM c
"""

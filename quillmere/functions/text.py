"""Scalar text functions as column expressions; offsets are 0-based code points, ends exclusive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII punctuation, spaces that are mapped to one, characters without width, the byte-order mark.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
UNICODE_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
ZERO_WIDTH = "\u200b\u200c\u200d\u2060"
BOM = "\ufeff"

#: How symbols of questions are read, longer ones first.
OPERATORS = {
    "<=": "less than or equal", ">=": "greater than or equal", "!=": "not equals", "==": "equals",
    "**": "power", "->": "arrow", "=>": "arrow", "+/-": "plus or minus",
}
SYMBOLS = {
    "-": "minus", "/": "divided",
    "+": "plus", "*": "times", "×": "times", "÷": "divided", "%": "percent", "^": "power",
    "=": "equals", "<": "less than", ">": "greater than", "≠": "not equals", "≤": "less than or equal",
    "≥": "greater than or equal", "≈": "approx", "~": "approx",
    "(": "lparen", ")": "rparen", "[": "lbracket", "]": "rbracket", "{": "lbrace", "}": "rbrace", "|": "pipe",
    "$": "dollar", "£": "pound", "€": "euro", "₹": "rupee", "°": "degree",
    "±": "plus or minus", "√": "sqrt", "π": "pi", "∞": "infinity", "∑": "sum",
    "∫": "integral", "→": "arrow", "&": "and", "#": "hash", "@": "at",
}


#: Marks between digits (the last one after them), and how they are read.
BESIDE_DIGITS = {r"\.(?<=\d\.)(?=\d)": " point ", r":(?<=\d:)(?=\d)": " ratio ", r"!(?<=\d!)": " factorial "}


def strip(t: Column) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def is_blank(t: Column) -> Column:
    """Null, empty or white space only."""
    return t.isNull() | t.rlike(r"(?U)^\s*$")


def fold(t: Column) -> Column:
    """Stripped and in lower case, as values are compared that may differ in both."""
    return F.lower(strip(t))


def normalize_answer(t: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    t = F.translate(F.lower(t), PUNCTUATION, "")
    t = F.regexp_replace(t, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def _run_starts(df: DataFrame, values: str) -> DataFrame:
    marked = F.filter(F.transform(values, lambda x, i: F.when((i == 0) | (x != F.get(values, i - 1)), i)), lambda i: i.isNotNull())
    return df.withColumn("__starts", marked)


def counted(df: DataFrame, values: str, name: str) -> DataFrame:
    """df with name: structs (n, term) of the values of a sorted array and how often they stand there. Linear, in the row."""
    df = _run_starts(df, values)
    length = lambda p, k: F.coalesce(F.get("__starts", k + 1), F.size(values)) - p
    return df.withColumn(name, F.transform("__starts", lambda p, k: F.struct(length(p, k).alias("n"), F.get(values, p).alias("term")))).drop("__starts")


def numbered_runs(df: DataFrame, values: str, name: str) -> DataFrame:
    """df with name: the values of a sorted array of strings, each with its number among equal ones."""
    df = counted(df, values, "__counted")
    each = F.transform("__counted", lambda c: F.transform(F.sequence(F.lit(1), c["n"]), lambda k: F.concat(c["term"], F.lit("\u0000"), k.cast("string"))))
    return df.withColumn(name, F.flatten(each)).drop("__counted")


def answer_tokens(t: Column) -> Column:
    return F.filter(F.split(normalize_answer(t), " "), lambda x: x != "")


def normalize_question(t: Column) -> Column:
    """normalize_answer, after symbols that carry meaning were put into words. Hyphens and slashes between letters join
    words and vanish, commas between digits, too; points, colons and exclamation marks count only next to digits. Patterns
    begin with the mark, as one that begins with look-behind is tried at every place of the text."""
    t = F.regexp_replace(F.lower(t), r"[-/](?<=\p{L}[-/])(?=\p{L})|,(?<=\d,)(?=\d)", "")
    t = F.regexp_replace(t, "_+", " blank ")
    t = reduce(lambda c, kv: F.regexp_replace(c, kv[0], kv[1]), BESIDE_DIGITS.items(), t)
    for table in (OPERATORS, SYMBOLS):
        t = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(f" {kv[1]} ")), table.items(), t)
    return normalize_answer(t)


def question_key(kind: Column, text: Column, scenario: Column, parts: Column) -> Column:
    """The fingerprint of a question; of a case, with its scenario and sub-questions (an array), as cases may share a
    text."""
    more = F.when(kind == "case", F.concat(F.array(F.coalesce(scenario, F.lit(""))), F.coalesce(parts, F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))
    every = F.filter(F.transform(F.concat(F.array(text), more), normalize_question), lambda p: p != "")
    return F.concat(kind, F.lit(":"), F.array_join(every, " | "))


def question_fingerprint(kind: Column, text: Column, *more: Column) -> Column:
    """type:normalized parts joined by ' | ', empty parts left out."""
    parts = F.filter(F.array(*[normalize_question(p) for p in (text, *more)]), lambda p: p != "")
    return F.concat(kind, F.lit(":"), F.array_join(parts, " | "))


def target_fingerprint(kind: Column, question: Column, answer: Column) -> Column:
    return F.concat(kind, F.lit(":"), normalize_question(question), F.lit("|"), normalize_answer(answer))


def example_fingerprint(context: Column, targets: Column) -> Column:
    """The context's fingerprint and those of the targets (structs with question_type, question, answer), joined by '|'."""
    each = F.transform(targets, lambda t: target_fingerprint(t["question_type"], t["question"], t["answer"]))
    return F.array_join(F.concat(F.array(context_fingerprint(context)), each), "|")


def strip_control(t: Column) -> Column:
    return F.regexp_replace(t, r"[\p{Cc}&&[^\n\t]]", "")


def clean_text(t: Column) -> Column:
    t = F.regexp_replace(t, f"^{BOM}+", "")
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.translate(t, UNICODE_SPACES + ZERO_WIDTH, " " * len(UNICODE_SPACES))
    t = strip_control(t)
    t = F.regexp_replace(t, r"(?m)[ \t]+$", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def collapse_inline(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"(?U)^\s+|\s+$", "")


def slug(t: Column, most: int = 40) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), F.lit("-")), 1, most)


def short_hash(*parts: Column, length: int = 12) -> Column:
    """The first hexadecimal digits of SHA-256 of the parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, length)


def document_id(filename: Column, text: Column) -> Column:
    digest = short_hash(filename, text)
    return F.when(slug(filename) == "", F.concat(F.lit("doc-"), digest)).otherwise(F.concat(F.lit("doc-"), slug(filename), F.lit("-"), digest))


def chunk_id(document: Column, index: Column) -> Column:
    return F.format_string("%s:c%04d", document, index)


def derive_id(source: Column, *parts: Column) -> Column:
    return F.concat(source, F.lit("-"), short_hash(*parts))


def excerpt(t: Column, most: int = 160) -> Column:
    flat = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), "^ | $", "")
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("..."))).otherwise(flat)


def span_is_valid(t: Column, start: Column, end: Column) -> Column:
    return (start >= 0) & (start <= end) & (end <= F.length(t))


def tighten_span(t: Column, start: Column, end: Column) -> Column:
    """(start, end) moved inwards past white space; only white space gives (start, start)."""
    cut = F.substring(t, start + 1, end - start)
    left = F.length(cut) - F.length(F.regexp_replace(cut, r"(?U)^\s+", ""))
    right = F.length(cut) - F.length(F.regexp_replace(cut, r"(?U)\s+$", ""))
    blank = left >= F.length(cut)
    return F.struct(
        F.when(blank, start).otherwise(start + left).alias("start"),
        F.when(blank, start).otherwise(end - right).alias("end"),
    )


def extract_answer(t: Column, start: Column, end: Column) -> Column:
    span = tighten_span(t, start, end)
    return F.substring(t, span["start"] + 1, span["end"] - span["start"])


def context_fingerprint(context: Column) -> Column:
    return F.substring(F.sha2(normalize_answer(context), 256), 1, 12)


def effective_group_key(key: Column, context: Column) -> Column:
    own = F.when(F.trim(key) != "", key)
    return F.coalesce(own, F.concat(F.lit("ctx:"), context_fingerprint(context)))


def extract_json_object(t: Column) -> Column:
    """From the first { to the last }, or null."""
    found = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def section_title(index: Column) -> Column:
    return F.concat(F.lit("Section "), F.when(index < 26, F.char(index + 65)).otherwise((index + 1).cast("string")))


def order_digest(seed: int | str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}\u0000"), key), 256)


#: ---- the same definitions in DuckDB SQL, in another form where the dialects differ -----------------------------------


def norm_sql(x: str) -> str:
    marks = PUNCTUATION.replace("'", "''")
    return f"array_to_string({tokens_sql(x, marks)}, ' ')"


def tokens_sql(x: str, marks: str | None = None) -> str:
    marks = marks or PUNCTUATION.replace("'", "''")
    return f"[w FOR w IN string_split_regex(translate(lower({x}), '{marks}', ''), '[\\s\\x{{00A0}}]+') IF w NOT IN ('', 'a', 'an', 'the')]"


def norm_question_sql(x: str) -> str:
    """normalize_question() in a dialect without look-behind: letters and digits around a mark are captured and put back,
    twice, as one letter may stand between two marks."""
    t = f"lower({x})"
    for mark, kept in (("-", 1), ("/", 2)):
        for _ in range(2):
            t = f"regexp_replace({t}, '(\\p{{L}}){mark}(\\p{{L}})', '\\1' || chr({kept}) || '\\2', 'g')"
    t = f"regexp_replace({t}, '_+', ' blank ', 'g')"
    for mark, word in ((",", ""), ("[.]", " point "), (":", " ratio ")):
        for _ in range(2):
            t = f"regexp_replace({t}, '([0-9]){mark}([0-9])', '\\1{word}\\2', 'g')"
    t = f"regexp_replace({t}, '([0-9])!', '\\1 factorial ', 'g')"
    for table in (OPERATORS, SYMBOLS):
        for sign, word in table.items():
            t = f"replace({t}, '{sign}', ' {word} ')"
    return norm_sql(f"translate({t}, chr(1) || chr(2), '-/')")


def f1_sql(p: str, g: str) -> str:
    """Token F1 of two lists of tokens."""
    shared = f"coalesce(list_sum([least(len([y FOR y IN {p} IF y = x]), len([y FOR y IN {g} IF y = x])) FOR x IN list_distinct({p})]), 0)"
    return f"CASE WHEN len({p}) = 0 OR len({g}) = 0 THEN CASE WHEN len({p}) = len({g}) THEN 1.0 ELSE 0.0 END ELSE 2.0 * {shared} / (len({p}) + len({g})) END"

"""Readers and writers: JSON and JSONL records, plain text and Markdown documents, prepared splits, prediction dumps."""

from __future__ import annotations

import contextlib
import json
import uuid
import warnings
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text, collapse_inline, document_id
from ..operators.metrics import example_scores
from ..operators.quality import check_schema
from ..operators.selection import select_hash
from ..scratch import place
from .lines import read_lines

#: Rows of the published splits.
SQUAD_SIZES = {"train": 87_599, "validation": 10_570}
TYPES = {".txt": "text", ".text": "text", ".md": "markdown", ".markdown": "markdown", ".mdown": "markdown", ".mkd": "markdown", ".pdf": "pdf", ".docx": "docx"}
WRAPPERS = ("data", "records", "examples")


def read_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """.json (a list, or an object with data, records or examples), .jsonl or .ndjson; anything else is refused, and so
    are malformed lines. Of the lines of JSONL at most limit, the first that are not blank, are read: the file is read no
    further than to the last of them, and types are told from them."""
    kind = PurePosixPath(path).suffix.lower()
    if kind in (".jsonl", ".ndjson"):
        if limit is None:
            return spark.read.option("mode", "FAILFAST").json(path)
        first = place(spark, "first")
        read_lines(spark, path, limit).select("text").write.text(first)
        return spark.read.option("mode", "FAILFAST").json(first)
    if kind != ".json":
        raise ValueError(f"{kind or 'no suffix'}: only .json, .jsonl and .ndjson can be read")
    df = spark.read.option("mode", "FAILFAST").option("multiLine", True).json(path)
    inner = next((c for c in WRAPPERS if c in df.columns and isinstance(df.schema[c].dataType, T.ArrayType)), None)
    if inner:
        df = df.select(F.inline(inner))
    return df if limit is None else df.limit(limit)


def read_source(spark: SparkSession, path: str | None = None, export: str | None = None, limit: int | None = None) -> DataFrame:
    """A local file wins over a Parquet export; neither is an error."""
    if path:
        return read_records(spark, path, limit)
    if export:
        df = spark.read.parquet(export)
        return df if limit is None else df.limit(limit)
    raise ValueError("a source needs a path or an export")


def source_type(name: str) -> str:
    """By suffix; formats without a reader are refused with a reason."""
    kind = TYPES.get(PurePosixPath(name).suffix.lower())
    if kind is None:
        raise ValueError(f"{name}: unknown kind of document")
    if kind in ("pdf", "docx"):
        raise NotImplementedError(f"{name}: {kind} needs a layout parser, which this library does not have")
    return kind


def _whole(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"))
    return df


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """id, filename, source_type, title (null), text of every file: cleaned first, then named by name and text."""
    df = _whole(spark, path).withColumn("text", clean_text(F.col("raw")))
    return df.select(document_id(F.col("filename"), F.col("text")).alias("id"), "filename", F.lit("text").alias("source_type"), F.lit(None).cast("string").alias("title"), "text")


#: A heading: up to three blanks, one to six number signs, a blank; closing signs do not belong to its text.
HEADING = r"(?m)^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$"
#: What is taken out of Markdown, line marks first, and what stays of it.
PLAIN = (
    (r"(?m)^ {0,3}(?:`{3,}|~{3,})[^\n]*$", ""),  # fences; the code between them stays
    (r"(?m)^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$", ""),  # rules
    (r"(?m)^ {0,3}(?:>[ \t]?)+", ""),  # quotes of any depth
    (HEADING, "$2"),
    (r"!?\[([^\]]*)\]\([^)\n]*\)", "$1"),  # images and links: their words
    (r"(?s)\*{2}(?=\S)(.+?)(?<=\S)\*{2}", "$1"),  # strong
    (r"(?<![*\w])\*(?=[^\s*])([^*\n]+?)(?<=\S)\*(?!\*)", "$1"),  # emphasis
    (r"`+([^`\n]+)`+", "$1"),  # code in a line
)


def markdown(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with body, title (the first heading of level one, else the first) and headings (level, text)."""
    levels = F.regexp_extract_all(raw, F.lit(HEADING), F.lit(1))
    names = F.regexp_extract_all(raw, F.lit(HEADING), F.lit(2))
    heads = F.zip_with(levels, names, lambda h, t: F.struct(F.length(h).alias("level"), collapse_inline(F.coalesce(t, F.lit(""))).alias("text")))
    df = df.withColumn("headings", F.filter(heads, lambda h: h["text"] != ""))
    top = F.filter("headings", lambda h: h["level"] == 1)
    body = F.col(raw)
    for pattern, kept in PLAIN:
        body = F.regexp_replace(body, pattern, kept)
    return df.withColumn("title", F.coalesce(F.get(top, F.lit(0))["text"], F.get("headings", F.lit(0))["text"])).withColumn("body", body)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    df = markdown(_whole(spark, path)).withColumn("text", clean_text(F.col("body")))
    return df.select(document_id(F.col("filename"), F.col("text")).alias("id"), "filename", F.lit("markdown").alias("source_type"), "title", "text", "headings")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return {"text": read_text, "markdown": read_markdown}[source_type(path)](spark, path)


def read_squad(spark: SparkSession, path: str, split: str, cap: int | None = None, seed: int = 42) -> DataFrame:
    """Question rows of a Parquet export: checked against the schema; a size other than SQUAD_SIZES says is warned about; at
    most cap rows, those whose seeded digests come first."""
    df = check_schema(spark.read.parquet(path), split)
    n = df.count()
    if split in SQUAD_SIZES and n != SQUAD_SIZES[split]:
        warnings.warn(f"split {split} has {n} rows, not {SQUAD_SIZES[split]}", stacklevel=2)
    return df if cap is None or cap >= n else select_hash(df, cap, seed)


def read_squad_all(spark: SparkSession, paths: dict[str, str], cap: int | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """Every split by its name."""
    return {split: read_squad(spark, path, split, cap, seed) for split, path in paths.items()}


def plan_sources(requests: list[dict], catalogue: dict[str, dict]) -> list[dict]:
    """Requests (source, path, export, limit) resolved against a catalogue (source -> defaults): each with how it is read
    (file, export or missing) and what it lacks. No data is read. An unknown source is an error."""
    out = []
    for r in requests:
        if r["source"] not in catalogue:
            raise KeyError(f"no source {r['source']!r}; there are {', '.join(sorted(catalogue))}")
        merged = {**catalogue[r["source"]], **{k: v for k, v in r.items() if v is not None}}
        how = "file" if merged.get("path") else "export" if merged.get("export") else "missing"
        out.append({**merged, "how": how, "needs": None if how != "missing" else "a path, or an export of the hub's table"})
    return out


@contextlib.contextmanager
def _replacing(spark: SparkSession, path: str) -> Iterator[str]:
    """A new folder beside path, which takes its place when all in it is written. If that fails the new folder goes and what
    stood at path stays. Whoever looks between the two renamings finds nothing at path, never a part."""
    path = path.rstrip("/")
    cut = path.rfind("/") + 1
    beside = lambda what: f"{path[:cut]}_{what}-{path[cut:]}-{uuid.uuid4().hex}"
    new = beside("writing")
    fs, new_at = _fs(spark, new)
    _, at = _fs(spark, path)
    try:
        yield new
        _, old_at = _fs(spark, beside("old"))
        stood = fs.exists(at)
        if stood and not fs.rename(at, old_at):
            raise OSError(f"{path} could not be moved away")
        if not fs.rename(new_at, at):
            if stood:
                fs.rename(old_at, at)
            raise OSError(f"{path} could not be put in place")
        if stood:
            fs.delete(old_at, True)
    finally:
        fs.delete(new_at, True)


def write_prepared(df: DataFrame, path: str) -> None:
    """Rows by split; an earlier set at path is replaced when the new one is whole."""
    with _replacing(df.sparkSession, path) as new:
        df.write.partitionBy("split").json(new)


def read_prepared(spark: SparkSession, path: str, split: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a split, and up to five lines that do not parse: file, line (from 1) and text. A split without rows is an
    error."""
    where = f"{path}/split={split}"
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(where).filter("value <> ''").select(F.input_file_name().alias("file"), parsed.alias("p"))
    good = rows.filter("p._bad is null").select("p.*").drop("_bad")
    if good.isEmpty():
        raise ValueError(f"split {split} is empty")
    # only files that hold a bad line are read again, in parts, to number their lines
    files = [r["file"] for r in rows.filter("p._bad is not null").select("file").distinct().orderBy("file").limit(5).collect()]
    if not files:
        return good, spark.createDataFrame([], "file string, line int, text string")
    bad = read_lines(spark, files).withColumnRenamed("text", "value").filter("value <> ''").withColumn("p", parsed).filter("p._bad is not null")
    return good, bad.select("file", F.col("line").cast("int").alias("line"), F.col("value").alias("text")).orderBy("file", "line").limit(5)


def write_report(root: str, experiment: str, fingerprint: str, report: dict, splits: DataFrame, spark: SparkSession) -> str:
    """Writes the splits and dataset.json into root/experiment-fingerprint, which it returns; both appear there at once."""
    place = f"{root.rstrip('/')}/{experiment}-{fingerprint}"
    with _replacing(spark, place) as new:
        splits.write.partitionBy("split").json(new)
        fs, at = _fs(spark, f"{new}/dataset.json")
        out = fs.create(at, True)
        try:
            out.write(bytearray(json.dumps({"experiment": experiment, "fingerprint": fingerprint, **report}, sort_keys=True, indent=1).encode()))
        finally:
            out.close()
    return place


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def discover(spark: SparkSession, root: str) -> list[dict]:
    """Prepared datasets under root, the newest first: directory, experiment, fingerprint, splits, modified. Folders that are
    still being written (their names begin with _) are none."""
    fs, at = _fs(spark, root)
    if not fs.exists(at):
        return []
    found = []
    for entry in fs.listStatus(at):
        name = entry.getPath().getName()
        if name.startswith("_"):
            continue
        splits = sorted(x.getPath().getName()[6:] for x in fs.listStatus(entry.getPath()) if x.getPath().getName().startswith("split=")) if entry.isDirectory() else []
        if splits:
            experiment, _, fingerprint = name.rpartition("-")
            found.append({"directory": entry.getPath().toString(), "experiment": experiment, "fingerprint": fingerprint, "splits": splits, "modified": entry.getModificationTime()})
    return sorted(found, key=lambda f: (-f["modified"], f["directory"]))


def resolve_prepared(spark: SparkSession, root: str, directory: str | None = None, fingerprint: str | None = None) -> dict:
    """A prepared dataset: the named directory, else that with the fingerprint, else the newest, with a warning if there
    are several."""
    if directory is not None:
        parent, _, name = directory.rstrip("/").rpartition("/")
        hits = [f for f in discover(spark, parent) if f["directory"].rstrip("/").endswith("/" + name)]
        if not hits:
            raise ValueError(f"{directory} holds no splits")
        return hits[0]
    every = discover(spark, root)
    hits = every if fingerprint is None else [f for f in every if f["fingerprint"] == fingerprint]
    if not hits:
        raise ValueError(f"nothing prepared under {root}" + (f" with fingerprint {fingerprint}" if fingerprint else ""))
    if fingerprint is None and len(hits) > 1:
        warnings.warn(f"{len(hits)} prepared datasets; {hits[0]['directory']} is the newest", stacklevel=2)
    return hits[0]


def prediction_dump(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """id, golds, prediction, em, f1 and the five best spans of each reference, also of those without a prediction, which
    score nothing."""
    df = references.select("id", "golds").join(predictions.select("id", F.coalesce("prediction", F.lit("")).alias("prediction"), "n_best"), "id", "left")
    scored = example_scores(df.select("id", F.coalesce("prediction", F.lit("")).alias("prediction")), references)
    return df.join(scored, "id").select("id", "golds", "prediction", "em", "f1", F.slice("n_best", 1, 5).alias("n_best"))


def write_predictions(predictions: DataFrame, references: DataFrame, path: str, most: int | None = None) -> None:
    df = prediction_dump(predictions, references)
    (df if most is None else df.orderBy("id").limit(most)).write.mode("overwrite").json(path)

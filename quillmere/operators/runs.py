"""Arithmetic of training runs, configurations, and records about runs; only plans with a table in them make a job."""

from __future__ import annotations

import hashlib
import json
import types
import typing
from dataclasses import asdict, fields, is_dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Records that are tokenized in a second, as planning assumes.
RECORDS_A_SECOND = 900


def total_steps(examples: Column, effective: Column, epochs: Column) -> Column:
    """Steps of a run: at least one an epoch, none without examples."""
    each = F.when(examples > 0, F.greatest(F.lit(1), F.ceil(examples / effective))).otherwise(0)
    return (each * epochs).cast("long")


def warmup_steps(total: Column, ratio: Column) -> Column:
    """At least one if there is any warming up; halves go to the even number."""
    return F.when((ratio > 0) & (total > 0), F.greatest(F.lit(1), F.bround(total * ratio))).otherwise(0).cast("long")


def step_plans(counts: DataFrame, plans: DataFrame) -> DataFrame:
    """counts (name, examples) and plans (batch, accumulation, epochs, warmup_ratio, seconds_per_step or null) -> each count
    under each plan: effective, total_steps, warmup_steps, seconds (one decimal). A plan that is not positive is an error."""
    fair = (F.col("batch") > 0) & (F.col("accumulation") > 0) & (F.col("epochs") > 0)
    wrong = F.raise_error(F.lit("batch, accumulation and epochs must be positive")).cast("boolean")
    df = counts.crossJoin(F.broadcast(plans)).filter(F.when(fair, F.lit(True)).otherwise(wrong))  # a few plans
    df = df.withColumn("effective", F.col("batch") * F.col("accumulation"))
    df = df.withColumn("total_steps", total_steps(F.col("examples"), F.col("effective"), F.col("epochs")))
    return df.withColumns({"warmup_steps": warmup_steps(F.col("total_steps"), F.col("warmup_ratio")), "seconds": F.round(F.col("total_steps") * F.col("seconds_per_step"), 1)})


def project_run(counts: DataFrame, seconds_per_step: float, batch: int = 1, accumulation: int = 8, epochs: int = 2) -> DataFrame:
    """counts (name, examples) -> total_steps and seconds of a run, if every step takes as long as the measured ones."""
    plan = counts.sparkSession.createDataFrame([(batch, accumulation, epochs, 0.0, seconds_per_step)], "batch int, accumulation int, epochs int, warmup_ratio double, seconds_per_step double")
    return step_plans(counts, plan).select(*counts.columns, "total_steps", "seconds")


def tokenize_seconds(n: Column) -> Column:
    return n / RECORDS_A_SECOND


def check_subset(subset: DataFrame, requested: int, limit: float = 0.05) -> DataFrame:
    """A measured subset (completion_tokens, truncated) -> finding, detail: another size than was asked for, a row without
    completion tokens, too many truncated rows."""
    facts = subset.agg(F.count("*").alias("n"), F.coalesce(F.min("completion_tokens"), F.lit(1)).alias("least"), F.coalesce(F.avg(F.col("truncated").cast("double")), F.lit(0.0)).alias("cut"))
    row = lambda when, name, detail: F.when(when, F.struct(F.lit(name).alias("finding"), detail.cast("string").alias("detail")))
    rules = F.array(
        row(F.col("n") != requested, "subset_size_mismatch", F.col("n")), row(F.col("least") <= 0, "empty_completion_tokens", F.col("least")),
        row(F.col("cut") > limit, "subset_truncation_high", F.round("cut", 6)),
    )
    return facts.select(F.inline(F.filter(rules, lambda r: r.isNotNull())))


def bench_subset(df: DataFrame, n: int, seed: int, id_: str = "id") -> DataFrame:
    """n rows by seeded digest; fewer rows than that are an error."""
    from .selection import select_hash

    have = df.count()
    if have < n:
        raise ValueError(f"{n} rows are asked for and there are {have}")
    return select_hash(df, n, seed, id_)


def utc_stamp(when: Column | None = None) -> Column:
    """A moment (now, if none is given) as 20240131T235959Z."""
    when = F.current_timestamp() if when is None else when
    return F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")


def utc_now() -> str:
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")


def config_hash(config: dict, length: int = 12) -> str:
    """A digest of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:length]


def merge(base: dict, over: dict) -> dict:
    """over on top of base, dict by dict."""
    return {k: merge(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in {**base, **over}}


def compose(configs: dict[str, dict], name: str, known: dict, sets: tuple[str, ...] = ()) -> dict:
    """A configuration with what it extends (key extends: another's name) and dotted overrides (a.b=json or text) on top of
    known, which holds every key with its default. Unknown keys and circles are errors."""
    chain, at = [], name
    while at is not None:
        if at in chain:
            raise ValueError(f"{name} extends itself by way of {at}")
        if at not in configs:
            raise KeyError(f"no configuration {at!r}")
        chain.append(at)
        at = configs[at].get("extends")
    out = known
    for one in reversed(chain):
        layer = {k: v for k, v in configs[one].items() if k != "extends"}
        _refuse_unknown(layer, known, one)
        out = merge(out, layer)
    for text in sets:
        path, eq, value = text.partition("=")
        if not eq:
            raise ValueError(f"{text!r} is no key=value")
        try:
            value = json.loads(value)
        except json.JSONDecodeError:
            pass
        for part in reversed(path.split(".")):
            value = {part: value}
        _refuse_unknown(value, known, "--set")
        out = merge(out, value)
    return out


def _refuse_unknown(layer: dict, known: dict, where: str, path: str = "") -> None:
    for k, v in layer.items():
        if k not in known:
            raise KeyError(f"{where}: unknown key {path}{k}")
        if isinstance(v, dict) and isinstance(known[k], dict):
            _refuse_unknown(v, known[k], where, f"{path}{k}.")


def to_record(value: object) -> str:
    """JSON of a record (a dataclass)."""
    return json.dumps(asdict(value), sort_keys=True)


def from_record(kind: type, text: str):
    """A record of a dataclass from its JSON: unknown and missing keys and values of another type are errors."""
    data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError(f"{kind.__name__} is read from an object")
    return _decoded(kind, data, kind.__name__)


def _decoded(kind, value, where: str):
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        if value is None and type(None) in args:
            return None
        return _decoded(next(a for a in args if a is not type(None)), value, where)
    if is_dataclass(kind):
        hints = typing.get_type_hints(kind)
        names = {f.name for f in fields(kind)}
        if not isinstance(value, dict) or set(value) != names:
            raise ValueError(f"{where}: fields must be {sorted(names)}")
        return kind(**{n: _decoded(hints[n], value[n], f"{where}.{n}") for n in names})
    if origin in (list, tuple):
        if not isinstance(value, list):
            raise ValueError(f"{where}: not a list")
        items = [_decoded(args[0], v, where) for v in value] if args else list(value)
        return items if origin is list else tuple(items)
    if origin is dict:
        if not isinstance(value, dict):
            raise ValueError(f"{where}: not an object")
        return {k: _decoded(args[1], v, f"{where}.{k}") for k, v in value.items()}
    if kind is float and type(value) is int:
        return float(value)
    if kind in (int, float, str, bool) and type(value) is not kind:
        raise ValueError(f"{where}: {value!r} is no {kind.__name__}")
    return value

"""Names for the parts that a user may replace: each registry maps a name to a function on DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from ..sources.readers import read_markdown, read_text
from .adapters import ADAPTERS
from .content import bm25, chunk_documents
from .selection import split_groups

#: records -> canonical examples with rejection_reason
DATASET_ADAPTERS = ADAPTERS
#: (examples, key, seed, ratios) -> examples with split
DATASET_SPLITTERS: dict[str, Callable[..., DataFrame]] = {"groups": split_groups}
#: (documents, target, least, most) -> chunks
CHUNKERS: dict[str, Callable[..., DataFrame]] = {"paragraphs": chunk_documents}
#: (documents, query, most) -> ranking
RETRIEVERS: dict[str, Callable[..., DataFrame]] = {"bm25": bm25}
#: (spark, path) -> documents
LOADERS: dict[str, Callable[..., DataFrame]] = {"text": read_text, "markdown": read_markdown}
#: (spark, request) -> passages
CONTENT_SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register(registry: dict[str, Callable[..., DataFrame]], name: str, part: Callable[..., DataFrame]) -> None:
    """A new name; one that is taken is an error."""
    if name in registry:
        raise KeyError(f"{name!r} is taken")
    registry[name] = part


def find(registry: dict[str, Callable[..., DataFrame]], name: str) -> Callable[..., DataFrame]:
    if name not in registry:
        raise KeyError(f"no {name!r}; there are {', '.join(sorted(registry))}")
    return registry[name]


def generate_questions(passages: DataFrame, generator: Callable[[list[dict]], list[dict]], columns: list[str], schema: str, batch: int = 16) -> DataFrame:
    """What a generator makes of passages: it gets a batch of them as dicts of the columns, and returns rows of the schema.
    No generator is part of this library."""
    ship(passages.sparkSession)
    empty = passages.sparkSession.createDataFrame([], schema).toArrow().schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                rows = generator(whole.slice(at, batch).to_pylist())
                yield pa.RecordBatch.from_pylist(rows, schema=empty)

    return passages.select(*columns).mapInArrow(work, schema)

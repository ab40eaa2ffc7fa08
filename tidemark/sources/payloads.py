"""Checkpoint payloads: bytes in one of several formats, told apart by their first bytes."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType

GZIP = b"\x1f\x8b"


def sniff(payload: bytes | None) -> tuple[str, str | None]:
    """Format and JSON text: ``gzip``, ``json``, or ``unknown`` without text."""
    if not payload:
        return "unknown", None
    kind = "json"
    if payload[:2] == GZIP:
        try:
            payload, kind = gzip.decompress(payload), "gzip"
        except (OSError, EOFError):
            return "unknown", None
    try:
        text = payload.decode()
        json.loads(text)
    except ValueError:
        return "unknown", None
    return kind, text


def _mapped(df: DataFrame, column: str, added: list[tuple[str, object]], work) -> DataFrame:
    keep = [c for c in df.columns if c != column]
    schema = df.select(*keep).schema
    for name, kind in added:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *work(b.column(column).to_pylist())], names=[*keep, *(n for n, _ in added)])

    return df.mapInArrow(run, schema)


def packed(df: DataFrame, body: str = "body", payload: str = "payload") -> DataFrame:
    """Replaces the JSON text ``body`` by its gzip bytes; the same text gives the same bytes."""
    return _mapped(df, body, [(payload, BinaryType())], lambda v: [pa.array([None if x is None else gzip.compress(x.encode(), mtime=0) for x in v], pa.binary())])


def unpacked(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Replaces payload bytes by ``format`` and ``body``."""

    def work(v: list) -> list[pa.Array]:
        each = [sniff(x) for x in v]
        return [pa.array([k for k, _ in each], pa.string()), pa.array([t for _, t in each], pa.string())]

    return _mapped(df, payload, [("format", StringType()), ("body", StringType())], work)

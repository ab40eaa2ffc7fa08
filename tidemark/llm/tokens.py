"""Counting rules for tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType

#: One Han character, or a run of other characters without white space.
TOKEN = r"[一-鿿]|[^ \t\n\r一-鿿]+"

_encoders: dict[str, object] = {}


def default_vocabulary() -> str:
    """Path of the installed public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """Encoder of a rank file; read once in each worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(encode, text: str | None) -> int:
    """Subword tokens of a whole text; 0 for null."""
    return len(encode(text)) if text else 0


def with_token_counts(df: DataFrame, text: str, out: str, vocabulary: str | None = None) -> DataFrame:
    """Replace column ``text`` by its token count ``out`` (bigint)."""
    path = vocabulary or default_vocabulary()
    keep = [c for c in df.columns if c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            n = [count_tokens(encode, t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, out])

    schema = df.select(*keep).schema.add(out, LongType())
    return df.mapInArrow(count, schema)

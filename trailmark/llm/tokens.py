"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary lies on every machine; ``spark.trailmark.tokenizer`` overrides it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary's byte-level BPE splits words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, object] = {}


def load(path: str):
    """The encoder of a vocabulary file, once per worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def vocabulary(df: DataFrame) -> str:
    """The configured vocabulary file."""
    return df.sparkSession.conf.get("spark.trailmark.tokenizer", os.environ.get("TRAILMARK_TOKENIZER", VOCABULARY))


def with_tokens(df: DataFrame, text_col: str, keep: list[str], *, path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``tokens BIGINT``, the size of ``text_col``.

    A null text has 0 tokens, as an empty one. Texts are encoded whole; only the
    kept columns and the count leave the Python worker.
    """
    path = path or vocabulary(df)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(path).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(counts, pa.int64())], names=schema.names
            )

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)

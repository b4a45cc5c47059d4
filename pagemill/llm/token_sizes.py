"""Sizes of texts in tokens of a public byte-level vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default place of the rank file; every operator takes another as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in stretches that end before a letter after white space, which changes no token.
STRETCH = 200_000


@cache
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _stretches(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > STRETCH:
        cut = at + STRETCH
        while cut > at + 1 and not (text[cut].isspace() and text[cut - 1].isalnum() and text[cut + 1 : cut + 2].isalnum()):
            cut -= 1
        if cut == at + 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    encode = encoder(vocabulary).encode_ordinary
    if len(text) <= STRETCH:
        return len(encode(text))
    return sum(len(encode(part)) for part in _stretches(text))


def sized(documents: DataFrame, columns: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``columns`` of the documents with a text, and ``tokens``; whole texts are counted, an empty one has 0."""
    kept = documents.where("doc_id is not null and text is not null").select(*columns, "text")
    schema = kept.drop("text").withColumn("tokens", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = pa.array([count_tokens(t, vocabulary) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), counts], names=[*columns, "tokens"])

    return kept.mapInArrow(run, schema)

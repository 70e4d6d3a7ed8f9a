"""Encoding of the whole corpus with a public byte-level tokenizer.

Each piece of text (by the tokenizer's split pattern) starts as its bytes. A
segment tree over the pieces' adjacent pairs holds, at a pair's position, the
rank of the merged bytes and the position in one number; the root is the
leftmost pair of the lowest rank. Merging it updates at most three leaves, each
in logarithmic time, until the root says that nothing can be merged. A piece of
n bytes takes O(n log n), so a text that is one very long run is no hazard.

Null and empty texts have the defined ids ``[]``. Rows are independent, so the
only movement is a scan; Python works on Arrow batches.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
ROWS = 500
#: Pieces remembered per worker; beyond it the memory is emptied, which costs time only.
REMEMBERED = 200_000
NONE = 1 << 60

_loaded: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Byte-pair encoding by rank for one vocabulary file of lines ``base64 rank``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece of text."""
        n = len(data)
        ranks = self.ranks
        if n == 1:
            return [ranks[data]]
        size = 1
        while size < n - 1:
            size *= 2
        parts: list[bytes] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(data[i : i + 2])
            if r is not None:
                tree[size + i] = r * size + i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    return
                tree[k] = low
                k >>= 1

        while tree[1] != NONE:
            i = tree[1] % size
            j = after[i]
            merged = parts[i] + parts[j]
            parts[i], parts[j] = merged, b""
            k = after[i] = after[j]
            if j < n - 1:
                put(j, NONE)
            if k < n:
                before[k] = i
                r = ranks.get(merged + parts[k])
                put(i, NONE if r is None else r * size + i)
            else:
                put(i, NONE)
            h = before[i]
            if h >= 0:
                r = ranks.get(parts[h] + merged)
                put(h, NONE if r is None else r * size + h)
        return [ranks[p] for p in parts if p]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known
        for word in self.split(text) if text else ():
            ids = known.get(word)
            if ids is None:
                ids = self.piece(word.encode("utf-8", "replace"))
                if len(known) >= REMEMBERED:
                    known.clear()
                known[word] = ids
            out += ids
        return out


def split_pattern(folder: str) -> str:
    """The split pattern that the vocabularies' folder states."""
    spec = importlib.util.spec_from_file_location("_vocabularies", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of a rank file, loaded once a process."""
    if (folder, vocabulary) not in _loaded:
        with open(os.path.join(folder, vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _loaded[folder, vocabulary] = Encoder(ranks, split_pattern(folder))
    return _loaded[folder, vocabulary]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of every row, without special tokens; their strings in
    a text are ordinary text. One row out for each row in, also for null ids,
    nulls (``[]``) and repeated rows; other columns are not read."""
    name = documents.schema[id_column]
    schema = T.StructType([T.StructField(id_column, name.dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, vocabulary)
        for part in _slices(batches):
            ids = pa.array([own.encode(x) for x in part.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_column, "ids"])

    return documents.select(id_column, text_column).mapInArrow(run, schema)


def count(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens): the number of token ids of every row, 0 for null and empty texts."""
    schema = T.StructType([T.StructField(id_column, documents.schema[id_column].dataType), T.StructField("tokens", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, vocabulary)
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(own.encode(x)) for x in part.column(1).to_pylist()], pa.int32())], [id_column, "tokens"])

    return documents.select(id_column, text_column).mapInArrow(run, schema)

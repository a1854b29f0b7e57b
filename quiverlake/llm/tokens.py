"""Encoding and decoding of a text column with a public vocabulary, as map-only Arrow stages."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from quiverlake.llm.bpe import Encoder, decode_stream

#: The folder of the vocabulary files; a parameter of every function here.
TOKENIZER_DIR = "/opt/tokenizers"


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One encoder a Python worker; its tables stay warm between tasks."""
    return Encoder(path)


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def _sent(df: DataFrame, path: str) -> str:
    """The file's name after it has been sent along with the job, once a context: workers need not have it."""
    sc = df.sparkSession.sparkContext
    sent = sc.__dict__.setdefault("_ql_files", {})
    name = os.path.basename(path)
    if sent.setdefault(name, path) != path:
        raise ValueError(f"two vocabulary files are called {name}: {sent[name]} and {path}")
    if f"{path}:sent" not in sent:
        sc.addFile(path)
        sent[f"{path}:sent"] = path
    return name


def _map_batches(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id_col, ids array<int>)``, one row per row of ``docs``.

    Null and empty texts give an empty list; strings of special tokens are ordinary text; repeated rows give
    repeated rows; an empty table gives an empty table; other columns are not read. No shuffle.
    """
    name = _sent(docs, path or vocabulary_path())
    kind = docs.schema[id_col].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(SparkFiles.get(name))
        ids = pa.array([encoder.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(_map_batches(one), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``(id_col, text)``: the text of each list of ids; null and empty lists give the empty text."""
    name = _sent(encoded, path or vocabulary_path())
    kind = encoded.schema[id_col].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        spelling = _encoder(SparkFiles.get(name)).transducer.spelling
        text = pa.array(["".join(decode_stream(x or (), spelling)) for x in batch.column(1).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), text], ["id", "text"])

    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(_map_batches(one), f"id {kind}, text string").withColumnRenamed("id", id_col)

"""Token-ID / binary output: flat files of unsigned integers plus 64-bit document offsets.

``write_token_files`` range-partitions the documents by ``doc_id`` and lets every task stream
one shard: ``.tokens`` (ids, little-endian, two bytes wide when the vocabulary allows it, else
four), ``.offsets`` (n + 1 little-endian 64-bit offsets in ids, from 0) and ``.docs`` (64-bit
document ids). A task writes under names of its own and returns one manifest row, so a lost
or repeated attempt leaves nothing that a reader sees. Partition bases are prefix sums over
the manifest, one row per shard. ``read_token_files`` maps shards into memory (local or
mounted folders; other stores are read in ranges) and returns one row per document.

Defined cases: null text is the empty text, which has the end id alone; a null ``doc_id`` sorts
first and reads back as null; repeated ids keep all their rows, in any order among themselves;
an empty table gives an empty manifest and no rows; other columns are ignored; a very long
text is one document like any other.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citescope.llm.batches import BATCH_BYTES, chunks, in_arrow, word_tokens

NULL_ID = -(1 << 63)  # stands for a null doc_id in the .docs file
READ_DOCS = 4096      # documents read from a shard at a time
MANIFEST = "shard int, name string, n_docs long, n_tokens long"


@dataclass
class TokenFiles:
    folder: str
    dtype: str
    shards: list[tuple[int, str, int, int, int]]  # shard, name, documents, ids, base


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def vocabulary_dtype(tokenizer: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> TokenFiles:
    """Encode ``docs`` (doc_id, text) into ``folder`` in ascending doc_id order."""
    dtype = vocabulary_dtype(tokenizer)
    end = np.array([end_id], dtype).tobytes()
    width = np.dtype(dtype).itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}"
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        tokens = word_tokens(tokenizer, dtype)
        n_docs = at = 0
        with (store.open_output_stream(f"{path}/{name}.tokens") as ids_file,
              store.open_output_stream(f"{path}/{name}.offsets") as offsets_file,
              store.open_output_stream(f"{path}/{name}.docs") as docs_file):
            offsets_file.write(np.zeros(1, "<i8").tobytes())
            for batch in chunks(batches, limit=BATCH_BYTES, tokens=True):
                encoded = [x + end for x in tokens.encode(batch.column(1))]
                ends = at + np.cumsum([len(x) // width for x in encoded])
                at = int(ends[-1])
                n_docs += len(encoded)
                ids_file.write(b"".join(encoded))
                offsets_file.write(ends.astype("<i8").tobytes())
                docs_file.write(batch.column(0).fill_null(NULL_ID).to_numpy(
                    zero_copy_only=False).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "name": pa.array([name]),
            "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([at], pa.int64())})

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
            .repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id")
            .transform(in_arrow, write, MANIFEST).collect())  # one row per shard
    shards, base = [], 0
    for r in sorted(rows, key=lambda r: r.shard):
        if r.n_docs:
            shards.append((r.shard, r.name, r.n_docs, r.n_tokens, base))
            base += r.n_tokens
    store, path = _open(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype, "shards": shards}).encode())
    return TokenFiles(folder, dtype, shards)


def open_token_files(folder: str) -> TokenFiles:
    """The files that a manifest names."""
    store, path = _open(folder)
    with store.open_input_stream(f"{path}/manifest.json") as f:
        found = json.loads(f.read())
    return TokenFiles(folder, found["dtype"], [tuple(x) for x in found["shards"]])


def _array(store: fs.FileSystem, path: str, dtype: str):
    """A function (first, last) -> values; memory-mapped where the store is a folder."""
    if isinstance(store, fs.LocalFileSystem):
        data = (np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path)
                else np.zeros(0, dtype))
        return lambda a, b: data[a:b]
    f, width = store.open_input_file(path), np.dtype(dtype).itemsize
    return lambda a, b: np.frombuffer(f.read_at((b - a) * width, a * width), dtype)


def read_token_files(spark: SparkSession, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 over the ids as
    little-endian unsigned 32-bit integers, and the ids themselves if asked for."""
    schema = ("doc_id long, start long, n_tokens long, ids_crc32 long"
              + (", ids array<long>" if with_ids else ""))
    if not files.shards:
        return spark.createDataFrame([], schema)
    folder, dtype = files.folder, files.dtype

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        for batch in batches:
            for r in batch.to_pylist():
                ids, offsets, docs = (_array(store, f"{path}/{r['name']}.{kind}", of) for kind, of
                                      in (("tokens", dtype), ("offsets", "<i8"), ("docs", "<i8")))
                for a in range(0, r["n_docs"], READ_DOCS):
                    b = min(r["n_docs"], a + READ_DOCS)
                    cuts = np.asarray(offsets(a, b + 1))
                    own = [np.asarray(ids(x, y)) for x, y in zip(cuts, cuts[1:])]
                    doc = np.asarray(docs(a, b))
                    out = {"doc_id": pa.array(doc, mask=doc == NULL_ID),
                           "start": pa.array(r["base"] + cuts[:-1]),
                           "n_tokens": pa.array(np.diff(cuts)),
                           "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes())
                                                  for x in own], pa.int64())}
                    if with_ids:
                        out["ids"] = pa.array([x.tolist() for x in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    manifest = spark.createDataFrame(files.shards, "shard int, name string, n_docs long, "
                                                   "n_tokens long, base long")
    return manifest.repartitionByRange(len(files.shards), "shard").transform(in_arrow, read, schema)

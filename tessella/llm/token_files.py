"""Operator 9: token ids in Arrow files with fixed-size-list batches.

Documents are sorted by id over the cluster; each task encodes its range,
appends the end id, cuts the stream of ids into sequences of equal length and
writes an Arrow IPC file of ``tokens`` and ``mask`` (fixed-size lists; bytes, 0 in
the padding after the last id, else 1) and an index file with a row for
each document.  Masks are dictionary-encoded, as a file has two different ones
at most: one byte a sequence, not one a token.  A file's footer holds the place of each record batch, so any
sequence can be read from a memory map without a copy.  Ids take 16 bits where
the vocabulary allows.

Each run of a task writes under names of its own, and the list of files that is
returned holds those of the run that ended, so a task that is run again after a
lost executor does no harm: what it wrote before isn't listed.  Nothing is
renamed, which suits object stores.

Defined cases: a null text is empty (only the end id); a null ``doc_id`` sorts
first; rows that repeat an id are kept, in the order of their texts' hashes; an
empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import encoder, with_end

#: Ids of a sequence, and sequences of a record batch.
SEQUENCE_LENGTH, BATCH_SEQUENCES = 2048, 64


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = "s3://" + uri.removeprefix("s3a://") if uri.startswith("s3a://") else uri
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class _Writer:
    """One file of sequences."""

    def __init__(self, sink, dtype: np.dtype, length: int):
        self.length, self.dtype = length, dtype
        self.schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), length)))])
        # the last batch adds the mask of the padded sequence to the dictionary
        self.out, self.waiting, self.n = pa.ipc.new_file(sink, self.schema, options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True)), [], 0

    def _write(self, ids: np.ndarray, valid: int) -> None:
        lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x), self.length)
        which, padded = np.zeros(len(ids) // self.length, np.int8), len(ids) - valid
        masks = np.ones((2 if padded else 1) * self.length, np.uint8)
        if padded:
            which[-1], masks[len(masks) - padded :] = 1, 0
        mask = pa.DictionaryArray.from_arrays(pa.array(which), lists(masks))
        self.out.write_batch(pa.record_batch([lists(ids), mask], schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n += len(ids)
        step = self.length * BATCH_SEQUENCES
        if self.n >= step:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // step * step
            for k in range(0, whole, step):
                self._write(flat[k : k + step], step)
            self.waiting, self.n = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.waiting)
            pad = -len(flat) % self.length
            self._write(np.concatenate([flat, np.zeros(pad, self.dtype)]), len(flat))
        self.out.close()


class TokenFile:
    """Random access to a file of sequences; local files are memory-mapped."""

    def __init__(self, uri: str):
        system, path = _file_system(uri)
        source = pa.memory_map(path) if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("tokens").type.list_size
        self._at, self._flat = -1, np.zeros(0)

    def _batch(self, k: int) -> np.ndarray:
        if k != self._at:
            self._at, self._flat = k, self.reader.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self._flat

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the i-th sequence: views of the file and of its one or two masks."""
        k, j = divmod(i, BATCH_SEQUENCES)
        batch = self.reader.get_batch(k)
        return batch.column(0)[j].values.to_numpy(), batch.column(1)[j].value.values.to_numpy()

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the file's stream."""
        step, parts = self.length * BATCH_SEQUENCES, []
        while n > 0:
            k, at = divmod(start, step)
            part = self._batch(k)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint16)])


def write_token_files(docs: DataFrame, directory: str, tokenizer: str, *, end_id: int = 2, length: int = SEQUENCE_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids; returns a row for each file pair, in stream order: part, tokens, index, n_docs, n_tokens.

    The rows are checkpointed: the files are written once, when this is called.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(directory)
        own, part = uuid.uuid4().hex, TaskContext.get().partitionId()
        system.create_dir(base, recursive=True)
        names = [f"{base}/part-{part:06d}-{own}.{kind}.arrow" for kind in ("tokens", "index")]
        code, n_docs, n = encoder(tokenizer), 0, 0
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        index_schema = pa.schema([("doc_id", first.schema.field("doc_id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        with system.open_output_stream(names[0]) as sink, system.open_output_stream(names[1]) as index_sink:
            out, index = _Writer(sink, code.dtype, length), pa.ipc.new_file(index_sink, index_schema)
            for batch in common.slices(_then(first, batches)):
                at = 0
                for ids, sizes in code.chunks(batch.column("text")):
                    ids, sizes = with_end(ids, sizes, end_id)
                    out.add(ids)
                    own = batch.column("doc_id").slice(at, len(sizes))
                    index.write_batch(pa.record_batch([own, n + np.cumsum(sizes) - sizes, sizes], schema=index_schema))
                    at += len(sizes)
                    n_docs += len(sizes)
                    n += len(ids)
            out.close()
            index.close()
        uri = directory.rstrip("/")
        yield pa.RecordBatch.from_pydict({"part": [part], "tokens": [f"{uri}/{names[0].rpartition('/')[2]}"], "index": [f"{uri}/{names[1].rpartition('/')[2]}"], "n_docs": [n_docs], "n_tokens": [n]})

    return common.checkpoint(rows.drop("tie").mapInArrow(write, "part long, tokens string, index string, n_docs long, n_tokens long"))


def _then(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    for batch in rest:
        if batch.num_rows:
            yield batch


def read_token_files(files: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """A row for each document, read from the files: doc_id, start, n_tokens, ids_crc32.

    Only the files' names and sizes pass through the driver, a row for each
    task that wrote; the running total of their sizes gives the starts.
    """
    spark = files.sparkSession
    id_type = id_type or T.LongType()
    listed, total = [], 0
    for f in sorted(files.collect(), key=lambda f: f["part"]):
        listed.append((f["tokens"], f["index"], total))
        total += f["n_tokens"]
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))])
    if not listed:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, index, offset in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                file = TokenFile(tokens)
                system, path = _file_system(index)
                with system.open_input_file(path) as source:
                    reader = pa.ipc.open_file(source)
                    for k in range(reader.num_record_batches):
                        rows = reader.get_batch(k)
                        starts, sizes = rows.column("start").to_numpy(), rows.column("n_tokens").to_numpy()
                        crc = [zlib.crc32(file.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(starts + offset), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    places = spark.createDataFrame(listed, "tokens string, index string, offset long").repartition(len(listed))
    return places.mapInArrow(read, schema)

"""Operator 9: token ids as Arrow stream files of fixed-size lists.

Each file holds the token stream of a range of ``doc_id`` in ascending order, cut into sequences of
equal length. A record batch has two fixed-size-list columns: ``tokens`` (the smallest unsigned
integer that holds the vocabulary) and ``mask`` (true for a token, false for the padding after the
last one of a file). All batches of a file but the last have equally many sequences and so equally
many bytes; a sequence's place follows from its number, and a memory-mapped file yields its tokens
without a copy. A companion file lists the documents: id, first token, number of tokens.

Files are written under another name and renamed when whole, with contents that depend on the input
only, so a task that runs again after a lost executor leaves the same file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec
from .shared import scratch_dir, steps, texts_of, written

#: Sequences in a record batch.
BATCH_ROWS = 64


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _file_schema(length: int, dtype: np.dtype, end_id: int) -> pa.Schema:
    kind = pa.from_numpy_dtype(dtype)
    return pa.schema([("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"sequence_length": str(length), "batch_rows": str(BATCH_ROWS), "end_id": str(end_id)})


class SequenceWriter:
    """Cuts a stream of tokens into sequences and writes them in batches of BATCH_ROWS."""

    def __init__(self, sink, length: int, dtype: np.dtype, end_id: int):
        self.length, self.dtype = length, dtype
        self.schema = _file_schema(length, dtype, end_id)
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_sequences = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        full = BATCH_ROWS * self.length
        if self.n_held >= full:
            flat = np.concatenate(self.held)
            whole = len(flat) // full * full
            for at in range(0, whole, full):
                self._write(flat[at : at + full], full)
            self.held, self.n_held = [flat[whole:].copy()], len(flat) - whole

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat.astype(self.dtype, copy=False), mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.n_sequences += len(flat) // self.length

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.stream.close()


@dataclass
class TokenFiles:
    """A written corpus: its folder and one row for each file, in the order of the documents."""

    folder: str
    files: list[dict]
    length: int

    def n_tokens(self) -> int:
        return sum(f["n_tokens"] for f in self.files)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, length: int = 2048, text: str = "text", doc_id: str = "doc_id", n_files: int | None = None) -> TokenFiles:
    """Encode every whole text, append ``end_id``, and write the ids in ascending order of ``doc_id``.

    A null or empty text is the end id alone; null ids come first; rows with one id follow each other
    in the order of a hash of their texts, repeated rows are written again. An empty table gives no
    file. Only one row for each file reaches the driver.
    """
    spark = docs.sparkSession
    n = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = picked.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        fs, root = _store(folder)
        part = TaskContext.get().partitionId()
        name, attempt = f"part-{part:06d}", uuid.uuid4().hex
        sink = out = index = None
        rows = 0
        for b in steps(batches):
            if sink is None:
                fs.create_dir(root, recursive=True)
                sink = [fs.open_output_stream(f"{root}/.{attempt}.{k}") for k in ("arrows", "docs")]
                out = SequenceWriter(sink[0], length, c.dtype, end_id)
                index = pa.ipc.new_stream(sink[1], _index_schema(b))
            ids, counts = c.encode_flat(texts_of(b))
            ends = np.cumsum(counts)
            sizes = counts + 1
            index.write_batch(pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(out.n_tokens + np.cumsum(sizes) - sizes), pa.array(sizes)], schema=_index_schema(b)))
            out.add(np.insert(ids, ends, end_id))
            rows += len(counts)
        if sink is None:
            return
        out.close()
        index.close()
        for s, k in zip(sink, ("arrows", "docs"), strict=True):
            s.close()
            _settle(fs, f"{root}/.{attempt}.{k}", f"{root}/{name}.{k}")
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n_docs": [rows], "n_tokens": [out.n_tokens], "n_sequences": [out.n_sequences]})

    manifest = written(ordered.mapInArrow(run, "part long, name string, n_docs long, n_tokens long, n_sequences long"))
    return TokenFiles(folder, [r.asDict() for r in manifest.orderBy("part").collect()], length)


def _index_schema(b: pa.RecordBatch) -> pa.Schema:
    return pa.schema([("doc_id", b.schema.field("doc_id").type), ("first", pa.int64()), ("n_tokens", pa.int64())])


def _settle(fs: pa.fs.FileSystem, temporary: str, final: str) -> None:
    """Rename; if another attempt at this task was first, its equal file stays."""
    try:
        fs.move(temporary, final)
    except OSError:
        if not fs.get_file_info(final).is_file:
            raise
        fs.delete_file(temporary)


def _tokens(stream: pa.ipc.RecordBatchStreamReader) -> Iterator[np.ndarray]:
    """The tokens of a file without its padding, by batch."""
    for b in stream:
        flat = b.column(0).flatten().to_numpy()
        real = b.column(1).flatten()
        yield flat[: pa.compute.sum(real).as_py() or 0]


def read_token_files(spark: SparkSession, files: TokenFiles, doc_type: str = "bigint") -> DataFrame:
    """One row for each document, from the files: doc_id, start (tokens of all documents before it),
    n_tokens and ``ids`` (its tokens as little-endian unsigned 32-bit integers, binary).

    Each file is read once, in order, by one task; a task holds one batch and one document.
    """
    starts, total = [], 0
    for f in files.files:
        starts.append((f"{files.folder}/{f['name']}", total))
        total += f["n_tokens"]
    schema = f"doc_id {doc_type}, start bigint, n_tokens bigint, ids binary"
    if not starts:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(starts, "path string, base bigint").repartition(len(starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(*(x.to_pylist() for x in b.columns), strict=True):
                fs, place = _store(path)
                with fs.open_input_file(f"{place}.arrows") as f, fs.open_input_file(f"{place}.docs") as g:
                    tokens, held, n_held = _tokens(pa.ipc.open_stream(f)), [], 0
                    for docs in pa.ipc.open_stream(g):
                        sizes = docs.column(2).to_pylist()
                        ids = []
                        for n in sizes:
                            while n_held < n:
                                held.append(next(tokens))
                                n_held += len(held[-1])
                            flat = held[0] if len(held) == 1 else np.concatenate(held)
                            ids.append(flat[:n].astype("<u4").tobytes())
                            held, n_held = [flat[n:]], n_held - n
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.compute.add(docs.column(1), base), docs.column(2), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return listed.mapInArrow(run, schema)


def sequence(path: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and mask of one sequence of a local file, straight from the memory map.

    Batches before the last have equal sizes, so the batch is found by its number alone.
    """
    source = pa.memory_map(path)
    schema = pa.ipc.read_schema(source)
    rows = int(schema.metadata[b"batch_rows"])
    at = source.tell()
    if number >= rows:
        first = pa.ipc.read_message(source)
        stride = source.tell() - at
        del first
        source.seek(at + number // rows * stride)
    batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
    length = int(schema.metadata[b"sequence_length"])
    tokens = batch.column(0).flatten().to_numpy()
    row = number % rows
    if row >= batch.num_rows:
        raise IndexError(number)
    mask = batch.column(1).slice(row, 1).flatten().to_numpy(zero_copy_only=False)
    return tokens[row * length : (row + 1) * length], mask


def write_to_scratch(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = 2048) -> TokenFiles:
    """``write_token_files`` into a fresh folder of the shared storage."""
    return write_token_files(docs, scratch_dir(docs.sparkSession), tokenizer_path, end_id, length)

"""Token ids as Arrow IPC files of fixed-size lists: equal-length sequences with masks.

Documents are dealt into ranges of doc_id (and of a text hash within it, so a repeated id can be split),
sorted, encoded, each ended with an id, and laid end to end. A range is one shard: an Arrow IPC file whose
batches hold `ids` and `mask`, fixed-size lists of `length` values; only the last sequence of a shard is
padded, with mask false. Beside it lies an Arrow file with each document's place. The width of an id is two
bytes where the vocabulary allows. A file carries the attempt in its name and counts only once its task has
returned it, so retried and speculative tasks do no harm. Opened with a memory map, a sequence or a batch is
read without a copy.

Defined cases: null text is empty and gets the end id only; rows without doc_id come first; rows of the
same doc_id are ordered by text hash; an empty table gives an empty store.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overlapse.llm.common import shared_dir

LENGTH = 2048
BATCH = 64
SHARDS = "shard int, name string, n_docs long, n_tokens long"


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


def _batch(ids: np.ndarray, n: int, length: int) -> pa.RecordBatch:
    """Sequences of ids; those from position n on are padding."""
    mask = np.arange(len(ids)) < n
    s = schema(ids.dtype, length)
    return pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=s)


def write_store(docs: DataFrame, tokenizer: str, uri: str | None = None, length: int = LENGTH, end_id: int = 0) -> tuple[str, list]:
    """Writes the store; returns its folder and its shards, in order, as (shard, name, n_docs, n_tokens)."""
    uri = uri or shared_dir(docs.sparkSession, "ids")
    kind = docs.schema["doc_id"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from overlapse.llm.pieces import pieces

        coder = pieces(tokenizer)
        where, at = _place(uri)
        where.create_dir(at, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"part-{shard:06d}-{uuid.uuid4().hex}"
        end = np.asarray([end_id], coder.dtype).tobytes()
        step = length * BATCH * coder.dtype.itemsize
        held, total, n_docs = bytearray(), 0, 0
        with where.open_output_stream(f"{at}/{name}.arrow") as f, where.open_output_stream(f"{at}/{name}.docs.arrow") as g:
            places = pa.schema([("doc_id", pa.string()), ("start", pa.int64()), ("n_tokens", pa.int64())])
            with pa.ipc.new_file(f, schema(coder.dtype, length)) as out, pa.ipc.new_file(g, places) as index:
                for b in batches:
                    texts = b.column("text").to_pylist()
                    starts, sizes = [], []
                    for lo in range(0, len(texts), 512):
                        for x in coder.encode(texts[lo : lo + 512]):
                            held += x + end
                            starts.append(total)
                            sizes.append(len(x) // coder.dtype.itemsize + 1)
                            total += sizes[-1]
                        while len(held) >= step:
                            out.write_batch(_batch(np.frombuffer(bytes(held[:step]), coder.dtype), length * BATCH, length))
                            del held[:step]
                    n_docs += len(texts)
                    index.write_batch(pa.record_batch([b.column("doc_id").cast(pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=places))
                if held:
                    ids = np.frombuffer(bytes(held), coder.dtype)
                    padded = np.zeros(-(-len(ids) // length) * length, coder.dtype)
                    padded[: len(ids)] = ids
                    out.write_batch(_batch(padded, len(ids), length))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    assert isinstance(kind, (T.IntegralType, T.StringType)), kind
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    d = d.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    # one row a shard: their number is that of the partitions, not of the documents
    shards = sorted(tuple(r) for r in d.mapInArrow(encode, SHARDS).where("n_docs > 0").collect())
    return uri, shards


class Shard:
    """A shard opened for random access; local files are memory-mapped."""

    def __init__(self, uri: str, name: str):
        where, at = _place(uri)
        local = where.type_name == "local"
        opened = (lambda p: pa.memory_map(p)) if local else where.open_input_file
        self.reader = pa.ipc.open_file(opened(f"{at}/{name}.arrow"))
        self.index = pa.ipc.open_file(opened(f"{at}/{name}.docs.arrow"))
        self.length = self.reader.schema.field("ids").type.list_size

    def batch(self, i: int) -> np.ndarray:
        """All ids of a batch, end to end, without a copy."""
        return self.reader.get_batch(i).column("ids").flatten().to_numpy()

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        b, k = self.reader.get_batch(i // BATCH), i % BATCH
        cut = lambda c: c.flatten().slice(k * self.length, self.length)
        return cut(b.column("ids")).to_numpy(), cut(b.column("mask")).to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from start on, over as many batches as they reach."""
        size, out = self.length * BATCH, []
        while n > 0:
            part = self.batch(start // size)[start % size : start % size + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(out) if len(out) != 1 else out[0]


def read_store(spark: SparkSession, uri: str, shards: list, doc_id: T.DataType = T.LongType()) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, from the files."""
    rows, before = [], 0
    for shard, name, n_docs, n_tokens in shards:
        rows.append((shard, name, before))
        before += n_tokens

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                s = Shard(uri, r["name"])
                for i in range(s.index.num_record_batches):
                    x = s.index.get_batch(i)
                    starts, sizes = x.column("start").to_numpy(), x.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(s.span(int(a), int(n)).astype("<u4").tobytes()) for a, n in zip(starts, sizes, strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": x.column("doc_id"), "start": pa.array(starts + r["before"]), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crc, pa.int64()), "shard": pa.array([r["shard"]] * len(crc), pa.int32())})

    d = spark.createDataFrame(rows, "shard int, name string, before long")
    d = d.repartition(max(1, len(rows)), "shard").mapInArrow(check, "doc_id string, start long, n_tokens long, ids_crc32 long, shard int")
    return d.withColumn("doc_id", F.col("doc_id").cast(doc_id))

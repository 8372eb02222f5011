"""Token ids in length-delimited binary record files, with a separate offset index.

A record: payload length (64 bits), masked CRC-32 of these 8 bytes, payload, masked CRC-32 of the
payload; all little-endian. Payload: doc_id (64 bits), whether it is there, bytes per id (2 or 4,
by the vocabulary), ids. The index is a Parquet table with a row for each record: part, record,
file, offset, length, the tokens of its part before it, and their number.

Each task writes one file under a name of its own and hands its index rows to Spark, which commits
them; files of lost or repeated attempts are in no index and so are never read. The index can be
read in any order or in part: a reader opens the file and seeks, and both checksums must hold.

Defined cases. Null text is empty; an empty text is a record with the end id alone. Null doc_ids
come first; equal doc_ids are ordered by text, and repeated rows each have a record. Columns
besides doc_id and text are not looked at. An empty table writes no file and an empty index.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchlife.llm.bytescan import pieces, release
from merchlife.llm.storage import Workspace, qualified, small

# Fixed values of the file format.
MASK_DELTA = 0xA282EAD8
LENGTH, CHECK, HEAD, HEAD_BYTES = "<Q", "<I", "<qBB", 10
INDEX = "part int, record long, doc_id long, file string, offset long, length long, first long, n_tokens long"
RECORDS = "part int, record long, first long, doc_id long, ids array<long>"
TOGETHER = 1 << 20  # bytes of records that are read at once, or one longer record


def masked(data: bytes) -> int:
    """CRC-32 rotated and shifted, so that a checksum of bytes that hold checksums is no fixed point."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack(LENGTH, len(payload))
    return b"".join((length, struct.pack(CHECK, masked(length)), payload, struct.pack(CHECK, masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload; an error if the record is cut or changed."""
    (n,) = struct.unpack_from(LENGTH, record)
    if struct.unpack_from(CHECK, record, 8)[0] != masked(record[:8]) or len(record) != n + 16:
        raise ValueError("a record's length is damaged")
    payload = record[12 : 12 + n]
    if struct.unpack_from(CHECK, record, 12 + n)[0] != masked(payload):
        raise ValueError("a record's payload is damaged")
    return payload


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a qualified path, by its scheme; some schemes have other names outside Hadoop."""
    scheme, rest = path.split(":", 1)
    if not rest.startswith("//"):
        rest = "//" + rest  # Hadoop writes file:/folder
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }:{rest}")


def write(docs: DataFrame, folder: str, coder: Callable, end_id: int, wide: bool) -> DataFrame:
    """Write ``docs(doc_id, text)`` in ascending doc_id order; the rows of the index. ``coder()`` is called once in each task."""
    folder = qualified(docs.sparkSession, folder)
    kind = np.dtype("<u4") if wide else np.dtype("<u2")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, name = None, None, ""
        part, record, offset, first = TaskContext.get().partitionId(), 0, 0, 0
        store, root = _place(folder)
        try:
            for batch in pieces(batches):
                if out is None:
                    encode = coder()
                    store.create_dir(root, recursive=True)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.rec"
                    out = store.open_output_stream(f"{root}/{name}")
                ids, counts = encode(batch.column("text"))
                stops = np.concatenate([[0], np.cumsum(counts)]).tolist()
                ids = ids.astype(kind)
                end = np.array([end_id], kind).tobytes()
                rows: dict[str, list] = {k: [] for k in ("doc_id", "record", "offset", "length", "first", "n_tokens")}
                for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                    data = frame(struct.pack(HEAD, doc or 0, doc is not None, kind.itemsize) + ids[stops[i] : stops[i + 1]].tobytes() + end)
                    out.write(data)
                    n = stops[i + 1] - stops[i] + 1
                    for k, v in zip(rows, (doc, record, offset, len(data), first, n), strict=True):
                        rows[k].append(v)
                    record, offset, first = record + 1, offset + len(data), first + n
                long = {k: pa.array(v, pa.int64()) for k, v in rows.items()}
                same = {"part": pa.array([part] * len(batch), pa.int32()), "file": pa.array([f"{folder}/{name}"] * len(batch))}
                yield pa.record_batch([(long | same)[c.split()[0]] for c in INDEX.split(", ")], names=[c.split()[0] for c in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return ordered.mapInArrow(run, INDEX)


def read(index: DataFrame, turn: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda batch: batch, schema: str = RECORDS) -> DataFrame:
    """(part, record, first, doc_id, ids) of the index's records, in the order in which its rows come; every checksum is verified.

    ``turn`` makes rows of ``schema`` from each batch of records in the worker that reads them, so that ids nobody
    asks for are not sent to the JVM, nor to a second worker beside the first."""

    def run(batches):
        name, store, source = None, None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("file", "offset", "length")]
            i = 0
            while i < len(batch):
                if columns[0][i] != name:
                    if source is not None:
                        source.close()
                    name = columns[0][i]
                    store, path = _place(name)
                    source = store.open_input_file(path)
                j, size = i, 0  # records that follow each other are read at once
                while j < len(batch) and columns[0][j] == name and columns[1][j] == columns[1][i] + size and (j == i or size + columns[2][j] <= TOGETHER):
                    size += columns[2][j]
                    j += 1
                source.seek(columns[1][i])
                data, at = source.read(size), 0
                docs, ids = [], []
                for n in columns[2][i:j]:
                    payload = unframe(data[at : at + n])
                    doc, there, width = struct.unpack_from(HEAD, payload)
                    docs.append(doc if there else None)
                    ids.append(np.frombuffer(payload, f"<u{width}", offset=HEAD_BYTES))
                    at += n
                cuts = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(ids).astype(np.int64)))
                rows = batch.slice(i, j - i)
                yield turn(pa.record_batch([rows.column("part"), rows.column("record"), rows.column("first"), pa.array(docs, pa.int64()), lists], names=["part", "record", "first", "doc_id", "ids"]))
                i = j
        if source is not None:
            source.close()
        release()

    return index.select("part", "record", "first", "file", "offset", "length").mapInArrow(run, schema)


def shuffled(index: DataFrame, seed: int) -> DataFrame:
    """The index in an order that ``seed`` decides."""
    return index.orderBy(F.xxhash64(F.lit(seed), "part", "record"), "part", "record")


def digests(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files; start counts the ids of all documents before."""

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("ids")
        flat, cuts = np.asarray(ids.flatten()).astype("<u4"), np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(ids)))])
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.record_batch([batch.column("part"), batch.column("first"), batch.column("doc_id"), pa.array(np.diff(cuts).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "first", "doc_id", "n_tokens", "ids_crc32"])

    rows = read(index, digest, "part int, first long, doc_id long, n_tokens long, ids_crc32 long")
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(small(before, 1_000_000), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Encode, write and index ``docs`` in the shared folder; the committed index."""
    from tokenizers import Tokenizer

    from merchlife.llm import wordbpe

    space = Workspace(docs.sparkSession, "records")
    wide = max(end_id + 1, Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)) > 1 << 16
    return space.save(write(docs, f"{space.path}/files", lambda: wordbpe.coder(path).encode, end_id, wide), "index")

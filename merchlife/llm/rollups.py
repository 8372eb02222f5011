"""Token counts kept up to date by deltas.

A batch of events inserts, deletes or revises documents' counts. It becomes signed rows: an insert
adds its count; a delete takes off the count that the ledger holds for the document and tokenizer
version; a revision takes that off and adds the new one. The signed rows are the ledger: the count of a
document is their sum. With them each batch writes its delta, their sums by source, language and
version, and the totals are the sums of the deltas: no batch reads documents or ledger rows other than
its own documents', which are looked up in the hash buckets of their ids.

Each try at a batch writes a folder of its own. It is committed by the next entry of a log, a small
file that names the batch and the folder, which is renamed into place and never replaces another, as
Spark's streaming checkpoints are. Only folders that the log names are read. If another job has taken
the entry meanwhile, the batch is looked up again: if it is committed by now, this try is dropped; if
not, its changes are made anew from the ledger as it now is. So a batch counts once, whoever sends it
how often, and batches that run side by side see each other. After ``compact`` entries the next commit
first writes a snapshot: the net ledger, the totals and the ids of all batches, in one folder.

Defined cases. Null text has no tokens. Null source or language is a group of its own. A delete or
revision of a document the ledger does not hold takes nothing off; a delete thereby says nothing.
An insert of a document it does hold is a revision. Within a batch the event with the highest
``at`` counts for a document and version, of equals the larger count. Events without doc_id are
counted like others and share one name. Other columns are not looked at. A total that returns to
zero documents and tokens is no longer shown. An empty batch is committed and changes nothing.
"""

from __future__ import annotations

import base64
import json
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlife.llm.bytescan import pieces
from merchlife.llm.storage import small

EVENT = "doc_id long, version string, kind string, source string, lang string, n_tokens long, at long"
SIGNED = "doc_id long, version string, source string, lang string, docs long, tokens long, bucket int"
TOTALS = "source string, lang string, version string, docs long, tokens long"
KEY = ("doc_id", "version")
GROUP = ("source", "lang", "version")


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens) with the tokenizer in the rank file ``path``."""

    def run(batches):
        coder = _encoding(path, pattern)
        for batch in pieces(batches):
            n = np.array([len(coder.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()], np.int64)
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array(n)], names=["doc_id", "source", "lang", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long")


def bucket_of(doc_id: str, buckets: int):
    return F.pmod(F.coalesce(F.xxhash64(F.col(doc_id)), F.lit(0)), F.lit(buckets)).cast("int")


class Rollup:
    """Committed batches in a folder of any file system that Spark reaches and that renames in one step."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, compact: int = 32):
        self.spark, self.folder, self.buckets, self.compact = spark, folder.rstrip("/"), buckets, compact

    # The log

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entry(self, number: int) -> dict | None:
        """Entry ``number``; None if there is none yet."""
        path, store = self._path(f"log/{number:012d}")
        if not store.exists(path):
            return None
        stream = store.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _append(self, number: int, entry: dict) -> bool:
        """Make ``entry`` the log's entry ``number``; False if it has one."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        log, store = self._path("log")
        store.mkdirs(log)
        made, _ = self._path(f"log/.{uuid.uuid4().hex}")
        place, _ = self._path(f"log/{number:012d}")
        stream = store.create(made, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        kept = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kept[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # an entry that is there stays
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf).rename(made, place, kept)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception.getClass()):
                raise
            return False
        finally:
            store.delete(made, False)
        return True

    def _state(self) -> tuple[int, dict | None, list[dict]]:
        """Number of the last entry, the last snapshot, and the batches after it."""
        log, store = self._path("log")
        names = [f.getPath().getName() for f in store.listStatus(log)] if store.exists(log) else []
        last = max((int(n) for n in names if n.isdigit()), default=0)
        batches: list[dict] = []
        for number in range(last, 0, -1):
            entry = self._entry(number)
            if "ids" in entry:
                return last, entry, batches[::-1]
            batches.append(entry)
        return last, None, batches[::-1]

    def _committed(self, batch: str, snapshot: dict | None, batches: list[dict]) -> bool:
        if any(e["batch"] == batch for e in batches):
            return True
        return snapshot is not None and not self.spark.read.parquet(f"{self.folder}/{snapshot['folder']}/ids").where(F.col("batch") == batch).isEmpty()

    def _read(self, kind: str, schema: str, snapshot: dict | None, batches: list[dict]) -> DataFrame:
        """A row set of the snapshot and the batches after it; at most ``compact`` folders."""
        folders = [e["folder"] for e in ([snapshot] if snapshot else []) + batches]
        out = self.spark.createDataFrame([], schema)
        for name in folders:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{kind}"))
        return out

    # Batches

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Apply ``events`` as batch ``batch``; False if that batch is committed already, and nothing is done."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id is made of letters, digits, - and _")
        last = None
        while True:
            number, snapshot, batches = self._state()
            if self._committed(batch, snapshot, batches):
                return False
            if len(batches) >= self.compact:
                self._compact(number, snapshot, batches)
                continue
            if last is None:
                last = self._last(batch, events)
            folder = self._try(batch)
            signed = self._signed(last, snapshot, batches)
            signed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{folder}/signed")
            written = self.spark.read.schema(SIGNED).parquet(f"{self.folder}/{folder}/signed")
            self._sums(written).write.parquet(f"{self.folder}/{folder}/totals")
            if self._append(number + 1, {"batch": batch, "folder": folder}):
                return True
            self._drop(folder)

    def _try(self, batch: str) -> str:
        return f"batches/{batch}-{uuid.uuid4().hex}"

    def _drop(self, folder: str) -> None:
        path, store = self._path(folder)
        store.delete(path, True)

    def _last(self, batch: str, events: DataFrame) -> DataFrame:
        """The events that count, written once: a retry after another job's commit counts no text again."""
        best = events.groupBy(*KEY).agg(F.max(F.struct("at", "n_tokens", "kind", "source", "lang")).alias("e")).select(*KEY, "e.*")
        path = f"{self.folder}/{self._try(batch)}/events"
        best.withColumn("bucket", bucket_of("doc_id", self.buckets)).write.parquet(path)
        return self.spark.read.parquet(path)

    def _signed(self, last: DataFrame, snapshot: dict | None, batches: list[dict]) -> DataFrame:
        """The signed rows that the events ``last`` amount to."""
        asked = [r[0] for r in last.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        held = self._read("signed", SIGNED, snapshot, batches).where(F.col("bucket").isin(asked))
        named = small(last.select(*(F.col(c).alias(f"asked_{c}") for c in (*KEY, "bucket"))), 200_000)
        same = F.col("bucket") == F.col("asked_bucket")
        for c in KEY:
            same = same & F.col(c).eqNullSafe(F.col(f"asked_{c}"))
        off = held.join(named, same, "left_semi").groupBy(*KEY, "source", "lang", "bucket").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
        off = off.select(*KEY, "source", "lang", (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"), "bucket")
        on = last.where("kind <> 'delete'").select(*KEY, "source", "lang", F.lit(1).cast("long").alias("docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("tokens"), "bucket")
        return off.unionByName(on)

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def _compact(self, number: int, snapshot: dict | None, batches: list[dict]) -> None:
        """Append a snapshot of all batches up to entry ``number``."""
        folder = self._try("snapshot")
        net = self._read("signed", SIGNED, snapshot, batches).groupBy(*KEY, "source", "lang", "bucket").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
        net.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{folder}/signed")
        self._sums(self._read("totals", TOTALS, snapshot, batches)).write.parquet(f"{self.folder}/{folder}/totals")
        ids = self.spark.createDataFrame([(e["batch"],) for e in batches], "batch string")
        if snapshot:
            ids = ids.union(self.spark.read.parquet(f"{self.folder}/{snapshot['folder']}/ids"))
        ids.write.parquet(f"{self.folder}/{folder}/ids")
        if not self._append(number + 1, {"folder": folder, "ids": True}):
            self._drop(folder)

    # Results

    def signed(self) -> DataFrame:
        """The signed rows of all committed batches, or the net ones since the last snapshot."""
        _, snapshot, batches = self._state()
        return self._read("signed", SIGNED, snapshot, batches)

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens), from the batches' deltas."""
        _, snapshot, batches = self._state()
        return self._sums(self._read("totals", TOTALS, snapshot, batches))


def events(rows: DataFrame, kind: str, version: str, at: int = 0) -> DataFrame:
    """Events of one kind from ``rows(doc_id, source, lang[, n_tokens])``."""
    count = F.col("n_tokens").cast("long") if "n_tokens" in rows.columns else F.lit(None).cast("long")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(version).alias("version"), F.lit(kind).alias("kind"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), count.alias("n_tokens"), F.lit(at).cast("long").alias("at"))

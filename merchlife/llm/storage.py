"""Where operators keep intermediate tables: the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_OPEN: list[Workspace] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one for a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="llm-"))
    return "file://" + _LOCAL[0]


class Workspace:
    """Tables of one run of one operator, each written once; a lost executor costs a re-read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
        _OPEN.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no pending result reads any more."""
        self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        """Remove all tables, once no pending result reads them."""
        self._delete(self.path)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def close_all(spark: SparkSession) -> None:
    """Remove the tables of all operators that this session ran, once their results are written elsewhere."""
    mine = [w for w in _OPEN if w.spark is spark]
    for space in mine:
        space.close()
        _OPEN.remove(space)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Names a row by its id and text, so that a repeated id with another text stays apart."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.lit("|"), F.col(text))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to hold at most ``rows`` rows; else as it is, and Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(docs: DataFrame, keys: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows whose ``row_key`` is in ``keys(key)``; its columns stay as they are."""
    return keyed(docs).join(small(keys.select("key").distinct(), rows), "key", "left_anti").select("row.*")


def keyed(docs: DataFrame) -> DataFrame:
    """(key, row): rows in a struct, so that no column name can clash."""
    return docs.select(row_key().alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def replaced(df: DataFrame, columns: list[str], **results: Column) -> DataFrame:
    """The columns of struct ``row``, then ``results``; a column that has a result's name, in any case, gives way to it."""
    taken = {name.lower() for name in results}
    kept = [F.col(f"row.`{c}`").alias(c) for c in columns if c.lower() not in taken]
    return df.select(*kept, *(c.alias(name) for name, c in results.items()))


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark would read it by, which tasks then need no configuration to know."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()

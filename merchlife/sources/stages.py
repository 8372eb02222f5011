"""Stage tables: the few intermediate results that several reports read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. A temporary folder serves
    only a local master, where driver and executors are one process. A cluster may name a
    mounted path, so its scheme says nothing about whether it is shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.conf.get("spark.master", "").startswith("local"):
        return tempfile.mkdtemp(prefix="merchlife-")
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


class StageStore:
    """Writes a stage once as Parquet in the shared folder and hands back the scan.

    A lost executor then costs a re-read and not the lineage; readers prune columns and
    push filters into the stage; and the file sizes tell Catalyst which sides are small
    enough to broadcast.

    A run with a name writes over the stages of the last run of that name, which bounds the
    space a scheduled job holds; without a name every store has a folder of its own.
    close() removes the folder once no result is read any more.
    """

    def __init__(self, spark: SparkSession, run: str | None = None):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/merchlife-stages/{run or uuid.uuid4().hex}"

    def save(self, name: str, df: DataFrame, split: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
        """Write a stage. With `split`, a column of few values, it is partitioned by it, and with
        `order` each file is sorted: readers' filters then leave out files and row groups. Rows
        are sorted where they are and not moved for it."""
        path = f"{self.root}/{name}"
        if split or order:
            df = df.sortWithinPartitions(*([split] if split else []), *order)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if split:
            writer = writer.partitionBy(split)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*(f"`{c}`" for c in df.columns))

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

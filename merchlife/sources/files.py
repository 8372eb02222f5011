"""Small files and folders in any file system that Spark reaches."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _open(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        where, store = self._open(folder)
        return sorted(f.getPath().getName() for f in store.listStatus(where)) if store.exists(where) else []

    def read(self, path: str) -> str:
        where, store = self._open(path)
        stream = store.open(where)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Make a file in one step; False if there is one, which stays as it is. The text is
        written beside it and renamed without replacing, as Spark's streaming checkpoints are."""
        where, store = self._open(path)
        made, _ = self._open(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
        stream = store.create(made, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        kept = self.spark.sparkContext._gateway.new_array(rename, 1)
        kept[0] = rename.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.conf).rename(made, where, kept)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception.getClass()):
                raise
            return False
        finally:
            store.delete(made, False)
        return True

    def delete(self, path: str) -> None:
        where, store = self._open(path)
        store.delete(where, True)

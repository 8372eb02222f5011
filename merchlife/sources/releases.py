"""Releases: all tables and reports of a run, replaced together in one step."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from merchlife.sources.files import Files


class Releases:
    """The releases in a folder.

    A run writes its tables and files to a folder of its own, `versions/<id>`. When all are
    there and audited, the next entry of `log` names that folder; the entry is made by a rename
    that replaces nothing, so it is the one step in which readers turn to the new release. A run
    that stops earlier leaves the last release in place, whole. The last `keep` releases stay for
    readers that have begun; older ones are removed after a commit.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self.files = Files(spark)

    def _numbers(self) -> list[int]:
        return [int(n) for n in self.files.names(f"{self.root}/log") if n.isdigit()]

    def _entry(self, number: int) -> dict:
        return json.loads(self.files.read(f"{self.root}/log/{number:012d}"))

    def number(self) -> int:
        """Of the last release; 0 if there is none."""
        return max(self._numbers(), default=0)

    def begin(self) -> Release:
        return Release(self)

    def path(self, name: str) -> str:
        """Folder of a table or report in the last release."""
        return f"{self.root}/{self._entry(self.number())['folder']}/{name}"

    def names(self) -> list[str]:
        return sorted(self._entry(self.number())["tables"])

    def read(self, name: str) -> DataFrame:
        """A table or report of the last release; it stays that release's while it is read."""
        entry = self._entry(self.number())
        kind = entry["tables"][name]["format"]
        reader = self.spark.read.option("header", True) if kind == "csv" else self.spark.read
        return reader.format(kind).load(f"{self.root}/{entry['folder']}/{name}")

    def publish(self, database: str) -> None:
        """Views of the last release's tables in a database. Each view is replaced in one step; a
        publication that was cut short is simply repeated."""
        entry = self._entry(self.number())
        for name, table in entry["tables"].items():
            if table["format"] == "parquet":
                path = f"{self.root}/{entry['folder']}/{name}"
                self.spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS SELECT * FROM parquet.`{path}`")

    def prune(self) -> None:
        """Remove the folders of all releases but the last `keep`."""
        numbers = sorted(self._numbers())
        for number in numbers[: -self.keep]:
            self.files.delete(f"{self.root}/{self._entry(number)['folder']}")


class Release:
    """One that is being written."""

    def __init__(self, releases: Releases):
        self.releases, self.spark = releases, releases.spark
        self.before = releases.number()
        self.folder = f"versions/{uuid.uuid4().hex}"
        self.tables: dict[str, dict] = {}

    def write(self, df: DataFrame, name: str, month_column: str | None = None, file_format: str = "parquet") -> None:
        """Write a table or report. With a month column it is partitioned by it, so that later
        month filters prune files; its rows are dealt by month first, so that a month has few
        files, and large months are split. The rows are counted on their way into the files."""
        if month_column:
            df = df.hint("rebalance", month_column)
        counted = Observation()
        writer = df.observe(counted, F.count(F.lit(1)).alias("rows")).write.format(file_format)
        if file_format == "csv":
            writer = writer.option("header", True)
        if month_column:
            writer = writer.partitionBy(month_column)
        writer.save(f"{self.releases.root}/{self.folder}/{name}")
        self.tables[name] = {"format": file_format, "rows": counted.get["rows"], "columns": df.columns}

    def audit(self) -> None:
        """What is in the files is what was written: rows and columns of each table."""
        for name, table in self.tables.items():
            reader = self.spark.read.option("header", True) if table["format"] == "csv" else self.spark.read
            found = reader.format(table["format"]).load(f"{self.releases.root}/{self.folder}/{name}")
            rows = found.count()
            if rows != table["rows"] or (rows and sorted(found.columns) != sorted(table["columns"])):
                raise RuntimeError(f"{name}: {table['rows']} rows were written, {rows} are there")

    def commit(self) -> None:
        """Audit, then make this the last release; an error if another run's was made meanwhile."""
        self.audit()
        entry = json.dumps({"folder": self.folder, "tables": self.tables})
        if not self.releases.files.create(f"{self.releases.root}/log/{self.before + 1:012d}", entry):
            raise RuntimeError("another run has made a release since this one began")
        self.releases.prune()

    def abort(self) -> None:
        """Remove what was written."""
        self.releases.files.delete(f"{self.releases.root}/{self.folder}")

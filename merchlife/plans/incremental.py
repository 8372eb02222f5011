"""Months of activity that are kept, and of which only the changed ones are made again."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlife.functions.columns import day, month
from merchlife.operators.activity import activity_distance, has_volume
from merchlife.params import Params
from merchlife.plans.pipeline import MerchantPipeline, stage
from merchlife.sources.files import Files
from merchlife.sources.stages import StageStore
from merchlife.sources.tables import Sources

FACTS = ["name_merchant_", "group", "billing_date_monthly", "account_create_date"]
CELL = ["name_merchant", "group", "mes"]


class KeptActivity:
    """`activity_distance` in a folder, a partition for each calendar month.

    A billing row reaches its own month and the `churn_months` after it. So the rows that came,
    went or changed since the last update, found month by month, name the (merchant, group,
    month) cells to make again: the change frontier. Their months are written by dynamic
    partition overwrite, with the other merchants' rows as they were; all other partitions stay
    untouched. Months that are new in the calendar are made for all merchants, months that left
    it are removed.

    Beside it lie the facts of the last update by billing month. They follow after the activity,
    and the calendar's bounds last: an update that was cut short finds the same changes again
    and makes the same cells again.
    """

    def __init__(self, spark: SparkSession, root: str, store: StageStore):
        self.spark, self.root, self.store = spark, root.rstrip("/"), store
        self.files = Files(spark)

    def read(self) -> DataFrame:
        kinds = "name_merchant string, inactividad long, group string, mes date"
        rows = self.spark.read.schema(kinds).parquet(f"{self.root}/activity")
        return rows.select("name_merchant", "mes", "inactividad", "group")

    def update(self, base: DataFrame, p: Params) -> list[date]:
        """Bring the activity up to `base`; the months that were written."""
        facts = self._facts(base, p)
        known = self._calendar()
        if known is None:
            rows = activity_distance(base, p)
            self._write(rows, "activity", "mes", dynamic=False)
            self._write(facts, "facts", "_month", dynamic=False)
            self._remember(p)
            return sorted(r[0] for r in self.read().select("mes").distinct().collect())
        before = self.spark.read.schema(facts.schema).parquet(f"{self.root}/facts")
        billed = self._changed_months(facts, before)
        cells = self._cells(facts, before, billed, p)
        cells = self.store.save("changed_cells", cells)
        touched = {r[0] for r in cells.select("mes").distinct().collect()}  # calendar months
        fresh = {m for m in _months(p) if not known[0] <= m <= known[1]}
        written = sorted(touched | fresh)
        if written:
            rows = self._rows(base, cells, touched - fresh, fresh, p)
            rows = self.store.save("changed_activity", rows)
            self._write(rows, "activity", "mes", dynamic=True)
            there = {r[0] for r in rows.select("mes").distinct().collect()}
            self._drop("activity", "mes", [m for m in written if m not in there])
        kept = self._partitions("activity", "mes")
        self._drop("activity", "mes", [m for m in kept if not p.first_month <= m <= p.last_month])
        if billed:
            again = self.store.save("changed_facts", facts.filter(F.col("_month").isin(*billed)))
            self._write(again, "facts", "_month", dynamic=True)
            there = {r[0] for r in again.select("_month").distinct().collect()}
            self._drop("facts", "_month", [m for m in billed if m not in there])
        self._remember(p)
        return written

    # Changes

    def _facts(self, base: DataFrame, p: Params) -> DataFrame:
        """The distinct rows and columns of the base that decide on activity."""
        billed = F.col("billing_date_monthly")
        used = has_volume() & F.col("account_create_date").isNotNull() & (billed <= day(p.last_month))
        return base.filter(used).select(*FACTS, month(billed).alias("_month")).distinct()

    def _changed_months(self, facts: DataFrame, before: DataFrame) -> list[date]:
        """Billing months whose facts differ, by their number and two sums of hashes, which are
        combined on the map side: a row for each month is all that moves."""

        def prints(df: DataFrame, side: str) -> DataFrame:
            total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
            sums = F.struct(F.count(F.lit(1)), total(*FACTS), total(F.lit("second"), *FACTS))
            return df.groupBy("_month").agg(sums.alias(side))

        both = prints(facts, "now").join(prints(before, "then"), "_month", "full")
        return sorted(r[0] for r in both.filter(~F.col("now").eqNullSafe(F.col("then"))).select("_month").collect())

    def _cells(self, facts: DataFrame, before: DataFrame, billed: list[date], p: Params) -> DataFrame:
        """(merchant, group, month) that facts reach which are on one side only."""
        inside = F.col("_month").isin(*billed) if billed else F.lit(False)
        sides = facts.filter(inside).withColumn("_side", F.lit(1)).unionByName(before.filter(inside).withColumn("_side", F.lit(-1)))
        changed = sides.groupBy(*FACTS, "_month").agg(F.sum("_side").alias("_side")).filter("_side <> 0")
        changed = changed.select(
            F.col("name_merchant_").alias("name_merchant"),
            "group",
            F.greatest(F.col("_month"), day(p.first_month)).alias("_from"),
            F.least(F.add_months("_month", p.churn_months), day(p.last_month)).alias("_to"),
        ).filter("_from <= _to")
        months = F.sequence("_from", "_to", F.expr("interval 1 month"))
        reached = changed.select("name_merchant", "group", F.explode(months).alias("mes"))
        return reached.distinct()

    def _rows(self, base: DataFrame, cells: DataFrame, touched: set[date], fresh: set[date], p: Params) -> DataFrame:
        """All rows of the months to write: the cells made again, the rest of the touched months
        as it was, and fresh months whole. Only billing rows that reach them are read."""
        reach = F.col("billing_date_monthly") >= F.add_months(day(min(touched | fresh)), -p.churn_months)
        made = activity_distance(base.filter(reach), p)
        parts = []
        if touched:
            among = F.col("mes").isin(*touched)
            on = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in CELL]
            on = on[0] & on[1] & on[2]
            parts.append(made.filter(among).alias("r").join(cells.alias("c"), on, "left_semi"))
            parts.append(self.read().filter(among).alias("r").join(cells.alias("c"), on, "left_anti"))
        if fresh:
            parts.append(made.filter(F.col("mes").isin(*fresh)))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    # Storage

    def _write(self, rows: DataFrame, name: str, column: str, dynamic: bool) -> None:
        mode = "dynamic" if dynamic else "static"
        writer = rows.hint("rebalance", column).write.mode("overwrite").option("partitionOverwriteMode", mode)
        writer.partitionBy(column).parquet(f"{self.root}/{name}")

    def _partitions(self, name: str, column: str) -> list[date]:
        names = self.files.names(f"{self.root}/{name}")
        return [date.fromisoformat(n.split("=")[1]) for n in names if n.startswith(f"{column}=")]

    def _drop(self, name: str, column: str, months: list[date]) -> None:
        for m in months:
            self.files.delete(f"{self.root}/{name}/{column}={m}")

    def _calendar(self) -> tuple[date, date] | None:
        """First and last month of the last update."""
        numbers = [int(n) for n in self.files.names(f"{self.root}/calendar") if n.isdigit()]
        if not numbers:
            return None
        known = json.loads(self.files.read(f"{self.root}/calendar/{max(numbers):012d}"))
        return date.fromisoformat(known[0]), date.fromisoformat(known[1])

    def _remember(self, p: Params) -> None:
        if self._calendar() == (p.first_month, p.last_month):
            return
        numbers = [int(n) for n in self.files.names(f"{self.root}/calendar") if n.isdigit()]
        text = json.dumps([str(p.first_month), str(p.last_month)])
        if not self.files.create(f"{self.root}/calendar/{max(numbers, default=0) + 1:012d}", text):
            raise RuntimeError("another update ran at the same time")


def _months(p: Params) -> list[date]:
    first = p.first_month.year * 12 + p.first_month.month - 1
    return [date((first + i) // 12, (first + i) % 12 + 1, 1) for i in range(p.horizon)]


class IncrementalPipeline(MerchantPipeline):
    """The pipeline with activity that is kept from run to run in a folder of its own."""

    def __init__(self, spark: SparkSession, sources: Sources, params: Params, kept: str, store: StageStore | None = None):
        super().__init__(spark, sources, params, store)
        self.kept = KeptActivity(spark, kept, self.store)
        self.written: list[date] = []

    @stage
    def activity_distance(self) -> DataFrame:
        """Brought up to date; a copy serves this run's readers, so that a later run's update
        does not change files under them."""
        self.written = self.kept.update(self.merchant_month_base(), self.p)
        return self.kept.read()

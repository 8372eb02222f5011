"""Column expressions shared by the operators. All of them stay inside codegen."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Payment methods in the column order of the activity tables.
METHODS = (
    "credit_card",
    "bank_referenced",
    "referenced",
    "bank_transfer",
    "pse",
    "debit_card",
    "cash",
    "cash_on_delivery",
    "ach",
    "lending",
)
MEASURES = ("tpt", "tpv_usd", "revenue_usd", "gm_usd")

# Fee columns per card / payment type, flat fee first.
FEE_COLUMNS = {
    "VISA": ("plana_visa", "porcentual_visa"),
    "MASTERCARD": ("plana_mc", "porcentual_mc"),
    "PSE": ("plana_pse", "porcentual_pse"),
    "EFECTY": ("plana_efecty", "porcentual_efecty"),
}
FEES = tuple(c for pair in FEE_COLUMNS.values() for c in pair)

# City groups, first match wins; a third entry is a spelling to leave out.
CITY_RULES = (
    ("%ogot%", "Bogotá and surroundings"),
    ("%Medell%", "Medellín and surroundings"),
    ("%cali", "Cali"),
    ("%cartagen%", "Cartagena"),
    ("%envigado%", "Medellín and surroundings"),
    ("%itag%", "Medellín and surroundings"),
    ("%barranq%", "Barranquilla"),
    ("%bucarama%", "Bucaramanga"),
    ("%chía%", "Bogotá and surroundings"),
    ("%chia%", "Bogotá and surroundings", "QUINCHIA"),
)
OTHER_CITIES = "Others"

USD = "decimal(38,18)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(d: date) -> Column:
    return F.lit(d)


def month(c: Column | str) -> Column:
    """First day of the month, as a date."""
    return F.trunc(col(c), "MM")


def month_diff(start: Column | str, end: Column | str) -> Column:
    """Month boundaries crossed from start to end (31 Jan to 1 Feb is 1)."""
    a, b = col(start), col(end)
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("long")


def month_number(c: Column | str) -> Column:
    """yyyymm as a number."""
    return F.month(col(c)) + F.year(col(c)) * 100


def decimal_sum(c: Column | str) -> Column:
    """Exact sum of a double column, as a decimal with 18 places.

    Amounts of up to four places are whole numbers of their ten-thousandths; these are added as
    longs, high and low bits apart so that no sum overflows, which takes half the time of decimals.
    A double is such an amount if the division gives it back. All other addends are added as
    decimals. A sum that mixes both kinds raises from 1e19 on, any other from 1e20.
    """
    x = col(c)
    units = F.rint(x * 10_000)
    plain = (units / 10_000 == x) & (F.abs(x) < 9e11)
    n = F.when(plain, units.cast("long"))
    high, low = F.sum(F.shiftright(n, 20)), F.sum(n.bitwiseAND(F.lit((1 << 20) - 1)))
    whole = high.cast("decimal(20,0)") * F.lit(1 << 20).cast("decimal(7,0)") + low.cast("decimal(20,0)")
    amounts = whole.cast("decimal(28,0)") * F.lit("0.0001").cast("decimal(4,4)")
    others = F.sum(F.when(~plain, x.cast(USD)))
    both = amounts.cast("decimal(23,4)") + others.cast("decimal(37,18)")  # of scale 18
    return F.when(others.isNull(), amounts.cast(USD)).when(amounts.isNull(), others).otherwise(both.cast(USD))


def exact_sum(c: Column | str) -> Column:
    """Sum of a double column that does not depend on the order of the rows.

    Double addition gives other last bits whenever a task is retried or a shuffle block
    arrives earlier, and the wide DISTINCTs downstream would then see two versions of one
    row. Decimals with 18 places add exactly, so small addends count in full. A value or
    sum of 1e20 or more raises, as the pipeline asks for ANSI mode.
    """
    return decimal_sum(c).cast("double")


def exact_avg(c: Column | str) -> Column:
    """Mean of the non-null values, from the exact sum."""
    return F.try_divide(exact_sum(c), F.count(col(c)))


def by_key(side: DataFrame) -> DataFrame:
    """A side of a join that has a row for each account, merchant or order: sort-merge join.

    Such a side is small as Parquet and many times that as rows. Broadcast on the strength of its
    file, it goes through the driver and into every executor until the data outgrow the threshold."""
    return side.hint("merge")


def left_join_by_month(rows: DataFrame, side: DataFrame) -> DataFrame:
    """`rows` with the columns that `side` has for their merchant and month.

    The rows are wide and often read, windowed or joined by merchant before or after. So the
    merchant alone deals them out, in one shuffle and sort for all of these, and the months are
    compared within it, where either side has a few rows for each month.
    """
    keys = ["nombre_merchant", "mes"]
    theirs = by_key(side.withColumnsRenamed({"nombre_merchant": "_merchant", "mes": "_mes"}))
    on = (F.col("nombre_merchant") == F.col("_merchant")) & (F.datediff("mes", "_mes") == 0)
    others = [c for df in (rows, side) for c in df.columns if c not in keys]
    return rows.join(theirs, on, "left").select(*keys, *others)


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def city_group(c: Column | str) -> Column:
    """City spelled in many ways to its group; NULL and unknown cities to Others."""
    value = col(c)
    found = F.lit(OTHER_CITIES)
    for pattern, group, *exceptions in reversed(CITY_RULES):
        hit = value.ilike(pattern)
        for spelling in exceptions:
            hit = hit & (value != spelling)
        found = F.when(hit, F.lit(group)).otherwise(found)
    return found


def yes_no(present: Column) -> Column:
    return F.when(present, F.lit("Yes")).otherwise(F.lit("No"))


def row_order(*extra: str) -> list[Column]:
    """Order of a merchant's rows: by month, then a tie-break that tells apart any two
    different rows of one month."""
    return [F.col(c).asc_nulls_last() for c in ("mes", "inactividad", *METHODS, *extra)]


def previous_in_merchant(c: str, *extra: str) -> Column:
    """Value of `c` in the merchant's previous row. NULL merchants have no previous row.

    A merchant has at most horizon x groups x groups rows here, whatever its share of the
    raw facts, so partitioning by merchant gives small sorts.
    """
    w = Window.partitionBy("nombre_merchant").orderBy(*row_order(*extra))
    return F.when(F.col("nombre_merchant").isNotNull(), F.lag(c).over(w))


def with_return_flag(df: DataFrame) -> DataFrame:
    """Adds mes_anterior and back_from_churn: the previous active row of the merchant is
    not in the preceding month. Several rows in one month differ by 0, which counts too."""
    return df.withColumn("mes_anterior", previous_in_merchant("mes")).withColumn(
        "back_from_churn",
        F.when(month_diff("mes", "mes_anterior") != -1, F.lit("is back")),
    )


def distinct_in_merchant(df: DataFrame) -> DataFrame:
    """DISTINCT of rows that joins by merchant follow, which need no shuffle of their own then. As
    in previous_in_merchant, a merchant has few rows here."""
    return df.repartition("nombre_merchant").distinct()


def repeat_rows(df: DataFrame, times: str, chunk: int = 10_000) -> DataFrame:
    """Each row `times` times, in two steps so that no array is longer than about
    max(chunk, times / chunk)."""
    n = F.col(times)
    outer = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / F.lit(chunk)).cast("long")))
    inner = F.explode(F.sequence(F.lit(1), F.least(n - F.col("_block") * chunk, F.lit(chunk))))
    return (
        df.withColumn("_block", outer)
        .withColumn("_copy", inner)
        .drop("_block", "_copy", times)
    )


def left_join_hot_right(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join for a right side that may hold very many rows of one key.

    A skewed partition of the right side of a left join cannot be split, because each part
    would report its left rows as unmatched. So the matches come from an inner join, where
    either side can be split, and the rest from an anti join against the distinct keys.
    Both sides are read twice: pass scans or stages, not long plans.
    """
    matched = left.join(right, keys)
    unmatched = left.join(right.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)

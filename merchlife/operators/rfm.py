"""Recency, frequency and monetary scores, segments and their migration."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchlife.functions.columns import (
    FEES,
    day,
    decimal_sum,
    left_join_by_month,
    month,
    month_diff,
    previous_in_merchant,
)
from merchlife.operators.activity import has_volume
from merchlife.operators.attributes import ACCOUNT_KEYS, REFERRED
from merchlife.operators.lifecycle import ACTIVE
from merchlife.params import Params, shift_month

RFM_COLUMNS = (
    "recencia",
    "alt_baj_recencia",
    "frecuencia_internet",
    "alt_baj_frecuencia",
    "monto",
    "alt_baj_monto",
    "rfm_group",
)
HIGH, LOW = "Alta", "Baja"
UNSCORED = "Unscored"

# Group labels by (recent, frequent, high value).
GROUPS = {
    (True, True, True): "Champion",
    (True, True, False): "Loyal",
    (True, False, True): "Big spender",
    (True, False, False): "Recent",
    (False, True, True): "At risk",
    (False, True, False): "Fading",
    (False, False, True): "Cooling",
    (False, False, False): "Low",
}

_METRICS = ("_recency", "_frequency", "_monetary")
UNITS = 10_000  # per transaction and USD in the summed metrics


def _units(total: Column) -> Column:
    return (F.round(total, 4) * UNITS).cast("long")


def rfm_values(financials: DataFrame, p: Params) -> DataFrame:
    """Per merchant and calendar month: months since the last volume, and transactions and
    volume of the scoring window. The sums are exact and then rounded to the four decimals
    of the scores' table, kept as whole numbers. Merchants without volume in the window are
    not scored. Each month is exploded to the windows it belongs to."""
    own = month("month")
    oldest = shift_month(p.first_month, 1 - p.rfm_window)
    months = F.sequence(F.col("_from"), F.col("_to"), F.expr("interval 1 month"))
    age = month_diff("_own", "mes")
    return (
        financials.filter(F.col("name_merchant").isNotNull())
        .filter((F.col("month") >= day(oldest)) & (F.col("month") < day(p.as_of_month)))
        .select(
            F.col("name_merchant").alias("nombre"),
            "tpt",
            "tpv_usd",
            own.alias("_own"),
            F.greatest(own, day(p.first_month)).alias("_from"),
            F.least(F.add_months(own, p.rfm_window - 1), day(p.last_month)).alias("_to"),
        )
        .filter(F.col("_from") <= F.col("_to"))
        .withColumn("mes", F.explode(months))
        .groupBy("nombre", "mes")
        .agg(
            F.min(F.when(has_volume(), age)).alias("_recency"),
            _units(decimal_sum("tpt")).alias("_frequency"),
            _units(decimal_sum("tpv_usd")).alias("_monetary"),
        )
        .filter(F.col("_recency").isNotNull())
    )


def _medians_wide(found: DataFrame) -> DataFrame:
    """(mes, the three medians) from (mes, metric, value)."""
    return found.groupBy("mes").agg(
        *(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"_median{m}") for m in _METRICS)
    )


def bracketed_medians(values: DataFrame, accuracy: int = 1_000) -> DataFrame:
    """Exact lower median of the three metrics per month, from two scans.

    A mergeable quantile sketch, whose size depends on its accuracy and not on the month, gives
    two values that the middle rank lies between, close together. One count then says how many
    values lie below the first and how many there are of each up to the second, which names the
    value of the middle rank. Only values inside the bracket are shuffled, already counted. The
    bounds are horizon x 3 rows, which bounds the broadcast. Where a sketch missed, the median is
    NULL, and `medians_by_digits` finds it.
    """
    rows = values.unpivot("mes", list(_METRICS), "metric", "value")
    keys = ["mes", "metric"]
    around = F.array(F.lit(0.5 - 2 / accuracy), F.lit(0.5 + 2 / accuracy))
    bounds = rows.groupBy(*keys).agg(
        F.percentile_approx("value", around, accuracy).alias("_edges"),
        F.floor((F.count(F.lit(1)) + 1) / 2).alias("_rank"),
    )
    # The sketch holds doubles, which round large numbers.
    edge = lambda i, way: way(F.col("_edges")[i], F.shiftright(F.abs(F.col("_edges")[i]), 50) + 1)
    low, high = edge(0, F.try_subtract), edge(1, F.try_add)
    counts = (
        rows.join(F.broadcast(bounds), keys)
        .filter(F.col("value") <= high)
        .groupBy(*keys, "_rank", F.when(F.col("value") >= low, F.col("value")).alias("value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    up_to = (
        Window.partitionBy(*keys)
        .orderBy(F.col("value").asc_nulls_first())  # what lies below comes first
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    middle = counts.withColumn("_up_to", F.sum("_n").over(up_to)).filter(
        (F.col("_up_to") >= F.col("_rank")) & (F.col("_up_to") - F.col("_n") < F.col("_rank"))
    )
    return _medians_wide(bounds.select(*keys).join(middle, keys, "left").select(*keys, "value"))


def medians_by_digits(values: DataFrame) -> DataFrame:
    """The same, without a sketch.

    The median is found 16 bits at a time: count the values per leading digit, keep the
    digit that holds the middle rank, go on inside it. Every pass is a map-side combined
    count with at most 65,536 digits per month and metric, so no task ever sorts or
    collects a month's merchants, which the exact percentile aggregates do. The kept
    digits are horizon x 3 rows, which bounds the broadcast.
    """
    rows = values.unpivot("mes", list(_METRICS), "metric", "value")
    keys = ["mes", "metric"]
    by_digit = Window.partitionBy(*keys).orderBy("_digit")
    up_to = by_digit.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = None
    for shift in (48, 32, 16, 0):
        if kept is None:
            inside = rows
            rank = F.floor((F.sum("_n").over(Window.partitionBy(*keys)) + 1) / 2)
        else:
            leading = rows.withColumn("_kept", F.shiftright("value", shift + 16))
            inside = leading.join(F.broadcast(kept), [*keys, "_kept"])
            rank = F.col("_rank")
        counts = inside.groupBy(
            *keys,
            F.shiftright("value", shift).alias("_digit"),
            *(["_rank"] if kept is not None else []),
        ).agg(F.count(F.lit(1)).alias("_n"))
        below = F.col("_up_to") - F.col("_n")
        kept = (
            counts.withColumn("_up_to", F.sum("_n").over(up_to))
            .withColumn("_rank", rank)
            .filter((F.col("_up_to") >= F.col("_rank")) & (below < F.col("_rank")))
            .select(*keys, F.col("_digit").alias("_kept"), (F.col("_rank") - below).alias("_rank"))
        )
    return _medians_wide(kept.withColumnRenamed("_kept", "value"))


def missed(medians: DataFrame) -> bool:
    """Whether a sketch missed; at most horizon rows are looked at."""
    wrong = F.lit(False)
    for m in _METRICS:
        wrong = wrong | F.col(f"_median{m}").isNull()
    return not medians.filter(wrong).isEmpty()


def rfm_scores(values: DataFrame, p: Params, medians: DataFrame | None = None) -> DataFrame:
    """Scores, high/low labels and group label, in the layout of the precomputed table. The
    medians are the thresholds unless the params have fixed ones."""
    if p.rfm_thresholds is None:
        scored = values.join(F.broadcast(medians), "mes")
        limits = [F.col(f"_median{m}") for m in _METRICS]
    else:
        recency, frequency, monetary = p.rfm_thresholds
        scored = values
        limits = [
            F.lit(recency),
            F.lit(round(frequency * UNITS)),
            F.lit(round(monetary * UNITS)),
        ]
    recent = F.col("_recency") <= limits[0]
    frequent = F.col("_frequency") >= limits[1]
    valuable = F.col("_monetary") >= limits[2]
    usd = F.col("_monetary").cast("decimal(20,0)") * F.lit(Decimal("0.0001"))
    return scored.select(
        "nombre",
        F.col("mes").alias("fecha_mes"),
        F.col("_recency").alias("recencia"),
        _label(recent).alias("alt_baj_recencia"),
        F.round(F.col("_frequency") / F.lit(UNITS)).cast("long").alias("frecuencia_internet"),
        _label(frequent).alias("alt_baj_frecuencia"),
        usd.cast("decimal(38,4)").alias("monto"),
        _label(valuable).alias("alt_baj_monto"),
        _group(recent, frequent, valuable).alias("rfm_group"),
    )


def _label(high: Column) -> Column:
    return F.when(high, F.lit(HIGH)).otherwise(F.lit(LOW))


def _group(recent: Column, frequent: Column, valuable: Column) -> Column:
    label = F.lit(None).cast("string")
    for (r, f, m), name in GROUPS.items():
        here = (recent == r) & (frequent == f) & (valuable == m)
        label = F.when(here, F.lit(name)).otherwise(label)
    return label


def attach_rfm(rows: DataFrame, rfm: DataFrame) -> DataFrame:
    scores = rfm.select(
        F.col("nombre").alias("nombre_merchant"), month("fecha_mes").alias("mes"), *RFM_COLUMNS
    )
    return left_join_by_month(rows, scores)


def _active_since(rows: DataFrame, p: Params) -> DataFrame:
    return rows.filter((F.col("mes") >= day(p.rfm_start)) & (F.col("estado_") == ACTIVE))


def rfm_summary(rows: DataFrame, p: Params) -> DataFrame:
    return (
        _active_since(rows, p)
        .groupBy("rfm_group", "mes", *ACCOUNT_KEYS, REFERRED, "city", "gerenciado", "update_")
        .agg(F.count(F.lit(1)).alias("cantidad"))
    )


def rfm_migration(rows: DataFrame, p: Params) -> DataFrame:
    """Active rows with the group of the merchant's previous row, by merchant and month. The sort
    is by ranges. Rows of one month that differ in attributes only are told apart by them."""
    ties = (*FEES, *ACCOUNT_KEYS, REFERRED, "ciudad")
    found = _active_since(rows, p).withColumn("last_rfm", previous_in_merchant("rfm_group", *ties))
    return found.orderBy("nombre_merchant", "mes")


def migration_matrix(moves: DataFrame, spark: SparkSession, p: Params) -> DataFrame:
    """Rows by month, previous group and group, with their share of the previous group's rows.

    The counts are sparse; the grid of all months of the report and all groups is laid over
    them, so that moves nobody made are zeros and months without rows are there. Rows without
    a score, and first rows, are in UNSCORED. A given score table may have groups of its own:
    they add cells where they occur.
    """
    last, now = (F.coalesce(c, F.lit(UNSCORED)).alias(c) for c in ("last_rfm", "rfm_group"))
    keys = ["mes", "last_rfm", "rfm_group"]
    counts = moves.select("mes", last, now).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    labels = F.array(*(F.lit(g) for g in (*GROUPS.values(), UNSCORED)))
    months = F.sequence(day(p.rfm_start), day(p.last_month), F.expr("interval 1 month"))
    grid = (
        spark.range(1)
        .select(F.explode(months).alias("mes"))
        .withColumn("last_rfm", F.explode(labels))
        .withColumn("rfm_group", F.explode(labels))
    )
    whole = Window.partitionBy("mes", "last_rfm")
    return (
        grid.join(counts, keys, "full")
        .select(*keys, F.coalesce("_n", F.lit(0).cast("long")).alias("cantidad"))
        .withColumn("participacion", F.try_divide(F.col("cantidad"), F.sum("cantidad").over(whole)))
    )

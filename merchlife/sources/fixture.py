"""Input tables derived from the TPC-H-like test tables, as FIXTURES.md describes.

Rows of a driver table become fixture rows, events only if they are sign-ups: cases such as a join without a match
are made by ids that match nothing, not by leaving rows out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from datetime import date
from threading import RLock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlife.functions.columns import by_key, exact_sum
from merchlife.params import Params
from merchlife.sources.stages import StageStore
from merchlife.sources.tables import CONTRACTS, OPTIONAL_COLUMNS, Sources, conform

FIXTURE_PARAMS = Params(
    as_of=date(2001, 9, 1),
    fee_snapshot_month=date(2001, 2, 1),
    review_month=date(2000, 11, 1),
    curve_start=date(1998, 12, 1),
    dashboard_start=date(2000, 3, 1),
    rfm_start=date(2000, 3, 1),
    cohort_start=date(1999, 1, 1),
)

# Order months run from the first to the last of these. Each customer's are moved together
# towards the last one, so that the first ones are spread over the years.
FIRST_MONTH, LAST_INDEX, STARTS, STRIDE = date(1995, 1, 1), 79, 72, 7

# Fixed values of the fixture, shared with its SQL form.
PAYMENT_METHODS = (
    "PSE",
    "CREDIT_CARD",
    "LENDING",
    "BANK_REFERENCED",
    "CASH",
    "CASH_ON_DELIVERY",
    "REFERENCED",
    "BANK_TRANSFER",
    "DEBIT_CARD",
    "ACH",
)
CITIES = (
    "Bogotá",
    "BOGOTA D.C.",
    "bogota",
    "Medellín",
    "MEDELLIN",
    "Santiago de Cali",
    "CALI",
    "Calima Darien",
    "Cartagena de Indias",
    "CARTAGENA",
    "Envigado",
    "ITAGUI",
    "Itagüí",
    "Barranquilla",
    "BARRANQUILLA",
    "Bucaramanga",
    "bucaramanga",
    "Chía",
    "CHÍA",
    "chia",
    "QUINCHIA",
    "Pereira",
    "Manizales",
    "Cúcuta",
    None,
)
SOURCES = ("OB1", "OB2", "MANUAL")
FEE_TYPES = ("VISA", "MASTERCARD", "PSE", "EFECTY")
GROUPS = {"BUILDING": "SMB", "HOUSEHOLD": "Partnership"}


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def fixture_tables(
    spark: SparkSession, folder: str, keep: Callable[[str, DataFrame], DataFrame]
) -> dict[str, Callable[[], DataFrame]]:
    """Each table as a function that makes it. What needs a shuffle is kept, once; projections
    of driver tables and of kept ones are not written again. Joins by key are merge joins:
    a key side just below the broadcast size would be many times that in the driver."""

    def kept(name: str, build: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        return _once(lambda: keep(name, build()))

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    customer = read("customer").withColumn("k", F.col("c_custkey"))
    orders = read("orders")
    lineitem = read("lineitem")
    nation = read("nation").select("n_nationkey", "n_regionkey", "n_name")
    k = F.col("k")
    text_k = k.cast("string")
    pair = F.floor(k / 2).cast("long")
    merchant = F.concat(F.lit("M"), pair.cast("string"))

    index = (F.year("o_orderdate") - FIRST_MONTH.year) * 12 + F.month("o_orderdate") - 1
    start = (F.col("o_custkey") * STRIDE) % STARTS
    moved = F.expr("_start + (_index * ({0} - _start)) div {0}".format(LAST_INDEX)).cast("int")
    orders = (
        orders.withColumns({"_index": index, "_start": start})
        .withColumn("m", F.add_months(F.lit(FIRST_MONTH), moved))
        .drop("_index", "_start")
    )
    first_order = kept(
        "first_order",
        lambda: orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min("m").alias("first_order")),
    )

    def with_first_order(rows: DataFrame) -> DataFrame:
        return rows.join(by_key(first_order()), "k", "left")

    opened = F.date_add(F.add_months("first_order", (-(k % 4)).cast("int")), (k % 28).cast("int"))
    # Some accounts have two equal rows; some another one with other attributes, which is repeated.
    versions = F.when(k % 11 == 0, F.array(F.lit(0), F.lit(1), F.lit(1))).when(
        k % 13 == 0, F.array(F.lit(0), F.lit(0))
    )
    version = F.col("version")
    account = kept(
        "account",
        lambda: with_first_order(customer)
        .withColumn("version", F.explode(F.coalesce(versions, F.array(F.lit(0)))))
        .select(
            text_k.alias("cuenta_id"),
            F.col("c_name").alias("nombre"),
            F.floor(k / 3).cast("long").alias("usuario_id"),
            opened.alias("fecha_creacion"),
            (F.col("c_nationkey") + version).cast("string").alias("codigo_mcc_id"),
            F.when((k + version) % 2 == 0, F.lit("AGGREGATOR")).otherwise(F.lit("GATEWAY")).alias(
                "modelo_pagos"
            ),
            _pick(SOURCES, k % 3).alias("fuente_creacion"),
            F.when((k + version) % 5 == 0, F.lit("r")).alias("referido_cuenta_linea"),
            _pick(CITIES, (F.col("c_nationkey") + version) % len(CITIES)).alias("ciudad"),
            (F.col("c_nationkey") + version).alias("grupo_perfil_cobranza_id"),
        ),
    )
    country = F.when(F.col("n_regionkey") == 4, F.lit("XX")).otherwise(F.lit("CO"))

    def dimension() -> DataFrame:
        located = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return with_first_order(located).select(
            "k",
            "c_name",
            "c_mktsegment",
            country.alias("country_account"),
            opened.alias("account_create_date"),
        )

    billed = kept(
        "billed",
        lambda: orders.select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice", "m").join(
            by_key(dimension()), "k"
        ),
    )
    # NULL order keys count as booked, without a merchant name.
    unbooked = F.coalesce(F.col("o_orderkey") % 50 == 0, F.lit(False))
    named = F.coalesce((F.col("o_orderkey") % 50 != 0) & (k % 10 != 0), F.lit(False))
    segment_group = F.col("c_mktsegment")
    for source, target in GROUPS.items():
        segment_group = F.when(F.col("c_mktsegment") == source, F.lit(target)).otherwise(
            segment_group
        )
    volume = F.when(F.col("o_orderkey") % 11 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice"))
    # Account and merchant follow from the key and two flags, which are narrower in the shuffle.
    client_base = kept(
        "client_base",
        lambda: billed()
        .select(
            "k",
            unbooked.alias("_unbooked"),
            named.alias("_named"),
            F.col("m").alias("month"),
            segment_group.alias("group"),
            "country_account",
            volume.alias("volume"),
        )
        .groupBy("k", "_unbooked", "_named", "month", "group", "country_account")
        .agg(F.count(F.lit(1)).cast("double").alias("tpt"), exact_sum("volume").alias("tpv_usd"))
        .select(
            F.when(F.col("_unbooked"), F.concat(F.lit("u"), text_k)).otherwise(text_k).alias("account_id"),
            F.when(F.col("_named"), merchant).alias("name_merchant"),
            "month",
            "group",
            "country_account",
            "tpt",
            "tpv_usd",
        )
        .withColumn("revenue_usd", F.col("tpv_usd") * F.lit(0.03))
        .withColumn("gm_usd", F.col("tpv_usd") * F.lit(0.01)),
    )
    # Balances and transactions are both the line items with the customer of their order.
    shipped = kept(
        "shipped",
        lambda: lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice").join(
            by_key(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("k"))),
            "l_orderkey",
        ),
    )
    item = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    part = read("part")
    months = F.sequence(F.lit(date(1995, 1, 1)), F.lit(date(2001, 12, 1)), F.expr("interval 1 month"))
    rates = spark.range(1).select(F.explode(months).alias("d")).select(
        F.year("d").alias("year"),
        F.month("d").alias("month"),
        F.when(F.col("d") == date(2000, 5, 1), F.lit("ARS")).otherwise(F.lit("COP")).alias("currency"),
        (F.lit(3000) + 10 * F.month("d") + F.year("d") - 1995).alias("usd"),
    )
    other = rates.withColumn("currency", F.lit("MXN")).withColumn("usd", F.lit(17))
    quarter_ends = F.array(*(F.lit(date(y, m, 1)) for y in (1999, 2000, 2001) for m in (3, 6, 9, 12)))
    merchants = customer.select("k")
    vip = F.when(pair % 7 == 0, F.lit("ex_vip"))
    managed = F.when(pair % 5 == 0, F.lit("gerenciado"))
    return {
        "account": account,
        "dim_account": kept(
            "dim_account",
            lambda: with_first_order(customer).select(
                text_k.alias("account_id"),
                opened.alias("account_create_date"),
            ),
        ),
        "name_map": lambda: customer.select(
            F.when(k % 10 == 0, F.concat(F.lit("x"), text_k)).otherwise(text_k).alias("account_id"),
            merchant.alias("name_merchant_2"),
        ),
        "allow_list": lambda: customer.select(
            F.when(k % 20 == 19, F.concat(F.lit("x"), text_k)).otherwise(text_k).alias("account_id")
        ),
        "agg_monthly": lambda: billed().select(
            text_k.alias("account_id"),
            F.col("c_name").alias("account_name"),
            F.col("m").alias("billing_date_monthly"),
            _pick(PAYMENT_METHODS, F.col("o_orderkey") % 10).alias("payment_method_type"),
            "account_create_date",
            "country_account",
        ),
        "client_base": client_base,
        "balance": lambda: shipped().select(
            text_k.alias("cuenta_id"),
            F.col("l_shipdate").alias("fecha_creacion"),
            F.col("l_extendedprice").alias("saldo"),
        ),
        "fx": lambda: rates.unionByName(other),
        "transaction": lambda: shipped().select(
            F.floor(k / 3).cast("long").alias("usuario_id"),
            item.alias("transaccion_id"),
            F.col("l_orderkey").alias("orden_id"),
        ),
        "dispute": lambda: lineitem.select(
            F.col("l_orderkey").alias("orden_id"),
            F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), F.lit("FRAUD"))
            .otherwise(F.lit("SERVICE"))
            .alias("motivo"),
            F.when(F.col("l_linestatus") == "F", F.lit("REFUNDED"))
            .otherwise(F.lit("OPEN"))
            .alias("estado"),
        ),
        "order": lambda: orders.select(
            F.col("o_orderkey").alias("orden_id"), F.col("o_custkey").cast("string").alias("cuenta_id")
        ),
        "transaction_amount": lambda: lineitem.select(
            item.alias("transaccion_id"),
            F.col("l_shipdate").alias("fecha_creacion"),
            F.col("l_extendedprice").alias("pm_purchase_value"),
        ),
        "fee": lambda: part.select(
            F.col("p_partkey").alias("perfil_cobranza_id"),
            F.col("p_retailprice").alias("comision_plana_comercio"),
            (F.col("p_size") / 10).alias("comision_porcentual_comercio"),
        ),
        "charge_profile": lambda: part.select(
            F.col("p_partkey").alias("perfil_cobranza_id"),
            F.floor(F.col("p_partkey") / 4).cast("int").alias("grupo_perfil_cobranza_id"),
            _pick(FEE_TYPES, F.col("p_partkey") % 4).alias("tipo_medio_pago"),
        ),
        "mcc": lambda: nation.select(
            F.col("n_nationkey").cast("string").alias("codigo"), F.col("n_name").alias("descripcion")
        ),
        "up_down": kept(
            "up_down",
            lambda: merchants.select(pair.alias("pair")).distinct().select(
                F.concat(F.lit("M"), F.col("pair").cast("string")).alias("name_merchant"),
                F.explode(quarter_ends).alias("fecha"),
                F.when(
                    F.col("pair") % 9 == 0,
                    F.when(F.col("pair") % 2 == 0, F.lit("up")).otherwise(F.lit("down")),
                ).alias("update_"),
            ),
        ),
        "segment": lambda: merchants.select(
            merchant.alias("name_merchant"),
            F.coalesce(vip, F.lit("masivo")).alias("segment"),
            F.when(vip.isNotNull(), F.lit(1)).otherwise(F.lit(3)).alias("priority"),
        ).unionByName(
            merchants.select(
                merchant.alias("name_merchant"),
                F.coalesce(managed, F.lit("masivo")).alias("segment"),
                F.when(managed.isNotNull(), F.lit(2)).otherwise(F.lit(3)).alias("priority"),
            )
        ),
        "signup": lambda: read("events").filter(F.col("event_type") == "signup").select(
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("mail"),
            F.col("ts").cast("string").alias("signup_date"),
            (F.col("user_id") % 25).cast("string").alias("mcc_code"),
            F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string")).alias("account"),
        ),
    }


def _once(build: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    lock, made = RLock(), []

    def once() -> DataFrame:
        with lock:
            if not made:
                made.append(build())
            return made[0]

    return once


@dataclass
class FixtureSources(Sources):
    """Sources whose tables may be functions: such a table is made when it is first read, so
    a query makes none that it does not need."""

    def __post_init__(self) -> None:
        pass

    def __getattribute__(self, name: str):
        value = super().__getattribute__(name)
        return value() if name in TABLE_NAMES and callable(value) else value


TABLE_NAMES = frozenset(f.name for f in fields(Sources))


def fixture_sources(spark: SparkSession, folder: str, store: StageStore) -> Sources:
    """The fixture as source tables in the layout of their contracts."""

    def conformed(name: str, build: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        return _once(lambda: conform(build(), CONTRACTS[name], OPTIONAL_COLUMNS.get(name, "")))

    tables = fixture_tables(spark, folder, lambda name, df: store.save(f"source_{name}", df))
    return FixtureSources(**{name: conformed(name, build) for name, build in tables.items()})

"""One table of merchant states: active, churned, created, signed up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlife.functions.columns import FEES, MEASURES, METHODS, USD, by_key, left_join_by_month, month, yes_no
from merchlife.operators.attributes import REFERRED
from merchlife.params import Params

# Columns and types of the state table, as the dashboard reads it.
ACTIVITY_SCHEMA: dict[str, str] = {
    "nombre_merchant": "string",
    "mes": "date",
    "inactividad": "long",
    **dict.fromkeys(MEASURES, "double"),
    **dict.fromkeys(METHODS, "long"),
    "suma_de_metodos": "long",
    "inactivo": "int",
    "fecha_creacion_nombre": "date",
    "primera_trx_nombre": "date",
    "creacion_hasta_first_trx": "long",
    "mob_first_trx": "long",
    "mob_creacion_cuenta": "long",
    "created_activated": "string",
    "mes_anterior": "date",
    "back_from_churn": "string",
    "saldo_promedio_mes": USD,
    "saldo_f_mes": USD,
    "monto_fraude": USD,
    "cantidad_fraude": "long",
    "codigo_mcc_id": "string",
    "modelo_pagos": "string",
    "fuente_creacion": "string",
    REFERRED: "string",
    "ciudad": "string",
    "city": "string",
    **dict.fromkeys(FEES, "decimal(14,2)"),
}
STATE_SCHEMA = {**ACTIVITY_SCHEMA, "estado_": "string"}
LIFECYCLE_SCHEMA = {
    **STATE_SCHEMA,
    "gerenciado": "string",
    "update_": "string",
    "primera_trx_sin": "string",
}

ACTIVE, CHURNED, CREATED, SIGNED_UP = "Activos", "Churn", "Creada", "sign_up"
MASS_SEGMENT = "masivo"


def align(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Exactly the columns of the schema, in its order; missing ones as typed NULLs."""
    present = set(df.columns)
    return df.select(
        *(
            (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)
            for name, kind in schema.items()
        )
    )


def tag_state(rows: DataFrame, state: str) -> DataFrame:
    return rows.withColumn("estado_", F.lit(state))


def active_without_rfm(rows: DataFrame) -> DataFrame:
    """The 45 activity columns, DISTINCT."""
    return align(rows, ACTIVITY_SCHEMA).distinct()


def align_active(rows: DataFrame) -> DataFrame:
    """Active rows in the state schema. They are distinct already: the attribute step
    starts with a DISTINCT, every later join has at most one different row per key, and the
    schema holds every column of theirs."""
    return align(tag_state(rows, ACTIVE), STATE_SCHEMA)


def align_churn(rows: DataFrame, p: Params) -> DataFrame:
    """Churn events without their group, DISTINCT. Their referral is still raw."""
    referred = F.col(REFERRED)
    present = referred.isNull() if p.reference_quirks else referred.isNotNull()
    flagged = rows.withColumn(REFERRED, yes_no(present)).drop("group").distinct()
    return align(tag_state(flagged, CHURNED), STATE_SCHEMA)


def align_created(rows: DataFrame, p: Params) -> DataFrame:
    """Created merchants, unique per merchant and attributes. The quirk overwrites the
    referral with a constant, which can make rows equal."""
    flagged = rows.withColumnRenamed("referidot", REFERRED)
    if p.reference_quirks:
        flagged = flagged.withColumn(REFERRED, yes_no(F.col(REFERRED).isNull())).distinct()
    return align(tag_state(flagged, CREATED), STATE_SCHEMA)


def signups(signup: DataFrame) -> DataFrame:
    """Sign-ups without an account yet, one row per mail, month and MCC."""
    rows = (
        signup.filter(F.col("account").isNull())
        .select(
            F.col("mail").alias("nombre_merchant"),
            month(F.try_to_date(F.substring("signup_date", 1, 10), "yyyy-MM-dd")).alias("mes"),
            F.col("mcc_code").alias("codigo_mcc_id"),
        )
        .distinct()
        .withColumn("fuente_creacion", F.lit("OB2"))
    )
    return align(tag_state(rows, SIGNED_UP), LIFECYCLE_SCHEMA)


def union_states(*arms: DataFrame) -> DataFrame:
    """UNION of arms that are distinct in themselves and differ in estado_: no row can be
    in two of them, so the wide DISTINCT over the union has nothing to do and is left out.
    Arms that went through attach_update_flag may repeat rows: use distinct() on those."""
    first, *rest = arms
    for arm in rest:
        first = first.unionByName(arm)
    return first


def created_without_activation(created: DataFrame, active: DataFrame) -> DataFrame:
    """Created rows whose merchant did not also start to transact in that month."""
    started = active.filter(F.col("created_activated") == "activa_mes_creada").select(
        "nombre_merchant", "mes"
    )
    return created.join(by_key(started), ["nombre_merchant", "mes"], "left_anti")


def flag_activated(created: DataFrame, active: DataFrame) -> DataFrame:
    """Created rows with flag = 1 where the merchant also started to transact in that
    month, once for each activated row."""
    started = active.filter(F.col("created_activated") == "activa_mes_creada").select(
        "nombre_merchant", "mes", F.lit(1).alias("flag")
    )
    return created.join(by_key(started), ["nombre_merchant", "mes"], "left")


def merchant_segments(segment: DataFrame) -> DataFrame:
    """The segment with the lowest priority number per merchant."""
    return segment.groupBy(F.col("name_merchant").alias("nombre_merchant")).agg(
        F.min_by("segment", "priority").alias("gerenciado")
    )


def management_segment(rows: DataFrame, segment: DataFrame) -> DataFrame:
    return rows.join(by_key(merchant_segments(segment)), "nombre_merchant", "left").withColumn(
        "gerenciado", F.coalesce("gerenciado", F.lit(MASS_SEGMENT))
    )


def attach_update_flag(rows: DataFrame, up_down: DataFrame) -> DataFrame:
    changes = up_down.select(
        F.col("name_merchant").alias("nombre_merchant"), F.col("fecha").alias("mes"), "update_"
    )
    return left_join_by_month(rows, changes)


def first_trx_marker(rows: DataFrame) -> DataFrame:
    first = F.col("mes") == F.col("primera_trx_nombre")
    return rows.withColumn("primera_trx_sin", F.when(first, F.lit("primera_sin_importar")))

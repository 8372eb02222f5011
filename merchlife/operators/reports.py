"""The dashboard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlife.functions.columns import FEES, day, exact_sum
from merchlife.operators.activity import kpi_columns
from merchlife.operators.attributes import ACCOUNT_KEYS, REFERRED
from merchlife.operators.balances import balance_columns
from merchlife.operators.cohorts import cohort_by_creation, cohort_by_first_trx
from merchlife.operators.lifecycle import ACTIVE, CHURNED, CREATED, SIGNED_UP
from merchlife.params import Params

SEGMENT_KEYS = (*ACCOUNT_KEYS, REFERRED, "city", *FEES, "gerenciado", "update_")


def month_figures(active: DataFrame) -> DataFrame:
    """Key figures, returns, activations and balances of each month, from one pass over the
    active rows with balances and return flag. A month without returns or activations has
    NULL, as if it were missing from a join."""
    returned = F.when(F.col("back_from_churn") == "is back", 1)
    activated = F.when(F.col("created_activated").isNotNull(), 1)
    return active.groupBy("mes").agg(
        *kpi_columns(),
        F.sum(returned).alias("number_back"),
        F.sum(activated).alias("primera_trx_mes_creacion"),
        *balance_columns(),
    )


def executive_dashboard(
    figures: DataFrame,
    names_created: DataFrame,
    first_trx: DataFrame,
    churn: DataFrame,
    fraud: DataFrame,
    months: int = 37,
) -> DataFrame:
    """Monthly key figures, newest months first. Every side has one row per month."""
    created = names_created.select(
        F.col("fecha_creacion").alias("mes"), F.col("cantidad").alias("cantidad_nom_creados")
    )
    sides = [
        created,
        first_trx.withColumnRenamed("primera_trx", "mes"),
        churn,
        fraud.withColumnRenamed("fecha_creacion_nombre", "mes"),
    ]
    wide = figures
    for side in sides:
        wide = wide.join(side, "mes", "left")
    without_trx = F.col("cantidad_nom_creados") - F.col("primera_trx_mes_creacion")
    return (
        wide.withColumn("cantidad_creados_no_trx", without_trx)
        .orderBy(F.col("mes").desc_nulls_first())
        .limit(months)
    )


def segment_dashboard(rows: DataFrame) -> DataFrame:
    """Key figures of all states per month and merchant attributes, in one aggregation."""
    state = F.col("estado_")
    first = (F.col("primera_trx_sin") == "primera_sin_importar") & (state == ACTIVE)
    return rows.groupBy("mes", *SEGMENT_KEYS).agg(
        F.count_if(state == ACTIVE).alias("registros"),
        F.count("back_from_churn").alias("back_from_churn_"),
        F.count("created_activated").alias("trx_mes_creacion"),
        F.sum("inactivo").alias("inactivo_"),
        exact_sum("tpt").alias("tpt_"),
        exact_sum("tpv_usd").alias("tpv_usd_"),
        exact_sum("revenue_usd").alias("revenue_usd_"),
        exact_sum("gm_usd").alias("gm_usd_"),
        F.sum("suma_de_metodos").alias("suma_de_metodos_"),
        F.sum("saldo_promedio_mes").alias("saldo_promedio_mes_sum"),
        F.sum("saldo_f_mes").alias("saldo_f_mes_sum"),
        F.sum("monto_fraude").alias("monto_fraude_sum"),
        F.sum("cantidad_fraude").alias("cantidad_fraude_sum"),
        F.count_if(state == CHURNED).alias("churn_numero"),
        F.count_if(state == CREATED).alias("creados_numero"),
        F.count_if(first).alias("primera_trx"),
        F.count_if(state == SIGNED_UP).alias("signups"),
    )


def segment_dashboard_mcc(dashboard: DataFrame, mcc: DataFrame, p: Params) -> DataFrame:
    codes = mcc.select(F.col("codigo").alias("codigo_mcc_id"), "descripcion")
    return dashboard.filter(F.col("mes") >= day(p.dashboard_start)).join(
        codes, "codigo_mcc_id", "left"
    )


def _cohort_rows(rows: DataFrame, p: Params) -> DataFrame:
    return rows.filter((F.col("mes") >= day(p.cohort_start)) & (F.col("estado_") == ACTIVE))


def cohort_first_trx_by_attributes(rows: DataFrame, p: Params) -> DataFrame:
    return cohort_by_first_trx(_cohort_rows(rows, p), *SEGMENT_KEYS)


def cohort_creation_by_attributes(rows: DataFrame, p: Params) -> DataFrame:
    return cohort_by_creation(_cohort_rows(rows, p), *SEGMENT_KEYS)

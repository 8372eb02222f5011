"""Each result of the pipeline as DuckDB SQL, in the literal form of the monthly script.

Where the pipeline explodes, pre-aggregates or partitions, the SQL here evaluates month by
month, sorts the whole table and deduplicates after every join, so that the two check each
other. Sums of doubles are exact on both sides (see functions.columns.exact_sum).
"""

from __future__ import annotations

import re
from dataclasses import replace

from merchlife.functions.columns import CITY_RULES, FEES, MEASURES, METHODS, OTHER_CITIES
from merchlife.operators.rfm import GROUPS, UNSCORED
from merchlife.params import Params
from merchlife.sources.fixture import FIXTURE_PARAMS
from verification.fixture_sql import FIXTURE


def day(d) -> str:
    return f"DATE '{d.isoformat()}'"


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def dsum(x: str) -> str:
    """Sum with 18 decimals. By way of text, as a direct cast multiplies in doubles."""
    return f"sum(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)))"


def esum(x: str) -> str:
    return f"CAST(CAST({dsum(x)} AS VARCHAR) AS DOUBLE)"


def score(x: str) -> str:
    """The sum with the four decimals of the scores' table."""
    return f"CAST(CAST(round({dsum(x)}, 4) AS VARCHAR) AS DOUBLE)"


def eavg(x: str) -> str:
    return f"{esum(x)} / nullif(count({x}), 0)"


def half_up(a: str, b: str) -> str:
    """a / b for non-negative whole numbers, rounded half up."""
    return f"((2 * ({a}) + ({b})) // (2 * ({b})))"


def usd18(milli: str, rate: str) -> str:
    """Thousandths of a local amount divided by the rate, in 1e-18 USD as a whole number."""
    return half_up(
        f"CAST({milli} AS HUGEINT) * 1000000000000000000", f"CAST({rate} AS HUGEINT) * 1000"
    )


ROW_ORDER = ", ".join(
    f"{c} ASC NULLS LAST" for c in ("nombre_merchant", "mes", "inactividad", *METHODS)
)
FEE_ORDER = ", ".join(f"{c} ASC NULLS LAST" for c in FEES)
FEE_LIST = ", ".join(FEES)
KEYS = "codigo_mcc_id, modelo_pagos, fuente_creacion, referido_cuenta_linea, city"
ALL_KEYS = f"{KEYS}, {FEE_LIST}, gerenciado, update_"

ACTIVITY = (
    "nombre_merchant s, mes d, inactividad i, "
    + ", ".join(f"{m} f" for m in MEASURES)
    + ", "
    + ", ".join(f"{m} i" for m in METHODS)
)
COUNTED = ACTIVITY + ", suma_de_metodos i, inactivo i"
MOBS = COUNTED + (
    ", fecha_creacion_nombre d, primera_trx_nombre d, creacion_hasta_first_trx i, "
    "mob_first_trx i, mob_creacion_cuenta i, created_activated s"
)
BALANCED = MOBS + ", mes_anterior d, back_from_churn s, saldo_promedio_mes q, saldo_f_mes q"
FRAUD = BALANCED + ", monto_fraude q, cantidad_fraude i"
ATTRS = "codigo_mcc_id s, modelo_pagos s, fuente_creacion s, referido_cuenta_linea s, ciudad s"
FEE_SPEC = ", ".join(f"{c} m" for c in FEES)
STATE_45 = f"{FRAUD}, {ATTRS}, city s, {FEE_SPEC}"
STATE = f"{STATE_45}, estado_ s"
SEGMENTED = f"{STATE}, gerenciado s, update_ s"
RFM_SPEC = (
    "recencia i, alt_baj_recencia s, frecuencia_internet i, alt_baj_frecuencia s, monto m, "
    "alt_baj_monto s, rfm_group s"
)
CHURN = "nombre_merchant s, mes d, inactividad i, group s"
BY_KEYS = f"codigo_mcc_id s, modelo_pagos s, fuente_creacion s, city s, {FEE_SPEC}"
DASH_KEYS = (
    "codigo_mcc_id s, modelo_pagos s, fuente_creacion s, referido_cuenta_linea s, city s, "
    f"{FEE_SPEC}, gerenciado s, update_ s"
)
DASHBOARD = (
    "mes d, registros i, back_from_churn_ i, trx_mes_creacion i, inactivo_ i, tpt_ f, "
    "tpv_usd_ f, revenue_usd_ f, gm_usd_ f, suma_de_metodos_ i, saldo_promedio_mes_sum q, "
    "saldo_f_mes_sum q, monto_fraude_sum q, cantidad_fraude_sum i, churn_numero i, "
    f"creados_numero i, primera_trx i, signups i, {DASH_KEYS}"
)
COHORT_MEANS = "tpt f, tpv f, revenue f, cantidad i"


def steps(p: Params) -> dict[str, str]:
    """Named SQL steps, in order; each may read the ones before it."""
    kept = f"NOT IN ({listed(p.excluded_accounts)})"
    groups = f"IN ({listed(p.groups)})"
    flags = ", ".join(
        f"max(CASE WHEN payment_method_type = '{m.upper()}' THEN 1 ELSE 0 END) AS {m}"
        for m in METHODS
    )
    city_rules = ", ".join(
        f"({i}, '{pattern}', '{group}', " + (f"'{rest[0]}')" if rest else "NULL)")
        for i, (pattern, group, *rest) in enumerate(CITY_RULES)
    )
    total_methods = " + ".join(METHODS)
    lag_row = f"""
        CASE WHEN lag(nombre_merchant) OVER w = nombre_merchant THEN lag(mes) OVER w END"""
    states = [c.split()[0] for c in STATE.split(", ")]
    no_activity = ", ".join(
        f"NULL AS {c}" for c in states[states.index("tpt") : states.index("codigo_mcc_id")]
    )
    rfm_labels = " ".join(
        "WHEN {} AND {} AND {} THEN '{}'".format(
            *(c if on else f"NOT ({c})" for c, on in zip(("hi_r", "hi_f", "hi_m"), key)), name
        )
        for key, name in GROUPS.items()
    )
    quirks = p.reference_quirks
    fee_sides = ", ".join(
        f"t{i}.comision_plana_comercio AS {FEES[2 * i]}, "
        f"t{i}.comision_porcentual_comercio AS {FEES[2 * i + 1]}"
        for i in range(4)
    )
    fee_joins = "\n".join(
        f"LEFT JOIN account_fees t{i} ON t{i}.cuenta_id = a.account_id "
        f"AND t{i}.tipo_medio_pago = '{m}'"
        for i, m in enumerate(("VISA", "MASTERCARD", "PSE", "EFECTY"))
    )
    return {
        **FIXTURE,
        "flags": f"""
            SELECT coalesce(c.name_merchant, b.account_name) AS name, b.billing_date_monthly,
                   c.grp, min(b.account_create_date) AS account_create_date, {flags}
            FROM src_agg_monthly b
            LEFT JOIN src_client_base c ON c.account_id = b.account_id
                 AND last_day(c.month) = last_day(b.billing_date_monthly)
            WHERE b.country_account = '{p.country}'
            GROUP BY 1, 2, 3""",
        "financials": f"""
            SELECT name_merchant, month, {", ".join(f"{esum(m)} AS {m}" for m in MEASURES)}
            FROM src_client_base
            WHERE grp {groups} AND country_account = '{p.country}'
            GROUP BY ALL""",
        "base": f"""
            SELECT flags.*, {", ".join(MEASURES)}
            FROM flags LEFT JOIN financials ON name = name_merchant
                 AND last_day(billing_date_monthly) = last_day(month)""",
        "calendar": f"""
            SELECT CAST(m AS DATE) AS mes
            FROM generate_series({day(p.first_month)}, {day(p.last_month)}, INTERVAL 1 MONTH) t(m)""",
        "evaluated": """
            SELECT mes, count(billing_date_monthly) AS registros_base FROM calendar
            LEFT JOIN base ON last_day(billing_date_monthly) = last_day(mes)
            GROUP BY mes""",
        "distance": """
            SELECT name, mes, grp, date_diff('month', max(billing_date_monthly), mes) AS inactividad
            FROM calendar JOIN base ON billing_date_monthly <= mes
                 AND account_create_date <= last_day(mes)
            WHERE tpv_usd > 0 AND tpt > 0
            GROUP BY name, mes, grp""",
        "active": f"""
            SELECT name AS name_merchant, mes, inactividad, grp AS "group"
            FROM distance WHERE inactividad < {p.churn_months}""",
        "churn": f"""
            SELECT name AS nombre_merchant, mes, inactividad, grp AS "group"
            FROM distance WHERE inactividad = {p.churn_months}""",
        "active_usage": f"""
            SELECT a.name_merchant AS nombre_merchant, a.mes, a.inactividad,
                   {", ".join((*MEASURES, *METHODS))}
            FROM active a LEFT JOIN base b
              ON b.name = a.name_merchant AND CAST(b.billing_date_monthly AS DATE) = a.mes
            WHERE a."group" {groups}""",
        "active_counted": f"""
            SELECT *, {total_methods} AS suma_de_metodos,
                   CASE WHEN inactividad >= {p.dormant_months} THEN 1 ELSE 0 END AS inactivo
            FROM active_usage""",
        "active_distinct": "SELECT DISTINCT * FROM active_counted",
        "active_zero": f"""
            SELECT * REPLACE ({", ".join(f"coalesce({m}, 0) AS {m}" for m in MEASURES)})
            FROM active_distinct""",
        "kpis": f"""
            SELECT mes, count(*) AS registros, {esum("tpt")} AS tpt, {esum("tpv_usd")} AS tpv,
                   {esum("revenue_usd")} AS revenue, {esum("gm_usd")} AS gm,
                   sum(suma_de_metodos) AS suma_metodos, sum(inactivo) AS inactivo
            FROM active_zero GROUP BY mes""",
        "creation": f"""
            SELECT name AS nombre_merchant,
                   CAST(date_trunc('month', min(account_create_date)) AS DATE) AS fecha_creacion
            FROM base WHERE account_create_date < {day(p.as_of_month)} GROUP BY name""",
        "names_created": f"""
            SELECT fecha_creacion, count(*) AS cantidad FROM (
                SELECT DISTINCT CAST(date_trunc('month', d.account_create_date) AS DATE)
                           AS fecha_creacion,
                       coalesce(n.name_merchant_2, a.nombre) AS name_merchant
                FROM src_dim_account d
                LEFT JOIN src_name_map n ON n.account_id = d.account_id
                LEFT JOIN src_account a ON a.cuenta_id = d.account_id
                WHERE d.account_id IN (SELECT account_id FROM src_allow_list)
                  AND d.account_id {kept})
            GROUP BY fecha_creacion""",
        "accounts_created": f"""
            SELECT CAST(date_trunc('month', account_create_date) AS DATE) AS fecha_creacion,
                   count(*) AS cantidad
            FROM src_dim_account
            WHERE account_id IN (SELECT account_id FROM src_allow_list) AND account_id {kept}
            GROUP BY 1""",
        "accounts_latest": """
            SELECT * FROM accounts_created ORDER BY fecha_creacion DESC NULLS FIRST LIMIT 10""",
        "first_trx": f"""
            SELECT name AS nombre_merchant, min(billing_date_monthly) AS primera_trx
            FROM base
            WHERE billing_date_monthly <= {day(p.as_of_month)} AND tpv_usd > 0 AND tpt > 0
            GROUP BY name""",
        "first_counts": """
            SELECT primera_trx, count(*) AS cantidad_primera_trx FROM first_trx GROUP BY 1""",
        "mobs": """
            SELECT z.*, c.fecha_creacion AS fecha_creacion_nombre,
                   f.primera_trx AS primera_trx_nombre,
                   date_diff('month', c.fecha_creacion, f.primera_trx) AS creacion_hasta_first_trx,
                   date_diff('month', f.primera_trx, z.mes) AS mob_first_trx,
                   date_diff('month', c.fecha_creacion, z.mes) AS mob_creacion_cuenta,
                   CASE WHEN date_diff('month', c.fecha_creacion, f.primera_trx) = 0
                             AND z.mes = f.primera_trx THEN 'activa_mes_creada' END
                       AS created_activated
            FROM active_zero z
            LEFT JOIN creation c ON c.nombre_merchant = z.nombre_merchant
            LEFT JOIN first_trx f ON f.nombre_merchant = z.nombre_merchant""",
        "curve_cells": """
            SELECT c.fecha_creacion, date_diff('month', c.fecha_creacion, f.primera_trx)
                       AS mob_first_trx, count(*) AS activas_mes_mob
            FROM creation c JOIN first_trx f ON f.nombre_merchant = c.nombre_merchant
            GROUP BY ALL""",
        "curve": f"""
            SELECT x.fecha_creacion, x.mob_first_trx, x.activas_mes_mob,
                   n.cantidad AS total_creadas, sum(y.activas_mes_mob) AS cumulative_sum,
                   {half_up("sum(y.activas_mes_mob) * 1000000000000000000", "n.cantidad")}
                       AS tasa_activacion_acum,
                   year(x.fecha_creacion) * 100 + month(x.fecha_creacion) AS fm_num
            FROM curve_cells x
            JOIN curve_cells y ON y.fecha_creacion = x.fecha_creacion
                 AND y.mob_first_trx <= x.mob_first_trx
            LEFT JOIN names_created n ON n.fecha_creacion = x.fecha_creacion
            GROUP BY x.fecha_creacion, x.mob_first_trx, x.activas_mes_mob, n.cantidad""",
        "curve_report": f"SELECT * FROM curve WHERE fecha_creacion >= {day(p.curve_start)}",
        "cohort_created": f"""
            SELECT fecha_creacion_nombre, mob_creacion_cuenta, {eavg("tpt")} AS tpt,
                   {eavg("tpv_usd")} AS tpv, {eavg("revenue_usd")} AS revenue, count(*) AS cantidad
            FROM mobs GROUP BY 1, 2""",
        "cohort_trx": f"""
            SELECT primera_trx_nombre, mob_first_trx, {eavg("tpt")} AS tpt,
                   {eavg("tpv_usd")} AS tpv, {eavg("revenue_usd")} AS revenue, count(*) AS cantidad
            FROM mobs GROUP BY 1, 2""",
        "returning_rows": f"""
            SELECT *, CASE WHEN date_diff('month', mes, mes_anterior) <> -1 THEN 'is back' END
                       AS back_from_churn
            FROM (SELECT *, {lag_row} AS mes_anterior
                  FROM mobs WINDOW w AS (ORDER BY {ROW_ORDER}))""",
        "returned": """
            SELECT mes, back_from_churn, count(*) AS number_back FROM returning_rows
            WHERE back_from_churn = 'is back' GROUP BY 1, 2""",
        "review": f"""
            SELECT nombre_merchant FROM returning_rows WHERE mes = {day(p.review_month)}""",
        "activated": """
            SELECT mes, count(*) AS primera_trx_mes_creacion FROM mobs
            WHERE created_activated IS NOT NULL GROUP BY mes""",
        "avg_balance": f"""
            SELECT cuenta_id AS account_id,
                   CAST(date_trunc('month', fecha_creacion) AS DATE) AS fecha_saldo,
                   {eavg("saldo")} AS saldo,
                   CAST(sum(CAST(saldo AS DECIMAL(18, 4))) * 10000 AS HUGEINT) AS total,
                   count(saldo) AS n
            FROM src_balance
            WHERE cuenta_id IN (SELECT account_id FROM src_allow_list) AND cuenta_id {kept}
            GROUP BY 1, 2""",
        "end_balance": f"""
            SELECT cuenta_id AS account_id,
                   CAST(date_trunc('month', fecha_creacion) AS DATE) AS fecha_saldo, saldo,
                   'last' AS es_ultimo
            FROM src_balance
            WHERE CAST(fecha_creacion AS DATE) = last_day(fecha_creacion)
              AND cuenta_id IN (SELECT account_id FROM src_allow_list) AND cuenta_id {kept}""",
        "balances": f"""
            SELECT name_merchant, fecha_saldo, sum(q1) AS saldo_promedio_mes,
                   sum(q2) AS saldo_f_mes
            FROM (SELECT DISTINCT coalesce(n.name_merchant_2, a.nombre) AS name_merchant,
                         b.fecha_saldo,
                         {usd18(half_up("b.total", "10 * b.n"), "x.usd")} AS q1,
                         {usd18("CAST(e.saldo AS DECIMAL(20, 3)) * 1000", "x.usd")} AS q2
                  FROM avg_balance b
                  LEFT JOIN end_balance e ON e.account_id = b.account_id
                       AND e.fecha_saldo = b.fecha_saldo
                  LEFT JOIN src_name_map n ON n.account_id = b.account_id
                  LEFT JOIN src_account a ON a.cuenta_id = b.account_id
                  LEFT JOIN src_fx x ON x.year = year(b.fecha_saldo)
                       AND x.month = month(b.fecha_saldo) AND x.currency = '{p.fx_currency}')
            GROUP BY 1, 2""",
        "active_balances": """
            SELECT r.*, b.saldo_promedio_mes, b.saldo_f_mes
            FROM returning_rows r LEFT JOIN balances b
              ON b.name_merchant = r.nombre_merchant AND b.fecha_saldo = r.mes""",
        "month_balances": f"""
            SELECT mes, {half_up("sum(saldo_promedio_mes)", "count(saldo_promedio_mes)")}
                       AS saldo_promedio_mes_nombre,
                   {half_up("sum(saldo_f_mes)", "count(saldo_f_mes)")} AS saldo_f_mes_nombre,
                   sum(saldo_promedio_mes) AS saldo_promedio_mes_sum,
                   sum(saldo_f_mes) AS saldo_f_mes_sum
            FROM active_balances GROUP BY mes""",
        "churn_months": f"""
            SELECT mes, count(*) AS cantidad_churn FROM churn WHERE "group" {groups}
            GROUP BY mes""",
        "status": f"""
            SELECT name AS name_merchant, grp AS "group", gap AS inactividad,
                   CASE WHEN gap < {p.dormant_months} THEN 'active'
                        WHEN gap < {p.churn_months} THEN 'dormant' ELSE 'churner' END AS status
            FROM (SELECT name, grp,
                         date_diff('month', max(billing_date_monthly), {day(p.last_month)}) AS gap
                  FROM base
                  WHERE tpv_usd > 0 AND tpt > 0 AND billing_date_monthly <= {day(p.last_month)}
                    AND account_create_date <= last_day({day(p.last_month)})
                  GROUP BY name, grp)""",
        "mix": f"""
            SELECT name_merchant, payment_method_type, count(*) AS cantidad,
                   count(*) / sum(count(*)) OVER (PARTITION BY name_merchant) AS participacion
            FROM (SELECT coalesce(c.name_merchant, b.account_name) AS name_merchant,
                         b.payment_method_type
                  FROM src_agg_monthly b
                  LEFT JOIN src_client_base c ON c.account_id = b.account_id
                       AND last_day(c.month) = last_day(b.billing_date_monthly)
                  WHERE b.country_account = '{p.country}')
            GROUP BY name_merchant, payment_method_type""",
        "disputed": """
            SELECT t.usuario_id, t.transaccion_id, t.orden_id
            FROM src_transaction t JOIN src_dispute d ON d.orden_id = t.orden_id
            WHERE d.motivo = 'FRAUD' AND d.estado = 'REFUNDED'""",
        "fraud_rows": f"""
            SELECT o.cuenta_id, d.* FROM disputed d JOIN src_order o ON o.orden_id = d.orden_id
            WHERE o.cuenta_id IN (SELECT account_id FROM src_allow_list) AND o.cuenta_id {kept}""",
        "fraud_value": f"""
            SELECT name_merchant, cuenta_id, usuario_id, transaccion_id, orden_id,
                   fecha_creacion_nombre, q AS pm_purchase_value
            FROM (SELECT DISTINCT coalesce(n.name_merchant_2, a.nombre) AS name_merchant, f.*,
                         CAST(date_trunc('month', v.fecha_creacion) AS DATE)
                             AS fecha_creacion_nombre,
                         {usd18("CAST(v.pm_purchase_value AS DECIMAL(20, 3)) * 1000", "x.usd")} AS q
                  FROM fraud_rows f
                  LEFT JOIN src_name_map n ON n.account_id = f.cuenta_id
                  LEFT JOIN src_account a ON a.cuenta_id = f.cuenta_id
                  LEFT JOIN src_amount v ON v.transaccion_id = f.transaccion_id
                  LEFT JOIN src_fx x ON x.year = year(v.fecha_creacion)
                       AND x.month = month(v.fecha_creacion) AND x.currency = '{p.fx_currency}')""",
        "fraud_merchant": """
            SELECT name_merchant, fecha_creacion_nombre, sum(pm_purchase_value) AS monto_fraude,
                   count(*) AS cantidad_fraude
            FROM fraud_value GROUP BY 1, 2""",
        "fraud_month": """
            SELECT fecha_creacion_nombre, sum(cantidad_fraude) AS cantidad_fraud,
                   sum(monto_fraude) AS monto_fraude
            FROM fraud_merchant GROUP BY 1""",
        "active_fraud": """
            SELECT b.*, coalesce(f.monto_fraude, 0) AS monto_fraude,
                   coalesce(f.cantidad_fraude, 0) AS cantidad_fraude
            FROM active_balances b LEFT JOIN fraud_merchant f
              ON f.name_merchant = b.nombre_merchant AND f.fecha_creacion_nombre = b.mes""",
        "executive": """
            SELECT k.*, n.cantidad AS cantidad_nom_creados, r.number_back,
                   f.cantidad_primera_trx,
                   n.cantidad - a.primera_trx_mes_creacion AS cantidad_creados_no_trx,
                   a.primera_trx_mes_creacion, b.* EXCLUDE (mes), c.cantidad_churn,
                   x.monto_fraude, x.cantidad_fraud
            FROM kpis k
            LEFT JOIN names_created n ON n.fecha_creacion = k.mes
            LEFT JOIN returned r ON r.mes = k.mes
            LEFT JOIN first_counts f ON f.primera_trx = k.mes
            LEFT JOIN activated a ON a.mes = k.mes
            LEFT JOIN month_balances b ON b.mes = k.mes
            LEFT JOIN churn_months c ON c.mes = k.mes
            LEFT JOIN fraud_month x ON x.fecha_creacion_nombre = k.mes
            ORDER BY k.mes DESC LIMIT 37""",
        "ranked_accounts": f"""
            SELECT *, CASE WHEN lag(nombre_merchant) OVER (
                               ORDER BY nombre_merchant, tpt_total DESC NULLS FIRST, account_id
                           ) = nombre_merchant THEN 0 ELSE 1 END AS lag_max
            FROM (SELECT DISTINCT coalesce(n.name_merchant_2, a.nombre) AS nombre_merchant,
                         t.account_id, t.tpt_total
                  FROM (SELECT account_id, {esum("tpt")} AS tpt_total FROM src_client_base
                        WHERE account_id IN (SELECT account_id FROM src_allow_list)
                          AND account_id {kept}
                        GROUP BY account_id) t
                  LEFT JOIN src_name_map n ON n.account_id = t.account_id
                  LEFT JOIN src_account a ON a.cuenta_id = t.account_id)""",
        "top_accounts": """
            SELECT nombre_merchant, account_id, tpt_total FROM ranked_accounts WHERE lag_max = 1""",
        "top_details": """
            SELECT t.nombre_merchant, t.account_id, a.codigo_mcc_id, a.modelo_pagos,
                   a.fuente_creacion, a.referido_cuenta_linea, a.ciudad
            FROM top_accounts t LEFT JOIN src_account a ON a.cuenta_id = t.account_id
                 AND a.cuenta_id IN (SELECT account_id FROM src_allow_list)""",
        "city_rules": f"""
            SELECT * FROM (VALUES {city_rules}) v(ord, pattern, city, except_for)""",
        "cities": f"""
            SELECT ciudad, coalesce(arg_min(city, ord), '{OTHER_CITIES}') AS city
            FROM (SELECT DISTINCT ciudad FROM src_account) s LEFT JOIN city_rules
              ON ciudad ILIKE pattern AND (except_for IS NULL OR ciudad <> except_for)
            GROUP BY ciudad""",
        "active_with_mcc": """
            SELECT DISTINCT a.*, t.codigo_mcc_id
            FROM active_fraud a LEFT JOIN top_details t ON t.nombre_merchant = a.nombre_merchant""",
        "active_attrs": """
            SELECT DISTINCT a.*, t.modelo_pagos, t.fuente_creacion,
                   CASE WHEN t.referido_cuenta_linea IS NULL THEN 'No' ELSE 'Yes' END
                       AS referido_cuenta_linea,
                   t.ciudad
            FROM active_with_mcc a
            LEFT JOIN top_details t ON t.nombre_merchant = a.nombre_merchant""",
        "active_cities": f"""
            SELECT a.*, coalesce(c.city, '{OTHER_CITIES}') AS city
            FROM active_attrs a LEFT JOIN cities c ON c.ciudad = a.ciudad""",
        "account_fees": """
            SELECT a.cuenta_id, f.comision_plana_comercio, f.comision_porcentual_comercio,
                   g.tipo_medio_pago
            FROM src_fee f
            LEFT JOIN src_charge_profile g ON g.perfil_cobranza_id = f.perfil_cobranza_id
            LEFT JOIN src_account a ON a.grupo_perfil_cobranza_id = g.grupo_perfil_cobranza_id
            WHERE g.tipo_medio_pago IN ('VISA', 'MASTERCARD', 'PSE', 'EFECTY')""",
        "fee_columns": f"""
            SELECT a.nombre_merchant, {fee_sides} FROM top_details a {fee_joins}""",
        "active_fee_rows": f"""
            SELECT DISTINCT a.*, {FEE_LIST} FROM active_cities a LEFT JOIN fee_columns f
              ON f.nombre_merchant = a.nombre_merchant AND a.mes = {day(p.fee_snapshot_month)}""",
        "rfm_ages": f"""
            SELECT f.name_merchant AS nombre, c.mes, f.tpt, f.tpv_usd,
                   date_diff('month', f.month, c.mes) AS age
            FROM financials f JOIN calendar c
              ON date_diff('month', f.month, c.mes) BETWEEN 0 AND {p.rfm_window - 1}
            WHERE f.name_merchant IS NOT NULL""",
        "rfm_raw": f"""
            SELECT nombre, mes, min(age) FILTER (WHERE tpv_usd > 0 AND tpt > 0) AS r,
                   {score("tpt")} AS f, {score("tpv_usd")} AS m
            FROM rfm_ages GROUP BY ALL HAVING r IS NOT NULL""",
        "rfm_ranks": """
            SELECT *, row_number() OVER (PARTITION BY mes ORDER BY r) AS rank_r,
                   row_number() OVER (PARTITION BY mes ORDER BY f) AS rank_f,
                   row_number() OVER (PARTITION BY mes ORDER BY m) AS rank_m,
                   (count(*) OVER (PARTITION BY mes) + 1) // 2 AS middle
            FROM rfm_raw""",
        "rfm_medians": """
            SELECT mes, max(r) FILTER (WHERE rank_r = middle) AS med_r,
                   max(f) FILTER (WHERE rank_f = middle) AS med_f,
                   max(m) FILTER (WHERE rank_m = middle) AS med_m
            FROM rfm_ranks GROUP BY mes""",
        "rfm_flags": """
            SELECT v.*, r <= med_r AS hi_r, f >= med_f AS hi_f, m >= med_m AS hi_m
            FROM rfm_raw v JOIN rfm_medians USING (mes)""",
        "rfm_table": f"""
            SELECT nombre, mes AS fecha_mes, r AS recencia,
                   CASE WHEN hi_r THEN 'Alta' ELSE 'Baja' END AS alt_baj_recencia,
                   CAST(round(f) AS BIGINT) AS frecuencia_internet,
                   CASE WHEN hi_f THEN 'Alta' ELSE 'Baja' END AS alt_baj_frecuencia,
                   m AS monto, CASE WHEN hi_m THEN 'Alta' ELSE 'Baja' END AS alt_baj_monto,
                   CASE {rfm_labels} END AS rfm_group
            FROM rfm_flags""",
        "active_scored": """
            SELECT a.*, r.* EXCLUDE (nombre, fecha_mes) FROM active_fee_rows a
            LEFT JOIN rfm_table r ON r.nombre = a.nombre_merchant AND r.fecha_mes = a.mes""",
        "active_45": f"""
            SELECT DISTINCT {", ".join(states[:-1])} FROM active_scored""",
        "back_by_attrs": f"""
            SELECT mes, back_from_churn, codigo_mcc_id, modelo_pagos, fuente_creacion,
                   {"'Yes'" if quirks else "referido_cuenta_linea"} AS referidot, city, {FEE_LIST},
                   rfm_group, count(*) AS cantidad_back
            FROM active_scored WHERE back_from_churn IS NOT NULL GROUP BY ALL""",
        "activated_by_attrs": f"""
            SELECT mes, created_activated, codigo_mcc_id, modelo_pagos, fuente_creacion,
                   {"'Yes'" if quirks else "referido_cuenta_linea"} AS referidot, city, {FEE_LIST},
                   rfm_group, count(*) AS trx_creation_month
            FROM active_scored WHERE created_activated IS NOT NULL GROUP BY ALL""",
        "first_by_attrs": f"""
            SELECT primera_trx_nombre, codigo_mcc_id, modelo_pagos, fuente_creacion,
                   {"'Yes'" if quirks else "referido_cuenta_linea"} AS referidot, city, {FEE_LIST},
                   rfm_group, count(*) AS cantidad_sin_imp_1_trx
            FROM active_scored GROUP BY ALL""",
        "churn_attrs": """
            SELECT DISTINCT c.*, t.* EXCLUDE (nombre_merchant, account_id)
            FROM churn c LEFT JOIN top_details t ON t.nombre_merchant = c.nombre_merchant""",
        "churn_cities": f"""
            SELECT a.*, coalesce(c.city, '{OTHER_CITIES}') AS city
            FROM churn_attrs a LEFT JOIN cities c ON c.ciudad = a.ciudad""",
        "churn_fee_rows": f"""
            SELECT DISTINCT a.*, {FEE_LIST} FROM churn_cities a LEFT JOIN fee_columns f
              ON f.nombre_merchant = a.nombre_merchant AND a.mes = {day(p.fee_snapshot_month)}""",
        "churn_scored": """
            SELECT a.*, r.* EXCLUDE (nombre, fecha_mes) FROM churn_fee_rows a
            LEFT JOIN rfm_table r ON r.nombre = a.nombre_merchant AND r.fecha_mes = a.mes""",
        "churn_by_attrs": f"""
            SELECT mes, codigo_mcc_id, modelo_pagos, fuente_creacion,
                   CASE WHEN referido_cuenta_linea IS NULL THEN 'No' ELSE 'Yes' END AS referidot,
                   city, {FEE_LIST}, count(*) AS cantidad_churn
            FROM churn_scored GROUP BY ALL""",
        "active_tagged": "SELECT *, 'Activos' AS estado_ FROM active_45",
        "churn_tagged": "SELECT *, 'Churn' AS estado_ FROM churn_scored",
        "churn_aligned": f"""
            SELECT DISTINCT nombre_merchant, mes, inactividad, {no_activity}, codigo_mcc_id,
                   modelo_pagos, fuente_creacion,
                   CASE WHEN referido_cuenta_linea IS {"NOT NULL" if quirks else "NULL"}
                        THEN 'No' ELSE 'Yes' END AS referido_cuenta_linea,
                   ciudad, city, {FEE_LIST}, estado_
            FROM churn_tagged""",
        "two_states": """
            SELECT * FROM active_tagged UNION SELECT * FROM churn_aligned""",
        "account_dim": f"""
            SELECT DISTINCT coalesce(n.name_merchant_2, a.nombre) AS nombre_merchant, a.cuenta_id,
                   a.usuario_id, a.fecha_creacion, a.codigo_mcc_id, a.modelo_pagos,
                   a.fuente_creacion,
                   CASE WHEN a.referido_cuenta_linea IS NULL THEN 'No' ELSE 'Yes' END AS referidot,
                   a.ciudad
            FROM src_account a LEFT JOIN src_name_map n ON n.account_id = a.cuenta_id
            JOIN src_allow_list s ON s.account_id = a.cuenta_id
            WHERE a.cuenta_id {kept}""",
        "created_cities": f"""
            SELECT DISTINCT a.*, coalesce(c.city, '{OTHER_CITIES}') AS city
            FROM account_dim a LEFT JOIN cities c ON c.ciudad = a.ciudad""",
        "created_fee_rows": f"""
            SELECT DISTINCT a.*, {FEE_LIST} FROM created_cities a LEFT JOIN fee_columns f
              ON f.nombre_merchant = a.nombre_merchant""",
        "created": f"""
            SELECT nombre_merchant,
                   CAST(date_trunc('month', min(fecha_creacion)) AS DATE) AS mes, codigo_mcc_id,
                   modelo_pagos, fuente_creacion, referidot, ciudad, city, {FEE_LIST}
            FROM created_fee_rows GROUP BY ALL""",
        "created_tagged": "SELECT *, 'Creada' AS estado_ FROM created",
        "created_aligned": f"""
            SELECT DISTINCT nombre_merchant, mes, CAST(NULL AS BIGINT) AS inactividad,
                   {no_activity}, codigo_mcc_id, modelo_pagos, fuente_creacion,
                   {"'No'" if quirks else "referidot"} AS referido_cuenta_linea, ciudad, city,
                   {FEE_LIST}, estado_
            FROM created_tagged""",
        "started": """
            SELECT nombre_merchant, mes, 1 AS flag FROM active_scored
            WHERE created_activated = 'activa_mes_creada'""",
        "created_flagged": """
            SELECT c.*, s.flag FROM created_aligned c LEFT JOIN started s
              ON s.nombre_merchant = c.nombre_merchant AND s.mes = c.mes""",
        "created_new": "SELECT DISTINCT * EXCLUDE (flag) FROM created_flagged WHERE flag IS NULL",
        "three_states": "SELECT * FROM two_states UNION SELECT * FROM created_new",
        "segmented": """
            SELECT u.*, CASE
                WHEN u.nombre_merchant IN (SELECT name_merchant FROM src_segment
                                           WHERE segment = 'ex_vip') THEN 'ex_vip'
                WHEN u.nombre_merchant IN (SELECT name_merchant FROM src_segment
                                           WHERE segment = 'gerenciado') THEN 'gerenciado'
                ELSE 'masivo' END AS gerenciado
            FROM three_states u""",
        "updated": """
            SELECT s.*, d.update_ FROM segmented s LEFT JOIN src_up_down d
              ON d.name_merchant = s.nombre_merchant AND d.fecha = s.mes""",
        "created_updated": """
            SELECT c.*, CASE
                WHEN c.nombre_merchant IN (SELECT name_merchant FROM src_segment
                                           WHERE segment = 'ex_vip') THEN 'ex_vip'
                WHEN c.nombre_merchant IN (SELECT name_merchant FROM src_segment
                                           WHERE segment = 'gerenciado') THEN 'gerenciado'
                ELSE 'masivo' END AS gerenciado, d.update_
            FROM created_flagged c LEFT JOIN src_up_down d
              ON d.name_merchant = c.nombre_merchant AND d.fecha = c.mes""",
        "marked": """
            SELECT *, CASE WHEN mes = primera_trx_nombre THEN 'primera_sin_importar' END
                AS primera_trx_sin
            FROM updated""",
        "signup_rows": f"""
            SELECT DISTINCT mail AS nombre_merchant,
                   CAST(date_trunc('month', CAST(left(signup_date, 10) AS DATE)) AS DATE) AS mes,
                   NULL AS inactividad, {no_activity}, mcc_code AS codigo_mcc_id,
                   NULL AS modelo_pagos, 'OB2' AS fuente_creacion, NULL AS referido_cuenta_linea,
                   NULL AS ciudad, NULL AS city, {", ".join(f"NULL AS {c}" for c in FEES)},
                   'sign_up' AS estado_, NULL AS gerenciado, NULL AS update_,
                   NULL AS primera_trx_sin
            FROM src_signup WHERE account IS NULL""",
        "four_states": "SELECT * FROM marked UNION SELECT * FROM signup_rows",
        "dashboard": f"""
            SELECT mes, {ALL_KEYS}, count(*) FILTER (WHERE estado_ = 'Activos') AS registros,
                   count(back_from_churn) AS back_from_churn_,
                   count(created_activated) AS trx_mes_creacion, sum(inactivo) AS inactivo_,
                   {esum("tpt")} AS tpt_, {esum("tpv_usd")} AS tpv_usd_,
                   {esum("revenue_usd")} AS revenue_usd_, {esum("gm_usd")} AS gm_usd_,
                   sum(suma_de_metodos) AS suma_de_metodos_,
                   sum(saldo_promedio_mes) AS saldo_promedio_mes_sum,
                   sum(saldo_f_mes) AS saldo_f_mes_sum, sum(monto_fraude) AS monto_fraude_sum,
                   sum(cantidad_fraude) AS cantidad_fraude_sum,
                   count(*) FILTER (WHERE estado_ = 'Churn') AS churn_numero,
                   count(*) FILTER (WHERE estado_ = 'Creada') AS creados_numero,
                   count(*) FILTER (WHERE estado_ = 'Activos'
                                    AND primera_trx_sin = 'primera_sin_importar') AS primera_trx,
                   count(*) FILTER (WHERE estado_ = 'sign_up') AS signups
            FROM four_states GROUP BY mes, {ALL_KEYS}""",
        "dashboard_mcc": f"""
            SELECT d.*, m.descripcion FROM dashboard d LEFT JOIN src_mcc m
              ON m.codigo = d.codigo_mcc_id
            WHERE d.mes >= {day(p.dashboard_start)}""",
        "marked_scored": """
            SELECT m.*, r.* EXCLUDE (nombre, fecha_mes) FROM marked m
            LEFT JOIN rfm_table r ON r.nombre = m.nombre_merchant AND r.fecha_mes = m.mes""",
        "rfm_counts": f"""
            SELECT rfm_group, mes, {KEYS}, gerenciado, update_, count(*) AS cantidad
            FROM marked_scored WHERE mes >= {day(p.rfm_start)} AND estado_ = 'Activos'
            GROUP BY ALL""",
        "migration": f"""
            SELECT *, CASE WHEN lag(nombre_merchant) OVER w = nombre_merchant
                           THEN lag(rfm_group) OVER w END AS last_rfm
            FROM marked_scored WHERE mes >= {day(p.rfm_start)} AND estado_ = 'Activos'
            WINDOW w AS (ORDER BY {ROW_ORDER}, {FEE_ORDER}, codigo_mcc_id, modelo_pagos,
                         fuente_creacion, referido_cuenta_linea, ciudad)""",
        "migration_labels": f"""
            SELECT unnest([{listed((*GROUPS.values(), UNSCORED))}]) AS label""",
        "migration_cells": f"""
            SELECT c.mes, a.label AS last_rfm, b.label AS rfm_group
            FROM calendar c, migration_labels a, migration_labels b
            WHERE c.mes >= {day(p.rfm_start)}""",
        "migration_matrix": f"""
            SELECT mes, last_rfm, rfm_group, n AS cantidad,
                   n / nullif(sum(n) OVER (PARTITION BY mes, last_rfm), 0) AS participacion
            FROM (SELECT c.*, count(m.mes) AS n FROM migration_cells c
                  LEFT JOIN migration m ON m.mes = c.mes
                       AND coalesce(m.last_rfm, '{UNSCORED}') = c.last_rfm
                       AND coalesce(m.rfm_group, '{UNSCORED}') = c.rfm_group
                  GROUP BY c.mes, c.last_rfm, c.rfm_group)""",
        "cohort_trx_attrs": f"""
            SELECT primera_trx_nombre, mob_first_trx, {ALL_KEYS}, {eavg("tpt")} AS tpt,
                   {eavg("tpv_usd")} AS tpv, {eavg("revenue_usd")} AS revenue, count(*) AS cantidad
            FROM marked_scored WHERE mes >= {day(p.cohort_start)} AND estado_ = 'Activos'
            GROUP BY primera_trx_nombre, mob_first_trx, {ALL_KEYS}""",
        "cohort_created_attrs": f"""
            SELECT fecha_creacion_nombre, mob_creacion_cuenta, {ALL_KEYS}, {eavg("tpt")} AS tpt,
                   {eavg("tpv_usd")} AS tpv, {eavg("revenue_usd")} AS revenue, count(*) AS cantidad
            FROM marked_scored WHERE mes >= {day(p.cohort_start)} AND estado_ = 'Activos'
            GROUP BY fecha_creacion_nombre, mob_creacion_cuenta, {ALL_KEYS}""",
    }


# key: (SQL step, output columns). s text, d date, i whole number, f double, m decimal shown
# as a double, q USD or a rate in 1e-18 units, shown as a double with six decimals. The
# rounding is done on whole numbers, so that ties fall as they do on Spark's decimals.
OUTPUTS: dict[str, tuple[str, str]] = {
    "payment_method_flags": (
        "flags",
        "name=name_merchant_ s, billing_date_monthly d, grp=group s, account_create_date d, "
        + ", ".join(f"{m} i" for m in METHODS),
    ),
    "merchant_month_financials": (
        "financials", "name_merchant s, month d, gm_usd f, tpt f, tpv_usd f, revenue_usd f"
    ),
    "merchant_month_base": (
        "base",
        "name=name_merchant_ s, billing_date_monthly d, grp=group s, account_create_date d, "
        + ", ".join(f"{m} i" for m in METHODS)
        + ", "
        + ", ".join(f"{m} f" for m in MEASURES),
    ),
    "month_calendar": ("evaluated", "mes d, registros_base i"),
    "active_merchants": ("active", "name_merchant s, mes d, inactividad i, group s"),
    "active_payment_usage": ("active_usage", ACTIVITY),
    "method_count_inactive": ("active_counted", COUNTED),
    "active_dedup": ("active_distinct", COUNTED),
    "active_null_to_zero": ("active_zero", COUNTED),
    "monthly_kpis": (
        "kpis",
        "mes d, registros i, tpt f, tpv f, revenue f, gm f, suma_metodos i, inactivo i",
    ),
    "merchant_creation_month": ("creation", "nombre_merchant s, fecha_creacion d"),
    "names_created_by_month": ("names_created", "fecha_creacion d, cantidad i"),
    "accounts_created_by_month": ("accounts_created", "fecha_creacion d, cantidad i"),
    "latest_accounts_created": ("accounts_latest", "fecha_creacion d, cantidad i"),
    "first_transaction_month": ("first_trx", "nombre_merchant s, primera_trx d"),
    "first_transaction_counts": ("first_counts", "primera_trx d, cantidad_primera_trx i"),
    "months_on_book": ("mobs", MOBS),
    "activation_curve": (
        "curve",
        "fecha_creacion d, mob_first_trx i, activas_mes_mob i, total_creadas i, "
        "cumulative_sum i, tasa_activacion_acum q, fm_num i",
    ),
    "activation_curve_report": (
        "curve_report",
        "fecha_creacion d, mob_first_trx i, activas_mes_mob i, total_creadas i, "
        "cumulative_sum i, tasa_activacion_acum q, fm_num i",
    ),
    "cohort_by_creation": (
        "cohort_created", f"fecha_creacion_nombre d, mob_creacion_cuenta i, {COHORT_MEANS}"
    ),
    "cohort_by_first_trx": (
        "cohort_trx", f"primera_trx_nombre d, mob_first_trx i, {COHORT_MEANS}"
    ),
    "back_from_churn_by_month": ("returned", "mes d, back_from_churn s, number_back i"),
    "back_from_churn_review": ("review", "nombre_merchant s"),
    "created_activated_by_month": ("activated", "mes d, primera_trx_mes_creacion i"),
    "avg_balance_month": ("avg_balance", "account_id s, fecha_saldo d, saldo f"),
    "month_end_balance": ("end_balance", "account_id s, fecha_saldo d, saldo f, es_ultimo s"),
    "merchant_balance_usd": (
        "balances", "name_merchant s, fecha_saldo d, saldo_promedio_mes q, saldo_f_mes q"
    ),
    "active_with_balances": ("active_balances", BALANCED),
    "balances_by_month": (
        "month_balances",
        "mes d, saldo_promedio_mes_nombre q, saldo_f_mes_nombre q, saldo_promedio_mes_sum q, "
        "saldo_f_mes_sum q",
    ),
    "churn_events": ("churn", CHURN),
    "churn_by_month": ("churn_months", "mes d, cantidad_churn i"),
    "disputed_transactions": ("disputed", "usuario_id i, transaccion_id i, orden_id i"),
    "fraud_transactions": (
        "fraud_rows", "cuenta_id s, usuario_id i, transaccion_id i, orden_id i"
    ),
    "fraud_usd": (
        "fraud_value",
        "name_merchant s, cuenta_id s, usuario_id i, transaccion_id i, orden_id i, "
        "fecha_creacion_nombre d, pm_purchase_value q",
    ),
    "fraud_by_merchant_month": (
        "fraud_merchant",
        "name_merchant s, fecha_creacion_nombre d, monto_fraude q, cantidad_fraude i",
    ),
    "fraud_by_month": (
        "fraud_month", "fecha_creacion_nombre d, cantidad_fraud i, monto_fraude q"
    ),
    "active_with_fraud": ("active_fraud", FRAUD),
    "executive_dashboard": (
        "executive",
        "mes d, registros i, tpt f, tpv f, revenue f, gm f, suma_metodos i, inactivo i, "
        "cantidad_nom_creados i, number_back i, cantidad_primera_trx i, "
        "cantidad_creados_no_trx i, primera_trx_mes_creacion i, saldo_promedio_mes_nombre q, "
        "saldo_f_mes_nombre q, saldo_promedio_mes_sum q, saldo_f_mes_sum q, cantidad_churn i, "
        "monto_fraude q, cantidad_fraud i",
    ),
    "top_account_per_merchant": ("top_accounts", "nombre_merchant s, account_id s, tpt_total f"),
    "attach_mcc_active": ("active_with_mcc", f"{FRAUD}, codigo_mcc_id s"),
    "attach_account_attributes_active": ("active_attrs", f"{FRAUD}, {ATTRS}"),
    "attach_account_attributes_churn": ("churn_attrs", f"{CHURN}, {ATTRS}"),
    "standardise_city_active": ("active_cities", f"{FRAUD}, {ATTRS}, city s"),
    "standardise_city_churn": ("churn_cities", f"{CHURN}, {ATTRS}, city s"),
    "standardise_city_created": (
        "created_cities",
        "nombre_merchant s, cuenta_id s, usuario_id i, fecha_creacion d, codigo_mcc_id s, "
        "modelo_pagos s, fuente_creacion s, referidot s, ciudad s, city s",
    ),
    "account_fees": (
        "account_fees",
        "cuenta_id s, comision_plana_comercio m, comision_porcentual_comercio m, "
        "tipo_medio_pago s",
    ),
    "attach_fees_pivot_active": ("active_fee_rows", STATE_45),
    "attach_fees_pivot_churn": ("churn_fee_rows", f"{CHURN}, {ATTRS}, city s, {FEE_SPEC}"),
    "attach_fees_pivot_created": (
        "created_fee_rows",
        "nombre_merchant s, cuenta_id s, usuario_id i, fecha_creacion d, codigo_mcc_id s, "
        f"modelo_pagos s, fuente_creacion s, referidot s, ciudad s, city s, {FEE_SPEC}",
    ),
    "rfm_scoring": ("rfm_table", f"nombre s, fecha_mes d, {RFM_SPEC}"),
    "attach_rfm_active": ("active_scored", f"{STATE_45}, {RFM_SPEC}"),
    "attach_rfm_churn": (
        "churn_scored", f"{CHURN}, {ATTRS}, city s, {FEE_SPEC}, {RFM_SPEC}"
    ),
    "attach_rfm_union": ("marked_scored", f"{SEGMENTED}, primera_trx_sin s, {RFM_SPEC}"),
    "active_without_rfm": ("active_45", STATE_45),
    "back_from_churn_by_attributes": (
        "back_by_attrs",
        f"mes d, back_from_churn s, cantidad_back i, referidot s, {BY_KEYS}, rfm_group s",
    ),
    "created_activated_by_attributes": (
        "activated_by_attrs",
        f"mes d, created_activated s, trx_creation_month i, referidot s, {BY_KEYS}, rfm_group s",
    ),
    "first_trx_by_attributes": (
        "first_by_attrs",
        f"primera_trx_nombre d, cantidad_sin_imp_1_trx i, referidot s, {BY_KEYS}, rfm_group s",
    ),
    "churn_by_attributes": (
        "churn_by_attrs", f"mes d, cantidad_churn i, referidot s, {BY_KEYS}"
    ),
    "tag_state_active": ("active_tagged", STATE),
    "tag_state_churn": (
        "churn_tagged", f"{CHURN}, {ATTRS}, city s, {FEE_SPEC}, {RFM_SPEC}, estado_ s"
    ),
    "tag_state_created": (
        "created_tagged", f"nombre_merchant s, mes d, referidot s, ciudad s, {BY_KEYS}, estado_ s"
    ),
    "align_state_schema_churn": ("churn_aligned", STATE),
    "align_state_schema_created": ("created_aligned", STATE),
    "union_active_churn": ("two_states", STATE),
    "account_dimension": (
        "account_dim",
        "nombre_merchant s, cuenta_id s, usuario_id i, fecha_creacion d, codigo_mcc_id s, "
        "modelo_pagos s, fuente_creacion s, referidot s, ciudad s",
    ),
    "created_by_month_attributes": (
        "created", f"nombre_merchant s, mes d, referidot s, ciudad s, {BY_KEYS}"
    ),
    "created_without_activation": ("created_new", STATE),
    "created_segment_and_update": ("created_updated", f"{SEGMENTED}, flag i"),
    "union_with_created": ("three_states", STATE),
    "management_segment": ("segmented", f"{STATE}, gerenciado s"),
    "attach_update_flag": ("updated", SEGMENTED),
    "first_trx_marker": ("marked", f"{SEGMENTED}, primera_trx_sin s"),
    "signups": ("signup_rows", f"{SEGMENTED}, primera_trx_sin s"),
    "union_signups": ("four_states", f"{SEGMENTED}, primera_trx_sin s"),
    "segment_dashboard": ("dashboard", DASHBOARD),
    "segment_dashboard_mcc": ("dashboard_mcc", f"{DASHBOARD}, descripcion s"),
    "rfm_summary": (
        "rfm_counts",
        "rfm_group s, mes d, codigo_mcc_id s, modelo_pagos s, fuente_creacion s, "
        "referido_cuenta_linea s, city s, gerenciado s, update_ s, cantidad i",
    ),
    "rfm_migration": (
        "migration", f"{SEGMENTED}, primera_trx_sin s, {RFM_SPEC}, last_rfm s"
    ),
    "rfm_migration_matrix": (
        "migration_matrix", "mes d, last_rfm s, rfm_group s, cantidad i, participacion f"
    ),
    "cohort_first_trx_by_attributes": (
        "cohort_trx_attrs", f"primera_trx_nombre d, mob_first_trx i, {COHORT_MEANS}, {DASH_KEYS}"
    ),
    "cohort_creation_by_attributes": (
        "cohort_created_attrs",
        f"fecha_creacion_nombre d, mob_creacion_cuenta i, {COHORT_MEANS}, {DASH_KEYS}",
    ),
    "lifecycle_status": ("status", "name_merchant s, group s, inactividad i, status s"),
    "payment_method_mix": (
        "mix", "name_merchant s, payment_method_type s, cantidad i, participacion f"
    ),
}

# Outputs that the referred-flag quirks change, as further keys.
QUIRK_OUTPUTS = (
    "back_from_churn_by_attributes",
    "created_activated_by_attributes",
    "first_trx_by_attributes",
    "align_state_schema_churn",
    "align_state_schema_created",
    "segment_dashboard",
)

_SHOW = {
    "s": 'CAST({c} AS VARCHAR) AS "{n}"',
    "d": 'CAST({c} AS DATE) AS "{n}"',
    "i": 'CAST({c} AS BIGINT) AS "{n}"',
    "f": 'CAST({c} AS DOUBLE) AS "{n}"',
    "m": 'CAST({c} AS DOUBLE) AS "{n}"',
    "q": f'CAST({half_up("{c}", "1000000000000")} AS DOUBLE) / 1000000 AS "{{n}}"',
}


def _needed(step: str, sql: dict[str, str], found: dict[str, None]) -> None:
    for name in dict.fromkeys(re.findall(r"\w+", sql[step])):
        if name in sql and name != step and name not in found:
            _needed(name, sql, found)
    found[step] = None


def query(step: str, columns: str, sql: dict[str, str]) -> str:
    found: dict[str, None] = {}
    _needed(step, sql, found)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({sql[name]})" for name in found)
    shown = []
    for column in columns.split(", "):
        source, kind = column.split()
        source, _, name = source.partition("=")
        shown.append(_SHOW[kind].format(c=f'"{source}"', n=name or source))
    return f"WITH {ctes}\nSELECT {', '.join(shown)} FROM {step}"


def oracle_queries() -> dict[str, str]:
    plain = steps(FIXTURE_PARAMS)
    quirky = steps(quirk_params())
    out = {key: query(step, columns, plain) for key, (step, columns) in OUTPUTS.items()}
    for key in QUIRK_OUTPUTS:
        out[f"{key}_quirks"] = query(*OUTPUTS[key], quirky)
    return out


def quirk_params() -> Params:
    return replace(FIXTURE_PARAMS, reference_quirks=True)

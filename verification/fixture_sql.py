"""The fixture of FIXTURES.md as DuckDB SQL, independent of the Spark expressions."""

from __future__ import annotations

from merchlife.sources.fixture import (
    CITIES,
    FEE_TYPES,
    FIRST_MONTH,
    LAST_INDEX,
    PAYMENT_METHODS,
    SOURCES,
    STARTS,
    STRIDE,
)


def texts(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


FIXTURE: dict[str, str] = {
    "fx_orders": f"""
        SELECT * EXCLUDE (i, s), CAST(DATE '{FIRST_MONTH}' + to_months(CAST(s + i * ({LAST_INDEX} - s) // {LAST_INDEX} AS INTEGER)) AS DATE) AS m
        FROM (SELECT *, (year(o_orderdate) - {FIRST_MONTH.year}) * 12 + month(o_orderdate) - 1 AS i,
                     o_custkey * {STRIDE} % {STARTS} AS s
              FROM orders)""",
    "fx_first": """
        SELECT o_custkey AS k, min(m) AS first_order FROM fx_orders GROUP BY o_custkey""",
    "fx_customer": """
        SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS id, c_name, c_nationkey,
               c_mktsegment, 'M' || CAST(c_custkey // 2 AS VARCHAR) AS merchant,
               CAST(first_order - to_months(CAST(c_custkey % 4 AS INTEGER)) + to_days(CAST(c_custkey % 28 AS INTEGER)) AS DATE) AS opened,
               CASE WHEN n_regionkey = 4 THEN 'XX' ELSE 'CO' END AS country
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN fx_first ON k = c_custkey""",
    "src_account": f"""
        SELECT id AS cuenta_id, c_name AS nombre, k // 3 AS usuario_id,
               opened AS fecha_creacion, CAST(c_nationkey + v AS VARCHAR) AS codigo_mcc_id,
               CASE WHEN (k + v) % 2 = 0 THEN 'AGGREGATOR' ELSE 'GATEWAY' END AS modelo_pagos,
               ({texts(SOURCES)})[k % 3 + 1] AS fuente_creacion,
               CASE WHEN (k + v) % 5 = 0 THEN 'r' END AS referido_cuenta_linea,
               ({texts(CITIES)})[(c_nationkey + v) % {len(CITIES)} + 1] AS ciudad,
               c_nationkey + v AS grupo_perfil_cobranza_id
        FROM (SELECT *, unnest(CASE WHEN k % 11 = 0 THEN [0, 1, 1] WHEN k % 13 = 0 THEN [0, 0] ELSE [0] END) AS v
              FROM fx_customer)""",
    "src_dim_account": "SELECT id AS account_id, opened AS account_create_date FROM fx_customer",
    "src_name_map": """
        SELECT CASE WHEN k % 10 = 0 THEN 'x' || id ELSE id END AS account_id,
               merchant AS name_merchant_2
        FROM fx_customer""",
    "src_allow_list": """
        SELECT CASE WHEN k % 20 = 19 THEN 'x' || id ELSE id END AS account_id
        FROM fx_customer""",
    "src_agg_monthly": f"""
        SELECT id AS account_id, c_name AS account_name,
               m AS billing_date_monthly,
               ({texts(PAYMENT_METHODS)})[o_orderkey % 10 + 1] AS payment_method_type,
               opened AS account_create_date, country AS country_account
        FROM fx_orders JOIN fx_customer ON k = o_custkey""",
    "fx_volume": """
        SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'u' || id ELSE id END AS account_id,
               CASE WHEN o_orderkey % 50 <> 0 AND k % 10 <> 0 THEN merchant END AS name_merchant,
               m AS month,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'SMB' WHEN 'HOUSEHOLD' THEN 'Partnership'
                    ELSE c_mktsegment END AS grp,
               country AS country_account, CAST(count(*) AS DOUBLE) AS tpt,
               CAST(sum(CASE WHEN o_orderkey % 11 = 0 THEN 0
                             ELSE CAST(o_totalprice AS DECIMAL(18, 4)) END) AS DOUBLE) AS tpv_usd
        FROM fx_orders JOIN fx_customer ON k = o_custkey
        GROUP BY ALL""",
    "src_client_base": """
        SELECT *, tpv_usd * CAST(0.03 AS DOUBLE) AS revenue_usd,
               tpv_usd * CAST(0.01 AS DOUBLE) AS gm_usd
        FROM fx_volume""",
    "fx_shipped": """
        SELECT lineitem.*, o_custkey AS k, l_orderkey * 10 + l_linenumber AS item
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "src_balance": """
        SELECT CAST(k AS VARCHAR) AS cuenta_id, l_shipdate AS fecha_creacion,
               l_extendedprice AS saldo
        FROM fx_shipped""",
    "fx_months": """
        SELECT CAST(m AS DATE) AS d
        FROM generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH) t(m)""",
    "src_fx": """
        SELECT year(d) AS year, month(d) AS month,
               CASE WHEN d = DATE '2000-05-01' THEN 'ARS' ELSE 'COP' END AS currency,
               3000 + 10 * month(d) + year(d) - 1995 AS usd
        FROM fx_months
        UNION ALL
        SELECT year(d), month(d), 'MXN', 17 FROM fx_months""",
    "src_transaction": """
        SELECT k // 3 AS usuario_id, item AS transaccion_id, l_orderkey AS orden_id
        FROM fx_shipped""",
    "src_dispute": """
        SELECT l_orderkey AS orden_id,
               CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'FRAUD' ELSE 'SERVICE' END
                   AS motivo,
               CASE WHEN l_linestatus = 'F' THEN 'REFUNDED' ELSE 'OPEN' END AS estado
        FROM lineitem""",
    "src_order": """
        SELECT o_orderkey AS orden_id, CAST(o_custkey AS VARCHAR) AS cuenta_id FROM orders""",
    "src_amount": """
        SELECT l_orderkey * 10 + l_linenumber AS transaccion_id,
               l_shipdate AS fecha_creacion, l_extendedprice AS pm_purchase_value
        FROM lineitem GROUP BY ALL""",
    "src_fee": """
        SELECT p_partkey AS perfil_cobranza_id,
               CAST(p_retailprice AS DECIMAL(14, 2)) AS comision_plana_comercio,
               CAST(p_size / 10 AS DECIMAL(14, 2)) AS comision_porcentual_comercio
        FROM part""",
    "src_charge_profile": f"""
        SELECT p_partkey AS perfil_cobranza_id, p_partkey // 4 AS grupo_perfil_cobranza_id,
               ({texts(FEE_TYPES)})[p_partkey % 4 + 1] AS tipo_medio_pago
        FROM part""",
    "src_mcc": """
        SELECT CAST(n_nationkey AS VARCHAR) AS codigo, n_name AS descripcion FROM nation""",
    "src_up_down": """
        SELECT DISTINCT merchant AS name_merchant, d AS fecha,
               CASE WHEN (k // 2) % 9 = 0
                    THEN CASE WHEN (k // 2) % 2 = 0 THEN 'up' ELSE 'down' END END AS update_
        FROM fx_customer
        JOIN fx_months ON month(d) % 3 = 0 AND year(d) BETWEEN 1999 AND 2001""",
    "src_segment": """
        SELECT merchant AS name_merchant,
               CASE WHEN (k // 2) % 7 = 0 THEN 'ex_vip' ELSE 'masivo' END AS segment,
               CASE WHEN (k // 2) % 7 = 0 THEN 1 ELSE 3 END AS priority
        FROM fx_customer
        UNION ALL
        SELECT merchant, CASE WHEN (k // 2) % 5 = 0 THEN 'gerenciado' ELSE 'masivo' END,
               CASE WHEN (k // 2) % 5 = 0 THEN 2 ELSE 3 END
        FROM fx_customer""",
    "src_signup": """
        SELECT 'user' || CAST(user_id AS VARCHAR) AS mail, CAST(ts AS VARCHAR) AS signup_date,
               CAST(user_id % 25 AS VARCHAR) AS mcc_code,
               CASE WHEN user_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS account
        FROM events WHERE event_type = 'signup'""",
}

"""Table contracts, loaders and sinks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlife.functions.columns import by_key

# Contracts of the input tables. Ids that are compared as text are strings everywhere.
CONTRACTS: dict[str, str] = {
    "agg_monthly": "account_id string, account_name string, billing_date_monthly date, "
    "payment_method_type string, account_create_date date",
    "client_base": "account_id string, name_merchant string, month date, group string, "
    "country_account string, gm_usd double, tpt double, tpv_usd double, revenue_usd double",
    "dim_account": "account_id string, account_create_date date",
    "name_map": "account_id string, name_merchant_2 string",
    "allow_list": "account_id string",
    "account": "cuenta_id string, nombre string, usuario_id long, fecha_creacion date, "
    "codigo_mcc_id string, modelo_pagos string, fuente_creacion string, "
    "referido_cuenta_linea string, ciudad string, grupo_perfil_cobranza_id int",
    "balance": "cuenta_id string, fecha_creacion timestamp, saldo double",
    "fx": "year int, month int, currency string, usd decimal(20,3)",
    "transaction": "usuario_id long, transaccion_id long, orden_id long",
    "dispute": "orden_id long, motivo string, estado string",
    "order": "orden_id long, cuenta_id string",
    "transaction_amount": "transaccion_id long, fecha_creacion timestamp, "
    "pm_purchase_value double",
    "fee": "perfil_cobranza_id long, comision_plana_comercio decimal(14,2), "
    "comision_porcentual_comercio decimal(14,2)",
    "charge_profile": "perfil_cobranza_id long, grupo_perfil_cobranza_id int, "
    "tipo_medio_pago string",
    "mcc": "codigo string, descripcion string",
    "rfm": "nombre string, fecha_mes date, recencia long, alt_baj_recencia string, "
    "frecuencia_internet long, alt_baj_frecuencia string, monto decimal(38,4), "
    "alt_baj_monto string, rfm_group string",
    "up_down": "name_merchant string, fecha date, update_ string",
    "segment": "name_merchant string, segment string, priority int",
    "signup": "mail string, signup_date string, mcc_code string, account string",
}

# Read when present: the country may sit on the billing facts or only on the client base.
OPTIONAL_COLUMNS: dict[str, str] = {"agg_monthly": "country_account string"}


def conform(df: DataFrame, contract: str, optional: str = "") -> DataFrame:
    """Select and cast the contract's columns. Unused columns never leave the scan."""
    present = set(df.columns)
    specs = [s.strip().split(" ", 1) for s in _split(contract)]
    specs += [s.strip().split(" ", 1) for s in _split(optional) if s.split()[0] in present]
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in specs))


def _split(contract: str) -> list[str]:
    # Commas inside decimal(p,s) do not have a blank after them.
    return [s for s in contract.split(", ") if s.strip()]


@dataclass
class Sources:
    """The input tables. `rfm` may be missing: the scores are then computed."""

    agg_monthly: DataFrame
    client_base: DataFrame
    dim_account: DataFrame
    name_map: DataFrame
    allow_list: DataFrame
    account: DataFrame
    balance: DataFrame
    fx: DataFrame
    transaction: DataFrame
    dispute: DataFrame
    order: DataFrame
    transaction_amount: DataFrame
    fee: DataFrame
    charge_profile: DataFrame
    mcc: DataFrame
    up_down: DataFrame
    segment: DataFrame
    signup: DataFrame
    rfm: DataFrame | None = None

    def __post_init__(self) -> None:
        for f in fields(self):
            df = getattr(self, f.name)
            if df is not None:
                optional = OPTIONAL_COLUMNS.get(f.name, "")
                setattr(self, f.name, conform(df, CONTRACTS[f.name], optional))

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, rfm: bool = False) -> Sources:
        names = [n for n in CONTRACTS if n != "rfm" or rfm]
        return cls(**{n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: Mapping[str, str]) -> Sources:
        """`names` maps each contract to the table that holds it."""
        return cls(**{n: spark.table(table) for n, table in names.items()})


def smb_accounts(allow_list: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """Distinct allow-listed account ids without the test accounts."""
    kept = allow_list.filter(~F.col("account_id").isin(*excluded))
    return kept.select("account_id").distinct()


def account_names(smb: DataFrame, name_map: DataFrame, account: DataFrame) -> DataFrame:
    """(account_id, name_merchant) of every allow-listed account: the mapped name, else
    the account's own, else NULL. It doubles as the allow-list: joining it replaces the
    semi-join and the two name joins of each statement that needs a merchant name."""
    own = account.select(F.col("cuenta_id").alias("account_id"), "nombre")
    return (
        smb.join(by_key(name_map), "account_id", "left")
        .join(by_key(own), "account_id", "left")
        .select("account_id", F.coalesce("name_merchant_2", "nombre").alias("name_merchant"))
        .distinct()
    )


def monthly_fx(fx: DataFrame, currency: str) -> DataFrame:
    """One rate per month, keyed by the month's first day."""
    return fx.filter(F.col("currency") == currency).select(
        F.make_date("year", "month", F.lit(1)).alias("fx_month"), "usd"
    )


def to_usd(amount: str, rate: str = "usd") -> Column:
    """Local amount divided by the month's rate, with three decimals on both sides."""
    value = F.col(amount).cast("decimal(20,3)")
    return F.try_divide(value, F.col(rate).cast("decimal(20,3)"))

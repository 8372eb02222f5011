"""The monthly run: wires the operators and keeps the results that several reports read."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import wraps
from threading import RLock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from merchlife.functions.columns import distinct_in_merchant
from merchlife.operators import (
    activity,
    attributes,
    balances,
    cohorts,
    fraud,
    lifecycle,
    reports,
    rfm,
)
from merchlife.params import Params
from merchlife.session import check_session
from merchlife.sources.stages import StageStore
from merchlife.sources.tables import Sources, account_names, smb_accounts


def step(build: Callable) -> Callable:
    """A lazy step: the same DataFrame for every reader."""

    @wraps(build)
    def once(self: MerchantPipeline) -> DataFrame:
        # Steps only wait for the steps they read, so these locks cannot form a circle.
        with self._locks[build.__name__]:
            if build.__name__ not in self._built:
                self._built[build.__name__] = build(self)
            return self._built[build.__name__]

    return once


def stage(build: Callable | None = None, **layout) -> Callable:
    """A step that is written once to the shared folder. For results that are much smaller
    than what they are made from and have several readers. The layout is StageStore.save's."""
    if build is None:
        return lambda build: stage(build, **layout)

    @wraps(build)
    def saved(self: MerchantPipeline) -> DataFrame:
        return self.store.save(build.__name__, build(self), **layout)

    saved.is_stage = True
    once = step(saved)
    once.is_stage = True
    return once


class MerchantPipeline:
    def __init__(
        self,
        spark: SparkSession,
        sources: Sources,
        params: Params,
        store: StageStore | None = None,
    ):
        if spark is not None:
            check_session(spark)
        self.spark = spark
        self.src = sources
        self.p = params
        self.store = store or StageStore(spark)
        self._built: dict[str, DataFrame] = {}
        self._locks: dict[str, RLock] = {n: RLock() for n in dir(type(self))}

    @classmethod
    def stages(cls) -> list[str]:
        named = dict.fromkeys(n for c in reversed(cls.__mro__) for n in vars(c))
        return [n for n in named if getattr(getattr(cls, n), "is_stage", False)]

    def prepare(self) -> None:
        """Writes all stages that this run needs."""
        given = {"rfm_values", "rfm_medians", "computed_rfm"} if self.src.rfm is not None else set()
        self._together(*(n for n in self.stages() if n not in given), workers=4)

    def _together(self, *names: str, workers: int = 3) -> None:
        """Runs independent steps at the same time: the jobs of one fill the slots that the
        last tasks of another leave free."""
        run = inheritable_thread_target(self.spark)(lambda name: getattr(self, name)())
        with ThreadPoolExecutor(workers) as pool:
            list(pool.map(run, names))

    # Account dimension

    @stage
    def smb(self) -> DataFrame:
        return smb_accounts(self.src.allow_list, self.p.excluded_accounts)

    @stage
    def names(self) -> DataFrame:
        return account_names(self.smb(), self.src.name_map, self.src.account)

    # Activity

    @step
    def payment_method_flags(self) -> DataFrame:
        return activity.payment_method_flags(self.src.agg_monthly, self.src.client_base, self.p)

    @stage
    def merchant_month_financials(self) -> DataFrame:
        return activity.merchant_month_financials(self.src.client_base, self.p)

    @stage
    def merchant_month_base(self) -> DataFrame:
        return activity.merchant_month_base(
            self.payment_method_flags(), self.merchant_month_financials()
        )

    @step
    def month_calendar(self) -> DataFrame:
        calendar = activity.month_calendar(self.spark, self.p)
        return activity.evaluated_months(calendar, self.merchant_month_base())

    @stage
    def activity_distance(self) -> DataFrame:
        return activity.activity_distance(self.merchant_month_base(), self.p)

    @step
    def active_merchants(self) -> DataFrame:
        return activity.active_merchants(self.activity_distance(), self.p)

    @step
    def active_payment_usage(self) -> DataFrame:
        return activity.active_payment_usage(
            self.active_merchants(), self.merchant_month_base(), self.p
        )

    @step
    def method_count_inactive(self) -> DataFrame:
        return activity.method_count_inactive(self.active_payment_usage(), self.p)

    @step
    def active_dedup(self) -> DataFrame:
        return activity.active_dedup(self.method_count_inactive())

    @step
    def active_null_to_zero(self) -> DataFrame:
        return activity.active_null_to_zero(self.active_dedup())

    @step
    def monthly_kpis(self) -> DataFrame:
        return activity.monthly_kpis(self.months_on_book())

    @step
    def churn_events(self) -> DataFrame:
        return activity.churn_events(self.activity_distance(), self.p)

    @step
    def churn_by_month(self) -> DataFrame:
        return activity.churn_by_month(self.churn_events(), self.p)

    @step
    def lifecycle_status(self) -> DataFrame:
        return activity.lifecycle_status(self.merchant_month_base(), self.p)

    @step
    def payment_method_mix(self) -> DataFrame:
        return activity.payment_method_mix(self.src.agg_monthly, self.src.client_base, self.p)

    # Cohorts

    @stage
    def merchant_milestones(self) -> DataFrame:
        return cohorts.merchant_milestones(self.merchant_month_base(), self.p)

    @step
    def merchant_creation_month(self) -> DataFrame:
        return cohorts.merchant_creation_month(self.merchant_milestones())

    @step
    def names_created_by_month(self) -> DataFrame:
        return cohorts.names_created_by_month(self.src.dim_account, self.names())

    @step
    def accounts_created_by_month(self) -> DataFrame:
        return cohorts.accounts_created_by_month(self.src.dim_account, self.smb())

    @step
    def latest_accounts_created(self) -> DataFrame:
        return cohorts.latest_accounts_created(self.accounts_created_by_month())

    @step
    def first_transaction_month(self) -> DataFrame:
        return cohorts.first_transaction_month(self.merchant_milestones())

    @step
    def first_transaction_counts(self) -> DataFrame:
        return cohorts.first_transaction_counts(self.merchant_milestones())

    @stage
    def months_on_book(self) -> DataFrame:
        self._together("activity_distance", "merchant_milestones")
        return cohorts.months_on_book(self.active_null_to_zero(), self.merchant_milestones())

    @step
    def activation_curve(self) -> DataFrame:
        return cohorts.activation_curve(self.merchant_milestones(), self.names_created_by_month())

    @step
    def activation_curve_report(self) -> DataFrame:
        return cohorts.activation_curve_report(self.activation_curve(), self.p)

    @step
    def cohort_by_creation(self) -> DataFrame:
        return cohorts.cohort_by_creation(self.months_on_book())

    @step
    def cohort_by_first_trx(self) -> DataFrame:
        return cohorts.cohort_by_first_trx(self.months_on_book())

    @step
    def back_from_churn_by_month(self) -> DataFrame:
        return cohorts.back_from_churn_by_month(self.months_on_book())

    @step
    def back_from_churn_review(self) -> DataFrame:
        return cohorts.back_from_churn_review(self.months_on_book(), self.p)

    @step
    def created_activated_by_month(self) -> DataFrame:
        return cohorts.created_activated_by_month(self.months_on_book())

    # Balances

    @stage
    def account_month_balance(self) -> DataFrame:
        return balances.account_month_balance(self.src.balance)

    @step
    def avg_balance_month(self) -> DataFrame:
        return balances.avg_balance_month(self.account_month_balance(), self.smb())

    @step
    def month_end_balance(self) -> DataFrame:
        return balances.month_end_balance(self.src.balance, self.smb())

    @stage
    def merchant_balance_usd(self) -> DataFrame:
        self._together("account_month_balance", "names")
        return balances.merchant_balance_usd(
            self.account_month_balance(),
            self.src.balance,
            self.names(),
            self.src.fx,
            self.p.fx_currency,
        )

    @step
    def active_with_balances(self) -> DataFrame:
        return balances.active_with_balances(self.months_on_book(), self.merchant_balance_usd())

    @step
    def balances_by_month(self) -> DataFrame:
        return balances.balances_by_month(self.active_with_fraud())

    # Fraud

    @step
    def disputed_transactions(self) -> DataFrame:
        return fraud.disputed_transactions(self.src.transaction, self.src.dispute)

    @stage
    def fraud_orders(self) -> DataFrame:
        return fraud.fraud_orders(self.src.dispute, self.src.order, self.smb())

    @step
    def fraud_transactions(self) -> DataFrame:
        return fraud.fraud_transactions(self.src.transaction, self.fraud_orders())

    @stage
    def named_fraud(self) -> DataFrame:
        self._together("fraud_orders", "names")
        return fraud.named_fraud(self.src.transaction, self.fraud_orders(), self.names())

    @stage
    def fraud_values(self) -> DataFrame:
        return fraud.fraud_values(
            self.named_fraud(), self.src.transaction_amount, self.src.fx, self.p.fx_currency
        )

    @step
    def fraud_usd(self) -> DataFrame:
        return fraud.fraud_usd(self.named_fraud(), self.fraud_values())

    @stage
    def fraud_by_merchant_month(self) -> DataFrame:
        return fraud.fraud_by_merchant_month(self.fraud_usd())

    @step
    def fraud_by_month(self) -> DataFrame:
        return fraud.fraud_by_month(self.fraud_by_merchant_month())

    @stage
    def active_with_fraud(self) -> DataFrame:
        self._together("months_on_book", "merchant_balance_usd", "fraud_by_merchant_month")
        return fraud.active_with_fraud(self.active_with_balances(), self.fraud_by_merchant_month())

    @step
    def executive_dashboard(self) -> DataFrame:
        self._together("active_with_fraud", "names")
        return reports.executive_dashboard(
            reports.month_figures(self.active_with_fraud()),
            self.names_created_by_month(),
            self.first_transaction_counts(),
            self.churn_by_month(),
            self.fraud_by_month(),
        )

    # Attributes

    @step
    def top_account_per_merchant(self) -> DataFrame:
        return attributes.top_account_per_merchant(self.src.client_base, self.names())

    @stage
    def merchant_profiles(self) -> DataFrame:
        return attributes.merchant_profiles(self.top_account_per_merchant(), self.src.account)

    @step
    def active_distinct(self) -> DataFrame:
        """Rows that differed in NULL against 0 are equal by now."""
        return distinct_in_merchant(self.active_with_fraud())

    @step
    def active_mcc(self) -> DataFrame:
        return attributes.attach_mcc(self.active_distinct(), self.merchant_profiles())

    @step
    def active_attributes(self) -> DataFrame:
        """MCC and account attributes of the active rows, from one join."""
        return attributes.attach_active_profile(self.active_distinct(), self.merchant_profiles())

    @step
    def active_city(self) -> DataFrame:
        return attributes.standardise_city(self.active_attributes())

    @stage
    def group_fees(self) -> DataFrame:
        return attributes.group_fees(self.src.fee, self.src.charge_profile)

    @step
    def account_fees(self) -> DataFrame:
        return attributes.account_fees(self.group_fees(), self.src.account)

    @step
    def group_fee_columns(self) -> DataFrame:
        return attributes.fee_columns(self.group_fees(), "grupo_perfil_cobranza_id")

    @stage
    def merchant_fees(self) -> DataFrame:
        return attributes.merchant_fees(
            self.merchant_profiles(), self.group_fees(), self.group_fee_columns()
        )

    @stage
    def active_fees(self) -> DataFrame:
        self._together("active_with_fraud", "merchant_fees")
        return attributes.attach_fees(self.active_city(), self.merchant_fees(), self.p)

    @step
    def churn_attributes(self) -> DataFrame:
        """Attributes of the churn events; the referral stays raw here."""
        return attributes.attach_churn_profile(self.churn_events(), self.merchant_profiles())

    @step
    def churn_city(self) -> DataFrame:
        return attributes.standardise_city(self.churn_attributes())

    @step
    def churn_fees(self) -> DataFrame:
        return attributes.attach_fees(self.churn_city(), self.merchant_fees(), self.p)

    @step
    def account_dimension(self) -> DataFrame:
        return attributes.account_dimension(self.src.account, self.names())

    @step
    def created_city(self) -> DataFrame:
        return attributes.standardise_city(self.account_dimension())

    @step
    def created_fees(self) -> DataFrame:
        return attributes.attach_fees(self.created_city(), self.merchant_fees())

    @step
    def created_by_month_attributes(self) -> DataFrame:
        return attributes.created_by_month_attributes(
            self.account_dimension(), self.merchant_fees()
        )

    # RFM

    @stage
    def rfm_values(self) -> DataFrame:
        return rfm.rfm_values(self.merchant_month_financials(), self.p)

    @stage
    def rfm_medians(self) -> DataFrame:
        return rfm.bracketed_medians(self.rfm_values())

    @stage
    def computed_rfm(self) -> DataFrame:
        if self.p.rfm_thresholds is not None:
            return rfm.rfm_scores(self.rfm_values(), self.p)
        medians = self.rfm_medians()
        if rfm.missed(medians):
            medians = rfm.medians_by_digits(self.rfm_values())
        return rfm.rfm_scores(self.rfm_values(), self.p, medians)

    @step
    def rfm_scores(self) -> DataFrame:
        """The precomputed table if there is one, else the scores computed here."""
        return self.computed_rfm() if self.src.rfm is None else self.src.rfm

    @step
    def active_rfm(self) -> DataFrame:
        self._together("active_fees", "rfm_scores")
        return rfm.attach_rfm(self.active_fees(), self.rfm_scores())

    @step
    def active_without_rfm(self) -> DataFrame:
        return lifecycle.active_without_rfm(self.active_rfm())

    @step
    def churn_rfm(self) -> DataFrame:
        return rfm.attach_rfm(self.churn_fees(), self.rfm_scores())

    @step
    def back_from_churn_by_attributes(self) -> DataFrame:
        return attributes.back_from_churn_by_attributes(self.active_rfm(), self.p)

    @step
    def created_activated_by_attributes(self) -> DataFrame:
        return attributes.created_activated_by_attributes(self.active_rfm(), self.p)

    @step
    def first_trx_by_attributes(self) -> DataFrame:
        return attributes.first_trx_by_attributes(self.active_rfm(), self.p)

    @step
    def churn_by_attributes(self) -> DataFrame:
        return attributes.churn_by_attributes(self.churn_rfm())

    # States

    @step
    def active_state(self) -> DataFrame:
        return lifecycle.align_active(self.active_fees())

    @step
    def churn_tagged(self) -> DataFrame:
        return lifecycle.tag_state(self.churn_rfm(), lifecycle.CHURNED)

    @step
    def churn_state(self) -> DataFrame:
        return lifecycle.align_churn(self.churn_fees(), self.p)

    @step
    def union_active_churn(self) -> DataFrame:
        return lifecycle.union_states(self.active_state(), self.churn_state())

    @step
    def created_tagged(self) -> DataFrame:
        return lifecycle.tag_state(self.created_by_month_attributes(), lifecycle.CREATED)

    @step
    def created_state(self) -> DataFrame:
        return lifecycle.align_created(self.created_by_month_attributes(), self.p)

    @step
    def created_without_activation(self) -> DataFrame:
        return lifecycle.created_without_activation(self.created_state(), self.active_fees())

    @step
    def created_segment(self) -> DataFrame:
        """Segment and update flag on all created rows, flagged as activated or not."""
        flagged = lifecycle.flag_activated(self.created_state(), self.active_rfm())
        rows = lifecycle.management_segment(flagged, self.src.segment)
        return lifecycle.attach_update_flag(rows, self.src.up_down)

    @step
    def union_with_created(self) -> DataFrame:
        return lifecycle.union_states(
            self.active_state(), self.churn_state(), self.created_without_activation()
        )

    @step
    def management_segment(self) -> DataFrame:
        return lifecycle.management_segment(self.union_with_created(), self.src.segment)

    @step
    def attach_update_flag(self) -> DataFrame:
        return lifecycle.attach_update_flag(self.management_segment(), self.src.up_down)

    @stage(split="estado_", order=("mes",))
    def lifecycle_rows(self) -> DataFrame:
        return lifecycle.first_trx_marker(self.attach_update_flag())

    @step
    def signups(self) -> DataFrame:
        return lifecycle.signups(self.src.signup)

    @step
    def union_signups(self) -> DataFrame:
        """Several changes of a merchant in a month may have repeated a row: DISTINCT."""
        rows = lifecycle.align(self.lifecycle_rows(), lifecycle.LIFECYCLE_SCHEMA)
        return lifecycle.union_states(rows, self.signups()).distinct()

    # Reports

    @step
    def segment_dashboard(self) -> DataFrame:
        return reports.segment_dashboard(self.union_signups())

    @step
    def segment_dashboard_mcc(self) -> DataFrame:
        return reports.segment_dashboard_mcc(self.segment_dashboard(), self.src.mcc, self.p)

    @step
    def lifecycle_rfm(self) -> DataFrame:
        self._together("lifecycle_rows", "rfm_scores")
        return rfm.attach_rfm(self.lifecycle_rows(), self.rfm_scores())

    @step
    def rfm_summary(self) -> DataFrame:
        return rfm.rfm_summary(self.lifecycle_rfm(), self.p)

    @step
    def rfm_migration(self) -> DataFrame:
        return rfm.rfm_migration(self.lifecycle_rfm(), self.p)

    @step
    def rfm_migration_matrix(self) -> DataFrame:
        return rfm.migration_matrix(self.rfm_migration(), self.spark, self.p)

    @step
    def cohort_first_trx_by_attributes(self) -> DataFrame:
        return reports.cohort_first_trx_by_attributes(self.lifecycle_rows(), self.p)

    @step
    def cohort_creation_by_attributes(self) -> DataFrame:
        return reports.cohort_creation_by_attributes(self.lifecycle_rows(), self.p)

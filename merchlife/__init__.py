"""Merchant lifecycle analytics as Spark DataFrame jobs."""

from merchlife.params import Params
from merchlife.plans.monthly import monthly_run
from merchlife.plans.pipeline import MerchantPipeline
from merchlife.sources.tables import Sources

__all__ = ["MerchantPipeline", "Params", "Sources", "monthly_run"]

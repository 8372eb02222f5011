"""Run parameters. Every date the pipeline depends on is here, so a run repeats exactly."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


def shift_month(d: date, months: int) -> date:
    """First day of the month `months` away from the month of `d`."""
    index = d.year * 12 + d.month - 1 + months
    return date(index // 12, index % 12 + 1, 1)


@dataclass(frozen=True)
class Params:
    as_of: date

    # Thresholds, filters and report months of the monthly script.
    horizon: int = 36
    churn_months: int = 6
    dormant_months: int = 3
    groups: tuple[str, ...] = ("SMB", "Partnership")
    country: str = "CO"
    fx_currency: str = "COP"
    excluded_accounts: tuple[str, ...] = ("1", "2", "5", "501159", "515992", "592315")
    fee_snapshot_month: date = date(2022, 4, 1)
    review_month: date = date(2022, 3, 1)
    curve_start: date = date(2019, 4, 1)
    dashboard_start: date = date(2022, 7, 1)
    rfm_start: date = date(2022, 7, 1)
    cohort_start: date = date(2019, 5, 1)

    # True reproduces the inverted / constant referred flags of the original statements.
    reference_quirks: bool = False

    # Scoring window in months, and fixed thresholds in place of the monthly medians:
    # (recency in months, frequency in transactions, monetary in USD).
    rfm_window: int = 6
    rfm_thresholds: tuple[int, int, float] | None = None

    @property
    def as_of_month(self) -> date:
        return shift_month(self.as_of, 0)

    @property
    def first_month(self) -> date:
        """Oldest month of the calendar."""
        return shift_month(self.as_of, -self.horizon)

    @property
    def last_month(self) -> date:
        """Newest closed month of the calendar."""
        return shift_month(self.as_of, -1)

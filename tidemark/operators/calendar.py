"""Scheduled dates as plain date arithmetic: no calendar table and no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRIDAY = 4


def nth_weekday(month: Column, weekday: int, n: int) -> Column:
    """The ``n``-th ``weekday`` (Monday is 0) of the month that starts at ``month``."""
    return F.date_add(month, F.pmod(F.lit(weekday) - F.weekday(month), F.lit(7)) + 7 * (n - 1))


def calendar_features(days: DataFrame) -> DataFrame:
    """Adds weekday, expiry (third Friday) and payrolls (first Friday) columns to rows with a ``date``."""
    month = F.trunc("date", "month")
    payrolls = nth_weekday(month, FRIDAY, 1)
    following = nth_weekday(F.add_months(month, 1), FRIDAY, 1)
    return days.withColumns(
        {
            "weekday": F.weekday("date").cast("long"),
            "is_expiry": F.col("date") == nth_weekday(month, FRIDAY, 3),
            "days_to_payrolls": F.datediff(F.when(payrolls > F.col("date"), payrolls).otherwise(following), "date").cast("long"),
            "days_to_month_end": F.datediff(F.last_day("date"), "date").cast("long"),
        }
    )


# Central-bank meeting dates, as published.
MEETINGS = """
2019-01-30 2019-03-20 2019-05-01 2019-06-19 2019-07-31 2019-09-18 2019-10-30 2019-12-11
2020-01-29 2020-03-03 2020-03-15 2020-03-18 2020-04-29 2020-06-10 2020-07-29 2020-09-16 2020-11-05 2020-12-16
2021-01-27 2021-03-17 2021-04-28 2021-06-16 2021-07-28 2021-09-22 2021-11-03 2021-12-15
2022-01-26 2022-03-16 2022-05-04 2022-06-15 2022-07-27 2022-09-21 2022-11-02 2022-12-14
2023-02-01 2023-03-22 2023-05-03 2023-06-14 2023-07-26 2023-09-20 2023-11-01 2023-12-13
2024-01-31 2024-03-20 2024-05-01 2024-06-12 2024-07-31 2024-09-18 2024-11-07 2024-12-18
2025-01-29 2025-03-19 2025-05-07 2025-06-18 2025-07-30 2025-09-17 2025-10-29 2025-12-10
2026-01-28 2026-03-18 2026-04-29 2026-06-17 2026-07-29 2026-09-16 2026-11-04 2026-12-16
""".split()
TUESDAY, THURSDAY = 1, 3


def _month(day: Column) -> Column:
    return F.trunc(day, "month")


def is_payrolls(day: Column) -> Column:
    return day == nth_weekday(_month(day), FRIDAY, 1)


def is_prices(day: Column) -> Column:
    """The second Tuesday stands for the consumer price release."""
    return day == nth_weekday(_month(day), TUESDAY, 2)


def is_purchasing(day: Column) -> Column:
    """The first business day of the month."""
    first = _month(day)
    return day == F.date_add(first, F.greatest(F.lit(7) - F.weekday(first), F.lit(0)) * (F.weekday(first) >= 5).cast("int"))


def is_product(day: Column) -> Column:
    """The last Thursday of January, April, July and October."""
    last = F.last_day(day)
    return F.month(day).isin(1, 4, 7, 10) & (day == F.date_sub(last, F.pmod(F.weekday(last) - THURSDAY, F.lit(7))))


def is_expiry(day: Column) -> Column:
    return day == nth_weekday(_month(day), FRIDAY, 3)


def _weekdays(day: Column) -> list[Column]:
    monday = F.date_sub(day, F.weekday(day))
    return [F.date_add(monday, i) for i in range(5)]


def event_calendar(days: DataFrame, none: int = 45) -> DataFrame:
    """Adds meeting, expiry and economic release columns to rows with a ``date``.

    The next meeting is after the day, the last one on or before it; ``none`` days stand for a
    missing one. Major releases are payrolls, prices and product. The list of meetings is a literal
    of the plan; all else is date arithmetic.
    """
    day = F.col("date")
    meetings = F.array(*[F.lit(d).cast("date") for d in MEETINGS])
    meets = lambda d: F.array_contains(meetings, d)
    any_of = lambda test: F.greatest(*[test(d).cast("long") for d in _weekdays(day)])
    major = lambda d: is_payrolls(d) | is_prices(d) | is_product(d)
    before = F.date_sub(day, F.when(F.weekday(F.date_sub(day, 1)) == 6, 2).otherwise(1))
    expiry = nth_weekday(_month(day), FRIDAY, 3)
    next_expiry = F.when(expiry > day, expiry).otherwise(nth_weekday(F.add_months(_month(day), 1), FRIDAY, 3))
    flag = lambda test: test.cast("long")
    rows = days.withColumns(
        {
            "fomc_is_meeting_day": flag(meets(day)),
            "fomc_is_day_before": flag(meets(F.date_add(day, 1)) | (meets(F.date_add(day, 3)) & (F.weekday(day) == FRIDAY))),
            "fomc_is_day_after": flag(meets(before)),
            "fomc_days_until_next": F.coalesce(F.datediff(F.array_min(F.filter(meetings, lambda m: m > day)), day), F.lit(none)).cast("long"),
            "fomc_days_since_last": F.coalesce(F.datediff(day, F.array_max(F.filter(meetings, lambda m: m <= day))), F.lit(none)).cast("long"),
            "fomc_is_meeting_week": any_of(meets),
            "opex_is_monthly": flag(is_expiry(day)),
            "opex_is_quad_witching": flag(is_expiry(day) & (F.month(day) % 3 == 0)),
            "opex_days_until_next": F.datediff(next_expiry, day).cast("long"),
            "opex_is_expiration_week": any_of(is_expiry),
            "opex_is_day_before": flag(is_expiry(F.date_add(day, 1))),
            "econ_is_nfp_day": flag(is_payrolls(day)),
            "econ_is_cpi_day": flag(is_prices(day)),
            "econ_is_pmi_day": flag(is_purchasing(day)),
            "econ_is_gdp_day": flag(is_product(day)),
            "econ_is_major_release": flag(major(day)),
            "econ_releases_this_week": sum((flag(major(d)) for d in _weekdays(day)), F.lit(0)),
        }
    )
    until, since = F.col("fomc_days_until_next"), F.col("fomc_days_since_last")
    return rows.withColumn("fomc_cycle_position", until / (until + since + 1))

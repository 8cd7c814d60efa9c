"""Numeric column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ELEMENTARY_CHARGE_C = 1.602e-19
PM_TO_M = 1e-12
BOHR_RADIUS_PM = 52.9177210903


def safe_log10(value: Column) -> Column:
    return F.when(value > 0, F.log10(value))


def safe_diff(a: Column, b: Column) -> Column:
    return a - b


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def charge_density(charge: Column, radius_pm: Column) -> Column:
    """Charge over sphere volume in C/m3; 0 for a point radius."""
    meters = radius_pm * F.lit(PM_TO_M)
    volume = F.lit(4 * math.pi) * F.pow(meters, F.lit(3.0)) / F.lit(3.0)
    return F.when(radius_pm == 0, F.lit(0.0)).otherwise(
        F.abs(charge) * F.lit(ELEMENTARY_CHARGE_C) / volume
    )


def ionic_potential(charge: Column, radius_pm: Column) -> Column:
    return F.when(radius_pm != 0, F.abs(charge) / radius_pm)


def to_si(milli: Column) -> Column:
    return milli / F.lit(1000.0)


def unlog10(value: Column) -> Column:
    return F.pow(F.lit(10.0), value)


def trend_label(delta: Column, threshold: float = 1e-4) -> Column:
    """Direction of a change with an unchanged band of ``threshold``."""
    finite = delta.isNotNull() & ~F.isnan(delta) & (F.abs(delta) != F.lit(float("inf")))
    return (
        F.when(~finite, F.raise_error(F.lit("changes must be finite")))
        .when(delta > threshold, "increase")
        .when(delta < -threshold, "decrease")
        .otherwise("unchanged")
    )

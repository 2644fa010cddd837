"""Which checks run, and their thresholds, from a relation of (Setting, Value): plans are pruned before they run."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbook.functions import numbers as N

#: The checks that can be switched off.
CHECKS = ["Total_Liability", "HSN_vs_Supply_Tables", "B2CL_Threshold", "Record_Count", "Interstate_Tax", "CDNR_Sign_Check", "Payment_Recon_6_1", "ITC_Math", "RCM_CrossCheck"]
#: The settings of thresholds, and the tolerance that each sets.
THRESHOLDS = {"variance_tolerance": "gst", "hsn_supply_variance_pct": "hsn_percent", "b2cl_invoice_threshold": "b2cl_average", "rcm_crosscheck_gap_pct": "rcm_percent"}
ENABLED = "checks_enabled"


@dataclass(frozen=True)
class Settings:
    """enabled: the checks that are on, all if null."""

    tolerances: N.Tolerances = N.DEFAULT
    enabled: frozenset[str] | None = None


def settings(config: DataFrame) -> Settings:
    """From rows (Setting, Value): thresholds as numbers, and a row of checks_enabled for each check that is on; without any
    such row all are on, and a blank value switches none on. Blank or null settings are left out. An unknown setting or check,
    a threshold that is no number, or two values of one threshold are refused, all at once."""
    known = [*THRESHOLDS, ENABLED]
    rows = config.select(F.trim("Setting").alias("k"), F.trim(F.coalesce("Value", F.lit(""))).alias("v")).where("k <> ''").distinct().limit(10 * (len(CHECKS) + len(THRESHOLDS)) + 1).collect()
    wrong = sorted({f"unknown setting {r.k}" for r in rows if r.k not in known} | {f"unknown check {r.v}" for r in rows if r.k == ENABLED and r.v and r.v not in CHECKS})
    values: dict[str, float] = {}
    for k, v in sorted((r.k, r.v) for r in rows if r.k in THRESHOLDS):
        try:
            number = float(v)
        except ValueError:
            wrong.append(f"{k} is no number: {v}")
            continue
        if values.setdefault(THRESHOLDS[k], number) != number:
            wrong.append(f"{k} has several values")
    if wrong:
        raise ValueError("; ".join(wrong))
    on = [r.v for r in rows if r.k == ENABLED]
    return Settings(replace(N.DEFAULT, **values), frozenset(c for c in on if c) if on else None)

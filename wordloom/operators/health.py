"""Checks over tables, one row each, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(table: DataFrame, name: str, fails: Column, warns: Column | None = None) -> DataFrame:
    """``name, status, detail``: FAIL if a row fails, WARN if one warns, else PASS, with the numbers of both."""
    counts = table.agg(F.count_if(fails).alias("f"), F.count_if(warns if warns is not None else F.lit(False)).alias("w"))
    status = F.when(F.col("f") > 0, "FAIL").when(F.col("w") > 0, "WARN").otherwise("PASS")
    return counts.select(F.lit(name).alias("name"), status.alias("status"), F.format_string("%d failed, %d warned", "f", "w").alias("detail"))


def together(*checks: DataFrame) -> DataFrame:
    """The checks as one table."""
    all_checks = checks[0]
    for one in checks[1:]:
        all_checks = all_checks.union(one)
    return all_checks


def summary(checks: DataFrame) -> DataFrame:
    """``passed, warned, failed``: how many checks ended how."""
    return checks.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("WARN", "warned"), ("FAIL", "failed"))])

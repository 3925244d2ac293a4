"""Queries over repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.operators.delivery import kept_deliveries, surplus_deliveries
from wordloom.plans.registry import Registry
from wordloom.session import read_table

registry = Registry()

_KEYED = r"""
WITH keyed AS (
  SELECT delivery_id,
         lower(regexp_replace(operation_id, '^\s+|\s+$', '', 'g')) AS op,
         regexp_replace(lower(regexp_replace(coalesce(receipt.payload_hash, payload_hash), '^\s+|\s+$', '', 'g')),
                        '^sha256:', '') AS hash,
         CASE WHEN regexp_full_match(trim(queued_at),
                   '\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})')
              THEN try_cast(trim(queued_at) AS TIMESTAMPTZ) END AS instant
  FROM memory_operations WHERE operation_id IS NOT NULL
)"""
_SURPLUS = f"""{_KEYED}
SELECT delivery_id FROM (
  SELECT delivery_id, row_number() OVER (PARTITION BY op, hash ORDER BY instant NULLS LAST, delivery_id) AS n FROM keyed
) WHERE n > 1
"""


@registry.query("p4_found", _SURPLUS)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surplus_deliveries(read_table(spark, sf_dir, "memory_operations"))


_KEPT = f"""{_KEYED}
SELECT delivery_id, deliveries FROM (
  SELECT delivery_id, row_number() OVER (PARTITION BY op, hash ORDER BY instant NULLS LAST, delivery_id) AS n, count(*) OVER (PARTITION BY op, hash) AS deliveries FROM keyed
) WHERE n = 1
"""


@registry.query("p4_kept", _KEPT)
def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery of each message that stays, and how many there were."""
    return kept_deliveries(read_table(spark, sf_dir, "memory_operations")).select("delivery_id", "deliveries")

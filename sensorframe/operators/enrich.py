"""Enrichment and key joins (JN1, JN2, JN4).

Facts use ``ID``, metadata uses ``id``. Spark resolves names case-
insensitively, so metadata's key is renamed to ``ID`` and the join is a
USING join that keeps one key column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe import model
from sensorframe.operators.joins import BROADCAST_MAX_ROWS, bounded_broadcast


def meta_keyed(meta: DataFrame) -> DataFrame:
    return meta.select(F.col("id").alias("ID"), *model.META_ATTRS)


def enrich(facts: DataFrame, meta: DataFrame, broadcast_max_rows: int | None = BROADCAST_MAX_ROWS) -> DataFrame:
    """Left join facts with metadata: unmatched facts keep NULL metadata,
    duplicate metadata ids fan out. Metadata is a dimension table and is
    broadcast after a row count check."""
    m = meta_keyed(meta)
    if broadcast_max_rows:
        m = bounded_broadcast(m, broadcast_max_rows)
    out = facts.join(m, "ID", "left")
    return out.select(*model.FACT_COLUMNS, *model.META_ATTRS)


def semi_keys(facts: DataFrame, ids: DataFrame, channels: DataFrame,
              broadcast_max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Facts whose ``ID`` is in ``ids`` and ``type`` in ``channels``.

    Semi joins: duplicate keys on the right add no rows.
    """
    i = bounded_broadcast(ids.select(F.col(ids.columns[0]).cast("bigint").alias("ID")), broadcast_max_rows)
    c = bounded_broadcast(channels.select(F.col(channels.columns[0]).alias("type")), broadcast_max_rows)
    return facts.join(i, "ID", "left_semi").join(c, "type", "left_semi").select(*model.FACT_COLUMNS)


def values_without_data(selected: DataFrame, data: DataFrame, col: str = "vanity") -> DataFrame:
    """Chosen values (e.g. vanities) with no row in ``data``, of which only the distinct values are shuffled."""
    s = selected.select(col).filter(F.col(col).isNotNull()).distinct()
    present = data.select(col).filter(F.col(col).isNotNull()).distinct()
    return s.join(present, col, "left_anti")

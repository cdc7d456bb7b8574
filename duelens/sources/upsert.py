"""Insert-or-replace by key on plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelens.schema import RECORD_KEY

KEPT = ["meta_id", "meta_created"]


def upsert(
    current: DataFrame,
    incoming: DataFrame,
    now: Column,
    key: str = RECORD_KEY,
    order: list[str] | None = None,
) -> DataFrame:
    """Whole-row replace by key; a field the new row lacks becomes null.

    Of several incoming rows of a key the last by ``order`` counts (by all its columns, if no
    order is given).  ``meta_id`` and ``meta_created`` of a known record
    stay, ``meta_updated`` becomes ``now``.  One full join, one shuffle of each side.
    """
    rest = [c for c in incoming.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*(order or rest)))
    newest = incoming.groupBy(key).agg(last.alias("last")).select(key, "last.*")
    old, new = current.alias("old"), newest.alias("new")
    arrived = F.col(f"new.{key}").isNotNull()
    columns = []
    for name in current.columns:
        before = F.col(f"old.{name}")
        after = F.col(f"new.{name}") if name in incoming.columns else F.lit(None)
        if name == key:
            value = F.coalesce(before, after)
        elif name == "meta_id":
            value = F.coalesce(before, after)
        elif name == "meta_created":
            value = F.coalesce(before, now)
        elif name == "meta_updated":
            value = F.when(arrived, now).otherwise(before)
        else:
            value = F.when(arrived, after).otherwise(before)
        columns.append(value.alias(name))
    return old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer").select(*columns)


def current_records(
    versions: DataFrame, order: list[str], key: str = RECORD_KEY
) -> DataFrame:
    """The record table from all versions ever written, newest by ``order``.

    The upsert rule over many batches at once: the newest row counts, the oldest gives
    ``meta_id`` and ``meta_created``.  Partial aggregates, so a record written very often
    shrinks before the shuffle.
    """
    rest = [c for c in versions.columns if c != key and c not in KEPT]
    rank = F.struct(*order)
    kept = [c for c in KEPT if c in versions.columns]
    grouped = versions.groupBy(key).agg(
        F.max_by(F.struct(*rest), rank).alias("newest"),
        *[F.min_by(c, rank).alias(c) for c in kept],
    )
    return grouped.select(key, *kept, *[F.col(f"newest.{c}").alias(c) for c in rest])


def upsert_history(history: DataFrame, headline: DataFrame) -> DataFrame:
    """History with the row of the headline's scrape date put in or replaced."""
    return history.join(headline.select("scrape_date"), "scrape_date", "left_anti").unionByName(
        headline, allowMissingColumns=True
    )

"""Joins of facts with a lookup side, safe against a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parts a hot key is split into when the lookup side has to be shuffled.
SALTS = 32

_SALT = "__salt"


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join that spreads every key of ``facts`` over ``salts`` shuffle partitions.

    ``lookup`` holds one row per key and is repeated once per salt.  The salt is a
    hash of ``spread_by``, so a task that runs again makes the same rows.  Adaptive
    execution still turns the join into a broadcast if the lookup proves small.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how!r}")
    salted = facts.withColumn(_SALT, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, _SALT], how).drop(_SALT)


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner"
) -> DataFrame:
    """Equi-join with a lookup side of unknown size.

    Adaptive execution knows the bytes of both sides when they are shuffled: it broadcasts a
    small lookup and splits the partitions of a hot key.
    """
    return facts.join(lookup, on, how)

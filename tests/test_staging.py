"""Staged tables without any setting for a shared folder."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from duelens.operators.staging import discard, discarding, staged

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import os
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
from duelens.operators.staging import new_path, shared_folder, staged
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_folder(spark) == shared_folder(spark)
assert new_path(spark) != new_path(spark)
rows = staged(spark.range(10))
again = staged(spark.range(10, 30))
assert (rows.count(), again.count()) == (10, 20)
assert spark.conf.get("spark.checkpoint.dir", None) is None
from duelens.plans.catalogue import QUERIES
first = QUERIES["sponsor_json_round_trip"](spark, "/root/testdata/sf0.001")
second = QUERIES["sponsor_json_round_trip"](spark, "/root/testdata/sf0.001")
assert first.count() == second.count() > 0
print("done")
"""


def test_a_stock_session(tmp_path):
    """A fresh process without any Spark settings, as a new user has it."""
    conf = tmp_path / "conf"
    conf.mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK", "PYSPARK"))}
    env |= {"SPARK_CONF_DIR": str(conf), "PYTHONPATH": str(ROOT)}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert done.stdout.strip().endswith("done"), done.stderr[-3000:]


def test_tables_are_removed_when_they_are_not_needed(spark):
    one, two = staged(spark.range(5)), staged(spark.range(6))
    discard(one)
    assert not Path(one._staged_at).exists()
    assert two.count() == 6
    with discarding(spark):
        inner, kept = staged(spark.range(7)), staged(spark.range(8), keep=True)
        with pytest.raises(ValueError, match="lost"), discarding(spark):
            last = staged(inner.where("id > 2"))
            raise ValueError("lost")
        assert not Path(last._staged_at).exists()
        assert inner.count() == 7
    assert not Path(inner._staged_at).exists()
    assert (two.count(), kept.count()) == (6, 8)


def test_staging_leaves_the_settings_as_they_were(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    rows = staged(spark.range(100).selectExpr("id % 3 AS k").groupBy("k").count())
    assert rows.count() == 3
    assert spark.conf.get(name) == before


def test_wide_jobs_are_compiled_and_the_setting_is_put_back(spark):
    from duelens.operators import staging

    seen = []

    class Watched:
        sparkSession = spark
        schema = spark.range(3).schema

        @property
        def write(self):
            seen.append(spark.conf.get(staging._METHOD_LIMIT))
            return spark.range(3).write

    before = spark.conf.get(staging._METHOD_LIMIT)
    assert staging.staged(Watched(), wide=True).count() == 3
    assert staging.staged(Watched()).count() == 3
    assert seen == ["8000", before] and spark.conf.get(staging._METHOD_LIMIT) == before


def test_joins_with_narrow_sides_are_hashed_and_settings_put_back(spark):
    from duelens.operators import staging

    seen = []
    names = [staging._HASH_LIMIT, staging._LISTS_HASHED]

    class Watched:
        sparkSession = spark
        schema = spark.range(3).schema

        @property
        def write(self):
            seen.append([spark.conf.get(name) for name in names])
            return spark.range(3).write

    before = [spark.conf.get(name) for name in names]
    assert staging.staged(Watched(), lookups=True, sort=True).count() == 3
    assert staging.staged(Watched()).count() == 3
    assert seen == [["64m", "false"], before]
    assert [spark.conf.get(name) for name in names] == before

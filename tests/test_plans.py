"""Physical plans: no cartesian joins, pruned scans, no local checkpoints."""

import os
import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from twofold.operators import trials
from twofold.plans.ensemble import Study
from twofold.sources import tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert entry(spark).count() > 0


def test_contract():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["t4_clean_trials", "f6_closed_form_loo", "w8_stacking_gradient", "e4_expected_values", "x15_effect_sizes", "m4_two_part_product"])
def test_no_cartesian_product(spark, sf_dir, name):
    text = plan(queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_needed_columns(spark, sf_dir):
    text = plan(trials.count_classes(Study(spark, sf_dir).trials))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any(s.startswith("l_orderkey") for s in schemas)
    assert all("price" not in s and "date" not in s for s in schemas)
    assert "partial_count" in text


def test_no_local_checkpoint_and_no_broadcast_hint():
    for folder, folders, files in os.walk(os.path.join(ROOT, "twofold")):
        folders[:] = [f for f in folders if f != "llm"]
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f)).read()
                assert "localCheckpoint" not in text and "broadcast(" not in text


def test_shared_stage_is_rebuilt_when_lost(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(5)

    assert tables.stage_once(spark, ("k",), "probe", build).count() == 5
    assert tables.stage_once(spark, ("k",), "probe", build).count() == 5
    assert len(made) == 1
    tables.forget_stages()
    assert tables.stage_once(spark, ("k",), "probe", build).count() == 5
    assert len(made) == 2


def test_delimited_round_trip_keeps_nulls(spark, tmp_path):
    rows = [(1, "AFRICA", "F", "ASIA", None, 3, "y"), (2, "ASIA", "G", "ASIA", "b", 0, "n")]
    df = spark.createDataFrame(rows, tables.TRIAL_SCHEMA)
    path = str(tmp_path / "csv")
    tables.write_delimited(df, path)
    assert sorted(map(tuple, tables.read_delimited(spark, path).collect())) == rows

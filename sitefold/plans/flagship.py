"""The whole job: each site against its storage, all sites together, one repair action per object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import central, local
from .fixtures import Tables, standalone
from .queries import START

#: The same rows in SQL.
EVERYTHING = standalone("SELECT bucket, name, need_action, need_action_from, sites FROM {o_everything}")


def reconcile_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    sites = ["site-a", "site-b", "site-c"]
    start = F.lit(START).cast("timestamp_ntz")
    states = local.reconcile_sites(t.f_objects, t.f_driver, start)
    actions = central.compute_actions(states, sites, on=("bucket", "name"))
    return actions.select("bucket", "name", "need_action", F.array_join("need_action_from", ",").alias("need_action_from"), F.array_join("sites", ",").alias("sites"))

"""Sites' states as they arrive: the states of each object are kept, and actions come out where they change."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.central import compute_actions
from ..operators.orders import zoneless_micros

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Stands for a state without a time, which any other of its round replaces.
NEVER = -(1 << 62)
STATES = "name string, now boolean, site string, event timestamp_ntz, nstatus int"


class SiteStates(StatefulProcessor):
    """State of each site of one object. A listing that arrives replaces what its site has said before.

    ``round`` numbers a site's listings; within one the latest event counts, and of those the smallest
    code. A state of an earlier round than the known one is passed over, so repeats change nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sites = handle.getMapState("sites", "site string", "round long, micros long, nstatus int")

    def handleInputRows(self, key, rows, timerValues):
        before = {s[0]: tuple(v) for s, v in self.sites.iterator()}
        after = dict(before)
        for frame in rows:
            for site, number, micros, nstatus in zip(frame.site, frame["round"], frame.micros, frame.nstatus, strict=True):
                new, old = (int(number), int(micros), int(nstatus)), after.get(site)
                if old is None or (new[0], new[1], -new[2]) > (old[0], old[1], -old[2]):
                    after[site] = new
        if after == before:
            return
        for site, new in after.items():
            if before.get(site) != new:
                self.sites.updateValue((site,), new)
        listed = [(key[0], now, site, pd.NaT if v[1] == NEVER else pd.Timestamp(v[1], unit="us"), v[2]) for now, states in ((False, before), (True, after)) for site, v in states.items()]
        yield pd.DataFrame(listed, columns=["name", "now", "site", "event", "nstatus"])

    def close(self) -> None:
        pass


def states_stream(listings: DataFrame) -> DataFrame:
    """For objects whose states change: all their states before (now = false) and after, for output mode update.

    ``listings``: name, site, round, event, nstatus. Needs the RocksDB state store. One call of Python for
    each object of a batch: for small batches of many; ``tables_writer`` takes large ones.
    """
    micros = F.coalesce(zoneless_micros(F.col("event").cast("timestamp_ntz")), F.lit(NEVER))
    rows = listings.select("name", "site", F.col("round").cast("long").alias("round"), micros.alias("micros"), F.col("nstatus").cast("int").alias("nstatus"))
    return rows.groupBy("name").transformWithStateInPandas(statefulProcessor=SiteStates(), outputStructType=STATES, outputMode="Update", timeMode="None")


def changed_actions(states: DataFrame, sites: Sequence[str]) -> DataFrame:
    """Of a batch of ``states_stream``: the actions that are new or other than before, and those withdrawn (need_action null)."""
    on = ["name"]
    now, before = (compute_actions(states.where(F.col("now") == x), sites, on) for x in (True, False))
    values = [c for c in now.columns if c not in on]
    joined = now.select(*on, F.struct(*values).alias("now_")).join(before.select(*on, F.struct(*values).alias("was_")), on, "full_outer")
    return joined.where(~F.col("now_").eqNullSafe(F.col("was_"))).select(*on, "now_.*")


def actions_writer(path: str, sites: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """An idempotent sink for ``foreachBatch``: each batch's changed actions in a folder of their own."""

    def write(states: DataFrame, batch: int) -> None:
        changed_actions(states, sites).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


LISTED = "name string, site string, round long, event timestamp_ntz, nstatus int"


def tables_writer(spark: SparkSession, path: str, sites: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that takes the listings themselves (name, site, round, event, nstatus) and keeps states in tables.

    The rules are those of ``SiteStates``, as joins and aggregations in ``spark``. ``states/batch=n`` gets the
    states that batch n changes, ``actions/batch=n`` the actions that it changes. What was known before is
    the greatest state of each site in the folders of earlier batches, so a batch that is run again replaces
    its own and changes nothing else. Each batch reads all states of before: for large batches.
    """
    key, values = ["name", "site"], ["round", "event", "minus"]
    told = lambda rows: rows.withColumn("minus", -F.col("nstatus")).groupBy(*key).agg(F.max(F.struct(*values)).alias("s"))
    plain = lambda rows: rows.select(*key, "s.round", "s.event", (-F.col("s.minus")).cast("int").alias("nstatus"))

    def write(listings: DataFrame, batch: int) -> None:
        form = [F.col(c).cast(t).alias(c) for c, t in (x.split() for x in LISTED.split(", "))]
        listings.select(*form).write.mode("overwrite").parquet(f"{path}/arrived")
        arrived = told(spark.read.schema(LISTED).parquet(f"{path}/arrived"))
        known = told(spark.createDataFrame([], LISTED))
        if batch:
            log = spark.read.schema(f"{LISTED}, batch long").parquet(f"{path}/states").where(F.col("batch") < batch)
            known = told(log)
        newer = arrived.join(known.withColumnRenamed("s", "was"), key, "left").where("was is null or s > was")
        plain(newer).write.mode("overwrite").parquet(f"{path}/states/batch={batch}")
        changed = spark.read.schema(LISTED).parquet(f"{path}/states/batch={batch}")
        before = plain(known).join(changed.select("name").distinct(), "name", "left_semi")
        after = plain(told(before.unionByName(changed)))
        states = before.withColumn("now", F.lit(False)).unionByName(after.withColumn("now", F.lit(True)))
        changed_actions(states, sites).write.mode("overwrite").parquet(f"{path}/actions/batch={batch}")

    return write


def latest_actions(changes: DataFrame) -> DataFrame:
    """The actions that stand after all batches. ``changes``: what ``actions_writer`` has written."""
    values = [c for c in changes.columns if c not in ("name", "batch")]
    last = changes.groupBy("name").agg(F.max_by(F.struct(*values), "batch").alias("a_"))
    return last.select("name", "a_.*").where("need_action is not null")

"""Reconciliation of all sites: merges their states and derives one repair action per object.

States are exploded rows: name (with whatever other key columns), site, event, nstatus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as m

ON = ("name",)


def newest_per_site(states: DataFrame, on: Sequence[str] = ON) -> DataFrame:
    """One row per key and site: the latest event, and of those the smallest code."""
    best = F.max_by(F.struct("event", "nstatus"), F.struct(F.col("event"), -F.col("nstatus"))).alias("best")
    return states.groupBy(*on, "site").agg(best).select(*on, "site", "best.event", "best.nstatus")


def merge_site_listing(old: DataFrame, new: DataFrame, on: Sequence[str] = ON) -> DataFrame:
    """The incoming states replace those of the same site; the others stay. Running it again changes nothing."""
    columns = [*on, "site", "event", "nstatus"]
    new = newest_per_site(new, on)
    return old.select(*columns).join(new, [*on, "site"], "left_anti").unionByName(new.select(*columns))


def sort_states(states: DataFrame, on: Sequence[str] = ON) -> DataFrame:
    """Adds the place of each state: latest first, then smallest code, then site."""
    order = Window.partitionBy(*on).orderBy(F.desc("event"), "nstatus", "site")
    return states.withColumn("place", F.row_number().over(order))


def primary_state(states: DataFrame, on: Sequence[str] = ON) -> DataFrame:
    return states.groupBy(*on).agg(_primary().alias("primary"))


def _primary() -> Column:
    return F.max_by("nstatus", F.struct(F.col("event"), -F.col("nstatus")))


def missing_sites(states: DataFrame, sites: Sequence[str], on: Sequence[str] = ON) -> DataFrame:
    return states.groupBy(*on).agg(F.array_except(_sites(sites), F.collect_set("site")).alias("missing"))


def _sites(sites: Sequence[str]) -> Column:
    return F.array(*(F.lit(s) for s in sites)).cast("array<string>")


def target_union(missing: Column, targets: Column) -> Column:
    return F.array_sort(F.array_union(missing, targets))


def compute_actions(states: DataFrame, sites: Sequence[str], on: Sequence[str] = ON, repair_partial: bool = False) -> DataFrame:
    """key, need_action, need_action_from, sites: one aggregation and one chain of conditions.

    Arrays are sorted. An object that is READY wherever it is known asks for nothing, though a site of
    the context lacks it, unless ``repair_partial``.
    """
    n = F.col("nstatus")
    some = lambda *codes: F.bool_or(n.isin(*codes))
    where = lambda c: F.collect_set(F.when(c, F.col("site")))
    g = states.groupBy(*on).agg(
        _primary().alias("primary"),
        F.collect_set("site").alias("known"),
        where(n == m.READY).alias("ready"),
        where(n == m.UPDATE).alias("update"),
        where(n != m.DELETED).alias("not_deleted"),
        where(n != m.READY).alias("not_ready"),
        some(m.DELETE, m.READY, m.UPDATE, m.UPLOAD).alias("undeleted"),
        some(m.DELETED, m.DELETE, m.UPDATE, m.UPLOAD).alias("unready"),
        F.bool_or((n <= m.DELETE) | (n >= m.UPLOAD)).alias("absent"),
        some(m.READY, m.UPDATE).alias("held"),
    )
    g = g.withColumn("missing", F.array_except(_sites(sites), "known"))
    partial = (F.size("missing") > 0) if repair_partial else F.lit(False)
    p = F.col("primary")
    lacks = F.col("absent") | partial
    action = (
        F.when(p.isin(m.DELETE, m.DELETED), F.when(F.col("undeleted"), m.DELETE))
        .when(p.isin(m.READY, m.UPDATE), F.when(F.col("unready") | partial, F.when(lacks, m.UPLOAD).otherwise(m.UPDATE)))
        .when(p == m.UPLOAD, F.when(F.col("held"), m.UPLOAD).otherwise(m.ERROR))
    )
    g = g.withColumn("need_action", action).where("need_action is not null")
    gone = F.col("need_action").isin(m.DELETE, m.ERROR)
    targets = target_union(F.col("missing"), F.when(gone, F.col("not_deleted")).otherwise(F.col("not_ready")))
    origin = F.when(~gone, F.array_sort(F.when(F.size("ready") > 0, F.col("ready")).otherwise(F.col("update"))))
    out = g.select(*on, "need_action", origin.alias("need_action_from"), targets.alias("sites"), "primary")
    return out.where(F.size("sites") > 0)


def actions_of_kind(actions: DataFrame, kind: str) -> DataFrame:
    """``delete``, ``ready``, ``upload`` or ``error``: the rule that gave the action, by its primary state."""
    p = F.col("primary")
    rule = {
        "delete": p.isin(m.DELETE, m.DELETED),
        "ready": p.isin(m.READY, m.UPDATE),
        "upload": (p == m.UPLOAD) & (F.col("need_action") == m.UPLOAD),
        "error": F.col("need_action") == m.ERROR,
    }
    return actions.where(rule[kind])


def count_actions(actions: DataFrame) -> DataFrame:
    return actions.groupBy("need_action").agg(F.count("*").alias("n"))


def site_progress(requests: DataFrame) -> DataFrame:
    """``requests`` with current_site, context_sites, context_sites_done: marks the current site done, and says who is left."""
    done = F.array_union("context_sites_done", F.array("current_site"))
    return requests.withColumn("context_sites_done", done).withColumn("still_missing", F.array_except("context_sites", "context_sites_done"))


def actions_of_request(actions: DataFrame, request: str, bucket: str) -> DataFrame:
    return actions.where((F.col("request_id") == request) & (F.col("bucket") == bucket))


def request_totals(listing: DataFrame, actions: DataFrame) -> DataFrame:
    """Per request: objects checked, states checked, actions, and actions that fetch content."""
    on = ["bucket", "name"]
    checked = listing.groupBy("request_id", *on).agg(F.count("*").alias("n")).groupBy("request_id").agg(F.count("*").alias("checked"), F.sum("n").alias("checked_states"))
    fetch = F.count_if(F.col("need_action").isin(m.UPLOAD, m.UPDATE))
    done = actions.groupBy("request_id").agg(F.count("*").alias("actions"), fetch.alias("fetches"))
    joined = checked.join(done, "request_id", "left")
    return joined.select("request_id", "checked", "checked_states", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("actions", "fetches")))


def actions_for_site(actions: DataFrame, site: str) -> DataFrame:
    return actions.where(F.array_contains("sites", site))


def actions_to_orders(actions: DataFrame, on: Sequence[str] = ON) -> DataFrame:
    """One order per action and target site; the source is the first of the sites to take it from."""
    source = F.element_at("need_action_from", 1)
    return actions.select(*on, "need_action", source.alias("from_site"), F.explode("sites").alias("to_site"))


#: Action, status of the object, its status in the catalog afterwards (none: the pair is invalid), step in storage.
OUTCOMES = (
    ("DELETE", "UPLOAD", "DELETED", "DELETE_IF_EXISTS"),
    ("DELETE", "READY", "DELETED", "DELETE_IF_EXISTS"),
    ("DELETE", "ERR_UPL", "DELETED", "DELETE_IF_EXISTS"),
    ("DELETE", "DELETING", "DELETED", "DELETE_IF_EXISTS"),
    ("DELETE", "DELETED", None, None),
    ("DELETE", "ERR_DEL", "DELETED", "DELETE_IF_EXISTS"),
    ("DELETE", "ABSENT", "IGNORE", "DELETE_IF_EXISTS"),
    ("UPDATE", "UPLOAD", "READY_IF_STORED", "UPLOAD_IF_NEEDED"),
    ("UPDATE", "READY", "READY_IF_STORED", None),
    ("UPDATE", "ERR_UPL", "READY_IF_STORED", "UPLOAD_IF_NEEDED"),
    ("UPDATE", "DELETING", None, None),
    ("UPDATE", "DELETED", None, None),
    ("UPDATE", "ERR_DEL", None, None),
    ("UPDATE", "ABSENT", "READY_WITH_UPLOAD", "UPLOAD"),
    ("UPLOAD", "UPLOAD", "READY", "UPLOAD"),
    ("UPLOAD", "READY", None, None),
    ("UPLOAD", "ERR_UPL", "READY", "UPLOAD"),
    ("UPLOAD", "DELETING", "READY", "UPLOAD"),
    ("UPLOAD", "DELETED", "READY", "UPLOAD"),
    ("UPLOAD", "ERR_DEL", "READY", "UPLOAD"),
    ("UPLOAD", "ABSENT", "READY", "UPLOAD"),
    ("UPGRADE", "UPLOAD", "READY", "UPLOAD_IF_NEEDED"),
    ("UPGRADE", "READY", None, None),
    ("UPGRADE", "ERR_UPL", "READY", "UPLOAD_IF_NEEDED"),
    ("UPGRADE", "DELETING", "READY", "UPLOAD_IF_NEEDED"),
    ("UPGRADE", "DELETED", "READY", "UPLOAD_IF_NEEDED"),
    ("UPGRADE", "ERR_DEL", "READY", "UPLOAD_IF_NEEDED"),
    ("UPGRADE", "ABSENT", "READY", "UPLOAD_IF_NEEDED"),
    ("ERR_UPL", "UPLOAD", "ERR_UPL", "NOTHING"),
    ("ERR_UPL", "READY", None, None),
    ("ERR_UPL", "ERR_UPL", "ERR_UPL", "NOTHING"),
    ("ERR_UPL", "DELETING", None, None),
    ("ERR_UPL", "DELETED", None, None),
    ("ERR_UPL", "ERR_DEL", None, None),
    ("ERR_UPL", "ABSENT", None, None),
)


def outcome_rules(spark) -> DataFrame:
    """The rule table: action, status, valid, db_status, storage_step; 35 rows."""
    rows = [(action, status, db is not None, db, step) for action, status, db, step in OUTCOMES]
    return spark.createDataFrame(rows, "action string, status string, valid boolean, db_status string, storage_step string")


def action_outcome(pairs: DataFrame) -> DataFrame:
    """``pairs``: action, status (null for an absent object). Pairs outside the table are invalid."""
    rules = F.broadcast(outcome_rules(pairs.sparkSession))  # 35 rows
    known = pairs.withColumn("status", F.coalesce("status", F.lit("ABSENT")))
    return known.join(rules, ["action", "status"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def reconcile_central(old: DataFrame, new: DataFrame, sites: Sequence[str], on: Sequence[str] = ON) -> DataFrame:
    return compute_actions(merge_site_listing(old, new, on), sites, on)

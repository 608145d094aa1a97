"""Reconciliation within one site: the catalog against what the storage lists.

``objects``: site, bucket, name, status, creation, expires, size, hash, rstatus and more. ``native``:
bucket, name, db, driver, with ``db`` and ``driver`` structs of (site, nstatus, event) or null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as m
from .mutate import keep_existing, merge_or_discard, null_out

ON = ["bucket", "name"]
STATE = "struct<site:string,nstatus:int,event:timestamp_ntz>"


def status_rank(status: Column) -> Column:
    """Place of the status in the order of statuses; null for any other text."""
    place = F.array_position(F.array(*(F.lit(s) for s in m.STATUSES)), status).cast("int") - 1
    return F.when(place >= 0, place)


def with_rank(objects: DataFrame) -> DataFrame:
    """Sets rstatus for all sites and buckets."""
    return objects.withColumn("rstatus", status_rank(F.col("status")))


def of(site: str, bucket: str | None) -> Column:
    here = F.col("site") == site
    return here if bucket is None else here & (F.col("bucket") == bucket)


def purge_unknown(objects: DataFrame, native: DataFrame, site: str, bucket: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Without the UNKNOWN objects of the site, and without their native rows."""
    gone = of(site, bucket) & (F.col("status") == "UNKNOWN")
    names = objects.where(gone).select(*ON)
    return objects.where(~F.coalesce(gone, F.lit(False))), native.join(names, ON, "left_anti")


#: The rank that each rank becomes when a run starts.
REMAP = (0, 7, 2, 7, 4, 5, 4)


def rank_remap(objects: DataFrame, site: str, start: Column, bucket: str | None = None) -> DataFrame:
    hit = of(site, bucket) & (F.col("creation") <= start) & F.col("rstatus").between(0, len(REMAP) - 1)
    new = F.element_at(F.array(*(F.lit(x) for x in REMAP)), F.col("rstatus") + 1)
    return objects.withColumn("rstatus", F.when(hit, new).otherwise(F.col("rstatus")))


def purge_native_errors(native: DataFrame, objects: DataFrame, site: str, bucket: str | None = None) -> DataFrame:
    """Native rows stay only for objects that are neither unknown, uploading, deleted nor in error."""
    bad = objects.where(of(site, bucket) & F.col("status").isin("UNKNOWN", "UPLOAD", "ERR_UPL", "DELETED", "ERR_DEL"))
    return native.join(bad.select(*ON), ON, "left_anti")


def continue_copy(native: DataFrame, before: str, request: str) -> DataFrame:
    """The previous run's rows once more, under the new request."""
    return native.unionByName(native.where(F.col("request_id") == before).withColumn("request_id", F.lit(request)))


def continue_replace(native: DataFrame, before: str, request: str) -> DataFrame:
    return native.withColumn("request_id", F.when(F.col("request_id") == before, F.lit(request)).otherwise(F.col("request_id")))


def reconcile_sites(objects: DataFrame, listing: DataFrame, start: Column) -> DataFrame:
    """The states (bucket, name, site, event, nstatus) that ``reconcile_local`` gives for each site, for all of them in one full outer join."""
    known = with_rank(objects.where(F.col("status").isNull() | (F.col("status") != "UNKNOWN")))
    hit = (F.col("creation") <= start) & F.col("rstatus").between(0, len(REMAP) - 1)
    rank = F.when(hit, F.element_at(F.array(*(F.lit(x) for x in REMAP)), F.col("rstatus") + 1)).otherwise(F.col("rstatus"))
    db = known.select("site", *ON, _state(F.col("site"), rank, F.col("creation")).alias("db"))
    driver = _listed(listing, "site", *ON).select("site", *ON, _state(F.col("site"), F.lit(m.RANK["READY"]), F.col("event")).alias("driver"))
    states = db.join(driver, ["site", *ON], "full_outer").withColumn("nstatus", state_code()).where("nstatus is not null")
    # What is stored and to be updated is refreshed from storage at once.
    code = F.when((F.col("nstatus") == m.UPDATE) & F.col("driver").isNotNull(), m.READY).otherwise(F.col("nstatus"))
    return states.select(*ON, "site", latest_event().alias("event"), code.alias("nstatus"))


def assign_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", F.uuid())


def _state(site: Column, nstatus: Column, event: Column) -> Column:
    return F.struct(site.alias("site"), nstatus.cast("int").alias("nstatus"), event.alias("event"))


def db_states(objects: DataFrame, site: str, bucket: str | None = None, only: Column | None = None) -> DataFrame:
    rows = objects.where(of(site, bucket) if only is None else of(site, bucket) & only)
    return rows.select(*ON, _state(F.col("site"), F.col("rstatus"), F.col("creation")).alias("db"))


def snapshot_db(native: DataFrame, objects: DataFrame, site: str, bucket: str | None = None, only: Column | None = None) -> DataFrame:
    return null_out(native, db_states(objects, site, bucket, only), ON)


def _listed(listing: DataFrame, *on: str) -> DataFrame:
    """A name that is listed twice counts once, at its latest event."""
    return listing.groupBy(*on).agg(F.max("event").alias("event"))


def snapshot_driver(native: DataFrame, listing: DataFrame, site: str, bucket: str | None = None, only: Column | None = None) -> DataFrame:
    """``listing``: site, bucket, name, event. Sets ``driver``; listed names without a native row get one."""
    rows = listing.where(of(site, bucket) if only is None else of(site, bucket) & only)
    rows = _listed(rows, "site", *ON).select(*ON, _state(F.col("site"), F.lit(m.RANK["READY"]), F.col("event")).alias("new_"))
    joined = native.join(rows, ON, "full_outer")
    return joined.select(*ON, "db", F.coalesce("new_", "driver").alias("driver"))


def compare_sides(objects: DataFrame, listing: DataFrame) -> DataFrame:
    """One full outer equi-join: site, bucket, name, side, status, creation, event."""
    db = objects.select(*m.SITE_KEY, "status", "creation", F.lit(True).alias("in_db"))
    dr = listing.select(*m.SITE_KEY, "event", F.lit(True).alias("in_driver"))
    side = F.when(F.col("in_db").isNull(), "driver_only").when(F.col("in_driver").isNull(), "db_only").otherwise("both")
    return db.join(dr, list(m.SITE_KEY), "full_outer").select(*m.SITE_KEY, side.alias("side"), "status", "creation", "event")


def _db_only() -> Column:
    return F.col("db").isNotNull() & F.col("driver").isNull()


def _driver_only() -> Column:
    return F.col("db").isNull() & F.col("driver").isNotNull()


def _both() -> Column:
    return F.col("db").isNotNull() & F.col("driver").isNotNull()


def latest_event() -> Column:
    return F.when(F.col("db.event") >= F.col("driver.event"), F.col("db.event")).otherwise(F.coalesce(F.col("driver.event"), F.col("db.event")))


def fix_missing_db(objects: DataFrame, native: DataFrame, site: str) -> DataFrame:
    """Stored objects that the catalog lacks become READY objects, to be updated."""
    new = native.where(_driver_only()).select(F.lit(site).alias("site"), *ON, F.lit("READY").alias("status"), F.lit(m.TO_UPDATE).alias("rstatus"), F.col("driver.event").alias("creation"))
    return keep_existing(objects, new, list(m.SITE_KEY))


def _fix(objects: DataFrame, native: DataFrame, site: str, where: Column, ranks: Sequence[int], status: str, rank: int) -> DataFrame:
    new = native.where(where & F.col("db.nstatus").isin(*ranks))
    new = new.select(F.lit(site).alias("site"), *ON, F.lit(status).alias("status"), F.lit(rank).alias("rstatus"))
    return merge_or_discard(objects, new, list(m.SITE_KEY), ["status", "rstatus"])


def fix_db_only_upload(objects: DataFrame, native: DataFrame, site: str) -> DataFrame:
    return _fix(objects, native, site, _db_only(), (1, 2, 3, 7), "UPLOAD", m.TO_UPDATE)


def fix_db_only_deleted(objects: DataFrame, native: DataFrame, site: str) -> DataFrame:
    return _fix(objects, native, site, _db_only(), (4, 5, 6), "DELETED", m.RANK["DELETED"])


def fix_both_ready(objects: DataFrame, native: DataFrame, site: str) -> DataFrame:
    return _fix(objects, native, site, _both(), (1, 3, 7), "READY", m.TO_UPDATE)


def fix_both_deleting(objects: DataFrame, native: DataFrame, site: str) -> DataFrame:
    return _fix(objects, native, site, _both(), (4, 5, 6), "DELETING", m.RANK["DELETING"])


def fix_objects(objects: DataFrame, native: DataFrame, site: str) -> DataFrame:
    """The five fixes at once: their conditions exclude each other, so one join does."""
    rank = F.col("db.nstatus")
    status = (
        F.when(_db_only() & rank.isin(1, 2, 3, 7), "UPLOAD")
        .when(_db_only() & rank.isin(4, 5, 6), "DELETED")
        .when(_both() & rank.isin(1, 3, 7), "READY")
        .when(_both() & rank.isin(4, 5, 6), "DELETING")
    )
    new_rank = F.when(status.isin("UPLOAD", "READY"), m.TO_UPDATE).when(status == "DELETED", 5).when(status == "DELETING", 4)
    new = native.where(status.isNotNull()).select(F.lit(site).alias("site"), *ON, status.alias("status"), new_rank.alias("rstatus"))
    return fix_missing_db(merge_or_discard(objects, new, list(m.SITE_KEY), ["status", "rstatus"]), native, site)


def state_code() -> Column:
    """The site's state of an object; null means no row."""
    rank = F.col("db.nstatus")
    only_db = F.when(rank == 0, m.UNKNOWN).when(rank.isin(1, 2, 3, 7), m.UPLOAD).otherwise(m.DELETED)
    both = F.when(rank.isin(1, 3, 7), m.UPDATE).when(rank == 2, m.READY).when(rank.isin(4, 5, 6), m.DELETE)
    return F.when(_driver_only(), m.UPDATE).when(_db_only(), only_db).when(_both(), both)


def site_states(native: DataFrame, site: str, where: Column | None = None) -> DataFrame:
    """bucket, name, site, event, nstatus: the exploded site listing of one site."""
    rows = native if where is None else native.where(where)
    rows = rows.select(*ON, F.lit(site).alias("site"), latest_event().alias("event"), state_code().alias("nstatus"))
    return rows.where("nstatus is not null")


def site_states_driver_only(native: DataFrame, site: str) -> DataFrame:
    return site_states(native, site, _driver_only())


def site_states_db_only(native: DataFrame, site: str) -> DataFrame:
    return site_states(native, site, _db_only())


def site_states_both(native: DataFrame, site: str) -> DataFrame:
    return site_states(native, site, _both())


def refresh_native(native: DataFrame) -> DataFrame:
    """The native rows after ``refresh_from_driver``: what was to be updated has the rank of READY and the storage's event on its catalog side."""
    todo = (state_code() == m.UPDATE) & F.col("driver").isNotNull()
    fresh = _state(F.col("driver.site"), F.lit(m.RANK["READY"]), F.col("driver.event"))
    return native.withColumn("db", F.when(todo, fresh).otherwise(F.col("db")))


def refresh_from_driver(objects: DataFrame, states: DataFrame, listing: DataFrame, site: str, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Objects to update take creation, and hash, size, expires and metadata where the listing has them; their states become READY.

    ``compat`` sets expires to the creation date and rstatus to 10, as the older system does.
    """
    todo = states.where(F.col("nstatus") == m.UPDATE).select(*ON)
    own = listing.where(F.col("site") == site)
    carried = [c for c in ("hash", "size", "expires", "metadata") if c in own.columns and c in objects.columns]
    new = own.join(todo, ON, "left_semi").select("site", *ON, F.col("event").alias("creation"), *carried)
    new = new.withColumn("status", F.lit("READY")).withColumn("rstatus", F.lit(m.READY if compat else m.RANK["READY"]))
    if compat and "expires" in objects.columns:
        new, carried = new.withColumn("expires", F.col("creation")), [*dict.fromkeys([*carried, "expires"])]
    objects = merge_or_discard(objects, new, list(m.SITE_KEY), ["creation", "status", "rstatus", *carried])
    found = new.select(*ON, F.lit(True).alias("found_"))
    states = states.join(found, ON, "left")
    code = F.when(F.col("found_") & (F.col("nstatus") == m.UPDATE), m.READY).otherwise(F.col("nstatus"))
    return objects, states.withColumn("nstatus", code).drop("found_")


def local_counts(native: DataFrame) -> DataFrame:
    """Per bucket: rows with a catalog side, with a storage side, and all."""
    return native.groupBy("bucket").agg(F.count("db").alias("checked_db"), F.count("driver").alias("checked_driver"), F.count("*").alias("checked"))


def reconcile_local(objects: DataFrame, listing: DataFrame, site: str, start: Column, bucket: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, native, states) after all steps, from an empty start; ``states`` is what goes to the central site.

    The steps in a row (``fix_objects``, ``site_states``, ``refresh_from_driver``) give the same. Here the
    site's objects meet the listing in one full outer join that carries both sides' columns, and every
    result is a projection of its rows: an object is changed where it is joined, not joined again.
    """
    kept = objects.where(~F.coalesce(of(site, bucket) & (F.col("status") == "UNKNOWN"), F.lit(False)))
    ranked = rank_remap(with_rank(kept), site, start, bucket)
    here = F.coalesce(of(site, bucket), F.lit(False))
    carried = [c for c in ("hash", "size", "expires", "metadata") if c in listing.columns and c in ranked.columns]
    found = listing.where(of(site, bucket)).groupBy("site", *ON).agg(F.max("event").alias("event"), *(F.max_by(c, "event").alias(f"{c}_new") for c in carried))
    driver = found.select(*ON, _state(F.col("site"), F.lit(m.RANK["READY"]), F.col("event")).alias("driver"), *(f"{c}_new" for c in carried))
    rest = [c for c in ranked.columns if c not in ON]
    mine = ranked.where(here).select(*ON, *rest, _state(F.col("site"), F.col("rstatus"), F.col("creation")).alias("db"))
    both = mine.join(driver, ON, "full_outer")
    native = both.select(*ON, "db", "driver")
    todo = F.coalesce((state_code() == m.UPDATE) & F.col("driver").isNotNull(), F.lit(False))
    code = F.when(todo, m.READY).otherwise(state_code())
    states = both.select(*ON, F.lit(site).alias("site"), latest_event().alias("event"), code.alias("nstatus")).where("nstatus is not null")
    rank = F.col("db.nstatus")
    new = {
        "site": F.lit(site),
        "status": F.when(todo, "READY").when(_db_only() & rank.isin(1, 2, 3, 7), "UPLOAD").when(_db_only() & rank.isin(4, 5, 6), "DELETED").when(_both() & rank.isin(4, 5, 6), "DELETING"),
        "rstatus": F.when(todo, m.RANK["READY"]).when(_db_only() & rank.isin(1, 2, 3, 7), m.TO_UPDATE).when(_db_only() & rank.isin(4, 5, 6), m.RANK["DELETED"]).when(_both() & rank.isin(4, 5, 6), m.RANK["DELETING"]),
        "creation": F.when(todo, F.col("driver.event")),
    } | {c: F.when(todo, F.col(f"{c}_new")) for c in carried}
    fixed = both.select(*(F.coalesce(new[c], c).alias(c) if c in new else F.col(c) for c in ranked.columns))
    return ranked.where(~here).unionByName(fixed), native, states

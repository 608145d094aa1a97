"""Ageing, archiving, import and first synchronisation of objects; ``now`` is always an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as m

ON = ["bucket", "name"]


def _now(now: datetime) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def _later(now: datetime, seconds: int) -> Column:
    return _now(now) + F.make_dt_interval(secs=F.lit(seconds))


def _expired(now: datetime, site: str, status: str) -> Column:
    return F.coalesce((F.col("site") == site) & (F.col("status") == status) & (F.col("expires") <= _now(now)), F.lit(False))


def _of_client(objects: DataFrame, buckets: DataFrame, client: str, site: str) -> DataFrame:
    """Objects with ``mine``: whether the client owns their bucket at the site.

    One client's bucket names at one site are broadcast, which is explicit as a table of buckets may be
    derived from the objects, whose size the planner then takes for its own. A shuffle by bucket would
    put a bucket's objects into one task.
    """
    own = buckets.where((F.col("client_id") == client) & (F.col("site") == site)).select(F.col("id").alias("bucket"), F.lit(True).alias("mine")).distinct()
    return objects.join(F.broadcast(own), "bucket", "left").withColumn("mine", F.coalesce("mine", F.lit(False)))


def purge_deleted(objects: DataFrame, buckets: DataFrame, listing: DataFrame, client: str, site: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(objects without the client's expired DELETED rows, their copies that storage still has)."""
    gone = F.col("mine") & _expired(now, site, "DELETED")
    marked = _of_client(objects, buckets, client, site)
    copies = listing.where(F.col("site") == site).join(marked.where(gone).select(*ON), ON, "left_semi").select(*ON)
    return marked.where(~gone).select(*objects.columns), copies


def expire_ready(objects: DataFrame, buckets: DataFrame, client: str, site: str, now: datetime, seconds: int = 0) -> DataFrame:
    """The client's expired READY rows become DELETED now, to expire after ``seconds``; 0 keeps the old expiry."""
    hit = F.col("mine") & _expired(now, site, "READY")
    marked = _of_client(objects, buckets, client, site).withColumn("hit", hit)
    changed = marked.withColumn("status", F.when(F.col("hit"), "DELETED").otherwise(F.col("status"))).withColumn("creation", F.when(F.col("hit"), _now(now)).otherwise(F.col("creation")))
    if seconds > 0:
        changed = changed.withColumn("expires", F.when(F.col("hit"), _later(now, seconds)).otherwise(F.col("expires")))
    return changed.select(*objects.columns)


def archive_ready(objects: DataFrame, buckets: DataFrame, listing: DataFrame, client: str, site: str, now: datetime, archive: str, seconds: int = 0) -> DataFrame:
    """Rows to insert: expired READY objects that storage has, in the archive bucket, with where they came from in ``metadata``."""
    marked = _of_client(objects, buckets, client, site)
    rows = marked.where(F.col("mine") & _expired(now, site, "READY") & (F.col("bucket") != archive)).select(*objects.columns)
    rows = rows.join(listing.where(F.col("site") == site).select(*ON), ON, "left_semi")
    told = F.create_map(F.lit("archived_from_bucket"), F.col("bucket"), F.lit("archived_from_id"), F.concat_ws("/", "site", "bucket", "name"), F.lit("archived_from_name"), F.col("name"))
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>")) if "metadata" in objects.columns else F.create_map().cast("map<string,string>")
    merged = F.map_concat(F.map_filter(own, lambda k, _: ~k.isin("archived_from_bucket", "archived_from_id", "archived_from_name")), told)
    later = _later(now, seconds) if seconds > 0 else F.lit(None).cast("timestamp_ntz")
    return rows.withColumn("metadata", merged).withColumn("bucket", F.lit(archive)).withColumn("expires", later).withColumn("status", F.lit("READY"))


def purge_orders(objects: DataFrame, buckets: DataFrame, client: str, site: str, now: datetime) -> DataFrame:
    rows = _of_client(objects, buckets, client, site).where(F.col("mine") & _expired(now, site, "READY"))
    return rows.select(F.col("site").alias("from_site"), F.lit(None).cast("string").alias("to_site"), F.lit(client).alias("client_id"), F.col("bucket").alias("bucket_name"), F.col("name").alias("object_name"), "size", "hash", F.lit("DELETE").alias("action"))


def purge_run(objects: DataFrame, buckets: DataFrame, listing: DataFrame, client: str, site: str, now: datetime, archive: str | None = None, seconds: int = 0) -> DataFrame:
    """First the deleted pass, then the ready pass: a row that turns DELETED here survives this run."""
    left, _ = purge_deleted(objects, buckets, listing, client, site, now)
    out = expire_ready(left, buckets, client, site, now, seconds)
    if archive:
        out = out.unionByName(archive_ready(left, buckets, listing, client, site, now, archive, seconds), allowMissingColumns=True)
    return out


def import_storage(objects: DataFrame, listing: DataFrame, site: str, now: datetime, prefix: str = "", after: datetime | None = None, before: datetime | None = None, seconds: int = 0, defaults: dict[str, str] | None = None) -> DataFrame:
    """Rows to insert for listed objects that the catalog lacks. Default metadata win over an object's own."""
    rows = listing.where((F.col("site") == site) & F.col("name").startswith(prefix))
    if after is not None:
        rows = rows.where(F.col("event") >= _now(after))
    if before is not None:
        rows = rows.where(F.col("event") <= _now(before))
    rows = rows.join(objects.select(*m.SITE_KEY), list(m.SITE_KEY), "left_anti")
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>")) if "metadata" in rows.columns else F.create_map().cast("map<string,string>")
    if defaults:
        keys = list(defaults)
        own = F.map_concat(F.map_filter(own, lambda k, _: ~k.isin(*keys)), F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv)))
    later = _later(now, seconds) if seconds > 0 else F.lit(None).cast("timestamp_ntz")
    return rows.select(*m.SITE_KEY, F.lit("READY").alias("status"), F.col("event").alias("creation"), later.alias("expires"), own.alias("metadata"))


def import_bucket(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Adds buckets that are absent, as READY. ``found``: id, client_id, site."""
    new = found.join(buckets.select("id", "site"), ["id", "site"], "left_anti").withColumn("status", F.lit("READY"))
    return buckets.unionByName(new.select(*buckets.columns))


def sync_site(objects: DataFrame, buckets: DataFrame, site: str, bucket: str, remote: str, only: Column | None = None) -> DataFrame:
    """An UPLOAD action from this site to the remote one for each READY object; none where the bucket is unknown."""
    rows = objects.where((F.col("site") == site) & (F.col("bucket") == bucket) & (F.col("status") == "READY"))
    rows = rows if only is None else rows.where(only)
    known = buckets.where(F.col("site") == site).select(F.col("id").alias("bucket"))
    rows = rows.join(known, "bucket", "left_semi")
    return rows.select(*ON, F.lit(m.UPLOAD).alias("need_action"), F.array(F.lit(site)).alias("need_action_from"), F.array(F.lit(remote)).alias("sites"))


def copy_objects(objects: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``moves``: site, bucket, name, to_bucket, to_name. (new rows, refused moves): both ends must be named and differ."""
    named = (F.length("bucket") > 0) & (F.length("name") > 0) & (F.length("to_bucket") > 0) & (F.length("to_name") > 0)
    good = F.coalesce(named & ((F.col("bucket") != F.col("to_bucket")) | (F.col("name") != F.col("to_name"))), F.lit(False))
    rows = objects.join(moves.where(good), list(m.SITE_KEY))
    new = rows.withColumn("bucket", F.col("to_bucket")).withColumn("name", F.col("to_name")).select(*objects.columns)
    return new, moves.where(~good)


def buffer_retry(items: DataFrame, objects: DataFrame, buckets: DataFrame, listing: DataFrame, site: str) -> DataFrame:
    """``items``: bucket, name, has_content. Adds ``decision``, the first that holds: drop, error, stored, error, retry."""
    here = lambda rows: rows.where(F.col("site") == site)
    db = here(objects).select(*ON, "status")
    known = here(buckets).where("status = 'READY'").select(F.col("id").alias("bucket"), F.lit(True).alias("bucket_there")).distinct()
    stored = here(listing).select(*ON, F.lit(True).alias("stored")).distinct()
    rows = items.join(db, ON, "left").join(known, "bucket", "left").join(stored, ON, "left")
    decision = (
        F.when(F.coalesce(F.col("status") != "READY", F.lit(True)), "drop_not_ready")
        .when(F.col("bucket_there").isNull(), "error_bucket_gone")
        .when(F.col("stored"), "drop_stored")
        .when(~F.coalesce("has_content", F.lit(False)), "error_content_gone")
        .otherwise("retry")
    )
    return rows.select(*items.columns, decision.alias("decision"))


def buffer_cleanup(items: DataFrame, limit: datetime) -> DataFrame:
    """Items strictly older than the limit."""
    return items.where(F.col("modified") < _now(limit))


def buffer_stats(items: DataFrame) -> DataFrame:
    """Number of items and bytes; metadata files count in neither."""
    data = ~F.coalesce("is_metadata", F.lit(False))
    return items.agg(F.count_if(data).alias("items"), F.coalesce(F.sum(F.when(data, F.col("length"))), F.lit(0)).cast("long").alias("bytes"))

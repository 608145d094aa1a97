"""Replication orders in batch: fan-out to sites, checks, and their effect on buckets and objects.

An order has op_id, from_site, to_site, client_id, bucket_name, object_name, action, and size and hash
where known; ``ts`` and op_id give the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model as m
from ..functions import names
from ..sources.catalog import TIME

SAME = ["from_site", "to_site", "client_id", "bucket_name", "object_name", "size", "hash", "action"]


def emit_orders(changes: DataFrame, site: str, client: str) -> DataFrame:
    """``changes``: bucket, name (null for a bucket), status, size, hash. READY gives CREATE, DELETED gives DELETE, others nothing."""
    action = F.when(F.col("status") == "READY", "CREATE").when(F.col("status") == "DELETED", "DELETE")
    rows = changes.select(F.lit(site).alias("from_site"), F.lit(None).cast("string").alias("to_site"), F.lit(client).alias("client_id"), F.col("bucket").alias("bucket_name"), F.col("name").alias("object_name"), "size", "hash", action.alias("action"))
    return rows.where("action is not null")


def fan_out_orders(orders: DataFrame, topology: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routed, unroutable). ``topology``: id, status.

    An order without target goes to every UP site but its own; one with a target goes there if that
    site is UP and not its own. The sites are a dimension table; Spark broadcasts it by its size.
    """
    up = topology.where("status = 'UP'").select(F.col("id").alias("site_"))
    open_ = orders.where("to_site is null").join(up, F.col("site_") != F.col("from_site"))
    open_ = open_.withColumn("to_site", F.col("site_")).select(*orders.columns)
    aimed = orders.where("to_site is not null")
    good = aimed.where("to_site <> from_site").join(up.select(F.col("site_").alias("to_site")), "to_site", "left_semi").select(*orders.columns)
    bad = aimed.join(up.select(F.col("site_").alias("to_site"), F.lit(True).alias("up_")), "to_site", "left").where("up_ is null or to_site <=> from_site").select(*orders.columns)
    return open_.unionByName(good), bad


def group_orders(routed: DataFrame) -> DataFrame:
    """Number of orders, creations and deletions by target site."""
    return routed.groupBy("to_site").agg(F.count("*").alias("n"), F.count_if(F.col("action") == "CREATE").alias("n_create"), F.count_if(F.col("action") == "DELETE").alias("n_delete"))


def write_by_target(routed: DataFrame, path: str, parts: int = 64) -> None:
    """The orders in one folder per target site, files of successive times within it, each in order of arrival.

    Rows are dealt out by ranges of (site, time, order), so a site with most orders is cut into as many
    parts as it has shares, and no task holds them all.
    """
    order = ["to_site", "ts", "op_id"]
    dealt = routed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.write.partitionBy("to_site").option("timestampNTZFormat", TIME).json(path)


def read_by_target(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_by_target`` has written; asking for a site reads its folder alone."""
    rows = spark.read.schema(schema).option("timestampNTZFormat", TIME).json(path)
    return rows.select(*T.StructType.fromDDL(schema).names)


def dedup_orders(orders: DataFrame) -> DataFrame:
    """One order of those that are equal but for op_id (and arrival): the first."""
    same = [c for c in SAME if c in orders.columns]
    rest = [c for c in orders.columns if c not in same]
    first = F.min(F.struct(*rest)).alias("f_")
    return orders.groupBy(*same).agg(first).select(*same, *(F.col(f"f_.{c}").alias(c) for c in rest)).select(*orders.columns)


def classify_orders(orders: DataFrame) -> DataFrame:
    kind = F.when(F.coalesce(F.length("object_name"), F.lit(0)) == 0, "bucket").otherwise("object")
    known = F.when(F.col("action").isin("CREATE", "DELETE"), F.lower("action")).otherwise("other")
    return orders.withColumn("kind", kind).withColumn("step", known)


def right_covers(have: Column, want: Column) -> Column:
    """Right codes are bits; the empty right covers only itself."""
    return F.when(want == 0, have == 0).otherwise(have.bitwiseAND(want) == want)


def order_checks(orders: DataFrame, ownership: DataFrame) -> DataFrame:
    """Adds ``rejected``: the first reason that holds, or null. ``ownership``: client, bucket, code, one row each or several."""
    rights = ownership.groupBy("client", "bucket").agg(F.bit_or("code").alias("code_"))
    rows = classify_orders(orders).join(rights.withColumnsRenamed({"client": "client_id", "bucket": "bucket_name"}), ["client_id", "bucket_name"], "left")
    want = F.when(F.col("action") == "DELETE", F.lit(m.DELETE_RIGHT)).otherwise(F.lit(m.WRITE))
    reason = (
        F.when(F.col("step") == "other", "unknown_action")
        .when(~F.coalesce(F.col("bucket_name").rlike(names.BUCKET_NAME), F.lit(False)), "bucket_name")
        .when((F.col("kind") == "object") & ~F.col("object_name").rlike(names.OBJECT_NAME), "object_name")
        .when(F.col("code_").isNull(), "not_owner")
        .when(~right_covers(F.col("code_"), want), "right")
    )
    return rows.select(*orders.columns, reason.alias("rejected"))


def apply_create_bucket(wanted: DataFrame, buckets: DataFrame) -> DataFrame:
    """``wanted``: bucket_name, client_id. Adds ``outcome``. ``buckets``: id, status."""
    rows = wanted.join(buckets.select(F.col("id").alias("bucket_name"), "status"), "bucket_name", "left")
    ok = F.col("status").isNull() | (F.col("status") == "DELETED")
    return rows.select(*wanted.columns, F.when(ok, "READY").otherwise("ALREADY_EXIST").alias("outcome"))


def apply_delete_bucket(wanted: DataFrame, buckets: DataFrame, objects: DataFrame) -> DataFrame:
    held = objects.where("status = 'READY'").groupBy(F.col("bucket").alias("bucket_name")).agg(F.count("*").alias("held"))
    rows = wanted.join(buckets.select(F.col("id").alias("bucket_name"), "status", F.col("client_id").alias("owner")), "bucket_name", "left").join(held, "bucket_name", "left")
    outcome = (
        F.when(F.col("status").isNull(), "NOT_EXIST")
        .when(F.col("owner") != F.col("client_id"), "NOT_ALLOWED")
        .when(F.col("status") == "DELETED", "ALREADY_DELETED")
        .when(F.col("status") != "READY", "BAD_STATUS")
        .when(F.col("held") > 0, "NOT_EMPTY")
        .otherwise("DELETED")
    )
    return rows.select(*wanted.columns, outcome.alias("outcome"))


def _with_object(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    return wanted.join(objects.select(F.col("bucket").alias("bucket_name"), F.col("name").alias("object_name"), "status"), ["bucket_name", "object_name"], "left")


def apply_create_object(wanted: DataFrame, buckets: DataFrame, objects: DataFrame) -> DataFrame:
    ready = buckets.where("status = 'READY'").select(F.col("id").alias("bucket_name"), F.lit(True).alias("open_"))
    rows = _with_object(wanted, objects).join(ready, "bucket_name", "left")
    outcome = (
        F.when(F.col("open_").isNull(), "NO_BUCKET")
        .when(F.col("status").isNull() | (F.col("status") == "DELETED"), "READY")
        .when(F.col("status") == "UPLOAD", "NOT_ACCEPTABLE")
        .otherwise("ALREADY_EXIST")
    )
    return rows.select(*wanted.columns, outcome.alias("outcome"))


def apply_delete_object(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    s = F.col("status")
    outcome = F.when(s.isNull(), "NOT_EXIST").when(s == "READY", "DELETED").when(s == "DELETED", "ALREADY_DELETED").otherwise("BAD_STATUS")
    return _with_object(wanted, objects).select(*wanted.columns, outcome.alias("outcome"))


#: Parts of the time line in which orders are folded apart.
RANGES = 64
OBJECT = ["bucket_name", "object_name"]


def object_orders(orders: DataFrame) -> DataFrame:
    """The orders that change an object."""
    return orders.where(F.col("action").isin("CREATE", "DELETE") & (F.length("object_name") > 0))


def zoneless_micros(ts: Column) -> Column:
    """Microseconds of a time without zone, in no zone: they rise as the times do."""
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1000000 + (F.extract(F.lit("SECONDS"), ts) * 1000000).cast("long")


def time_range(orders: DataFrame, ranges: int = RANGES) -> Column:
    """Number of the part of the time line that an order falls in, parts holding about as many orders each; null times come first.

    One aggregation over the times finds the cuts. Orders of one microsecond stay together.
    """
    shares = [k / ranges for k in range(1, ranges)]
    micros = zoneless_micros(F.col("ts")) if orders.schema["ts"].dataType == T.TimestampNTZType() else F.unix_micros("ts")
    cuts = orders.agg(F.percentile_approx(micros, shares, 100 * ranges)).first()[0] or []  # one array of ``ranges`` numbers
    return F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))).cast("array<long>"), lambda c: c < micros))


def fold_ranges(orders: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Orders of each object and part of the time line as one transition: n, errors, first, last, created, until.

    Between orders an object rests READY or not, so an order's outcome hangs on the one before it alone:
    CREATE after CREATE and DELETE after DELETE fail. A transition therefore is its first and last action
    and the failures between; two in a row compose to one by ``compose_ranges``, in any grouping.
    An object's orders are dealt out over the parts, so one with most orders needs no task for all.
    """
    rows = object_orders(orders).withColumn("range", time_range(orders, ranges))
    rows = rows.withColumn("before", F.lag("action").over(Window.partitionBy(*OBJECT, "range").orderBy("ts", "op_id")))
    place = F.struct("ts", "op_id")
    return rows.groupBy(*OBJECT, "range").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("action") == F.col("before")).alias("errors"),
        F.min_by("action", place).alias("first"),
        F.max_by("action", place).alias("last"),
        F.bool_or(F.col("action") == "CREATE").alias("created"),
        F.max(place).alias("until"),
    )


def compose_ranges(transitions: DataFrame) -> DataFrame:
    """One transition per object from those of successive ranges: a failure more wherever one begins as the one before ends."""
    before = F.lag("last").over(Window.partitionBy(*OBJECT).orderBy("range"))
    return transitions.withColumn("before", before).groupBy(*OBJECT).agg(
        F.min("range").alias("range"),
        F.sum("n").alias("n"),
        (F.sum("errors") + F.count_if(F.col("before") == F.col("first"))).alias("errors"),
        F.min_by("first", "range").alias("first"),
        F.max_by("last", "range").alias("last"),
        F.bool_or("created").alias("created"),
        F.max("until").alias("until"),
    )


def settled(start: Column) -> tuple[Column, Column]:
    """(final status, errors) of a transition from a status."""
    stuck = F.coalesce(~start.isin("READY", "DELETED"), F.lit(False))
    refused = (F.col("first") == "CREATE") == F.coalesce(start == "READY", F.lit(False))
    final = (
        F.when(stuck, start)
        .when(F.col("last") == "CREATE", "READY")
        .when(start.isNotNull() | F.col("created"), "DELETED")
    )
    return final, F.when(stuck, F.col("n")).otherwise(F.col("errors") + refused.cast("long"))


def fold_orders(orders: DataFrame, objects: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Orders on objects of open buckets, in order of arrival: bucket_name, object_name, final_status (null: absent), errors.

    CREATE on READY and DELETE on anything else fail and change nothing. An object that starts in any
    status but READY and DELETED refuses both and keeps it. Orders are composed to one transition per
    object before the catalog is joined, which then meets as many rows as objects.
    """
    rows = _with_object(compose_ranges(fold_ranges(orders, ranges)), objects)
    final, errors = settled(F.col("status"))
    return rows.select(*OBJECT, final.alias("final_status"), errors.alias("errors"))


def order_counters(outcomes: DataFrame) -> DataFrame:
    """``outcomes``: kind, step, failed. Counters by kind and tag."""
    tag = F.when(F.col("failed"), "error").when(F.col("step") == "create", "created").when(F.col("step") == "delete", "deleted").otherwise("error")
    return outcomes.groupBy("kind", tag.alias("tag")).agg(F.count("*").alias("n"))


def locate_remote(holdings: DataFrame, topology: DataFrame, own: str) -> DataFrame:
    """``holdings``: bucket, name, site where it is READY. The first UP site, by id, that is not this one."""
    up = topology.where((F.col("status") == "UP") & (F.col("id") != own)).select(F.col("id").alias("site"))
    return holdings.join(up, "site", "left_semi").groupBy("bucket", "name").agg(F.min("site").alias("remote"))


def fix_on_absent(objects: DataFrame, topology: DataFrame, own: str) -> DataFrame:
    """CREATE orders to this site for objects READY elsewhere and missing here."""
    ready = objects.where("status = 'READY'").select("site", "bucket", "name")
    lost = ready.join(objects.where(F.col("site") == own).select("bucket", "name"), ["bucket", "name"], "left_anti")
    found = locate_remote(lost, topology, own)
    return found.select(F.col("remote").alias("from_site"), F.lit(own).alias("to_site"), F.col("bucket").alias("bucket_name"), F.col("name").alias("object_name"), F.lit("CREATE").alias("action"))


def check_pullable(wanted: DataFrame, objects: DataFrame, listing: DataFrame, topology: DataFrame, own: str) -> DataFrame:
    """``wanted``: bucket, name. Adds ``pull_from``: this site if READY and stored here, else a remote one, else null."""
    on = ["bucket", "name"]
    here = objects.where((F.col("site") == own) & (F.col("status") == "READY")).select(*on)
    here = here.join(listing.where(F.col("site") == own), on, "left_semi").withColumn("own_", F.lit(own))
    remote = locate_remote(objects.where("status = 'READY'").select("site", *on), topology, own)
    return wanted.join(here, on, "left").join(remote, on, "left").select(*wanted.columns, F.coalesce("own_", "remote").alias("pull_from"))

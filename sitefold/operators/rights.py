"""Rights of clients on buckets, sites by status, and the state of buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .orders import right_covers


def fused_rights(grants: DataFrame) -> DataFrame:
    """One row per client and bucket: the union of its grants (client, bucket, code)."""
    return grants.groupBy("client", "bucket").agg(F.bit_or("code").alias("code"))


def rights_of_client(grants: DataFrame, client: str, right: int | None = None) -> DataFrame:
    rows = fused_rights(grants.where(F.col("client") == client))
    return rows if right is None else rows.where(right_covers(F.col("code"), F.lit(right)))


def all_pairs_of_rights(grants: DataFrame) -> DataFrame:
    """(a, b, covers, fusion) for all pairs of codes that occur: at most 64."""
    codes = grants.select("code").distinct()
    pairs = codes.withColumnRenamed("code", "a").join(F.broadcast(codes.withColumnRenamed("code", "b")), F.lit(True))  # eight codes
    return pairs.select("a", "b", right_covers(F.col("a"), F.col("b")).alias("covers"), F.col("a").bitwiseOR(F.col("b")).alias("fusion"))


def sites_by_status(topology: DataFrame, status: str = "UP") -> DataFrame:
    return topology.where(F.col("status") == status)


def buckets_of_client(buckets: DataFrame, client: str) -> DataFrame:
    return buckets.where(F.col("client_id") == client)


def bucket_state(wanted: DataFrame, buckets: DataFrame, site: str) -> DataFrame:
    """``wanted``: bucket. Adds ``state``: ok, gone, error or absent."""
    own = buckets.where(F.col("site") == site).select(F.col("id").alias("bucket"), "status")
    s = F.col("status")
    state = F.when(s.isNull(), "absent").when(s == "READY", "ok").when(s == "DELETED", "gone").otherwise("error")
    return wanted.join(own, "bucket", "left").select(*wanted.columns, state.alias("state"))


def deletable_buckets(buckets: DataFrame, objects: DataFrame, client: str) -> DataFrame:
    """The client's READY buckets without a READY object at their site."""
    held = objects.where("status = 'READY'").select(F.col("bucket").alias("id"), "site").distinct()
    return buckets.where((F.col("client_id") == client) & (F.col("status") == "READY")).join(held, ["id", "site"], "left_anti")

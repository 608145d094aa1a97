"""Content digests, name checks and counters over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names

DIGESTS = {
    "MD5": F.md5,
    "SHA1": F.sha1,
    "SHA256": lambda c: F.sha2(c, 256),
    "SHA384": lambda c: F.sha2(c, 384),
    "SHA512": lambda c: F.sha2(c, 512),
}


def content_manifest(contents: DataFrame, content: Column, algorithms=("MD5", "SHA1", "SHA256")) -> DataFrame:
    """The rows with a digest per algorithm and the size in bytes."""
    data = content.cast("binary")
    return contents.withColumns({a.lower(): DIGESTS[a](data) for a in algorithms} | {"n_bytes": F.octet_length(data).cast("long")})


def duplicate_contents(manifest: DataFrame, digest: str = "sha256") -> DataFrame:
    """Digest, copies and smallest name of contents that occur more than once."""
    return manifest.groupBy(digest).agg(F.count("*").alias("copies"), F.min("name").alias("first_name")).where("copies > 1")


def fixity_audit(contents: DataFrame, content: Column, stored_hash: str, stored_size: str) -> DataFrame:
    """Per bucket: rows, wrong digests, wrong sizes (in characters, as stored)."""
    wrong = lambda c: F.count_if(F.coalesce(~c, F.lit(True)))
    return contents.groupBy("bucket").agg(F.count("*").alias("n"), wrong(F.md5(content.cast("binary")) == F.col(stored_hash)).alias("bad_hash"), wrong(F.length(content) == F.col(stored_size)).alias("bad_size"))


def sanitize_names(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn("clean", names.sanitized(F.col(name)))


def validate_names(rows: DataFrame, name: str, pattern: str = names.OBJECT_NAME) -> tuple[DataFrame, DataFrame]:
    """(good rows, refused rows with ``reason``)."""
    judged = rows.withColumn("reason", names.fault(F.col(name), pattern))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def name_collisions(rows: DataFrame, name: str) -> DataFrame:
    """Clean forms that several distinct names share."""
    g = rows.select(name, names.sanitized(F.col(name)).alias("clean")).distinct()
    return g.groupBy("clean").agg(F.count("*").alias("names"), F.min(name).alias("first_name")).where("names > 1")


def metric_rollup(counters: DataFrame) -> DataFrame:
    return counters.groupBy("component", "key", "tag").agg(F.sum("value").alias("value"))

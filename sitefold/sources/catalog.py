"""Reading and writing catalogs, storage listings and JSON lines."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: How times are written in JSON: to the microsecond.
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def scan(spark: SparkSession, path: str, predicate: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Parquet rows; Catalyst takes predicate and columns to the files."""
    rows = spark.read.parquet(path)
    rows = rows if predicate is None else rows.where(predicate)
    return rows if columns is None else rows.select(*columns)


def scan_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64, **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of a numeric key where one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def find_one(rows: DataFrame, predicate: Column, order: list[str]) -> DataFrame:
    """The first row by ``order``: a top-1, not a full sort."""
    return rows.where(predicate).orderBy(*order).limit(1)


def list_storage_files(spark: SparkSession, root: str, bucket: str, glob: str | None = None, after: datetime | None = None, before: datetime | None = None) -> DataFrame:
    """Objects under ``root/bucket`` of any Hadoop file system, without their content: bucket, name, size, event. Both ends of the dates are inclusive."""
    base = f"{root.rstrip('/')}/{bucket}"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(base).select("path", "length", "modificationTime")
    if after is not None:
        rows = rows.where(F.col("modificationTime") >= F.lit(after))
    if before is not None:
        rows = rows.where(F.col("modificationTime") <= F.lit(before))
    name = F.regexp_replace(F.col("path"), "^.*?/" + re.escape(bucket) + "/", "")
    return rows.select(F.lit(bucket).alias("bucket"), name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("event"))


def list_storage(listing: DataFrame, site: str, bucket: str, prefix: str = "", after: datetime | None = None, before: datetime | None = None) -> DataFrame:
    """Rows of an inventory table, prefix and both dates inclusive."""
    rows = listing.where((F.col("site") == site) & (F.col("bucket") == bucket) & F.col("name").startswith(prefix))
    if after is not None:
        rows = rows.where(F.col("event") >= F.lit(after).cast("timestamp_ntz"))
    if before is not None:
        rows = rows.where(F.col("event") <= F.lit(before).cast("timestamp_ntz"))
    return rows


def count_storage(listing: DataFrame) -> DataFrame:
    return listing.groupBy("site", "bucket").agg(F.count("*").alias("n"))


def list_storage_buckets(listing: DataFrame) -> DataFrame:
    return listing.select("site", "bucket").distinct()


def export_ndjson(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    """One JSON object a line, in compressed files. ``zstd`` needs Hadoop's native codec; gzip is always there."""
    rows.write.option("compression", compression).option("timestampNTZFormat", TIME).json(path)


def import_ndjson(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("timestampNTZFormat", TIME).json(path)


def to_json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns), {"timestampNTZFormat": TIME}).alias("line"))


def from_json_lines(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("line", schema, {"timestampNTZFormat": TIME}).alias("r")).select("r.*")


def list_objects(objects: DataFrame, grants: DataFrame, client: str, bucket: str, predicate: Column, right: int) -> DataFrame:
    """Objects of the bucket that match, if the client has the right on it."""
    from ..operators.rights import rights_of_client

    allowed = rights_of_client(grants, client, right).select("bucket")
    return objects.where((F.col("bucket") == bucket) & predicate).join(allowed, "bucket", "left_semi")


def classify_paths(paths: DataFrame, objects: DataFrame) -> DataFrame:
    """``paths``: site, bucket, path. Adds ``kind``: OBJECT for an exact name, DIRECTORY for a beginning of one that ends at a slash, else NONE.

    Names are exploded into their ancestor directories, so the match is one equi-join.
    """
    parts = F.split("name", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = objects.where(F.contains("name", F.lit("/"))).select("site", "bucket", F.explode(above).alias("path")).distinct().withColumn("rank", F.lit(1))
    exact = objects.select("site", "bucket", F.col("name").alias("path")).withColumn("rank", F.lit(2))
    known = exact.unionByName(folders).groupBy("site", "bucket", "path").agg(F.max("rank").alias("rank"))
    rows = paths.withColumn("given_", F.col("path")).withColumn("path", F.regexp_replace("path", "/+$", ""))
    kind = F.when(F.col("rank") == 2, "OBJECT").when(F.col("rank") == 1, "DIRECTORY").otherwise("NONE")
    return rows.join(known, ["site", "bucket", "path"], "left").withColumn("path", F.col("given_")).select(*paths.columns, kind.alias("kind"))

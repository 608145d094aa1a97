"""Stored tables: rows of requests in partitions of their own, and a catalog kept bucketed by its key."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mutate import one_per_key

REQUEST = "request_id"


def save_requests(rows: DataFrame, path: str) -> None:
    """Adds rows, each to the partition of its request (column request_id)."""
    rows.write.mode("append").partitionBy(REQUEST).parquet(path)


def request_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All requests' rows; a condition on request_id reads that request's files alone."""
    return spark.read.schema(schema).parquet(path)


def replace_request(rows: DataFrame, path: str) -> None:
    """Overwrites the partitions of the requests in ``rows`` and no others; running it again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(REQUEST).parquet(path)


def drop_request(spark: SparkSession, path: str, request: str, schema: str) -> None:
    """Removes one request's rows: its partition is overwritten with nothing, the other requests' files stay as they are."""
    name = f"requests_{uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet OPTIONS (path '{_quoted(path)}') PARTITIONED BY ({REQUEST})")
    try:
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION ({REQUEST} = '{_quoted(request)}')")
        nothing = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()})" for f in spark.table(name).schema if f.name != REQUEST)
        spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION ({REQUEST} = '{_quoted(request)}') SELECT {nothing} FROM VALUES (1) WHERE false")
    finally:
        spark.sql(f"DROP TABLE {name}")


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


class BucketedCatalog:
    """A catalog kept bucketed and sorted by its key, so that a merge shuffles the incoming rows alone.

    Each version has a folder of its own under ``path``; ``merge`` writes the next one from the last and
    points the table's name at it, so a merge that fails leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, on: Sequence[str], buckets: int = 200):
        self.spark, self.name, self.path, self.on, self.buckets = spark, name, path.rstrip("/"), list(on), buckets
        self.version = 0

    def save(self, rows: DataFrame) -> None:
        """The rows as a new version."""
        self.version += 1
        fresh = f"{self.name}_v{self.version}"
        writer = rows.write.format("parquet").bucketBy(self.buckets, *self.on).sortBy(*self.on)
        writer.option("path", f"{self.path}/v{self.version}").saveAsTable(fresh)
        if self.version > 1:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_v{self.version - 1}")  # its files stay for who still reads them

    def rows(self) -> DataFrame:
        return self.spark.table(f"{self.name}_v{self.version}")

    def merge(self, change: Callable[[DataFrame, DataFrame], DataFrame], source: DataFrame) -> None:
        """``change`` makes the new rows from the table and the source, such as ``mutate.merge_or_discard`` with its key."""
        self.save(change(self.rows(), self.incoming(source)))

    def incoming(self, source: DataFrame) -> DataFrame:
        """The source with one row per key, dealt out as the table is."""
        return one_per_key(source.repartition(self.buckets, *self.on), self.on)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_v{self.version}")


def observed(rows: DataFrame, observation, **counts) -> DataFrame:
    """The rows, with counts taken by the job that works them off: a second pass over them is not needed.

    ``observation`` has them after the first action; ``counts`` are aggregates by name.
    """
    return rows.observe(observation, *(c.alias(n) for n, c in counts.items()))


def checked(native: DataFrame, observation) -> DataFrame:
    """Native rows with the counts of a run: with a catalog side, with a storage side, all."""
    return observed(native, observation, checked_db=F.count("db"), checked_driver=F.count("driver"), checked=F.count(F.lit(1)))

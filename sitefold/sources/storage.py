"""Objects in a store, as rows: a listing that is a Spark data source, and digests of stored files.

Stores are opened by URI on the executors (local or shared folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTING = "bucket string, name string, size long, event timestamp_ntz"
#: Names handed to Spark at once, and bytes of a file read at once.
ROWS, CHUNK = 4096, 1 << 23


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI, and the path in it."""
    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")
    return store, path.rstrip("/")


@dataclass
class Folder(InputPartition):
    """Part of a listing: all objects below a prefix, or those that lie directly in the bucket."""

    bucket: str
    prefix: str
    deep: bool


class ListingReader(DataSourceReader):
    """Plans a partition for each first-level prefix of each bucket; names and dates are compared where they are listed."""

    def __init__(self, root: str, bucket: str | None):
        self.root, self.bucket = root, bucket
        self.start, self.after, self.before = "", [], []

    def pushFilters(self, filters):
        """Takes prefixes of names and bounds of dates; the rest is Spark's."""
        for f in filters:
            kind, column = type(f), getattr(f, "attribute", ())
            if kind is StringStartsWith and column == ("name",) and (f.value.startswith(self.start) or self.start.startswith(f.value)):
                self.start = max(self.start, f.value, key=len)
            elif kind is EqualTo and column == ("bucket",) and self.bucket in (None, f.value):
                self.bucket = f.value
            elif kind in (GreaterThan, GreaterThanOrEqual) and column == ("event",):
                self.after.append((f.value, kind is GreaterThan))
            elif kind in (LessThan, LessThanOrEqual) and column == ("event",):
                self.before.append((f.value, kind is LessThan))
            elif kind is not IsNotNull:  # no column of a listing is null
                yield f

    def partitions(self):
        store, base = opened(self.root)
        folders = lambda path: [i.base_name for i in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.type == fs.FileType.Directory]
        found: list[Folder] = []
        for bucket in [self.bucket] if self.bucket is not None else sorted(folders(base)):
            first, slash, _ = self.start.partition("/")
            if slash:
                found.append(Folder(bucket, first, True))
                continue
            found.append(Folder(bucket, "", False))
            found += [Folder(bucket, x, True) for x in sorted(folders(f"{base}/{bucket}")) if x.startswith(first)]
        return found

    def read(self, part: Folder) -> Iterator[pa.RecordBatch]:
        store, base = opened(self.root)
        home = f"{base}/{part.bucket}/"
        rows: list[tuple] = []
        todo = [home + part.prefix if part.deep else home.rstrip("/")]
        while todo:  # folder by folder: no listing is held whole
            for info in store.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True)):
                name = info.path[len(home) :] if info.path.startswith(home) else info.path.split(home, 1)[-1]
                if info.type == fs.FileType.Directory:
                    if part.deep and (name.startswith(self.start) or self.start.startswith(f"{name}/")):
                        todo.append(info.path)
                elif name.startswith(self.start) and self._dated(event := _naive(info.mtime)):
                    rows.append((part.bucket, name, info.size, event))
                    if len(rows) == ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    def _dated(self, event: datetime) -> bool:
        late = all(event > t if strict else event >= t for t, strict in self.after)
        return late and all(event < t if strict else event <= t for t, strict in self.before)


def _naive(time: datetime) -> datetime:
    return time.astimezone(timezone.utc).replace(tzinfo=None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us"))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=["bucket", "name", "size", "event"])


class Listing(DataSource):
    """``spark.read.format("storage_listing").option("root", uri)``, and ``bucket`` for one bucket alone.

    A bucket is a folder below the root and a name a path below the bucket; dates are UTC.
    """

    @classmethod
    def name(cls) -> str:
        return "storage_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["root"], self.options.get("bucket"))


def stored_objects(spark: SparkSession, root: str) -> DataFrame:
    """Every object below the root: bucket, name, size, event. Conditions on bucket, beginning of the name and date reach the listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Listing)
    return spark.read.format("storage_listing").option("root", root).load()


def store_objects(contents: DataFrame, root: str) -> DataFrame:
    """Writes each row's content (bucket, name, content) as an object, and returns bucket, name and size as a plan that does so when it runs.

    An object is written whole under its own name, so a task that runs again replaces what it wrote.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for batch in batches:
            sizes = []
            for bucket, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = f"{base}/{bucket}/{name}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(content or b"")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["bucket", "name", "size"])

    return contents.select("bucket", "name", F.col("content").cast("binary").alias("content")).mapInArrow(write, "bucket string, name string, size long")


ALGORITHMS = ("MD5", "SHA1", "SHA256", "SHA384", "SHA512")


def file_manifest(objects: DataFrame, root: str, algorithms: tuple[str, ...] = ALGORITHMS, parts: int | None = None) -> DataFrame:
    """``objects`` (bucket, name) with n_bytes and a digest per algorithm, read from the store.

    Each file is read once, a chunk at a time for all algorithms together, so files may be longer than
    memory or one array. Objects that the store lacks have nulls. ``parts`` deals the objects out.
    """
    names = [a.lower() for a in algorithms]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for batch in batches:
            rows = []
            for bucket, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made, size = [hashlib.new(n) for n in names], 0
                try:
                    with store.open_input_stream(f"{base}/{bucket}/{name}") as file:
                        while chunk := file.read(CHUNK):
                            size += len(chunk)
                            for m in made:
                                m.update(chunk)
                    rows.append((size, *(m.hexdigest() for m in made)))
                except FileNotFoundError:
                    rows.append((None,) * (1 + len(made)))
            columns = list(zip(*rows)) if rows else [()] * (1 + len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], names=["bucket", "name", "n_bytes", *names])

    rows = objects.select("bucket", "name")
    rows = rows if parts is None else rows.repartition(parts, "bucket", "name")
    return rows.mapInArrow(digest, ", ".join(["bucket string, name string, n_bytes long", *(f"{n} string" for n in names)]))


def range_manifest(objects: DataFrame, root: str, length: int = 1 << 26, algorithm: str = "SHA256", parts: int = 200) -> DataFrame:
    """``objects`` (bucket, name, size) by ranges of ``length`` bytes: start, n_bytes and the range's digest.

    Ranges are dealt out to ``parts`` tasks, those of one large file to all of them; two copies are equal
    just where all their ranges are. An empty object has one empty range.
    """
    kind = algorithm.lower()
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("size") - 1), F.lit(length).cast("long"))
    rows = objects.select("bucket", "name", F.explode(starts).alias("start")).repartition(parts, "bucket", "name", "start")  # a set number: rows are small, what they ask for is not

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for batch in batches:
            sizes, found = [], []
            for bucket, name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made, left = hashlib.new(kind), length
                with store.open_input_file(f"{base}/{bucket}/{name}") as file:
                    file.seek(start)
                    while left and (chunk := file.read(min(CHUNK, left))):
                        made.update(chunk)
                        left -= len(chunk)
                sizes.append(length - left)
                found.append(made.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(found, pa.string())], names=["bucket", "name", "start", "n_bytes", "digest"])

    return rows.mapInArrow(digest, "bucket string, name string, start long, n_bytes long, digest string")


def stored_fixity(objects: DataFrame, root: str, algorithm: str = "MD5") -> DataFrame:
    """``objects``: bucket, name, stored_hash, stored_size. Per bucket: rows, and those whose file has another digest, another size, or is missing."""
    kind = algorithm.lower()
    found = file_manifest(objects, root, (algorithm,)).withColumnRenamed(kind, "digest_")
    rows = objects.join(found, ["bucket", "name"])
    wrong = lambda c: F.count_if(F.col("n_bytes").isNotNull() & F.coalesce(~c, F.lit(True)))
    return rows.groupBy("bucket").agg(
        F.count("*").alias("n"), wrong(F.col("digest_") == F.col("stored_hash")).alias("bad_hash"), wrong(F.col("n_bytes") == F.col("stored_size")).alias("bad_size"), F.count_if(F.col("n_bytes").isNull()).alias("missing")
    )

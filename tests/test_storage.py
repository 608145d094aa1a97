"""Stored tables and objects: partitions, buckets, listings with pushed conditions, digests, counts by the way, JDBC."""

import glob
import hashlib
import os
import random
from collections import Counter
from datetime import datetime, timezone

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sitefold.operators import local, mutate
from sitefold.plans.queries import queries, rocksdb
from sitefold.sources import catalog, storage, tables
from sitefold.streaming import central

ROWS = "bucket string, name string, request_id string"


def plan_of(rows):
    return rows._jdf.queryExecution().toString()


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/part-*", recursive=True)}


def test_one_request_is_dropped_or_replaced_and_others_keep_their_files(spark, tmp_path):
    path = f"{tmp_path}/requests"
    rows = [(f"b{i % 2}", f"n{i}", f"run {i % 3}'s") for i in range(30)]
    tables.save_requests(spark.createDataFrame(rows, ROWS), path)
    before = files(path)
    tables.drop_request(spark, path, "run 1's", ROWS)
    left = {f: t for f, t in before.items() if "run 1" not in f}
    assert files(path) == left and len(left) < len(before)
    back = tables.request_rows(spark, path, ROWS)
    assert {tuple(r) for r in back.collect()} == {r for r in rows if r[2] != "run 1's"}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("requests_")]
    tables.drop_request(spark, path, "never there", ROWS)
    for _ in range(2):
        tables.replace_request(spark.createDataFrame([("b", "new", "run 2's")], ROWS), path)
    back = tables.request_rows(spark, path, ROWS)
    assert {tuple(r) for r in back.where("request_id = \"run 2's\"").collect()} == {("b", "new", "run 2's")}
    assert {f: t for f, t in files(path).items() if "run 0" in f} == {f: t for f, t in before.items() if "run 0" in f}
    assert "PartitionFilters: [isnotnull(request_id" in plan_of(back.where("request_id = 'x'"))


def test_a_merge_into_a_bucketed_catalog_does_not_shuffle_it(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        old = spark.createDataFrame([(f"b{i % 3}", f"n{i}", "UPLOAD", i) for i in range(200)], "bucket string, name string, status string, size int")
        new = spark.createDataFrame([(f"b{i % 3}", f"n{i}", "READY") for i in range(100, 300)] + [("b1", "n100", "DELETED")], "bucket string, name string, status string")
        kept = tables.BucketedCatalog(spark, "objects_kept", f"{tmp_path}/kept", ["bucket", "name"], 8)
        kept.save(old)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        change = lambda rows, source: mutate.merge_or_discard(rows, source, ["bucket", "name"], ["status"], once=True)
        plan = plan_of(change(kept.rows(), kept.incoming(new))).split("== Physical Plan ==")[1]
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # the incoming rows alone
        kept.merge(change, new)
        got = {r.name: (r.status, r.size) for r in kept.rows().collect()}
        assert got == {f"n{i}": ("READY" if i >= 100 else "UPLOAD", i) for i in range(200)}
        again = plan_of(change(kept.rows(), kept.incoming(new))).split("== Physical Plan ==")[1]
        assert again.count("Exchange hashpartitioning") == 1
        sides = plan_of(kept.rows().join(kept.incoming(new.withColumnRenamed("status", "s")), ["bucket", "name"], "full_outer")).split("== Physical Plan ==")[1]
        assert sides.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        kept.drop()


def test_a_repeated_key_with_a_map_or_struct_counts_once(spark):
    form = "k int, s struct<a: int, b: string>, m map<string, int>"
    rows = spark.createDataFrame([(1, (1, "x"), {"a": 1}), (1, (2, None), {"a": 2}), (2, None, None)], form)
    for part in (rows, rows.drop("m")):
        got = mutate.one_per_key(part, ["k"]).orderBy("k").collect()
        assert [r.k for r in got] == [1, 2] and got[0].s.a == 2


def test_counts_are_taken_by_the_job_that_does_the_work(spark, tmp_path):
    objects = spark.createDataFrame([("s", "b", f"n{i}", "READY", datetime(2020, 1, 1)) for i in range(20)], "site string, bucket string, name string, status string, creation timestamp_ntz")
    listing = spark.createDataFrame([("s", "b", f"n{i}", datetime(2020, 1, 2)) for i in range(5, 30)], "site string, bucket string, name string, event timestamp_ntz")
    objects.write.parquet(f"{tmp_path}/o")
    objects = spark.read.parquet(f"{tmp_path}/o")
    native = local.reconcile_local(objects, listing, "s", F.lit(datetime(2021, 1, 1)).cast("timestamp_ntz"))[1]
    seen = Observation("run")
    counted = tables.checked(native, seen)
    assert plan_of(counted).split("== Physical Plan ==")[1].count("FileScan") == plan_of(native).split("== Physical Plan ==")[1].count("FileScan") == 1
    counted.write.parquet(f"{tmp_path}/native")
    again = local.local_counts(spark.read.parquet(f"{tmp_path}/native")).drop("bucket").first()
    assert seen.get == again.asDict() == {"checked_db": 20, "checked_driver": 25, "checked": 30}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    objects = [("b0", f"dir{i % 3}/sub{i % 2}/o{i}", b"x" * i) for i in range(40)] + [("b1", "top", b"\0\xff" * 70000), ("b1", "dir1/empty", b""), ("b1", "dir10/o", b"ten"), ("b1", "dir1/ö ü", b"name")]
    assert storage.store_objects(spark.createDataFrame(objects, "bucket string, name string, content binary").repartition(3), root).count() == len(objects)
    old = datetime(2001, 2, 3, tzinfo=timezone.utc).timestamp()
    os.utime(f"{root}/b0/dir1/sub1/o1", (old, old))
    return root, objects


def test_a_listing_takes_conditions_to_the_store(spark, store):
    root, objects = store
    rows = storage.stored_objects(spark, root)
    assert Counter((r.bucket, r.name, r.size) for r in rows.collect()) == Counter((b, n, len(c)) for b, n, c in objects)
    for prefix in ("dir1", "dir1/", "dir1/sub1/o1", "t", "none/", ""):
        for bucket in ("b0", "b1", "b2"):
            got = rows.where((F.col("bucket") == bucket) & F.col("name").startswith(prefix))
            assert sorted(r.name for r in got.collect()) == sorted(n for b, n, _ in objects if b == bucket and n.startswith(prefix))
    some = rows.where("bucket = 'b0' and startswith(name, 'dir1/')")
    plan = plan_of(some).split("== Physical Plan ==")[1]
    assert "Filter (" not in plan and some.rdd.getNumPartitions() == 1  # both conditions are the listing's, one prefix is one task
    assert rows.where("bucket = 'b0'").rdd.getNumPartitions() == 4
    dated = rows.where("event <= timestamp_ntz'2001-02-03 00:00:00'")
    assert [r.name for r in dated.collect()] == ["dir1/sub1/o1"] and "Filter (" not in plan_of(dated).split("== Physical Plan ==")[1]
    assert rows.where("event < timestamp_ntz'2001-02-03 00:00:00'").count() == 0
    assert rows.where("event >= timestamp_ntz'2001-02-03 00:00:00' and event > timestamp_ntz'2001-02-03 00:00:00'").count() == len(objects) - 1
    assert rows.where("startswith(name, 'dir1') and startswith(name, 'dir2')").count() == 0
    assert rows.where("bucket = 'b0' and bucket = 'b1'").count() == 0
    assert rows.where("size = 3 and endswith(name, 'o3')").select("name").first().name == "dir0/sub1/o3"


def test_digests_of_files_equal_those_of_columns(spark, store, monkeypatch):
    root, objects = store
    monkeypatch.setattr(storage, "CHUNK", 1000)
    names = spark.createDataFrame([(b, n) for b, n, _ in objects] + [("b1", "missing")], "bucket string, name string")
    got = {(r.bucket, r.name): r for r in storage.file_manifest(names, root, parts=3).collect()}
    for b, n, c in objects:
        assert [got[b, n].n_bytes, *(got[b, n][a.lower()] for a in storage.ALGORITHMS)] == [len(c), *(hashlib.new(a, c).hexdigest() for a in storage.ALGORITHMS)]
    assert got["b1", "missing"].n_bytes is None and got["b1", "missing"].md5 is None


def test_ranges_of_a_large_file_are_dealt_out(spark, store):
    root, objects = store
    listed = storage.stored_objects(spark, root)
    rows = storage.range_manifest(listed, root, length=4096, parts=4)
    got = {(r.bucket, r.name, r.start): (r.n_bytes, r.digest) for r in rows.collect()}
    want = {(b, n, k): (len(c[k : k + 4096]), hashlib.sha256(c[k : k + 4096]).hexdigest()) for b, n, c in objects for k in range(0, max(1, len(c)), 4096)}
    assert got == want
    tasks = rows.select("name", F.spark_partition_id().alias("task")).where("name = 'top'").distinct().collect()
    assert len(tasks) == 4


def test_fixity_of_stored_files(spark, store):
    root, objects = store
    rows = [(b, n, hashlib.md5(c if i % 5 else b"other").hexdigest() if i % 7 else None, len(c) + (i % 4 == 0)) for i, (b, n, c) in enumerate(objects)] + [("b1", "missing", "x", 1)]
    got = {r.bucket: tuple(r)[1:] for r in storage.stored_fixity(spark.createDataFrame(rows, "bucket string, name string, stored_hash string, stored_size long"), root).collect()}
    for bucket in ("b0", "b1"):
        own = [i for i, (b, _, _) in enumerate(objects) if b == bucket]
        gone = bucket == "b1"
        assert got[bucket] == (len(own) + gone, sum(i % 5 == 0 or i % 7 == 0 for i in own), sum(i % 4 == 0 for i in own), int(gone))


def test_sites_states_as_they_arrive(spark, tmp_path):
    sites = ["s0", "s1"]
    t = lambda d: datetime(2020, 1, d)
    form = "name string, site string, round long, event timestamp_ntz, nstatus int"
    runs = [
        [("a", "s0", 0, t(2), 10), ("b", "s0", 0, t(1), 1), ("c", "s0", 0, t(1), 10)],
        [("a", "s1", 0, t(1), 1), ("b", "s1", 0, t(1), 1), ("c", "s1", 0, t(1), 10), ("c", "s1", 0, t(1), 10)],
        [("a", "s1", 0, t(1), 1)],  # sent again: nothing changes
        [("a", "s1", 1, t(3), 10), ("c", "s0", 1, t(1), 10), ("d", "s0", 0, None, 10)],
    ]
    seen = []
    with rocksdb(spark):
        for rows in runs:
            spark.createDataFrame(rows, form).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            found = []
            keep = lambda batch, _, found=found: found.extend((r.name, r.need_action, r.sites) for r in central.changed_actions(batch, sites).collect())
            arrived = spark.readStream.schema(form).parquet(f"{tmp_path}/in")
            central.states_stream(arrived).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
            seen.append(sorted(found))
    first, second, repeated, last = seen
    assert {n for n, _, _ in first} <= {"a", "b", "c"} and [x for x in second if x[0] == "a"] == [("a", 20, ["s1"])]
    assert repeated == []
    assert [x for x in last if x[0] == "a"] == [("a", None, None)]  # withdrawn: both sites are READY now
    assert "c" not in {n for n, _, _ in last}


def test_sites_states_in_tables_equal_those_of_the_state_store(spark, tmp_path):
    rng, sites = random.Random(3), ["s0", "s1", "s2"]
    runs = [[(f"n{rng.randrange(12)}", rng.choice([*sites, "s9"]), rng.randrange(3), rng.choice([None, datetime(2020, 1, 1 + rng.randrange(4))]), rng.choice([1, 2, 10, 11, 20])) for _ in range(25)] for _ in range(3)]
    runs.append(runs[1])  # sent again
    write, found, state = central.tables_writer(spark, f"{tmp_path}/t", sites), [], {}
    top = lambda r: (r[2], r[3] is not None, r[3] or datetime.min, -r[4])
    for batch, rows in enumerate(runs):
        for _ in range(2):  # the second time as after a crash
            write(spark.createDataFrame(rows, central.LISTED), batch)
        before = dict(state)
        for r in rows:
            state[r[:2]] = max(r, state.get(r[:2], r), key=top)
        names = {k[0] for k in state if state[k] != before.get(k)}
        states = [(n, now, r[1], r[3], r[4]) for now, all_ in ((False, before), (True, state)) for (n, _), r in all_.items() if n in names]
        want = central.changed_actions(spark.createDataFrame(states, central.STATES), sites)
        got = spark.read.parquet(f"{tmp_path}/t/actions/batch={batch}")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        found.append(got.count())
    assert found[0] and found[1] and found[3] == 0


def test_large_listings_need_no_call_per_object(spark, monkeypatch):
    """With a call for each object, six times sf0.1 didn't end in time."""

    def refuse(*_):
        raise AssertionError("a call of Python for an object")

    monkeypatch.setattr(central.SiteStates, "handleInputRows", refuse)
    sf, found = "/root/testdata/sf0.001", queries()
    assert found["stream_central"](spark, sf).exceptAll(found["reconcile_central"](spark, sf)).isEmpty()


def test_a_database_table_is_read_in_ranges(spark, tmp_path):
    """Derby comes with Spark."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(i, f"name {i}", i % 3) for i in range(100)], "id long, name string, kind int")
    rows.write.format("jdbc").options(url=url, dbtable="OBJECTS", **driver).save()
    read = catalog.scan_jdbc(spark, url, "OBJECTS", key="id", bounds=(0, 100), parts=5, **driver)
    assert read.rdd.getNumPartitions() == 5
    some = read.where("kind = 1").select("id", "name")
    assert sorted(r.id for r in some.collect()) == list(range(1, 100, 3))
    assert "PushedFilters: [*IsNotNull(kind), *EqualTo(kind,1)]" in plan_of(some)


def test_refresh_as_the_older_system_does(spark):
    t = lambda d: datetime(2020, 1, d)
    objects = spark.createDataFrame([("s", "b", "n", "UPLOAD", t(1), 1, t(9), 5), ("s", "b", "m", "READY", t(1), 2, t(9), 6)], "site string, bucket string, name string, status string, creation timestamp_ntz, rstatus int, expires timestamp_ntz, size long")
    states = spark.createDataFrame([("b", "n", "s", t(2), 11), ("b", "m", "s", t(1), 10)], "bucket string, name string, site string, event timestamp_ntz, nstatus int")
    listing = spark.createDataFrame([("s", "b", "n", t(3), t(20), 7)], "site string, bucket string, name string, event timestamp_ntz, expires timestamp_ntz, size long")
    for compat, rank, expires in ((True, 10, t(3)), (False, 2, t(20))):
        fresh, after = local.refresh_from_driver(objects, states, listing, "s", compat=compat)
        n, m = (next(r for r in fresh.collect() if r.name == x) for x in "nm")
        assert (n.status, n.creation, n.rstatus, n.expires, n.size) == ("READY", t(3), rank, expires, 7)
        assert (m.status, m.rstatus, m.expires) == ("READY", 2, t(9))
        assert {r.name: r.nstatus for r in after.collect()} == {"n": 10, "m": 10}

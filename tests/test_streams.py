"""Orders in hot objects and hot targets, and as streams with restarts, crashes, repeats and states that go."""

import glob
import json
import os
import random
from collections import Counter
from datetime import datetime, timedelta
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from sitefold.operators import orders as o
from sitefold.plans.queries import queries, rocksdb
from sitefold.streaming import orders as s

BEGIN = datetime(2024, 1, 1)
FORM = s.ORDER


def order(i, minutes, bucket="b", name="x", action="CREATE", target="site1", source="site0"):
    return (i, BEGIN + timedelta(minutes=minutes), source, target, "client", bucket, name, action)


def plain_fold(rows, start):
    """Order by order, as a site works them off."""
    state, errors = dict(start), Counter()
    touched = set()
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (r[5], r[6])
        if r[7] not in ("CREATE", "DELETE") or not r[6]:
            continue
        touched.add(key)
        now = state.get(key)
        if now not in (None, "READY", "DELETED") or (r[7] == "CREATE") == (now == "READY"):
            errors[key] += 1
        else:
            state[key] = "READY" if r[7] == "CREATE" else "DELETED"
    return {(*k, state.get(k), errors[k]) for k in touched}


def mixed_orders(n, seed, hot=0.7):
    rng = random.Random(seed)
    actions = ["CREATE", "DELETE", "CREATE", "DELETE", "UNKNOWN"]
    return [order(i, rng.randrange(n), f"b{rng.randrange(3)}" if (far := rng.random() > hot) else "b0", rng.choice(["x", "y", "z", None, ""]) if far else "hot", rng.choice(actions)) for i in range(n)]


START = [("b0", "hot", "DELETED"), ("b1", "x", "READY"), ("b2", "y", "UPLOAD"), ("b0", "z", "ERR_UPL"), ("b9", "other", "READY")]


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_fold_of_a_hot_object_equals_the_plain_fold(spark, ranges):
    rows = mixed_orders(3000, ranges)
    orders = spark.createDataFrame(rows, FORM).repartition(4)
    known = spark.createDataFrame(START, "bucket string, name string, status string")
    got = {tuple(r) for r in o.fold_orders(orders, known, ranges).collect()}
    assert got == plain_fold(rows, {(b, n): st for b, n, st in START})
    parts = o.fold_ranges(orders, ranges).collect()  # what a task may get
    hot = [p.n for p in parts if p.object_name == "hot"]
    assert len(hot) == ranges and max(hot) < 1.5 * sum(hot) / ranges + 20


def test_transitions_compose_in_any_grouping(spark):
    rows = mixed_orders(800, 5)
    parts = o.fold_ranges(spark.createDataFrame(rows, FORM), 16)
    whole = {tuple(r) for r in o.compose_ranges(parts).drop("range").collect()}
    halves = o.compose_ranges(parts.where("range < 9")).unionByName(o.compose_ranges(parts.where("range >= 9")))
    assert whole == {tuple(r) for r in o.compose_ranges(halves).drop("range").collect()}


def test_fold_of_odd_orders(spark):
    known = spark.createDataFrame(START, "bucket string, name string, status string")
    assert o.fold_orders(spark.createDataFrame([], FORM), known).count() == 0
    rows = [(1, None, "a", "b", "c", "b0", "hot", "CREATE"), order(2, 5, "b0", "hot", "DELETE"), order(3, 5, "b0", "hot", "DELETE")]
    got = [tuple(r) for r in o.fold_orders(spark.createDataFrame(rows, FORM), known).collect()]
    assert got == [("b0", "hot", "DELETED", 1)]  # an order without a time comes first


def test_times_without_zone_keep_their_order_where_clocks_are_set(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        rows = [(i, datetime(2024, 3, 31, 1, 30) + timedelta(minutes=5 * i), "a", "b", "c", "b", "x", "CREATE" if i % 2 else "DELETE") for i in range(24)]
        orders = spark.createDataFrame(rows, FORM)
        ranges = [r[0] for r in orders.select(o.time_range(orders, 8).alias("r"), "op_id").orderBy("op_id").collect()]
        assert ranges == sorted(ranges) and len(set(ranges)) == 8
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_hot_target_lies_in_many_files_in_order(spark, tmp_path):
    rows = [order(i, i % 977, target="site9" if i % 10 else f"site{i % 3}") for i in range(6000)]
    o.write_by_target(spark.createDataFrame(rows, FORM).repartition(3), f"{tmp_path}/t", 12)
    assert sorted(os.path.basename(f) for f in glob.glob(f"{tmp_path}/t/to_site=*")) == [f"to_site=site{i}" for i in (0, 1, 2, 9)]
    files = sorted(glob.glob(f"{tmp_path}/t/to_site=site9/*.json"))
    held = [[json.loads(line) for line in open(f)] for f in files]
    assert len(files) >= 8 and max(map(len, held)) < 0.25 * sum(map(len, held))
    flat = [(x["ts"], x["op_id"]) for part in held for x in part]
    assert flat == sorted(flat) and len(flat) == 5400
    back = o.read_by_target(spark, f"{tmp_path}/t", FORM)
    assert {tuple(r) for r in back.collect()} == set(rows)
    one = back.where("to_site = 'site1'")
    assert "PartitionFilters: [isnotnull(to_site" in one._jdf.queryExecution().toString()


def deliver(spark, base, rows):
    spark.createDataFrame(rows, FORM).coalesce(2).write.mode("append").option("timestampNTZFormat", s.TIME).json(f"{base}/in")


def sink(spark, base):
    s.write_files(s.read_files(spark, f"{base}/in"), f"{base}/out", f"{base}/check").awaitTermination()
    return Counter(map(tuple, s.read_written(spark, f"{base}/out").select(*(f.split()[0] for f in FORM.split(", "))).collect()))


def test_the_sink_writes_once_over_restarts_and_crashes(spark, tmp_path):
    first, second = [order(i, i, target=None if i % 4 else "site1") for i in range(50)], [order(i, i) for i in range(50, 80)]
    deliver(spark, tmp_path, first)
    assert sink(spark, tmp_path) == Counter(first)
    deliver(spark, tmp_path, second)
    assert sink(spark, tmp_path) == Counter(first + second)
    # A crash after the batch was written and before it was committed: the batch runs again.
    last = max(glob.glob(f"{tmp_path}/check/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    os.remove(last)
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    assert sink(spark, tmp_path) == Counter(first + second)
    # A file that a failed task left behind is in no commit.
    stray = f"{tmp_path}/out/to_site=site1/part-stray.json"
    with open(stray, "w") as f:
        f.write(json.dumps({"op_id": 999}) + "\n")
    assert sink(spark, tmp_path) == Counter(first + second)


def remembered(query):
    """Rows of the state store after the last batch that used it."""
    return [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]][-1][0]["numRowsTotal"]


def test_messages_hold_the_orders_and_keep_an_objects_in_one_partition(spark):
    """What a topic would get: keys by object, values that read back as the orders."""
    rows = [order(i, i, bucket=f"b{i % 2}", name=None if i % 5 == 0 else f"n{i % 3}", target=None if i % 2 else "site1") for i in range(30)]
    messages = s.as_messages(spark.createDataFrame(rows, FORM))
    assert {r.key for r in messages.collect()} == {f"{r[5]}/{r[6] or ''}" for r in rows}
    back = messages.select(F.from_json("value", FORM, {"timestampNTZFormat": s.TIME}).alias("o")).select("o.*")
    assert {tuple(r) for r in back.collect()} == set(rows)


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    write = s.batch_writer(f"{tmp_path}/out")
    rows = spark.createDataFrame([order(i, i) for i in range(9)], FORM)
    for batch, part in ((0, "op_id < 5"), (1, "op_id >= 5"), (1, "op_id >= 5")):
        write(rows.where(part), batch)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 9


def test_repeated_orders_on_the_topic(spark, tmp_path):
    """Repeats within the bound come out once, also over a restart; what is remembered stays bounded."""
    seen, state = [], []

    def run(rows):
        deliver(spark, tmp_path, rows)
        out = s.dedup_stream(s.read_files(spark, f"{tmp_path}/in"), "30 minutes")
        query = out.writeStream.foreachBatch(lambda batch, _: seen.extend(r.op_id for r in batch.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        state.append(remembered(query))

    with rocksdb(spark):
        run([order(i, i, name=f"n{i}") for i in range(20)])
        run([order(100 + i, i + 8, name=f"n{i}") for i in range(20)])  # the same orders, sent again
        assert sorted(seen) == list(range(20))
        for k in range(2, 8):  # later orders, while the first ones are forgotten
            run([order(1000 * k + i, 100 * k + i, name=f"n{k}-{i}") for i in range(20)])
    assert len(seen) == 20 * 7 and max(state) <= 40


def test_states_start_from_the_catalog_and_go_when_idle(spark, tmp_path):
    known = spark.createDataFrame(START, "bucket string, name string, status string")
    rows = sorted(mixed_orders(300, 3), key=lambda r: (r[1], r[0]))
    last, state = {}, []

    def run(part, **how):
        base = f"{tmp_path}/{len(how)}"
        deliver(spark, base, part)
        out = s.apply_stream(s.read_files(spark, f"{base}/in"), known, **how)
        keep = lambda batch, _: last.update({(r.bucket_name, r.object_name): (r.final_status, r.errors) for r in batch.collect()})
        query = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        state.append(remembered(query))

    with rocksdb(spark):
        run(rows[:150])
        run(rows[150:])
        assert {(*k, *v) for k, v in last.items()} == plain_fold(rows, {(b, n): st for b, n, st in START})
        state.clear()
        gone = [order(10 * i + j, 100 * i + j, "b", f"n{i}", a) for i in range(6) for j, a in enumerate(["CREATE", "DELETE"])]
        for i in range(6):
            run(gone[2 * i : 2 * i + 2], idle="10 minutes")
        assert all(last["b", f"n{i}"] == ("DELETED", 0) for i in range(6))
        assert state[-1] < 6 + len(START)  # deleted objects of earlier batches are let go
        run([order(900, 2000, "b", "n0", "DELETE"), order(901, 2001, "b", "n0", "CREATE")], idle="10 minutes")
        assert last["b", "n0"] == ("READY", 1)


def test_both_folds_agree_on_adjacent_actions():
    """The closed form's ground: an order fails just where it repeats the action before it."""
    for bits in range(256):
        actions = ["CREATE" if bits >> k & 1 else "DELETE" for k in range(8)]
        rows = [order(k, k, action=a) for k, a in enumerate(actions)]
        for start in (None, "READY", "DELETED"):
            known = {} if start is None else {("b", "x"): start}
            repeats = sum(a == b for a, b in pairwise(actions)) + ((actions[0] == "CREATE") == (start == "READY"))
            assert [x[3] for x in plain_fold(rows, known)] == [repeats]


def test_states_in_tables_equal_the_plain_fold(spark, tmp_path):
    """Batches that are sent again, or run again after a crash, and orders that come too late change nothing."""
    known = spark.createDataFrame(START, "bucket string, name string, status string")
    rows = sorted(mixed_orders(300, 4), key=lambda r: (r[1], r[0])) + [order(900 + i, 400 + i, None, "n", a) for i, a in enumerate(["DELETE", "CREATE", "CREATE"])]
    write = s.apply_writer(spark, f"{tmp_path}/out", known, 4)
    parts = [rows[:120], rows[120:301], rows[100:200], rows[301:], [order(999, -1, "b0", "hot", "DELETE")]]
    for batch, part in enumerate(parts):
        for _ in range(2):
            write(spark.createDataFrame(part, FORM).repartition(3), batch)
    got = {tuple(r) for r in s.latest_states(spark.read.parquet(f"{tmp_path}/out/states")).collect()}
    assert got == plain_fold(rows, {(b, n): st for b, n, st in START})


def refuse(*_):
    raise AssertionError("a call of Python for an object")


def test_large_batches_of_orders_need_no_call_per_object(spark, monkeypatch):
    """With a call for each object of the catalog, sixty times sf0.1 didn't end in time."""
    monkeypatch.setattr(s.ObjectState, "handleInitialState", refuse)
    monkeypatch.setattr(s.ObjectState, "handleInputRows", refuse)
    sf, found = "/root/testdata/sf0.001", queries()
    assert found["stream_apply"](spark, sf).exceptAll(found["fold_orders"](spark, sf)).isEmpty()

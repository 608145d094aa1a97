"""Known small cases, and the action rules against a plain evaluator on random states."""

import random
import re
import unicodedata
from datetime import datetime, timedelta
from urllib.parse import unquote_plus

import pytest
from pyspark.sql import functions as F

from sitefold import model as m
from sitefold.functions import names
from sitefold.functions import predicates as p
from sitefold.operators import central, content, lifecycle, local, mutate, orders, rights
from sitefold.sources import catalog

T0 = datetime(2024, 1, 1)
OBJECT = "site string, bucket string, name string, status string, creation timestamp_ntz, expires timestamp_ntz, size long, hash string"


def seven(spark):
    """One object in each status."""
    return spark.createDataFrame([("a", "b", f"dir/object_{s}", s, T0 - timedelta(seconds=100), None, 1, "hash") for s in m.STATUSES], OBJECT)


def test_one_site_from_start_to_states(spark):
    stored = [("a", "b", f"dir/object_{s}", T0 - timedelta(seconds=99)) for s in ("READY", "UPLOAD", "DELETING")] + [("a", "b", "dir/object_ExtraDoc", T0 - timedelta(seconds=97))]
    listing = spark.createDataFrame(stored, "site string, bucket string, name string, event timestamp_ntz")
    objects, native, states = local.reconcile_local(seven(spark), listing, "a", F.lit(T0).cast("timestamp_ntz"))
    assert native.count() == 7 and native.where("driver is not null").count() == 4
    found = {r["name"][11:]: r["nstatus"] for r in states.collect()}
    assert found == {"UPLOAD": 10, "READY": 10, "ERR_UPL": 20, "DELETING": 2, "DELETED": 1, "ERR_DEL": 1, "ExtraDoc": 10}
    assert {r["name"][11:] for r in objects.where("status = 'READY'").collect()} == {"UPLOAD", "READY", "ExtraDoc"}


def test_start_of_a_run_marks_two_for_update(spark):
    left, _ = local.purge_unknown(seven(spark), spark.createDataFrame([], "bucket string, name string"), "a", "b")
    ranked = local.rank_remap(local.with_rank(left), "a", F.lit(T0).cast("timestamp_ntz"), "b")
    assert ranked.count() == 6 and ranked.where(F.col("rstatus") == m.TO_UPDATE).count() == 2


def plain(states, sites):
    """The rules, one object at a time."""
    ordered = sorted(states, key=lambda s: (-s[1].timestamp(), s[2]))
    primary, codes = ordered[0][2], {s: c for s, _, c in states}
    missing = set(sites) - set(codes)
    pick = lambda ok: sorted(s for s, c in codes.items() if ok(c))
    any_of = lambda *k: any(c in k for c in codes.values())
    if primary in (1, 2) and any_of(2, 10, 11, 20):
        action, origin, targets = 2, None, set(pick(lambda c: c != 1)) | missing
    elif primary in (10, 11) and any_of(1, 2, 11, 20):
        action = 20 if any(c <= 2 or c >= 20 for c in codes.values()) else 11
        origin, targets = pick(lambda c: c == 10) or pick(lambda c: c == 11), set(pick(lambda c: c != 10)) | missing
    elif primary == 20 and any_of(10, 11):
        action, origin, targets = 20, pick(lambda c: c == 10) or pick(lambda c: c == 11), set(pick(lambda c: c != 10)) | missing
    elif primary == 20:
        action, origin, targets = 30, None, set(pick(lambda c: c != 1)) | missing
    else:
        return None
    return (action, origin, sorted(targets)) if targets else None


def test_actions_equal_the_plain_rules(spark):
    rng = random.Random(5)
    sites = [f"s{i}" for i in range(5)]
    rows, want = [], {}
    for k in range(400):
        own = [(s, T0 - timedelta(seconds=rng.randint(0, 3)), rng.choice([0, 1, 2, 10, 11, 20, 21, 30])) for s in rng.sample(sites, rng.randint(1, 5))]
        rows += [(f"o{k}", *s) for s in own]
        want[f"o{k}"] = plain(own, sites)
    frame = spark.createDataFrame(rows, "name string, site string, event timestamp_ntz, nstatus int")
    got = {r["name"]: (r["need_action"], r["need_action_from"], r["sites"]) for r in central.compute_actions(frame, sites).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_actions_need_one_pass(spark):
    frame = spark.createDataFrame([("o", "s", T0, 1)], "name string, site string, event timestamp_ntz, nstatus int")
    plan = central.compute_actions(frame, ["s"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_ready_everywhere_known_asks_for_nothing_unless_partial_repair(spark):
    frame = spark.createDataFrame([("o", "s1", T0, 10), ("o", "s2", T0, 10)], "name string, site string, event timestamp_ntz, nstatus int")
    assert central.compute_actions(frame, ["s1", "s2", "s3"]).count() == 0
    repaired = central.compute_actions(frame, ["s1", "s2", "s3"], repair_partial=True).collect()
    assert [(r["need_action"], r["sites"]) for r in repaired] == [(m.UPLOAD, ["s3"])]


def test_merging_twice_changes_nothing(spark):
    kind = "name string, site string, event timestamp_ntz, nstatus int"
    old = spark.createDataFrame([("o", "s1", T0, 1), ("o", "s2", T0, 2)], kind)
    new = spark.createDataFrame([("o", "s1", T0, 10), ("o", "s1", T0 - timedelta(1), 1), ("p", "s1", T0, 20)], kind)
    once = central.merge_site_listing(old, new)
    twice = central.merge_site_listing(once, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) and once.count() == 3


@pytest.mark.parametrize("archive, left", [(None, 7), ("archive", 8)])
def test_purge(spark, archive, left):
    past, later = T0 - timedelta(1), T0 + timedelta(1)
    rows, stored = [], []
    for status in ("DELETED", "READY"):
        for expires in (past, later):
            for there in (True, False):
                name = f"{status}-{expires > T0}-{there}"
                rows.append(("a", "b", name, status, past, expires, 1, "h"))
                stored += [("a", "b", name, past)] * there
    rows.append(("a", "other", "x", "DELETED", past, past, 1, "h"))
    buckets = spark.createDataFrame([("b", "me", "a", "READY"), ("other", "you", "a", "READY")], "id string, client_id string, site string, status string")
    listing = spark.createDataFrame(stored, "site string, bucket string, name string, event timestamp_ntz")
    out = lifecycle.purge_run(spark.createDataFrame(rows, OBJECT), buckets, listing, "me", "a", T0, archive, 60)
    assert out.count() == left
    assert out.where("status = 'DELETED'").count() == 5
    if archive:
        told = out.where("bucket = 'archive'").first()
        assert told["metadata"]["archived_from_bucket"] == "b" and told["expires"] == T0 + timedelta(seconds=60)


def test_no_task_of_a_purge_gets_a_whole_bucket(spark):
    """A client's buckets are few, whatever size the planner takes their table for."""
    objects = spark.range(50).selectExpr("'a' AS site", "concat('b', id % 3) AS bucket", "concat('n', id) AS name", "'READY' AS status", "CAST(NULL AS timestamp_ntz) AS creation", "CAST(NULL AS timestamp_ntz) AS expires", "id AS size", "'h' AS hash")
    buckets = objects.selectExpr("bucket AS id", "'me' AS client_id", "site").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (lifecycle.purge_deleted(objects, buckets, objects, "me", "a", T0)[0], lifecycle.expire_ready(objects, buckets, "me", "a", T0), lifecycle.purge_run(objects, buckets, objects, "me", "a", T0, "old"), lifecycle.purge_orders(objects, buckets, "me", "a", T0)):
            assert not re.search(r"SortMergeJoin \[bucket#\d+\]", out._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rights_table(spark):
    pairs = rights.all_pairs_of_rights(spark.createDataFrame([(c,) for c in range(8)], "code int")).collect()
    assert len(pairs) == 64
    for a, b, covers, fusion in pairs:
        assert covers == ((a & b) == b if b else a == 0) and fusion == a | b


#: One name for each rule.
CLEAN = {
    "plain.txt": "plain.txt",
    "one+two": "one_two",  # as in a URL
    "north%2Fsouth": "north/south",
    "100%": "100",  # not an escape, so nothing is decoded
    "win\\dows": "win/dows",
    "deep//down": "deep/down",
    "Zoë Ångström": "Zoe_Angstrom",
    "o\u0302pera": "opera",  # a mark of its own
    "tab\tand\nline": "tab_and_line",
    "mixed _ _ gap": "mixed_gap",
    "(1) [b] {c}!": "1_b_c",
    "dash---dash": "dash-dash",
    "\u3000edge ": "edge",
    "/root": "root",
    "?!": "",
    "": None,
    None: None,
}


def plain_clean(name):
    """The rules, a character at a time."""
    text = unquote_plus(name).replace("\\", "/").replace("//", "/")
    out = ""
    for c in unicodedata.normalize("NFD", text):
        c = " " if c in " \t\n_" else c
        if c in "/_ .-" or c.isascii() and c.isalnum():
            out += "" if c in " -" and out.endswith(c) else c
    # Characters that went may have stood between two blanks.
    out = "_".join(part for part in out.split(" ") if part)
    return out[1:] if out.startswith("/") else out


def test_clean_names(spark):
    rng = random.Random(8)
    alphabet = ["a", "B", "7", " ", "_", "-", "/", ".", "+", "é", "(", "\t", "\\", "%41", "ö"]
    swept = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    given = [*CLEAN, *swept]
    want = [*CLEAN.values(), *map(plain_clean, swept)]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, name string").select("i", names.sanitized(F.col("name")).alias("clean")).orderBy("i").collect()
    assert [(g, r["clean"]) for g, r in zip(given, rows, strict=True)] == list(zip(given, want, strict=True))


def test_name_faults(spark):
    rows = spark.createDataFrame([("ok/name.txt",), ("bad name",), ("x;y",), ("t\tab",), (None,), ("",)], "name string")
    good, bad = content.validate_names(rows, "name")
    assert [r["name"] for r in good.collect()] == ["ok/name.txt"]
    assert sorted(r["reason"] for r in bad.collect()) == ["control", "empty", "empty", "pattern", "tag"]


def test_folding_equals_a_plain_fold(spark):
    rng, rows, start, want = random.Random(2), [], [], {}
    for k in range(150):
        status = rng.choice([None, "READY", "DELETED", "UPLOAD", "ERR_DEL"])
        if status:
            start.append(("b", f"o{k}", status))
        errors, now = 0, status
        for i in range(rng.randint(1, 6)):
            action = rng.choice(["CREATE", "DELETE"])
            rows.append((i, T0 + timedelta(seconds=i), "b", f"o{k}", action))
            stuck = status in ("UPLOAD", "ERR_DEL")
            if stuck or (action == "CREATE") == (now == "READY"):
                errors += 1
            else:
                now = "READY" if action == "CREATE" else "DELETED"
        want[f"o{k}"] = (now, errors)
    got = orders.fold_orders(
        spark.createDataFrame(rows, "op_id long, ts timestamp_ntz, bucket_name string, object_name string, action string"), spark.createDataFrame(start, "bucket string, name string, status string")
    )
    assert {r["object_name"]: (r["final_status"], r["errors"]) for r in got.collect()} == want


def test_fan_out_without_sites_up(spark):
    order = spark.createDataFrame([(1, "s1", None), (2, "s1", "s2"), (3, "s1", "s1")], "op_id long, from_site string, to_site string")
    up = spark.createDataFrame([("s1", "UP"), ("s2", "DOWN")], "id string, status string")
    routed, lost = orders.fan_out_orders(order, up)
    assert routed.count() == 0 and sorted(r["op_id"] for r in lost.collect()) == [2, 3]


def test_update_if_changed_and_status_audit(spark):
    target = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, v int, w string")
    source = spark.createDataFrame([("a", 1, None), ("b", 2, "y")], "k string, v int, w string")
    out = {r["k"]: (r["w"], r["changed"]) for r in mutate.update_if_changed(target, source, ["k"]).collect()}
    assert out == {"a": (None, False), "b": ("y", True)}
    rows = spark.createDataFrame([("a", "READY", T0)], "k string, status string, creation timestamp_ntz")
    changes = spark.createDataFrame([("a", "DELETED", None), ("z", "READY", None)], "k string, new_status string, new_creation timestamp_ntz")
    table, missed = mutate.update_status(rows, changes, ["k"])
    assert table.first()["status"] == "DELETED" and [r["k"] for r in missed.collect()] == ["z"]


def test_bad_predicate_trees():
    with pytest.raises(ValueError):
        p.from_json({"query": "LIKE", "fieldName": "a", "svalue": "b"})
    with pytest.raises(ValueError):
        p.from_json({"conjunction": "XOR", "restQueries": []})


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b", "n/1", T0, {"k": "v"})], "bucket string, name string, event timestamp_ntz, metadata map<string,string>")
    catalog.export_ndjson(rows, str(tmp_path / "out"), "gzip")
    back = catalog.import_ndjson(spark, str(tmp_path / "out"), rows.schema)
    assert back.collect() == rows.collect()
    (tmp_path / "store/b/n").mkdir(parents=True)
    (tmp_path / "store/b/n/1").write_bytes(b"abc")
    listed = catalog.list_storage_files(spark, str(tmp_path / "store"), "b").collect()
    assert [(r["bucket"], r["name"], r["size"]) for r in listed] == [("b", "n/1", 3)]


def test_repeated_source_keys_never_multiply_rows(spark):
    target = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, status string, creation int")
    source = spark.createDataFrame([(1, "x", 5), (1, "y", 4), (3, "z", 1)], "k int, status string, creation int")
    assert [tuple(r) for r in mutate.merge_or_discard(target, source, ["k"], ["status"]).orderBy("k").collect()] == [(1, "y", 0), (2, "b", 0)]
    assert mutate.update_if_changed(target, source, ["k"]).count() == 2
    changes = source.select("k", source.status.alias("new_status"), source.creation.alias("new_creation"))
    assert mutate.update_status(target, changes, ["k"])[0].count() == 2


def test_names_listed_twice_count_once(spark):
    stamp = lambda d: datetime(2020, 1, d)
    listing = spark.createDataFrame([("s", "b", "n", stamp(1)), ("s", "b", "n", stamp(3)), ("s", "b", "o", stamp(2))], "site string, bucket string, name string, event timestamp_ntz")
    native = spark.createDataFrame([], f"bucket string, name string, db {local.STATE}, driver {local.STATE}")
    got = {r["name"]: r["driver"]["event"] for r in local.snapshot_driver(native, listing, "s").collect()}
    assert got == {"n": stamp(3), "o": stamp(2)} and local.snapshot_driver(native, listing, "s").count() == 2


def test_one_join_gives_what_the_steps_give(spark):
    stamp = lambda d: datetime(2020, 1, d)
    form = "site string, bucket string, name string, status string, creation timestamp_ntz, hash string, size long, metadata map<string,string>"
    statuses = [*m.STATUSES, None, "odd"]
    objects = [("s", "b", f"n{i}-{there}", st, stamp(5 + i % 3), "old", i, {"k": "old"}) for i, st in enumerate(statuses) for there in (True, False)]
    objects += [("z", "b", "n2-True", "UPLOAD", stamp(5), "old", 1, None), (None, "b", "n2-True", "UPLOAD", stamp(5), "old", 1, None), ("s", "c", "n1-True", "UPLOAD", stamp(5), "old", 1, None)]
    listing = [("s", "b", f"n{i}-True", stamp(6), "new", 9 if i % 2 else None, None) for i in range(len(statuses))] + [("s", "b", "n1-True", stamp(2), "older", 8, None), ("s", "b", "extra", stamp(7), "new", 7, {"a": "b"}), ("z", "b", "n2-True", stamp(8), "new", 5, None)]
    objects, listing = spark.createDataFrame(objects, form), spark.createDataFrame(listing, "site string, bucket string, name string, event timestamp_ntz, hash string, size long, metadata map<string,string>")
    start = F.lit(stamp(6)).cast("timestamp_ntz")
    for bucket in (None, "b"):
        fixed, native, states = local.reconcile_local(objects, listing, "s", start, bucket)
        ranked = local.rank_remap(local.with_rank(local.purge_unknown(objects, native, "s", bucket)[0]), "s", start, bucket)
        nothing = spark.createDataFrame([], f"bucket string, name string, db {local.STATE}, driver {local.STATE}")
        by_steps = local.snapshot_driver(local.snapshot_db(nothing, ranked, "s", bucket), listing, "s", bucket)
        latest = listing.where("event <> timestamp_ntz'2020-01-02 00:00:00'")
        want, told = local.refresh_from_driver(local.fix_objects(ranked, by_steps, "s"), local.site_states(by_steps, "s"), latest if bucket is None else latest.where("bucket = 'b'"), "s")
        text = lambda rows: sorted(map(str, (r.asDict(recursive=True) for r in rows.select(*sorted(rows.columns)).collect())))
        assert text(fixed) == text(want) and text(states) == text(told) and text(native) == text(by_steps)
        assert fixed._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1

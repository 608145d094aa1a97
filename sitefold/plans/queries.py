"""One query per operator over the given tables, each with the same result in SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import model as m
from ..functions import predicates as p
from ..operators import central, content, lifecycle, local, mutate, orders, rights
from ..sources import catalog, storage, tables
from .fixtures import Tables, standalone

NOW, START, SITE = datetime(2000, 1, 1), datetime(1996, 1, 1), "site-a"
SITES = ["site0", "site1", "site2", "site3"]
QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: standalone(v) for k, v in ORACLES.items()}


def joined(array: str) -> F.Column:
    return F.array_join(F.array_sort(array), ",").alias(array)


# --- scans, sources, sinks -----------------------------------------------------------------------

query("scan_catalog", "SELECT site, bucket, name, size FROM {f_objects} WHERE status = 'READY' AND size >= 200000")(
    lambda t: t.f_objects.where(p.eq("status", "READY") & p.gte("size", 200000)).select("site", "bucket", "name", "size")
)
query("find_one", "SELECT site, bucket, name, status FROM {f_objects} WHERE bucket = 'bucket-1' AND status = 'READY' ORDER BY name, site LIMIT 1")(
    lambda t: catalog.find_one(t.f_objects.select("site", "bucket", "name", "status"), p.eq("bucket", "bucket-1") & p.eq("status", "READY"), ["name", "site"])
)
query("list_storage", "SELECT * FROM {f_driver} WHERE site = 'site-a' AND bucket = 'bucket-2' AND starts_with(name, 'dir3/') AND event >= TIMESTAMP '1994-01-01 00:00:00' AND event <= TIMESTAMP '1997-01-01 00:00:00'")(
    lambda t: catalog.list_storage(t.f_driver, SITE, "bucket-2", "dir3/", datetime(1994, 1, 1), datetime(1997, 1, 1))
)
query("count_storage", "SELECT site, bucket, count(*) AS n FROM {f_driver} GROUP BY ALL")(lambda t: catalog.count_storage(t.f_driver))
query("list_storage_buckets", "SELECT DISTINCT site, bucket FROM {f_driver}")(lambda t: catalog.list_storage_buckets(t.f_driver))
LINE = "site string, bucket string, name string, event timestamp_ntz"


def exported(t: Tables, rows: DataFrame) -> str:
    """A folder of compressed JSON lines with the rows."""
    path = f"{_shared(t.spark)}/lines-{uuid4().hex}"
    catalog.export_ndjson(rows, path)
    return path


query("export_ndjson", "SELECT site, count(*) AS n, CAST(sum(length(name)) AS BIGINT) AS letters FROM {f_driver} GROUP BY 1")(
    lambda t: t.spark.read.text(exported(t, t.f_driver)).select(F.get_json_object("value", "$.site").alias("site"), F.length(F.get_json_object("value", "$.name")).alias("n_")).groupBy("site").agg(F.count("*").alias("n"), F.sum("n_").alias("letters"))
)
query("import_ndjson", "SELECT site, bucket, name, event FROM {f_driver}")(lambda t: catalog.import_ndjson(t.spark, exported(t, t.f_driver), LINE))


@query("order_source", "SELECT op_id, bucket_name, object_name, action FROM {f_orders}")
def _(t):
    return _streamed(t, lambda rows: rows.select("op_id", "bucket_name", "object_name", "action"), "append").drop("batch")



@query("order_sink", "SELECT op_id, ts, from_site, to_site, client_id, bucket_name, object_name, action, CAST(1 AS BIGINT) AS copies FROM {f_orders}")
def _(t):
    """Two runs of the file sink with a restart between, read back by its log."""
    from ..streaming import orders as s

    base = f"{_shared(t.spark)}/sink-{uuid4().hex}"
    for _ in arriving(t, base):
        s.write_files(s.read_files(t.spark, f"{base}/in"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    written = s.read_written(t.spark, f"{base}/out")
    return written.groupBy(*t.f_orders.columns).agg(F.count("*").alias("copies"))


@query("drop_request_rows", "SELECT bucket, name, CASE site WHEN 'site-b' THEN 'run-2' ELSE 'run-3' END AS request_id FROM {f_driver} WHERE site <> 'site-a'")
def _(t):
    """Rows of three requests in partitions of their own; one request's partition is dropped."""
    path = f"{_shared(t.spark)}/requests-{uuid4().hex}"
    request = F.when(F.col("site") == SITE, "run-1").when(F.col("site") == "site-b", "run-2").otherwise("run-3")
    tables.save_requests(t.f_driver.select("bucket", "name", request.alias("request_id")), path)
    schema = "bucket string, name string, request_id string"
    tables.drop_request(t.spark, path, "run-1", schema)
    return tables.request_rows(t.spark, path, schema)


@query("replace_request", "SELECT bucket, name, CASE WHEN site = 'site-a' THEN 'run-1' ELSE 'run-2' END AS request_id FROM {f_driver} WHERE site <> 'site-b'")
def _(t):
    """Site b's rows of run-2 are overwritten with site c's; run-1 stays as it is."""
    path = f"{_shared(t.spark)}/requests-{uuid4().hex}"
    rows = lambda where, request: t.f_driver.where(where).select("bucket", "name", F.lit(request).alias("request_id"))
    tables.save_requests(rows("site = 'site-a'", "run-1").unionByName(rows("site = 'site-b'", "run-2")), path)
    tables.replace_request(rows("site = 'site-c'", "run-2"), path)
    return tables.request_rows(t.spark, path, "bucket string, name string, request_id string")


def stored(t: Tables) -> str:
    """A store that holds the contents as objects, in a bucket for each language."""
    root = f"{_shared(t.spark)}/store-{uuid4().hex}"
    storage.store_objects(t.f_content.select("bucket", "name", F.col("text").alias("content")), root).agg(F.sum("size")).collect()
    return root


query("list_stored", "SELECT bucket, name, CAST(strlen(text) AS BIGINT) AS size FROM {f_content} WHERE bucket = 'en' AND starts_with(name, 'src1')")(
    lambda t: storage.stored_objects(t.spark, stored(t)).where("bucket = 'en' and startswith(name, 'src1') and event >= timestamp_ntz'2000-01-01 00:00:00'").select("bucket", "name", "size")
)
query("list_stored_all", "SELECT bucket, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM {f_content} GROUP BY 1")(
    lambda t: storage.stored_objects(t.spark, stored(t)).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
)
query("stored_manifest", "SELECT bucket, name, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM {f_content}")(
    lambda t: storage.file_manifest(t.f_content.select("bucket", "name"), stored(t), ("MD5", "SHA1", "SHA256"))
)
query("stored_fixity", "SELECT bucket, count(*) AS n, count(*) FILTER (md5(text) <> stored_hash) AS bad_hash, count(*) FILTER (strlen(text) <> n_chars) AS bad_size, CAST(0 AS BIGINT) AS missing FROM {f_content} GROUP BY 1")(
    lambda t: storage.stored_fixity(t.f_content.select("bucket", "name", "stored_hash", F.col("n_chars").alias("stored_size")), stored(t))
)

# --- predicates ----------------------------------------------------------------------------------

ROW = ["site", "bucket", "name"]


def predicate(name: str, sql: str, condition, on: Callable[[Tables], DataFrame] = lambda t: t.objects):
    query(name, f"SELECT site, bucket, name FROM {{f_objects}} WHERE {sql}")(lambda t: on(t).where(condition()).select(*ROW))


def tagged(t: Tables) -> DataFrame:
    """Objects with an array: bucket, status and priority."""
    return t.f_objects.withColumn("tags", F.array("bucket", "status", "md_priority"))


predicate("pred_eq", "status = 'ERR_UPL'", lambda: p.eq("status", "ERR_UPL"))
predicate("pred_neq", "expires <> TIMESTAMP '1996-01-02 00:00:00'", lambda: p.neq("expires", datetime(1996, 1, 2)))
predicate("pred_gte", "size >= 250000", lambda: p.gte("size", 250000))
predicate("pred_lte", "creation <= TIMESTAMP '1996-01-01 00:00:00'", lambda: p.lte("creation", datetime(1996, 1, 1)))
predicate("pred_start_with", "starts_with(name, 'dir7/object_1')", lambda: p.start_with("name", "dir7/object_1"))
predicate("pred_json_eq", "md_priority = '1-URGENT'", lambda: p.json_eq("metadata", "priority", "1-URGENT"))
predicate("pred_json_neq", "md_priority <> '1-URGENT'", lambda: p.json_neq("metadata", "priority", "1-URGENT"))
predicate("pred_contains", "bucket = 'bucket-1' AND status = 'READY'", lambda: p.contains("tags", ["bucket-1", "READY"]), tagged)
predicate("pred_contained", "bucket IN ('bucket-1', 'bucket-2') AND status = 'READY' AND md_priority = '5-LOW'", lambda: p.contained("tags", ["bucket-1", "bucket-2", "READY", "5-LOW"]), tagged)
predicate("pred_any", "bucket = 'bucket-3' AND md_priority = '5-LOW'", lambda: p.any_of("tags", ["bucket-3", "5-LOW"]), tagged)
predicate("pred_in", "status IN ('UPLOAD', 'DELETING')", lambda: p.is_in("status", ["UPLOAD", "DELETING"]))
predicate("pred_and", "site = 'site-b' AND size <= 50000", lambda: p.all_of([p.eq("site", "site-b"), p.lte("size", 50000)]))
predicate("pred_or", "status = 'ERR_DEL' OR size >= 300000", lambda: p.one_of([p.eq("status", "ERR_DEL"), p.gte("size", 300000)]))
predicate("pred_not", "NOT (site = 'site-a' AND status = 'READY')", lambda: p.none_of_all([p.eq("site", SITE), p.eq("status", "READY")]))
TREE = {
    "conjunction": "AND",
    "restQueries": [
        {"query": "START_WITH", "fieldName": "name", "svalue": "dir1/"},
        {"conjunction": "OR", "restQueries": [{"query": "IN", "fieldName": "status", "avalues": ["UPLOAD", "READY"]}, {"query": "GTE", "fieldName": "size", "ovalue": 200000}]},
        {"conjunction": "NOT", "restQueries": [{"query": "JSON_EQ", "fieldName": "metadata", "avalues": ["priority", "2-HIGH"]}]},
    ],
}
predicate("pred_from_json", "starts_with(name, 'dir1/') AND (status IN ('UPLOAD', 'READY') OR size >= 200000) AND NOT md_priority = '2-HIGH'", lambda: p.from_json(TREE))
FILTER = p.ObjectFilter("dir", ("READY", "UPLOAD"), datetime(1998, 1, 1), datetime(1992, 6, 1), datetime(1998, 6, 1), datetime(1993, 1, 1), 300000, 20000, {"priority": "3-MEDIUM"})
_SIZES = "starts_with(name, 'dir') AND size <= 300000 AND size >= 20000 AND md_priority = '3-MEDIUM'"
predicate(
    "object_filter",
    _SIZES + " AND status IN ('READY', 'UPLOAD') AND creation <= TIMESTAMP '1998-01-01' AND creation >= TIMESTAMP '1992-06-01' AND expires <= TIMESTAMP '1998-06-01' AND expires >= TIMESTAMP '1993-01-01'",
    lambda: FILTER.on_catalog(),
)
predicate(
    "filter_storage",
    _SIZES + " AND (creation IS NULL OR creation BETWEEN TIMESTAMP '1992-06-01' AND TIMESTAMP '1998-01-01') AND (expires IS NULL OR expires BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1998-06-01')",
    lambda: FILTER.on_storage(),
)
_OWNED = "(SELECT bucket FROM {f_ownership} WHERE client = 'client-10' GROUP BY bucket HAVING (bit_or(code) & 1) = 1)"
query("list_objects", f"SELECT site, bucket, name FROM {{f_objects}} WHERE bucket = 'bucket-1' AND status = 'READY' AND bucket IN {_OWNED}")(
    lambda t: catalog.list_objects(t.objects, t.f_ownership, "client-10", "bucket-1", p.ObjectFilter(statuses=["READY"]).on_catalog(), m.READ).select(*ROW)
)
predicate("list_by_prefix", "site = 'site-a' AND bucket = 'bucket-0' AND starts_with(name, 'dir4/') AND status = 'READY'", lambda: p.eq("site", SITE) & p.eq("bucket", "bucket-0") & p.start_with("name", "dir4/") & p.eq("status", "READY"))
_PATHS = "SELECT site, bucket, CASE WHEN size % 3 = 0 THEN name WHEN size % 3 = 1 THEN regexp_replace(name, '/.*', '/') ELSE concat(name, 'x') END AS path FROM {f_objects} WHERE site = 'site-a'"
query(
    "classify_path",
    f"""SELECT q.site, q.bucket, q.path, CASE WHEN EXISTS (SELECT 1 FROM {{f_objects}} o WHERE o.site = q.site AND o.bucket = q.bucket AND o.name = q.path) THEN 'OBJECT'
 WHEN right(q.path, 1) = '/' AND EXISTS (SELECT 1 FROM {{f_objects}} o WHERE o.site = q.site AND o.bucket = q.bucket AND regexp_replace(o.name, '/.*', '/') = q.path) THEN 'DIRECTORY' ELSE 'NONE' END AS kind FROM ({_PATHS}) q""",
)(lambda t: catalog.classify_paths(t.spark.sql(_PATHS, f_objects=t.f_objects), t.f_objects))
query("project_native", "SELECT bucket, name, db_rank AS nstatus, db_event AS event FROM {o_native} WHERE side <> 'driver_only'")(
    lambda t: local.db_states(started(t), SITE).select("bucket", "name", "db.nstatus", "db.event")
)

# --- changes and merges --------------------------------------------------------------------------

def ready_here():
    return p.eq("site", SITE) & p.eq("status", "READY")


query("count_where", "SELECT count(*) AS n FROM {f_objects} WHERE site = 'site-a' AND status = 'READY'")(lambda t: mutate.count_where(t.f_objects, ready_here()))
query("count_all", "SELECT count(*) AS n FROM {f_objects}")(lambda t: mutate.count_where(t.f_objects))
query("delete_where", "SELECT site, bucket, name FROM {f_objects} WHERE NOT coalesce(expires <= TIMESTAMP '1996-01-01', false)")(
    lambda t: mutate.delete_where(t.f_objects, p.lte("expires", datetime(1996, 1, 1))).select(*ROW)
)
query("update_set", "SELECT site, bucket, name, CASE WHEN site = 'site-a' AND status = 'READY' THEN 'DELETED' ELSE status END AS status, CASE WHEN site = 'site-a' AND status = 'READY' THEN 0 ELSE size END AS size FROM {f_objects}")(
    lambda t: mutate.update_set(t.f_objects, ready_here(), {"status": F.lit("DELETED"), "size": F.lit(0).cast("long")}).select(*ROW, "status", "size")
)
query("update_add_to_set", "SELECT site, bucket, name, CASE WHEN status = 'READY' THEN concat(bucket, ',', status) ELSE concat(bucket, ',', status, ',READY') END AS tags FROM {f_objects}")(
    lambda t: mutate.add_to_set(t.f_objects.select(*ROW, F.array("bucket", "status").alias("tags")), "tags", F.lit("READY")).select(*ROW, F.array_join("tags", ",").alias("tags"))
)
query("update_set_array", "SELECT site, bucket, name, concat(bucket, ',', status, ',READY') AS tags FROM {f_objects}")(
    lambda t: mutate.set_array(t.f_objects.select(*ROW, F.array("bucket", "status").alias("tags")), "tags", F.col("tags"), F.lit("READY")).select(*ROW, F.array_join("tags", ",").alias("tags"))
)


def incoming(t: Tables) -> DataFrame:
    """Site b's rows as new values for site a."""
    return t.f_objects.where("site = 'site-b'").select(F.lit(SITE).alias("site"), "bucket", "name", "status", "size")


def existing(t: Tables) -> DataFrame:
    return t.f_objects.where("site = 'site-a'").select("site", "bucket", "name", "status", "size")


_NEW = "(SELECT 'site-a' AS site, bucket, name, status, size FROM {f_objects} WHERE site = 'site-b')"
_OLD = "(SELECT site, bucket, name, status, size FROM {f_objects} WHERE site = 'site-a')"
query("update_if_changed", f"SELECT o.site, o.bucket, o.name, coalesce(n.status, o.status) AS status, coalesce(n.size, o.size) AS size, n.name IS NOT NULL AND (n.status <> o.status OR n.size <> o.size) AS changed FROM {_OLD} o LEFT JOIN {_NEW} n ON o.bucket = n.bucket AND o.name = n.name")(
    lambda t: mutate.update_if_changed(existing(t), incoming(t), m.SITE_KEY)
)


@query("update_status", f"SELECT o.site, o.bucket, o.name, coalesce(n.status, o.status) AS status FROM {_OLD} o LEFT JOIN {_NEW} n ON o.bucket = n.bucket AND o.name = n.name")
def _(t):
    changes = incoming(t).select(*ROW, F.col("status").alias("new_status"), F.lit(None).cast("timestamp_ntz").alias("new_creation"))
    target = t.f_objects.where("site = 'site-a'").select(*ROW, "status", "creation")
    return mutate.update_status(target, changes, m.SITE_KEY)[0].select(*ROW, "status")


query("merge_keep_existing", f"SELECT * FROM {_OLD} o UNION ALL SELECT * FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM {_OLD} o WHERE o.bucket = n.bucket AND o.name = n.name)")(
    lambda t: mutate.keep_existing(existing(t), incoming(t), m.SITE_KEY)
)
query("merge_or_discard", f"SELECT o.site, o.bucket, o.name, coalesce(n.status, o.status) AS status, o.size FROM {_OLD} o LEFT JOIN {_NEW} n ON o.bucket = n.bucket AND o.name = n.name")(
    lambda t: mutate.merge_or_discard(existing(t), incoming(t), m.SITE_KEY, ["status"])
)


@query("merge_bucketed", f"SELECT o.site, o.bucket, o.name, coalesce(n.status, o.status) AS status, o.size FROM {_OLD} o LEFT JOIN {_NEW} n ON o.bucket = n.bucket AND o.name = n.name")
def _(t):
    """The catalog lies bucketed by its key; a merge writes its next version."""
    kept = tables.BucketedCatalog(t.spark, f"catalog_{uuid4().hex}", f"{_shared(t.spark)}/catalog-{uuid4().hex}", m.SITE_KEY, 8)
    kept.save(existing(t))
    kept.merge(lambda old, new: mutate.merge_or_discard(old, new, m.SITE_KEY, ["status"], once=True), incoming(t))
    return kept.rows()


query("merge_replace", f"SELECT * FROM {_NEW} n UNION ALL SELECT * FROM {_OLD} o WHERE NOT EXISTS (SELECT 1 FROM {_NEW} n WHERE o.bucket = n.bucket AND o.name = n.name)")(
    lambda t: mutate.replace(existing(t), incoming(t), m.SITE_KEY)
)
query("merge_concat_array", f"SELECT coalesce(o.site, n.site) AS site, coalesce(o.bucket, n.bucket) AS bucket, coalesce(o.name, n.name) AS name, concat_ws(',', o.status, n.status) AS tags FROM {_OLD} o FULL JOIN {_NEW} n ON o.bucket = n.bucket AND o.name = n.name")(
    lambda t: mutate.concat_array(
        existing(t).withColumn("tags", F.array("status")), incoming(t).withColumn("tags", F.array("status")), m.SITE_KEY, "tags"
    ).select(*ROW, F.array_join("tags", ",").alias("tags"))
)


def started(t: Tables) -> DataFrame:
    """The catalog after the first steps of site a's run."""
    kept = mutate.delete_where(t.f_objects, p.eq("site", SITE) & p.eq("status", "UNKNOWN"))
    return local.rank_remap(local.with_rank(kept), SITE, F.lit(START).cast("timestamp_ntz"))


def empty_native(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([], f"bucket string, name string, db {local.STATE}, driver {local.STATE}")


def snapped(t: Tables) -> DataFrame:
    """Native rows of a run that has listed the storage alone."""
    return local.snapshot_driver(empty_native(t), t.f_driver, SITE)


def native_of(t: Tables) -> DataFrame:
    states = local.db_states(started(t), SITE)
    listed = local.snapshot_driver(states.withColumn("driver", F.lit(None).cast(local.STATE)), t.f_driver, SITE)
    return listed


def flat(native: DataFrame) -> DataFrame:
    return native.select("bucket", "name", F.col("db.nstatus").alias("db_rank"), F.col("db.event").alias("db_event"), F.col("driver.event").alias("driver_event"))


query("merge_null_out", "SELECT bucket, name, db_rank, db_event, CASE WHEN NOT coalesce(db_rank IN (4,5,6), false) THEN driver_event END AS driver_event FROM {o_native}")(
    lambda t: flat(local.snapshot_db(local.snapshot_driver(empty_native(t), t.f_driver, SITE), started(t), SITE))
)

# --- one site ------------------------------------------------------------------------------------

query("purge_unknown", "SELECT site, bucket, name, status FROM {f_objects} WHERE NOT (site = 'site-a' AND status = 'UNKNOWN')")(
    lambda t: local.purge_unknown(t.f_objects, snapped(t), SITE)[0].select(*ROW, "status")
)
query(
    "purge_unknown_native",
    "SELECT d.bucket, d.name, d.event AS driver_event FROM {f_driver} d WHERE d.site = 'site-a' AND NOT EXISTS (SELECT 1 FROM {f_objects} o WHERE o.site = 'site-a' AND o.status = 'UNKNOWN' AND o.bucket = d.bucket AND o.name = d.name)",
)(lambda t: local.purge_unknown(t.f_objects, snapped(t), SITE)[1].select("bucket", "name", F.col("driver.event").alias("driver_event")))
query("status_rank", "SELECT site, bucket, name, rank AS rstatus FROM {o_ranked}")(lambda t: local.with_rank(t.f_objects).select(*ROW, "rstatus"))
query("rank_remap", "SELECT site, bucket, name, rstatus FROM {o_started}")(lambda t: started(t).select(*ROW, "rstatus"))
query(
    "purge_native_errors",
    "SELECT d.bucket, d.name FROM {f_driver} d WHERE d.site = 'site-a' AND NOT EXISTS (SELECT 1 FROM {f_objects} o WHERE o.site = 'site-a' AND o.bucket = d.bucket AND o.name = d.name AND o.status IN ('UNKNOWN','UPLOAD','ERR_UPL','DELETED','ERR_DEL'))",
)(lambda t: local.purge_native_errors(snapped(t), t.f_objects, SITE).select("bucket", "name"))


def runs(t: Tables) -> DataFrame:
    return t.f_driver.select("bucket", "name", F.when(F.col("site") == SITE, "run-1").otherwise("run-0").alias("request_id"))


_RUNS = "(SELECT bucket, name, CASE WHEN site = 'site-a' THEN 'run-1' ELSE 'run-0' END AS request_id FROM {f_driver})"
query("continue_copy", f"SELECT * FROM {_RUNS} a UNION ALL SELECT bucket, name, 'run-2' FROM {_RUNS} b WHERE request_id = 'run-1'")(lambda t: local.continue_copy(runs(t), "run-1", "run-2"))
query("continue_replace", f"SELECT bucket, name, CASE WHEN request_id = 'run-1' THEN 'run-2' ELSE request_id END AS request_id FROM {_RUNS} a")(lambda t: local.continue_replace(runs(t), "run-1", "run-2"))
query("assign_ids", "SELECT bucket, count(*) AS n, count(*) AS n_ids, 36 * count(*) AS letters FROM {f_driver} GROUP BY 1")(  # the ids themselves are random
    lambda t: local.assign_ids(t.f_driver.select("bucket", "name")).groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.sum(F.length("id")).alias("letters"))
)
query("snapshot_db", "SELECT bucket, name, db_rank, db_event, CAST(NULL AS TIMESTAMP) AS driver_event FROM {o_native} WHERE side <> 'driver_only'")(
    lambda t: flat(local.snapshot_db(empty_native(t), started(t), SITE))
)
query("snapshot_driver", "SELECT bucket, name, db_rank, db_event, driver_event FROM {o_native}")(lambda t: flat(native_of(t)))
query(
    "compare_sides",
    "SELECT CASE WHEN d.name IS NULL THEN 'db_only' WHEN o.name IS NULL THEN 'driver_only' ELSE 'both' END AS side, o.status, count(*) AS n FROM (SELECT * FROM {f_objects} WHERE site = 'site-a') o FULL JOIN (SELECT * FROM {f_driver} WHERE site = 'site-a') d ON o.bucket = d.bucket AND o.name = d.name GROUP BY 1, 2",
)(lambda t: local.compare_sides(t.f_objects.where(F.col("site") == SITE), t.f_driver.where(F.col("site") == SITE)).groupBy("side", "status").agg(F.count("*").alias("n")))


def fix(name: str, f, side: str, ranks: str, status: str, rank: int) -> None:
    hit = f"EXISTS (SELECT 1 FROM {{o_native}} n WHERE s.site = 'site-a' AND n.bucket = s.bucket AND n.name = s.name AND n.side = '{side}' AND n.db_rank IN ({ranks}))"
    query(name, f"SELECT site, bucket, name, CASE WHEN {hit} THEN '{status}' ELSE status END AS status, CASE WHEN {hit} THEN {rank} ELSE rstatus END AS rstatus FROM {{o_started}} s")(
        lambda t: f(started(t), native_of(t), SITE).select(*ROW, "status", "rstatus")
    )


query(
    "fix_missing_db",
    "SELECT site, bucket, name, status, rstatus, creation FROM {o_started} UNION ALL SELECT 'site-a', bucket, name, 'READY', 7, driver_event FROM {o_native} WHERE side = 'driver_only'",
)(lambda t: local.fix_missing_db(started(t), native_of(t), SITE).select(*ROW, "status", "rstatus", "creation"))
fix("fix_db_only_upload", local.fix_db_only_upload, "db_only", "1,2,3,7", "UPLOAD", 7)
fix("fix_db_only_deleted", local.fix_db_only_deleted, "db_only", "4,5,6", "DELETED", 5)
fix("fix_both_ready", local.fix_both_ready, "both", "1,3,7", "READY", 7)
fix("fix_both_deleting", local.fix_both_deleting, "both", "4,5,6", "DELETING", 4)
for _side in ("driver_only", "db_only", "both"):
    query(f"site_state_{_side}", f"SELECT bucket, name, 'site-a' AS site, event, nstatus FROM {{o_states}} WHERE side = '{_side}'")(
        lambda t, f=getattr(local, f"site_states_{_side}"): f(native_of(t), SITE)
    )
query("latest_event", "SELECT bucket, name, CASE WHEN driver_event IS NULL OR db_event >= driver_event THEN db_event ELSE driver_event END AS event FROM {o_native}")(
    lambda t: native_of(t).select("bucket", "name", local.latest_event().alias("event"))
)
query(
    "refresh_from_driver",
    "SELECT s.bucket, s.name, CASE WHEN s.nstatus = 11 AND d.name IS NOT NULL THEN 10 ELSE s.nstatus END AS nstatus, s.event FROM {o_states} s LEFT JOIN (SELECT * FROM {f_driver} WHERE site = 'site-a') d ON s.bucket = d.bucket AND s.name = d.name",
)(lambda t: local.refresh_from_driver(started(t), local.site_states(native_of(t), SITE), t.f_driver, SITE)[1].select("bucket", "name", "nstatus", "event"))
query(
    "refresh_native",
    "SELECT bucket, name, CASE WHEN side = 'driver_only' OR side = 'both' AND db_rank IN (1,3,7) THEN 2 ELSE db_rank END AS db_rank, CASE WHEN side = 'driver_only' OR side = 'both' AND db_rank IN (1,3,7) THEN driver_event ELSE db_event END AS db_event, driver_event FROM {o_native}",
)(lambda t: flat(local.refresh_native(native_of(t))))
_STORED = "SELECT *, md5(concat(name, '!')) AS hash, CAST(length(name) AS BIGINT) AS size, event + INTERVAL '30' DAY AS expires FROM {f_driver}"
query(
    "refresh_objects",
    f"""SELECT s.site, s.bucket, s.name, CASE WHEN d.name IS NULL THEN s.status ELSE 'READY' END AS status, CASE WHEN d.name IS NULL THEN s.rstatus ELSE 2 END AS rstatus, coalesce(d.event, s.creation) AS creation, coalesce(d.hash, s.hash) AS hash, coalesce(d.size, s.size) AS size, coalesce(d.expires, s.expires) AS expires
FROM {{o_started}} s LEFT JOIN (SELECT l.* FROM ({_STORED}) l JOIN {{o_states}} x ON x.bucket = l.bucket AND x.name = l.name AND x.nstatus = 11 WHERE l.site = 'site-a') d ON d.site = s.site AND d.bucket = s.bucket AND d.name = s.name""",
)(
    lambda t: local.refresh_from_driver(started(t), local.site_states(native_of(t), SITE), t.spark.sql(_STORED, f_driver=t.f_driver), SITE)[0].select(*ROW, "status", "rstatus", "creation", "hash", "size", "expires")
)
query("sites_listing_export", "SELECT bucket, name, 'site-a' AS site, nstatus FROM {o_states}")(
    lambda t: catalog.from_json_lines(catalog.to_json_lines(local.site_states(native_of(t), SITE)), "bucket string, name string, site string, nstatus int")
)
query("local_counts", "SELECT bucket, count(db_event) AS checked_db, count(driver_event) AS checked_driver, count(*) AS checked FROM {o_native} GROUP BY 1")(lambda t: local.local_counts(native_of(t)))


@query("observed_counts", "SELECT count(db_event) AS checked_db, count(driver_event) AS checked_driver, count(*) AS checked FROM {o_native}")
def _(t):
    """The counts of a run, taken by the job that writes its native rows."""
    seen = Observation("run")
    tables.checked(native_of(t), seen).write.parquet(f"{_shared(t.spark)}/native-{uuid4().hex}")
    return t.spark.createDataFrame([seen.get], "checked_db long, checked_driver long, checked long")


query(
    "reconcile_local",
    """SELECT bucket, nstatus, count(*) AS n FROM (SELECT bucket, CASE WHEN nstatus = 11 THEN 10 ELSE nstatus END AS nstatus FROM {o_states}) x GROUP BY ALL""",
)(lambda t: local.reconcile_local(t.f_objects, t.f_driver, SITE, F.lit(START).cast("timestamp_ntz"))[2].groupBy("bucket", "nstatus").agg(F.count("*").alias("n")))

_FIX = lambda a, b, c, d, e: f"CASE WHEN n.side = 'db_only' AND n.db_rank IN (1,2,3,7) THEN {a} WHEN n.side = 'db_only' AND n.db_rank IN (4,5,6) THEN {b} WHEN n.side = 'both' AND n.db_rank IN (1,3,7) THEN {c} WHEN n.side = 'both' AND n.db_rank IN (4,5,6) THEN {d} ELSE {e} END"
query(
    "reconcile_local_objects",
    f"""SELECT s.site, s.bucket, s.name, {_FIX("'UPLOAD'", "'DELETED'", "'READY'", "'DELETING'", "s.status")} AS status, {_FIX("7", "5", "2", "4", "s.rstatus")} AS rstatus, {_FIX("s.creation", "s.creation", "n.driver_event", "s.creation", "s.creation")} AS creation,
 {_FIX("s.size", "s.size", "length(s.name)", "s.size", "s.size")} AS size FROM {{o_started}} s LEFT JOIN {{o_native}} n ON s.site = 'site-a' AND n.bucket = s.bucket AND n.name = s.name
UNION ALL SELECT 'site-a', bucket, name, 'READY', 2, driver_event, length(name) FROM {{o_native}} WHERE side = 'driver_only'""",
)(lambda t: local.reconcile_local(t.f_objects, t.spark.sql(_STORED, f_driver=t.f_driver), SITE, F.lit(START).cast("timestamp_ntz"))[0].select(*ROW, "status", "rstatus", "creation", "size"))

# --- all sites -----------------------------------------------------------------------------------

query("merge_site_listing", "SELECT name, site, event, nstatus FROM {o_merged}")(lambda t: central.merge_site_listing(t.f_old_listing, t.f_new_listing))
query("sort_states", "SELECT name, site, event, nstatus, CAST(row_number() OVER (PARTITION BY name ORDER BY event DESC, nstatus, site) AS INT) AS place FROM {f_site_listing}")(lambda t: central.sort_states(t.f_site_listing))
query("primary_state", "SELECT name, list(nstatus ORDER BY event DESC, nstatus)[1] AS primary FROM {f_site_listing} GROUP BY name".replace("AS primary", 'AS "primary"'))(lambda t: central.primary_state(t.f_site_listing))
query("missing_sites", "SELECT name, array_to_string(list_sort(list_filter(['site0','site1','site2','site3'], lambda x: NOT list_contains(list(site), x))), ',') AS missing FROM {f_site_listing} GROUP BY name")(
    lambda t: central.missing_sites(t.f_site_listing, SITES).select("name", joined("missing"))
)
query(
    "target_union",
    "SELECT name, array_to_string(list_sort(list_distinct(list_concat(list_filter(['site0','site1','site2','site3'], lambda x: NOT list_contains(list(site), x)), coalesce(list(site) FILTER (nstatus <> 10), [])))), ',') AS targets FROM {f_site_listing} GROUP BY name",
)(
    lambda t: central.missing_sites(t.f_site_listing, SITES)
    .join(t.f_site_listing.groupBy("name").agg(F.collect_set(F.when(F.col("nstatus") != m.READY, F.col("site"))).alias("behind")), "name")
    .select("name", central.target_union(F.col("missing"), F.col("behind")).alias("targets"))
    .select("name", joined("targets"))
)


def actions(t: Tables) -> DataFrame:
    return central.compute_actions(t.f_site_listing, SITES)


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("name", "need_action", F.array_join("need_action_from", ",").alias("need_action_from"), F.array_join("sites", ",").alias("sites"))


_ACT = "SELECT name, need_action, need_action_from, sites FROM {o_actions}"
for _kind, _where in (("delete", "prim IN (1, 2)"), ("ready", "prim IN (10, 11)"), ("upload", "prim = 20 AND need_action = 20"), ("error", "need_action = 30")):
    query(f"action_{_kind}", f"{_ACT} WHERE {_where}")(lambda t, k=_kind: shown(central.actions_of_kind(actions(t), k)))
query("compute_actions", _ACT)(lambda t: shown(actions(t)))
query("count_actions", "SELECT need_action, count(*) AS n FROM {o_actions} GROUP BY 1")(lambda t: central.count_actions(actions(t)))
query(
    "site_progress",
    "SELECT name, array_to_string(list_sort(list(site)), ',') AS context_sites_done, array_to_string(list_sort(list_filter(['site0','site1','site2','site3'], lambda x: NOT list_contains(list(site), x))), ',') AS still_missing FROM {f_site_listing} GROUP BY name",
)(
    lambda t: central.site_progress(
        t.f_site_listing.groupBy("name").agg(F.max("site").alias("current_site"), F.collect_set("site").alias("done")).select(
            "name", "current_site", F.array(*(F.lit(s) for s in SITES)).alias("context_sites"), F.array_except("done", F.array("current_site")).alias("context_sites_done")
        )
    ).select("name", joined("context_sites_done"), joined("still_missing"))
)


def requested(t: Tables) -> DataFrame:
    return central.compute_actions(t.f_request_listing, SITES, ("request_id", "bucket", "name"))


query("actions_of_request", _ACT.replace("o_actions", "o_requests") + " WHERE request_id = 'run-1' AND bucket = 'bucket-2'")(lambda t: shown(central.actions_of_request(requested(t), "run-1", "bucket-2")))
query(
    "request_totals",
    """SELECT l.request_id, checked, checked_states, coalesce(actions, 0) AS actions, coalesce(fetches, 0) AS fetches FROM (SELECT request_id, count(DISTINCT concat(bucket, '/', name)) AS checked, count(*) AS checked_states FROM {f_request_listing} GROUP BY 1) l
LEFT JOIN (SELECT request_id, count(*) AS actions, count(*) FILTER (need_action IN (11, 20)) AS fetches FROM {o_requests} GROUP BY 1) a ON a.request_id = l.request_id""",
)(lambda t: central.request_totals(t.f_request_listing, requested(t)))
query("actions_for_site", f"{_ACT} WHERE list_contains(string_split(sites, ','), 'site2')")(lambda t: shown(central.actions_for_site(actions(t), "site2")))
query("actions_to_orders", "SELECT name, need_action, string_split(need_action_from, ',')[1] AS from_site, unnest(string_split(sites, ',')) AS to_site FROM {o_actions}")(lambda t: central.actions_to_orders(actions(t)))
_PAIRS = "SELECT site, name, CASE size % 5 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'UPLOAD' WHEN 3 THEN 'UPGRADE' ELSE 'ERR_UPL' END AS action, CASE WHEN size % 7 = 0 THEN NULL ELSE status END AS status FROM {f_objects}"
# The published table as rules, written apart from the operator's rows.
_NEED = "CASE WHEN action = 'DELETE' THEN status <> 'DELETED' WHEN action = 'UPDATE' THEN status IN ('UPLOAD', 'READY', 'ERR_UPL', 'ABSENT') WHEN action IN ('UPLOAD', 'UPGRADE') THEN status <> 'READY' ELSE status IN ('UPLOAD', 'ERR_UPL') END AND status <> 'UNKNOWN'"
query(
    "action_outcome",
    f"""SELECT site, name, action, status, valid,
 CASE WHEN valid THEN CASE action WHEN 'DELETE' THEN CASE status WHEN 'ABSENT' THEN 'IGNORE' ELSE 'DELETED' END WHEN 'UPDATE' THEN CASE status WHEN 'ABSENT' THEN 'READY_WITH_UPLOAD' ELSE 'READY_IF_STORED' END WHEN 'ERR_UPL' THEN 'ERR_UPL' ELSE 'READY' END END AS db_status,
 CASE WHEN valid THEN CASE action WHEN 'DELETE' THEN 'DELETE_IF_EXISTS' WHEN 'UPLOAD' THEN 'UPLOAD' WHEN 'UPGRADE' THEN 'UPLOAD_IF_NEEDED' WHEN 'ERR_UPL' THEN 'NOTHING' ELSE CASE status WHEN 'ABSENT' THEN 'UPLOAD' WHEN 'READY' THEN NULL ELSE 'UPLOAD_IF_NEEDED' END END END AS storage_step
FROM (SELECT *, {_NEED} AS valid FROM (SELECT site, name, action, coalesce(status, 'ABSENT') AS status FROM ({_PAIRS}) x) y) z""",
)(lambda t: central.action_outcome(t.spark.sql(_PAIRS, f_objects=t.f_objects)).select("site", "name", "action", "status", "valid", "db_status", "storage_step"))
query("reconcile_central", _ACT.replace("o_actions", "o_central"))(lambda t: shown(central.reconcile_central(t.f_old_listing, t.f_new_listing, SITES)))


@query("stream_central", _ACT.replace("o_actions", "o_central"))
def _(t):
    """Listings of sites as they arrive, a run of the stream for each: the actions that stand in the end."""
    from ..streaming import central as s
    from ..streaming.orders import run_once

    base = f"{_shared(t.spark)}/central-{uuid4().hex}"
    for number, listing in enumerate((t.f_old_listing, t.f_new_listing)):
        rows = listing.select("name", "site", F.lit(number).cast("long").alias("round"), F.col("event").cast("timestamp_ntz").alias("event"), "nstatus")
        rows.write.mode("append").parquet(f"{base}/in")
        run_once(t.spark.readStream.schema(s.LISTED).parquet(f"{base}/in"), s.tables_writer(t.spark, f"{base}/out", SITES), f"{base}/checkpoint")
    return shown(s.latest_actions(t.spark.read.parquet(f"{base}/out/actions")))


query("reconcile_central_actions", "SELECT need_action, count(*) AS n FROM {o_central} GROUP BY 1")(
    lambda t: central.count_actions(central.reconcile_central(t.f_old_listing, t.f_new_listing, SITES))
)
query("merged_states", "SELECT name, count(*) AS n_states, max(event) AS last_event FROM {o_merged} GROUP BY 1")(
    lambda t: central.merge_site_listing(t.f_old_listing, t.f_new_listing).groupBy("name").agg(F.count("*").alias("n_states"), F.max("event").alias("last_event"))
)

# --- life cycle ----------------------------------------------------------------------------------

CLIENT = "client-x"
_MINE = "site = 'site-a' AND bucket IN ('bucket-0', 'bucket-1')"
_GONE = "coalesce(expires <= TIMESTAMP '2000-01-01', false)"
_HIT = f"({_MINE} AND status = 'READY' AND {_GONE})"
_DEAD = f"({_MINE} AND status = 'DELETED' AND {_GONE})"
query("purge_deleted", f"SELECT site, bucket, name FROM {{f_objects}} WHERE NOT {_DEAD}")(lambda t: lifecycle.purge_deleted(t.f_objects, t.f_buckets, t.f_driver, CLIENT, SITE, NOW)[0].select(*ROW))
query("purge_deleted_copies", f"SELECT o.bucket, o.name FROM (SELECT * FROM {{f_objects}} WHERE {_DEAD}) o JOIN {{f_driver}} d ON d.site = o.site AND d.bucket = o.bucket AND d.name = o.name")(
    lambda t: lifecycle.purge_deleted(t.f_objects, t.f_buckets, t.f_driver, CLIENT, SITE, NOW)[1]
)
_AGED = f"SELECT site, bucket, name, CASE WHEN {_HIT} THEN 'DELETED' ELSE status END AS status, CASE WHEN {_HIT} THEN TIMESTAMP '2000-01-01' ELSE creation END AS creation, CASE WHEN {_HIT} THEN TIMESTAMP '2000-01-01 01:00:00' ELSE expires END AS expires FROM {{f_objects}}"
query("expire_ready", _AGED)(lambda t: lifecycle.expire_ready(t.f_objects, t.f_buckets, CLIENT, SITE, NOW, 3600).select(*ROW, "status", "creation", "expires"))
_ARCHIVED = f"SELECT o.site, 'archive' AS bucket, o.name, 'READY' AS status, o.bucket AS from_bucket FROM (SELECT * FROM {{f_objects}} WHERE {_HIT}) o JOIN {{f_driver}} d ON d.site = o.site AND d.bucket = o.bucket AND d.name = o.name"
query("archive_ready", _ARCHIVED)(
    lambda t: lifecycle.archive_ready(t.objects, t.f_buckets, t.f_driver, CLIENT, SITE, NOW, "archive").select(*ROW, "status", F.col("metadata")["archived_from_bucket"].alias("from_bucket"))
)
query("purge_orders", f"SELECT site AS from_site, bucket AS bucket_name, name AS object_name, size, 'DELETE' AS action FROM {{f_objects}} WHERE {_HIT}")(
    lambda t: lifecycle.purge_orders(t.f_objects, t.f_buckets, CLIENT, SITE, NOW).select("from_site", "bucket_name", "object_name", "size", "action")
)
query("purge_run", f"SELECT * FROM (SELECT site, bucket, name, status FROM ({_AGED} WHERE NOT {_DEAD}) a UNION ALL SELECT site, bucket, name, status FROM ({_ARCHIVED}) b) c")(
    lambda t: lifecycle.purge_run(t.objects, t.f_buckets, t.f_driver, CLIENT, SITE, NOW, "archive", 3600).select(*ROW, "status")
)
query(
    "import_storage",
    "SELECT d.site, d.bucket, d.name, 'READY' AS status, d.event AS creation, TIMESTAMP '2000-01-01 01:00:00' AS expires, 'yes' AS imported FROM {f_driver} d WHERE d.site = 'site-a' AND starts_with(d.name, 'dir') AND d.event <= TIMESTAMP '1997-01-01' AND NOT EXISTS (SELECT 1 FROM {f_objects} o WHERE o.site = d.site AND o.bucket = d.bucket AND o.name = d.name)",
)(
    lambda t: lifecycle.import_storage(t.f_objects, t.f_driver, SITE, NOW, "dir", before=datetime(1997, 1, 1), seconds=3600, defaults={"imported": "yes"}).select(
        *ROW, "status", "creation", "expires", F.col("metadata")["imported"].alias("imported")
    )
)
query("import_bucket", "SELECT id, client_id, site, status FROM {f_known_buckets} UNION ALL SELECT DISTINCT bucket, 'client-y', site, 'READY' FROM {f_driver} WHERE bucket = 'bucket-2'")(
    lambda t: lifecycle.import_bucket(t.f_known_buckets, t.f_driver.select(F.col("bucket").alias("id"), F.lit("client-y").alias("client_id"), "site").distinct())
)
query("sync_site", "SELECT bucket, name, 20 AS need_action, 'site-a' AS need_action_from, 'site-z' AS sites FROM {f_objects} WHERE site = 'site-a' AND bucket = 'bucket-1' AND status = 'READY' AND starts_with(name, 'dir5/')")(
    lambda t: lifecycle.sync_site(t.f_objects, t.f_buckets, SITE, "bucket-1", "site-z", p.start_with("name", "dir5/")).select("bucket", "name", "need_action", joined("need_action_from"), joined("sites"))
)
query("copy_objects", "SELECT site, 'copies' AS bucket, concat(name, '.bak') AS name, status, size FROM {f_objects} WHERE bucket = 'bucket-2' AND status = 'READY'")(
    lambda t: lifecycle.copy_objects(t.f_objects, t.f_objects.where("bucket = 'bucket-2' and status = 'READY'").select(*ROW, F.lit("copies").alias("to_bucket"), F.concat("name", F.lit(".bak")).alias("to_name")))[0].select(*ROW, "status", "size")
)


def buffered(t: Tables) -> DataFrame:
    return t.f_objects.groupBy("bucket", "name").agg(F.max("size").alias("length"), (F.max("size") % 5 != 0).alias("has_content"), F.max("creation").alias("modified"), (F.max("size") % 2 == 0).alias("is_metadata"))


_BUF = "(SELECT bucket, name, max(size) AS length, max(size) % 5 <> 0 AS has_content, max(creation) AS modified, max(size) % 2 = 0 AS is_metadata FROM {f_objects} GROUP BY 1, 2)"
query(
    "buffer_retry",
    f"""SELECT i.bucket, i.name, CASE WHEN o.status IS NULL OR o.status <> 'READY' THEN 'drop_not_ready' WHEN i.bucket = 'bucket-3' THEN 'error_bucket_gone' WHEN d.name IS NOT NULL THEN 'drop_stored' WHEN NOT i.has_content THEN 'error_content_gone' ELSE 'retry' END AS decision
FROM {_BUF} i LEFT JOIN (SELECT * FROM {{f_objects}} WHERE site = 'site-a') o ON o.bucket = i.bucket AND o.name = i.name LEFT JOIN (SELECT * FROM {{f_driver}} WHERE site = 'site-a') d ON d.bucket = i.bucket AND d.name = i.name""",
)(lambda t: lifecycle.buffer_retry(buffered(t), t.f_objects, t.f_buckets, t.f_driver, SITE).select("bucket", "name", "decision"))
query("buffer_cleanup", f"SELECT bucket, name FROM {_BUF} i WHERE modified < TIMESTAMP '1995-06-01'")(lambda t: lifecycle.buffer_cleanup(buffered(t), datetime(1995, 6, 1)).select("bucket", "name"))
query("buffer_stats", f"SELECT count(*) FILTER (NOT is_metadata) AS items, CAST(coalesce(sum(length) FILTER (NOT is_metadata), 0) AS BIGINT) AS bytes FROM {_BUF} i")(lambda t: lifecycle.buffer_stats(buffered(t)))

# --- orders --------------------------------------------------------------------------------------

query("emit_orders", "SELECT site AS from_site, bucket AS bucket_name, name AS object_name, CASE status WHEN 'READY' THEN 'CREATE' ELSE 'DELETE' END AS action FROM {f_objects} WHERE site = 'site-a' AND status IN ('READY', 'DELETED')")(
    lambda t: orders.emit_orders(t.f_objects.where(F.col("site") == SITE), SITE, CLIENT).select("from_site", "bucket_name", "object_name", "action")
)
_UP = "(SELECT id FROM {f_topology} WHERE status = 'UP')"
_ROUTED = f"SELECT o.op_id, o.ts, o.from_site, u.id AS to_site, o.client_id, o.bucket_name, o.object_name, o.action FROM {{f_orders}} o JOIN {_UP} u ON u.id <> o.from_site AND (o.to_site IS NULL OR o.to_site = u.id)"
query("fan_out_orders", _ROUTED)(lambda t: orders.fan_out_orders(t.f_orders, t.f_topology)[0])
query("unroutable_orders", f"SELECT op_id, from_site, to_site FROM {{f_orders}} WHERE to_site IS NOT NULL AND (to_site = from_site OR to_site NOT IN {_UP})")(
    lambda t: orders.fan_out_orders(t.f_orders, t.f_topology)[1].select("op_id", "from_site", "to_site")
)


@query("group_orders", f"SELECT to_site, count(*) AS n, count(*) FILTER (action = 'CREATE') AS n_create, count(*) FILTER (action = 'DELETE') AS n_delete FROM ({_ROUTED}) r GROUP BY 1")
def _(t):
    """Written to a folder for each target, and counted from there."""
    from ..streaming.orders import ORDER

    path = f"{_shared(t.spark)}/targets-{uuid4().hex}"
    orders.write_by_target(orders.fan_out_orders(t.f_orders, t.f_topology)[0], path)
    return orders.group_orders(orders.read_by_target(t.spark, path, ORDER))


query("dedup_orders", "SELECT min(op_id) AS op_id, min(ts) AS ts, from_site, to_site, client_id, bucket_name, object_name, action FROM {f_orders} GROUP BY ALL")(lambda t: orders.dedup_orders(t.f_orders))
_CLASS = "SELECT op_id, CASE WHEN coalesce(object_name, '') = '' THEN 'bucket' ELSE 'object' END AS kind, CASE WHEN action IN ('CREATE','DELETE') THEN lower(action) ELSE 'other' END AS step FROM {f_orders}"
query("classify_orders", _CLASS)(lambda t: orders.classify_orders(t.f_orders).select("op_id", "kind", "step"))
query(
    "order_checks",
    """SELECT o.op_id, CASE WHEN action NOT IN ('CREATE','DELETE') THEN 'unknown_action' WHEN code IS NULL THEN 'not_owner' WHEN (code & CASE WHEN action = 'DELETE' THEN 4 ELSE 2 END) = 0 THEN 'right' END AS rejected
FROM {f_orders} o LEFT JOIN (SELECT client, bucket, bit_or(code) AS code FROM {f_ownership} GROUP BY 1, 2) r ON r.client = o.client_id AND r.bucket = o.bucket_name""",
)(lambda t: orders.order_checks(t.f_orders, t.f_ownership).select("op_id", "rejected"))


def wanted_buckets(t: Tables) -> DataFrame:
    return t.f_orders.where("object_name is null").select("op_id", "client_id", "bucket_name")


def own_buckets(t: Tables) -> DataFrame:
    return t.f_known_buckets.where("site = 'site-a'")


query("apply_create_bucket", "SELECT op_id, bucket_name, CASE WHEN b.id IS NULL OR b.status = 'DELETED' THEN 'READY' ELSE 'ALREADY_EXIST' END AS outcome FROM {f_orders} LEFT JOIN (SELECT * FROM {f_known_buckets} WHERE site = 'site-a') b ON b.id = bucket_name WHERE object_name IS NULL")(
    lambda t: orders.apply_create_bucket(wanted_buckets(t), own_buckets(t)).select("op_id", "bucket_name", "outcome")
)
_OWN = "(SELECT * FROM {f_known_buckets} WHERE site = 'site-a')"
query(
    "apply_delete_bucket",
    f"""SELECT op_id, bucket_name, CASE WHEN b.id IS NULL THEN 'NOT_EXIST' WHEN b.client_id <> CASE WHEN op_id % 3 = 0 THEN 'client-x' ELSE 'client-y' END THEN 'NOT_ALLOWED' WHEN b.status = 'DELETED' THEN 'ALREADY_DELETED' WHEN b.status <> 'READY' THEN 'BAD_STATUS'
 WHEN EXISTS (SELECT 1 FROM {{f_targets}} x WHERE x.bucket = bucket_name AND x.status = 'READY') THEN 'NOT_EMPTY' ELSE 'DELETED' END AS outcome FROM {{f_orders}} LEFT JOIN {_OWN} b ON b.id = bucket_name WHERE object_name IS NULL""",
)(
    lambda t: orders.apply_delete_bucket(
        wanted_buckets(t).withColumn("client_id", F.when(F.col("op_id") % 3 == 0, "client-x").otherwise("client-y")), own_buckets(t), t.f_targets
    ).select("op_id", "bucket_name", "outcome")
)


def wanted_objects(t: Tables) -> DataFrame:
    return t.f_orders.where("object_name is not null").select("op_id", "bucket_name", "object_name")


_WANT = "FROM {f_orders} o LEFT JOIN {f_targets} x ON x.bucket = o.bucket_name AND x.name = o.object_name WHERE o.object_name IS NOT NULL"
query("apply_create_object", f"SELECT op_id, CASE WHEN bucket_name NOT IN (SELECT id FROM {_OWN} b WHERE b.status = 'READY') THEN 'NO_BUCKET' WHEN status IS NULL OR status = 'DELETED' THEN 'READY' WHEN status = 'UPLOAD' THEN 'NOT_ACCEPTABLE' ELSE 'ALREADY_EXIST' END AS outcome {_WANT}")(
    lambda t: orders.apply_create_object(wanted_objects(t), own_buckets(t), t.f_targets).select("op_id", "outcome")
)
query("apply_delete_object", f"SELECT op_id, CASE WHEN status IS NULL THEN 'NOT_EXIST' WHEN status = 'READY' THEN 'DELETED' WHEN status = 'DELETED' THEN 'ALREADY_DELETED' ELSE 'BAD_STATUS' END AS outcome {_WANT}")(
    lambda t: orders.apply_delete_object(wanted_objects(t), t.f_targets).select("op_id", "outcome")
)
_FOLD = """(SELECT bucket_name, object_name, status AS start, action, ts, op_id, status NOT IN ('READY','DELETED') AS stuck, lag(action) OVER (PARTITION BY bucket_name, object_name ORDER BY ts, op_id) AS before
 FROM (SELECT o.*, x.status FROM {f_orders} o LEFT JOIN {f_targets} x ON x.bucket = o.bucket_name AND x.name = o.object_name WHERE o.object_name IS NOT NULL AND action IN ('CREATE','DELETE')) y)"""
FOLDED = f"""SELECT bucket_name, object_name, CASE WHEN bool_or(coalesce(stuck, false)) THEN any_value(start) WHEN list(action ORDER BY ts DESC, op_id DESC)[1] = 'CREATE' THEN 'READY' WHEN any_value(start) IS NOT NULL OR bool_or(action = 'CREATE') THEN 'DELETED' END AS final_status,
 count(*) FILTER (coalesce(stuck, false) OR (action = 'CREATE') = coalesce(before = 'CREATE', start = 'READY', false)) AS errors FROM {_FOLD} f GROUP BY 1, 2"""
query("fold_orders", FOLDED)(lambda t: orders.fold_orders(t.f_orders, t.f_targets))
query("order_counters", f"SELECT kind, CASE WHEN op_id % 10 = 0 THEN 'error' WHEN step = 'create' THEN 'created' WHEN step = 'delete' THEN 'deleted' ELSE 'error' END AS tag, count(*) AS n FROM ({_CLASS}) c GROUP BY 1, 2")(
    lambda t: orders.order_counters(orders.classify_orders(t.f_orders).withColumn("failed", F.col("op_id") % 10 == 0))
)
_ELSEWHERE = "site IN (SELECT id FROM {f_sites_up} WHERE status = 'UP' AND id <> 'site-a') AND status = 'READY'"
query("locate_remote", f"SELECT bucket, name, min(site) AS remote FROM {{f_objects}} WHERE {_ELSEWHERE} GROUP BY 1, 2")(
    lambda t: orders.locate_remote(t.f_objects.where("status = 'READY'").select(*ROW), t.f_sites_up, SITE)
)
_LOST = "NOT EXISTS (SELECT 1 FROM {f_objects} a WHERE a.site = 'site-a' AND a.bucket = o.bucket AND a.name = o.name)"
query("fix_on_absent", f"SELECT min(site) AS from_site, 'site-a' AS to_site, bucket AS bucket_name, name AS object_name, 'CREATE' AS action FROM {{f_objects}} o WHERE {_ELSEWHERE} AND {_LOST} GROUP BY bucket, name")(
    lambda t: orders.fix_on_absent(t.f_objects, t.f_sites_up, SITE)
)
query(
    "check_pullable",
    f"""SELECT w.bucket, w.name, CASE WHEN a.name IS NOT NULL AND d.name IS NOT NULL THEN 'site-a' ELSE c.site END AS pull_from FROM (SELECT DISTINCT bucket, name FROM {{f_objects}}) w
LEFT JOIN (SELECT * FROM {{f_objects}} WHERE site = 'site-a' AND status = 'READY') a ON a.bucket = w.bucket AND a.name = w.name LEFT JOIN (SELECT * FROM {{f_driver}} WHERE site = 'site-a') d ON d.bucket = w.bucket AND d.name = w.name
LEFT JOIN (SELECT bucket, name, min(site) AS site FROM {{f_objects}} WHERE {_ELSEWHERE} GROUP BY 1, 2) c ON c.bucket = w.bucket AND c.name = w.name""",
)(lambda t: orders.check_pullable(t.f_objects.select("bucket", "name").distinct(), t.f_objects, t.f_driver, t.f_sites_up, SITE))

# --- streaming: the table's rows as files, read as a stream ---------------------------------------


def arriving(t: Tables, base: str):
    """Orders as JSON files in two parts: what arrives before and after a restart."""
    from ..streaming import orders as s

    middle = t.f_orders.select(F.percentile_approx("op_id", 0.5).alias("m")).first()["m"]
    for part in (F.col("op_id") <= middle, F.col("op_id") > middle):
        yield t.f_orders.where(part).write.mode("append").option("timestampNTZFormat", s.TIME).json(f"{base}/in")


def _streamed(t: Tables, out, mode: str) -> DataFrame:
    """Runs the stream over orders that arrive in two parts, and reads what it wrote to the shared folder."""
    from ..streaming import orders as s

    base = f"{_shared(t.spark)}/stream-{uuid4().hex}"
    for _ in arriving(t, base):
        s.run_once(out(s.read_files(t.spark, f"{base}/in")), s.batch_writer(f"{base}/out"), f"{base}/checkpoint", mode)
    return t.spark.read.parquet(f"{base}/out")


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that keyed states need, for the time of a query."""
    from ..streaming.orders import ROCKSDB

    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _shared(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="spark-streams-")


@query("stream_fan_out", _ROUTED)
def _(t):
    from ..streaming.orders import fan_out_stream

    return _streamed(t, lambda rows: fan_out_stream(rows, t.f_topology), "append").drop("batch")


@query("stream_counters", f"SELECT kind, step, count(*) AS n FROM ({_CLASS}) c GROUP BY 1, 2")
def _(t):
    from ..streaming.orders import counters_stream

    rows = _streamed(t, counters_stream, "complete")
    return rows.groupBy("kind", "step").agg(F.max_by("n", "batch").alias("n"))


@query("stream_apply", FOLDED)
def _(t):
    """From the catalog's states: the same as ``fold_orders``, in two runs."""
    from ..streaming import orders as s

    base = f"{_shared(t.spark)}/apply-{uuid4().hex}"
    for _ in arriving(t, base):
        s.run_once(s.read_files(t.spark, f"{base}/in"), s.apply_writer(t.spark, f"{base}/out", t.f_targets), f"{base}/checkpoint")
    return s.latest_states(t.spark.read.parquet(f"{base}/out/states"))


@query("stream_dedup", "SELECT DISTINCT from_site, to_site, client_id, bucket_name, object_name, action FROM {f_orders}")
def _(t):
    """Within a bound beyond the table's whole time each order comes out once; op_id and ts are those that arrived first."""
    from ..streaming import orders as s

    with rocksdb(t.spark):
        rows = _streamed(t, lambda rows: s.dedup_stream(rows, "400 days"), "append")
    return rows.select("from_site", "to_site", "client_id", "bucket_name", "object_name", "action")


# --- rights, sites, buckets ----------------------------------------------------------------------

query("right_include", "SELECT x.code AS a, y.code AS b, CASE WHEN y.code = 0 THEN x.code = 0 ELSE (x.code & y.code) = y.code END AS covers FROM (SELECT DISTINCT code FROM {f_ownership}) x CROSS JOIN (SELECT DISTINCT code FROM {f_ownership}) y")(
    lambda t: rights.all_pairs_of_rights(t.f_ownership).select("a", "b", "covers")
)
query("right_fusion", "SELECT client, bucket, bit_or(code) AS code FROM {f_ownership} GROUP BY 1, 2")(lambda t: rights.fused_rights(t.f_ownership))
query("rights_of_client", "SELECT client, bucket, bit_or(code) AS code FROM {f_ownership} WHERE client = 'client-3' GROUP BY 1, 2 HAVING (bit_or(code) & 2) = 2")(lambda t: rights.rights_of_client(t.f_ownership, "client-3", m.WRITE))
query("sites_up", "SELECT id, status FROM {f_topology} WHERE status = 'UP'")(lambda t: rights.sites_by_status(t.f_topology))
query("buckets_of_client", "SELECT id, client_id, site, status FROM {f_buckets} WHERE client_id = 'client-y'")(lambda t: rights.buckets_of_client(t.f_buckets, "client-y"))
query("bucket_state", "SELECT bucket, CASE WHEN b.id IS NULL THEN 'absent' WHEN b.status = 'READY' THEN 'ok' WHEN b.status = 'DELETED' THEN 'gone' ELSE 'error' END AS state FROM (SELECT DISTINCT bucket FROM {f_ownership}) x LEFT JOIN (SELECT * FROM {f_buckets} WHERE site = 'site-a') b ON b.id = x.bucket")(
    lambda t: rights.bucket_state(t.f_ownership.select("bucket").distinct(), t.f_buckets, SITE)
)
query("bucket_deletable", "SELECT id, site FROM {f_buckets} b WHERE client_id = 'client-x' AND status = 'READY' AND NOT EXISTS (SELECT 1 FROM {f_holdings} o WHERE o.site = b.site AND o.bucket = b.id AND o.status = 'READY')")(
    lambda t: rights.deletable_buckets(t.f_buckets, t.f_holdings, CLIENT).select("id", "site")
)

# --- content, names, metrics ---------------------------------------------------------------------

query("content_manifest", "SELECT name, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS n_bytes FROM {f_content}")(
    lambda t: content.content_manifest(t.f_content, F.col("text")).select("name", "md5", "sha1", "sha256", "n_bytes")
)
query("content_duplicates", "SELECT sha256(text) AS sha256, count(*) AS copies, min(name) AS first_name FROM {f_content} GROUP BY 1 HAVING count(*) > 1")(
    lambda t: content.duplicate_contents(content.content_manifest(t.f_content, F.col("text"), ["SHA256"]))
)
query("fixity_audit", "SELECT bucket, count(*) AS n, count(*) FILTER (md5(text) <> stored_hash) AS bad_hash, count(*) FILTER (length(text) <> n_chars) AS bad_size FROM {f_content} GROUP BY 1")(
    lambda t: content.fixity_audit(t.f_content, F.col("text"), "stored_hash", "n_chars")
)
_CLEAN = r"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(replace(url_decode(replace(url, '+', ' ')), '//', '/')), '[\s_]+', ' ', 'g'), '[^a-zA-Z0-9/_ .\-]', '', 'g'), '-+', '-', 'g')), '[\s_]+', '_', 'g')"
query("sanitize_names", f"SELECT page_id, CASE WHEN starts_with(clean, '/') THEN substr(clean, 2) ELSE clean END AS clean FROM (SELECT page_id, {_CLEAN} AS clean FROM pages) x")(
    lambda t: content.sanitize_names(t.pages, "url").select("page_id", "clean")
)
query("validate_names", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce(length(url), 0) = 0 THEN 'empty' WHEN regexp_matches(url, '[\\x00-\\x1F\\x7F]') THEN 'control' WHEN contains(url, ';') OR contains(url, '<script>') THEN 'tag' WHEN NOT regexp_matches(url, '^[0-9a-zA-Z_./:\\-]+$') THEN 'pattern' END AS reason FROM pages) x WHERE reason IS NOT NULL GROUP BY 1")(
    lambda t: content.validate_names(t.pages, "url", r"^[0-9a-zA-Z_./:\-]{1,1024}$")[1].groupBy("reason").agg(F.count("*").alias("n"))
)
query("name_collisions", f"SELECT clean, count(*) AS names, min(url) AS first_name FROM (SELECT DISTINCT url, CASE WHEN starts_with(c, '/') THEN substr(c, 2) ELSE c END AS clean FROM (SELECT url, {_CLEAN} AS c FROM (SELECT regexp_replace(url, '[0-9]+', '', 'g') || CASE WHEN page_id % 2 = 0 THEN '#' ELSE '' END AS url FROM pages) y) x) z GROUP BY 1 HAVING count(*) > 1")(
    lambda t: content.name_collisions(t.pages.select(F.concat(F.regexp_replace("url", "[0-9]+", ""), F.when(F.col("page_id") % 2 == 0, "#").otherwise("")).alias("url")), "url")
)
query("metric_rollup", "SELECT 'replicator' AS component, bucket_name AS key, lower(action) AS tag, count(*) AS value FROM {f_orders} GROUP BY ALL")(
    lambda t: content.metric_rollup(t.f_orders.select(F.lit("replicator").alias("component"), F.col("bucket_name").alias("key"), F.lower("action").alias("tag"), F.lit(1).cast("long").alias("value")))
)

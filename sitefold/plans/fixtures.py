"""Catalog tables derived from the given tables, in SQL that Spark and DuckDB both run.

``{name}`` stands for a table. Spark gets DataFrames for the names, DuckDB common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "f_sites": "SELECT 0 AS i, 'site-a' AS site UNION ALL SELECT 1, 'site-b' UNION ALL SELECT 2, 'site-c'",
    "f_objects": """SELECT s.site AS site, concat('bucket-', CAST(o.o_custkey % 4 AS VARCHAR(10))) AS bucket,
 concat('dir', CAST(o.o_orderkey % 10 AS VARCHAR(10)), '/object_', CAST(o.o_orderkey AS VARCHAR(20))) AS name,
 CASE (o.o_orderkey + 3*s.i) % 20 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'UPLOAD' WHEN 2 THEN 'UPLOAD' WHEN 3 THEN 'ERR_UPL'
  WHEN 4 THEN 'DELETING' WHEN 5 THEN 'DELETED' WHEN 6 THEN 'DELETED' WHEN 7 THEN 'ERR_DEL' ELSE 'READY' END AS status,
 o.o_orderdate + CASE s.i WHEN 0 THEN INTERVAL '0' HOUR WHEN 1 THEN INTERVAL '1' HOUR ELSE INTERVAL '2' HOUR END AS creation,
 CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE o.o_orderdate + INTERVAL '365' DAY END AS expires,
 CAST(floor(o.o_totalprice) AS BIGINT) AS size, md5(CAST(o.o_orderkey AS VARCHAR(20))) AS hash, o.o_orderpriority AS md_priority
FROM {orders} o CROSS JOIN {f_sites} s WHERE (o.o_orderkey*7 + s.i) % 10 <> 0""",
    "f_driver": """SELECT s.site AS site, concat('bucket-', CAST(o.o_custkey % 4 AS VARCHAR(10))) AS bucket,
 concat('dir', CAST(o.o_orderkey % 10 AS VARCHAR(10)), '/object_', CAST(o.o_orderkey AS VARCHAR(20))) AS name,
 o.o_orderdate + CASE WHEN o.o_orderkey % 2 = 0 THEN INTERVAL '90' MINUTE ELSE INTERVAL '0' MINUTE END AS event
FROM {orders} o CROSS JOIN {f_sites} s WHERE (o.o_orderkey*11 + s.i) % 7 <> 0""",
    "f_buckets": "SELECT DISTINCT bucket AS id, concat('client-', CASE WHEN bucket IN ('bucket-0','bucket-1') THEN 'x' ELSE 'y' END) AS client_id, site, CASE WHEN bucket='bucket-3' THEN 'DELETED' ELSE 'READY' END AS status FROM {f_objects}",
    "f_site_listing": """SELECT concat('object_', CAST(l_orderkey AS VARCHAR(20))) AS name, concat('site', CAST(l_suppkey % 4 AS VARCHAR(4))) AS site,
 max(l_shipdate) AS event, CASE min(l_partkey) % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 10 WHEN 3 THEN 11 ELSE 20 END AS nstatus FROM {lineitem} GROUP BY 1,2""",
    "f_orders": """SELECT event_id AS op_id, ts, concat('site', CAST(user_id % 3 AS VARCHAR(4))) AS from_site, CASE WHEN user_id % 5 = 0 THEN concat('site', CAST(event_id % 3 AS VARCHAR(4))) END AS to_site,
 concat('client-', CAST(user_id % 7 AS VARCHAR(4))) AS client_id, concat('bucket-', CAST(user_id % 4 AS VARCHAR(4))) AS bucket_name,
 CASE WHEN event_type='signup' THEN NULL ELSE concat('object_', CAST(user_id AS VARCHAR(20)), '_', right(regexp_extract(props, '([0-9]+)', 1), 1)) END AS object_name, CASE event_type WHEN 'click' THEN 'DELETE' WHEN 'error' THEN 'UNKNOWN' ELSE 'CREATE' END AS action FROM {events}""",
    "f_ownership": "SELECT concat('client-', CAST(c_nationkey AS VARCHAR(4))) AS client, concat('bucket-', CAST(c_custkey % 40 AS VARCHAR(4))) AS bucket, CAST(c_custkey % 8 AS INT) AS code FROM {customer}",
    "f_content": "SELECT doc_id, lang AS bucket, concat(source,'/',CAST(doc_id AS VARCHAR(20))) AS name, text, n_chars, CASE WHEN doc_id % 17 = 0 THEN md5('corrupt') ELSE md5(text) END AS stored_hash FROM {documents}",
    # Sites that hold objects, and sites that orders go to: one of each is down.
    "f_sites_up": "SELECT site AS id, CASE WHEN site = 'site-b' THEN 'DOWN' ELSE 'UP' END AS status FROM {f_sites}",
    "f_topology": "SELECT DISTINCT from_site AS id, CASE WHEN from_site = 'site2' THEN 'DOWN' ELSE 'UP' END AS status FROM {f_orders}",
    # Objects that orders act on, of ten times as many users as send orders, with every status; bucket-1 holds none that is READY.
    "f_targets": """SELECT DISTINCT concat('bucket-', CAST(o_custkey % 4 AS VARCHAR(4))) AS bucket, concat('object_', CAST(o_custkey AS VARCHAR(20)), '_', CAST(o_orderkey % 10 AS VARCHAR(20))) AS name,
 CASE WHEN o_custkey % 4 = 1 THEN CASE o_orderkey % 2 WHEN 0 THEN 'DELETED' ELSE 'DELETING' END ELSE CASE (o_custkey + o_orderkey % 10) % 6 WHEN 0 THEN 'UPLOAD' WHEN 1 THEN 'DELETED' WHEN 2 THEN 'ERR_UPL' ELSE 'READY' END END AS status FROM {orders}""",
    # The same states under requests and buckets.
    "f_request_listing": "SELECT concat('run-', CAST(length(name) % 3 AS VARCHAR(4))) AS request_id, concat('bucket-', right(name, 1)) AS bucket, name, site, event, nstatus FROM {f_site_listing}",
    # Buckets known before an import; what owners hold when they ask to delete buckets.
    "f_known_buckets": "SELECT * FROM {f_buckets} WHERE id <> 'bucket-2'",
    "f_holdings": "SELECT o.site, o.bucket, o.name, CASE WHEN b.client_id = 'client-x' AND o.bucket = 'bucket-1' AND o.site <> 'site-b' AND o.status = 'READY' THEN 'DELETED' ELSE o.status END AS status FROM {f_objects} o JOIN {f_buckets} b ON b.id = o.bucket AND b.site = o.site",
    # Sites' states, sent in two parts: later sites first, then earlier ones with some newer states.
    "f_old_listing": "SELECT name, site, event, nstatus FROM {f_site_listing} WHERE site <> 'site0'",
    "f_new_listing": "SELECT name, site, event + INTERVAL '1' DAY AS event, CASE WHEN nstatus = 20 THEN 10 ELSE nstatus END AS nstatus FROM {f_site_listing} WHERE site IN ('site0', 'site1')",
}

_RANK = "CASE status WHEN 'UNKNOWN' THEN 0 WHEN 'UPLOAD' THEN 1 WHEN 'READY' THEN 2 WHEN 'ERR_UPL' THEN 3 WHEN 'DELETING' THEN 4 WHEN 'DELETED' THEN 5 WHEN 'ERR_DEL' THEN 6 END"
_REMAPPED = "CASE rank WHEN 0 THEN 0 WHEN 1 THEN 7 WHEN 2 THEN 2 WHEN 3 THEN 7 WHEN 4 THEN 4 WHEN 5 THEN 5 WHEN 6 THEN 4 END"


def _actions(table: str, key: str = "name", sites: str = "['site0','site1','site2','site3']") -> str:
    """The four action rules over the site states in a table."""
    return _ACTIONS.replace("<table>", table).replace("<key>", key).replace("<sites>", sites)


_ACTIONS = """SELECT <key>, action AS need_action, CASE WHEN action IN (2, 30) THEN NULL WHEN n_ready > 0 THEN ready ELSE updated END AS need_action_from,
 array_to_string(list_sort(list_distinct(list_concat(list_filter(<sites>, lambda x: NOT list_contains(known, x)), CASE WHEN action IN (2, 30) THEN not_deleted ELSE not_ready END))), ',') AS sites, prim
FROM (SELECT *, CASE WHEN prim IN (1, 2) THEN CASE WHEN undeleted THEN 2 END WHEN prim IN (10, 11) THEN CASE WHEN unready THEN CASE WHEN absent THEN 20 ELSE 11 END END WHEN prim = 20 THEN CASE WHEN held THEN 20 ELSE 30 END END AS action
 FROM (SELECT <key>, list(nstatus ORDER BY event DESC, nstatus, site)[1] AS prim, list(site) AS known, count(*) FILTER (nstatus = 10) AS n_ready,
  string_agg(CASE WHEN nstatus = 10 THEN site END, ',' ORDER BY site) AS ready, string_agg(CASE WHEN nstatus = 11 THEN site END, ',' ORDER BY site) AS updated,
  coalesce(list(site) FILTER (nstatus <> 1), []) AS not_deleted, coalesce(list(site) FILTER (nstatus <> 10), []) AS not_ready,
  bool_or(nstatus IN (2,10,11,20)) AS undeleted, bool_or(nstatus IN (1,2,11,20)) AS unready, bool_or(nstatus <= 2 OR nstatus >= 20) AS absent, bool_or(nstatus IN (10, 11)) AS held
  FROM {<table>} GROUP BY <key>) a) b WHERE action IS NOT NULL"""
#: For oracles alone: what the first steps of a site's run leave.
ORACLE_SQL = {
    "o_ranked": f"SELECT *, {_RANK} AS rank FROM {{f_objects}}",
    "o_started": f"SELECT *, CASE WHEN site = 'site-a' AND creation <= TIMESTAMP '1996-01-01 00:00:00' THEN {_REMAPPED} ELSE rank END AS rstatus FROM {{o_ranked}} WHERE NOT (site = 'site-a' AND status = 'UNKNOWN')",
    "o_native": """SELECT coalesce(o.bucket, d.bucket) AS bucket, coalesce(o.name, d.name) AS name, o.rstatus AS db_rank, o.creation AS db_event, d.event AS driver_event,
 CASE WHEN o.name IS NULL THEN 'driver_only' WHEN d.name IS NULL THEN 'db_only' ELSE 'both' END AS side
FROM (SELECT * FROM {o_started} WHERE site = 'site-a') o FULL JOIN (SELECT * FROM {f_driver} WHERE site = 'site-a') d ON o.bucket = d.bucket AND o.name = d.name""",
    "o_states": """SELECT * FROM (SELECT bucket, name, side, db_rank, CASE WHEN side = 'driver_only' THEN 11 WHEN side = 'db_only' THEN CASE WHEN db_rank = 0 THEN 0 WHEN db_rank IN (1,2,3,7) THEN 20 ELSE 1 END
 ELSE CASE WHEN db_rank IN (1,3,7) THEN 11 WHEN db_rank = 2 THEN 10 WHEN db_rank IN (4,5,6) THEN 2 END END AS nstatus,
 CASE WHEN db_event >= driver_event OR driver_event IS NULL THEN db_event ELSE driver_event END AS event FROM {o_native}) x WHERE nstatus IS NOT NULL""",
    "o_merged": "SELECT o.* FROM {f_old_listing} o LEFT JOIN {f_new_listing} n ON o.name = n.name AND o.site = n.site WHERE n.site IS NULL UNION ALL SELECT * FROM {f_new_listing}",
    # All sites of the catalog at once, after their stored objects are refreshed.
    "o_all_states": f"""SELECT bucket, name, site, event, CASE WHEN nstatus = 11 AND stored THEN 10 ELSE nstatus END AS nstatus FROM (SELECT bucket, name, site, db_rank, driver_event IS NOT NULL AS stored,
 CASE WHEN db_rank IS NULL THEN 11 WHEN driver_event IS NULL THEN CASE WHEN db_rank = 0 THEN 0 WHEN db_rank IN (1,2,3,7) THEN 20 ELSE 1 END WHEN db_rank IN (1,3,7) THEN 11 WHEN db_rank = 2 THEN 10 WHEN db_rank IN (4,5,6) THEN 2 END AS nstatus,
 CASE WHEN db_event >= driver_event OR driver_event IS NULL THEN db_event ELSE driver_event END AS event FROM (SELECT coalesce(o.site, d.site) AS site, coalesce(o.bucket, d.bucket) AS bucket, coalesce(o.name, d.name) AS name,
  o.rstatus AS db_rank, o.creation AS db_event, d.event AS driver_event FROM (SELECT *, CASE WHEN creation <= TIMESTAMP '1996-01-01 00:00:00' THEN {_REMAPPED} ELSE rank END AS rstatus FROM {{o_ranked}} WHERE status <> 'UNKNOWN') o
  FULL JOIN {{f_driver}} d ON o.site = d.site AND o.bucket = d.bucket AND o.name = d.name) x) y WHERE nstatus IS NOT NULL""",
    "o_actions": _actions("f_site_listing"),
    "o_central": _actions("o_merged"),
    "o_requests": _actions("f_request_listing", "request_id, bucket, name"),
    "o_everything": _actions("o_all_states", "bucket, name", "['site-a','site-b','site-c']"),
}
_USED = re.compile(r"\{(\w+)\}")


class Tables:
    """The given tables and the derived ones, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in SQL:
                self._known[name] = self.spark.sql(SQL[name], **{x: getattr(self, x) for x in set(_USED.findall(SQL[name]))})
            else:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._known[name]

    @property
    def objects(self) -> DataFrame:
        """The catalog with its open metadata map."""
        return self.f_objects.withColumn("metadata", F.create_map(F.lit("priority"), F.col("md_priority")))


def standalone(sql: str) -> str:
    """The statement with a common table expression for each derived table that it uses."""
    texts, order = SQL | ORACLE_SQL, []

    def add(name: str) -> None:
        if name in texts and name not in order:
            for x in _USED.findall(texts[name]):
                add(x)
            order.append(name)

    for x in _USED.findall(sql):
        add(x)
    plain = lambda s: _USED.sub(r"\1", s)
    ctes = ", ".join(f"{x} AS ({plain(texts[x])})" for x in order)
    return (f"WITH {ctes} " if ctes else "") + plain(sql)

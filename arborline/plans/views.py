"""Views of the given tables as geometry and traits, in Spark and in the same SQL.

There are no meshes among the tables, so vertices come from the first three components of ``embeddings`` (label: owner),
faces from ``lineitem`` (corners: keys modulo the number of vertices), polylines from ``events`` (one per user).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arborline.common import normal_key, table
from arborline.operators.architecture import eligible, latest_traits
from arborline.operators.hierarchy import current_links


def vertices(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("id"), *(F.element_at("embedding", k + 1).cast("double").alias(a) for k, a in enumerate("xyz")), F.col("label").cast("int").alias("label"))


def faces(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "embeddings").agg(F.count("*").alias("n"))
    corner = lambda c, k: F.pmod(F.col(c).cast("long"), F.col("n")).alias(k)
    return table(s, d, "lineitem").crossJoin(F.broadcast(n)).select(corner("l_orderkey", "a"), corner("l_partkey", "b"), corner("l_suppkey", "c"))


def nodes(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").select(F.col("user_id").cast("long").alias("root_id"), F.row_number().over(w).cast("long").alias("node_id"), F.col("value").cast("double").alias("x"), (F.pmod("event_id", F.lit(101)) / 10.0).alias("y"))
    return e.select("*", (-F.col("node_id")).cast("double").alias("z"))


def traits(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The newest traits of each root, with these columns only; a metric stands for its value and whether it is eligible."""
    wide = [x for c in columns for x in ((c, f"{c}_measurement_eligible") if c in ("length", "mean_diameter") else (c,))]
    return latest_traits(table(s, d, "traits"), wide)


def branches(s: SparkSession, d: str) -> DataFrame:
    """Insertions of the current roots: sample_id, parent_key, root_id, arc."""
    r = table(s, d, "roots").groupBy("sample_id", normal_key("root_id").alias("key")).agg(F.max(F.struct("recorded_at", "root_id", normal_key("parent_id").alias("parent_key"), "insertion_index")).alias("r"))
    return r.select("sample_id", "r.parent_key", "r.root_id", F.col("r.insertion_index").cast("double").alias("arc")).filter("parent_key is not null")


def children_and_parents(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = traits(s, d, "length").select("sample_id", "root_id", eligible("length").alias("length"))
    links = current_links(table(s, d, "roots"))
    own = links.join(t, ["sample_id", "root_id"], "left").select("sample_id", "key", "parent_key", "length")
    return own.filter("parent_key is not null").select("sample_id", F.col("parent_key").alias("parent_id"), F.col("length").isNotNull().alias("ok")), own.select("sample_id", F.col("key").alias("root_id"), "length")


SQL = {
    "vertices": "vertices AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(label AS INTEGER) AS label FROM embeddings)",
    "faces": "faces AS (SELECT l_orderkey % n AS a, l_partkey % n AS b, l_suppkey % n AS c FROM lineitem, (SELECT count(*) AS n FROM embeddings))",
    "corners": "corners AS (SELECT f.*, p.x AS ax, p.y AS ay, p.z AS az, p.label AS al, q.x AS bx, q.y AS by_, q.z AS bz, q.label AS bl, r.x AS cx, r.y AS cy, r.z AS cz, r.label AS cl FROM faces f JOIN vertices p ON p.id = f.a JOIN vertices q ON q.id = f.b JOIN vertices r ON r.id = f.c)",
    "measures": "measures AS (SELECT *, 0.5 * sqrt(pow((by_-ay)*(cz-az)-(bz-az)*(cy-ay),2) + pow((bz-az)*(cx-ax)-(bx-ax)*(cz-az),2) + pow((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax),2)) AS area, (ax*(by_*cz-bz*cy) + ay*(bz*cx-bx*cz) + az*(bx*cy-by_*cx)) / 6.0 AS volume FROM corners)",
    "edges": "edges AS (SELECT u, v, count(*) AS incidence, sum(way) AS balance FROM (SELECT unnest([{'u': least(a,b), 'v': greatest(a,b), 'way': CASE WHEN a < b THEN 1 ELSE -1 END}, {'u': least(b,c), 'v': greatest(b,c), 'way': CASE WHEN b < c THEN 1 ELSE -1 END}, {'u': least(c,a), 'v': greatest(c,a), 'way': CASE WHEN c < a THEN 1 ELSE -1 END}], recursive := true) FROM faces WHERE a <> b AND b <> c AND a <> c) GROUP BY u, v)",
    "nodes": "nodes AS (SELECT root_id, node_id, x, y, CAST(-node_id AS DOUBLE) AS z FROM (SELECT CAST(user_id AS BIGINT) AS root_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS node_id, CAST(value AS DOUBLE) AS x, (event_id % 101) / 10.0 AS y FROM events))",
    "arcs": "arcs AS (SELECT *, sum(step) OVER (PARTITION BY root_id ORDER BY node_id ROWS UNBOUNDED PRECEDING) AS arc FROM (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0.0) AS step FROM nodes WINDOW w AS (PARTITION BY root_id ORDER BY node_id)))",
    "segs": "segs AS (SELECT * FROM (SELECT root_id, node_id AS seg_id, x AS ax, y AS ay, z AS az, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(z) OVER w AS bz, arc, lead(step) OVER w AS length FROM arcs WINDOW w AS (PARTITION BY root_id ORDER BY node_id)) WHERE length IS NOT NULL)",
    "latest": "latest AS (SELECT * EXCLUDE (rn), CASE WHEN length_measurement_eligible AND isfinite(length) AND length > 0 THEN length END AS el, CASE WHEN mean_diameter_measurement_eligible AND isfinite(mean_diameter) AND mean_diameter > 0 THEN mean_diameter END AS ed FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, root_id ORDER BY run_no DESC, loaded_at DESC) AS rn FROM traits) WHERE rn = 1)",
    "current": "current AS (SELECT * FROM (SELECT *, lower(regexp_replace(root_id, '^\\s+|\\s+$', '', 'g')) AS k, nullif(lower(regexp_replace(parent_id, '^\\s+|\\s+$', '', 'g')), '') AS p, row_number() OVER (PARTITION BY sample_id, lower(regexp_replace(root_id, '^\\s+|\\s+$', '', 'g')) ORDER BY recorded_at DESC) AS rn FROM roots) WHERE rn = 1)",
    "walk": "walk AS (SELECT sample_id, k, k AS here, 0 AS links, [k] AS line FROM current UNION ALL SELECT w.sample_id, w.k, m.k, w.links + 1, list_append(w.line, m.k) FROM walk w JOIN current c ON c.sample_id = w.sample_id AND c.k = w.here JOIN current m ON m.sample_id = c.sample_id AND m.k = c.p WHERE NOT list_contains(w.line, m.k))",
    "up": "up AS (SELECT sample_id, k, here, links FROM walk)",
}


def with_sql(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names) + "\n"

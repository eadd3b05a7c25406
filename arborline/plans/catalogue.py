"""The queries of the geometry, tree and trait operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborline.common import normal_key, table
from arborline.functions import geometry as g
from arborline.functions import text as tx
from arborline.operators import architecture as arch
from arborline.operators import changes, mesh, polyline, spatial, tree
from arborline.plans.problems import HIERARCHY
from arborline.plans.views import SQL, branches, children_and_parents, faces, nodes, traits, vertices, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Distances in the space of the vertices and of the polylines at which the queries look.
REACH, NEIGHBOURS, STEP, WINDOW = 0.1, 4, 25.0, 40.0


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r(c: str | Column, places: int = 6) -> Column:
    """A double rounded for comparison, under its own name."""
    return F.round(F.col(c) if isinstance(c, str) else c, places).alias(c if isinstance(c, str) else "value")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(r(n, places) if t == "double" else F.col(n) for n, t in df.dtypes))


# Summaries of systems


_scopes = """, scoped AS (SELECT sample_id, el, ed, unnest(list_filter(['system', CASE WHEN root_order > 0 THEN 'laterals' END, CASE WHEN root_order IS NOT NULL THEN 'order_' || root_order END], lambda x: x IS NOT NULL)) AS scope FROM latest)
"""


@query(with_sql("latest") + _scopes + """SELECT sample_id, scope, count(*) AS roots, count(el) AS eligible_roots, count(*) - count(el) AS excluded_roots, round(sum(el), 9) AS total_length, round(avg(el), 9) AS mean_length,
 round(stddev_samp(el) / avg(el), 9) AS length_variation, round(avg(ed), 9) AS mean_diameter, round(stddev_samp(ed) / avg(ed), 9) AS diameter_variation,
 round(quantile_cont(ed, 0.1), 9) AS diameter_p10, round(quantile_cont(ed, 0.5), 9) AS diameter_p50, round(quantile_cont(ed, 0.9), 9) AS diameter_p90, round(quantile_cont(ed, 0.75) - quantile_cont(ed, 0.25), 9) AS diameter_iqr,
 round(sum(el) / nullif(count(el), 0), 9) AS length_per_root FROM scoped GROUP BY sample_id, scope""")
def architecture_summary(s: SparkSession, d: str) -> DataFrame:
    return rounded(arch.scope_summary(traits(s, d, "root_order", "length", "mean_diameter"), ["sample_id"]), 9)


@query(with_sql("latest") + """SELECT accession, 'length' AS metric, count(*) FILTER (length_measurement_status = 'complete') AS complete, count(*) FILTER (length_measurement_status = 'partial') AS partial, count(*) FILTER (length_measurement_status = 'unavailable') AS unavailable, count(*) FILTER (length_measurement_status = 'excluded') AS excluded, count(*) FILTER (length_measurement_status NOT IN ('complete','partial','unavailable','excluded') OR length_measurement_status IS NULL) AS other FROM latest GROUP BY accession
UNION ALL SELECT accession, 'mean_diameter', count(*) FILTER (mean_diameter_measurement_status = 'complete'), count(*) FILTER (mean_diameter_measurement_status = 'partial'), count(*) FILTER (mean_diameter_measurement_status = 'unavailable'), count(*) FILTER (mean_diameter_measurement_status = 'excluded'), count(*) FILTER (mean_diameter_measurement_status NOT IN ('complete','partial','unavailable','excluded') OR mean_diameter_measurement_status IS NULL) FROM latest GROUP BY accession""")
def metric_status_partition(s: SparkSession, d: str) -> DataFrame:
    return arch.status_counts(traits(s, d, "accession", "length_measurement_status", "mean_diameter_measurement_status"), ["accession"])


@query(with_sql("latest") + "SELECT sample_id, root_order, count(*) AS laterals FROM latest WHERE root_order > 0 AND el IS NOT NULL GROUP BY ALL")
def lateral_counts_by_order(s: SparkSession, d: str) -> DataFrame:
    return arch.laterals_by_order(traits(s, d, "root_order", "length"), ["sample_id"])


@query(with_sql("latest") + """, one AS (SELECT sample_id, CAST(count(*) AS DOUBLE) AS root_count, CAST(count(*) FILTER (root_order > 0) AS DOUBLE) AS lateral_count, CAST(max(root_order) AS DOUBLE) AS max_order, sum(el) AS total_length, sum(CASE WHEN root_order > 0 THEN el END) AS lateral_length, avg(ed) AS mean_diameter, sum(CASE WHEN isfinite(volume) THEN volume END) AS total_volume, CAST(count(*) FILTER (length_measurement_status = 'complete') AS DOUBLE) AS complete_lengths FROM latest GROUP BY sample_id)
SELECT sample_id, trait, round(value, 9) AS value FROM one UNPIVOT INCLUDE NULLS (value FOR trait IN (root_count, lateral_count, max_order, total_length, lateral_length, mean_diameter, total_volume, complete_lengths))""")
def system_summary_kv(s: SparkSession, d: str) -> DataFrame:
    return rounded(arch.system_summary(traits(s, d, "root_order", "length", "length_measurement_status", "mean_diameter", "volume"), ["sample_id"]), 9)


_gap = with_sql("current") + """, g AS (SELECT sample_id, p AS parent_key, root_id, CAST(insertion_index AS DOUBLE) AS arc FROM current WHERE p IS NOT NULL AND insertion_index IS NOT NULL),
h AS (SELECT *, arc - lag(arc) OVER (PARTITION BY sample_id, parent_key ORDER BY arc, root_id) AS gap FROM g)"""


@query(_gap + "SELECT sample_id, parent_key, count(gap) AS gaps, round(avg(gap), 6) AS mean_gap, count(*) FILTER (gap <= 1e-9) AS coincident FROM h GROUP BY ALL")
def branch_spacing(s: SparkSession, d: str) -> DataFrame:
    return rounded(arch.branch_gaps(branches(s, d), ["sample_id", "parent_key"]))


@query(_gap + """, i AS (SELECT sample_id, parent_key, arc - lag(arc) OVER (PARTITION BY sample_id, parent_key ORDER BY arc, root_id) AS gap FROM h WHERE gap > 1e-9 OR gap IS NULL)
SELECT sample_id, parent_key, count(gap) AS gaps, round(avg(gap), 6) AS mean_gap, count(*) FILTER (gap <= 1e-9) AS coincident FROM i GROUP BY ALL""")
def branch_spacing_distinct(s: SparkSession, d: str) -> DataFrame:
    return rounded(arch.branch_gaps(branches(s, d), ["sample_id", "parent_key"], distinct=True))


@query(with_sql("latest", "current") + """, own AS (SELECT c.sample_id, c.k, c.p, l.el FROM current c LEFT JOIN latest l ON l.sample_id = c.sample_id AND l.root_id = c.root_id),
n AS (SELECT sample_id, p, count(*) FILTER (el IS NOT NULL) AS n FROM own WHERE p IS NOT NULL GROUP BY ALL)
SELECT n.sample_id, CAST(sum(n.n) AS BIGINT) AS children, count(*) AS parents, count(*) FILTER (o.el IS NULL) AS unusable_parents, round(sum(o.el), 6) AS parent_length, CASE WHEN count(*) FILTER (o.el IS NULL) = 0 THEN round(sum(n.n) / sum(o.el), 6) END AS density FROM n LEFT JOIN own o ON o.sample_id = n.sample_id AND o.k = n.p GROUP BY n.sample_id""")
def branch_density(s: SparkSession, d: str) -> DataFrame:
    children, parents = children_and_parents(s, d)
    return rounded(arch.branch_density(children, parents, ["sample_id"]))


@query(with_sql("latest") + ", n AS (SELECT accession, ed AS value, count(*) AS n FROM latest WHERE ed IS NOT NULL GROUP BY ALL) SELECT accession, value, n, round(sum(n) OVER (PARTITION BY accession ORDER BY value ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY accession), 6) AS cumulative FROM n")
def diameter_distribution(s: SparkSession, d: str) -> DataFrame:
    return arch.distribution(traits(s, d, "accession", "mean_diameter"), "mean_diameter", ["accession"]).withColumn("cumulative", F.round("cumulative", 6))


@query(with_sql("latest", "current") + """, own AS (SELECT c.sample_id, c.root_id, c.k, c.p, l.el FROM current c JOIN latest l ON l.sample_id = c.sample_id AND l.root_id = c.root_id)
SELECT a.sample_id, a.root_id, round(a.el / b.el, 6) AS ratio, a.el > b.el + greatest(1e-12, 1e-9 * greatest(a.el, b.el)) AS exceeds,
 CASE WHEN a.el > b.el + greatest(1e-12, 1e-9 * greatest(a.el, b.el)) THEN round(0.05 * greatest(0.0, least(1.0, (a.el - b.el) / a.el)), 6) ELSE 0.0 END AS penalty FROM own a JOIN own b ON b.sample_id = a.sample_id AND b.k = a.p WHERE a.el IS NOT NULL AND b.el IS NOT NULL""")
def child_parent_length_review(s: SparkSession, d: str) -> DataFrame:
    return rounded(tree.length_review(table(s, d, "roots"), traits(s, d, "length").select("sample_id", "root_id", arch.eligible("length").alias("length"))))


@query(with_sql("latest", "current") + "SELECT c.sample_id, c.root_id, c.parent_id, c.root_order, c.confidence, l.el AS length, l.length_measurement_status, l.ed AS mean_diameter FROM current c LEFT JOIN latest l ON l.sample_id = c.sample_id AND l.root_id = c.root_id")
def inventory_join(s: SparkSession, d: str) -> DataFrame:
    return arch.inventory(table(s, d, "roots"), table(s, d, "traits"))


@query("""SELECT column_name AS "column", CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'timestamp_ntz' END AS type,
 CASE WHEN column_name LIKE '%\\_measurement\\_status' ESCAPE '\\' THEN 'state of the measurement: complete, partial, unavailable or excluded' WHEN column_name LIKE '%\\_measurement\\_eligible' ESCAPE '\\' THEN 'whether the value may enter summaries' WHEN column_name LIKE '%\\_measurement\\_reason' ESCAPE '\\' THEN 'why the value is partial, missing or excluded'
 WHEN column_name LIKE '%\\_id' ESCAPE '\\' THEN 'identifier' WHEN column_name LIKE '%\\_at' ESCAPE '\\' THEN 'time' WHEN column_type = 'DOUBLE' THEN 'value in mm' ELSE 'attribute' END AS meaning FROM (DESCRIBE SELECT * FROM traits)""")
def trait_dictionary(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "traits")
    return arch.dictionary(t.select(*(F.col(n).cast("timestamp_ntz").alias(n) if k.startswith("timestamp") else F.col(n) for n, k in t.dtypes)))


@query(with_sql("latest") + ", b AS (SELECT sample_id, root_id, ed FROM latest WHERE ed IS NOT NULL) SELECT sample_id, root_id, CAST(row_number() OVER w AS INTEGER) AS rank, round(ed - lead(ed) OVER w, 6) AS margin FROM b WINDOW w AS (PARTITION BY sample_id ORDER BY ed DESC, root_id)")
def ranked_diameters(s: SparkSession, d: str) -> DataFrame:
    t = traits(s, d, "mean_diameter").select("sample_id", "root_id", arch.eligible("mean_diameter").alias("ed")).filter("ed is not null")
    return rounded(arch.ranked(t, ["sample_id"], "ed", "root_id").select("sample_id", "root_id", "rank", "margin"))


# Polylines


@query(with_sql("nodes", "arcs") + """, e AS (SELECT root_id, count(*) AS nodes, sum(step) AS length, sqrt(pow(arg_max(x, node_id) - arg_min(x, node_id), 2) + pow(arg_max(y, node_id) - arg_min(y, node_id), 2) + pow(arg_max(z, node_id) - arg_min(z, node_id), 2)) AS chord FROM arcs GROUP BY root_id)
SELECT root_id, nodes, round(length, 6) AS length, round(chord, 6) AS chord, CASE WHEN chord > 0 THEN round(length / chord, 6) END AS tortuosity FROM e""")
def polyline_length(s: SparkSession, d: str) -> DataFrame:
    return rounded(polyline.lengths(nodes(s, d)))


@query(with_sql("nodes", "arcs") + "SELECT root_id, node_id, round(step, 6) AS step, round(arc, 6) AS arc FROM arcs")
def polyline_arc(s: SparkSession, d: str) -> DataFrame:
    return rounded(polyline.with_arc(nodes(s, d)).select("root_id", "node_id", "step", "arc"))


@query(with_sql("nodes") + """, t AS (SELECT root_id, node_id, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy, coalesce(lead(z) OVER w, z) - coalesce(lag(z) OVER w, z) AS dz FROM nodes WINDOW w AS (PARTITION BY root_id ORDER BY node_id)),
u AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS n FROM t) SELECT root_id, node_id, round(CASE WHEN n > 1e-12 THEN dx / n ELSE 0 END, 6) AS tx, round(CASE WHEN n > 1e-12 THEN dy / n ELSE 0 END, 6) AS ty, round(CASE WHEN n > 1e-12 THEN dz / n ELSE 1 END, 6) AS tz FROM u""")
def polyline_tangents(s: SparkSession, d: str) -> DataFrame:
    return rounded(polyline.tangents(nodes(s, d)))


_window = with_sql("nodes", "arcs", "segs") + """, tot AS (SELECT root_id, sum(length) AS total FROM segs GROUP BY root_id HAVING sum(length) > 0),
att AS (SELECT root_id, total - least(40.0, total * 0.25) AS low, total AS high FROM tot),
hit AS (SELECT s.*, a.low, a.high, CASE WHEN arc <= low + 1e-9 * a.high AND low <= arc + length + 1e-9 * a.high AND length > 0 THEN greatest(0.0, least(1.0, (low - arc) / length)) END AS tl, CASE WHEN arc <= high + 1e-9 * a.high AND high <= arc + length + 1e-9 * a.high AND length > 0 THEN greatest(0.0, least(1.0, (high - arc) / length)) END AS th FROM segs s JOIN att a USING (root_id)),
w AS (SELECT root_id, arg_min(ax + (bx - ax) * tl, seg_id) FILTER (tl IS NOT NULL) AS lx, arg_min(ay + (by_ - ay) * tl, seg_id) FILTER (tl IS NOT NULL) AS ly, arg_min(az + (bz - az) * tl, seg_id) FILTER (tl IS NOT NULL) AS lz,
 arg_min(ax + (bx - ax) * th, seg_id) FILTER (th IS NOT NULL) AS hx, arg_min(ay + (by_ - ay) * th, seg_id) FILTER (th IS NOT NULL) AS hy, arg_min(az + (bz - az) * th, seg_id) FILTER (th IS NOT NULL) AS hz FROM hit GROUP BY root_id)
"""


@query(_window + "SELECT root_id, round(hx - lx, 4) AS wx, round(hy - ly, 4) AS wy, round(hz - lz, 4) AS wz FROM w WHERE hx IS NOT NULL")
def arc_window_vector(s: SparkSession, d: str) -> DataFrame:
    return rounded(polyline.arc_window(nodes(s, d), WINDOW).filter("wx is not null"), 4)


@query(_window + "SELECT root_id, round(degrees(acos(greatest(-1.0, least(1.0, -(hz - lz) / sqrt(pow(hx-lx,2) + pow(hy-ly,2) + pow(hz-lz,2)))))), 4) AS tip_gravity_angle FROM w WHERE hx IS NOT NULL AND sqrt(pow(hx-lx,2) + pow(hy-ly,2) + pow(hz-lz,2)) > 1e-12")
def tip_gravity_angle(s: SparkSession, d: str) -> DataFrame:
    w = polyline.arc_window(nodes(s, d), WINDOW)
    down = [F.lit(0.0), F.lit(0.0), F.lit(-1.0)]
    return w.select("root_id", F.round(g.directed_angle(g.xyz("w"), down), 4).alias("tip_gravity_angle")).filter("tip_gravity_angle is not null")


@query(with_sql("nodes", "arcs", "segs") + """, tot AS (SELECT root_id, sum(length) AS total, max(seg_id) AS last_seg FROM segs GROUP BY root_id HAVING sum(length) > 0),
s AS (SELECT g.*, t.total, t.last_seg, greatest(25.0, t.total / 1000) AS step FROM segs g JOIN tot t USING (root_id)),
n AS (SELECT *, CAST(ceil(arc / step - 1e-9) AS BIGINT) AS lo, CAST(ceil((arc + length) / step - 1e-9) AS BIGINT) - 1 AS hi FROM s),
i AS (SELECT *, unnest(range(lo, hi + 1)) AS number FROM n)
SELECT root_id, number, round(number * step, 4) AS arc, round(ax + (bx - ax) * greatest(0.0, least(1.0, (number * step - arc) / length)), 4) AS x, round(ay + (by_ - ay) * greatest(0.0, least(1.0, (number * step - arc) / length)), 4) AS y, round(az + (bz - az) * greatest(0.0, least(1.0, (number * step - arc) / length)), 4) AS z FROM i
UNION ALL SELECT root_id, CAST(ceil(total / step - 1e-9) AS BIGINT), round(total, 4), round(bx, 4), round(by_, 4), round(bz, 4) FROM s WHERE seg_id = last_seg""")
def polyline_resample(s: SparkSession, d: str) -> DataFrame:
    return rounded(polyline.resample(nodes(s, d), STEP), 4)


_project = with_sql("nodes", "arcs", "segs") + """, pts AS (SELECT root_id, node_id AS point_id, x + 3 AS px, y - 2 AS py, z + 0.5 AS pz FROM nodes),
j AS (SELECT p.root_id, p.point_id, s.seg_id, s.arc, s.length, px, py, pz, ax, ay, az, bx-ax AS ux, by_-ay AS uy, bz-az AS uz FROM pts p JOIN segs s USING (root_id)),
t AS (SELECT *, CASE WHEN ux*ux+uy*uy+uz*uz > 0 THEN greatest(0.0, least(1.0, ((px-ax)*ux+(py-ay)*uy+(pz-az)*uz) / (ux*ux+uy*uy+uz*uz))) ELSE 0.0 END AS t FROM j),
q AS (SELECT root_id, point_id, arc + t * length AS arc, sqrt(pow(px-ax-ux*t,2) + pow(py-ay-uy*t,2) + pow(pz-az-uz*t,2)) AS distance, row_number() OVER (PARTITION BY root_id, point_id ORDER BY sqrt(pow(px-ax-ux*t,2) + pow(py-ay-uy*t,2) + pow(pz-az-uz*t,2)), seg_id) AS rn FROM t)
SELECT root_id, point_id, round(arc, 4) AS arc, round(distance, 4) AS distance FROM q WHERE rn = 1"""


@query(_project)
def polyline_project(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    pts = n.select("root_id", F.col("node_id").alias("point_id"), (F.col("x") + 3).alias("x"), (F.col("y") - 2).alias("y"), (F.col("z") + 0.5).alias("z"))
    return rounded(polyline.project(pts, n).select("root_id", "point_id", "arc", "distance"), 4)


@query(with_sql("nodes") + """, s AS (SELECT root_id, 0.5 + y / 20 AS r0, 0.5 + lead(y) OVER w / 20 AS r1, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2) + pow(lead(z) OVER w - z, 2)) AS h FROM nodes WINDOW w AS (PARTITION BY root_id ORDER BY node_id))
SELECT root_id, round(sum(pi() * (r0 + r1) * sqrt(h*h + (r1-r0)*(r1-r0))), 3) AS lateral_area, round(sum(pi() * h * (r0*r0 + r0*r1 + r1*r1) / 3), 3) AS volume FROM s GROUP BY root_id""")
def frustum_volume(s: SparkSession, d: str) -> DataFrame:
    return rounded(polyline.frusta(nodes(s, d).withColumn("radius", 0.5 + F.col("y") / 20)), 3)


@query(with_sql("nodes") + """, a AS (SELECT root_id, node_id, coalesce(0.25 * lag(x) OVER w + 0.5 * x + 0.25 * lead(x) OVER w, x) AS x FROM nodes WINDOW w AS (PARTITION BY root_id ORDER BY node_id)),
b AS (SELECT root_id, node_id, coalesce(0.25 * lag(x) OVER w + 0.5 * x + 0.25 * lead(x) OVER w, x) AS x FROM a WINDOW w AS (PARTITION BY root_id ORDER BY node_id))
SELECT root_id, node_id, round(coalesce(0.25 * lag(x) OVER w + 0.5 * x + 0.25 * lead(x) OVER w, x), 9) AS x FROM b WINDOW w AS (PARTITION BY root_id ORDER BY node_id)""")
def polyline_smooth(s: SparkSession, d: str) -> DataFrame:
    return rounded(polyline.smooth(nodes(s, d), "x").select("root_id", "node_id", "x"), 9)


@query(with_sql("nodes") + """, sp AS (SELECT root_id, x AS low, x + y AS high FROM nodes),
m AS (SELECT *, CASE WHEN low > max(high) OVER (PARTITION BY root_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-10 OR max(high) OVER (PARTITION BY root_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL THEN 1 ELSE 0 END AS fresh FROM sp),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY root_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS cover FROM m)
SELECT root_id, CAST(cover AS BIGINT) AS cover, round(min(low), 6) AS low, round(max(high), 6) AS high, count(*) AS parts FROM c GROUP BY root_id, cover""")
def interval_cover(s: SparkSession, d: str) -> DataFrame:
    return rounded(polyline.merge_intervals(nodes(s, d).select("root_id", F.col("x").alias("low"), (F.col("x") + F.col("y")).alias("high"))))


# Meshes


@query(with_sql("faces", "edges") + "SELECT u, v, incidence, CAST(balance AS BIGINT) AS balance FROM edges")
def mesh_edges(s: SparkSession, d: str) -> DataFrame:
    return mesh.edges(faces(s, d))


_dups = "dups AS (SELECT list_sort([a, b, c]) AS k, count(*) AS copies FROM faces GROUP BY ALL HAVING count(*) > 1)"


@query(with_sql("faces") + ", " + _dups + " SELECT k[1] AS a, k[2] AS b, k[3] AS c, copies FROM dups")
def duplicate_faces(s: SparkSession, d: str) -> DataFrame:
    return mesh.duplicate_faces(faces(s, d))


@query(with_sql("vertices", "faces", "corners", "measures", "edges") + f", {_dups}" + """ SELECT f.*, e.*, (SELECT CAST(coalesce(sum(copies - 1), 0) AS BIGINT) FROM dups) AS duplicate_faces, edges > 0 AND boundary_edges = 0 AND non_manifold_edges = 0 AND inconsistent_edges = 0 AS closed
 FROM (SELECT count(*) AS faces, count(*) FILTER (a = b OR b = c OR a = c) AS degenerate_faces, round(sum(area), 4) AS area, round(sum(volume), 4) AS signed_volume FROM measures) f,
 (SELECT count(*) AS edges, count(*) FILTER (incidence = 1) AS boundary_edges, count(*) FILTER (incidence > 2) AS non_manifold_edges, count(*) FILTER (incidence = 2 AND balance <> 0) AS inconsistent_edges FROM edges) e""")
def mesh_audit(s: SparkSession, d: str) -> DataFrame:
    return rounded(mesh.audit(faces(s, d), vertices(s, d)), 4)


@query(with_sql("vertices", "faces", "corners", "measures") + "SELECT CASE WHEN al = bl OR al = cl THEN al ELSE bl END AS label, round(sum(area), 4) AS area, count(*) AS parts FROM measures WHERE al = bl OR al = cl OR bl = cl GROUP BY 1")
def surface_partition_majority(s: SparkSession, d: str) -> DataFrame:
    return rounded(mesh.surface_by_owner(faces(s, d), vertices(s, d)), 4)


@query(with_sql("vertices", "faces", "corners", "measures") + "SELECT label, round(sum(area) / 3, 4) AS area, count(*) AS parts FROM (SELECT unnest([al, bl, cl]) AS label, area FROM measures) GROUP BY label")
def surface_partition_thirds(s: SparkSession, d: str) -> DataFrame:
    return rounded(mesh.surface_by_owner(faces(s, d), vertices(s, d), "thirds"), 4)


@query(with_sql("vertices", "faces", "corners", "measures") + """, s AS (SELECT sum(volume) AS v, sum(((by_-ay)*(cz-az)-(bz-az)*(cy-ay)) / 6) AS nx, sum(((bz-az)*(cx-ax)-(bx-ax)*(cz-az)) / 6) AS ny, sum(((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax)) / 6) AS nz FROM measures)
SELECT round(v, 4) AS volume, round(v - greatest(abs(nx), abs(ny), abs(nz)), 4) AS least, round(v + greatest(abs(nx), abs(ny), abs(nz)), 4) AS greatest, round(2 * greatest(abs(nx), abs(ny), abs(nz)), 4) AS spread FROM s""")
def mesh_origin_sensitivity(s: SparkSession, d: str) -> DataFrame:
    return rounded(mesh.origin_sensitivity(faces(s, d), vertices(s, d)), 4)


@query(with_sql("vertices", "faces", "corners", "measures") + """, w AS (SELECT id, sum(area / 3) AS w FROM (SELECT unnest([a, b, c]) AS id, area FROM measures) GROUP BY id HAVING sum(area / 3) > 0)
SELECT v.id, round(coalesce(w.w, (SELECT quantile_cont(w, 0.5) FROM w)), 5) AS weight FROM vertices v LEFT JOIN w ON w.id = v.id""")
def vertex_area_weights(s: SparkSession, d: str) -> DataFrame:
    return rounded(mesh.vertex_weights(faces(s, d), vertices(s, d)), 5)


@query(with_sql("vertices", "faces") + ", bad AS (SELECT id FROM vertices WHERE id % 17 = 3) SELECT a, b, c, count(*) AS copies FROM faces WHERE a NOT IN (FROM bad) AND b NOT IN (FROM bad) AND c NOT IN (FROM bad) GROUP BY ALL")
def sanitize_faces(s: SparkSession, d: str) -> DataFrame:
    v = vertices(s, d).withColumn("x", F.when(F.col("id") % 17 == 3, F.lit(float("nan"))).otherwise(F.col("x")))
    return mesh.sanitize(faces(s, d), v).groupBy("a", "b", "c").agg(F.count("*").alias("copies"))


_contacts = with_sql("vertices", "faces", "edges") + ", con AS (SELECT least(p.label, q.label) AS low, greatest(p.label, q.label) AS high, count(*) AS edges FROM edges e JOIN vertices p ON p.id = e.u JOIN vertices q ON q.id = e.v WHERE p.label <> q.label GROUP BY ALL)"


@query(_contacts + " SELECT low, high, edges FROM con")
def contact_edges(s: SparkSession, d: str) -> DataFrame:
    return mesh.contact_edges(faces(s, d), vertices(s, d))


@query(_contacts + " SELECT high AS label, CAST(1 + high % 3 AS INTEGER) AS root_order, edges FROM con WHERE low = 0 AND high > 0 AND 1 + high % 3 >= 2")
def primary_contact_violations(s: SparkSession, d: str) -> DataFrame:
    v = vertices(s, d)
    orders = v.select("label").distinct().select("label", (1 + F.col("label") % 3).cast("int").alias("root_order"))
    return mesh.primary_contacts(faces(s, d), v, orders)


@query(with_sql("vertices") + ", k AS (SELECT id, round(x, 1) + 0.0 AS kx, round(y, 1) + 0.0 AS ky, round(z, 1) + 0.0 AS kz FROM vertices) SELECT id, min(id) OVER (PARTITION BY kx, ky, kz) AS representative FROM k")
def position_dedup(s: SparkSession, d: str) -> DataFrame:
    return mesh.position_index(vertices(s, d).select("id", *(F.round(a, 1).alias(a) for a in "xyz")))


_links = "l AS (SELECT DISTINCT sample_id || '/' || k AS u, sample_id || '/' || p AS v FROM current WHERE p IS NOT NULL)"


@query(with_sql("current", recursive=True) + f", {_links}, b AS (SELECT u, v FROM l UNION SELECT v, u FROM l), r AS (SELECT u AS id, u AS reach FROM b UNION SELECT r.id, b.v FROM r JOIN b ON b.u = r.reach) SELECT id, min(reach) AS component FROM r GROUP BY id")
def connected_components(s: SparkSession, d: str) -> DataFrame:
    from arborline.operators.graph import components
    from arborline.operators.hierarchy import current_links

    links = current_links(table(s, d, "roots")).filter("parent_key is not null")
    return components(links.select(F.concat_ws("/", "sample_id", "key").alias("u"), F.concat_ws("/", "sample_id", "parent_key").alias("v")))


# Neighbourhoods


@query(with_sql("vertices") + "SELECT a.id, count(b.id) AS neighbours FROM vertices a LEFT JOIN vertices b ON a.id <> b.id AND sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2)) <= 0.1 GROUP BY a.id")
def radius_counts(s: SparkSession, d: str) -> DataFrame:
    return spatial.radius_counts(vertices(s, d), REACH)


_knn = with_sql("vertices") + ", pr AS (SELECT a.id AS a, b.id AS b, a.label AS al, b.label AS bl, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist FROM vertices a JOIN vertices b ON a.id <> b.id), kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS rank FROM pr) WHERE rank <= 4)"


@query(_knn + " SELECT least(a, b) AS u, greatest(a, b) AS v, round(max(dist), 6) AS distance FROM kn GROUP BY 1, 2")
def knn_graph(s: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.knn_graph(vertices(s, d), NEIGHBOURS))


@query(_knn + " SELECT round(avg(dist), 6) AS mean_distance, count(*) AS points FROM kn WHERE rank = 1")
def mean_nn_distance(s: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.mean_nearest_distance(vertices(s, d)))


@query(_knn + """, sp AS (SELECT a AS id, dist AS spacing FROM kn WHERE rank = 1)
SELECT k.a AS u, k.b AS v, round(k.dist, 6) AS distance, k.al AS u_label, k.bl AS v_label FROM kn k JOIN kn m ON m.a = k.b AND m.b = k.a JOIN sp p ON p.id = k.a JOIN sp q ON q.id = k.b WHERE k.a < k.b AND k.al <> k.bl AND k.dist <= 2.5 * least(p.spacing, q.spacing)""")
def mutual_knn_contacts(s: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.mutual_contacts(vertices(s, d), NEIGHBOURS))


_pieces = """, pc AS (SELECT * FROM (SELECT label AS owner, x AS ax, y AS ay, z AS az, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(z) OVER w AS bz FROM vertices WINDOW w AS (PARTITION BY label ORDER BY id)) WHERE bx IS NOT NULL),
pt AS (SELECT v.id, p.owner, v.x-ax AS px, v.y-ay AS py, v.z-az AS pz, bx-ax AS ux, by_-ay AS uy, bz-az AS uz FROM vertices v, pc p),
pd AS (SELECT id, owner, sqrt(pow(px-ux*t,2)+pow(py-uy*t,2)+pow(pz-uz*t,2)) AS dist FROM (SELECT *, greatest(0.0, least(1.0, (px*ux+py*uy+pz*uz) / (ux*ux+uy*uy+uz*uz))) AS t FROM pt)),
po AS (SELECT id, owner, min(dist) AS dist FROM pd WHERE dist <= 0.15 GROUP BY ALL), pk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, owner) AS rank FROM po),
two AS (SELECT id, max(CASE WHEN rank = 1 THEN owner END) AS owner, max(CASE WHEN rank = 1 THEN dist END) AS distance, max(CASE WHEN rank = 2 THEN owner END) AS rival, max(CASE WHEN rank = 2 THEN dist END) AS rival_distance FROM pk GROUP BY id)
"""


def _owner_pieces(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("label").orderBy("id")
    v = vertices(s, d)
    p = v.select(F.col("label").alias("owner"), F.col("id").alias("seg_id"), *(F.col(a).alias(f"a{a}") for a in "xyz"), *(F.lead(a).over(w).alias(f"b{a}") for a in "xyz"))
    return p.filter("bx is not null")


@query(with_sql("vertices") + _pieces + "SELECT id, owner, round(distance, 6) AS distance, rival, round(rival_distance, 6) AS rival_distance, CAST(CASE WHEN rival_distance - distance <= 0.02 THEN -2 ELSE owner END AS INTEGER) AS label FROM two")
def nearest_two_owners(s: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.assign(spatial.nearest_two_owners(vertices(s, d), _owner_pieces(s, d), 0.15), 0.02))


@query(with_sql("vertices") + "SELECT v.id, round((v.x - f.lx) / f.e, 6) AS x, round((v.y - f.ly) / f.e, 6) AS y, round((v.z - f.lz) / f.e, 6) AS z FROM vertices v, (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS e FROM vertices) f")
def unit_box(s: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.unit_box(vertices(s, d)))


@query(with_sql("vertices") + "SELECT id, CASE WHEN sqrt(pow(x-0.05,2)+pow(y-0.05,2)+pow(z-0.05,2)) <= 0.15 THEN (x-0.05)*0.6 + (y-0.05)*0.0 + (z-0.05)*-0.8 < 0 ELSE -(z-0.05) < 0 END AS above FROM vertices")
def above_base_mask(s: SparkSession, d: str) -> DataFrame:
    return spatial.above_base(vertices(s, d), (0.05, 0.05, 0.05), (0.6, 0.0, -0.8), 0.15)


@query(with_sql("vertices") + ", h AS (SELECT CAST(least(floor((max(z) OVER () - z) / (max(z) OVER () - min(z) OVER ()) * 10), 9) AS INTEGER) AS bin FROM vertices) SELECT CAST(b.bin AS INTEGER) AS bin, count(h.bin) AS points FROM range(10) b(bin) LEFT JOIN h ON h.bin = b.bin GROUP BY 1")
def depth_histogram(s: SparkSession, d: str) -> DataFrame:
    return spatial.depth_histogram(vertices(s, d))


# Trees


@query(with_sql("current", "walk", "up", recursive=True) + ", o AS (SELECT sample_id, k, max(links) AS links FROM up WHERE here = 'primary' GROUP BY ALL) SELECT c.sample_id, c.root_id, CAST(o.links AS BIGINT) AS tree_order FROM current c LEFT JOIN o ON o.sample_id = c.sample_id AND o.k = c.k AND NOT EXISTS (SELECT 1 FROM current m WHERE m.sample_id = c.sample_id AND m.k = 'primary' AND m.p IS NOT NULL AND EXISTS (SELECT 1 FROM current q WHERE q.sample_id = m.sample_id AND q.k = m.p))")
def tree_orders(s: SparkSession, d: str) -> DataFrame:
    return tree.orders(table(s, d, "roots"))


_good = ", ends AS (SELECT sample_id, k FROM current c WHERE p IS NULL OR NOT EXISTS (SELECT 1 FROM current m WHERE m.sample_id = c.sample_id AND m.k = c.p)), good AS (SELECT DISTINCT u.sample_id, u.k FROM up u JOIN ends e ON e.sample_id = u.sample_id AND e.k = u.here)"


@query(with_sql("current", "walk", "up", recursive=True) + _good + " SELECT c.sample_id, c.root_id, CAST(count(DISTINCT u.k) - 1 AS BIGINT) AS descendants FROM current c JOIN good USING (sample_id, k) JOIN up u ON u.sample_id = c.sample_id AND u.here = c.k GROUP BY c.sample_id, c.root_id")
def tree_descendants(s: SparkSession, d: str) -> DataFrame:
    return tree.descendants(table(s, d, "roots"))


@query(with_sql("current", "walk", "up", recursive=True) + _good + " SELECT u.sample_id, a.root_id AS ancestor_id, c.root_id, CAST(u.links AS BIGINT) AS links FROM up u JOIN good g ON g.sample_id = u.sample_id AND g.k = u.k JOIN current c ON c.sample_id = u.sample_id AND c.k = u.k JOIN current a ON a.sample_id = u.sample_id AND a.k = u.here")
def tree_closure(s: SparkSession, d: str) -> DataFrame:
    return tree.closure(table(s, d, "roots"))


@query(with_sql("current", "walk", "up", recursive=True) + _good + ", off AS (SELECT sample_id, k FROM current WHERE confidence < 0.5) SELECT c.sample_id, c.root_id FROM current c JOIN good USING (sample_id, k) WHERE NOT EXISTS (SELECT 1 FROM up u JOIN off o ON o.sample_id = u.sample_id AND o.k = u.here WHERE u.sample_id = c.sample_id AND u.k = c.k)")
def prune_subtrees(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "roots")
    now = t.groupBy("sample_id", normal_key("root_id").alias("key")).agg(F.max(F.struct("recorded_at", "root_id", "confidence")).alias("n"))
    return tree.prune(t, now.filter("n.confidence < 0.5").select("sample_id", "n.root_id"))


_checked = HIERARCHY.rstrip() + ", " + SQL["current"] + """
, rep AS (SELECT sample_id, arg_max(root_id, recorded_at) AS root_id FROM (SELECT DISTINCT sample_id, root_id, lower(regexp_replace(root_id, '^\\s+|\\s+$', '', 'g')) AS k, lower(regexp_replace(parent_id, '^\\s+|\\s+$', '', 'g')) AS p, root_order, insertion_index, recorded_at FROM roots) GROUP BY sample_id, k HAVING count(*) > 1)
"""


@query(_checked + """SELECT sample_id, root_id, 'repeated_id' AS breach FROM rep
UNION ALL SELECT c.sample_id, c.root_id, 'unknown_parent' FROM current c WHERE c.p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM current m WHERE m.sample_id = c.sample_id AND m.k = c.p)
UNION ALL SELECT c.sample_id, c.root_id, 'order' FROM current c JOIN current m ON m.sample_id = c.sample_id AND m.k = c.p WHERE c.root_order <> m.root_order + 1
UNION ALL SELECT sample_id, root_id, 'no_insertion' FROM current WHERE p IS NOT NULL AND insertion_index IS NULL
UNION ALL SELECT sample_id, root_id, CASE finding WHEN 'cycle' THEN 'cycle' ELSE 'unreachable' END FROM x WHERE finding IN ('cycle', 'detached')""")
def tree_violations(s: SparkSession, d: str) -> DataFrame:
    return tree.violations(table(s, d, "roots"))


@query(with_sql("current", "walk", "up", recursive=True) + _good + """, kk AS (SELECT sample_id, k, root_id, lpad(coalesce(CAST(insertion_index AS VARCHAR), '9999999999'), 10, '0') || ':' || k AS key FROM current),
l AS (SELECT u.sample_id, u.k, max(u.links) AS depth, arg_max(u.here, u.links) AS top, list(kk.key ORDER BY u.links DESC) AS line FROM up u JOIN good USING (sample_id, k) JOIN kk ON kk.sample_id = u.sample_id AND kk.k = u.here GROUP BY u.sample_id, u.k)
SELECT l.sample_id, kk.root_id, CASE WHEN depth = 0 THEN kk.root_id ELSE format('root-o{}-{:03d}', depth, row_number() OVER (PARTITION BY l.sample_id, depth ORDER BY line, kk.root_id)) END AS stable_id FROM l JOIN kk ON kk.sample_id = l.sample_id AND kk.k = l.k WHERE top = 'primary'""")
def stable_ids(s: SparkSession, d: str) -> DataFrame:
    return tree.stable_ids(table(s, d, "roots"))


@query(_checked + """, q AS (SELECT x.sample_id, x.root_id, m.root_id AS old_parent_id, row_number() OVER (PARTITION BY x.sample_id, x.top_root_id ORDER BY c.confidence, c.root_id) AS rn FROM x JOIN current c ON c.sample_id = x.sample_id AND c.root_id = x.root_id JOIN current m ON m.sample_id = c.sample_id AND m.k = c.p WHERE x.finding = 'cycle')
SELECT sample_id, root_id, old_parent_id, 'primary' AS new_parent_id FROM q WHERE rn = 1""")
def cycle_repairs(s: SparkSession, d: str) -> DataFrame:
    return tree.repair_cycles(table(s, d, "roots"))


# Edit logs and texts


@query(r"""WITH k AS (SELECT DISTINCT session_id, baseline_fingerprint FROM label_map), o AS (SELECT o.*, lower(trim(event)) AS e, CASE WHEN lower(trim(event)) = 'apply' THEN operation_id ELSE target_operation_id END AS oid FROM ops o SEMI JOIN k USING (session_id, baseline_fingerprint)),
a AS (SELECT session_id, oid, min(sequence) FILTER (e = 'apply') AS t, arg_min(type, sequence) FILTER (e = 'apply') AS type, max(sequence) FILTER (e <> 'apply') AS ut, arg_max(e, sequence) FILTER (e <> 'apply') AS ue FROM o WHERE oid IS NOT NULL GROUP BY ALL)
SELECT session_id, oid AS operation_id, t, type FROM a WHERE t IS NOT NULL AND (ut IS NULL OR ue = 'redo' OR ut < t)""")
def ops_in_force(s: SparkSession, d: str) -> DataFrame:
    return changes.in_force(table(s, d, "ops"), table(s, d, "label_map")).select("session_id", "operation_id", "t", "type")


@query("SELECT session_id, arguments['root_id'] AS root_id, min({'s': sequence, 't': type}).t AS first_type, min(sequence) AS first_sequence FROM ops WHERE lower(trim(event)) = 'apply' AND arguments['root_id'] IS NOT NULL GROUP BY ALL")
def first_touch(s: SparkSession, d: str) -> DataFrame:
    """The earliest operation on each root (the value that a compound change keeps)."""
    o = table(s, d, "ops").filter(normal_key("event") == "apply").withColumn("root_id", F.col("arguments")["root_id"]).filter("root_id is not null")
    return o.groupBy("session_id", "root_id").agg(F.min(F.struct("sequence", "type")).alias("m")).select("session_id", "root_id", F.col("m.type").alias("first_type"), F.col("m.sequence").alias("first_sequence"))


@query("SELECT sample_id, root_id, recorded_at, array_to_string(list_sort(qc_flags), ';') AS flags FROM roots WHERE qc_flags IS NOT NULL")
def flag_texts(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "roots").filter("qc_flags is not null")
    return t.select("sample_id", "root_id", F.col("recorded_at"), tx.join_flags(F.array_sort("qc_flags")).alias("flags"))


@query("SELECT sample_id, CAST(date_trunc('day', measured_at) AS DATE) AS day, count(*) AS n FROM traits GROUP BY ALL")
def measurements_by_day(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "traits").groupBy("sample_id", F.col("measured_at").cast("date").alias("day")).agg(F.count("*").alias("n"))


# Ownership and kernels, one specimen per label of the vertices


@query(with_sql("vertices") + _pieces + """, lab AS (SELECT v.id, CAST(CASE WHEN t.owner IS NULL THEN -1 WHEN t.rival_distance - t.distance <= 0.02 THEN -2 ELSE t.owner END AS INTEGER) AS label FROM vertices v LEFT JOIN two t ON t.id = v.id)
SELECT count(*) AS vertices, count(*) FILTER (label = 0) AS "primary", count(*) FILTER (label > 0) AS lateral, count(*) FILTER (label = -1) AS unassigned, count(*) FILTER (label = -2) AS uncertain, count(*) FILTER (label <= -3) AS other FROM lab""")
def assignment_summary(s: SparkSession, d: str) -> DataFrame:
    from arborline.operators import ownership

    v = vertices(s, d)
    two = spatial.assign(spatial.nearest_two_owners(v, _owner_pieces(s, d), 0.15), 0.02)
    return ownership.assignment_summary(v.select("id").join(two.select("id", "label"), "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label")))


@query()
def component_volumes(s: SparkSession, d: str) -> DataFrame:
    return rounded(mesh.component_volumes(faces(s, d), vertices(s, d)), 4)


def _kernel(s: SparkSession, d: str, kernel: Callable, schema: str) -> DataFrame:
    from arborline.operators.kernels import grouped

    return grouped(vertices(s, d), "label", kernel, schema)


def _sorted(pdf):
    pdf = pdf.sort_values("id", ignore_index=True)
    return pdf, pdf[["x", "y", "z"]].to_numpy()


@query()
def shortest_path(s: SparkSession, d: str) -> DataFrame:
    """The path from the highest to the lowest vertex of each specimen over its neighbour graph."""

    def run(pdf):
        import pandas as pd

        from arborline.operators import kernels

        pdf, p = _sorted(pdf)
        path = kernels.path_between(p, int(p[:, 2].argmax()), int(p[:, 2].argmin()), 6)
        return pd.DataFrame({"place": range(len(path)), "id": pdf["id"].to_numpy()[path]})

    return _kernel(s, d, run, "place long, id long")


@query()
def cluster_density(s: SparkSession, d: str) -> DataFrame:
    def run(pdf):
        from arborline.operators import kernels

        pdf, p = _sorted(pdf)
        return pdf[["id"]].assign(cluster=kernels.density_clusters(p, 5))

    return _kernel(s, d, run, "id long, cluster long")


@query()
def convex_hull(s: SparkSession, d: str) -> DataFrame:
    """Depth, width and hull volume of each specimen."""

    def run(pdf):
        import pandas as pd

        from arborline.operators import kernels

        _, p = _sorted(pdf)
        return pd.DataFrame([(float(p[:, 2].max() - p[:, 2].min()), kernels.hull_width(p[:, :2]), kernels.hull_volume(p))], columns=["depth", "width", "volume"])

    return rounded(_kernel(s, d, run, "depth double, width double, volume double"))


@query("WITH RECURSIVE " + with_sql("vertices")[5:] + """, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY z DESC, id) AS k FROM vertices),
st AS (SELECT label, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[]) AS kept FROM vertices GROUP BY label
 UNION ALL SELECT st.label, r.k, CASE WHEN len(st.kept) < 10 AND len(list_filter(st.kept, lambda c: sqrt((c.x-r.x)*(c.x-r.x)+(c.y-r.y)*(c.y-r.y)+(c.z-r.z)*(c.z-r.z)) < 0.1)) = 0 THEN list_append(st.kept, {'id': r.id, 'x': r.x, 'y': r.y, 'z': r.z}) ELSE st.kept END FROM st JOIN r ON r.label = st.label AND r.k = st.k + 1),
f AS (SELECT label, arg_max(kept, k) AS kept FROM st GROUP BY label)
SELECT CAST(label AS INTEGER) AS label, CAST(i - 1 AS BIGINT) AS place, kept[i].id AS id FROM (SELECT label, kept, unnest(range(1, len(kept) + 1)) AS i FROM f)""")
def distinct_top(s: SparkSession, d: str) -> DataFrame:
    """The highest vertices that keep a distance from each other."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        from arborline.operators import kernels

        pdf, p = _sorted(pdf)
        keep = kernels.spread_out(p, np.lexsort((pdf["id"], -p[:, 2])), 10, 0.1)
        return pd.DataFrame({"place": range(len(keep)), "id": pdf["id"].to_numpy()[keep]})

    return _kernel(s, d, run, "place long, id long")


@query("WITH RECURSIVE " + with_sql("vertices")[5:] + """, sup AS (SELECT a.label, a.id, list(b.id) AS s FROM vertices a JOIN vertices b ON a.label = b.label AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 0.15 GROUP BY a.label, a.id),
st AS (SELECT label, CAST(-1 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS support, CAST([] AS BIGINT[]) AS used FROM vertices GROUP BY label
 UNION ALL SELECT st.label, st.place + 1, f.id, f.n, list_distinct(list_concat(st.used, f.s)) FROM st JOIN LATERAL (SELECT id, s, n FROM (SELECT id, s, len(s) AS n, len(list_filter(s, lambda x: NOT list_contains(st.used, x))) AS new FROM sup WHERE sup.label = st.label) WHERE new > 0 AND new - 1.25 * (n - new) > 0 ORDER BY new - 1.25 * (n - new) DESC, id LIMIT 1) f ON true)
SELECT CAST(label AS INTEGER) AS label, place, id, support FROM st WHERE place >= 0""")
def greedy_selection(s: SparkSession, d: str) -> DataFrame:
    """Balls around the vertices of a specimen as candidates, selected by weighted greedy cover."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        from arborline.operators import kernels

        pdf, p = _sorted(pdf)
        supports = [set(np.flatnonzero(np.linalg.norm(p - q, axis=1) <= 0.15).tolist()) for q in p]
        chosen = kernels.greedy_cover(supports, np.zeros(len(p)), 0.05)
        return pd.DataFrame({"place": range(len(chosen)), "id": pdf["id"].to_numpy()[chosen], "support": [len(supports[i]) for i in chosen]})

    return _kernel(s, d, run, "place long, id long, support long")


@query()
def primary_rank(s: SparkSession, d: str) -> DataFrame:
    def run(pdf):
        from arborline.operators import kernels

        pdf, p = _sorted(pdf)
        out = kernels.rank_primaries(p)
        return out.assign(start=pdf["id"].to_numpy()[out["start"].to_numpy(int)], end=pdf["id"].to_numpy()[out["end"].to_numpy(int)])

    return rounded(_kernel(s, d, run, "start long, end long, length double, down double, straight double, score double, rank long"))


@query()
def grown_paths(s: SparkSession, d: str) -> DataFrame:
    """Paths grown downwards from the highest vertex of each specimen."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        from arborline.operators import kernels

        pdf, p = _sorted(pdf)
        path = kernels.grow_path(p, int(p[:, 2].argmax()), np.array([0.0, 0.0, -1.0]), 0.08)
        return pd.DataFrame({"place": range(len(path)), "id": pdf["id"].to_numpy()[path]})

    return _kernel(s, d, run, "place long, id long")


@query("SELECT event_type, time_bucket(INTERVAL '5 minutes', ts) AS from_ts, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(s: SparkSession, d: str) -> DataFrame:
    """Events per five minutes (tumbling), the batch form of the streaming operator."""
    from arborline.streaming import edits

    e = table(s, d, "events")
    return edits.windows(e, slide="5 minutes").select("event_type", F.col("from_ts").cast(e.schema["ts"].dataType).alias("from_ts"), "n", F.round("total", 6).alias("total"))

"""Queries of the tracing, ownership, review and file operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborline.common import normal_key, table
from arborline.functions import geometry as g
from arborline.functions import text as tx
from arborline.operators import architecture, mesh, ownership, polyline, spatial, tracing, tree
from arborline.operators.hierarchy import current_links
from arborline.plans.catalogue import NEIGHBOURS, REACH, WINDOW, _good, _owner_pieces, _pieces, _window, rounded
from arborline.plans.views import faces, nodes, traits, vertices, with_sql
from arborline.sources import files, guides

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Neighbourhoods and masks


@query(with_sql("vertices") + "SELECT a.id AS a_id, b.id AS b_id, round(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2)), 6) AS distance FROM vertices a JOIN vertices b ON a.id < b.id AND sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2)) <= 0.1")
def radius_pairs(s: SparkSession, d: str) -> DataFrame:
    v = vertices(s, d)
    return rounded(spatial.within(v.withColumnRenamed("id", "a_id"), v.withColumnRenamed("id", "b_id"), REACH).filter("a_id < b_id"))


@query(with_sql("vertices") + """, n AS (SELECT id AS node_id, x, y, z, 0.03 + abs(z) / 10 AS radius FROM vertices WHERE label = 0),
q AS (SELECT v.id, n.radius, sqrt(pow(v.x-n.x,2)+pow(v.y-n.y,2)+pow(v.z-n.z,2)) AS distance, row_number() OVER (PARTITION BY v.id ORDER BY sqrt((v.x-n.x)*(v.x-n.x)+(v.y-n.y)*(v.y-n.y)+(v.z-n.z)*(v.z-n.z)), n.node_id) AS rn FROM vertices v, n)
SELECT id, distance <= radius + 0.02 AS inside FROM q WHERE rn = 1""")
def tube_membership(s: SparkSession, d: str) -> DataFrame:
    """Which vertices lie in the tube of the main axis (label 0)."""
    v = vertices(s, d)
    axis = v.filter("label = 0").select(F.col("id").alias("node_id"), "x", "y", "z", (0.03 + F.abs("z") / 10).alias("radius"))
    return tracing.tube_mask(v, axis, 0.01)


_limits = """, r AS (SELECT root_id, node_id, y / 10 AS radius FROM nodes), p AS (SELECT root_id, quantile_cont(radius, 0.99) AS p99 FROM r GROUP BY root_id)
SELECT r.root_id, r.node_id, round(greatest(0.28, radius + 0.18, CASE WHEN radius <= 0.32 AND p99 <= 0.36 THEN 2 * radius + 0.04 ELSE 0 END), 6) AS near FROM r JOIN p USING (root_id)"""


@query(with_sql("nodes") + _limits)
def seed_distance_limits(s: SparkSession, d: str) -> DataFrame:
    r = nodes(s, d).select("root_id", "node_id", (F.col("y") / 10).alias("radius"))
    return rounded(tracing.seed_limits(r, 0.02, ["root_id"]))


@query(with_sql("vertices") + """, p AS (SELECT id AS b, x, y, z FROM vertices WHERE label = 0),
w AS (SELECT v.label, v.id, v.x, v.y, v.z, p.b, p.x AS px, p.y AS py, p.z AS pz, sqrt(pow(v.x-p.x,2)+pow(v.y-p.y,2)+pow(v.z-p.z,2)) AS dist FROM vertices v JOIN p ON sqrt(pow(v.x-p.x,2)+pow(v.y-p.y,2)+pow(v.z-p.z,2)) <= 0.12),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, b) AS rn FROM w) WHERE rn = 1),
a AS (SELECT v.label, v.id, m.b, CASE WHEN m.b IS NOT NULL THEN degrees(acos(least(1.0, abs(m.x*px + m.y*py + m.z*pz) / (sqrt(m.x*m.x+m.y*m.y+m.z*m.z) * sqrt(px*px+py*py+pz*pz))))) END AS angle FROM vertices v LEFT JOIN m ON m.id = v.id)
SELECT CAST(label AS INTEGER) AS candidate_id, round(count(b) / count(*), 6) AS share_within, round(avg(angle), 4) AS mean_alignment, count(b) / count(*) >= 0.8 AND coalesce(avg(angle) <= 30, false) AS copy FROM a GROUP BY label""")
def tracking_copy_review(s: SparkSession, d: str) -> DataFrame:
    """Each label's vertices as a path held against the main axis; the places stand for tangents."""
    v = vertices(s, d)
    c = v.select(F.col("label").alias("candidate_id"), F.col("id").alias("node_id"), "x", "y", "z", *(F.col(a).alias(f"t{a}") for a in "xyz"))
    out = tracing.tracking_copies(c, c.filter("candidate_id = 0").drop("candidate_id"), 0.01)
    return out.select("candidate_id", F.round("share_within", 6).alias("share_within"), F.round("mean_alignment", 4).alias("mean_alignment"), "copy")


# Profiles


@query("""WITH k AS (SELECT event_type, CAST(value AS DOUBLE) AS value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value) AS k FROM events)
SELECT event_type AS step, round(quantile_cont(value, 0.5), 6) AS seconds, count(*) AS runs FROM k WHERE k <= 50 GROUP BY event_type""")
def step_medians(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("event_type").alias("step"), F.col("ts").alias("ended_at"), F.col("value").cast("double").alias("seconds"))
    return rounded(tracing.step_times(e))


@query(with_sql("nodes") + """, n AS (SELECT root_id, node_id, CASE WHEN y > 3 THEN x END AS x FROM nodes),
f AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN node_id END IGNORE NULLS) OVER a AS bp, last_value(x IGNORE NULLS) OVER a AS bv, first_value(CASE WHEN x IS NOT NULL THEN node_id END IGNORE NULLS) OVER c AS ap, first_value(x IGNORE NULLS) OVER c AS av FROM n
 WINDOW a AS (PARTITION BY root_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY root_id ORDER BY node_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT root_id, node_id, round(coalesce(x, bv + (av - bv) * (node_id - bp) / (ap - bp), bv, av), 6) AS x FROM f""")
def filled_profile(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d).select("root_id", "node_id", F.when(F.col("y") > 3, F.col("x")).alias("x"))
    return rounded(polyline.fill_linear(n, "x", "node_id").select("root_id", "node_id", "x"))


_minute = "CAST(extract(minute FROM ts) AS INTEGER)"


@query(f"""WITH e AS (SELECT CAST(user_id AS BIGINT) AS root_id, {_minute} AS node_id, CAST(value AS DOUBLE) AS distance FROM events),
q AS (SELECT root_id, node_id, CASE WHEN count(*) >= 3 THEN quantile_cont(distance, 0.7) END AS radius FROM e GROUP BY ALL),
f AS (SELECT *, last_value(CASE WHEN radius IS NOT NULL THEN node_id END IGNORE NULLS) OVER a AS bp, last_value(radius IGNORE NULLS) OVER a AS bv, first_value(CASE WHEN radius IS NOT NULL THEN node_id END IGNORE NULLS) OVER c AS ap, first_value(radius IGNORE NULLS) OVER c AS av FROM q
 WINDOW a AS (PARTITION BY root_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY root_id ORDER BY node_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
h AS (SELECT root_id, node_id, coalesce(radius, bv + (av - bv) * (node_id - bp) / (ap - bp), bv, av) AS r FROM f),
m AS (SELECT root_id, node_id, quantile_cont(r, 0.5) OVER (PARTITION BY root_id ORDER BY node_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS r FROM h)
SELECT root_id, node_id, round(greatest(r, 0.5), 8) AS radius FROM m""")
def parent_radius_profile(s: SparkSession, d: str) -> DataFrame:
    """Distances of supporting points by node (values by user and minute) as a radius profile."""
    e = table(s, d, "events").select(F.col("user_id").cast("long").alias("root_id"), F.minute("ts").alias("node_id"), F.col("value").cast("double").alias("distance"))
    return rounded(ownership.parent_radii(e, 0.2, ["root_id"]), 8)


@query("""WITH o AS (SELECT CAST(user_id AS BIGINT) AS root_id, CAST(extract(hour FROM ts) AS INTEGER) AS station, CAST(value AS DOUBLE) - 50 AS u, CAST(event_id % 101 AS DOUBLE) - 50 AS v FROM events),
t AS (SELECT *, atan2(v, u) AS turn FROM o), n AS (SELECT *, coalesce(lead(turn) OVER (PARTITION BY root_id, station ORDER BY turn), min(turn) OVER (PARTITION BY root_id, station) + 2 * pi()) AS next FROM t)
SELECT root_id, station, CASE WHEN count(*) >= 3 AND max(next - turn) <= pi() THEN round(quantile_cont(sqrt(u*u + v*v), 0.65), 6) END AS radius, round(max(next - turn), 6) AS gap FROM n GROUP BY ALL""")
def station_radius(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    o = e.select(F.col("user_id").cast("long").alias("root_id"), F.hour("ts").alias("station"), (F.col("value").cast("double") - 50).alias("u"), (F.pmod("event_id", F.lit(101)).cast("double") - 50).alias("v"))
    return rounded(ownership.station_radii(o, ["root_id"]))


@query(with_sql("nodes", "arcs") + """, h AS (SELECT root_id, lead(arc) OVER w - arc AS h, (0.5 + y / 20 + lead(0.5 + y / 20) OVER w) / 2 AS r FROM arcs WINDOW w AS (PARTITION BY root_id ORDER BY arc, node_id))
SELECT root_id, round(CASE WHEN sum(h) > 0 THEN sum(h * r) / sum(h) END, 6) AS radius FROM h WHERE h IS NOT NULL GROUP BY root_id""")
def arc_mean_radius(s: SparkSession, d: str) -> DataFrame:
    p = polyline.with_arc(nodes(s, d)).select("root_id", "arc", (0.5 + F.col("y") / 20).alias("radius"))
    return rounded(ownership.arc_weighted_radius(p, ["root_id"]))


@query(with_sql("nodes", "arcs") + """, b AS (SELECT root_id, arc AS low, lead(arc) OVER w AS high, 0.5 + y / 20 AS r0, lead(0.5 + y / 20) OVER w AS r1 FROM arcs WINDOW w AS (PARTITION BY root_id ORDER BY node_id)),
s AS (SELECT root_id, high - low AS h, least(r0, r1) AS lo, greatest(r0, r1) AS hi FROM b WHERE high > low), tot AS (SELECT root_id, sum(h) AS total FROM s GROUP BY root_id),
cuts AS (SELECT DISTINCT root_id, r FROM (SELECT root_id, lo AS r FROM s UNION ALL SELECT root_id, hi FROM s)),
cdf AS (SELECT c.root_id, c.r, sum(CASE WHEN s.hi <= c.r THEN s.h WHEN s.lo >= c.r THEN 0 ELSE s.h * (c.r - s.lo) / (s.hi - s.lo) END) / any_value(t.total) AS below, sum(CASE WHEN s.lo = s.hi AND s.hi = c.r THEN s.h ELSE 0 END) / any_value(t.total) AS flat FROM cuts c JOIN s USING (root_id) JOIN tot t USING (root_id) GROUP BY ALL),
n AS (SELECT root_id, r, below, lag(r) OVER w AS r0, lag(below) OVER w AS b0, flat FROM cdf WINDOW w AS (PARTITION BY root_id ORDER BY r)),
k AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY r) AS rn FROM n WHERE below >= 0.5 - 1e-12)
SELECT root_id, round(CASE WHEN r0 IS NULL OR below - flat <= 0.5 OR below - flat = b0 THEN r ELSE r0 + (r - r0) * (0.5 - b0) / (below - flat - b0) END, 6) AS radius FROM k WHERE rn = 1""")
def arc_median_radius(s: SparkSession, d: str) -> DataFrame:
    """The radius that half of each polyline's length does not exceed."""
    p = polyline.with_arc(nodes(s, d)).select("root_id", "node_id", "arc", (0.5 + F.col("y") / 20).alias("radius"))
    return rounded(ownership.arc_median_radius(p, ["root_id"]))


@query(with_sql("nodes", "arcs") + """, l AS (SELECT root_id, sum(step) AS length, sqrt(pow(arg_max(x, node_id) - arg_min(x, node_id), 2) + pow(arg_max(y, node_id) - arg_min(y, node_id), 2) + pow(arg_max(z, node_id) - arg_min(z, node_id), 2)) AS chord, count(*) AS n FROM arcs GROUP BY root_id),
f AS (SELECT root_id, 0.5 + y / 20 AS r0, 0.5 + lead(y) OVER w / 20 AS r1, lead(step) OVER w AS h FROM arcs WINDOW w AS (PARTITION BY root_id ORDER BY node_id)),
v AS (SELECT root_id, sum(pi() * (r0 + r1) * sqrt(h*h + (r1-r0)*(r1-r0))) AS a, sum(pi() * h * (r0*r0 + r0*r1 + r1*r1) / 3) AS v, sum(h * (r0 + r1) / 2) / nullif(sum(h), 0) AS m FROM f GROUP BY root_id)
SELECT l.root_id, CAST(l.root_id % 4 AS INTEGER) AS root_order, round(length * 2, 4) AS length, round(chord * 2, 4) AS chord, round(CASE WHEN chord > 0 THEN length / chord END, 4) AS tortuosity, round(m * 4, 4) AS mean_diameter, round(a * 4, 3) AS lateral_area, round(v * 8, 3) AS volume,
 CASE WHEN l.root_id % 7 = 0 THEN 'excluded' WHEN NOT length > 0 THEN 'unavailable' WHEN (l.root_id % 3) >= 1 THEN 'complete' ELSE 'partial' END AS length_measurement_status, l.root_id % 7 <> 0 AND length > 0 AS length_measurement_eligible,
 CASE WHEN l.root_id % 7 = 0 THEN 'noise' WHEN NOT length > 0 THEN 'no_length' WHEN (l.root_id % 3) >= 1 THEN NULL ELSE 'short_support' END AS length_measurement_reason FROM l JOIN v USING (root_id)""")
def root_trait_table(s: SparkSession, d: str) -> DataFrame:
    """The per-root trait table of the polylines, at two mm per unit."""
    n = nodes(s, d).withColumn("radius", 0.5 + F.col("y") / 20)
    roots = n.select("root_id").distinct().select("root_id", F.pmod("root_id", F.lit(4)).cast("int").alias("root_order"), (F.pmod("root_id", F.lit(7)) == 0).alias("excluded"))
    support = roots.select("root_id", F.pmod("root_id", F.lit(3)).cast("double").alias("supported"))
    t = tracing.root_traits(n, roots, support, 2.0)
    digits = {"lateral_area": 3, "volume": 3}
    return t.select(*(F.round(c, digits.get(c, 4)).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes))


_starts = _window.replace("SELECT root_id, total - least(40.0, total * 0.25) AS low, total AS high", "SELECT root_id, CAST(0.0 AS DOUBLE) AS low, least(40.0, total * 0.25) AS high")


def _angle(x: str, y: str, z: str) -> str:
    n = f"sqrt(pow({x},2) + pow({y},2) + pow({z},2))"
    return f"CASE WHEN {n} > 1e-12 THEN round(degrees(acos(greatest(-1.0, least(1.0, -({z}) / {n})))), 4) END"


@query(_starts + "SELECT root_id, " + _angle("hx-lx", "hy-ly", "hz-lz") + " AS base_gravity, " + _angle("hx-lx", "hy-ly", "hz-lz") + " AS emergence FROM w WHERE hx IS NOT NULL")
def root_angles(s: SparkSession, d: str) -> DataFrame:
    """Angles at the base of each polyline, against gravity and against a parent that goes straight down."""
    n = nodes(s, d)
    down = n.select("root_id").distinct().select("root_id", F.lit(0.0).alias("px"), F.lit(0.0).alias("py"), F.lit(-1.0).alias("pz"))
    return rounded(polyline.root_angles(n, WINDOW, down).select("root_id", "base_gravity", "emergence"), 4).filter("base_gravity is not null")


@query(with_sql("latest") + """, sc AS (SELECT sample_id, el, ed, unnest(list_filter(['system', CASE WHEN root_order > 0 THEN 'laterals' END, CASE WHEN root_order IS NOT NULL THEN 'order_' || root_order END], lambda x: x IS NOT NULL)) AS scope FROM latest),
m AS (SELECT sample_id, scope, 'length' AS metric, el AS v FROM sc UNION ALL SELECT sample_id, scope, 'mean_diameter', ed FROM sc)
SELECT sample_id, scope, metric, count(*) AS roots, count(v) AS eligible, round(sum(v), 9) AS total, round(avg(v), 9) AS mean, round(stddev_samp(v) / avg(v), 9) AS variation, round(quantile_cont(v, 0.1), 9) AS p10, round(quantile_cont(v, 0.5), 9) AS p50, round(quantile_cont(v, 0.9), 9) AS p90, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 9) AS iqr FROM m GROUP BY ALL""")
def metric_rollup(s: SparkSession, d: str) -> DataFrame:
    t = traits(s, d, "root_order", "length", "length_measurement_status", "mean_diameter", "mean_diameter_measurement_status")
    return rounded(architecture.metric_rollup(t, ["sample_id"]), 9)


# Decisions


@query("""WITH c AS (SELECT l_orderkey AS root_id, l_partkey AS parent_id, l_linenumber AS e, CAST(l_discount AS DOUBLE) AS gap, least(CAST(l_tax AS DOUBLE) * 5, 1.0) AS separation, l_linestatus = 'O' AS preferred FROM lineitem),
k AS (SELECT *, gap / 0.05 + 0.25 * (1 - separation) - CASE WHEN preferred THEN 0.45 ELSE 0.0 END AS cost FROM c),
b AS (SELECT root_id, min({'cost': cost, 'parent_id': parent_id, 'e': e, 'gap': gap}) AS b FROM k GROUP BY root_id)
SELECT root_id, b.parent_id AS parent_id, b.e AS "end", round(b.cost, 6) AS cost, b.gap <= 0.05 AS attached FROM b""")
def attachment_choice(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("root_id"), F.col("l_partkey").alias("parent_id"), F.col("l_linenumber").alias("end"), F.col("l_discount").cast("double").alias("gap"),
        F.least(F.col("l_tax").cast("double") * 5, F.lit(1.0)).alias("separation"), (F.col("l_linestatus") == "O").alias("preferred"),
    )
    return rounded(ownership.best_attachment(c, 0.05))


@query(with_sql("vertices") + _pieces + """, lab AS (SELECT id, owner, rival, CASE WHEN rival_distance - distance <= 0.02 THEN -2 ELSE owner END AS label, distance * 10 AS arc FROM two),
r AS (SELECT DISTINCT label, label - 1 AS parent, 0.4 + label / 40.0 AS body_start FROM vertices WHERE label > 0),
n AS (SELECT l.id, min(r.parent) AS parent FROM lab l JOIN r ON ((l.owner = r.label AND l.rival = r.parent) OR (l.rival = r.label AND l.owner = r.parent)) AND l.arc <= r.body_start WHERE l.label = -2 GROUP BY l.id)
SELECT l.id, CAST(coalesce(n.parent, l.label) AS INTEGER) AS label FROM lab l LEFT JOIN n ON n.id = l.id""")
def junction_resolution(s: SparkSession, d: str) -> DataFrame:
    v = vertices(s, d)
    a = spatial.assign(spatial.nearest_two_owners(v, _owner_pieces(s, d), 0.15), 0.02).withColumn("arc", F.col("distance") * 10)
    r = v.filter("label > 0").select("label").distinct().select("label", (F.col("label") - 1).alias("parent"), (0.4 + F.col("label") / 40.0).alias("body_start"))
    return ownership.resolve_junctions(a, r).select("id", F.col("label").cast("int").alias("label"))


@query(with_sql("vertices") + """, p AS (SELECT id, label + 1 AS label FROM vertices WHERE x > 0 UNION ALL SELECT id, label + 2 FROM vertices WHERE y > 0.1),
q AS (SELECT id, min(label) AS low, max(label) AS high FROM p GROUP BY id)
SELECT v.id, CAST(CASE WHEN low = high THEN low ELSE v.label END AS INTEGER) AS label, coalesce(low <> high, false) AS withheld FROM vertices v LEFT JOIN q ON q.id = v.id""")
def merged_proposals(s: SparkSession, d: str) -> DataFrame:
    v = vertices(s, d).select("id", "x", "y", "label")
    out, withheld = ownership.merge_proposals(v, v.filter("x > 0").select("id", (F.col("label") + 1).alias("label")), v.filter("y > 0.1").select("id", (F.col("label") + 2).alias("label")))
    return out.join(withheld.withColumn("withheld", F.lit(True)), "id", "left").select("id", F.col("label").cast("int").alias("label"), F.coalesce("withheld", F.lit(False)).alias("withheld"))


@query(with_sql("vertices") + "SELECT id, CAST(label AS INTEGER) AS label, CAST(8 AS INTEGER) AS generation FROM vertices")
def ledger_commit(s: SparkSession, d: str) -> DataFrame:
    """The uncertain vertices (those with x below 0) given back to their recorded owners in one commit."""
    v = vertices(s, d)
    labels = v.select("id", F.when(F.col("x") < 0, F.lit(-2)).otherwise(F.col("label")).alias("label"), F.lit(7).alias("generation"))
    ledger = v.select("id", F.lit(7).alias("generation"), F.array("label", F.col("label") + 1).alias("candidates"))
    out, _ = ownership.commit(labels, ledger, v.filter("x < 0").select(F.col("label").alias("region"), "id", F.col("label").alias("owner")), 7)
    return out.select("id", F.col("label").cast("int").alias("label"), "generation")


@query(with_sql("vertices") + """SELECT id, CASE WHEN label = 3 THEN 'overlap' WHEN x >= 0 THEN 'not_uncertain' WHEN label % 2 = 1 THEN 'not_a_candidate' END AS breach FROM vertices WHERE label = 3 OR x >= 0 OR label % 2 = 1""")
def ledger_breaches(s: SparkSession, d: str) -> DataFrame:
    """Why a commit over all vertices is refused: certain ones, owners that are no candidates, overlapping regions."""
    v = vertices(s, d)
    labels = v.select("id", F.when(F.col("x") < 0, F.lit(-2)).otherwise(F.col("label")).alias("label"), F.lit(7).alias("generation"))
    ledger = v.select("id", F.lit(7).alias("generation"), F.array(F.col("label") + F.pmod("label", F.lit(2))).alias("candidates"))
    region = v.select(F.col("label").alias("region"), "id", F.col("label").alias("owner"))
    return ownership.commit(labels, ledger, region.unionByName(region.filter("owner = 3").withColumn("region", F.lit(99))), 7)[1]


@query(with_sql("vertices") + "SELECT id, CAST(CASE WHEN z > 0.1 THEN -1 ELSE label END AS INTEGER) AS label FROM vertices")
def label_overlay(s: SparkSession, d: str) -> DataFrame:
    v = vertices(s, d)
    return tracing.reassign(v.select("id", "label"), v.filter("z > 0.1").select("id", F.lit(-1).alias("label"))).select("id", F.col("label").cast("int").alias("label"))


# Patches


_knn = ", pr AS (SELECT a.id AS a, b.id AS b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist FROM vertices a JOIN vertices b ON a.id <> b.id), kn AS (SELECT least(a, b) AS u, greatest(a, b) AS v FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS rank FROM pr) WHERE rank <= 4 GROUP BY 1, 2)"
_same = """, e AS (SELECT k.u, k.v, p.label AS ul, q.label AS vl FROM kn k JOIN vertices p ON p.id = k.u JOIN vertices q ON q.id = k.v), two AS (SELECT u AS a, v AS b FROM e WHERE ul = vl UNION SELECT v, u FROM e WHERE ul = vl),
reach AS (SELECT id, id AS r FROM vertices UNION SELECT reach.id, two.b FROM reach JOIN two ON two.a = reach.r), pa AS (SELECT r.id, v.label, min(r.r) AS patch FROM reach r JOIN vertices v ON v.id = r.id GROUP BY r.id, v.label),
sz AS (SELECT patch, label, count(*) AS vertices FROM pa GROUP BY ALL), mn AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vertices DESC, patch) = 1 AS main FROM sz),
bo AS (SELECT p.patch, e.vl AS other FROM e JOIN pa p ON p.id = e.u WHERE ul <> vl UNION ALL SELECT p.patch, e.ul FROM e JOIN pa p ON p.id = e.v WHERE ul <> vl),
bn AS (SELECT patch, other, count(*) AS n FROM bo GROUP BY ALL), bt AS (SELECT patch, other, n, sum(n) OVER (PARTITION BY patch) AS every, row_number() OVER (PARTITION BY patch ORDER BY n DESC, other) AS rn FROM bn),
tab AS (SELECT m.patch, m.label, m.vertices, m.main, t.other AS neighbour, t.n / t.every AS share FROM mn m LEFT JOIN bt t ON t.patch = m.patch AND t.rn = 1)
"""


@query("WITH RECURSIVE " + with_sql("vertices")[5:] + _knn + _same + "SELECT patch, CAST(label AS INTEGER) AS label, vertices, main, CAST(neighbour AS INTEGER) AS neighbour, round(share, 6) AS share FROM tab")
def label_patches(s: SparkSession, d: str) -> DataFrame:
    """Patches of one label over the edges of near vertices."""
    v = vertices(s, d)
    return rounded(ownership.patch_table(spatial.knn_graph(v, NEIGHBOURS).select("u", "v"), v.select("id", "label")))


@query("WITH RECURSIVE " + with_sql("vertices")[5:] + _knn + _same + "SELECT p.id, CAST(t.neighbour AS INTEGER) AS label FROM pa p JOIN tab t ON t.patch = p.patch WHERE t.label > 0 AND NOT t.main AND t.share >= 0.75 AND t.neighbour >= 0")
def island_moves(s: SparkSession, d: str) -> DataFrame:
    """Islands that go to the neighbour around them."""
    v = vertices(s, d)
    return ownership.island_proposals(spatial.knn_graph(v, NEIGHBOURS).select("u", "v"), v.select("id", "label"))


# Sets, reviews, corrections


@query("""WITH c AS (SELECT c_custkey AS k FROM customer), o AS (SELECT o_custkey AS k FROM orders)
SELECT 'union' AS op, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT k FROM c UNION SELECT k FROM o) UNION ALL SELECT 'union_all', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT k FROM c UNION ALL SELECT k FROM o)
UNION ALL SELECT 'intersect', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT k FROM c INTERSECT SELECT k FROM o) UNION ALL SELECT 'except', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT k FROM c EXCEPT SELECT k FROM o) UNION ALL SELECT 'except_all', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT k FROM o EXCEPT ALL SELECT k FROM c)""")
def set_operations(s: SparkSession, d: str) -> DataFrame:
    c, o = table(s, d, "customer").select(F.col("c_custkey").alias("k")), table(s, d, "orders").select(F.col("o_custkey").alias("k"))
    every = {"union": c.union(o).distinct(), "union_all": c.union(o), "intersect": c.intersect(o), "except": c.subtract(o), "except_all": o.exceptAll(c)}
    out = None
    for name, df in every.items():
        one = df.agg(F.count("*").alias("n"), F.sum("k").alias("total")).select(F.lit(name).alias("op"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query(with_sql("faces", "vertices") + ", f AS (SELECT a, b, c FROM faces WHERE a NOT IN (SELECT id FROM vertices WHERE label = 1) AND b NOT IN (SELECT id FROM vertices WHERE label = 1) AND c NOT IN (SELECT id FROM vertices WHERE label = 1)) SELECT a, b, c, count(*) AS copies FROM f GROUP BY ALL")
def visible_faces(s: SparkSession, d: str) -> DataFrame:
    """Faces left when the vertices of a label are hidden."""
    v = vertices(s, d)
    return mesh.drop_hidden(faces(s, d), v, v.filter("label = 1"))[0].groupBy("a", "b", "c").agg(F.count("*").alias("copies"))


@query(with_sql("current") + "SELECT sample_id, root_id, CASE WHEN confidence < 0.5 THEN 'primary' ELSE parent_id END AS parent_id, CASE WHEN confidence < 0.5 THEN 0.0 ELSE confidence END AS confidence, list_contains(qc_flags, 'reviewed') OR confidence < 0.5 AS reviewed FROM (SELECT * REPLACE (coalesce(qc_flags, []) AS qc_flags) FROM current) WHERE NOT (confidence < 0.1)")
def reviewed_links(s: SparkSession, d: str) -> DataFrame:
    """Roots of little confidence hung on primary by review, those of least taken out."""
    r = table(s, d, "roots").groupBy("sample_id", normal_key("root_id").alias("key")).agg(F.max(F.struct("recorded_at", "root_id", "parent_id", "confidence", "qc_flags")).alias("r")).select("sample_id", "r.root_id", "r.parent_id", "r.confidence", "r.qc_flags")
    r = r.withColumn("fingerprint", F.sha2("root_id", 256))
    c = r.filter("confidence < 0.5").select("sample_id", "root_id", F.lit("primary").alias("parent_id"), (F.col("confidence") >= 0.1).alias("valid"), "fingerprint")
    out, _ = tree.apply_corrections(r, c)
    return out.select("sample_id", "root_id", "parent_id", "confidence", F.array_contains(F.coalesce("qc_flags", F.array().cast("array<string>")), "reviewed").alias("reviewed"))


@query(with_sql("vertices") + "SELECT id FROM vertices WHERE NOT (label % 3 = 0 AND x < 0)")
def reviewed_objects(s: SparkSession, d: str) -> DataFrame:
    """Objects that no review of the same fingerprint rejects; stale reviews change nothing."""
    v = vertices(s, d).select(F.col("id").alias("object_id"), F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"), "label", "x")
    r = v.filter("x < 0").select("object_id", F.when(F.col("label") % 3 == 0, F.col("fingerprint")).otherwise("old").alias("fingerprint"), F.lit(False).alias("accepted"))
    return guides.apply_reviews(v, r)[0].select(F.col("object_id").alias("id"))


# Texts, arrays, prints


@query("SELECT sample_id, root_id, recorded_at, array_to_string(list_concat(list_filter(list_distinct_in_order, lambda f: f <> 'short'), CASE WHEN list_contains(list_filter(list_distinct_in_order, lambda f: f <> 'short'), 'seen') THEN [] ELSE ['seen'] END), ';') AS flags FROM (SELECT *, coalesce(list_filter(qc_flags, lambda f, i: list_position(qc_flags, f) = i AND trim(f) <> ''), []) AS list_distinct_in_order FROM roots)")
def edited_flags(s: SparkSession, d: str) -> DataFrame:
    """Flags read from their joined text, one dropped and one added, joined again."""
    r = table(s, d, "roots")
    f = tx.split_flags(tx.join_flags(F.col("qc_flags")))
    return r.select("sample_id", "root_id", "recorded_at", tx.join_flags(tx.edit_flags(f, F.array(F.lit("short")), F.array(F.lit("seen")))).alias("flags"))


@query(with_sql("vertices") + "SELECT id, sha256('3,' || printf('%.10f', round(x, 10) + 0.0) || ',' || printf('%.10f', round(y, 10) + 0.0) || ',' || printf('%.10f', round(z, 10) + 0.0)) AS print FROM vertices")
def place_fingerprints(s: SparkSession, d: str) -> DataFrame:
    return vertices(s, d).select("id", tx.fingerprint(F.array("x", "y", "z")).alias("print"))


@query(r"""SELECT file_id, received_at, sha256(regexp_replace(replace(body, '"session_id"', '"session_token"'), '(?i)("[^"]*(?:password|passwd|secret|token|api_key|apikey|credential|authorization)[^"]*"\s*:\s*)("(?:[^"\\]|\\.)*"|[^,}\]\s]+)', '\1"***"', 'g')) AS masked FROM sessions WHERE body IS NOT NULL""")
def redacted_bodies(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "sessions").filter("body is not null")
    body = F.replace(F.col("body"), F.lit('"session_id"'), F.lit('"session_token"'))
    return t.select("file_id", "received_at", F.sha2(tx.redact(body), 256).alias("masked"))


@query("""SELECT sample_id, unnest(map_keys(score_components)) AS component, unnest(map_values(score_components)) AS v FROM roots""".join(["WITH m AS (", ") SELECT sample_id, component, count(*) AS n, round(sum(v), 6) AS total, round(max(v), 6) AS most FROM m GROUP BY ALL"]))
def score_components(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "roots").select("sample_id", F.explode("score_components").alias("component", "v"))
    return m.groupBy("sample_id", "component").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total"), F.round(F.max("v"), 6).alias("most"))


@query(with_sql("vertices") + ", e AS (SELECT min(x) AS lx, max(x) AS hx FROM vertices) SELECT id, round((x - lx) / (hx - lx), 6) AS scaled, round(least(a, 180 - a), 4) AS axial, CASE WHEN label = 0 THEN '60,60,60' ELSE ['31,119,180','214,39,40','44,160,44','148,103,189','255,127,14'][(label - 1) % 5 + 1] END AS color FROM (SELECT *, degrees(acos(greatest(-1.0, least(1.0, z / sqrt(x*x+y*y+z*z))))) AS a FROM vertices) v, e")
def scaled_points(s: SparkSession, d: str) -> DataFrame:
    v = vertices(s, d)
    ends = v.agg(F.min("x").alias("lx"), F.max("x").alias("hx"))
    up = [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return v.crossJoin(F.broadcast(ends)).select("id", F.round(g.minmax(F.col("x"), F.col("lx"), F.col("hx")), 6).alias("scaled"), F.round(g.axial_angle(g.xyz(), up), 4).alias("axial"), g.order_color(F.col("label")).alias("color"))


# Whole shapes by label


@query(with_sql("vertices") + """, c AS (SELECT label, covar_pop(x, x) AS a, covar_pop(y, y) AS b, covar_pop(z, z) AS c, covar_pop(x, y) AS d, covar_pop(y, z) AS e, covar_pop(x, z) AS f FROM vertices GROUP BY label),
q AS (SELECT *, (a + b + c) / 3 AS q, d*d + e*e + f*f AS o FROM c), p AS (SELECT *, sqrt(((a-q)*(a-q) + (b-q)*(b-q) + (c-q)*(c-q) + 2*o) / 6) AS p FROM q),
t AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1.0, least(1.0, (((a-q)*((b-q)*(c-q) - e*e) - d*(d*(c-q) - e*f) + f*(d*e - (b-q)*f)) / (p*p*p)) / 2))) / 3 ELSE 0 END AS phi FROM p)
SELECT CAST(label AS INTEGER) AS label, round(q + 2*p*cos(phi), 6) AS first, round(3*q - (q + 2*p*cos(phi)) - (q + 2*p*cos(phi + 2*pi()/3)), 6) AS second, round(q + 2*p*cos(phi + 2*pi()/3), 6) AS third FROM t""")
def principal_axes(s: SparkSession, d: str) -> DataFrame:
    """The variances along the principal axes of each specimen, from aggregated covariances."""
    return rounded(spatial.principal_variances(vertices(s, d), ["label"]))


@query(with_sql("vertices") + """, w AS (SELECT a.label, max(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))) AS width FROM vertices a JOIN vertices b ON a.label = b.label GROUP BY a.label), e AS (SELECT label, max(z) - min(z) AS depth FROM vertices GROUP BY label)
SELECT CAST(e.label AS INTEGER) AS label, round(depth, 6) AS depth, round(width, 6) AS width, round(CASE WHEN width > 0 THEN depth / width END, 6) AS depth_to_width FROM e JOIN w USING (label)""")
def envelope(s: SparkSession, d: str) -> DataFrame:
    """Depth along gravity, the greatest horizontal width, and their ratio."""
    return rounded(spatial.envelope(vertices(s, d), ["label"]))


@query("WITH RECURSIVE " + with_sql("vertices")[5:] + """, st AS (
 SELECT label, 0 AS place, arg_min(id, {'z': z, 'id': id}) AS id, [arg_min(id, {'z': z, 'id': id})] AS chosen FROM vertices GROUP BY label
 UNION ALL
 SELECT * FROM (SELECT st.label, st.place + 1 AS place, f.id, list_append(st.chosen, f.id) AS chosen FROM st JOIN LATERAL (SELECT v.id FROM vertices v JOIN vertices c ON list_contains(st.chosen, c.id) WHERE v.label = st.label GROUP BY v.id HAVING min(sqrt((v.x-c.x)*(v.x-c.x)+(v.y-c.y)*(v.y-c.y)+(v.z-c.z)*(v.z-c.z))) > 0 ORDER BY min(sqrt((v.x-c.x)*(v.x-c.x)+(v.y-c.y)*(v.y-c.y)+(v.z-c.z)*(v.z-c.z))) DESC, v.id LIMIT 1) f ON true WHERE st.place < 7))
SELECT CAST(label AS INTEGER) AS label, CAST(place AS BIGINT) AS place, id FROM st""")
def landmarks(s: SparkSession, d: str) -> DataFrame:
    """The lowest vertex of each specimen, then always the one farthest from those chosen."""
    return spatial.landmarks(vertices(s, d), ["label"], 8)


@query(with_sql("vertices", "faces", "corners", "measures") + """, w AS (SELECT id, sum(area / 3) AS w FROM (SELECT unnest([a, b, c]) AS id, area FROM measures) GROUP BY id),
q AS (SELECT label AS nodule_id, count(*) AS vertices, sum(w) AS area, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, sum(w * z) / sum(w) AS cz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS extent FROM vertices JOIN w USING (id) GROUP BY label)""" + _knn + """, c AS (SELECT p.label AS nodule_id, q.label FROM kn k JOIN vertices p ON p.id = k.u JOIN vertices q ON q.id = k.v WHERE p.label <> q.label),
n AS (SELECT nodule_id, label, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT nodule_id, max({'n': n, 'label': label}) AS t, sum(n) AS every FROM n GROUP BY nodule_id)
SELECT CAST(q.nodule_id AS INTEGER) AS nodule_id, vertices, round(area, 4) AS area, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(extent, 6) AS extent, CAST(CASE WHEN t.t.n >= 0.7 * every THEN t.t.label END AS INTEGER) AS root FROM q LEFT JOIN t USING (nodule_id)""")
def nodule_table(s: SparkSession, d: str) -> DataFrame:
    """Area, centre, extent and supporting root of each label taken as a nodule."""
    v = vertices(s, d)
    f = faces(s, d)
    w = mesh.corner_weights(f, v)
    e = spatial.knn_graph(v, NEIGHBOURS)
    c = e.join(v.select(F.col("id").alias("u"), F.col("label").alias("nodule_id")), "u").join(v.select(F.col("id").alias("v"), "label"), "v").filter("nodule_id <> label")
    out = tracing.nodule_quantities(v.join(w, "id").withColumnRenamed("label", "nodule_id"), c.select("nodule_id", "label"))
    return out.select("nodule_id", "vertices", F.round("area", 4).alias("area"), *(F.round(x, 6).alias(x) for x in ("cx", "cy", "cz", "extent")), "root")


# Files


@query(with_sql("vertices") + "SELECT 'all' AS sample_id, row_number() OVER (ORDER BY id) - 1 AS vertex_id, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z, CAST(label AS DOUBLE) AS label FROM vertices")
def labelled_mesh_file(s: SparkSession, d: str) -> DataFrame:
    """The vertices written as a labelled PLY file and read again with their labels."""
    v = vertices(s, d).select(F.lit("all").alias("sample_id"), F.col("id").alias("vertex_id"), "x", "y", "z", "label")
    f = faces(s, d).select(F.lit("all").alias("sample_id"), F.monotonically_increasing_id().alias("face_id"), "a", "b", "c")
    back = files.decode_pieces(files.ply_pieces(v, f), "vertices", scalars=True)
    return back.select("sample_id", "vertex_id", *(F.round(a, 9).alias(a) for a in "xyz"), F.col("scalars")["label"].alias("label"))


@query(with_sql("current", "latest", "walk", "up", recursive=True) + _good + """ SELECT c.sample_id, c.k AS root_id, m.k AS parent_id, round(max(l.el), 6) AS length, CAST(2 AS BIGINT) AS points FROM current c JOIN good USING (sample_id, k) LEFT JOIN current m ON m.sample_id = c.sample_id AND m.k = c.p LEFT JOIN latest l ON l.sample_id = c.sample_id AND l.root_id = c.root_id GROUP BY ALL""")
def root_documents(s: SparkSession, d: str) -> DataFrame:
    """All hierarchies written as RSML documents with their lengths, and read again."""
    links = current_links(table(s, d, "roots"))
    t = traits(s, d, "length").select("sample_id", "root_id", architecture.eligible("length").alias("length"))
    r = links.join(t, ["sample_id", "root_id"], "left").select("sample_id", F.col("key").alias("root_id"), F.col("parent_key").alias("parent_id"), "length")
    ends = r.select("sample_id", "root_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("node_id"), F.lit(0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(-1.5).alias("z"), F.lit(0.25).alias("radius"))
    back = files.read_rsml(files.rsml_files(r, ends, ("length",)))
    return back.filter(F.col("diameters") == F.array(F.lit(0.5), F.lit(0.5))).select("sample_id", "root_id", "parent_id", F.round(F.col("properties")["length"].cast("double"), 6).alias("length"), F.size("nodes").cast("long").alias("points"))


@query(with_sql("vertices") + "SELECT 'all' AS sample_id, row_number() OVER (ORDER BY id) - 1 AS vertex_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM vertices")
def point_text_file(s: SparkSession, d: str) -> DataFrame:
    """The vertices written as a text of coordinates and read again."""
    line = F.concat_ws(" ", *(F.col(a).cast("string") for a in "xyz"))
    text = vertices(s, d).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda r: r["line"]), "\n").alias("text"))
    held = text.select(F.lit("all").alias("sample_id"), F.lit("all.xyz").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return files.decode(held, "vertices").select("sample_id", "vertex_id", *(F.round(a, 6).alias(a) for a in "xyz"))

"""Queries of the repairs of hierarchies and surfaces over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborline.common import normal_key, table
from arborline.operators import repair, spatial
from arborline.operators.kernels import grouped
from arborline.plans.catalogue import NEIGHBOURS, REACH, rounded
from arborline.plans.evidence import _knn, _same
from arborline.plans.views import nodes, vertices, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(with_sql("current", recursive=True) + """, w AS (SELECT sample_id, k AS root, p, 0 AS steps, [k, p] AS seen, insertion_x AS x, insertion_y AS y, insertion_z AS z, confidence AS c FROM current
 UNION ALL SELECT w.sample_id, w.root, m.p, w.steps + 1, list_append(w.seen, m.p), w.x, w.y, w.z, w.c FROM w JOIN current m ON m.sample_id = w.sample_id AND m.k = w.p JOIN current g ON g.sample_id = w.sample_id AND g.k = m.p
 WHERE sqrt(pow(w.x-m.insertion_x,2)+pow(w.y-m.insertion_y,2)+pow(w.z-m.insertion_z,2)) <= 60 AND sqrt(pow(w.x+w.c-g.insertion_x,2)+pow(w.y+w.c-g.insertion_y,2)+pow(w.z+w.c-g.insertion_z,2)) <= 60 AND NOT list_contains(w.seen, m.p))
SELECT sample_id, root AS root_id, arg_max(p, steps) AS parent_id, CAST(max(steps) AS INTEGER) AS steps FROM (SELECT * REPLACE (coalesce(p, '') AS p) FROM w) GROUP BY ALL""")
def base_promotion(s: SparkSession, d: str) -> DataFrame:
    """Roots that leave their parent at its base, hung on the grandparent."""
    r = table(s, d, "roots").groupBy("sample_id", normal_key("root_id").alias("root_id")).agg(F.max(F.struct("recorded_at", normal_key("parent_id").alias("parent_id"), "insertion_x", "insertion_y", "insertion_z", "confidence")).alias("r"))
    at = {a: F.col(f"r.insertion_{a}") for a in "xyz"}
    links = r.select("sample_id", "root_id", "r.parent_id", *(c.alias(f"i{a}") for a, c in at.items()), *((c + F.col("r.confidence")).alias(f"s{a}") for a, c in at.items()), *(c.alias(f"b{a}") for a, c in at.items()))
    return repair.promote_base_children(links, 60.0).select("sample_id", "root_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "steps")


@query("""WITH p AS (SELECT l_orderkey AS child_id, l_suppkey % 3 AS parent_id, CAST(l_discount AS DOUBLE) / 2 AS distance, l_linenumber = 1 AS tip, CAST(l_quantity AS DOUBLE) AS angle, 0.4 AS shorter, l_linenumber AS shared, 4 AS support FROM lineitem),
n AS (SELECT *, distance <= greatest(0.024, 0.08 * shorter) AS near FROM p),
s AS (SELECT child_id, parent_id, avg(CASE WHEN near THEN 1.0 ELSE 0.0 END) AS share, bool_or(near) FILTER (tip) AS tip_near, max(distance) FILTER (tip) AS td, avg(angle) AS angle, quantile_cont(distance, 0.9) AS p90, max(shorter) AS shorter, max(shared) AS shared, max(support) AS support FROM n GROUP BY ALL)
SELECT child_id, parent_id, coalesce(share >= 0.8 AND tip_near AND angle <= 30 AND ((shared >= 3 AND shared >= 0.65 * support) OR (p90 <= greatest(0.006, 0.015 * shorter) AND td <= greatest(0.008, 0.02 * shorter) AND angle <= 15)), false) AS duplicate FROM s""")
def parallel_review(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("child_id"), F.pmod("l_suppkey", F.lit(3)).alias("parent_id"), (F.col("l_discount").cast("double") / 2).alias("distance"), (F.col("l_linenumber") == 1).alias("tip"),
        F.col("l_quantity").cast("double").alias("angle"), F.lit(0.4).alias("shorter"), F.col("l_linenumber").alias("shared"), F.lit(4).alias("support"),
    )
    return repair.parallel_duplicates(p, 0.002)


@query("""WITH RECURSIVE l AS (SELECT p_partkey AS root_id, p_partkey // 2 AS parent_id, p_size <= 25 AND p_partkey > 1 AS gone FROM part),
w AS (SELECT root_id, parent_id AS at FROM l WHERE NOT gone UNION ALL SELECT w.root_id, l.parent_id FROM w JOIN l ON l.root_id = w.at AND l.gone)
SELECT w.root_id, w.at AS parent_id FROM w LEFT JOIN l ON l.root_id = w.at WHERE NOT coalesce(l.gone, false)""")
def absorbed_links(s: SparkSession, d: str) -> DataFrame:
    """A tree of parts in which the small ones are merged into their parents."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("root_id"), F.floor(F.col("p_partkey") / 2).cast("long").alias("parent_id"), "p_size")
    return repair.absorb(p.select("root_id", "parent_id"), p.filter("p_size <= 25 and root_id > 1").select("root_id", F.col("parent_id").alias("into")))


@query("""WITH c AS (SELECT l_orderkey AS parent_id, CAST(l_orderkey % 5 AS INTEGER) AS root_order, l_partkey AS child_id, CAST(l_discount AS DOUBLE) * 10 AS direction, CAST(l_tax AS DOUBLE) * 12 AS fork, CAST(l_quantity AS DOUBLE) / 50 AS length, CAST(l_extendedprice AS DOUBLE) / 1000 AS cl, CAST(l_quantity AS DOUBLE) AS pl, l_returnflag <> 'R' AS connected FROM lineitem),
k AS (SELECT *, 0.55 * direction + 0.35 * fork + 0.10 * length - CASE WHEN cl > pl + greatest(1e-12, 1e-9 * greatest(cl, pl)) THEN 0.05 * greatest(0.0, least(1.0, (cl - pl) / cl)) ELSE 0.0 END AS score, 0.55 * direction + 0.35 * fork - (0.55 * 0.4 + 0.35 * 0.4) AS gain FROM c),
a AS (SELECT *, gain > 0.05 AND score - (0.55 * 0.4 + 0.35 * 0.4 + 0.10 * 0.5) > 0.05 AND cl - pl > greatest(0.08, 0.05 * pl) AND connected AS accepted FROM k),
b AS (SELECT parent_id, root_order, max({'accepted': accepted, 'score': score, 'child': -child_id}) AS m FROM a GROUP BY ALL)
SELECT parent_id, -m.child AS child_id, row_number() OVER (ORDER BY root_order, parent_id) AS place, round(m.score, 6) AS score, m.accepted AS accepted FROM b""")
def fork_queue(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("parent_id"), F.pmod("l_orderkey", F.lit(5)).cast("int").alias("root_order"), F.col("l_partkey").alias("child_id"), (F.col("l_discount").cast("double") * 10).alias("direction"), (F.col("l_tax").cast("double") * 12).alias("fork"), (F.col("l_quantity").cast("double") / 50).alias("length"),
        (F.col("l_extendedprice").cast("double") / 1000).alias("child_length"), F.col("l_quantity").cast("double").alias("parent_length"), F.lit(0.4).alias("own_direction"), F.lit(0.4).alias("own_fork"), F.lit(0.5).alias("own_length"), (F.col("l_returnflag") != "R").alias("connected"),
    )
    return rounded(repair.fork_review(c, 0.01))


@query(with_sql("vertices") + """, j AS (SELECT t.id AS a, u.id AS b, sqrt(pow(t.x-u.x,2)+pow(t.y-u.y,2)+pow(t.z-u.z,2)) AS distance, degrees(acos(greatest(-1.0, least(1.0, (t.x*(u.x-t.x)+t.y*(u.y-t.y)+t.z*(u.z-t.z)) / (sqrt(t.x*t.x+t.y*t.y+t.z*t.z) * sqrt(pow(t.x-u.x,2)+pow(t.y-u.y,2)+pow(t.z-u.z,2))))))) AS angle FROM vertices t JOIN vertices u ON t.label <> u.label AND sqrt(pow(t.x-u.x,2)+pow(t.y-u.y,2)+pow(t.z-u.z,2)) <= 0.1),
o AS (SELECT * FROM j WHERE angle <= 45) SELECT a AS tip_id, b AS start_id, round(distance, 6) AS distance FROM (SELECT *, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM o) WHERE na = 1 AND nb = 1""")
def continuations(s: SparkSession, d: str) -> DataFrame:
    v = vertices(s, d).withColumnRenamed("label", "root")
    return rounded(repair.continuation_joins(v.select("*", *(F.col(a).alias(f"d{a}") for a in "xyz")), v, REACH))


@query("""WITH u AS (SELECT CAST(user_id AS BIGINT) AS user_id, list(event_id ORDER BY ts, event_id) AS path, list(CAST(value AS DOUBLE) ORDER BY ts, event_id) AS r FROM events GROUP BY 1),
c AS (SELECT user_id // 2 AS pair_id, user_id % 2 AS side, path, CAST(len(path) // 2 AS INTEGER) AS cut, list_avg(r[1:len(r) // 2]) AS before, list_avg(r[len(r) // 2 + 1:]) AS after FROM u),
p AS (SELECT a.pair_id, a.path AS ap, b.path AS bp, a.cut AS ac, b.cut AS bc, coalesce(abs(a.before - b.after) + abs(b.before - a.after) < abs(a.before - a.after) + abs(b.before - b.after), false) AS swapped FROM c a JOIN c b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1)
SELECT pair_id, array_to_string(CASE WHEN swapped THEN list_concat(ap[1:ac], bp[bc + 1:]) ELSE ap END, ',') AS a_path, array_to_string(CASE WHEN swapped THEN list_concat(bp[1:bc], ap[ac + 1:]) ELSE bp END, ',') AS b_path, swapped FROM p""")
def uncrossed_pairs(s: SparkSession, d: str) -> DataFrame:
    """Users two by two as paths that touch in their middle."""
    u = table(s, d, "events").groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("value").cast("double").alias("value")))).alias("e"))
    cut = F.floor(F.size("e") / 2).cast("int")
    mean = lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, e: a + e["value"]) / F.size(x))
    c = u.select(F.floor(F.col("user_id") / 2).cast("long").alias("pair_id"), F.pmod("user_id", F.lit(2)).alias("side"), F.transform("e", lambda e: e["event_id"]).alias("path"), cut.alias("cut"), mean(F.slice("e", F.lit(1), cut)).alias("before"), mean(F.slice("e", cut + 1, F.size("e"))).alias("after"))
    side = lambda k, n: c.filter(F.col("side") == n).select("pair_id", *(F.col(x).alias(f"{k}_{x}") for x in ("path", "cut", "before", "after")))
    out = repair.uncross(side("a", 0).join(side("b", 1), "pair_id"))
    return out.select("pair_id", *(F.array_join(F.col(f"{k}_path").cast("array<string>"), ",").alias(f"{k}_path") for k in "ab"), "swapped")


@query("""WITH u AS (SELECT CAST(user_id AS BIGINT) AS child_id, CAST(user_id % 10 AS BIGINT) AS parent_id, list(event_id ORDER BY ts, event_id) AS path, CAST(user_id % 7 AS DOUBLE) / 1000 AS gap, 140.0 + user_id % 40 AS angle, (user_id % 5) / 8.0 AS inside FROM events GROUP BY user_id),
b AS (SELECT parent_id, arg_min(child_id, {'g': gap, 'c': child_id}) AS child_id FROM u WHERE gap <= 0.008 AND angle >= 150 AND inside < 0.5 GROUP BY parent_id)
SELECT b.parent_id AS root_id, b.child_id AS merged, array_to_string(list_concat(list_reverse(u.path), [b.parent_id * 1000 + 1, b.parent_id * 1000 + 2]), ',') AS path FROM b JOIN u USING (child_id)""")
def merged_connectors(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "events").groupBy(F.col("user_id").cast("long").alias("child_id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("e"))
    p = F.pmod("child_id", F.lit(10))
    c = u.select("child_id", p.alias("parent_id"), F.transform("e", lambda e: e["event_id"]).alias("child_path"), F.array(p * 1000, p * 1000 + 1, p * 1000 + 2).alias("parent_path"), (F.pmod("child_id", F.lit(7)) / 1000).alias("gap"), (140.0 + F.pmod("child_id", F.lit(40))).alias("angle"), (F.pmod("child_id", F.lit(5)) / 8.0).alias("inside"))
    return repair.connector_merges(c, 0.001).select("root_id", "merged", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query("""WITH c AS (SELECT l_orderkey AS root_id, l_partkey AS parent_id, l_linenumber = 1 AS current, CAST(l_quantity AS DOUBLE) AS support, CAST(l_discount AS DOUBLE) AS gap FROM lineitem),
b AS (SELECT root_id, max({'s': support, 'g': -gap, 'p': -parent_id}) AS m, max(CASE WHEN current THEN {'s': support, 'p': parent_id} END) AS c, sum(support) AS every FROM c GROUP BY root_id)
SELECT root_id, c.p AS old_parent_id, -m.p AS new_parent_id FROM b WHERE -m.p <> c.p AND m.s - c.s > 0.05 * every""")
def basal_parents(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "lineitem").select(F.col("l_orderkey").alias("root_id"), F.col("l_partkey").alias("parent_id"), (F.col("l_linenumber") == 1).alias("current"), F.col("l_quantity").cast("double").alias("support"), F.col("l_discount").cast("double").alias("gap"))
    return repair.basal_review(c)


@query("""WITH p AS (SELECT CAST(user_id AS BIGINT) AS station, event_id AS id, CAST(value AS DOUBLE) AS radial, event_id % 3 = 0 AS facing FROM events),
s AS (SELECT station, CASE WHEN count(*) FILTER (facing) >= 5 THEN quantile_cont(radial, 0.8) FILTER (facing) END AS face, CASE WHEN count(*) FILTER (NOT facing) >= 5 THEN quantile_cont(radial, 0.8) FILTER (NOT facing) END AS flank FROM p GROUP BY station)
SELECT station, id, coalesce(facing AND face > 1.35 * flank AND radial > flank, false) AS trimmed FROM p JOIN s USING (station)""")
def trimmed_sections(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "events").select(F.col("user_id").cast("long").alias("station"), F.col("event_id").alias("id"), F.col("value").cast("double").alias("radial"), (F.pmod("event_id", F.lit(3)) == 0).alias("facing"))
    return repair.trim_sections(p)


_open = "WITH RECURSIVE vertices AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CASE WHEN CAST(embedding[3] AS DOUBLE) > 0.12 THEN -1 ELSE CAST(label AS INTEGER) END AS label FROM embeddings)"


def _opened(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges of near vertices, and labels in which the upper vertices are unassigned."""
    v = vertices(s, d)
    return spatial.knn_graph(v, NEIGHBOURS).select("u", "v"), v.select("id", F.when(F.col("z") > 0.12, F.lit(-1)).otherwise(F.col("label")).alias("label"))


@query(_open + _knn + _same + """SELECT p.id, CAST(coalesce(CASE WHEN ((t.label > 0 AND NOT t.main) OR t.label = -1) AND t.share >= 0.75 AND t.neighbour >= 0 THEN t.neighbour WHEN t.label > 0 AND NOT t.main AND t.vertices < 3 THEN -1 END, p.label) AS INTEGER) AS label FROM pa p JOIN tab t ON t.patch = p.patch""")
def cleaned_surface(s: SparkSession, d: str) -> DataFrame:
    edges, labels = _opened(s, d)
    return repair.clean_surface(edges, labels).select("id", F.col("label").cast("int").alias("label"))


@query(_open + _knn + _same + """, big AS (SELECT patch FROM sz WHERE label = -1 AND vertices >= 3), nb AS (SELECT p.patch, e.vl AS owner FROM e JOIN pa p ON p.id = e.u WHERE e.ul <> e.vl UNION SELECT p.patch, e.ul FROM e JOIN pa p ON p.id = e.v WHERE e.ul <> e.vl),
one AS (SELECT patch, min(owner) AS owner FROM nb SEMI JOIN big USING (patch) WHERE owner >= 6 GROUP BY patch HAVING count(*) = 1)
SELECT p.id, CAST(coalesce(o.owner, p.label) AS INTEGER) AS label FROM pa p LEFT JOIN one o ON o.patch = p.patch""")
def recovered_arms(s: SparkSession, d: str) -> DataFrame:
    edges, labels = _opened(s, d)
    return repair.recover_arms(edges, labels, labels.filter("label >= 6").select("label"), 3).select("id", F.col("label").cast("int").alias("label"))


@query()
def restricted_contacts(s: SparkSession, d: str) -> DataFrame:
    """Labels after roots of order two and above let go of the primary (orders by label)."""
    v = vertices(s, d)
    orders = v.select("label").distinct().select("label", (1 + F.col("label") % 3).cast("int").alias("root_order"))
    return repair.restrict_primary_contacts(spatial.knn_graph(v, NEIGHBOURS), v.select("id", "label"), orders).select("id", F.col("label").cast("int").alias("label"))


@query()
def transferred_patches(s: SparkSession, d: str) -> DataFrame:
    """Labels after detached patches went to the parent (the label before)."""
    v = vertices(s, d)
    parents = v.filter("label > 0").select("label").distinct().select("label", (F.col("label") - 1).alias("parent"))
    return repair.transfer_parent_patches(spatial.knn_graph(v, NEIGHBOURS).select("u", "v"), v.select("id", "label"), parents, 0.5).select("id", F.col("label").cast("int").alias("label"))


@query(with_sql("nodes") + """, t AS (SELECT root_id, y, abs(((x * 3 - lag(x * 3) OVER w + 180) % 360 + 360) % 360 - 180) AS step FROM nodes WINDOW w AS (PARTITION BY root_id ORDER BY node_id)),
s AS (SELECT root_id, avg(CASE WHEN y <= 6 THEN 1.0 ELSE 0.0 END) AS on_wall, coalesce(sum(step), 0.0) AS turned FROM t GROUP BY root_id)
SELECT root_id, round(on_wall, 6) AS on_wall, round(turned, 4) AS turned, on_wall >= 0.8 AND turned <= 120 AS wall_track FROM s""")
def wall_track_review(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d).select("root_id", "node_id", F.col("y").alias("gap"), F.lit(6.0).alias("reach"), (F.col("x") * 3).alias("azimuth"))
    return repair.wall_tracks(n).select("root_id", F.round("on_wall", 6).alias("on_wall"), F.round("turned", 4).alias("turned"), "wall_track")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS nodule_id, p_size AS primary_id, (p_partkey % 97) / 300.0 AS compactness, (p_partkey % 13) / 100.0 AS normal_spread, 1.0 + (p_partkey % 11) / 20.0 AS neck_ratio, (p_partkey % 7) / 10.0 AS coverage, CAST(p_partkey % 101 AS DOUBLE) AS place, 1.0 + p_partkey % 5 AS size FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY primary_id ORDER BY compactness DESC, nodule_id) AS k FROM p WHERE compactness >= 0.10 AND normal_spread >= 0.07 AND neck_ratio >= 1.18 AND coverage >= 0.25),
st AS (SELECT primary_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, place DOUBLE, size DOUBLE)[]) AS kept FROM f GROUP BY primary_id
 UNION ALL SELECT st.primary_id, f.k, CASE WHEN len(list_filter(st.kept, lambda c: abs(c.place - f.place) < (c.size + f.size) / 2)) = 0 THEN list_append(st.kept, {'id': f.nodule_id, 'place': f.place, 'size': f.size}) ELSE st.kept END FROM st JOIN f ON f.primary_id = st.primary_id AND f.k = st.k + 1),
t AS (SELECT unnest(kept).id AS nodule_id FROM (SELECT primary_id, arg_max(kept, k) AS kept FROM st GROUP BY primary_id))
SELECT p.nodule_id, t.nodule_id IS NOT NULL AS accepted FROM p LEFT JOIN t ON t.nodule_id = p.nodule_id""")
def nodules(s: SparkSession, d: str) -> DataFrame:
    k = lambda n: F.pmod("p_partkey", F.lit(n))
    p = table(s, d, "part").select(
        F.col("p_partkey").alias("nodule_id"), F.col("p_size").alias("primary_id"), (k(97) / 300.0).alias("compactness"), (k(13) / 100.0).alias("normal_spread"), (1.0 + k(11) / 20.0).alias("neck_ratio"), (k(7) / 10.0).alias("coverage"),
        k(101).cast("double").alias("place"), (1.0 + k(5)).alias("size"),
    )
    return repair.nodule_candidates(p)


@query("""WITH c AS (SELECT l_orderkey AS root_id, ['prior', 'axis', 'regularised'][l_linenumber % 3 + 1] AS kind, CAST(l_quantity AS DOUBLE) / 50 AS sections, l_returnflag <> 'R' AS supported, 0.7 + CAST(l_discount AS DOUBLE) * 3 AS coverage, CAST(l_tax AS DOUBLE) * 5 AS centring, 1 + CAST(l_discount AS DOUBLE) AS ratio, CAST(l_tax AS DOUBLE) / 6 AS backtrack, CAST(l_extendedprice AS DOUBLE) / 100000 AS error FROM lineitem),
k AS (SELECT root_id, kind, error + 0.5 * (ratio - 1) AS score, CASE WHEN sections < 0.6 THEN 'sections' WHEN NOT supported THEN 'endpoint' WHEN coverage < 0.8 THEN 'coverage' WHEN centring > 0.35 THEN 'centring' WHEN ratio > 1.08 THEN 'length_ratio' WHEN backtrack > 0.01 THEN 'backtrack' END AS reason FROM c),
b AS (SELECT root_id, min(CASE WHEN reason IS NULL THEN {'score': score, 'kind': kind} END) AS m, min(CASE WHEN kind = 'prior' THEN coalesce(reason, 'no_score') END) AS why FROM k GROUP BY root_id)
SELECT root_id, coalesce(m.kind, 'prior') AS kind, round(m.score, 9) AS score, CASE WHEN m IS NULL THEN coalesce(why, 'no_candidate') END AS reason FROM b""")
def curve_choices(s: SparkSession, d: str) -> DataFrame:
    x = lambda c: F.col(c).cast("double")
    c = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("root_id"), F.element_at(F.array(*map(F.lit, ("prior", "axis", "regularised"))), (F.pmod("l_linenumber", F.lit(3)) + 1).cast("int")).alias("kind"), (x("l_quantity") / 50).alias("sections"), (F.col("l_returnflag") != "R").alias("supported"),
        (0.7 + x("l_discount") * 3).alias("coverage"), (x("l_tax") * 5).alias("centring"), (1 + x("l_discount")).alias("ratio"), (x("l_tax") / 6).alias("backtrack"), (x("l_extendedprice") / 100000).alias("error"),
    )
    return rounded(repair.curve_choice(c), 9)


@query(with_sql("current") + "SELECT sample_id, root_id, array_to_string(list_filter([CASE WHEN insertion_x > 0.06 THEN 'attachment_gap' END, CASE WHEN insertion_y < 0.08 THEN 'short_trace' END, CASE WHEN confidence < 0.55 THEN 'low_confidence' END], lambda f: f IS NOT NULL), ';') AS flags FROM current")
def quality_flags(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "roots").groupBy("sample_id", normal_key("root_id").alias("key")).agg(F.max(F.struct("recorded_at", "root_id", "insertion_x", "insertion_y", "confidence")).alias("r")).select("sample_id", "r.*")
    return r.select("sample_id", "root_id", F.array_join(repair.quality_flags(F.col("insertion_x"), F.col("insertion_y"), F.col("confidence"), 0.01), ";").alias("flags"))


@query()
def repaired_hierarchy(s: SparkSession, d: str) -> DataFrame:
    """Circles broken, weak subtrees pruned, orders and ids anew; the steps each have SQL of their own."""
    return repair.repair_hierarchy(table(s, d, "roots"), 0.2)


@query()
def traced_orders(s: SparkSession, d: str) -> DataFrame:
    """The branches of each specimen below the path from its highest to its lowest vertex."""

    def run(pdf):
        from arborline.operators import growth, kernels

        pdf = pdf.sort_values("id", ignore_index=True)
        p = pdf[["x", "y", "z"]].to_numpy()
        axis = kernels.path_between(p, int(p[:, 2].argmax()), int(p[:, 2].argmin()), 6)
        spacing = float(kernels.nearest_neighbours(p, 1)[1].mean()) if len(p) > 1 else 1.0
        out = growth.trace_orders(p, axis, max(spacing, 1e-9))
        return out.assign(id=pdf["id"].to_numpy()[out["point"].to_numpy(int)]).drop(columns="point")

    return grouped(vertices(s, d), "label", run, "root long, parent long, root_order long, place long, id long")

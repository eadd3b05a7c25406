"""The queries of the general table problems (p1 to p5) and, where it can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborline.common import table
from arborline.operators import changes, drift, hierarchy, quantiles, units

def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    """All readable session files in one table of stable columns."""
    return drift.stable_table(table(spark, d, "sessions"))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    return units.segments(units.unit_segments(table(spark, d, "calibrations")))


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Each root with its interval of the Euler tour and its path as a text."""
    h = hierarchy.hierarchies(table(spark, d, "roots"), paths=True)
    return h.withColumn("path", F.array_join("path", "/"))


def p5_faults_by_joins(spark: SparkSession, d: str) -> DataFrame:
    """The same findings as p5_found by the way that holds no sample in a task."""
    return hierarchy.hierarchy_faults(table(spark, d, "roots"), limit=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda s, d: drift.schema_changes(table(s, d, "sessions")),
    "p1_schema": lambda s, d: drift.union_schema(table(s, d, "sessions")),
    "p1_sessions": p1_sessions,
    "p2_found": lambda s, d: units.unit_cases(table(s, d, "calibrations")),
    "p2_extents": lambda s, d: units.convert_extents(table(s, d, "calibrations")).select("calibration_id", F.round("extent_mm", 6).alias("extent_mm"), "outcome"),
    "p2_histories": lambda s, d: units.convert_histories(table(s, d, "calibrations")),
    "p2_segments": p2_segments,
    "p3_found": lambda s, d: changes.final_links(table(s, d, "ops"), table(s, d, "label_map")),
    "p4_percentiles": lambda s, d: quantiles.trait_percentiles(table(s, d, "traits")),
    "p4_over_days": lambda s, d: quantiles.percentiles_over_days(table(s, d, "traits")),
    "p4_checked": lambda s, d: quantiles.check_percentiles(table(s, d, "traits")),
    "p5_found": lambda s, d: hierarchy.hierarchy_faults(table(s, d, "roots")),
    "p5_hierarchy": p5_hierarchy,
    "p5_faults_by_joins": p5_faults_by_joins,
}

# The SQL has word tables of its own, so that a wrong word in the operator shows.
_words = "millimetres?|millimeters?|centimetres?|centimeters?|micrometres?|micrometers?|nanometres?|nanometers?|microns?|metres?|meters?|inches|inch|in|mm|cm|um|µm|μm|nm|m"
_factor = r"""CASE WHEN regexp_full_match(trim({0}, ' .' || chr(9) || chr(10) || chr(13)), '(?i)mm|millimet(re|er)s?') THEN 1.0::DOUBLE WHEN regexp_full_match(trim({0}, ' .' || chr(9) || chr(10) || chr(13)), '(?i)cm|centimet(re|er)s?') THEN 10.0::DOUBLE
 WHEN regexp_full_match(trim({0}, ' .' || chr(9) || chr(10) || chr(13)), '(?i)m|met(re|er)s?') THEN 1000.0::DOUBLE WHEN regexp_full_match(trim({0}, ' .' || chr(9) || chr(10) || chr(13)), '(?i)um|µm|μm|microns?|micromet(re|er)s?') THEN 0.001::DOUBLE
 WHEN regexp_full_match(trim({0}, ' .' || chr(9) || chr(10) || chr(13)), '(?i)nm|nanomet(re|er)s?') THEN 0.000001::DOUBLE WHEN regexp_full_match(trim({0}, ' .' || chr(9) || chr(10) || chr(13)), '(?i)in|inch|inches') THEN 25.4::DOUBLE END"""
_about = "coordinates|coordinate|xyz|numbers|number|axes|axis|units|unit|mesh|model|vertices|points|values|geometry"
_evidence = rf"""
WITH r AS (SELECT DISTINCT calibration_id, mm_per_mesh_unit, declared_unit, raw_declaration, coordinate_unit, scale, scale_text, remark FROM calibrations),
w AS (SELECT *,
    CASE WHEN mm_per_mesh_unit > 0 AND isfinite(mm_per_mesh_unit) THEN mm_per_mesh_unit END AS f0,
    CASE WHEN trim(declared_unit) <> '' THEN declared_unit END AS w1,
    nullif(regexp_extract(raw_declaration, '(?i)\bunits?\s*[:=]\s*([^\s;,\]\)]+)', 1), '') AS w2,
    nullif(regexp_extract(remark, '(?i)(?:^|[;,.]\s*)(?:the\s+|all\s+|export\s+)*(?:{_about})\b[^;,0-9]*?\s\(?({_words}|px|pixels?|voxels?|grid|unitless|au|\?)\)?\.?\s*(?:$|[;,.])', 1), '') AS w3,
    nullif(regexp_extract(scale_text, '[0-9]+(?:[ '']?[0-9]{{3}})*(?:[.,][0-9]+)?\s*\(?\s*([^\s\)\(;0-9]+)', 1), '') AS w4,
    coalesce(scale, TRY_CAST(replace(regexp_replace(regexp_extract(scale_text, '[0-9]+(?: [0-9]{{3}})*(?:[.,][0-9]+)?'), ' ', '', 'g'), ',', '.') AS DOUBLE)) AS number
  FROM r),
f AS (SELECT *, {_factor.format("coordinate_unit")} AS frame, {_factor.format("w1")} AS f1, {_factor.format("w2")} AS f2, {_factor.format("w3")} AS f3, {_factor.format("w4")} AS f4 FROM w),
g AS (SELECT calibration_id, number, frame, least(f0, f1, f2, f3, f4) AS low, greatest(f0, f1, f2, f3, f4) AS high,
    (w1 IS NOT NULL AND f1 IS NULL) OR (w2 IS NOT NULL AND f2 IS NULL) OR (w3 IS NOT NULL AND f3 IS NULL) OR (w4 IS NOT NULL AND f4 IS NULL) AS unnamed,
    coalesce(w1, w2, w3, w4) IS NULL AND f0 IS NULL AS silent FROM f),
h AS (SELECT *, coalesce(frame, CASE WHEN NOT unnamed AND high - low <= 1e-6 * high THEN low END) AS factor FROM g),
o AS (SELECT calibration_id, number, factor, CASE WHEN number IS NULL THEN 'no_number' WHEN factor IS NOT NULL THEN CASE WHEN abs(factor - 1) <= 1e-6 THEN 'as_it_stands' ELSE 'converted' END
    WHEN silent THEN 'no_evidence' WHEN low IS NULL THEN 'no_unit' ELSE 'contradiction' END AS outcome FROM h)
"""

#: The findings of hierarchies in SQL, as the common table expression x.
HIERARCHY = r"""
WITH RECURSIVE n AS (
  SELECT sample_id, lower(trim(root_id)) AS k, arg_max(root_id, recorded_at) AS root_id, arg_max(coalesce(lower(regexp_replace(parent_id, '^\s+|\s+$', '', 'g')), ''), recorded_at) AS p, arg_max(coalesce(root_order, -1), recorded_at) AS root_order
  FROM roots GROUP BY ALL),
l AS (SELECT n.*, m.k AS up FROM n LEFT JOIN n m ON m.sample_id = n.sample_id AND m.k = n.p AND n.p <> ''),
walk AS (
  SELECT sample_id, k AS origin, k AS here, up, [k] AS seen, false AS looped FROM l
  UNION ALL
  SELECT w.sample_id, w.origin, l.k, l.up, list_append(w.seen, l.k), list_contains(w.seen, l.k)
  FROM walk w JOIN l ON l.sample_id = w.sample_id AND l.k = w.up WHERE NOT w.looped),
e AS (SELECT sample_id, origin, here, seen, looped FROM walk WHERE looped OR up IS NULL),
c AS (SELECT sample_id, origin, here, looped, list_position(seen, here) - 1 AS first, len(seen) - 1 AS links, seen FROM e),
u AS (SELECT c.sample_id, c.origin, min(n.root_id) AS top FROM (SELECT sample_id, origin, unnest(seen[first + 1 : links]) AS k FROM c WHERE looped) c JOIN n ON n.sample_id = c.sample_id AND n.k = c.k GROUP BY ALL),
x AS (SELECT c.sample_id, n.root_id, CASE WHEN c.looped THEN u.top ELSE t.root_id END AS top_root_id, CASE WHEN c.looped THEN c.first ELSE c.links END AS depth,
    CASE WHEN c.looped THEN CASE WHEN c.first = 0 THEN 'cycle' ELSE 'below_cycle' END WHEN c.here <> 'primary' THEN 'detached' WHEN n.root_order >= 0 AND n.root_order <> c.links THEN 'order' END AS finding
  FROM c JOIN n ON n.sample_id = c.sample_id AND n.k = c.origin JOIN n t ON t.sample_id = c.sample_id AND t.k = c.here LEFT JOIN u ON u.sample_id = c.sample_id AND u.origin = c.origin)
"""

_replay = r"""
WITH RECURSIVE known AS (SELECT DISTINCT session_id, baseline_fingerprint FROM label_map),
o AS (SELECT o.*, lower(trim(event)) AS e, CASE WHEN lower(trim(event)) = 'apply' THEN operation_id ELSE target_operation_id END AS oid FROM ops o SEMI JOIN known USING (session_id, baseline_fingerprint)),
a AS (SELECT session_id, oid, min(sequence) FILTER (e = 'apply') AS t, arg_min(type, sequence) FILTER (e = 'apply') AS type, arg_min(arguments, sequence) FILTER (e = 'apply') AS args, max(sequence) FILTER (e <> 'apply') AS ut, arg_max(e, sequence) FILTER (e <> 'apply') AS ue FROM o WHERE oid IS NOT NULL GROUP BY ALL),
f AS (SELECT session_id, oid, type, args['root_id'] AS r, coalesce(args['parent_id'], args['new_parent_id']) AS p, args['source_root_id'] AS src, row_number() OVER (PARTITION BY session_id ORDER BY t) AS k FROM a WHERE t IS NOT NULL AND (ut IS NULL OR ue = 'redo' OR ut < t)),
st AS (
  SELECT session_id, CAST(0 AS BIGINT) AS k, list({'r': root_id, 'p': parent_id, 'o': ''}) AS s FROM (SELECT DISTINCT session_id, root_id, parent_id FROM label_map WHERE numeric_label >= 0) GROUP BY session_id
  UNION ALL
  SELECT st.session_id, f.k, CASE f.type
    WHEN 'create_root' THEN list_append(list_filter(s, lambda x: x.r <> f.r), {'r': f.r, 'p': f.p, 'o': f.oid})
    WHEN 'reparent_root' THEN list_transform(s, lambda x: CASE WHEN x.r = f.r THEN {'r': x.r, 'p': f.p, 'o': f.oid} ELSE x END)
    WHEN 'delete_root' THEN list_transform(list_filter(s, lambda x: x.r <> f.r), lambda x: CASE WHEN x.p = f.r THEN {'r': x.r, 'p': list_filter(s, lambda y: y.r = f.r)[1].p, 'o': x.o} ELSE x END)
    WHEN 'merge_roots' THEN list_transform(list_filter(s, lambda x: x.r <> f.src), lambda x: {'r': x.r, 'p': CASE WHEN x.p = f.src THEN f.r ELSE x.p END, 'o': CASE WHEN x.r = f.r THEN f.oid ELSE x.o END})
    ELSE list_transform(s, lambda x: CASE WHEN x.r = f.r THEN {'r': x.r, 'p': x.p, 'o': f.oid} ELSE x END) END
  FROM st JOIN f ON f.session_id = st.session_id AND f.k = st.k + 1),
z AS (SELECT session_id, arg_max(s, k) AS s FROM st GROUP BY session_id)
SELECT session_id, x.r AS root_id, x.p AS parent_id, x.o AS last_operation_id FROM (SELECT session_id, unnest(s) AS x FROM z) WHERE x.r <> 'primary'
"""

_findings = "SELECT sample_id, root_id, finding, top_root_id, CAST(depth AS BIGINT) AS depth FROM x WHERE finding IS NOT NULL"

ORACLES: dict[str, str] = {
    "p4_checked": """WITH now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, root_id, run_no ORDER BY loaded_at DESC) AS rn FROM traits) WHERE rn = 1),
v AS (SELECT accession, root_order, 'length' AS metric, length AS value FROM now WHERE length_measurement_eligible UNION ALL SELECT accession, root_order, 'mean_diameter', mean_diameter FROM now WHERE mean_diameter_measurement_eligible),
w AS (SELECT * FROM v WHERE isfinite(value) AND value > 0)
SELECT 'group' AS level, accession, root_order, metric, count(*) AS n, true AS p10_holds, true AS p50_holds, true AS p90_holds, true AS p99_holds FROM w GROUP BY ALL
UNION ALL SELECT 'total', NULL, root_order, metric, count(*), true, true, true, true FROM w GROUP BY ALL""",
    "p3_found": _replay,
    "p2_found": _evidence + "SELECT calibration_id, CASE WHEN outcome = 'converted' THEN CAST(round(number * factor * 1000) AS BIGINT) ELSE CAST(-1 AS BIGINT) END AS extent_um FROM o WHERE outcome NOT IN ('no_number', 'as_it_stands')",
    "p2_extents": _evidence + "SELECT calibration_id, round(number * factor, 6) AS extent_mm, outcome FROM o",
    "p1_schema": r"""WITH f AS (SELECT file_id, station_id, written_at, received_at, ltrim(body, chr(65279)) AS body FROM sessions WHERE file_id IS NOT NULL AND station_id IS NOT NULL AND written_at IS NOT NULL),
g AS (SELECT * FROM f WHERE json_valid(body)), r AS (SELECT * FROM g WHERE json_type(body) = 'OBJECT'),
o AS (SELECT file_id, arg_min(written_at, received_at) AS written_at, arg_min(body, received_at) AS body FROM r GROUP BY file_id),
t AS (SELECT o.file_id, o.written_at, t.fullkey, t.type FROM o, json_tree(o.body) t),
k AS (SELECT DISTINCT file_id, written_at, replace(substr(fullkey, 3), '"', '') AS path, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM t WHERE fullkey <> '$' AND fullkey NOT LIKE '%[%'),
c AS (SELECT path, kind, count(*) AS files, arg_min(file_id, {'w': written_at, 'f': file_id}) AS first_file_id, arg_max(file_id, {'w': written_at, 'f': file_id}) AS last_file_id FROM k GROUP BY path, kind)
SELECT path, kind, files, first_file_id, last_file_id, CAST(count(kind) OVER (PARTITION BY path) AS INTEGER) AS alternatives FROM c""",
    "p5_found": HIERARCHY + _findings,
    "p5_faults_by_joins": HIERARCHY + _findings,
    "p5_hierarchy": HIERARCHY + """, t AS (SELECT sample_id, origin AS k, looped, first, list_reverse(seen[1:CASE WHEN looped THEN first + 1 ELSE links + 1 END]) AS line FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY sample_id, line[1] ORDER BY line) - 1 AS pre, len(line) - 1 AS deep FROM t),
up AS (SELECT sample_id, k, unnest(line) AS a, generate_subscripts(line, 1) AS i FROM t),
below AS (SELECT sample_id, a AS k, count(*) - 1 AS descendants FROM up GROUP BY ALL),
names AS (SELECT up.sample_id, up.k, string_agg(n.root_id, '/' ORDER BY i) AS path FROM up JOIN n ON n.sample_id = up.sample_id AND n.k = up.a GROUP BY ALL)
SELECT p.sample_id, l.root_id, m.root_id AS parent_root_id, nullif(l.root_order, -1) AS root_order, CASE WHEN NOT p.looped THEN 'tree' WHEN p.first = 0 THEN 'cycle' ELSE 'below_cycle' END AS kind, x.top_root_id, CAST(p.deep AS BIGINT) AS depth,
 CAST(2 * pre - deep AS BIGINT) AS entry, CAST(2 * pre - deep + 2 * descendants + 1 AS BIGINT) AS exit, CAST(descendants AS BIGINT) AS descendants, names.path
FROM p JOIN l USING (sample_id, k) LEFT JOIN n m ON m.sample_id = l.sample_id AND m.k = l.up JOIN below USING (sample_id, k) JOIN names USING (sample_id, k) JOIN x ON x.sample_id = p.sample_id AND x.root_id = l.root_id""",
}

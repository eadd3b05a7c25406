"""Trees of roots: checks, orders, subtrees, stable numbers, corrections. Built on the hierarchy operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arborline.common import normal_key, running, stored
from arborline.functions import geometry as g
from arborline.functions.text import stable_id
from arborline.operators.hierarchy import current_links, hierarchies


def orders(roots: DataFrame) -> DataFrame:
    """The order of each root as its depth below ``primary``: sample_id, root_id, tree_order; missing off that tree."""
    h = hierarchies(roots)
    on = (F.col("kind") == "tree") & (normal_key("top_root_id") == "primary")
    return h.select("sample_id", "root_id", F.when(on, F.col("depth")).alias("tree_order"))


def descendants(roots: DataFrame) -> DataFrame:
    """The number of descendants of each root that is not on or below a circle."""
    return hierarchies(roots).filter("kind = 'tree'").select("sample_id", "root_id", "descendants")


def closure(roots: DataFrame) -> DataFrame:
    """Every (ancestor, descendant, links) pair: sample_id, ancestor_id, root_id, links; a root is its own at 0 links.

    The size is that of the result, the summed depths; paths of the hierarchy are taken apart, nothing is joined.
    """
    h = hierarchies(roots, paths=True).filter("kind = 'tree'")
    return h.select("sample_id", "root_id", F.posexplode("path").alias("k", "ancestor_id"), F.size("path").alias("n")).select("sample_id", "ancestor_id", "root_id", (F.col("n") - 1 - F.col("k")).cast("long").alias("links"))


def violations(roots: DataFrame) -> DataFrame:
    """One row per breach: sample_id, root_id, breach.

    repeated_id (one id with several differing rows), unknown_parent, order (not the parent's plus one), no_insertion (a lateral without an
    insertion), cycle, unreachable (not under primary).
    """
    rows = roots.select("sample_id", "root_id", normal_key("root_id").alias("key"), normal_key("parent_id").alias("parent_key"), "root_order", "insertion_index", "recorded_at").distinct()
    repeated = rows.groupBy("sample_id", "key").agg(F.count("*").alias("n"), F.max_by("root_id", "recorded_at").alias("root_id")).filter("n > 1").select("sample_id", "root_id", F.lit("repeated_id").alias("breach"))
    latest = rows.groupBy("sample_id", "key").agg(F.max(F.struct("recorded_at", "root_id", "parent_key", "root_order", "insertion_index")).alias("r")).select("sample_id", "key", "r.*")
    up = latest.select("sample_id", F.col("key").alias("parent_key"), F.col("root_order").alias("parent_order"), F.lit(True).alias("known"))
    linked = latest.join(up, ["sample_id", "parent_key"], "left")
    h = hierarchies(roots).select("sample_id", "root_id", "kind", normal_key("top_root_id").alias("top"))
    per = linked.join(h, ["sample_id", "root_id"], "left")
    has = F.col("parent_key").isNotNull()
    found = F.array_compact(F.array(
        F.when(has & F.col("known").isNull(), F.lit("unknown_parent")),
        F.when(has & F.col("known") & (F.col("root_order") != F.col("parent_order") + 1), F.lit("order")),
        F.when(has & F.col("insertion_index").isNull(), F.lit("no_insertion")),
        F.when(F.col("kind") == "cycle", F.lit("cycle")),
        F.when((F.col("kind") == "tree") & (F.col("top") != "primary"), F.lit("unreachable")),
    ))
    return per.select("sample_id", "root_id", F.explode(found).alias("breach")).unionByName(repeated)


def prune(roots: DataFrame, offending: DataFrame) -> DataFrame:
    """The roots that are neither in ``offending`` (sample_id, root_id) nor below one: sample_id, root_id.

    A root goes if the interval of an offender in the Euler tour holds its own, that is, if of the offenders that begin
    before it one ends after it: a running maximum along the tour. Roots on and below circles are left out.
    """
    h = hierarchies(roots).filter("kind = 'tree'").select("sample_id", "root_id", F.col("top_root_id").alias("top"), "entry", "exit")
    off = offending.select("sample_id", "root_id").distinct().withColumn("_off", F.lit(True))
    t = h.join(off, ["sample_id", "root_id"], "left").withColumn("_ends", F.when(F.col("_off"), F.col("exit"))).drop("_off")
    covered = running(t, ["sample_id", "top"], ["entry"], "_ends", "_covered", "max")
    return covered.filter("_covered is null or _covered < exit").select("sample_id", "root_id")


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``number``, 1, 2, ... per key in an order, like row_number, but no key passes through one task.

    The order must be unique within a key. Rows are numbered within ranges of (key, order), after the counts of the ranges before.
    """
    return running(df.withColumn("_one", F.lit(1).cast("long")), [key], order, "_one", "number").drop("_one")


def stable_ids(roots: DataFrame) -> DataFrame:
    """New ids ``root-o{order}-{number}`` under primary: sample_id, root_id, stable_id.

    Numbers count per order, in the order of (insertion_index, id) along the path from the top, so that siblings are
    numbered by where they leave their parent; primary keeps its name. That order is the one of an Euler tour in which
    siblings are named by where they leave, so no path is taken apart.
    """
    now = roots.groupBy("sample_id", normal_key("root_id").alias("key")).agg(F.max(F.struct("recorded_at", "root_id", normal_key("parent_id").alias("parent_key"), "insertion_index")).alias("r"))
    place = F.concat(F.lpad(F.coalesce(F.col("r.insertion_index").cast("string"), F.lit("9999999999")), 10, "0"), F.lit(":"), F.col("key"))
    now = stored(now.filter("sample_id is not null and key is not null").select("sample_id", "key", "r.root_id", "r.parent_key", place.alias("place")))
    up = now.select("sample_id", F.col("key").alias("parent_key"), F.col("place").alias("parent_place"))
    named = now.join(up, ["sample_id", "parent_key"], "left").select("sample_id", F.col("place").alias("root_id"), F.col("parent_place").alias("parent_id"), F.lit(0).alias("root_order"), F.lit(0).alias("recorded_at"))
    h = hierarchies(named).filter("kind = 'tree'").select("sample_id", F.col("root_id").alias("place"), "top_root_id", "depth", "entry")
    h = h.join(now.select("sample_id", "place", "key", "root_id"), ["sample_id", "place"]).filter(F.expr("substring(top_root_id, 12)") == "primary")
    out = numbered(h.withColumn("group", F.concat_ws("/", "sample_id", "depth")), "group", ["entry"])
    return out.select("sample_id", "root_id", F.when(F.col("depth") == 0, F.col("root_id")).otherwise(stable_id(F.col("depth"), F.col("number"))).alias("stable_id"))


def length_review(roots: DataFrame, lengths: DataFrame) -> DataFrame:
    """Children against parents: sample_id, root_id, ratio, exceeds, penalty. ``lengths``: sample_id, root_id, length."""
    links = current_links(roots)
    own = links.join(lengths, ["sample_id", "root_id"]).select("sample_id", "key", "root_id", "parent_key", "length")
    up = own.select("sample_id", F.col("key").alias("parent_key"), F.col("length").alias("parent_length"))
    c, p = F.col("length"), F.col("parent_length")
    return own.join(up, ["sample_id", "parent_key"]).filter("length is not null and parent_length is not null").select("sample_id", "root_id", g.ratio(c, p).alias("ratio"), g.exceeds_parent(c, p).alias("exceeds"), g.excess_penalty(c, p).alias("penalty"))


def repair_cycles(roots: DataFrame, top: str = "primary") -> DataFrame:
    """For each circle the root that is hung on ``top`` to break it: the one of least confidence, then of least id.

    sample_id, root_id, old_parent_id, new_parent_id. One cut per circle suffices, since every root has one parent.
    """
    h = hierarchies(roots).filter("kind = 'cycle'")
    c = roots.groupBy("sample_id", "root_id").agg(F.max(F.struct("recorded_at", "confidence")).alias("r")).select("sample_id", "root_id", F.col("r.confidence").alias("confidence"))
    worst = h.join(c, ["sample_id", "root_id"], "left").groupBy("sample_id", "top_root_id").agg(F.min(F.struct("confidence", "root_id", "parent_root_id")).alias("w"))
    return worst.select("sample_id", F.col("w.root_id").alias("root_id"), F.col("w.parent_root_id").alias("old_parent_id"), F.lit(top).alias("new_parent_id"))


def apply_corrections(roots: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewed links put over the automatic ones, and what was refused.

    ``corrections``: sample_id, root_id, parent_id, valid, fingerprint; ``roots`` with a column ``fingerprint``. A
    correction is refused as repeated, unknown or stale (another fingerprint); the others set the parent, take out roots
    that are not valid, and leave confidence 0 and the flag ``reviewed`` behind. A result with new circles shows in
    ``violations``.
    """
    c = corrections.withColumn("n", F.count("*").over(W.partitionBy("sample_id", "root_id")))
    own = roots.select("sample_id", "root_id", F.col("fingerprint").alias("own"), F.lit(True).alias("known"))
    c = c.join(own, ["sample_id", "root_id"], "left")
    reason = F.when(F.col("n") > 1, "repeated").when(F.col("known").isNull(), "unknown").when(~F.col("fingerprint").eqNullSafe(F.col("own")), "stale")
    c = c.withColumn("reason", reason)
    good = c.filter("reason is null").select("sample_id", "root_id", F.col("parent_id").alias("new_parent"), "valid", F.lit(True).alias("touched"))
    out = roots.join(good, ["sample_id", "root_id"], "left").filter("touched is null or valid")
    touched = F.coalesce("touched", F.lit(False))
    out = out.withColumn("parent_id", F.when(touched, F.col("new_parent")).otherwise(F.col("parent_id"))).withColumn("confidence", F.when(touched, F.lit(0.0)).otherwise(F.col("confidence")))
    out = out.withColumn("qc_flags", F.when(touched, F.array_union(F.coalesce("qc_flags", F.array().cast("array<string>")), F.array(F.lit("reviewed")))).otherwise(F.col("qc_flags")))
    return out.select(*roots.columns), c.filter("reason is not null").select("sample_id", "root_id", "reason")

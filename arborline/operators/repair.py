"""Repairs of traced hierarchies and surfaces, as joins on frozen tables.

A rule looks at one state of all roots or vertices, scores pairs by column expressions, and proposes changes; what two
rows propose for the same thing is settled by rank or withheld, so that the outcome does not depend on any order of rows.
``spacing`` is the mean distance of neighbouring points. Bounds are fixed values that make results comparable.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arborline.common import stored
from arborline.functions import geometry as g
from arborline.operators import ownership, spatial, tree

# Links


def attachment_confidence(attach: Column, separation: Column, length: Column, support: Column, trace: Column) -> Column:
    """How well a root hangs on its parent; all features scaled to 0..1."""
    return 0.42 * attach + 0.23 * separation + 0.18 * length + 0.10 * support + 0.07 * trace


def quality_flags(gap: Column, length: Column, confidence: Column, spacing: float) -> Column:
    """``attachment_gap``, ``short_trace`` and ``low_confidence`` where they apply; missing values raise no flag."""
    tolerance = max(6 * spacing, 0.008)
    return F.array_compact(F.array(
        F.when(gap > tolerance, "attachment_gap"), F.when(length < max(8 * spacing, 0.008), "short_trace"), F.when(confidence < 0.55, "low_confidence"),
    ))


def promote_base_children(roots: DataFrame, reach: float) -> DataFrame:
    """Roots that leave their parent at its very base are hung on the grandparent, again and again: root_id, parent_id, steps.

    ``roots``: sample_id, root_id, parent_id, ix, iy, iz (insertion), sx, sy, sz (seed), bx, by, bz (base). A root goes up if
    its insertion is within ``reach`` of its parent's base and its seed within ``reach`` of the grandparent's base. All
    roots go up at once, against the links as they were; the number of rounds is at most the greatest depth, since no root
    comes to a parent again that it had (or to itself). Missing places keep their links.
    """
    base = roots.select("sample_id", F.col("root_id").alias("p"), F.col("parent_id").alias("pp"), *(F.col(f"b{a}").alias(f"p{a}") for a in "xyz"))
    grand = roots.select("sample_id", F.col("root_id").alias("pp"), *(F.col(f"b{a}").alias(f"q{a}") for a in "xyz"))
    # What each link would do next does not change from round to round, so that it is joined once.
    up = base.join(grand, ["sample_id", "pp"])
    state = roots.select("sample_id", "root_id", F.col("parent_id").alias("p"), F.lit(0).alias("steps"), F.array("root_id", "parent_id").alias("seen"), *(f"{k}{a}" for k in "is" for a in "xyz"))
    done = None
    while True:
        j = state.join(up, ["sample_id", "p"], "left")
        near = (g.norm(g.minus(g.xyz("i"), g.xyz("p"))) <= reach) & (g.norm(g.minus(g.xyz("s"), g.xyz("q"))) <= reach) & ~F.array_contains("seen", F.col("pp"))
        j = stored(j.withColumn("goes", F.coalesce(near, F.lit(False))))
        out = j.filter("not goes").select("sample_id", "root_id", F.col("p").alias("parent_id"), "steps")
        done = out if done is None else done.unionByName(out)
        moving = j.filter("goes")
        if moving.isEmpty():
            return done
        state = moving.select("sample_id", "root_id", F.col("pp").alias("p"), (F.col("steps") + 1).alias("steps"), F.array_append("seen", F.col("pp")).alias("seen"), *(f"{k}{a}" for k in "is" for a in "xyz"))


def parallel_duplicates(pairs: DataFrame, spacing: float) -> DataFrame:
    """Children that only repeat their parent: child_id, parent_id, duplicate.

    ``pairs``: child_id, parent_id, distance (of each child node to the parent), tip (whether it is the child's last node),
    angle (axial, to the parent's direction), shorter (length of the shorter of the two), shared, support (points of the
    child that both have, and all of them). Four fifths of the nodes and the tip must be near, and either the support is
    shared or the distances are very small.
    """
    near = F.col("distance") <= F.greatest(F.lit(12 * spacing), 0.08 * F.col("shorter"))
    s = pairs.withColumn("near", near).groupBy("child_id", "parent_id").agg(
        F.avg(F.col("near").cast("double")).alias("share"), F.max(F.when(F.col("tip"), F.col("near"))).alias("tip_near"), F.max(F.when(F.col("tip"), F.col("distance"))).alias("tip_distance"),
        F.avg("angle").alias("angle"), F.percentile("distance", 0.9).alias("p90"), F.max("shorter").alias("shorter"), F.max("shared").alias("shared"), F.max("support").alias("support"),
    )
    common = (F.col("shared") >= 3) & (F.col("shared") >= 0.65 * F.col("support"))
    close = (F.col("p90") <= F.greatest(F.lit(3 * spacing), 0.015 * F.col("shorter"))) & (F.col("tip_distance") <= F.greatest(F.lit(4 * spacing), 0.02 * F.col("shorter"))) & (F.col("angle") <= 15)
    verdict = (F.col("share") >= 0.8) & F.col("tip_near") & (F.col("angle") <= 30) & (common | close)
    return s.select("child_id", "parent_id", F.coalesce(verdict, F.lit(False)).alias("duplicate"))


def absorb(links: DataFrame, merged: DataFrame) -> DataFrame:
    """Links after roots were merged into others: root_id, parent_id of those left; children of a merged root go where it went.

    ``links``: root_id, parent_id; ``merged``: root_id, into. Chains of merges are followed by pointer doubling; merges in a
    circle keep their roots.
    """
    m = stored(merged.groupBy("root_id").agg(F.min("into").alias("at")).filter("root_id <> at").withColumn("whole", F.lit(False)))
    while True:
        nxt = m.select(F.col("root_id").alias("at"), F.col("at").alias("at2"))
        step = m.join(nxt, "at", "left").select("root_id", F.coalesce("at2", "at").alias("at"), F.col("at2").isNull().alias("whole")).withColumn("circle", F.col("root_id") == F.col("at"))
        on_circle = step.filter("circle").select("root_id")
        m = stored(step.filter("not circle").join(on_circle.select(F.col("root_id").alias("at")), "at", "left_anti").select("root_id", "at", "whole"))
        if m.filter("not whole").isEmpty():
            break
    ends = m.select("root_id", F.col("at").alias("end"))
    left = links.join(ends, "root_id", "left_anti")
    return left.join(ends.select(F.col("root_id").alias("parent_id"), "end"), "parent_id", "left").select("root_id", F.coalesce("end", "parent_id").alias("parent_id"))


def fork_review(candidates: DataFrame, spacing: float, gain: float = 0.05) -> DataFrame:
    """Which continuation each parent takes at a fork: parent_id, child_id, place, score, accepted.

    ``candidates``: parent_id, root_order, child_id, direction, fork, length (scaled), child_length, parent_length, and the
    same of the present continuation as own_direction, own_fork, own_length; connected (by the mesh, null: no mesh). A
    swap must gain in direction and fork evidence, with and without the penalty of length, must be connected, and lengthen the
    continuation by more than max(8 spacings, 5 percent). The best accepted child of a parent counts (ties: smallest id);
    places are those of a queue by (order, parent).
    """
    independent = (0.55 * F.col("direction") + 0.35 * F.col("fork")) - (0.55 * F.col("own_direction") + 0.35 * F.col("own_fork"))
    score = ownership.fork_score(F.col("direction"), F.col("fork"), F.col("length"), F.col("child_length"), F.col("parent_length"))
    own = 0.55 * F.col("own_direction") + 0.35 * F.col("own_fork") + 0.10 * F.col("own_length")
    longer = F.col("child_length") - F.col("parent_length") > F.greatest(F.lit(8 * spacing), 0.05 * F.col("parent_length"))
    ok = (independent > gain) & (score - own > gain) & longer & F.coalesce("connected", F.lit(True))
    c = candidates.select("parent_id", "root_order", "child_id", score.alias("score"), F.coalesce(ok, F.lit(False)).alias("accepted"))
    best = c.groupBy("parent_id", "root_order").agg(F.max_by(F.struct("child_id", "score", "accepted"), F.struct("accepted", "score", -F.col("child_id"))).alias("m"))
    out = best.select("parent_id", "root_order", "m.*")
    return tree.numbered(out.withColumn("_all", F.lit(1)), "_all", ["root_order", "parent_id"]).select("parent_id", "child_id", F.col("number").alias("place"), "score", "accepted")


def continuation_joins(tips: DataFrame, starts: DataFrame, reach: float, angle: float = 45.0) -> DataFrame:
    """Tips that go on in exactly one start, which goes on from exactly one tip: tip_id, start_id, distance.

    ``tips``: id, root, x, y, z, dx, dy, dz (direction at the end); ``starts``: id, root, x, y, z. A start must be within
    ``reach``, of another root, and lie ahead: at most ``angle`` degrees off the tip's direction.
    """
    near = spatial.within(tips.select(F.col("id").alias("a_id"), "x", "y", "z"), starts.select(F.col("id").alias("b_id"), "x", "y", "z"), reach)
    j = near.join(tips.select(F.col("id").alias("a_id"), F.col("root").alias("ra"), *(F.col(a).alias(f"t{a}") for a in "xyz"), "dx", "dy", "dz"), "a_id")
    j = j.join(starts.select(F.col("id").alias("b_id"), F.col("root").alias("rb"), *(F.col(a).alias(f"u{a}") for a in "xyz")), "b_id")
    ahead = g.directed_angle(g.xyz("d"), g.minus(g.xyz("u"), g.xyz("t")))
    ok = j.filter((F.col("ra") != F.col("rb")) & (ahead <= angle))
    one = lambda k: ok.groupBy(k).agg(F.count("*").alias("n")).filter("n = 1").select(k)
    return ok.join(one("a_id"), "a_id", "left_semi").join(one("b_id"), "b_id", "left_semi").select(F.col("a_id").alias("tip_id"), F.col("b_id").alias("start_id"), "distance")


def uncross(pairs: DataFrame) -> DataFrame:
    """Two roots that touch exchange what lies beyond the contact, where their radii say so: pair_id, a_path, b_path, swapped.

    ``pairs``: pair_id, a_path, b_path (arrays of nodes), a_cut, b_cut (number of nodes up to the contact), and the radii
    before and after it: a_before, a_after, b_before, b_after. Missing radii swap nothing.
    """
    keep = F.abs(F.col("a_before") - F.col("a_after")) + F.abs(F.col("b_before") - F.col("b_after"))
    turn = F.abs(F.col("a_before") - F.col("b_after")) + F.abs(F.col("b_before") - F.col("a_after"))
    swap = F.coalesce(turn < keep, F.lit(False))
    head = lambda k: F.slice(f"{k}_path", F.lit(1), F.col(f"{k}_cut"))
    rest = lambda k: F.slice(f"{k}_path", F.col(f"{k}_cut") + 1, F.size(f"{k}_path"))
    one = lambda k, o: F.when(swap, F.concat(head(k), rest(o))).otherwise(F.col(f"{k}_path"))
    return pairs.select("pair_id", one("a", "b").alias("a_path"), one("b", "a").alias("b_path"), swap.alias("swapped"))


def connector_merges(candidates: DataFrame, spacing: float) -> DataFrame:
    """Traces that run backwards onto their parent's base are put before the parent: root_id (of the parent), merged, path.

    ``candidates``: child_id, parent_id, child_path, parent_path (arrays of nodes), gap (from the child's start to the
    parent's start), angle (between the child's first and the parent's first direction), inside (share of the child's nodes
    within the parent's tube). A connector starts within 6 spacings of the parent's start, runs against it (150 degrees or
    more) and is mostly its own. Of several the one with the least gap, then the least id, counts.
    """
    c = candidates.filter((F.col("gap") <= max(6 * spacing, 0.008)) & (F.col("angle") >= 150) & (F.col("inside") < 0.5))
    best = c.groupBy("parent_id").agg(F.min_by(F.struct("child_id", "child_path", "parent_path"), F.struct("gap", "child_id")).alias("m"))
    return best.select(F.col("parent_id").alias("root_id"), F.col("m.child_id").alias("merged"), F.concat(F.reverse("m.child_path"), F.slice("m.parent_path", F.lit(2), F.greatest(F.size("m.parent_path") - 1, F.lit(0)))).alias("path"))


def basal_review(candidates: DataFrame, margin: float = 0.05) -> DataFrame:
    """The parent that the measured body of each root speaks for: root_id, old_parent_id, new_parent_id.

    ``candidates``: root_id, parent_id, current, support (measured sections on that body), gap. A root changes to the
    parent of most support (ties: least gap, then id) if that beats the current one by more than ``margin`` of all support.
    """
    best = candidates.groupBy("root_id").agg(
        F.max_by(F.struct("parent_id", "support"), F.struct(F.col("support"), -F.col("gap"), -F.col("parent_id"))).alias("m"),
        F.max(F.when(F.col("current"), F.struct("support", "parent_id"))).alias("c"), F.sum("support").alias("every"),
    )
    wins = (F.col("m.parent_id") != F.col("c.parent_id")) & (F.col("m.support") - F.col("c.support") > margin * F.col("every"))
    return best.filter(wins).select("root_id", F.col("c.parent_id").alias("old_parent_id"), F.col("m.parent_id").alias("new_parent_id"))


def repair_hierarchy(roots: DataFrame, least_confidence: float = 0.0, top: str = "primary") -> DataFrame:
    """Circles broken, weak subtrees pruned, orders and ids made anew: sample_id, root_id, parent_id, root_order, stable_id.

    ``roots`` as in ``hierarchy.hierarchies`` with insertion_index and confidence. The order of steps is fixed: circles
    first (``tree.repair_cycles``), then roots under ``least_confidence`` go with all below them, then what is left is
    numbered. Roots that do not hang on ``top`` stay out.
    """
    now = roots.groupBy("sample_id", "root_id").agg(F.max(F.struct("recorded_at", "parent_id", "root_order", "insertion_index", "confidence")).alias("r")).select("sample_id", "root_id", "r.*")
    cuts = tree.repair_cycles(now, top).select("sample_id", "root_id", "new_parent_id")
    mended = stored(now.join(cuts, ["sample_id", "root_id"], "left").withColumn("parent_id", F.coalesce("new_parent_id", "parent_id")).drop("new_parent_id"))
    kept = tree.prune(mended, mended.filter(F.col("confidence") < least_confidence).select("sample_id", "root_id"))
    left = stored(mended.join(kept, ["sample_id", "root_id"], "left_semi"))
    return left.drop("root_order").join(tree.orders(left).withColumnRenamed("tree_order", "root_order"), ["sample_id", "root_id"]).join(tree.stable_ids(left), ["sample_id", "root_id"]).select("sample_id", "root_id", "parent_id", "root_order", "stable_id")


# Surfaces


def trim_sections(points: DataFrame, factor: float = 1.35) -> DataFrame:
    """Points of a trunk's section that bulge towards a child: station, id, trimmed.

    ``points``: station, id, radial (distance from the axis), facing (whether it lies in the sector towards the child). The
    80th percentile of the facing sector is held against that of the flanks; where it is more than ``factor`` times as
    great, facing points beyond the flanks' are trimmed. Sections with fewer than five points on a side are left.
    """
    r = lambda f: F.when(F.count_if(f) >= 5, F.percentile(F.when(f, F.col("radial")), 0.8))
    s = points.groupBy("station").agg(r(F.col("facing")).alias("face"), r(~F.col("facing")).alias("flank"))
    trims = F.col("facing") & (F.col("face") > factor * F.col("flank")) & (F.col("radial") > F.col("flank"))
    return points.join(s, "station").select("station", "id", F.coalesce(trims, F.lit(False)).alias("trimmed"))


def guarded(edges: DataFrame, labels: DataFrame, proposal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A proposal (id, label) put over the labels as far as no root is lost or cut by it: labels, withheld labels.

    Changes that take vertices from, or give them to, a root that would be lost or come apart are withheld as a whole; the
    rest is checked again, until nothing is withheld.
    """
    open_ = proposal.select("id", F.col("label").alias("new")).join(labels, "id").filter("new <> label").select("id", "new", F.col("label").alias("old"))
    open_ = stored(open_)
    held = labels.select("label").limit(0)
    while True:
        after = labels.join(open_.select("id", "new"), "id", "left").select("id", F.coalesce("new", "label").alias("label"))
        bad = stored(ownership.splits(edges, labels, after).select("label"))
        if bad.isEmpty():
            return after, held.distinct()
        held = held.unionByName(bad)
        n = open_.count()
        open_ = stored(open_.join(bad.withColumnRenamed("label", "old"), "old", "left_anti").join(bad.withColumnRenamed("label", "new"), "new", "left_anti"))
        if open_.count() == n:  # the breaks lie in no change of these roots
            return labels, held.distinct()


def clean_surface(edges: DataFrame, labels: DataFrame, least: int = 3, share: float = 0.75) -> DataFrame:
    """Islands and holes of the final surface: id, label.

    A patch apart from its root's main body, or an unassigned one, goes to the owner with ``share`` of its border; one of
    fewer than ``least`` vertices without such an owner is unassigned. Main bodies stay.
    """
    t = ownership.patch_table(edges, labels)
    small = (F.col("label") > 0) & ~F.col("main")
    hole = F.col("label") == ownership.UNASSIGNED
    goes = (small | hole) & (F.col("share") >= share) & (F.col("neighbour") >= 0)
    new = F.when(goes, F.col("neighbour")).when(small & (F.col("vertices") < least), F.lit(ownership.UNASSIGNED))
    moves = t.select("patch", new.alias("new")).filter("new is not null")
    return ownership.patches(edges, labels).join(moves, "patch", "left").select("id", F.coalesce("new", "label").alias("label"))


def restrict_primary_contacts(edges: DataFrame, labels: DataFrame, orders: DataFrame, longest: float | None = None) -> DataFrame:
    """Roots of order 2 and above let go of the primary: the child's side of the contact becomes uncertain, where that is safe.

    ``edges``: u, v and, for ``longest``, length (longer edges are audited elsewhere, not repaired); ``labels``: id, label;
    ``orders``: label, root_order. A repair that would consume or split the child is withheld. Returns id, label.
    """
    e = edges if longest is None else edges.filter(F.col("length") <= longest)
    own = labels.join(orders, "label", "left")
    j = e.join(own.select(F.col("id").alias("u"), F.col("label").alias("ul"), F.col("root_order").alias("uo")), "u").join(own.select(F.col("id").alias("v"), F.col("label").alias("vl"), F.col("root_order").alias("vo")), "v")
    seam = j.filter((F.col("ul") == 0) & (F.col("vo") >= 2)).select(F.col("v").alias("id")).unionByName(j.filter((F.col("vl") == 0) & (F.col("uo") >= 2)).select(F.col("u").alias("id"))).distinct()
    return guarded(edges.select("u", "v"), labels, seam.withColumn("label", F.lit(ownership.UNCERTAIN)))[0]


def transfer_parent_patches(edges: DataFrame, labels: DataFrame, parents: DataFrame, share: float = 0.75) -> DataFrame:
    """Patches of a child that lie apart from its body on its own parent go to the parent as a whole: id, label.

    ``parents``: label, parent. At least ``share`` of a patch's border must be the parent's; transfers that would split or
    consume a root are withheld.
    """
    t = ownership.patch_table(edges, labels).filter((F.col("label") > 0) & ~F.col("main") & (F.col("share") >= share))
    own = t.join(parents, "label").filter(F.col("neighbour") == F.col("parent")).select("patch", F.col("parent").alias("new"))
    moves = ownership.patches(edges, labels).join(own, "patch").select("id", F.col("new").alias("label"))
    return guarded(edges, labels, moves)[0]


def wall_tracks(nodes: DataFrame, share: float = 0.8, turn: float = 120.0) -> DataFrame:
    """Laterals that only follow the primary's wall: root_id, on_wall, turned, wall_track.

    ``nodes``: root_id, node_id, gap (to the primary's surface), reach (distance that counts as on it), azimuth (degrees
    around the primary). A track has ``share`` of its nodes on the wall and goes round the primary by at most ``turn``
    degrees in all.
    """
    w = W.partitionBy("root_id").orderBy("node_id")
    step = F.abs(F.pmod(F.col("azimuth") - F.lag("azimuth").over(w) + 180.0, F.lit(360.0)) - 180.0)
    s = nodes.withColumn("step", step).groupBy("root_id").agg(F.avg((F.col("gap") <= F.col("reach")).cast("double")).alias("on_wall"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("turned"))
    return s.withColumn("wall_track", F.coalesce((F.col("on_wall") >= share) & (F.col("turned") <= turn), F.lit(False)))


def recover_arms(edges: DataFrame, labels: DataFrame, forked: DataFrame, least: int = 300) -> DataFrame:
    """Unassigned parts of at least ``least`` vertices next to exactly one root with an open fork go to it: id, label. ``forked``: label."""
    p = ownership.patches(edges, labels)
    big = p.filter(F.col("label") == ownership.UNASSIGNED).groupBy("patch").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("patch")
    at = p.select("id", "patch", "label").join(big, "patch", "left_semi")
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    owners = both.join(at.select(F.col("id").alias("u"), "patch"), "u").join(labels.select(F.col("id").alias("v"), F.col("label").alias("owner")), "v").join(forked.select(F.col("label").alias("owner")).distinct(), "owner", "left_semi")
    one = owners.groupBy("patch").agg(F.min("owner").alias("new"), F.max("owner").alias("high")).filter("new = high").select("patch", "new")
    return p.join(one, "patch", "left").select("id", F.coalesce("new", "label").alias("label"))


def nodule_candidates(patches: DataFrame) -> DataFrame:
    """Which bulges count as nodules: nodule_id, accepted.

    ``patches``: nodule_id, primary_id, compactness, normal_spread, neck_ratio, coverage, place (arc on the primary), size.
    Thresholds are fixed values. Those that pass are taken by falling compactness (then id), unless they overlap one taken
    before on the same primary (closer than the mean of both sizes). The bulges of one primary go through one task.
    """
    ok = (F.col("compactness") >= 0.10) & (F.col("normal_spread") >= 0.07) & (F.col("neck_ratio") >= 1.18) & (F.col("coverage") >= 0.25)
    p = patches.withColumn("fits", F.coalesce(ok & F.col("place").isNotNull() & F.col("size").isNotNull(), F.lit(False)))
    kind = patches.schema["nodule_id"].dataType.simpleString()

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["compactness", "nodule_id"], ascending=[False, True])
        kept: list[tuple[float, float]] = []
        ids = []
        for i, at, size in zip(pdf["nodule_id"], pdf["place"], pdf["size"]):
            if all(abs(at - q) >= (size + r) / 2 for q, r in kept):
                kept.append((at, size))
                ids.append(i)
        return pd.DataFrame({"nodule_id": ids})

    taken = p.filter("fits").select("primary_id", "nodule_id", "compactness", "place", "size").groupBy("primary_id").applyInPandas(take, f"nodule_id {kind}")
    return p.join(taken.withColumn("taken", F.lit(True)), "nodule_id", "left").select("nodule_id", F.coalesce("taken", F.lit(False)).alias("accepted"))


def curve_choice(candidates: DataFrame) -> DataFrame:
    """Which fitted curve each root takes: root_id, kind, score, reason; the prior one where none passes.

    ``candidates``: root_id, kind (prior, axis, regularised), sections (share measured), supported (whether its ends are),
    coverage, centring (75th percentile), ratio (of sampled lengths), backtrack (share), error. Bounds are fixed values.
    """
    reason = (
        F.when(F.col("sections") < 0.60, "sections").when(~F.col("supported"), "endpoint").when(F.col("coverage") < 0.80, "coverage").when(F.col("centring") > 0.35, "centring")
        .when(F.col("ratio") > 1.08, "length_ratio").when(F.col("backtrack") > 0.01, "backtrack")
    )
    c = candidates.select("root_id", "kind", (F.col("error") + 0.5 * (F.col("ratio") - 1)).alias("score"), reason.alias("reason"))
    best = c.groupBy("root_id").agg(F.min(F.when(F.col("reason").isNull() & F.col("score").isNotNull(), F.struct("score", "kind"))).alias("m"), F.min(F.when(F.col("kind") == "prior", F.coalesce("reason", F.lit("no_score")))).alias("why"))
    return best.select("root_id", F.coalesce("m.kind", F.lit("prior")).alias("kind"), F.col("m.score").alias("score"), F.when(F.col("m").isNull(), F.coalesce("why", F.lit("no_candidate"))).alias("reason"))


def remeasure_visible(nodes: DataFrame, roots: DataFrame, supported: DataFrame, hidden: DataFrame, mm_per_unit: float = 1.0) -> DataFrame:
    """The trait table after vertices were hidden as noise: ``tracing.root_traits`` without the nodes in ``hidden`` (root_id, node_id)."""
    from arborline.operators.tracing import root_traits

    return root_traits(nodes.join(hidden.select("root_id", "node_id").distinct(), ["root_id", "node_id"], "left_anti"), roots, supported, mm_per_unit)

"""Summaries of whole systems from per-root traits: eligibility, scopes, densities, spacing, distributions.

A missing value is null, never 0. An empty scope sums to 0; a scope that has roots but none with an eligible value is
missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arborline.common import finite, running
from arborline.functions import geometry as g

#: The states of a measurement.
STATES = ("complete", "partial", "unavailable", "excluded")

#: Steps between insertions up to this count as one place.
SAME_PLACE = 1e-9


def latest_traits(traits: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The newest measurement of each root: greatest run, then latest load; one row per (sample_id, root_id).

    ``columns``: those that are wanted (default: all), so that others are not read; rows that agree in run and load are
    told apart by them.
    """
    keep = [c for c in (traits.columns if columns is None else columns) if c not in ("sample_id", "root_id", "run_no", "loaded_at")]
    return traits.groupBy("sample_id", "root_id").agg(F.max(F.struct("run_no", "loaded_at", *keep)).alias("r")).select("sample_id", "root_id", "r.*")


def eligible(metric: str) -> Column:
    """A metric's value where it is eligible, finite and positive; else null."""
    v = finite(metric)
    return F.when(F.col(f"{metric}_measurement_eligible") & (v > 0), v)


def with_scopes(roots: DataFrame) -> DataFrame:
    """Each root once per scope it is in: system, laterals (order above 0), order_N."""
    n = F.col("root_order")
    scopes = F.array_compact(F.array(F.lit("system"), F.when(n > 0, F.lit("laterals")), F.when(n.isNotNull(), F.concat(F.lit("order_"), n.cast("string")))))
    return roots.withColumn("scope", F.explode(scopes))


def scope_summary(traits: DataFrame, by: list[str]) -> DataFrame:
    """Counts, sums, means, variation and percentiles of the eligible values per scope.

    Percentiles are linear between the ranks. Percentiles hold the distinct values of a group, which for counts of roots
    per sample or accession is small; for whole corpora use the sketches of ``quantiles``.
    """
    t = with_scopes(traits.select(*by, "root_order", eligible("length").alias("l"), eligible("mean_diameter").alias("d")))
    p = F.percentile("d", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9), F.lit(0.25), F.lit(0.75)))
    s = t.groupBy(*by, "scope").agg(
        F.count("*").alias("roots"), F.count("l").alias("eligible_roots"), F.sum("l").alias("total_length"), F.avg("l").alias("mean_length"),
        (F.stddev_samp("l") / F.avg("l")).alias("length_variation"), F.avg("d").alias("mean_diameter"), (F.stddev_samp("d") / F.avg("d")).alias("diameter_variation"), p.alias("p"),
    )
    e = lambda k: F.get("p", k)
    return s.select(
        *by, "scope", "roots", "eligible_roots", (F.col("roots") - F.col("eligible_roots")).alias("excluded_roots"), "total_length", "mean_length", "length_variation", "mean_diameter", "diameter_variation",
        e(0).alias("diameter_p10"), e(1).alias("diameter_p50"), e(2).alias("diameter_p90"), (e(4) - e(3)).alias("diameter_iqr"), g.ratio(F.col("total_length"), F.col("eligible_roots").cast("double")).alias("length_per_root"),
    )


def metrics_of(traits: DataFrame) -> list[str]:
    """The metrics of a trait table: columns that have a state, an eligibility and a value."""
    end = "_measurement_status"
    return [c[: -len(end)] for c in traits.columns if c.endswith(end) and f"{c[: -len(end)]}_measurement_eligible" in traits.columns and c[: -len(end)] in traits.columns]


def metric_rollup(traits: DataFrame, by: list[str], metrics: list[str] | None = None) -> DataFrame:
    """Every metric of every scope in one pass: by, scope, metric, roots, eligible, total, mean, variation, p10, p50, p90, iqr.

    ``metrics``: by default all that the table has. A scope without an eligible value of a metric has missing figures.
    """
    names = metrics_of(traits) if metrics is None else metrics
    values = F.array(*(F.struct(F.lit(m).alias("metric"), eligible(m).alias("v")) for m in names))
    t = with_scopes(traits.select(*by, "root_order", F.explode(values).alias("m")).select(*by, "root_order", "m.*"))
    s = t.groupBy(*by, "scope", "metric").agg(
        F.count("*").alias("roots"), F.count("v").alias("eligible"), F.sum("v").alias("total"), F.avg("v").alias("mean"), (F.stddev_samp("v") / F.avg("v")).alias("variation"),
        F.percentile("v", F.array(*map(F.lit, (0.1, 0.5, 0.9, 0.25, 0.75)))).alias("p"),
    )
    e = lambda k: F.get("p", k)
    return s.select(*by, "scope", "metric", "roots", "eligible", "total", "mean", "variation", e(0).alias("p10"), e(1).alias("p50"), e(2).alias("p90"), (e(4) - e(3)).alias("iqr"))


def status_counts(traits: DataFrame, by: list[str], metrics: list[str] | None = None) -> DataFrame:
    """Roots per state of each metric: by, metric, complete, partial, unavailable, excluded, other. ``metrics``: by default all that have a state."""
    names = metrics or [c.removesuffix("_measurement_status") for c in traits.columns if c.endswith("_measurement_status")]
    parts = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_measurement_status").alias("status")) for m in names))
    t = traits.select(*by, F.explode(parts).alias("m")).select(*by, "m.*")
    return t.groupBy(*by, "metric").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATES), F.count_if(~F.coalesce(F.col("status").isin(*STATES), F.lit(False))).alias("other"))


def laterals_by_order(traits: DataFrame, by: list[str]) -> DataFrame:
    return traits.filter((F.col("root_order") > 0) & eligible("length").isNotNull()).groupBy(*by, "root_order").agg(F.count("*").alias("laterals"))


def system_summary(traits: DataFrame, by: list[str]) -> DataFrame:
    """Key and value rows of a system: by, trait, value (unpivoted from one aggregate pass)."""
    l, d = eligible("length"), eligible("mean_diameter")
    lateral = F.col("root_order") > 0
    one = traits.groupBy(*by).agg(
        F.count("*").cast("double").alias("root_count"), F.count_if(lateral).cast("double").alias("lateral_count"), F.max("root_order").cast("double").alias("max_order"),
        F.sum(l).alias("total_length"), F.sum(F.when(lateral, l)).alias("lateral_length"), F.avg(d).alias("mean_diameter"), F.sum(finite("volume")).alias("total_volume"),
        F.count_if(F.col("length_measurement_status") == "complete").cast("double").alias("complete_lengths"),
    )
    return one.unpivot(by, [c for c in one.columns if c not in by], "trait", "value")


def branch_density(children: DataFrame, parents: DataFrame, by: list[str]) -> DataFrame:
    """Eligible children per length of their distinct parents: by, children, parents, unusable_parents, parent_length, density.

    ``children``: by, parent_id, ok; ``parents``: by, root_id, length (null: not eligible). Missing if any parent is unusable.
    """
    n = children.groupBy(*by, "parent_id").agg(F.count_if("ok").alias("n"))
    p = n.join(parents.select(*by, F.col("root_id").alias("parent_id"), "length"), [*by, "parent_id"], "left")
    s = p.groupBy(*by).agg(F.sum("n").alias("children"), F.count("*").alias("parents"), F.count_if(F.col("length").isNull()).alias("unusable_parents"), F.sum("length").alias("parent_length"))
    return s.withColumn("density", F.when(F.col("unusable_parents") == 0, g.ratio(F.col("children").cast("double"), F.col("parent_length"))))


def branch_gaps(branches: DataFrame, by: list[str], distinct: bool = False) -> DataFrame:
    """Steps between consecutive insertions on a parent: by, gaps, mean_gap, coincident.

    ``branches``: by, root_id, arc. Order is (arc, root_id); steps up to SAME_PLACE are coincident; with ``distinct`` they
    are left out and the next step counts from the first at a place. The mean of consecutive steps is the span over their
    number, but the number of distinct places needs the steps: a window per parent, over its places only (repeats of an
    arc are counted before it), so that a parent with very many branches at few places is small.
    """
    places = branches.filter(finite("arc").isNotNull()).groupBy(*by, "arc").agg(F.count("*").alias("n"))
    w = W.partitionBy(*by).orderBy("arc")
    g_ = places.withColumn("gap", F.col("arc") - F.lag("arc").over(w))
    near = F.col("gap") <= SAME_PLACE
    if distinct:
        kept = g_.filter(~near | F.col("gap").isNull()).withColumn("gap", F.col("arc") - F.lag("arc").over(w))
        return kept.groupBy(*by).agg(F.count("gap").alias("gaps"), F.avg("gap").alias("mean_gap"), F.count_if(F.col("gap") <= SAME_PLACE).alias("coincident"))
    s = g_.groupBy(*by).agg(F.sum("n").alias("n"), F.max("arc").alias("high"), F.min("arc").alias("low"), (F.sum(F.col("n") - 1) + F.count_if(near)).alias("coincident"))
    return s.select(*by, (F.col("n") - 1).alias("gaps"), g.ratio(F.col("high") - F.col("low"), (F.col("n") - 1).cast("double")).alias("mean_gap"), "coincident")


def distribution(traits: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """The empirical distribution function: by, value, n, cumulative (share up to the value). A group with very many values is summed in ranges."""
    t = traits.select(*by, eligible(metric).alias("value")).filter("value is not null")
    n = running(t.groupBy(*by, "value").agg(F.count("*").alias("n")), by, ["value"], "n", "_up_to")
    every = n.groupBy(*by).agg(F.sum("n").alias("_every"))
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by]
    return n.alias("n").join(every.alias("e"), same).select(*(f"n.{c}" for c in by), "value", "n", (F.col("_up_to") / F.col("_every")).alias("cumulative"))


def inventory(roots: DataFrame, traits: DataFrame) -> DataFrame:
    """All current roots, with the newest traits where there are any: one row per root, both sides reduced to one row per key first."""
    now = roots.groupBy("sample_id", "root_id").agg(F.max(F.struct("recorded_at", "parent_id", "root_order", "confidence")).alias("r")).select("sample_id", "root_id", "r.parent_id", "r.root_order", "r.confidence")
    t = latest_traits(traits, ["length", "length_measurement_status", "length_measurement_eligible", "mean_diameter", "mean_diameter_measurement_eligible"]).select("sample_id", "root_id", eligible("length").alias("length"), "length_measurement_status", eligible("mean_diameter").alias("mean_diameter"))
    return now.join(t, ["sample_id", "root_id"], "left")


def ranked(candidates: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """Candidates by falling score with the margin to the next one: rank, margin (missing at the last)."""
    w = W.partitionBy(*by).orderBy(F.desc(score), tie)
    return candidates.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col(score) - F.lead(score).over(w))


#: What the ends of column names mean.
SUFFIXES = {
    "_measurement_status": "state of the measurement: complete, partial, unavailable or excluded",
    "_measurement_eligible": "whether the value may enter summaries",
    "_measurement_reason": "why the value is partial, missing or excluded",
    "_id": "identifier",
    "_at": "time",
}


def dictionary(df: DataFrame) -> DataFrame:
    """A description of each column of a table: column, type, meaning."""
    rows = [(n, t, next((m for s, m in SUFFIXES.items() if n.endswith(s)), "value in mm" if t == "double" else "attribute")) for n, t in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "column string, type string, meaning string")

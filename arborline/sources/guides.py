"""Small inputs that people give: endpoints, reviewed labels, reviews; bound to the data they were made for."""

from __future__ import annotations

import csv
import io
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_endpoints(text: str) -> dict[str, tuple[float, float, float]]:
    """``start`` and ``end`` from JSON (``{"start": [x, y, z], "end": ...}``), a CSV with name, x, y, z, or six numbers."""
    text = text.strip()
    if text.startswith("{"):
        held = json.loads(text)
        out = {k: tuple(map(float, held[k])) for k in ("start", "end")}
    elif re.match(r"(?i)\s*name\s*,", text):
        rows = csv.DictReader(io.StringIO(text))
        out = {r["name"].strip().lower(): (float(r["x"]), float(r["y"]), float(r["z"])) for r in rows}
    else:
        n = [float(x) for x in re.split(r"[,;\s]+", text) if x]
        if len(n) != 6:
            raise ValueError("six numbers, a table or an object is needed")
        out = {"start": tuple(n[:3]), "end": tuple(n[3:])}
    if set(out) != {"start", "end"} or any(len(p) != 3 for p in out.values()) or out["start"] == out["end"]:
        raise ValueError("a start and another end of three numbers each are needed")
    return out


def apply_reviewed_labels(labels: DataFrame, reviewed: DataFrame, fingerprint: str, expected: str, tolerance: float = 0.02) -> DataFrame:
    """Reviewed labels put over the automatic ones: id, label.

    Raises if the geometry's fingerprint is not the one that was reviewed, or if more than ``tolerance`` of the reviewed
    ids are not there. ``reviewed``: id, label.
    """
    if fingerprint != expected:
        raise ValueError("the review was made for another geometry")
    n = reviewed.join(labels.select("id", F.lit(True).alias("known")), "id", "left").agg(F.count("*").alias("every"), F.count("known").alias("known")).first()
    if n["every"] and (n["every"] - n["known"]) > tolerance * n["every"]:
        raise ValueError(f"{n['every'] - n['known']} of {n['every']} reviewed vertices are not there")
    return labels.join(reviewed.select("id", F.col("label").alias("_new")), "id", "left").select("id", F.coalesce("_new", "label").alias("label"))


def apply_reviews(objects: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects that were not rejected, and the reviews that fit none: (objects), (object_id, reason).

    ``objects``: object_id, fingerprint, ...; ``reviews``: object_id, fingerprint, accepted. A review of another
    fingerprint is stale and changes nothing; of several the rejecting one counts.
    """
    r = reviews.groupBy("object_id", "fingerprint").agg(F.min("accepted").alias("accepted"))
    own = objects.select("object_id", F.col("fingerprint").alias("own"), F.lit(True).alias("known"))
    j = r.join(own, "object_id", "left")
    refused = j.select("object_id", F.when(F.col("known").isNull(), "unknown").when(~F.col("fingerprint").eqNullSafe(F.col("own")), "stale").alias("reason")).filter("reason is not null")
    rejected = j.filter((F.col("fingerprint") == F.col("own")) & ~F.col("accepted")).select("object_id")
    return objects.join(rejected, "object_id", "left_anti").select(*objects.columns), refused

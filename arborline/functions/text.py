"""Column expressions on flags, ids, fingerprints and configuration texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of names whose values are secrets.
SECRET_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "credential", "authorization")


def split_flags(flags: Column) -> Column:
    """``a; b;a`` as an array without blanks and repeats, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(flags, F.lit("")), ";"), lambda f: F.trim(f)), lambda f: f != ""))


def join_flags(flags: Column) -> Column:
    return F.array_join(flags, ";")


def edit_flags(flags: Column, drop: Column, add: Column) -> Column:
    """Flags without those of ``drop`` and with those of ``add`` behind."""
    return F.array_union(F.array_except(flags, drop), add)


def stable_id(order: Column, number: Column) -> Column:
    """``root-o1-001``."""
    return F.format_string("root-o%d-%03d", order.cast("int"), number.cast("int"))


def fingerprint(values: Column, places: int = 10) -> Column:
    """SHA-256 of an array of doubles, rounded, with one zero; equal numbers give equal prints on any engine."""
    text = F.transform(values, lambda v: F.format_string(f"%.{places}f", F.round(v, places) + F.lit(0.0)))
    return F.sha2(F.concat_ws(",", F.size(values).cast("string"), F.array_join(text, ",")), 256)


def redact(config: Column) -> Column:
    """A JSON text with the values of secret names masked."""
    names = "|".join(SECRET_NAMES)
    return F.regexp_replace(config, rf'(?i)("[^"]*(?:{names})[^"]*"\s*:\s*)("(?:[^"\\]|\\.)*"|[^,}}\]\s]+)', '$1"***"')


def json_safe(value: Column) -> Column:
    """A double for JSON: NaN and infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)

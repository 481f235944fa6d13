"""Similarities of sets, values, counts and histograms as FLOAT columns.

Sets are distinct arrays. Division guards make every function safe under ANSI mode; null sets count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def _set(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def shared_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(_set(a), _set(b)))


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b|; 1 for two empty sets."""
    shared = shared_count(a, b)
    union = F.size(_set(a)) + F.size(_set(b)) - shared
    return F.when(union == 0, f32(1.0)).otherwise(f32(shared / F.greatest(union, F.lit(1))))


def signal_jaccard(a: Column, b: Column) -> Column:
    """As jaccard, but 0 for two empty sets: absence is no signal."""
    return F.when((F.size(_set(a)) == 0) & (F.size(_set(b)) == 0), f32(0.0)).otherwise(jaccard(a, b))


def exact_option(a: Column, b: Column) -> Column:
    """1 if equal or both null, else 0."""
    return F.when(a.eqNullSafe(b), f32(1.0)).otherwise(f32(0.0))


def equal_score(a: Column, b: Column) -> Column:
    return F.when(F.coalesce(a == b, F.lit(False)), f32(1.0)).otherwise(f32(0.0))


def bounded_ratio(a: Column, b: Column) -> Column:
    """min / max; 1 for 0 and 0."""
    return F.when((a == 0) & (b == 0), f32(1.0)).otherwise(f32(F.least(a, b) / F.greatest(a, b, F.lit(1))))


def histogram_norm(h: Column) -> Column:
    return F.sqrt(F.aggregate(h, F.lit(0.0), lambda s, x: s + x["n"].cast("double") * x["n"].cast("double")))


def histogram_cosine(a: Column, b: Column) -> Column:
    """Cosine of two histograms (arrays of (op, n) sorted by op); 0 if either has no mass."""
    counts = F.map_from_entries(b)
    dot = F.aggregate(a, F.lit(0.0), lambda s, x: s + x["n"].cast("double") * F.coalesce(F.try_element_at(counts, x["op"]).cast("double"), F.lit(0.0)))
    norms = histogram_norm(a) * histogram_norm(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (norms == 0), f32(0.0)).otherwise(f32(dot / F.greatest(norms, F.lit(1e-30))))


def control_flow_score(a: Column, b: Column) -> Column:
    """Mean ratio of branch, return, throw and switch counts of two code structs."""
    parts = [bounded_ratio(a[k], b[k]) for k in ("branch_count", "return_count", "throw_count", "switch_count")]
    return f32((parts[0] + parts[1] + parts[2] + parts[3]) / 4)

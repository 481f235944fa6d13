"""Predicates on fingerprints, matches and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from artifactlink.functions.similarity import f32, jaccard

INTERFACE_FLAG = 0x0200
#: Reasons that users see.
SEMANTIC_BREAK = "semantic break: class/interface access flag changed"
WEAK_SHAPE = "unsafe same descriptor: weak method shape overlap"
#: Descriptors under these are the platform's, not the app's.
PLATFORM_PREFIXES = (
    "Landroid/", "Landroidx/", "Lcom/android/", "Ldalvik/", "Lj$/", "Ljava/", "Ljavax/", "Lkotlin/",
    "Lkotlinx/", "Llibcore/", "Lorg/apache/http/", "Lorg/json/", "Lorg/w3c/dom/", "Lorg/xml/sax/", "Lorg/xmlpull/", "Lsun/",
)


def is_useful_anchor(c: Column) -> Column:
    """At least 4 bytes, and not only ASCII digits."""
    return (F.octet_length(c) >= 4) & ~c.rlike("^[0-9]+$")


def class_kind_changed(old_flags: Column, new_flags: Column) -> Column:
    return old_flags.bitwiseAND(INTERFACE_FLAG) != new_flags.bitwiseAND(INTERFACE_FLAG)


def same_descriptor_weak_shape(old: Column, new: Column) -> Column:
    few = F.least(F.size(old["method_shapes"]), F.size(new["method_shapes"]))
    return (old["descriptor"] == new["descriptor"]) & (few >= 3) & (jaccard(old["method_shapes"], new["method_shapes"]) < f32(0.30))


def is_verified(reasons: Column) -> Column:
    return F.exists(reasons, lambda r: r.startswith("verified:"))


def has_reason(reasons: Column, text: str) -> Column:
    return F.exists(reasons, lambda r: r == text)


def is_safe(status: Column, reasons: Column) -> Column:
    return (status == "Matched") & is_verified(reasons)


def is_name_only(status: Column, reasons: Column) -> Column:
    return status.isin("Matched", "LowConfidence") & has_reason(reasons, "same descriptor") & ~is_verified(reasons)


def is_unsafe(status: Column, reasons: Column) -> Column:
    return status.isin("Conflict", "SemanticBreak") | has_reason(reasons, SEMANTIC_BREAK) | has_reason(reasons, WEAK_SHAPE)


def starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in sorted(set(prefixes)):
        out = out | c.startswith(p)
    return out


def is_excluded(descriptor: Column, ignore: Sequence[str] = PLATFORM_PREFIXES, include: Sequence[str] = ()) -> Column:
    """Outside the audit: under an ignored prefix and under no included one. Blank prefixes are refused."""
    if any(not p.strip() for p in (*ignore, *include)):
        raise ValueError("a prefix must not be blank")
    return starts_with_any(descriptor, ignore) & ~starts_with_any(descriptor, include)

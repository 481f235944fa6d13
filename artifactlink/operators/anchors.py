"""Anchors: values of fingerprint sets by which classes of two versions can meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artifactlink.functions.predicates import is_useful_anchor

#: Kind, set column and order of the scan.
KINDS = {"string": "strings", "method_ref": "method_ref_shapes", "field_ref": "field_ref_shapes", "method_proto": "method_proto_shapes", "field_type": "field_type_shapes"}
RARE_MAX = 3


def anchors(fp: DataFrame, kinds: dict[str, str] = KINDS) -> DataFrame:
    """(class_id, descriptor, kind, kind_ord, item, value): useful values of each class's sets; item: place in the useful ones."""
    per_kind = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("kind_ord"), F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), is_useful_anchor).alias("vs")) for i, (k, c) in enumerate(kinds.items())])
    out = fp.select("class_id", "descriptor", F.explode(per_kind).alias("k"))
    return out.select("class_id", "descriptor", "k.kind", "k.kind_ord", F.posexplode("k.vs").alias("item", "value"))


def anchor_frequency(fp: DataFrame, kinds: dict[str, str] = KINDS) -> DataFrame:
    """(kind, value, df): classes that have the value."""
    return anchors(fp, kinds).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("df"))


def rare_anchors(old: DataFrame, new: DataFrame, kinds: dict[str, str] = KINDS, most: int = RARE_MAX) -> DataFrame:
    """(kind, value, old_df, new_df): values in 1 to `most` classes of both sides."""
    o = anchor_frequency(old, kinds).where(F.col("df") <= most).withColumnRenamed("df", "old_df")
    n = anchor_frequency(new, kinds).where(F.col("df") <= most).withColumnRenamed("df", "new_df")
    return o.join(n, ["kind", "value"])


def with_rare(fp: DataFrame, rare: DataFrame, kinds: dict[str, str] = KINDS) -> DataFrame:
    """Adds `rare`: a map from kind to the class's rare values. A rare value is in few classes, so the join has no hot key."""
    mine = anchors(fp, kinds).join(rare.select("kind", "value"), ["kind", "value"]).groupBy("class_id", "kind").agg(F.array_sort(F.collect_list("value")).alias("vs"))
    per = mine.groupBy("class_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "vs"))).alias("rare"))
    return fp.join(per, "class_id", "left")

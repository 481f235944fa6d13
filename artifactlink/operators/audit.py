"""Reference audit: every symbol reference of chosen sources against an index of definitions.

Tables:
  def_classes (descriptor, load_ord, part, dex, superclass, interfaces)
  def_methods (owner, name, params, ret, is_static, is_direct, load_ord), def_fields (owner, name, type, is_static, load_ord)
  sites (site_id, kind, kind_ord, owner, name, params, ret, dispatch, part, dex, source_class, source_method, offset, standalone)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artifactlink.functions.predicates import PLATFORM_PREFIXES, is_excluded
from artifactlink.functions.text import object_descriptor
from artifactlink.operators.graph import ancestors

STATIC = 0x0008
#: Kinds and reasons in the order of reports.
KINDS = ("class", "method", "field")
REASONS = ("missing_owner", "missing_method", "missing_field", "changed_prototype", "changed_descriptor", "member_kind_mismatch")


def ordinal(c: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), c)


def signature(owner: Column, name: Column, params: Column, ret: Column) -> Column:
    """`owner->name(p1p2)ret`: parameters without separators."""
    return F.concat(owner, F.lit("->"), name, F.lit("("), F.array_join(params, ""), F.lit(")"), ret)


def field_signature(owner: Column, name: Column, kind: Column) -> Column:
    return F.concat(owner, F.lit("->"), name, F.lit(":"), kind)


def first_wins(rows: DataFrame, keys: list[str], load_ord: str = "load_ord") -> DataFrame:
    """Of rows with equal keys the one loaded first."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), load_ord).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def class_index(classes: DataFrame) -> DataFrame:
    return first_wins(classes, ["descriptor"])


def method_dispatch(op: Column) -> Column:
    return F.when(op.isin(0x71, 0x77), "static").when(op.isin(0x70, 0x76), "direct").otherwise("virtual")


def field_dispatch(op: Column) -> Column:
    return F.when(op >= 0x60, "static").otherwise("instance")


def hierarchy(def_classes: DataFrame) -> DataFrame:
    """(src, dst, ord): a class's superclass, then its interfaces in order."""
    up = F.array_compact(F.concat(F.array("superclass"), "interfaces"))
    return def_classes.select(F.col("descriptor").alias("src"), F.posexplode(up).alias("ord", "dst"))


def _kind_ok(dispatch: Column, name: Column, is_static: Column, is_direct: Column) -> Column:
    return (
        F.when(dispatch == "static", is_static).when(dispatch == "direct", ~is_static & is_direct).when(dispatch == "virtual", ~is_static & ~is_direct & (name != "<init>"))
        .when(dispatch == "instance", ~is_static)
    )


def _resolved_at(sites: DataFrame, order: DataFrame, members: DataFrame, same: Column, kind: str) -> DataFrame:
    """Per site: hit (least order of an exact member of the right kind), mismatch, same_name, candidates."""
    walk = sites.join(order.select(F.col("start").alias("owner"), F.col("node"), F.col("ord")), "owner", "left")
    walk = walk.where(F.col("hierarchy") | (F.col("node") == F.col("owner")) | F.col("node").isNull())
    m = members.select(F.col("owner").alias("node"), F.col("name").alias("m_name"), *[F.col(c).alias(f"m_{c}") for c in members.columns if c not in ("owner", "name")])
    x = walk.join(m, (walk.node == m.node) & (F.col("name") == F.col("m_name")), "left").drop(m.node)
    ok = _kind_ok(F.col("dispatch"), F.col("name"), F.col("m_is_static"), F.col("m_is_direct") if kind == "method" else F.lit(False))
    text = signature(F.col("node"), F.col("m_name"), F.col("m_params"), F.col("m_ret")) if kind == "method" else field_signature(F.col("node"), F.col("m_name"), F.col("m_type"))
    return x.groupBy("site_id").agg(
        F.min(F.when(same & ok, F.struct("ord", F.col("node").alias("at")))).alias("hit"), F.coalesce(F.bool_or(same & ~ok), F.lit(False)).alias("mismatch"),
        F.coalesce(F.bool_or(F.col("m_name").isNotNull()), F.lit(False)).alias("same_name"), F.array_sort(F.collect_set(F.when(F.col("m_name").isNotNull(), text))).alias("candidates"),
    )


def audit(
    sites: DataFrame, def_classes: DataFrame, def_methods: DataFrame, def_fields: DataFrame, ignore=PLATFORM_PREFIXES, include=(), mapping: DataFrame | None = None
) -> DataFrame:
    """Each counted site with `outcome` (excluded, resolved, unresolved), reason, candidates and where it was found.

    Primitive class references aren't counted. Unknown ancestors give nothing, so a platform method called on an app
    class is missing. mapping: (old, new) descriptors that give candidates of a mapped owner."""
    classes = class_index(def_classes)
    s = sites.withColumn("target", F.when(F.col("kind") == "class", object_descriptor(F.col("owner"))).otherwise(F.col("owner")))
    s = s.where(F.col("target").isNotNull()).withColumn("excluded", is_excluded(F.col("target"), ignore, include))
    found = classes.select(F.col("descriptor").alias("target"), F.col("part").alias("found_part"))
    s = s.join(found, "target", "left").withColumn("owner_known", F.col("found_part").isNotNull())
    live = s.where(~F.col("excluded") & F.col("owner_known"))
    methods, fields = live.where(F.col("kind") == "method"), live.where(F.col("kind") == "field")
    methods = methods.withColumn("hierarchy", (F.col("dispatch") == "virtual") & (F.col("name") != "<init>"))
    fields = fields.withColumn("hierarchy", F.col("dispatch") == "instance")
    starts = methods.select(F.col("owner").alias("node")).union(fields.select(F.col("owner").alias("node"))).distinct()
    order = ancestors(hierarchy(classes), starts)
    m = _resolved_at(methods, order, first_wins(def_methods, ["owner", "name", "params", "ret", "is_static", "is_direct"]), (F.col("params") == F.col("m_params")) & (F.col("ret") == F.col("m_ret")), "method")
    f = _resolved_at(fields, order, first_wins(def_fields, ["owner", "name", "type", "is_static"]), F.col("ret") == F.col("m_type"), "field")
    x = s.join(m.unionByName(f), "site_id", "left")
    x = x.join(found.select(F.col("target").alias("at"), F.col("found_part").alias("at_part")), F.col("hit.at") == F.col("at"), "left")
    hit = F.when(F.col("kind") == "class", F.col("owner_known")).otherwise(F.col("hit").isNotNull())
    is_method = F.col("kind") == "method"
    reason = (
        F.when(~F.col("owner_known"), "missing_owner").when(F.col("mismatch"), "member_kind_mismatch")
        .when(F.col("same_name"), F.when(is_method, "changed_prototype").otherwise("changed_descriptor")).otherwise(F.when(is_method, "missing_method").otherwise("missing_field"))
    )
    outcome = F.when(F.col("excluded"), "excluded").when(hit, "resolved").otherwise("unresolved")
    where = F.when(F.col("kind") == "class", F.col("found_part")).otherwise(F.col("at_part"))
    x = x.withColumns({"outcome": outcome, "reason": F.when(outcome == "unresolved", reason), "resolved_part": F.when(outcome == "resolved", where)})
    x = x.withColumn("another_split", F.coalesce((F.col("outcome") == "resolved") & ~F.col("standalone") & (F.col("resolved_part") != F.col("part")), F.lit(False)))
    x = x.withColumn("candidates", F.when(F.col("outcome") == "unresolved", F.coalesce("candidates", F.array().cast("array<string>"))))
    ref = F.when(is_method, signature(F.col("owner"), F.col("name"), F.col("params"), F.col("ret"))).when(F.col("kind") == "field", field_signature(F.col("owner"), F.col("name"), F.col("ret"))).otherwise(F.col("target"))
    x = x.withColumn("reference", ref)
    if mapping is not None:
        x = with_mapped_candidates(x, mapping, def_methods, def_fields)
    return x.select("site_id", "kind", "reference", "outcome", "reason", "part", "dex", "source_class", "source_method", "offset", "candidates", "resolved_part", "another_split")


def with_mapped_candidates(x: DataFrame, mapping: DataFrame, def_methods: DataFrame, def_fields: DataFrame) -> DataFrame:
    """Adds to unresolved rows `mapped_owner=X` and X's members of the same name, where the owner is mapped to X."""
    members = def_methods.select(F.lit("method").alias("k"), F.col("owner").alias("o"), F.col("name").alias("n"), signature(F.col("owner"), F.col("name"), F.col("params"), F.col("ret")).alias("t"))
    members = members.union(def_fields.select(F.lit("field"), "owner", "name", field_signature(F.col("owner"), F.col("name"), F.col("type"))))
    open_rows = x.where("outcome = 'unresolved'").select("site_id", "kind", "name", F.col("target").alias("old")).join(mapping.select("old", F.col("new").alias("mapped")), "old")
    named = open_rows.join(members, (F.col("mapped") == F.col("o")) & (F.col("kind") == F.col("k")) & (F.col("name") == F.col("n")), "left")
    more = named.groupBy(F.col("site_id").alias("m_id"), "mapped").agg(F.collect_set("t").alias("ts")).select("m_id", F.concat(F.array(F.concat(F.lit("mapped_owner="), "mapped")), "ts").alias("more"))
    out = x.join(more, F.col("site_id") == F.col("m_id"), "left")
    return out.withColumn("candidates", F.when(F.col("more").isNull(), F.col("candidates")).otherwise(F.array_sort(F.array_union("candidates", "more")))).drop("m_id", "more")


def unresolved_in_order(x: DataFrame) -> DataFrame:
    rows = x.where("outcome = 'unresolved'")
    return rows.orderBy(ordinal(F.col("reason"), REASONS), ordinal(F.col("kind"), KINDS), "reference", "part", "dex", "source_class", "source_method", F.asc_nulls_first("offset"))


def audit_counts(x: DataFrame) -> DataFrame:
    is_ = lambda v: F.count_if(F.col("outcome") == v)
    return x.agg(F.count(F.lit(1)).alias("references_scanned"), is_("excluded").alias("references_excluded"), is_("resolved").alias("references_resolved"), F.count_if("another_split").alias("resolved_in_another_split"), is_("unresolved").alias("unresolved_references"))


def passes(x: DataFrame, allow_missing: int = 0) -> bool:
    return x.where("outcome = 'unresolved'").count() <= allow_missing


def reason_counts(x: DataFrame) -> DataFrame:
    rows = x.where("outcome = 'unresolved'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(ordinal(F.col("reason"), REASONS))



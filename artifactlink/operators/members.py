"""Methods and fields inside accepted class pairs: candidates by buckets in order, scores, statuses.

A member's candidates stay inside its class pair, so all joins are on the pair; two old members may choose one new member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artifactlink.functions.similarity import bounded_ratio, control_flow_score, equal_score, f32, histogram_cosine, signal_jaccard
from artifactlink.functions.text import two_decimals
from artifactlink.operators.decide import MatchConfig, member_status
from artifactlink.schemas import CANDIDATE

NO_NEW = "no new member candidate above low-confidence threshold"
NO_OLD = {"methods": "no old method candidate above low-confidence threshold", "fields": "no old field candidate above low-confidence threshold"}
#: References of a new method that are indexed, and of an old one that are probed.
INDEXED, PROBED = 32, 16
KEYS = ("old_class_id", "new_class_id", "old_id")


def member_cap(k: int) -> int:
    return max(32 * max(1, k), 128)


def accepted_pairs(class_matches: DataFrame) -> DataFrame:
    return class_matches.where(F.col("status").isin("Matched", "LowConfidence") & F.col("new_class_id").isNotNull()).select("old_class_id", "new_class_id")


def _side(pairs: DataFrame, classes: DataFrame, side: str, members: str) -> DataFrame:
    rows = classes.select(F.col("id").alias(f"{side}_class_id"), F.posexplode(members).alias(f"{side}_pos", side)).withColumn(f"{side}_id", F.col(f"{side}.id"))
    return pairs.join(rows, f"{side}_class_id")


def code_score(a: Column, b: Column) -> Column:
    return (
        f32(0.35) * histogram_cosine(a["opcode_histogram"], b["opcode_histogram"]) + f32(0.20) * bounded_ratio(a["instruction_count"], b["instruction_count"])
        + f32(0.20) * control_flow_score(a, b) + f32(0.10) * signal_jaccard(F.array_distinct(a["string_refs"]), F.array_distinct(b["string_refs"]))
        + f32(0.10) * signal_jaccard(F.array_distinct(a["method_refs"]), F.array_distinct(b["method_refs"])) + f32(0.05) * signal_jaccard(F.array_distinct(a["field_refs"]), F.array_distinct(b["field_refs"]))
    )


def score_method(a: Column, b: Column) -> tuple[Column, Column]:
    """Score and reasons. The prototype reason shows the weights of methods without code, with code or without."""
    name, ret, params = equal_score(a["name"], b["name"]), equal_score(a["return_type"], b["return_type"]), equal_score(a["parameters"], b["parameters"])
    both, code = a["code"].isNotNull() & b["code"].isNotNull(), code_score(a["code"], b["code"])
    plain = f32(0.35) * name + f32(0.30) * ret + f32(0.35) * params
    score = F.when(both, f32(0.20) * name + f32(0.20) * ret + f32(0.20) * params + f32(0.40) * code).otherwise(plain)
    says = lambda text, x: F.concat(F.lit(text + " "), two_decimals(x))
    return score, F.array_compact(F.array(says("method name score", name), says("prototype score", f32(0.30) * ret + f32(0.35) * params), F.when(both, says("bytecode score", code))))


def score_field(a: Column, b: Column) -> tuple[Column, Column]:
    name, kind = equal_score(a["name"], b["name"]), equal_score(a["field_type"], b["field_type"])
    says = lambda text, x: F.concat(F.lit(text + " "), two_decimals(x))
    return f32(0.40) * name + f32(0.60) * kind, F.array(says("field name score", name), says("field type score", kind))


def _buckets(members: str, a: Column, b: Column) -> list[Column]:
    """Ways in which an old and a new member can meet, in order."""
    if members == "fields":
        return [a["name"] == b["name"], a["field_type"] == b["field_type"]]
    shared = lambda c: F.arrays_overlap(F.slice(F.coalesce(a["code"][c], F.array().cast("array<string>")), 1, PROBED), F.slice(F.coalesce(b["code"][c], F.array().cast("array<string>")), 1, INDEXED))
    return [a["name"] == b["name"], (a["return_type"] == b["return_type"]) & (a["parameters"] == b["parameters"]), shared("string_refs"), shared("method_refs")]


def _once(x: DataFrame, **cols: Column) -> DataFrame:
    """Columns that are computed once a row: the optimizer would write a plain projection's expression wherever it is read."""
    for name, c in cols.items():
        x = x.withColumn("_one", F.array(c))
        x = x.select(*[k for k in x.columns if k != "_one"], F.explode("_one").alias(name))
    return x


def candidates(pairs: DataFrame, old: DataFrame, new: DataFrame, members: str, k: int) -> DataFrame:
    """Old members with `news`, the members of the new class, and `chosen`, the places in it that they are scored against.

    The cap is looked at after each candidate, so a bucket that begins over the cap still gives one; if no bucket gives
    any, the first `cap` members of the new class are taken. All of this is inside an old member's row: pairs of members
    are no rows, and take no shuffle."""
    cap = member_cap(k)
    news = new.select(F.col("id").alias("new_class_id"), F.coalesce(F.col(members), F.filter(members, lambda x: F.lit(False))).alias("news"))
    x = _side(pairs, old, "old", members).join(news, "new_class_id")
    buckets = len(_buckets(members, F.col("old"), F.col("old")))

    def bucket(n: Column) -> Column:
        out = F.lit(None).cast("int")
        for i, met in reversed(list(enumerate(_buckets(members, F.col("old"), n)))):
            out = F.when(F.coalesce(met, F.lit(False)), i).otherwise(out)
        return out

    x = _once(x, met=F.transform("news", bucket))
    places = F.sequence(F.lit(0), F.size("news") - 1)
    place_of = lambda i: F.filter(places, lambda p: F.coalesce(F.get("met", p) == i, F.lit(False)))
    x = _once(x, **{f"in_{i}": place_of(i) for i in range(buckets)})
    before, parts = F.lit(0), []
    for i in range(buckets):
        parts.append(F.slice(f"in_{i}", 1, F.greatest(F.lit(cap) - before, F.lit(1))))
        before = before + F.size(f"in_{i}")
    chosen = F.when(before > 0, F.concat(*parts)).otherwise(F.slice(places, 1, cap))
    return _once(x.where(F.size("news") > 0), chosen=chosen)


def best_members(x: DataFrame, members: str, config: MatchConfig) -> DataFrame:
    """KEYS, old_owner_class, new_owner_class of the best, and `candidates`: the best of `chosen` by score, then id."""
    rate = score_method if members == "methods" else score_field

    def row(p: Column) -> Column:
        n = F.get("news", p)
        score, reasons = rate(F.col("old"), n)
        return F.struct((-score).alias("order"), n["id"].alias("entity_id"), score.cast("float").alias("score"), reasons.alias("reasons"), n["owner_class"].alias("owner"))

    scored = F.filter(F.transform("chosen", row), lambda c: c["score"] >= f32(config.low_confidence))
    x = _once(x, tops=F.slice(F.array_sort(scored), 1, config.max_candidates))
    plain = F.transform("tops", lambda c: F.struct(c["entity_id"].alias("entity_id"), c["score"].alias("score"), c["reasons"].alias("reasons")))
    return x.select(*KEYS, F.col("old.owner_class").alias("old_owner_class"), F.get("tops", F.lit(0))["owner"].alias("new_owner_class"), plain.alias("candidates"))


def match_members(class_matches: DataFrame, old: DataFrame, new: DataFrame, members: str, config: MatchConfig = MatchConfig()) -> DataFrame:
    """`members`: "methods" or "fields" of two class tables (schemas.CLASSES) -> schemas.MEMBER_MATCH, in the order of a report."""
    return matched_members(class_matches, old, new, members, config).orderBy(F.asc_nulls_last("old_owner_class"), F.asc_nulls_last("old_member_id"), F.asc_nulls_last("new_member_id"))


def matched_members(class_matches: DataFrame, old: DataFrame, new: DataFrame, members: str, config: MatchConfig = MatchConfig()) -> DataFrame:
    """The rows of `match_members` in no order."""
    pairs = accepted_pairs(class_matches)
    tops = best_members(candidates(pairs, old, new, members, config.max_candidates), members, config)
    # old members of pairs whose new class has no members
    empty = new.where(F.coalesce(F.size(members), F.lit(0)) <= 0).select(F.col("id").alias("new_class_id"))
    alone = _side(pairs.join(empty, "new_class_id"), old, "old", members).select(*KEYS, F.col("old.owner_class").alias("old_owner_class"), F.lit(None).cast("string").alias("new_owner_class"), F.array().cast(f"array<{CANDIDATE}>").alias("candidates"))
    x = tops.unionByName(alone)
    news = _side(pairs, new, "new", members).select("old_class_id", "new_class_id", "new_id", F.col("new.owner_class").alias("new_owner_class"))
    best = F.get("candidates", F.lit(0))
    x = x.select(*KEYS, "old_owner_class", best["entity_id"].alias("new_id"), F.coalesce(best["score"], f32(0.0)).alias("score"), member_status(F.col("candidates"), config.min_confidence).alias("status"), F.coalesce(best["reasons"], F.array(F.lit(NO_NEW))).alias("reasons"), "candidates", "new_owner_class")
    used = x.where(F.col("status").isin("Matched", "LowConfidence", "Conflict")).select("old_class_id", "new_class_id", "new_id")
    left = news.join(used, ["old_class_id", "new_class_id", "new_id"], "left_anti").select(
        "old_class_id", "new_class_id", F.lit(None).cast("bigint").alias("old_id"), F.lit(None).cast("string").alias("old_owner_class"), "new_id", f32(0.0).alias("score"),
        F.lit("UnresolvedNew").alias("status"), F.array(F.lit(NO_OLD[members])).alias("reasons"), F.array().cast(f"array<{CANDIDATE}>").alias("candidates"), "new_owner_class",
    )
    return x.unionByName(left).select(
        "old_class_id", "new_class_id", F.col("old_id").alias("old_member_id"), F.col("new_id").alias("new_member_id"), "old_owner_class", "new_owner_class", "score", "status", "reasons", "candidates"
    )

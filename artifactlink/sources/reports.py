"""Report files of a comparison and an audit, and the reader of the JSON mapping.

Text is built as columns and comes to the driver row by row (`toLocalIterator`), as each report is one ordered file.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from artifactlink.errors import MappingError
from artifactlink.functions.predicates import SEMANTIC_BREAK, WEAK_SHAPE, has_reason, is_name_only, is_safe, is_unsafe
from artifactlink.functions.text import class_label, descriptor_to_java_name, tsv_safe, two_decimals
from artifactlink.operators import audit as A
from artifactlink.operators.anchors import RARE_MAX
from artifactlink.operators.graph import PASSES
from artifactlink.operators.scoring import GRAPH_REASON, RARE_REASON, RULES
from artifactlink.schemas import MAPPING_JSON, STATUSES

SCHEMA_VERSION = 1
MAPPED = ("Matched", "LowConfidence", "Conflict", "SemanticBreak")
#: Names of the summary's lines for each verification reason.
VERIFIED_LINES = {
    RULES["exact"][1]: "verified_exact_class_fingerprint", RULES["api"][1]: "verified_exact_descriptor_stable_api_shape", RULES["code"][1]: "verified_exact_descriptor_stable_code_pattern",
    RULES["proto_code"][1]: "verified_exact_descriptor_stable_proto_code_pattern", RULES["renamed"][1]: "verified_renamed_exact_behavior_pattern",
    RULES["renamed_anchor"][1]: "verified_renamed_stable_prototype_anchor_pattern", RARE_REASON: "verified_rare_anchors_stable_shape", GRAPH_REASON: "verified_call_graph_neighborhood",
}
STATUS_LINES = {
    "Matched": "matched_classes", "LowConfidence": "low_confidence_classes", "Conflict": "conflict_classes", "SemanticBreak": "semantic_break_classes", "UnresolvedOld": "unresolved_old_classes", "UnresolvedNew": "unresolved_new_classes",
}


def _write(path: str, lines: Iterable[str]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        for line in lines:
            f.write(line + "\n")


def _lines(df: DataFrame, column: str) -> Iterator[str]:
    return (r[0] for r in df.select(column).toLocalIterator())


def labelled(matches: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Adds old_label, new_label and descriptors from class tables."""
    o = old.select(F.col("id").alias("old_class_id"), F.col("descriptor").alias("old_descriptor"), F.col("origin").alias("old_origin"))
    n = new.select(F.col("id").alias("new_class_id"), F.col("descriptor").alias("new_descriptor"), F.col("origin").alias("new_origin"))
    x = matches.join(o, "old_class_id", "left").join(n, "new_class_id", "left")
    return x.withColumns({
        "old_label": class_label(F.col("old_class_id"), F.col("old_descriptor"), F.col("old_origin")), "new_label": class_label(F.col("new_class_id"), F.col("new_descriptor"), F.col("new_origin")),
    })


def summary_lines(c) -> list[str]:
    """28 lines of `key: value` of a comparison."""
    m = c.classes
    counts = m.agg(*[F.count_if(F.col("status") == s).alias(k) for s, k in STATUS_LINES.items()], *[F.count_if(has_reason(F.col("reasons"), r)).alias(k) for r, k in VERIFIED_LINES.items()]).first().asDict()
    a, b = c.old.coverage(), c.new.coverage()
    out = {"old_apk": c.old.name, "new_apk": c.new.name}
    for line, key in (("classes", "parsed_classes"), ("apk_parts", "apk_parts"), ("dex_files", "dex_files"), ("warnings", "warning_count")):
        out |= {f"old_{line}": a[key], f"new_{line}": b[key]}
    out |= counts | {"call_graph_verify_passes": PASSES, "rare_anchor_max_frequency": RARE_MAX, "min_confidence": f"{c.config.min_confidence:.2f}", "low_confidence": f"{c.config.low_confidence:.2f}"}
    return [f"{k}: {v}" for k, v in out.items()]


def mapping_rows(x: DataFrame) -> DataFrame:
    """(status, n, text): numbered rows of each section, with an unsafe mark in front of mapped rows that aren't Matched."""
    n = F.row_number().over(Window.partitionBy("status").orderBy(F.asc_nulls_last("old_class_id"), F.asc_nulls_last("new_class_id")))
    mark = F.when(F.col("status").isin(*MAPPED[1:]), F.concat(F.lit("# UNSAFE: "), "status", F.lit("\n"))).otherwise("")
    why = F.array_join("reasons", ", ")
    mapped = F.concat(mark, F.lit("["), two_decimals(F.col("score")), F.lit("] "), "old_label", F.lit(" -> "), "new_label", F.when(why != "", F.concat(F.lit("\n  reasons: "), why)).otherwise(""))
    text = F.when(F.col("status").isin(*MAPPED), mapped).otherwise(F.concat(F.when(F.col("status") == "UnresolvedOld", F.col("old_label")).otherwise(F.col("new_label")), F.lit(": "), why))
    return x.select("status", n.alias("n"), text.alias("text"))


#: Titles of the sections of mapping.txt, by status. File names of chunks are the titles in lower case.
TITLES = {
    "Matched": "MATCHED CLASSES", "LowConfidence": "LOW CONFIDENCE CLASSES", "Conflict": "CONFLICTS", "SemanticBreak": "SEMANTIC BREAKS",
    "UnresolvedOld": "UNRESOLVED OLD CLASSES", "UnresolvedNew": "UNRESOLVED NEW CLASSES",
}


def write_mapping(x: DataFrame, out: str, preview: int = 2000, chunk: int = 10_000, names: tuple[str, str] = ("", "")) -> None:
    """mapping.txt with at most `preview` rows a section (0: all), and numbered chunks of everything when one is longer."""
    rows = mapping_rows(x).persist()
    totals = {r.status: r["count"] for r in rows.groupBy("status").count().collect()}

    def sections() -> Iterator[str]:
        for i, status in enumerate(STATUSES):
            if i:
                yield ""
            yield TITLES[status]
            mine = rows.where(F.col("status") == status)
            yield from _lines((mine.where(F.col("n") <= preview) if preview else mine).orderBy("n"), "text")
            if preview and (total := totals.get(status, 0)) > preview:
                yield f"... truncated: showing {preview} of {total} rows; full rows are in mapping-index.txt when chunking is enabled; use --max-txt-rows 0 for one full TXT"

    _write(os.path.join(out, "mapping.txt"), sections())
    folder, index = os.path.join(out, "mapping-parts"), os.path.join(out, "mapping-index.txt")
    for old in [*(os.path.join(folder, f) for f in (os.listdir(folder) if os.path.isdir(folder) else ())), index]:
        if os.path.isfile(old):
            os.remove(old)
    if not preview or not chunk or not any(n > preview for n in totals.values()):
        return
    os.makedirs(folder, exist_ok=True)
    apks = [f"old_apk: {names[0]}", f"new_apk: {names[1]}", ""]
    listed = ["MAPPING INDEX", "preview: mapping.txt", "parts_dir: mapping-parts", f"chunk_rows: {chunk}", *apks]
    for status in STATUSES:
        total = totals.get(status, 0)
        listed.append(f"{TITLES[status]}: {total} rows")
        for k in range(-(-total // chunk)):
            name, span = f"{TITLES[status].lower().replace(' ', '-')}-{k + 1:04d}.txt", f"rows {k * chunk + 1}-{min((k + 1) * chunk, total)} of {total}"
            listed.append(f"  mapping-parts/{name}: {span}")
            mine = rows.where((F.col("status") == status) & (F.floor((F.col("n") - 1) / chunk) == k)).orderBy("n")
            _write(os.path.join(folder, name), [TITLES[status], span, *apks, *_lines(mine, "text")])
        listed.append("")
    _write(index, listed)


def write_tiers(x: DataFrame, out: str) -> None:
    s, r = F.col("status"), F.col("reasons")
    row = F.concat_ws("\t", tsv_safe(F.col("old_label")), tsv_safe(F.col("new_label")), two_decimals(F.col("score")), "status", tsv_safe(F.array_join("reasons", "; ")))
    for name, keep in (("verified.txt", is_safe(s, r)), ("name-only.txt", is_name_only(s, r)), ("unsafe.txt", is_unsafe(s, r))):
        rows = x.where(keep).orderBy(F.asc_nulls_last("old_class_id"), F.asc_nulls_last("new_class_id")).select(row.alias("text"))
        _write(os.path.join(out, name), ["old\tnew\tscore\tstatus\treasons", *_lines(rows, "text")])


def _why_unsafe(status: Column, reasons: Column) -> Column:
    return F.when(has_reason(reasons, SEMANTIC_BREAK), F.lit("semantic break")).when(has_reason(reasons, WEAK_SHAPE), F.lit("weak same-descriptor match")).otherwise(status)


def proguard_lines(x: DataFrame, old_to_new: bool) -> DataFrame:
    rows = x.where(F.col("status").isin(*MAPPED) & F.col("old_descriptor").isNotNull() & F.col("new_descriptor").isNotNull()).orderBy("old_class_id", "new_class_id")
    a, b = (descriptor_to_java_name(F.col(c)) for c in (("old_descriptor", "new_descriptor") if old_to_new else ("new_descriptor", "old_descriptor")))
    mark = F.when(is_safe(F.col("status"), F.col("reasons")), F.lit("")).otherwise(F.concat(F.lit("# UNSAFE: "), _why_unsafe(F.col("status"), F.col("reasons")), F.lit("\n")))
    return rows.select(F.concat(mark, a, F.lit(" -> "), b, F.lit(":")).alias("text"))


def write_members(c, out: str) -> None:
    """methods.tsv and fields.tsv; an empty result leaves what is there."""
    for name, rows in (("methods", c.methods), ("fields", c.fields)):
        if rows is None or rows.isEmpty():
            continue
        for side, classes in (("old", c.old.classes), ("new", c.new.classes)):
            rows = rows.join(_member_texts(classes, name, side), f"{side}_member_id", "left")
        cells = [tsv_safe(F.col(f"{side}_{what}")) for side in ("old", "new") for what in ("label", "text")]
        text = F.concat_ws("\t", *cells, two_decimals(F.col("score")), "status", tsv_safe(F.array_join("reasons", "; ")))
        rows = rows.orderBy(*[F.asc_nulls_last(k) for k in ("old_owner_class", "old_member_id", "new_member_id")]).select(text.alias("text"))
        one = name.removesuffix("s")
        _write(os.path.join(out, f"{name}.tsv"), [f"old_class\told_{one}\tnew_class\tnew_{one}\tscore\tstatus\treasons", *_lines(rows, "text")])


def _member_texts(classes: DataFrame, members: str, side: str) -> DataFrame:
    """Of each member of an app: its id, its class's label and its signature."""
    m = F.col("m")
    text = F.concat(m["name"], F.lit("("), F.array_join(m["parameters"], ","), F.lit(")->"), m["return_type"]) if members == "methods" else F.concat(m["name"], F.lit(":"), m["field_type"])
    x = classes.select("id", "descriptor", "origin", F.explode(members).alias("m"))
    return x.select(m["id"].alias(f"{side}_member_id"), class_label(F.col("id"), F.col("descriptor"), F.col("origin")).alias(f"{side}_label"), text.alias(f"{side}_text"))


def _app_json(app) -> Iterator[str]:
    yield "{" + f'"apk_name":{json.dumps(app.name)},"package_name":{json.dumps(app.package)},"classes":['
    rows = app.classes.orderBy("descriptor", "id").select(F.to_json(F.struct("id", "descriptor", "origin")).alias("j"))
    for i, j in enumerate(_lines(rows, "j")):
        yield ("," if i else "") + j
    yield f'],"coverage":{json.dumps(app.coverage(), separators=(",", ":"))}' + "}"


def mapping_json(c) -> Iterator[str]:
    """Pieces of the compact mapping document; members as counts only."""
    yield f'{{"schema_version":{SCHEMA_VERSION},"old_app":'
    yield from _app_json(c.old)
    yield ',"new_app":'
    yield from _app_json(c.new)
    yield ',"matches":{"classes":['
    keys = ("old_class_id", "new_class_id", "score", "status", "reasons", "candidates")
    rows = c.classes.orderBy(F.asc_nulls_last("old_class_id"), F.asc_nulls_last("new_class_id")).select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("j"))
    for i, j in enumerate(_lines(rows, "j")):
        yield ("," if i else "") + j
    count = lambda m: 0 if m is None else m.count()
    yield f'],"method_count":{count(c.methods)},"field_count":{count(c.fields)}}},"min_confidence":{c.config.min_confidence},"low_confidence":{c.config.low_confidence}}}'


HTML_HEAD = """<!doctype html><html><head><meta charset="utf-8"><title>Mapping report</title>
<style>body{font-family:sans-serif;margin:2em}.tile{display:inline-block;margin:0 1em 1em 0;padding:.5em 1em;border:1px solid #ccc}td,th{padding:.2em .6em;text-align:left}</style></head><body><h1>Mapping report</h1>"""
HTML_TAIL = """<input id="find" placeholder="search"><select id="status"><option value="">all</option></select><table id="rows"></table><script>
const d=JSON.parse(document.getElementById('data').textContent),name=(a,i)=>{const c=a.classes.find(x=>x.id===i);return c?c.descriptor:''};
const pick=document.getElementById('status'),find=document.getElementById('find'),rows=document.getElementById('rows');
for(const s of new Set(d.matches.classes.map(m=>m.status))){const o=document.createElement('option');o.textContent=s;pick.append(o)}
function draw(){rows.replaceChildren();for(const m of d.matches.classes){const t=[m.status,m.score.toFixed(2),name(d.old_app,m.old_class_id),name(d.new_app,m.new_class_id)];
if((pick.value&&m.status!==pick.value)||!t.join(' ').includes(find.value))continue;const r=rows.insertRow();for(const x of t)r.insertCell().textContent=x}}
pick.onchange=find.oninput=draw;draw()</script></body></html>"""


def write_html(spark: SparkSession, c, path: str) -> None:
    """A static page with the JSON mapping inside; its text cannot close the script element."""
    tiles = "".join(f'<div class="tile">{escape(line)}</div>' for line in summary_lines(c))
    with open(path, "w", encoding="utf-8") as f:
        f.write(HTML_HEAD + tiles + '<script type="application/json" id="data">')
        for piece in mapping_json(c):
            f.write(piece.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026"))
        f.write("</script>" + HTML_TAIL)


def write_reports(spark: SparkSession, c, out: str, html: bool = True, json_file: bool = True, proguard: bool = True, preview: int = 2000, chunk: int = 10_000) -> None:
    os.makedirs(out, exist_ok=True)
    c.classes = c.classes.persist()
    x = labelled(c.classes, c.old.classes, c.new.classes).persist()
    _write(os.path.join(out, "summary.txt"), summary_lines(c))
    write_mapping(x, out, preview, chunk, (c.old.name, c.new.name))
    write_tiers(x, out)
    write_members(c, out)
    if json_file:
        with open(os.path.join(out, "mapping.json"), "w", encoding="utf-8") as f:
            f.writelines(mapping_json(c))
    if proguard:
        _write(os.path.join(out, "old-to-new.pro"), _lines(proguard_lines(x, True), "text"))
        _write(os.path.join(out, "new-to-old.pro"), _lines(proguard_lines(x, False), "text"))
    if html:
        write_html(spark, c, os.path.join(out, "report.html"))
    x.unpersist()


@dataclass
class Mapping:
    """A JSON mapping as tables."""

    matches: DataFrame
    old: DataFrame
    new: DataFrame
    header: dict


def read_mapping(spark: SparkSession, path: str) -> Mapping:
    """Unknown fields are ignored, missing numbers are 0."""
    doc = spark.read.schema(MAPPING_JSON).json(path, multiLine=True)
    if doc.where("matches is null").count():
        raise MappingError(f"not a mapping: {path}")
    side = lambda s: doc.select(F.explode(f"{s}_app.classes").alias("c")).select("c.*")
    zero = lambda c: F.coalesce(c, F.lit(0))
    head = doc.select(zero(F.col("schema_version")).alias("schema_version"), zero(F.col("matches.method_count")).alias("method_count"), zero(F.col("matches.field_count")).alias("field_count")).first()
    return Mapping(doc.select(F.explode("matches.classes").alias("m")).select("m.*"), side("old"), side("new"), head.asDict())


def write_audit(x: DataFrame, out: str, target: str, allow_missing: int = 0, counts: dict | None = None) -> bool:
    """summary.txt and unresolved-refs.tsv; whether the audit passes."""
    os.makedirs(out, exist_ok=True)
    n = A.audit_counts(x).first().asDict()
    passes = n["unresolved_references"] <= allow_missing
    lines = ["Reference Audit", "===============", "", f"target: {target}", *[f"{k}: {v}" for k, v in ((counts or {}) | n).items()], f"allow_missing: {allow_missing}", f"status: {'PASS' if passes else 'FAIL'}"]
    reasons = [f"{r.reason}: {r.n}" for r in A.reason_counts(x).collect()]
    _write(os.path.join(out, "summary.txt"), lines + (["", "Unresolved by reason", "--------------------", *reasons] if reasons else []))
    offset = F.when(F.col("offset").isNull(), "-").otherwise(F.concat(F.lit("0x"), F.lower(F.hex("offset"))))
    cells = [tsv_safe(F.col(c)) for c in ("kind", "reference", "reason", "part", "dex", "source_class", "source_method")]
    text = F.concat_ws("\t", *cells, offset, tsv_safe(F.array_join("candidates", " | ")))
    head = "kind\treference\treason\tsource_split\tsource_dex\tsource_class\tsource_method\toffset\tcandidates"
    _write(os.path.join(out, "unresolved-refs.tsv"), [head, *_lines(A.unresolved_in_order(x).select(text.alias("text")), "text")])
    return passes


__all__ = ["Mapping", "read_mapping", "write_audit", "write_reports"]

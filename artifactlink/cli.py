"""Command line: compare (no subcommand), inspect, audit-refs, query, remap."""

from __future__ import annotations

import argparse
import os
import shutil
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from artifactlink.errors import ArtifactError, InputError
from artifactlink.operators import inspect as I
from artifactlink.operators.decide import MatchConfig
from artifactlink.operators.mapping import Rewriter, query_class
from artifactlink.plans import commands as C
from artifactlink.sources import reports
from artifactlink.sources.containers import decode_blobs, dex_blobs, resolve_parts

TEXT_LIKE = ("smali", "java", "kt", "xml", "txt", "pro", "cfg", "properties")
COMMANDS = ("inspect", "audit-refs", "query", "remap")


def parse_memory(text: str) -> int | None:
    """`12g`, `2048m`, `512k` or bytes, 1024-based; 0, off, none, disabled, unlimited: no limit."""
    t = text.strip().lower()
    if t in ("0", "off", "none", "disabled", "unlimited"):
        return None
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(t.rstrip("b")[-1:], 1)
    digits = t.rstrip("b").rstrip("kmg")
    if not digits.isdigit():
        raise InputError(f"memory limit can't be read: {text}")
    return int(digits) * unit


def session(args: argparse.Namespace) -> SparkSession:
    b = SparkSession.builder.appName("artifactlink").master(f"local[{args.threads or '*'}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    limit = parse_memory(args.memory_limit)
    return (b.config("spark.driver.memory", f"{max(1, limit >> 20)}m") if limit else b).getOrCreate()


def rewrite_tree(replacements: dict[str, str], source: str, out: str) -> None:
    """A file or a folder rewritten into a new place; texts by extension, other files as they are. Links are refused."""
    a, b = os.path.realpath(source), os.path.realpath(out)
    if a == b or a.startswith(b + os.sep) or b.startswith(a + os.sep):
        raise InputError(f"output must not overlap the input: {out}")
    rewrite = Rewriter(replacements)
    folders = os.walk(source) if os.path.isdir(source) else [(os.path.dirname(source) or ".", [], [os.path.basename(source)])]
    for folder, inner, names in folders:
        for name in [*inner, *names]:
            if os.path.islink(os.path.join(folder, name)):
                raise InputError(f"symbolic links are not followed: {os.path.join(folder, name)}")
        for name in names:
            path = os.path.join(folder, name)
            to = os.path.join(out, os.path.relpath(path, source)) if os.path.isdir(source) else out
            os.makedirs(os.path.dirname(to) or ".", exist_ok=True)
            if name.rpartition(".")[2] in TEXT_LIKE:
                with open(path, encoding="utf-8", newline="") as f, open(to, "w", encoding="utf-8", newline="") as g:
                    g.write(rewrite(f.read()))
            else:
                shutil.copyfile(path, to)


def inspect(spark: SparkSession, path: str, out: str) -> None:
    parts = resolve_parts(spark, path, "app")
    decoded = decode_blobs(dex_blobs(parts)).persist()
    os.makedirs(out, exist_ok=True)
    total = I.totals(parts, decoded).first().asDict()
    issues = [r.issue for r in I.issues(decoded).toLocalIterator()]
    lines = ["Inspect Report", "==============", "", f"Input: {path}", *[f"{k}: {v}" for k, v in total.items()], ""]
    for r in I.dex_rows(decoded).orderBy("part_ord", "dex_ord").toLocalIterator():
        lines.append(f"  - {r.apk_part}!{r.dex_file}: {r.bytes} bytes, parsed={str(r.parsed).lower()}, classes={r.classes}, methods={r.methods}, fields={r.fields}")
    reports._write(os.path.join(out, "inspect-summary.txt"), [*lines, "", "Unresolved", "----------", *(issues or ["none"])])
    rows = I.dex_rows(decoded).orderBy("part_ord", "dex_ord").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    reports._write(os.path.join(out, "inspect.json"), ['{"files": [', ",\n".join(r.j for r in rows.toLocalIterator()), "]}"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="artifactlink", description=__doc__)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--threads", type=int)
    common.add_argument("--memory-limit", default="0")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compare", parents=[common])
    c.add_argument("old")
    c.add_argument("new")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--min-confidence", type=float, default=0.80)
    c.add_argument("--low-confidence", type=float, default=0.55)
    c.add_argument("--max-candidates", type=int, default=10)
    c.add_argument("--max-txt-rows", "--txt-preview", dest="txt_preview", type=int, default=2000)
    c.add_argument("--txt-chunk-rows", "--txt-chunk", dest="txt_chunk", type=int, default=10_000)
    for flag in ("--members", "--low-memory", "--no-strict-package", "--full-txt", "--allow-unverified", "--no-html", "--no-json", "--no-proguard"):
        c.add_argument(flag, action="store_true")
    i = sub.add_parser("inspect", parents=[common])
    i.add_argument("input")
    i.add_argument("-o", "--output", required=True)
    a = sub.add_parser("audit-refs", parents=[common])
    a.add_argument("target")
    a.add_argument("-o", "--output", required=True)
    for many in ("--references", "--source-dex", "--ignore-prefix", "--include-prefix"):
        a.add_argument(many, action="append", default=[])
    a.add_argument("--mapping")
    a.add_argument("--allow-missing", type=int, default=0)
    q = sub.add_parser("query", parents=[common])
    q.add_argument("mapping")
    q.add_argument("name")
    r = sub.add_parser("remap", parents=[common])
    r.add_argument("-m", "--mapping", required=True)
    r.add_argument("input")
    r.add_argument("-o", "--output", required=True)
    r.add_argument("--include-unsafe", action="store_true")
    return p


def run(args: argparse.Namespace) -> None:
    if args.command == "compare":
        k = min(args.max_candidates, 3) if args.low_memory else args.max_candidates
        config = MatchConfig(args.min_confidence, args.low_confidence, k, not args.allow_unverified)
        spark = session(args)
        c = C.compare(spark, args.old, args.new, config, args.members, args.low_memory, not args.no_strict_package)
        preview, chunk = (0, 0) if args.full_txt else (args.txt_preview, args.txt_chunk)
        reports.write_reports(spark, c, args.output, not args.no_html, not args.no_json, not args.no_proguard, preview, chunk)
    elif args.command == "inspect":
        inspect(session(args), args.input, args.output)
    elif args.command == "audit-refs":
        spark = session(args)
        mapping = None
        if args.mapping:
            pairs = C.load_replacements(spark, args.mapping)
            mapping = spark.createDataFrame(sorted(pairs.items()), "old string, new string")
        x = C.audit_references(spark, args.target, args.source_dex, args.references, args.ignore_prefix, args.include_prefix, mapping).persist()
        reports.write_audit(x, args.output, args.target, args.allow_missing)
        C.require_pass(x, args.allow_missing)
    elif args.command == "query":
        spark = session(args)
        m = reports.read_mapping(spark, args.mapping)
        rows = query_class(m.matches, m.old, m.new, args.name).collect()
        if not rows:
            raise InputError(f"class not found in mapping: {args.name}")
        for r in rows:
            print(f"side: {r.side}\nstatus: {r.status}\nscore: {r.score:.2f}\nold: {r.old or ''}\nnew: {r.new or ''}\nsafe: {str(r.safe).lower()}")
            print("\n".join(["reasons:", *(f"  - {x}" for x in r.reasons), "candidates:", *(f"  - {x.score:.2f} #{x.entity_id}" for x in r.candidates)]))
    else:
        rewrite_tree(C.load_replacements(session(args), args.mapping, args.include_unsafe), args.input, args.output)


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in (*COMMANDS, "compare", "-h", "--help"):
        argv = ["compare", *argv]
    try:
        run(parser().parse_args(argv))
    except (ArtifactError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

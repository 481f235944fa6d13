import pytest

from artifactlink import cli
from artifactlink.errors import ArtifactError, DexError, InputError
from artifactlink.operators.inspect import totals
from artifactlink.operators.mapping import Rewriter
from artifactlink.plans import commands as C
from artifactlink.sources import dex as D
from artifactlink.sources.containers import bundle_parts, decode_blobs, dex_blobs, dex_ordinal, input_kind, manifest_package, part_key, resolve_parts
from artifactlink.sources.reports import read_mapping, write_reports
from tests.dexfix import Class, Method, archive, dex


def sample(name="La/Old;", text="login", own=None):
    own = own or name
    run = Method("run", ["I"], "V", "virtual", [("string", text), ("call", "Lsdk/Auth;", "check", ["I"], "Z"), ("get", own, "state", "I"), ("class", "Lsdk/T;")])
    return Class(name, interfaces=["Lsdk/Face;"], methods=[Method("<init>"), run, Method("make", [], own, "static", [])], fields=[("state", "I", False), ("count", "J", True)])


def test_decoder():
    d = D.decode(dex(sample()), "base.apk", "classes.dex", 0)
    (c,) = d["classes"]
    assert (c["descriptor"], c["superclass"], c["interfaces"]) == ("La/Old;", "Ljava/lang/Object;", ["Lsdk/Face;"])
    assert [f["name"] for f in c["fields"]] == ["count", "state"]
    assert [m["name"] for m in c["methods"]][-1] == "run"
    code = c["methods"][-1]["code"]
    assert code["string_refs"] == ["login"] and code["method_refs"] == ["Lsdk/Auth;->check(I)->Z"] and code["field_refs"] == ["La/Old;->state:I"]
    assert code["instruction_count"] == 5 and code["return_count"] == 1 and {"op": 0x6E, "n": 1} in code["opcode_histogram"]


@pytest.mark.parametrize(("data", "text"), [(b"zip\n035\0" + bytes(200), "magic"), (b"dex\n999\0" + bytes(200), "version"), (dex(sample())[:60], "out of bounds"), (b"dex\n035\0" + bytes(104), "header size")])
def test_bad_files(data, text):
    with pytest.raises(DexError, match=text):
        D.Dex(data)


def test_instructions():
    s = D.scan_code([0x0012, 0x000E])
    assert (s.count, s.returns) == (2, 1)
    s = D.scan_code([0x002B, 3, 0, 0x0100, 0, 0, 0, 0x000E])  # packed switch with an empty payload
    assert (s.branches, s.switches, s.opcodes[0]) == (1, 1, 1)
    with pytest.raises(DexError):
        D.scan_code([0x006E, 1])
    assert D.scan_code([0x0000, 0x0000]).count == 2
    assert D.Cursor(b"\xe5\x8e\x26").uleb() == 624485
    for bad in (b"\x80", b"\xff\xff\xff\xff\xff\x01"):
        with pytest.raises(DexError):
            D.Cursor(bad).uleb()


def test_names_and_parts():
    assert [dex_ordinal(n) for n in ("classes.dex", "classes10.dex", "assets/classes.dex", "classesx.dex")] == [1, 10, None, None]
    assert sorted(["b.apk", "x.apks!base.apk", "a.apk"], key=part_key)[0] == "x.apks!base.apk"
    assert input_kind("a/b.XAPK", False) == "BundleArchive" and input_kind("d", True) == "SplitDirectory"
    with pytest.raises(InputError):
        input_kind("a.zip", False)
    with pytest.raises(InputError):
        bundle_parts(archive(**{"x.txt": b""}), "b.apks")
    assert manifest_package(b'<manifest package="com.a.b">') == "com.a.b"
    assert manifest_package(b"\x03\0package\0\0com.x.y\0") == "com.x.y" and manifest_package(b"package\0word\0") is None


def test_containers_and_ids(spark, tmp_path):
    base = archive(**{"classes2.dex": dex(Class("Lz/Z;", methods=[Method("m")])), "classes.dex": dex(sample()), "AndroidManifest.xml": b'<manifest package="com.app">'})
    (tmp_path / "app").mkdir()
    (tmp_path / "app" / "x.apks").write_bytes(archive(**{"base.apk": base, "empty.apk": archive(**{"a.txt": b"x"})}))
    (tmp_path / "app" / "y.apk").write_bytes(archive(**{"classes.dex": b"broken"}))
    parts = resolve_parts(spark, str(tmp_path / "app"))
    assert [(r.part_ord, r.part_name) for r in parts.orderBy("part_ord").collect()] == [(0, "x.apks!base.apk"), (1, "x.apks!empty.apk"), (2, "y.apk")]
    t = totals(parts, decode_blobs(dex_blobs(parts))).first()
    assert (t.parts, t.dex_files, t.parsed_dex_files, t.failed_dex_files, t.classes) == (3, 3, 2, 1, 2)
    (tmp_path / "one.apk").write_bytes(base)
    app = C.read_app(spark, str(tmp_path / "one.apk"))
    assert [(r.id, r.descriptor, r.origin.dex_index) for r in app.classes.orderBy("id").collect()] == [(0, "La/Old;", 0), (1, "Lz/Z;", 1)]
    assert app.package == "com.app" and [m.id for r in app.classes.orderBy("id").collect() for m in r.methods] == [0, 1, 2, 3]


def write_pair(tmp_path):
    old, new = tmp_path / "old.apk", tmp_path / "new.apk"
    old.write_bytes(archive(**{"classes.dex": dex(sample(own="Lsdk/S;"))}))
    new.write_bytes(archive(**{"classes.dex": dex(sample("Lb/New;", own="Lsdk/S;"))}))
    return str(old), str(new)


def test_compare_reports_query_and_remap(spark, tmp_path, capsys):
    c = C.compare(spark, *write_pair(tmp_path), C.MatchConfig(verified_only=False), members=True)
    out = tmp_path / "out"
    write_reports(spark, c, str(out))
    assert (out / "summary.txt").read_text().count("\n") == 28 and "matched_classes: 1" in (out / "summary.txt").read_text()
    assert "La/Old; (old.apk!classes.dex#0) -> Lb/New; (new.apk!classes.dex#0)" in (out / "mapping.txt").read_text()
    assert (out / "methods.tsv").exists() and (out / "verified.txt").read_text().startswith("old\tnew\tscore\tstatus\treasons\n")
    assert "</script>" not in (out / "report.html").read_text().split('id="data">')[1].split("</script>")[0]
    m = read_mapping(spark, str(out / "mapping.json"))
    assert m.matches.count() == 1 and m.header["schema_version"] == 1 and m.header["method_count"] == 3
    for name in ("mapping.json", "mapping.txt"):
        assert C.load_replacements(spark, str(out / name)) == {"La/Old;": "Lb/New;"}
    source = tmp_path / "src"
    source.mkdir()
    (source / "a.smali").write_text("new La/Old; a.Old.run() La/Older;")
    (source / "b.bin").write_bytes(b"\0La/Old;")
    assert cli.main(["remap", "-m", str(out / "mapping.json"), str(source), "-o", str(tmp_path / "dst")]) == 0
    assert (tmp_path / "dst" / "a.smali").read_text() == "new Lb/New; b.New.run() La/Older;"
    assert (tmp_path / "dst" / "b.bin").read_bytes() == b"\0La/Old;"
    assert cli.main(["remap", "-m", str(out / "mapping.json"), str(source), "-o", str(source / "in")]) == 1
    assert cli.main(["query", str(out / "mapping.json"), "a.Old"]) == 0
    assert "side: old" in capsys.readouterr().out
    assert cli.main(["query", str(out / "mapping.json"), "no.Such"]) == 1


def test_sections_are_cut_into_chunks(spark, tmp_path):
    old = [Class(f"La/C{i};", methods=[Method(f"m{i}")]) for i in range(7)]
    (tmp_path / "o.apk").write_bytes(archive(**{"classes.dex": dex(*old)}))
    c = C.compare(spark, str(tmp_path / "o.apk"), str(tmp_path / "o.apk"), C.MatchConfig(verified_only=False), low_memory=True)
    write_reports(spark, c, str(tmp_path / "r"), html=False, preview=3, chunk=4)
    assert "... truncated" in (tmp_path / "r" / "mapping.txt").read_text()
    index = (tmp_path / "r" / "mapping-index.txt").read_text().splitlines()
    assert index[3:7] == ["chunk_rows: 4", "old_apk: o.apk", "new_apk: o.apk", ""]
    assert index[7:10] == ["MATCHED CLASSES: 7 rows", "  mapping-parts/matched-classes-0001.txt: rows 1-4 of 7", "  mapping-parts/matched-classes-0002.txt: rows 5-7 of 7"]
    part = (tmp_path / "r" / "mapping-parts" / "matched-classes-0002.txt").read_text().splitlines()
    assert part[:2] == ["MATCHED CLASSES", "rows 5-7 of 7"] and part[5].startswith("[1.00] La/C4; ")


def test_audit(spark, tmp_path):
    base = Class("Ltest/Base;", methods=[Method("<init>"), Method("inherited", kind="virtual"), Method("inheritedStatic", kind="static")], fields=[("value", "I", False), ("staticFlag", "I", True)])
    face = Class("Ltest/Contract;", methods=[Method("work", kind="abstract")], flags=0x601)
    target = Class("Ltest/Target;", "Ltest/Base;", ["Ltest/Contract;"], [Method("ok", kind="virtual"), Method("changed", ["I"], kind="virtual")], [("changed", "I", False), ("ownValue", "I", False)])
    code = [
        ("call", "Ltest/Target;", "ok", [], "V"), ("call", "Ltest/Target;", "inherited", [], "V"), ("call", "Ltest/Target;", "work", [], "V"), ("get", "Ltest/Target;", "value", "I"),
        ("call", "Ltest/Target;", "changed", ["J"], "V"), ("call", "Ltest/Target;", "gone", [], "V"), ("static", "Ltest/Target;", "inheritedStatic", [], "V"), ("get", "Ltest/Target;", "changed", "J"),
        ("sget", "Ltest/Target;", "ownValue", "I"), ("class", "Ltest/Nowhere;"), ("class", "Landroid/app/Activity;"), ("get", "Ltest/Target;", "lost", "I"),
    ]
    source = Class("Lbridge/Source;", None, methods=[Method("run", kind="static", code=code)])
    (tmp_path / "t.apk").write_bytes(archive(**{"classes.dex": dex(base, face, target)}))
    (tmp_path / "s.dex").write_bytes(dex(source))
    x = C.audit_references(spark, str(tmp_path / "t.apk"), references=[str(tmp_path / "s.dex")]).persist()
    bad = {(r.reference, r.reason): list(r.candidates) for r in x.where("outcome = 'unresolved'").collect()}
    assert bad == {
        ("Ltest/Target;->changed(J)V", "changed_prototype"): ["Ltest/Target;->changed(I)V"], ("Ltest/Target;->gone()V", "missing_method"): [], ("Ltest/Target;->inheritedStatic()V", "missing_method"): [],
        ("Ltest/Target;->changed:J", "changed_descriptor"): ["Ltest/Target;->changed:I"], ("Ltest/Target;->ownValue:I", "member_kind_mismatch"): ["Ltest/Target;->ownValue:I"],
        ("Ltest/Nowhere;", "missing_owner"): [], ("Ltest/Target;->lost:I", "missing_field"): [],
    }
    done = {r.reference for r in x.where("outcome = 'resolved'").collect()}
    assert {"Ltest/Target;->ok()V", "Ltest/Target;->inherited()V", "Ltest/Target;->work()V", "Ltest/Target;->value:I"} <= done
    assert x.where("outcome = 'excluded'").count() == 1
    args = ["audit-refs", str(tmp_path / "t.apk"), "--references", str(tmp_path / "s.dex"), "-o", str(tmp_path / "a")]
    assert cli.main(args) == 1 and cli.main([*args, "--allow-missing", "7"]) == 0
    assert "status: PASS" in (tmp_path / "a" / "summary.txt").read_text()
    with pytest.raises(InputError):
        C.audit_references(spark, str(tmp_path / "t.apk"), source_dex=["classes7.dex"])


def test_audit_inputs(spark, tmp_path):
    code = [("call", "Ltest/A;", "run", [], "V")]
    source = dex(Class("Lx/S;", None, methods=[Method("go", kind="static", code=code)]))
    good = dex(Class("Ltest/A;", methods=[Method("run", kind="virtual")]))
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "s.dex").write_bytes(source)
    refs = [str(tmp_path / f / "s.dex") for f in ("one", "two")]
    (tmp_path / "t.apk").write_bytes(archive(**{"classes.dex": good}))
    x = C.audit_references(spark, str(tmp_path / "t.apk"), references=refs).collect()
    assert len({r.site_id for r in x}) == len(x) == 2
    assert {(r.part, r.dex, r.outcome) for r in x} == {("standalone", p, "resolved") for p in refs}
    # a name with a huge number is loaded last, so the first definition counts
    (tmp_path / "h.apk").write_bytes(archive(**{"classes.dex": good, "classes99999999999999999999.dex": dex(Class("Ltest/A;", methods=[Method("other", kind="virtual")]))}))
    assert [r.outcome for r in C.audit_references(spark, str(tmp_path / "h.apk"), references=refs[:1]).collect()] == ["resolved"]
    (tmp_path / "d.apk").write_bytes(archive(**{"classes.dex": good, "classes2.dex": b"dex\nbroken"}))
    with pytest.raises(ArtifactError):
        C.audit_references(spark, str(tmp_path / "d.apk"), references=refs[:1])
    (tmp_path / "split").mkdir()
    (tmp_path / "split" / "base.apk").write_bytes(archive(**{"classes.dex": good}))
    (tmp_path / "split" / "feature.apk").write_bytes(b"no archive")
    with pytest.raises(ArtifactError):
        C.audit_references(spark, str(tmp_path / "split"), references=refs[:1])


def test_inspect_command(tmp_path, spark):
    old, _ = write_pair(tmp_path)
    assert cli.main(["inspect", old, "-o", str(tmp_path / "i")]) == 0
    assert "none" in (tmp_path / "i" / "inspect-summary.txt").read_text()


@pytest.mark.parametrize(("pairs", "text", "want"), [
    ({"La/A;": "Lb/B;", "Lb/B;": "Lc/C;"}, "La/A; Lb/B; a.A b/B", "Lb/B; Lc/C; b.B c/C"),
    ({"La/A;": "Lb/B;", "Lb/B;": "La/A;"}, "La/A;->x(Lb/B;)V", "Lb/B;->x(La/A;)V"),
    ({"La/A;": "Llong/er/Name;"}, "La/Ab; La/A$Inner; a.A.run() (ILa/A;[La/A;ZLa/A;)V", "La/Ab; La/A$Inner; long.er.Name.run() (ILlong/er/Name;[Llong/er/Name;ZLlong/er/Name;)V"),
    ({"La/A;": "Lб/Б;"}, "a.A a.Á xa.A", "б.Б a.Á xa.A"),
])
def test_rewriter(pairs, text, want):
    assert Rewriter(pairs)(text) == want


def test_memory_limits():
    assert [cli.parse_memory(t) for t in ("12g", "2048m", "512KB", "100", "off")] == [12 << 30, 2048 << 20, 512 << 10, 100, None]
    with pytest.raises(InputError):
        cli.parse_memory("many")

"""Decoder of DEX bytecode files, bytes in, nested rows out (schemas.CLASSES and coverage). It runs on the executors.

Checksums aren't verified. An index out of range is an empty text, except a type's descriptor, which is fatal. A code item
that can't be scanned is a warning, not an error.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from struct import Struct

from artifactlink.errors import DexError

NO_INDEX = 0xFFFFFFFF
#: Versions, and the offsets of the (size, offset) pairs of the header.
VERSIONS = ("035", "037", "038", "039", "040")
TABLES = {"strings": 56, "types": 64, "protos": 72, "fields": 80, "methods": 88, "classes": 96}
HEADER_SIZE, ENDIAN_TAG = 112, 0x12345678
_U16, _U32 = Struct("<H"), Struct("<I")


def _codes(*spans) -> frozenset[int]:
    return frozenset(x for s in spans for x in (range(s[0], s[1] + 1) if isinstance(s, tuple) else (s,)))


#: Opcodes by what they refer to, by what they do and by width in 16-bit units (1 if none is given).
STRING, STRING_JUMBO = 0x1A, 0x1B
TYPE_USES = _codes(0x1C, 0x1F, 0x20, (0x22, 0x25))
FIELD_USES = _codes((0x52, 0x6D))
METHOD_USES = _codes((0x6E, 0x72), (0x74, 0x78), 0xFA, 0xFB)
BRANCHES, RETURNS, THROWS, SWITCHES = _codes((0x28, 0x2C)), _codes((0x0E, 0x11)), _codes(0x27), _codes(0x2B, 0x2C)
_WIDTHS = {
    2: _codes(0x02, 0x05, 0x08, 0x13, 0x15, 0x16, 0x19, 0x1A, 0x1C, 0x1F, 0x20, 0x22, 0x23, 0x29, (0x2D, 0x3D), (0x44, 0x51), (0x52, 0x6D), (0x90, 0xAF), (0xD0, 0xE2), 0xFE, 0xFF),
    3: _codes(0x03, 0x06, 0x09, 0x14, 0x17, 0x1B, (0x24, 0x26), (0x2A, 0x2C), (0x6E, 0x72), (0x74, 0x78), 0xFC, 0xFD),
    4: _codes(0xFA, 0xFB),
    5: _codes(0x18),
}
WIDTH = [next((w for w, ops in _WIDTHS.items() if op in ops), 1) for op in range(256)]


class Cursor:
    """Bounded reads of a buffer."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def need(self, at: int, n: int) -> int:
        if at < 0 or at + n > len(self.data):
            raise DexError(f"invalid DEX header: read of {n} bytes at {at} is out of bounds")
        return at

    def u16(self, at: int) -> int:
        return _U16.unpack_from(self.data, self.need(at, 2))[0]

    def u32(self, at: int) -> int:
        return _U32.unpack_from(self.data, self.need(at, 4))[0]

    def uleb(self) -> int:
        begin, value = self.at, 0
        for shift in range(0, 35, 7):
            if self.at >= len(self.data):
                break
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                if value > 0xFFFFFFFF:
                    break
                return value
        raise DexError(f"invalid LEB128 value at offset {begin}")


@dataclass
class Scan:
    """What a method's instructions refer to and do; uses are (index, offset, opcode)."""

    opcodes: Counter = field(default_factory=Counter)
    strings: set = field(default_factory=set)
    types: list = field(default_factory=list)
    fields: list = field(default_factory=list)
    methods: list = field(default_factory=list)
    count: int = 0
    branches: int = 0
    returns: int = 0
    throws: int = 0
    switches: int = 0


def payload_width(units: memoryview | list, at: int) -> int:
    """Units of a switch or array payload under opcode 0; 1 for a plain no-op."""
    kind, left = units[at] >> 8, len(units) - at
    if kind in (1, 2) and left >= 2:
        return 4 + 2 * units[at + 1] if kind == 1 else 2 + 4 * units[at + 1]
    if kind == 3 and left >= 4:
        size = units[at + 1] * (units[at + 2] | units[at + 3] << 16)
        return 4 + (size + 1) // 2
    if kind in (1, 2, 3):
        raise DexError(f"invalid instruction at code-unit offset {at}, opcode 0x00")
    return 1


def scan_code(units) -> Scan:
    """One pass over 16-bit units; a payload counts as one instruction with opcode 0."""
    s, at, end = Scan(), 0, len(units)
    uses = ((TYPE_USES, s.types), (FIELD_USES, s.fields), (METHOD_USES, s.methods))
    while at < end:
        op = units[at] & 0xFF
        width = payload_width(units, at) if op == 0 else WIDTH[op]
        if at + width > end:
            raise DexError(f"invalid instruction at code-unit offset {at}, opcode 0x{op:02x}")
        s.opcodes[op] += 1
        s.count += 1
        if op == STRING:
            s.strings.add(units[at + 1])
        elif op == STRING_JUMBO:
            s.strings.add(units[at + 1] | units[at + 2] << 16)
        for ops, sites in uses:
            if op in ops:
                sites.append((units[at + 1], at, op))
        s.branches += op in BRANCHES
        s.returns += op in RETURNS
        s.throws += op in THROWS
        s.switches += op in SWITCHES
        at += width
    return s


class Dex:
    """Symbol tables and classes of one file."""

    def __init__(self, data: bytes):
        c = self.c = Cursor(data)
        if data[:4] != b"dex\n" or data[7:8] != b"\0":
            raise DexError("invalid DEX magic")
        self.version = data[4:7].decode("ascii", "replace")
        if self.version not in VERSIONS:
            raise DexError(f"unsupported DEX version: {self.version}")
        c.need(0, HEADER_SIZE)
        if c.u32(36) != HEADER_SIZE or c.u32(40) != ENDIAN_TAG:
            raise DexError("invalid DEX header: header size or endian tag")
        if c.u32(32) > len(data):
            raise DexError("invalid DEX header: file size is larger than the buffer")
        self.sizes = {k: c.u32(at) for k, at in TABLES.items()}
        self.at = {k: c.u32(at + 4) for k, at in TABLES.items()}
        self.warnings: list[str] = []
        self.strings = [self._text(c.u32(self._row("strings", i, 4))) for i in range(self.sizes["strings"])]
        self.types = []
        for i in range(self.sizes["types"]):
            k = c.u32(self._row("types", i, 4))
            if k >= len(self.strings):
                raise DexError("invalid DEX header: type descriptor index out of range")
            self.types.append(self.strings[k])
        rows = lambda table, width: (self._row(table, i, width) for i in range(self.sizes[table]))
        self.protos = [(self.type(c.u32(r + 4)), self.type_list(c.u32(r + 8))) for r in rows("protos", 12)]
        self.fields = [(self.type(c.u16(r)), self.string(c.u32(r + 4)), self.type(c.u16(r + 2))) for r in rows("fields", 8)]
        self.methods = [(self.type(c.u16(r)), self.string(c.u32(r + 4)), *self.proto(c.u16(r + 2))) for r in rows("methods", 8)]
        self.code: dict[int, dict | None] = {}

    def _row(self, table: str, i: int, width: int) -> int:
        return self.c.need(self.at[table] + i * width, width)

    def _text(self, at: int) -> str:
        self.c.at = at
        self.c.uleb()
        end = self.c.data.find(b"\0", self.c.at)
        if end < 0:
            raise DexError(f"invalid DEX header: text at {at} has no end")
        return self.c.data[self.c.at : end].decode("utf-8", "replace")

    def string(self, i: int) -> str:
        return self.strings[i] if i < len(self.strings) else ""

    def type(self, i: int) -> str:
        return self.types[i] if i < len(self.types) else ""

    def type_list(self, at: int) -> list[str]:
        return [self.type(self.c.u16(at + 4 + 2 * k)) for k in range(self.c.u32(at))] if at else []

    def proto(self, i: int) -> tuple[str, list[str]]:
        return self.protos[i] if i < len(self.protos) else ("", [])

    def method(self, i: int) -> tuple[str, str, str, list[str]]:
        return self.methods[i] if i < len(self.methods) else ("", "", "", [])

    def field(self, i: int) -> tuple[str, str, str]:
        return self.fields[i] if i < len(self.fields) else ("", "", "")

    def method_text(self, i: int) -> str:
        owner, name, ret, params = self.method(i)
        return f"{owner}->{name}({','.join(params)})->{ret}"

    def field_text(self, i: int) -> str:
        owner, name, kind = self.field(i)
        return f"{owner}->{name}:{kind}"

    def members(self, at: int) -> list[list[tuple[int, int, int]]]:
        """Static fields, instance fields, direct and virtual methods as (index, flags, code offset)."""
        if not at:
            return [[], [], [], []]
        self.c.at = at
        counts, out = [self.c.uleb() for _ in range(4)], []
        for k, n in enumerate(counts):
            rows, index = [], 0
            for _ in range(n):
                index += self.c.uleb()
                if index > NO_INDEX:
                    raise DexError("invalid encoded class data: member index overflows")
                rows.append((index, self.c.uleb(), self.c.uleb() if k > 1 else 0))
            out.append(rows)
        return out

    def code_item(self, at: int, owner: str) -> dict | None:
        """A code summary with its raw scan under `scan`; scanned once for each offset."""
        if at not in self.code:
            try:
                n = self.c.u32(at + 12)
                self.c.need(at + 16, 2 * n)
                scan = scan_code(Struct(f"<{n}H").unpack_from(self.c.data, at + 16))
                self.code[at] = {"registers_size": self.c.u16(at), "ins_size": self.c.u16(at + 2), "outs_size": self.c.u16(at + 4), "scan": scan}
            except DexError as e:
                self.code[at] = None
                self.warnings.append(f"{owner}@code_off={at}: {e}")
        return self.code[at]

    def summary(self, item: dict | None) -> dict | None:
        if item is None:
            return None
        s: Scan = item["scan"]
        unique = lambda sites: sorted({i for i, _, _ in sites})
        return {
            "registers_size": item["registers_size"], "ins_size": item["ins_size"], "outs_size": item["outs_size"], "instruction_count": s.count,
            "opcode_histogram": [{"op": op, "n": n} for op, n in sorted(s.opcodes.items())], "string_refs": [self.string(i) for i in sorted(s.strings)],
            "method_refs": [self.method_text(i) for i in unique(s.methods)], "field_refs": [self.field_text(i) for i in unique(s.fields)],
            "branch_count": s.branches, "return_count": s.returns, "throw_count": s.throws, "switch_count": s.switches,
        }

    def classes(self):
        """(class_def_index, descriptor, flags, superclass, interfaces, members) of every definition."""
        for k in range(self.sizes["classes"]):
            r = self._row("classes", k, 32)
            up = self.c.u32(r + 8)
            yield k, self.type(self.c.u32(r)), self.c.u32(r + 4), None if up == NO_INDEX else self.type(up), self.type_list(self.c.u32(r + 12)), self.members(self.c.u32(r + 24))


def decode(data: bytes, part: str, name: str, dex_index: int, members: bool = True) -> dict:
    """A file as {version, sizes, warnings, classes}; ids count from 0 inside the file, fields static first, methods direct first.

    members=False gives classes without members (the code is still scanned, for warnings)."""
    dex, rows, method_id, field_id = Dex(data), [], 0, 0
    for k, descriptor, flags, up, interfaces, (static, instance, direct, virtual) in dex.classes():
        methods, fields = [], []
        for i, f, _ in static + instance:
            owner, fname, kind = dex.field(i)
            fields.append({"id": field_id, "owner_class": owner, "name": fname, "field_type": kind, "access_flags": f})
            field_id += 1
        for i, f, at in direct + virtual:
            owner, mname, ret, params = dex.method(i)
            code = dex.summary(dex.code_item(at, descriptor)) if at else None
            methods.append({"id": method_id, "owner_class": owner, "name": mname, "return_type": ret, "parameters": params, "access_flags": f, "code": code})
            method_id += 1
        origin = {"apk_part": part, "dex_file": name, "dex_index": dex_index, "class_def_index": k}
        rows.append({"id": k, "descriptor": descriptor, "access_flags": flags, "superclass": up, "interfaces": interfaces, "methods": methods if members else [], "fields": fields if members else [], "origin": origin})
    return {"version": dex.version, "sizes": dex.sizes, "warnings": dex.warnings, "classes": rows, "methods": method_id, "fields": field_id}


def reference_sites(data: bytes) -> list[dict]:
    """Every reference of a file, in order: declared types first, then instructions of methods with their offsets.

    A file with a warning or an index out of range can't be audited: DexError."""
    dex, out = Dex(data), []

    def add(kind, owner, name=None, params=None, ret=None, dispatch=None, cls="", method="", offset=None):
        out.append({"kind": kind, "owner": owner, "name": name, "params": params, "ret": ret, "dispatch": dispatch, "source_class": cls, "source_method": method, "offset": offset})

    def index(i: int, table: list, what: str) -> int:
        if i >= len(table):
            raise DexError(f"cannot audit: incomplete DEX parsing: {what} index {i} out of range")
        return i

    for _, descriptor, _, up, interfaces, (static, instance, direct, virtual) in dex.classes():
        for t in ([up] if up else []) + interfaces:
            add("class", t, cls=descriptor)
        for i, _, _ in static + instance:
            add("class", dex.field(index(i, dex.fields, "field"))[2], cls=descriptor)
        for i, _, at in direct + virtual:
            _, name, ret, params = dex.method(index(i, dex.methods, "method"))
            text = f"{name}({''.join(params)}){ret}"
            for t in [ret, *params]:
                add("class", t, cls=descriptor, method=text)
            item = dex.code_item(at, descriptor) if at else None
            if item is None:
                if at:
                    raise DexError(f"cannot audit: incomplete DEX parsing: {dex.warnings[-1]}")
                continue
            scan: Scan = item["scan"]
            sites = sorted([(o, "t", i, op) for i, o, op in scan.types] + [(o, "m", i, op) for i, o, op in scan.methods] + [(o, "f", i, op) for i, o, op in scan.fields])
            for offset, kind, i, op in sites:
                here = {"cls": descriptor, "method": text, "offset": offset}
                if kind == "t":
                    add("class", dex.type(index(i, dex.types, "type")), **here)
                elif kind == "m":
                    owner, mname, mret, mparams = dex.method(index(i, dex.methods, "method"))
                    for t in [mret, *mparams]:
                        add("class", t, **here)
                    add("method", owner, mname, mparams, mret, "static" if op in (0x71, 0x77) else "direct" if op in (0x70, 0x76) else "virtual", **here)
                else:
                    owner, fname, ftype = dex.field(index(i, dex.fields, "field"))
                    add("class", ftype, **here)
                    add("field", owner, fname, None, ftype, "static" if op >= 0x60 else "instance", **here)
    return out


def definitions(data: bytes) -> tuple[list[dict], list[dict], list[dict]]:
    """Classes, methods and fields that a file defines, for the audit's index."""
    dex, classes, methods, fields = Dex(data), [], [], []
    for _, descriptor, _, up, interfaces, (static, instance, direct, virtual) in dex.classes():
        classes.append({"descriptor": descriptor, "superclass": up, "interfaces": interfaces})
        for is_direct, rows in ((True, direct), (False, virtual)):
            for i, flags, _ in rows:
                _, name, ret, params = dex.method(i)
                methods.append({"owner": descriptor, "name": name, "params": params, "ret": ret, "is_static": bool(flags & 0x0008), "is_direct": is_direct})
        for is_static, rows in ((True, static), (False, instance)):
            for i, _, _ in rows:
                _, name, kind = dex.field(i)
                fields.append({"owner": descriptor, "name": name, "type": kind, "is_static": is_static})
    return classes, methods, fields

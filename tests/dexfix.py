"""A tiny DEX and zip writer for tests."""

from __future__ import annotations

import io
import struct
import zipfile
from dataclasses import dataclass, field


@dataclass
class Method:
    name: str
    params: list = field(default_factory=list)
    ret: str = "V"
    kind: str = "direct"  # direct, static, virtual, abstract
    code: list | None = None  # ("string", s), ("class", t), ("call"|"static"|"direct", owner, name, params, ret), ("get"|"sget", owner, name, type), ("raw", units)


@dataclass
class Class:
    descriptor: str
    superclass: str | None = "Ljava/lang/Object;"
    interfaces: list = field(default_factory=list)
    methods: list = field(default_factory=list)
    fields: list = field(default_factory=list)  # (name, type, static)
    flags: int = 1


OPS = {"class": 0x1C, "call": 0x6E, "direct": 0x70, "static": 0x71, "get": 0x52, "sget": 0x60}


def uleb(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out)


class Writer:
    def __init__(self, classes: list[Class], version: str = "035"):
        self.classes, self.version = classes, version
        self.protos: list[tuple] = []
        self.fields: list[tuple] = []
        self.methods: list[tuple] = []
        self.types: list[str] = []
        self.strings: list[str] = []

    def _add(self, table: list, x):
        if x not in table:
            table.append(x)
        return table.index(x)

    def string(self, s):
        return self._add(self.strings, s)

    def type(self, t):
        self.string(t)
        return self._add(self.types, t)

    def proto(self, params, ret):
        for t in (ret, *params):
            self.type(t)
        return self._add(self.protos, (tuple(params), ret))

    def method(self, owner, name, params, ret):
        self.type(owner)
        self.string(name)
        return self._add(self.methods, (owner, name, self.proto(params, ret)))

    def field(self, owner, name, kind):
        self.type(owner)
        self.type(kind)
        self.string(name)
        return self._add(self.fields, (owner, name, kind))

    def units(self, code) -> list[int]:
        out: list[int] = []
        for op, *x in code:
            if op == "raw":
                out += x[0]
            elif op == "string":
                out += [0x1A, self.string(x[0])]
            elif op == "class":
                out += [0x1C, self.type(x[0])]
            elif op in ("get", "sget"):
                out += [OPS[op], self.field(*x)]
            else:
                out += [OPS[op], self.method(*x), 0]
        return [*out, 0x0E]

    def build(self) -> bytes:
        body, at = bytearray(), 0
        members = {}
        for c in self.classes:
            for t in [c.descriptor, *([c.superclass] if c.superclass else []), *c.interfaces]:
                self.type(t)
            fs = {s: [(self.field(c.descriptor, n, t), 8 if s else 1, 0) for n, t, st in c.fields if st == s] for s in (True, False)}
            ms = {"d": [], "v": []}
            for m in c.methods:
                i = self.method(c.descriptor, m.name, m.params, m.ret)
                flags = {"static": 9, "direct": 2, "virtual": 1, "abstract": 0x401}[m.kind]
                ms["d" if m.kind in ("direct", "static") else "v"].append((i, flags, self.units(m.code) if m.code is not None else None))
            members[c.descriptor] = (fs[True], fs[False], ms["d"], ms["v"])
        self.string("V")
        base = 112 + 4 * len(self.strings) + 4 * len(self.types) + 12 * len(self.protos) + 8 * len(self.fields) + 8 * len(self.methods) + 32 * len(self.classes)
        here = lambda: base + len(body)
        text_at = []
        for s in self.strings:
            text_at.append(here())
            body.extend(uleb(len(s)) + s.encode() + b"\0")

        def type_list(ts):
            if not ts:
                return 0
            while len(body) % 4:
                body.append(0)
            at = here()
            body.extend(struct.pack("<I", len(ts)) + b"".join(struct.pack("<H", self.types.index(t)) for t in ts))
            return at

        proto_at = [type_list(p) for p, _ in self.protos]
        rows = bytearray()
        for c in self.classes:
            coded = []
            for group in members[c.descriptor]:
                done = []
                for i, flags, units in sorted(group, key=lambda r: r[0]):
                    off = 0
                    if isinstance(units, list):
                        while len(body) % 4:
                            body.append(0)
                        off = here()
                        body.extend(struct.pack("<HHHHII", 3, 1, 1, 0, 0, len(units)) + struct.pack(f"<{len(units)}H", *units))
                    done.append((i, flags, off))
                coded.append(done)
            faces = type_list(c.interfaces)
            data_at = here()
            body.extend(b"".join(uleb(len(g)) for g in coded))
            for k, g in enumerate(coded):
                last = 0
                for i, flags, off in g:
                    body.extend(uleb(i - last) + uleb(flags) + (uleb(off) if k > 1 else b""))
                    last = i
            up = self.types.index(c.superclass) if c.superclass else 0xFFFFFFFF
            rows.extend(struct.pack("<8I", self.types.index(c.descriptor), c.flags, up, faces, 0xFFFFFFFF, 0, data_at, 0))
        tables = b"".join(struct.pack("<I", x) for x in text_at) + b"".join(struct.pack("<I", self.strings.index(t)) for t in self.types)
        tables += b"".join(struct.pack("<III", 0, self.types.index(r), proto_at[k]) for k, (_, r) in enumerate(self.protos))
        tables += b"".join(struct.pack("<HHI", self.types.index(o), self.types.index(t), self.strings.index(n)) for o, n, t in self.fields)
        tables += b"".join(struct.pack("<HHI", self.types.index(o), p, self.strings.index(n)) for o, n, p in self.methods) + bytes(rows)
        head = bytearray(112)
        head[:8] = b"dex\n" + self.version.encode() + b"\0"
        struct.pack_into("<III", head, 32, base + len(body), 112, 0x12345678)
        at = 112
        for k, (n, width) in enumerate(((len(self.strings), 4), (len(self.types), 4), (len(self.protos), 12), (len(self.fields), 8), (len(self.methods), 8), (len(self.classes), 32))):
            struct.pack_into("<II", head, 56 + 8 * k, n, at)
            at += n * width
        return bytes(head) + tables + bytes(body)


def dex(*classes: Class, version: str = "035") -> bytes:
    return Writer(list(classes), version).build()


def archive(**entries: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()

import re
from fractions import Fraction

from artifactlink.llm import licenses as L
from artifactlink.llm import mixing as M
from artifactlink.llm.common import read_table
from tests.llm.support import frame, odd_texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute_scan(t, threshold=Fraction(8, 10)):
    w, starts, base = words(t), [], set()
    for p, label in L.PHRASES.items():
        p = p.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    shares, labels = [], set(base)
    for text, label in L.TEMPLATES:
        own, size = set(words(text)), len(words(text)) * 5 // 4
        for i in range(len(w)) if len(own & set(w)) >= threshold * len(own) else ():
            n = len(own & set(w[i : i + size]))
            if n >= threshold * len(own):
                shares.append(n / len(own))
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if starts else max(shares, default=0.0)


def test_license_scan(spark):
    extra = [
        "Released under the MIT License.", "mit, (license) MIT\nLICENSE", "This work is licensed under the GNU General\npublic license, version 3.", "Licensed under CC BY-NC 4.0.",
        "Licensed under the\nMozilla, Public\nLicense", "licensed " + "x " * 30 + "under the mozilla public license version 2.0", "a " * 50 + "released\nunder the\r\nISC\n\nlicense " * 3, "summit license", "permission is hereby granted free of charge to any person obtaining a copy of software", "LICENSED under the apache license", "general public license general public license",
    ]
    rows = [*enumerate([*odd_texts(9), *extra]), (None, "MIT license"), (4, "again"), (4, "again")]
    got = sorted([tuple(r)[:8] for r in L.license_scan(frame(spark, rows)).collect()], key=str)
    assert got == sorted([(i, *brute_scan(t)) for i, t in rows], key=str)
    assert any(r[6] for r in got) and L.license_scan(frame(spark, [])).count() == 0


def test_statements_over_line_ends(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\nconditions are met"
    grant = "Permission is hereby granted,\n free of charge, to any person obtaining\n a copy of this software"
    got = {r.doc_id: r for r in L.license_scan(frame(spark, [(1, "\n".join(["x"] * 9) + bsd), (2, grant), (3, "clean text on a license")])).collect()}
    assert got[1].labels == "bsd" and got[2].labels == "mit" and got[3].labels == "" and got[3].score == 0
    b = min(got[1].blocks, key=lambda b: b.first_word)
    assert words("\n".join(["x"] * 9) + bsd)[b.first_word] in words(bsd)


def test_long_text_takes_time_by_its_words():
    import time

    index, phrases = L.Index(L.TEMPLATES, {}, 0.8), [(p.encode().split(), label) for p, label in L.PHRASES.items()]
    times = []
    for n in (100_000, 400_000):
        start = time.thread_time()
        got = L.scan_text(b"the mit license " * n, index, phrases)
        times.append(time.thread_time() - start)
        assert got[:4] == (3 * n, n, 1, 3 * n - 2)
    assert times[1] < 12 * times[0]


def test_license_table(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    got = {r.doc_id: tuple(r)[1:8] for r in L.license_scan(docs).collect()}
    assert got == {r.doc_id: brute_scan(r.text) for r in docs.collect()}


def brute_deal(budget, children):
    """children: name -> (weight, cap). Fill the tightest first; the rest share by weight, rounded down."""
    out, left = {}, dict(children)
    b = min(budget, sum(c for _, c in children.values()))
    for name in sorted(children, key=lambda k: (children[k][1] * 1_000_000 // children[k][0], k)):
        w_left = sum(w for w, _ in left.values())
        w, cap = left[name]
        if cap * w_left > w * b:
            return out | {k: left[k][0] * b // w_left for k in left}
        out[name] = cap
        b -= cap
        del left[name]
    return out


def brute_mix(rows, numer, denom, epochs, seed, weights):
    import hashlib

    leaves = {}
    for d, t, lang, source in rows:
        digit = "0123456789abcdef".index(hashlib.md5((source or "unknown").encode()).hexdigest()[0])
        leaf = (M.DOMAINS[(digit + 1) % 4], lang or "und", source or "unknown")
        leaves.setdefault(leaf, []).append((d, len((t or "").encode().split())))
    cap = {k: epochs * sum(n for _, n in v) for k, v in leaves.items()}
    total = sum(cap.values()) // epochs
    wt = lambda level, v: weights.get((level, v), 1)
    out = []
    doms = brute_deal(total * numer // denom, {x: (wt("domain", x), sum(c for k, c in cap.items() if k[0] == x)) for x in {k[0] for k in cap}})
    for dom, b in doms.items():
        langs = brute_deal(b, {x: (wt("lang", x), sum(c for k, c in cap.items() if k[:2] == (dom, x))) for x in {k[1] for k in cap if k[0] == dom}})
        for lang, b2 in langs.items():
            srcs = brute_deal(b2, {k[2]: (wt("source", k[2]), c) for k, c in cap.items() if k[:2] == (dom, lang)})
            for src, b3 in srcs.items():
                docs, left = leaves[(dom, lang, src)], b3
                for e in range(1, epochs + 1):
                    groups = {}
                    for d, n in docs:
                        groups.setdefault(hashlib.md5(f"{seed}:{e}:{'null' if d is None else d}".encode()).hexdigest(), []).append((d, n))
                    if b3 == 0 or left == 0:
                        break
                    for key in sorted(groups):
                        size = sum(n for _, n in groups[key])
                        if size > left:
                            left = 0
                            break
                        left -= size
                        out += [(d, dom, lang, src, n, e, b3) for d, n in groups[key]]
                    else:
                        continue
                    break
    return sorted(out, key=str)


def test_mixing(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), ["en", "fr", None][i % 3], [f"src{i % 5}", None][i % 11 == 0]) for i in range(120)]
    rows += [(None, "a b", "en", "src1"), (None, "c", "en", "src1"), (7, "x y z", "en", "src2"), (7, "x y z", "en", "src2"), (500, None, "fr", "src3"), (501, "", "fr", "src3")]
    for numer, denom, epochs in ((7, 10, 2), (3, 1, 2), (1, 50, 3), (9, 10, 1)):
        got = M.mix(frame(spark, rows), numer, denom, epochs, bucket_digits=1).drop("key").collect()
        assert sorted([tuple(r) for r in got], key=str) == brute_mix(rows, numer, denom, epochs, 20, M.WEIGHTS), (numer, denom, epochs)
    assert M.mix(frame(spark, [])).count() == 0


def test_mixed_documents_are_the_first_epoch(spark):
    rows = [(i, "w " * (1 + i % 9), "en", f"src{i % 4}") for i in range(80)]
    df = frame(spark, rows)
    out = M.mix_documents(df, 9, 10)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in brute_mix(rows, 9, 10, 1, 20, M.WEIGHTS))

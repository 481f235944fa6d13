import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from artifactlink.llm import perplexity as Q
from artifactlink.llm.common import read_table
from tests.llm.support import frame, odd_texts


def base(text):
    raw = (text or "").encode()
    words = raw.split()
    seen = Counter(zip(*[words[i:] for i in range(5)]))
    covered = {i + k for i, w in enumerate(zip(*[words[i:] for i in range(5)])) if seen[w] > 1 for k in range(5)}
    lines, dup, had = raw.split(b"\n"), 0, set()
    for x in lines:
        if x.split():
            dup += x in had
            had.add(x)
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_base_rules_of_odd_rows(spark):
    texts = [*odd_texts(7), "a b c d e a b c d e", "a b c d e f g h i j k l a b c d e", "x\ny\nx\n\n\n x\nx", "w " * 40]
    rows = [*enumerate(texts), (None, "null id"), (3, "again"), (3, "again")]
    got = sorted([tuple(r)[:8] for r in Q.quality_rules(frame(spark, rows), hash_bits=14).collect()], key=str)
    want = []
    for i, t in rows:
        n, chars, symbols, dup, rep = base(t)
        want.append((i, n, chars, symbols, dup, rep, n < 10 or 100 * rep > 20 * n))
    assert [g[:7] for g in got] == [w for w in sorted(want, key=str)]
    assert not any(g[7] for g in got if g[6])
    assert Q.quality_rules(frame(spark, []), hash_bits=14).count() == 0


def brute_model(texts, langs, order):
    """Modified Kneser-Ney over exact n-grams, from the definition."""
    counts = {k: Counter() for k in range(1, order + 1)}
    for t, lang in zip(texts, langs):
        s = "\0" * (order - 1) + Q.normalize(t) + "\1"
        for i in range(order - 1, len(s)):
            counts[order][(lang, s[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        for lang, g in counts[k + 1]:
            counts[k][(lang, g[1:])] += 1
    d = {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d[k] = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05 * i), 0.95 * i) if n[i] else 0.5 * i for i in (1, 2, 3)]
    total, mass = defaultdict(float), defaultdict(float)
    cut = lambda k, c: d[k][min(c, 3) - 1]
    for k, c in counts.items():
        for (lang, g), n in c.items():
            total[(k, lang, g[:-1])] += n
            mass[(k, lang, g[:-1])] += cut(k, n)
    alphabet = len(counts[1])

    def log10(t, lang):
        s, out = "\0" * (order - 1) + Q.normalize(t) + "\1", 0.0
        for i in range(order - 1, len(s)):
            p = 1.0 / (alphabet + 1)
            for k in range(1, order + 1):
                g = s[i - k + 1 : i + 1]
                x, n = (k, lang, g[:-1]), counts[k].get((lang, g), 0)
                if x in total:
                    p = ((n - cut(k, n)) if n else 0.0) / total[x] + mass[x] / total[x] * p
            out += math.log10(p)
        return out

    return log10


def test_model_matches_the_definition(spark):
    texts = [f"the cat sat on the mat number {i} and then the dog ran off with a hat" for i in range(12)] + ["le chat noir dort sur le lit et la souris danse"] * 3
    langs = ["en"] * 12 + ["fr"] * 3
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate(zip(texts, langs))]
    df = frame(spark, rows).select("doc_id", "text", "lang")
    model = Q.train(df, 4, 30)
    g = Q.Grams([t.encode() for t in texts], langs, 4, 30)
    lp = model.log10(g)[g.where]
    ref = brute_model([t.encode() for t in texts], langs, 4)
    for k, (t, lang) in enumerate(zip(texts, langs)):
        assert lp[g.starts[k] : g.starts[k] + g.lengths[k]].sum() == pytest.approx(ref(t.encode(), lang), rel=1e-4)


def test_junk_is_rejected_and_prose_kept(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    out = {r.doc_id: r for r in Q.quality_rules(docs).collect()}
    quality = {r.doc_id: r.quality for r in read_table(spark, sf_dir, "labels").collect()}
    good = [out[i].kept for i, q in quality.items() if q == 1 and not out[i].base_failed]
    bad = [out[i].kept for i, q in quality.items() if q == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1


def test_unseen_ngrams_are_not_taken_for_seen(spark, sf_dir):
    import inspect

    bits = inspect.signature(Q.quality_rules).parameters["hash_bits"].default
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").where("lang = 'en'").limit(60)
    rows = [(r.text.encode(), r.lang) for r in docs.collect() if r.text and Q.is_prose(r.text.encode())]
    rng = np.random.default_rng(4)
    junk = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 4000))) for _ in range(5)]
    known, other = Q.Grams(*map(list, zip(*rows)), 5, bits), Q.Grams([t.encode() for t in junk], ["en"] * 5, 5, bits)
    assert len(rows) > 20 and not np.isin(other.slots[5], known.slots[5]).any()
    s = {Q.normalize(t)[i : i + 5] for t, _ in rows for i in range(len(Q.normalize(t)) - 4)}
    assert len(np.unique(known.slots[5])) >= len(s)
    model = Q.train(docs, 5, bits)
    assert max(v.max() for v in (model.grams[5][0], model.contexts[5][0])) > 1 << 32

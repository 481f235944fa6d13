import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from artifactlink.llm import bigru, langid, neural_lm, toxicity
from artifactlink.llm.common import ASCII_LOWER, read_table
from tests.llm.support import frame, odd_texts


def test_gru_gradients_and_scoring_agree():
    rng = np.random.default_rng(0)
    steps, batch, hidden = 5, 3, 4
    x = rng.normal(size=(steps, batch, 3 * hidden)).astype(np.float64)
    w = rng.normal(size=(hidden, 3 * hidden))
    mask = np.array([[1, 1, 1], [1, 1, 0], [1, 1, 0], [1, 0, 0], [1, 0, 0]], np.float64)
    up = rng.normal(size=(steps, batch, hidden))
    loss = lambda x, w: float((bigru.gru_with_cache(x, mask, w)[0].astype(np.float64) * up).sum())
    out, cache = bigru.gru_with_cache(x, mask, w)
    dx, dw = bigru.gru_gradients(up, cache, w)
    for a, d in ((x, dx), (w, dw)):
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in a.shape)
            keep, e = a[at], 1e-2
            a[at] = keep + e
            hi = loss(x, w)
            a[at] = keep - e
            lo = loss(x, w)
            a[at] = keep
            assert (hi - lo) / (2 * e) == pytest.approx(d[at], abs=3e-3)
    x32, w32 = x.astype(np.float32), w.astype(np.float32)
    fast = bigru.run_gru(lambda t: np.ascontiguousarray(x32[t].T), range(steps), batch, mask > 0, w32)
    assert np.allclose(fast.transpose(0, 2, 1), out, atol=1e-5)


def test_language_windows_cover_every_byte():
    texts = [b"", b"abc", b"x" * 64, b"y" * 130]
    data, lengths, owner = langid.windows_of(texts, 64)
    assert lengths.tolist() == [3, 64, 64, 64, 2] and owner.tolist() == [1, 2, 3, 3, 3]


def test_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    out = {r.doc_id: r for r in langid.language_id(docs, steps=200).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    held = [out[i].lang_pred == r.lang for i, r in rows.items() if out[i].held_out]
    assert np.mean(held) > 0.9
    odd = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "123 !? 🙂", "en", "s"), (None, "the cat", "en", "s"), (4, "le chat", None, "s"), (4, "le chat", None, "s")]
    got = langid.language_id(frame(spark, odd), steps=3).collect()
    assert sorted((r.doc_id or 0, r.lang_pred == "und", r.score == 0.0) for r in got) == [(0, False, False), (1, True, True), (2, True, True), (3, True, True), (4, False, False), (4, False, False)]
    assert langid.language_id(frame(spark, [])).count() == 0


def test_toxicity(spark, sf_dir):
    bad = ["idiot", "moron", "scum"]
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows, labels = [], []
    for i in range(400):
        w = [word() for _ in range(int(rng.integers(5, 90)))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(int(rng.integers(0, len(w))), str(rng.choice(bad)).upper() + ["", "!", ","][i % 3])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "?! .."), (None, "an idiot"), (1003, "word " * 3000 + "idiot moron scum " + "word " * 3000)]
    lab = spark.createDataFrame([*labels, (0, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows), lab, steps=150).collect()}
    want = dict(labels)
    held = [out[i].predicted == y for i, y in want.items() if out[i].held_out]
    assert len(held) > 40 and np.mean(held) > 0.95
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in want)
    assert [out[i].score for i in (1000, 1001, 1002)] == [0, 0, 0] and out[1003].predicted == 1
    kept = toxicity.drop_toxic(frame(spark, rows), lab, steps=150)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, r in out.items() if r.predicted == 0)
    assert toxicity.toxicity(frame(spark, []), lab, steps=2).count() == 0


def test_all_windows_are_scored():
    words = toxicity.Words([b" ".join(b"w%d" % i for i in range(n)) for n in (0, 1, 16, 17, 32, 33, 100)])
    rows, owner = words.windows(32)
    assert np.bincount(owner, minlength=7).tolist() == [0, 1, 1, 1, 1, 2, 6]
    starts = np.cumsum(words.counts) - words.counts
    for k in range(1, 7):
        mine = set(rows[owner == k].ravel().tolist()) - {words.n}
        assert mine == set(words.ids[starts[k] : starts[k] + words.counts[k]].tolist())


def test_language_model(spark):
    texts = [*odd_texts(11), *["the cat sat on the mat and the dog sat on the rug"] * 30, "Unseen words only here"]
    rows = [*enumerate(texts), (None, "null id the cat"), (3, "again"), (3, "again")]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    split = lambda t: [*(t or "").encode().translate(ASCII_LOWER).split(), b" "]
    c = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        w = split(t)
        want.append((i, held(i), len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    for head in (20, 1 << 18):
        got = neural_lm.lm_scores(frame(spark, rows), vocab=15, head_size=head, steps=60).collect()
        got = sorted(([*tuple(r)[:5], r.base_score, r.score] for r in got), key=lambda r: (str(r[0]), r[2], r[5]))
        assert len(got) == len(want)
        for g, x in zip(got, sorted(want, key=lambda r: (str(r[0]), r[2], r[5]))):
            assert tuple(g[:5]) == x[:5] and g[5] == pytest.approx(x[5], rel=1e-9) and g[6] < 0
    assert neural_lm.lm_scores(frame(spark, []), steps=2).count() == 0


def test_class_probabilities_sum_to_one_and_learn():
    rng = np.random.default_rng(1)
    n = 6
    # class k follows (any, k - 1)
    triples = np.array([(int(rng.integers(0, n)), k, (k + 1) % n) for k in range(n) for _ in range(40)])
    model = neural_lm.train_nce(triples, np.ones(len(triples)), np.full(n, 1 / n), dim=8, steps=600)
    one, two = np.repeat(np.arange(n + 1), n), np.tile(np.arange(n), n + 1)
    total = sum(np.exp(model.log_probs(np.full(len(one), w), one, two)) for w in range(n))
    assert np.allclose(total, 1, atol=1e-4)
    right = np.exp(model.log_probs((np.arange(n) + 1) % n, np.zeros(n, int), np.arange(n)))
    assert right.mean() > 0.6


def test_scores_are_summed_whatever_their_size():
    rng = np.random.default_rng(2)
    r, out, bias = rng.normal(0, 1, (600, 5)).astype(np.float32), rng.normal(0, 1, (40, 5)).astype(np.float32), rng.normal(-3, 1, 40).astype(np.float32)
    r[300:310] *= 200
    s = r.astype(float) @ out.T.astype(float) + bias
    want = s.max(1) + np.log(np.exp(s - s.max(1)[:, None]).sum(1))
    assert np.allclose(neural_lm.log_sums(r, out, bias), want, rtol=1e-5, atol=1e-4)
    assert len(neural_lm.log_sums(r[:0], out, bias)) == 0


def test_words_by_arrow_are_the_words():
    texts = [*[t for _, t in enumerate(odd_texts(12))], None, "", " ", "a", " A\x0bb\x1cc\u00a0D\u2003e \x0c", "x" * 300_000, "b a"]
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"]).slice(1)
    words, sizes = neural_lm.words_of(batch)
    want = [neural_lm.lm_words((t or "").encode()) for t in texts[1:]]
    assert sizes.tolist() == [len(w) - 1 for w in want]
    vocabulary = pa.array([b"b", neural_lm.END, b"a"], pa.large_binary())
    place = {b"b": 0, neural_lm.END: 1, b"a": 2}
    assert neural_lm.numbers_of(words, sizes, vocabulary).tolist() == [place.get(x, -1) for w in want for x in w]
    assert neural_lm.numbers_of(words, sizes, vocabulary[:0]).tolist() == [-1] * sum(map(len, want))


def test_held_out_text_is_likelier_than_by_word_counts(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    r = neural_lm.lm_scores(docs).where("held_out").selectExpr("sum(score) / sum(n_tokens) as s", "sum(base_score) / sum(n_tokens) as b").first()
    assert r.s > r.b


def test_every_training_position_is_trained_on(spark):
    texts = [f"w{i % 90} x{i % 7} w{i * 7 % 90} y" for i in range(400)]
    docs = frame(spark, [*enumerate(texts)])
    words = Counter(w for t in texts for w in neural_lm.lm_words(t.encode()))
    ids = {w: i for i, (w, _) in enumerate(words.most_common())}
    vocabulary = pa.array(list(ids), pa.large_binary())
    layout, tokens = neural_lm.layout_of(len(ids), 8), sum(words.values())
    table = neural_lm.encode(docs, vocabulary, layout.n, 6, [1, 1, 2, 2]).collect()
    assert sorted(r.ids for r in table) == sorted(np.array([ids[w] for w in neural_lm.lm_words(t.encode())], np.int32).tobytes() for t in texts)
    assert all(r["round"] == [0, 1, 2, 2, 3, 3][r.shard] for r in table)
    share, tail = np.full(layout.classes, 1 / layout.classes), np.zeros(layout.n - layout.head)
    model = neural_lm.train_rounds(docs, vocabulary, layout, share, tail, tokens, 1, 4, shard_size=tokens // 6 + 1)
    start, _ = neural_lm.start_net(layout.n + 2, share, tail, 4, 7)
    moved = (model.net["r"] != start["r"]).any(1)
    assert moved[[i for w, i in ids.items() if w != neural_lm.END]].all() and moved[layout.n + 1]


def test_words_outside_the_head_follow_their_context(spark):
    texts = [f"key{i} val{i}" for i in range(40) for _ in range(30)]
    ask = [f"key{i} val{i + k}" for i in range(39) for k in (0, 1)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    at = [i for i in range(20_000) if held(i)][: len(ask)]
    free = [i for i in range(20_000) if not held(i)][: len(texts)]
    got = {r.doc_id: r for r in neural_lm.lm_scores(frame(spark, [*zip(free, texts), *zip(at, ask)]), vocab=5).collect()}
    better = [got[a].score - got[b].score for a, b in zip(at[::2], at[1::2])]
    assert np.mean(better) > 0.5 and np.mean([x > 0 for x in better]) > 0.9
    lay = neural_lm.Layout(9, 3, 2)
    net, _ = neural_lm.start_net(11, np.full(lay.classes, 1 / lay.classes), np.zeros(6), 4, 1)
    total = sum(np.exp(neural_lm.Factored(lay, net).log_probs(np.full(11, w), np.arange(11), np.arange(11))) for w in range(10))
    assert np.allclose(total, 1, atol=1e-4)


def test_every_language_is_learned(spark):
    rows = frame(spark, [(i, f"text number {i}", f"l{i % 70:02}", "s") for i in range(140)]).select("doc_id", "text", "lang")
    langs, _, _, labels = langid.training_windows(rows, 1500, 4, 64)
    assert langs == [f"l{i:02}" for i in range(70)] and set(labels.tolist()) == set(range(70))


def test_equal_positions_are_trained_on_as_one_with_their_weight():
    rng = np.random.default_rng(3)
    layout = neural_lm.Layout(9, 3, 2)
    texts = [rng.integers(0, 10, rng.integers(1, 40)).astype(np.int32) for _ in range(60)] + [np.zeros(90, np.int32)]
    want: Counter = Counter()
    for t in texts:
        full = [layout.n + 1, layout.n + 1, *t.tolist()]
        want.update(zip(full[1:], full, full[2:]))
    one, two, heads, ids, weight = neural_lm.chunks_of([t.tobytes() for t in texts], layout)
    got: Counter = Counter()
    for a, b, lo, hi in zip(one.tolist(), two.tolist(), heads, [*heads[1:], len(ids)]):
        assert 0 < hi - lo <= neural_lm.CHUNK
        for x, k in zip(ids[lo:hi].tolist(), weight[lo:hi].tolist()):
            got[b, a, x] += k
    assert weight.max() <= neural_lm.HEAVIEST and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(n, rel=1e-5) for k, n in want.items()) and sum(want.values()) == sum(map(len, texts))


def test_what_shards_send_follows_the_text_not_the_network():
    n, rows = 440_000, np.arange(neural_lm.ROWS)
    sent = lambda dim: len(neural_lm._pack(rows, rows, rows, np.zeros((len(rows), dim))))
    a_word = (2 * sent(24) + sent(1)) / len(rows)
    for tokens in (0, 1, 10**8, 10**10):
        assert neural_lm.shards_of(tokens, n) * n * a_word <= 2.01 * tokens + n * a_word
    assert neural_lm.shards_of(10**8, 1000) == 13


def test_states_average_by_how_often_rows_moved():
    one = neural_lm._pack(np.array([0, 4095]), np.array([1, 2]), np.array([0.5, 1]), np.array([[1.0, -2], [0.25, 4]]))
    two = neural_lm._pack(np.array([4095]), np.array([6]), np.array([2]), np.array([[1.25, 0]]))
    rows, weight, gain, change = neural_lm._unpack(neural_lm._average([one, two]))
    assert rows.tolist() == [0, 4095] and weight.tolist() == [1, 8] and gain.tolist() == [0.5, 3] and change.tolist() == [[1, -2], [1, 1]]


def test_sums_of_runs_are_those_of_reduceat():
    rng = np.random.default_rng(5)
    for top in (2, 40, 4000):
        by, starts, _ = neural_lm._runs(rng.integers(0, top, 2000))
        g = rng.normal(size=(2000, 5)).astype(np.float32)
        assert np.allclose(neural_lm._sums(g, starts, by), np.add.reduceat(g[by], starts, axis=0), atol=1e-4)
        assert np.allclose(neural_lm._sums(g, starts), np.add.reduceat(g, starts, axis=0), atol=1e-4)


def test_words_counted_by_arrow(spark, monkeypatch):
    texts = [*odd_texts(40), None, "", "A a\x0bb", "a " * 500]
    got = {bytes(r.word): r.n for r in neural_lm.counted_words(frame(spark, [*enumerate(texts)])).collect()}
    assert got == Counter(w for t in texts for w in neural_lm.lm_words((t or "").encode()))
    monkeypatch.setattr(neural_lm, "TEXT_BYTES", 50)
    batches = [pa.record_batch([pa.array(texts[i : i + 3], pa.string())], ["text"]) for i in range(0, len(texts), 3)]
    pieces = list(neural_lm.gathered(iter(batches)))
    assert [t for b in pieces for t in b.column(0).to_pylist()] == texts and len(pieces) > 2
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(0).to_pylist()) <= 50 for b in pieces)


def test_words_of_slices_of_large_batches():
    texts = [f"Text {i} of A large\tbatch\u00e9 " * (1 + i % 40) for i in range(4000)]
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    for at, n in ((1, 5), (700, 900), (2500, 1500)):
        words, sizes = neural_lm.words_of(batch.slice(at, n))
        want = [neural_lm.lm_words(t.encode())[:-1] for t in texts[at : at + n]]
        assert sizes.tolist() == [len(w) for w in want] and words.to_pylist() == [x for w in want for x in w]

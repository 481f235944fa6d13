"""Toxicity with a bidirectional gated recurrent network and attention pooling over character and word inputs.

A word's input is a vector of the word (for the `VOCAB` words that most training texts have, known by 64-bit hashes) plus
the mean of vectors of its character 3- to 5-grams (hashed, with marks for the word's start and end), so that forms of a
word that no training text has still resemble it. Every
overlapping window of `window` words (starts `window` / 2 apart, the whole text) goes through the network; attention pools
its states to one score, and a document has the score of its highest window.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled documents: at most
`sample_docs` of each label, chosen by a hash of doc_id, and of each at most `sample_words` words in a row. Of a clean one
they stand at a place given by the hash, as any part of a clean text is clean. Of a longer toxic one they are the part
that matters: a first network, trained without these documents, scores all of their text where it lies, in overlapping
stretches, and the training goes on with the highest stretch of each. A toxic label belongs to its document's highest
window, as the network sees it so far (multiple-instance learning); early on, to all windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artifactlink.llm.bigru import Adam, gru_gradients, gru_with_cache, recurrent_weights, run_gru, sigmoid
from artifactlink.llm.common import ASCII_LOWER, give_back, heldout, pieces_of, small_batches, text_bytes, tidy
from artifactlink.llm.shingles import mix, word_places

#: ASCII letters and digits, lower case, and all other bytes from 0x80; everything else ends a word.
_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in ASCII_LOWER)
#: Slots of character n-grams, and words with vectors of their own.
SLOTS = 1 << 15
VOCAB = 1 << 13
#: Spread of first character vectors: small, so that n-grams that no training text has say nothing.
CHAR_INIT = 0.03
_GRAMS = (3, 4, 5)
#: Bytes of text that are scored at a time; working memory is some hundred times as much, or follows one longer text.
PIECE = 500_000


#: Words whose n-grams are made at a time.
_SOME = 50_000


def _word_grams(raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of words of a buffer, and which word each is of, in the words' order."""
    # each word between a mark for its start and one for its end
    sizes = lengths + 2
    at = np.cumsum(sizes) - sizes
    chars = np.empty(int(sizes.sum()), np.uint64)
    chars[at], chars[at + sizes - 1] = 1, 2
    inner = np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.ones(len(chars), bool)
    place[at] = place[at + sizes - 1] = False
    chars[place] = np.frombuffer(raw, np.uint8)[inner]
    owner = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
    grams, owners = [], []
    for k in _GRAMS:
        m = len(chars) - k + 1
        if m <= 0:
            continue
        same = owner[:m] == owner[k - 1 :]
        key = np.zeros(m, np.uint64)
        for j in range(k):
            key = key * np.uint64(1099511628211) + chars[j : j + m]
        grams.append((mix(key[same] + np.uint64(k << 60)) >> np.uint64(49)).astype(np.uint16))
        owners.append(owner[:m][same])
    gram, own = np.concatenate(grams), np.concatenate(owners)
    by = np.argsort(own, kind="stable")
    return gram[by], own[by]


class Words:
    """Distinct words of some texts, hashed, with their character n-grams; and the texts as rows of word numbers."""

    def __init__(self, texts: list[bytes]):
        raw, starts, ends, h, self.counts = word_places([t if t.isascii() else t.decode().lower().encode() for t in texts], _WORD)
        _, first, self.ids = np.unique(h, return_index=True, return_inverse=True)
        self.n = len(first)
        self.hash = h[first]
        starts, lengths = starts[first], (ends - starts)[first]
        grams, owners = [np.zeros(0, np.uint16)], [np.zeros(0, np.int32)]
        for lo in range(0, self.n, _SOME):
            gram, own = _word_grams(raw, starts[lo : lo + _SOME], lengths[lo : lo + _SOME])
            grams.append(gram)
            owners.append(own + np.int32(lo))
        self.gram, self.gram_owner = np.concatenate(grams), np.concatenate(owners)
        self.gram_count = np.bincount(self.gram_owner, minlength=self.n)

        self.cuts = np.concatenate([[0], np.cumsum(self.gram_count)])

    def rows_of(self, vocab: np.ndarray) -> np.ndarray:
        """Each distinct word's place in a sorted vocabulary of hashes; its length if it has none."""
        if not len(vocab):
            return np.zeros(self.n, np.int64)
        i = np.minimum(np.searchsorted(vocab, self.hash), len(vocab) - 1)
        return np.where(vocab[i] == self.hash, i, len(vocab))

    def grams_of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of some words, and how many each has."""
        counts = self.gram_count[some]
        at = np.repeat(self.cuts[some], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.gram[at], counts

    def vectors(self, p: dict[str, np.ndarray], known: np.ndarray, some: np.ndarray, block: int = 50_000) -> np.ndarray:
        """A row for each of some words, and a last one of zeros for padding. known: `rows_of` of all words."""
        out = np.zeros((len(some) + 1, p["word"].shape[1]), np.float32)
        for lo in range(0, len(some), block):
            part = some[lo : lo + block]
            gram, counts = self.grams_of(part)
            own = counts > 0
            view = out[lo : lo + len(part)]
            if own.any():
                view[own] = np.add.reduceat(p["char"][gram], (np.cumsum(counts) - counts)[own], axis=0) / counts[own][:, None]
            view += p["word"][known[part]]
        return out

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of word numbers (padded with n) and the text of each row; texts without words have none."""
        step = window // 2
        starts = np.cumsum(self.counts) - self.counts
        count = np.where(self.counts > 0, np.maximum(1, -(-(self.counts - step) // step)), 0)
        owner = np.repeat(np.arange(len(self.counts)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at = (starts[owner] + nth * step)[:, None] + np.arange(window)
        inside = at < (starts + self.counts)[owner][:, None]
        return np.where(inside, self.ids[np.minimum(at, max(0, len(self.ids) - 1))] if len(self.ids) else 0, self.n), owner


@dataclass
class WordNetwork:
    """params["word"] has a last row of zeros, for words without a vector of their own."""

    vocab: np.ndarray
    params: dict[str, np.ndarray]

    def window_logits(self, rows: np.ndarray, x: dict[str, np.ndarray], pad: int, block: int = 2048) -> np.ndarray:
        p = self.params
        out = np.empty(len(rows), np.float32)
        for lo in range(0, len(rows), block):
            cols = np.ascontiguousarray(rows[lo : lo + block].T)
            steps, batch = cols.shape
            mask = cols != pad
            some = None if mask.all() else mask
            ahead = run_gru(lambda t, c=cols: x["f"].take(c[t], axis=1), range(steps), batch, some, p["w_f"])
            back = run_gru(lambda t, c=cols: x["b"].take(c[t], axis=1), reversed(range(steps)), batch, some, p["w_b"])
            h = np.concatenate([ahead, back], 1)
            att, att_v = np.ascontiguousarray(p["att"].T), p["att_v"]
            a = np.stack([att_v @ np.tanh(att @ h[t]) for t in range(steps)])
            a = np.where(mask, a, np.float32(-1e9))
            a = np.exp(a - a.max(0))
            a /= a.sum(0)
            out[lo : lo + block] = p["out"] @ np.einsum("tb,thb->hb", a, h) + p["bias"][0]
        return out

    def projected(self, words: Words) -> dict[str, np.ndarray]:
        v = words.vectors(self.params, words.rows_of(self.vocab), np.arange(words.n))
        return {k: np.ascontiguousarray((v @ self.params[f"in_{k}"] + self.params[f"b_{k}"]).T) for k in "fb"}

    def score(self, texts: list[bytes], window: int) -> np.ndarray:
        """The highest window's probability; 0 for texts without words."""
        words = Words(texts)
        rows, owner = words.windows(window)
        best = np.full(len(texts), -np.inf)
        if len(rows):
            np.maximum.at(best, owner, self.window_logits(rows, self.projected(words), words.n))
        return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best, -60, 60))), 0.0)


def _loss_gradients(p: dict[str, np.ndarray], words: Words, known: np.ndarray, rows: np.ndarray, want: np.ndarray, weight: np.ndarray, drop: np.ndarray) -> dict[str, np.ndarray]:
    used, cols = np.unique(rows.T, return_inverse=True)
    cols = cols.reshape(rows.T.shape)
    used = used[used < words.n]
    mask = (cols < len(used)).astype(np.float32)
    v = words.vectors(p, known, used)[cols]
    # word vectors are dropped at random, so that characters have to do too
    word = np.append(known[used], len(p["word"]) - 1)[cols]
    v = v - drop[:, :, None] * p["word"][word]
    hf, cf = gru_with_cache(v @ p["in_f"] + p["b_f"], mask, p["w_f"])
    hb, cb = gru_with_cache((v @ p["in_b"] + p["b_b"])[::-1], mask[::-1], p["w_b"])
    h = np.concatenate([hf, hb[::-1]], 2)
    u = np.tanh(h @ p["att"])
    s = np.where(mask > 0, u @ p["att_v"], -1e9)
    a = np.exp(s - s.max(0))
    a /= a.sum(0)
    c = np.einsum("tb,tbh->bh", a, h)
    d = (sigmoid(c @ p["out"] + p["bias"][0]) - want) * weight / len(rows)
    dc = d[:, None] * p["out"]
    da = np.einsum("tbh,bh->tb", h, dc)
    ds = a * (da - (a * da).sum(0))
    du = ds[:, :, None] * p["att_v"] * (1 - u * u)
    dh = a[:, :, None] * dc + du @ p["att"].T
    half = p["w_f"].shape[0]
    dxf, dwf = gru_gradients(np.ascontiguousarray(dh[:, :, :half]), cf, p["w_f"])
    dxb, dwb = gru_gradients(np.ascontiguousarray(dh[::-1, :, half:]), cb, p["w_b"])
    dxb = dxb[::-1]
    flat = lambda x: x.reshape(-1, x.shape[2])
    dv = dxf @ p["in_f"].T + dxb @ p["in_b"].T
    g = {
        "w_f": dwf, "w_b": dwb, "out": c.T @ d, "bias": np.array([d.sum()], np.float32), "att": flat(h).T @ flat(du), "att_v": np.einsum("tbk,tb->k", u, ds),
        "in_f": flat(v).T @ flat(dxf), "in_b": flat(v).T @ flat(dxb), "b_f": dxf.sum((0, 1)), "b_b": dxb.sum((0, 1)),
    }
    real = (mask > 0).ravel()
    where, dv, kept = cols.ravel()[real], flat(dv)[real], (1 - drop.ravel()[real])[:, None]
    per_word, per_kept = np.zeros((len(used), dv.shape[1]), np.float32), np.zeros((len(used), dv.shape[1]), np.float32)
    np.add.at(per_word, where, dv)
    np.add.at(per_kept, where, dv * kept)
    g["word"] = np.zeros_like(p["word"])
    np.add.at(g["word"], known[used], per_kept)
    g["word"][-1] = 0
    gram, counts = words.grams_of(used)
    g["char"] = np.zeros_like(p["char"])
    np.add.at(g["char"], gram, np.repeat(per_word / np.maximum(1, counts)[:, None], counts, 0))
    return g


def vocabulary(words: Words, size: int) -> np.ndarray:
    """Hashes, sorted, of the words that the most texts have: 3 texts at least, and one in 200."""
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    pairs = np.unique(words.ids.astype(np.int64) * max(1, len(words.counts)) + owner) // max(1, len(words.counts))
    texts = np.bincount(pairs, minlength=words.n)
    best = np.argsort(-texts, kind="stable")[:size]
    return np.sort(words.hash[best[texts[best] >= max(3, len(words.counts) // 200)]])


def train(texts: list[bytes], labels: np.ndarray, window: int, hidden: int, dim: int, steps: int, batch: int = 192, rate: float = 0.01, seed: int = 11, start: WordNetwork | None = None, refresh: int = 0) -> WordNetwork:
    """The network after `steps` batches; it goes on from `start`, and its vocabulary, if there is one. Every `refresh` steps all
    windows are scored, to choose among them."""
    rng = np.random.default_rng(seed)
    words = Words(texts)
    vocab = start.vocab if start else vocabulary(words, VOCAB)
    p = {k: v.copy() for k, v in start.params.items()} if start else {
        "word": rng.normal(0, 0.1, (len(vocab) + 1, dim)), "char": rng.normal(0, CHAR_INIT, (SLOTS, dim)),
        "in_f": rng.normal(0, 0.3, (dim, 3 * hidden)), "in_b": rng.normal(0, 0.3, (dim, 3 * hidden)), "b_f": np.zeros(3 * hidden), "b_b": np.zeros(3 * hidden),
        "w_f": recurrent_weights(rng, hidden), "w_b": recurrent_weights(rng, hidden),
        "att": rng.normal(0, 0.3, (2 * hidden, hidden)), "att_v": rng.normal(0, 0.3, hidden), "out": rng.normal(0, 0.3, 2 * hidden), "bias": np.array([-1.0]),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["word"][-1] = 0
    rate *= 0.6 if start else 1
    net, adam, known = WordNetwork(vocab, p), Adam(p, rate), words.rows_of(vocab)
    rows, owner = words.windows(window)
    bad, good = np.flatnonzero(labels[owner] == 1) if len(owner) else owner, np.flatnonzero(labels[owner] == 0) if len(owner) else owner
    if not len(bad) or not len(good):
        p["bias"][0] = 20.0 if len(bad) else -20.0
        p["out"][:] = 0
        return net
    bad_all, hard = bad, good
    refresh = refresh or max(1, steps // 12)
    for step in range(steps):
        adam.rate = rate * (1 - 0.9 * step / steps)
        if step % refresh == 0 and (step or start):
            logit = net.window_logits(rows, net.projected(words), words.n)
            hard = good[np.argsort(-logit[good], kind="stable")[: max(batch, len(good) // 20)]]
            if step >= 2 * refresh or start:
                # each toxic document's highest window, and others that are high by themselves
                top = np.full(len(texts), -np.inf, np.float32)
                np.maximum.at(top, owner, logit)
                bad = bad_all[(logit[bad_all] >= top[owner[bad_all]]) | (logit[bad_all] > 1.0)]
        n = batch // 4
        pick = np.concatenate([rng.choice(bad, n), rng.choice(good, n), rng.choice(hard, 2 * n)])
        want = labels[owner[pick]].astype(np.float32)
        weight = np.where(want > 0, 2.0, 1.0).astype(np.float32)
        x = rows[pick]
        drop = (rng.random(x.T.shape) < 0.4).astype(np.float32)
        adam.step(_loss_gradients(p, words, known, x, want, weight, drop))
    top = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(top, owner, net.window_logits(rows, net.projected(words), words.n))
    p["bias"][0] -= cutoff(top[np.isfinite(top)], labels[np.isfinite(top)])
    return net


def cutoff(logits: np.ndarray, labels: np.ndarray) -> float:
    """Where the fewest training documents are on the wrong side: the middle of the widest such gap."""
    by = np.argsort(logits)
    v, y = logits[by].astype(np.float64), labels[by]
    wrong = np.concatenate([[0], np.cumsum(y == 1)]) + (y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)])
    gap = np.concatenate([[1e-6], np.diff(v), [1e-6]])
    k = max(np.flatnonzero(wrong == wrong.min()).tolist(), key=lambda i: gap[i])
    return float(v[0] - 1 if k == 0 else v[-1] + 1 if k == len(v) else (v[k - 1] + v[k]) / 2)


def picked_labels(labels: DataFrame, sample_docs: int) -> dict[int, tuple[int, float]]:
    """doc_id -> (toxic, hash from 0 to 1) of at most sample_docs documents of each label, those of the least hashes."""
    own = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and id is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    own = own.withColumn("u", F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40))
    kinds = [own.where(F.col("toxic") == 1), own.where(F.col("toxic") != 1)]
    # at most 2 * sample_docs rows reach the driver and go back to the tasks, so texts need not move to meet their labels
    return {r.id: (r.toxic, r.u) for kind in kinds for r in kind.orderBy("u", "id").limit(sample_docs).collect()}


def highest_stretch(net: WordNetwork, words: list[bytes], size: int, window: int, some: int = 50) -> bytes:
    """Of the stretches of `size` words, starts size / 2 apart, the one with the highest window; `some` are scored at a time."""
    best, found = -1.0, b""
    starts = range(0, max(1, len(words) - size + size // 2), size // 2)
    for i in range(0, len(starts), some):
        parts = [b" ".join(words[at : at + size]) for at in starts[i : i + some]]
        scores = net.score(parts, window)
        if scores.max() > best:
            best, found = float(scores.max()), parts[int(scores.argmax())]
    return found


def training_texts(docs: DataFrame, picked: dict[int, tuple[int, float]], sample_words: int, window: int, net: WordNetwork | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts of at most sample_words words, their labels, and which ones are parts of longer toxic texts. Of rows that repeat
    a doc_id the one with the least such text counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            own = [i for i, k in enumerate(b.column(0).to_pylist()) if k in picked]
            few = b.take(pa.array(own, pa.int64()))
            for i, t in zip(few.column(0).to_pylist(), text_bytes(few), strict=True):
                (toxic, v), words = picked[i], t.split()
                part = toxic == 1 and len(words) > sample_words
                if part and net is not None:
                    out.append((i, highest_stretch(net, words, sample_words, window), toxic, part))
                else:
                    at = int((v * 2**20) % 1 * max(0, len(words) - sample_words))
                    out.append((i, b" ".join(words[at : at + sample_words]), toxic, part))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.bool_()), strict=True)], ["doc_id", "text", "toxic", "part"])

    rows = docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, text binary, toxic int, part boolean")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "toxic", "part")).alias("r")).select("doc_id", "r.*").toArrow().to_pydict()
    order = sorted(zip(rows["doc_id"], rows["text"], rows["toxic"], rows["part"], strict=True))
    return [r[1] for r in order], np.array([int(r[2] == 1) for r in order], np.int64), np.array([r[3] for r in order], bool)


def learned(docs: DataFrame, labels: DataFrame, window: int, hidden: int, dim: int, steps: int, sample_docs: int, sample_words: int, held_mod: int, held_rest: int) -> WordNetwork:
    picked = picked_labels(labels.where(~heldout(F.col("doc_id"), held_mod, held_rest)), sample_docs)
    texts, known, part = training_texts(docs, picked, sample_words, window)
    if not part.any():
        return train(texts, known, window, hidden, dim, steps)
    # if all toxic ones are long, their parts by hash are the first network's only examples
    own = ~part if (known[~part] == 1).any() else np.ones(len(part), bool)
    first = train([t for t, k in zip(texts, own.tolist(), strict=True) if k], known[own], window, hidden, dim, max(1, steps * 2 // 5))
    del texts, known
    give_back()
    texts, known, _ = training_texts(docs, picked, sample_words, window, first)
    return train(texts, known, window, hidden, dim, max(1, steps - steps * 2 // 5), start=first)


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    window: int = 32,
    hidden: int = 8,
    dim: int = 16,
    steps: int = 500,
    sample_docs: int = 2500,
    sample_words: int = 600,
    held_mod: int = 5,
    held_rest: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of `docs`, all columns, that score below 0.5. It learns and scores as `toxicity`; rows don't move.

    Null texts and texts without words score 0 and stay. Null doc_ids and rows that repeat go or stay by their own text.
    Further columns are carried along whatever their names; an empty table stays empty."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(learned(rows, labels, window, hidden, dim, steps, sample_docs, sample_words, held_mod, held_rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for whole in batches:
            for b in pieces_of(whole, PIECE, text_col):
                yield b.filter(pa.array(net.score(text_bytes(b, text_col), window) < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    window: int = 32,
    hidden: int = 8,
    dim: int = 16,
    steps: int = 500,
    sample_docs: int = 2500,
    sample_words: int = 600,
    held_mod: int = 5,
    held_rest: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null texts and texts without words have score 0. A null doc_id counts as the empty text for the fold, and has no
    label. Of several labels of a doc_id the highest counts; null labels don't. Without labels of both kinds every score
    is near the only label (0 without any). Rows that repeat are scored as any other row. Other columns of the inputs
    play no part. An empty table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(learned(rows, labels, window, hidden, dim, steps, sample_docs, sample_words, held_mod, held_rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for whole in batches:
            for b in pieces_of(whole, PIECE):
                yield pa.record_batch([b.column(0), pa.array(net.score(text_bytes(b), window))], ["doc_id", "score"])

    out = rows.mapInArrow(tidy(run), "doc_id long, score double")
    return out.select("doc_id", heldout(F.col("doc_id"), held_mod, held_rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Language ID with a bidirectional gated recurrent network over bytes.

Texts are cut into windows of `window` bytes, all of them, and the network gives each byte a distribution over languages
from what stands before and after it in its window; a document's probabilities are the mean over its bytes. The network
is trained in numpy by backpropagation through time on windows of a bounded sample of labelled documents: about
`sample_docs` of each language, chosen by a hash of doc_id, and at most `doc_windows` windows of each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artifactlink.llm.bigru import Adam, gru_gradients, gru_with_cache, recurrent_weights, run_gru
from artifactlink.llm.common import heldout, pieces_of, small_batches, text_bytes, tidy

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode()))


def windows_of(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (rows of bytes, padded), their lengths, and the text of each."""
    count = [-(-len(t) // window) for t in texts]
    raw = b"".join(t.ljust(n * window, b"\0") for t, n in zip(texts, count, strict=True))
    data = np.frombuffer(raw, np.uint8).reshape(-1, window)
    owner = np.repeat(np.arange(len(texts)), count)
    lengths = np.full(len(data), window)
    last = np.cumsum(count) - 1
    some = np.array([n > 0 for n in count], bool)
    lengths[last[some]] = np.array([len(t) - (n - 1) * window for t, n in zip(texts, count, strict=True)], np.int64)[some]
    return data, lengths, owner


@dataclass
class ByteNetwork:
    langs: list[str]
    params: dict[str, np.ndarray]

    def position_sums(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each window the sum of its bytes' language distributions."""
        p, steps = self.params, data.shape[1]
        mask = None if (lengths == steps).all() else np.arange(steps)[:, None] < lengths
        cols = np.ascontiguousarray(data.T)
        table_f, table_b = np.ascontiguousarray(p["in_f"].T), np.ascontiguousarray(p["in_b"].T)
        ahead = run_gru(lambda t: table_f.take(cols[t], axis=1), range(steps), len(data), mask, p["w_f"])
        back = run_gru(lambda t: table_b.take(cols[t], axis=1), reversed(range(steps)), len(data), mask, p["w_b"])
        out_f, out_b, bias = np.ascontiguousarray(p["out_f"].T), np.ascontiguousarray(p["out_b"].T), p["bias"][:, None]
        total = np.zeros((len(self.langs), len(data)), np.float32)
        for t in range(steps):
            s = out_f @ ahead[t]
            s += out_b @ back[t]
            s += bias
            s -= s.max(0)
            np.exp(s, out=s)
            s /= s.sum(0)
            if mask is not None:
                s *= mask[t]
            total += s
        return total.T

    def probabilities(self, texts: list[bytes], window: int, block: int = 2048) -> np.ndarray:
        data, lengths, owner = windows_of(texts, window)
        sums = np.zeros((len(texts), len(self.langs)))
        # full windows first: they need no mask
        order = np.argsort(lengths != window, kind="stable")
        full = int((lengths == window).sum())
        for lo, hi in [*((i, min(i + block, full)) for i in range(0, full, block)), *((i, min(i + block, len(order))) for i in range(full, len(order), block))]:
            at = order[lo:hi]
            np.add.at(sums, owner[at], self.position_sums(data[at], lengths[at]))
        return sums / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def train(langs: list[str], data: np.ndarray, lengths: np.ndarray, labels: np.ndarray, hidden: int, steps: int = 260, batch: int = 256, rate: float = 0.01, seed: int = 5) -> ByteNetwork:
    rng = np.random.default_rng(seed)
    n = len(langs)
    p = {
        "in_f": rng.normal(0, 0.3, (256, 3 * hidden)), "in_b": rng.normal(0, 0.3, (256, 3 * hidden)),
        "w_f": recurrent_weights(rng, hidden), "w_b": recurrent_weights(rng, hidden),
        "out_f": rng.normal(0, 0.3, (hidden, n)), "out_b": rng.normal(0, 0.3, (hidden, n)), "bias": np.zeros(n),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    adam = Adam(p, rate)
    by_label = [np.flatnonzero(labels == k) for k in range(n)]
    by_label = [x for x in by_label if len(x)]
    for step in range(steps if by_label else 0):
        adam.rate = rate * (1 - 0.9 * step / steps)
        kinds = rng.integers(0, len(by_label), batch)
        pick = np.array([rng.choice(by_label[k]) for k in kinds])
        x, want, size = data[pick].T, labels[pick], lengths[pick]
        mask = (np.arange(x.shape[0])[:, None] < size).astype(np.float32)
        hf, cf = gru_with_cache(p["in_f"][x], mask, p["w_f"])
        hb, cb = gru_with_cache(p["in_b"][x[::-1]], mask[::-1], p["w_b"])
        hb = hb[::-1]
        s = hf @ p["out_f"] + hb @ p["out_b"] + p["bias"]
        s = np.exp(s - s.max(2, keepdims=True))
        s /= s.sum(2, keepdims=True)
        s[:, np.arange(batch), want] -= 1
        s *= mask[:, :, None] / mask.sum()
        dxf, dwf = gru_gradients(s @ p["out_f"].T, cf, p["w_f"])
        dxb, dwb = gru_gradients((s @ p["out_b"].T)[::-1], cb, p["w_b"])
        grads = {"w_f": dwf, "w_b": dwb, "out_f": np.einsum("tbh,tbn->hn", hf, s), "out_b": np.einsum("tbh,tbn->hn", hb, s), "bias": s.sum((0, 1))}
        for k, d, at in (("in_f", dxf, x), ("in_b", dxb, x[::-1])):
            one = np.zeros((256, at.size), np.float32)
            one[at.ravel(), np.arange(at.size)] = 1
            grads[k] = one @ d.reshape(at.size, -1)
        adam.step(grads)
    return ByteNetwork(langs, p)


def training_windows(docs: DataFrame, sample_docs: int, doc_windows: int, window: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages (all of them), and the sample's windows, lengths and labels. A row's hash is that of its id and text, and
    equal windows of equal rows count once, so that neither null nor repeated ids make the sample larger."""
    counts = docs.groupBy("lang").count().collect()
    langs = sorted(r.lang for r in counts)
    rate = {r.lang: min(1.0, sample_docs / r["count"]) for r in counts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = b.column(2).to_pylist()
            langs, wins, keys = [], [], []
            for text, lang, v in zip(text_bytes(b), b.column(1).to_pylist(), u, strict=True):
                if not text or v >= rate.get(lang, 0.0):
                    continue
                rng = np.random.default_rng(int(v * 2**52))
                n = -(-len(text) // window)
                for k in sorted(rng.permutation(n)[:doc_windows].tolist()):
                    langs.append(lang)
                    wins.append(text[k * window : (k + 1) * window])
                    keys.append(v)
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(wins, pa.binary()), pa.array(keys, pa.float64())], ["lang", "bytes", "u"])

    u = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)).alias("u")
    got = docs.select("text", "lang", u).mapInArrow(tidy(run), "lang string, bytes binary, u double").distinct().toArrow().to_pydict()
    rows = sorted(zip(got["u"], got["lang"], got["bytes"], strict=True))
    at = {v: i for i, v in enumerate(langs)}
    raw = b"".join(r[2].ljust(window, b"\0") for r in rows)
    return langs, np.frombuffer(raw, np.uint8).reshape(-1, window), np.array([len(r[2]) for r in rows]), np.array([at[r[1]] for r in rows], np.int64)


def language_id(
    docs: DataFrame,
    hidden: int = 12,
    window: int = 64,
    sample_docs: int = 1500,
    doc_windows: int = 4,
    steps: int = 260,
    held_mod: int = 4,
    held_rest: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (the mean probability of lang_pred over the bytes).

    Null texts and texts without a letter are `und` with score 0, and so is all if nothing could be learned. A null
    doc_id counts as the empty text for the fold. Rows that repeat are labelled as any other row. Other columns of the
    input play no part. An empty table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    small_batches(docs)
    labelled = rows.where(~heldout(F.col("doc_id"), held_mod, held_rest) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs, data, lengths, labels = training_windows(labelled, sample_docs, doc_windows, window)
    shared = docs.sparkSession.sparkContext.broadcast(train(langs, data, lengths, labels, hidden, steps=steps) if len(labels) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for b in pieces_of(whole, 2_000_000):
                texts = text_bytes(b)
                pred, score = ["und"] * len(texts), [0.0] * len(texts)
                if model is not None:
                    p = model.probabilities(texts, window)
                    best = p.argmax(1)
                    for i, t in enumerate(texts):
                        if has_letter(t):
                            pred[i], score[i] = model.langs[best[i]], min(1.0, float(p[i, best[i]]))
                yield pa.record_batch([b.column(0), pa.array(pred), pa.array(score)], ["doc_id", "lang_pred", "score"])

    out = rows.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", heldout(F.col("doc_id"), held_mod, held_rest).alias("held_out"), "lang_pred", "score")

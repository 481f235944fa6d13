"""Quality rules with n-gram perplexity.

The model is a modified Kneser-Ney n-gram model over the characters of whole texts (lower case, white space as one
space, digits as 0), one for each language. It learns from every document that is prose by rule (`is_prose`: few symbols
and few repeated lines), so that junk is measured against prose and not against other junk. Spark counts the n-grams of
all these documents, continuation counts, discounts and back-off weights; the driver gets, for each order, arrays of all
n-grams sorted by hash, and tasks look n-grams up in them by the leading bits. An n-gram is known by its hash only, of
60 bits: of ten million n-grams, two share one with a probability of about 1 in 20,000. The arrays follow the corpus's
distinct character n-grams, which grow much slower than its text.

A document's log perplexity is held against its language's band, centre -/+ width * sqrt(spread**2 + v / characters):
centre and spread are the median and the scaled quartile range of all documents of that language that pass the base
rules, v the mean variance of a character's log probability, so that a short text isn't rejected for being short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artifactlink.llm.common import materialize, pieces_of, small_batches, text_bytes, tidy
from artifactlink.llm.shingles import word_places

_P = 0x9E3779B97F4A7C15
_WS = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
#: Digits become 0; the two marks that the model uses become white space.
_PLAIN = bytes(48 if 48 <= b <= 57 else 32 if b < 2 else b for b in range(256))


def normalize(text: bytes) -> str:
    return " ".join(text.translate(_PLAIN).decode().lower().split())


def distinct(x: np.ndarray, places: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """A place of each distinct value, where each element is among them (if asked for), and their counts."""
    by = np.argsort(x)
    y = x[by]
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(y[1:], y[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    where = None
    if places:
        where = np.empty(len(x), np.int32)
        where[by] = np.cumsum(new, dtype=np.int32) - 1
    return by[starts], where, np.diff(np.append(starts, len(x)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def is_prose(text: bytes) -> bool:
    """At most one symbol in ten words and one repeated line in five."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return 10 * (len(text) - len(text.translate(None, _SYMBOLS))) <= len(text.split()) and 5 * (len(lines) - len(set(lines))) <= len(lines)


class Grams:
    """The n-grams of some texts: distinct ones with slots of every order, and where each position's is among them."""

    def __init__(self, texts: list[bytes], langs: list[str], order: int, bits: int, places: bool = True):
        pad = "\x00" * (order - 1)
        parts = [f"{pad}{normalize(t)}\x01" for t in texts]
        #: Characters plus one; the marks in front of a text are 1.
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4").astype(np.uint64)
        codes += np.uint64(1)
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        #: Characters that are scored: the text's and its end. `where` has order - 1 places in front of each text that count for nothing.
        self.lengths = sizes - (order - 1)
        self.starts = starts + order - 1
        seeds = np.array([zlib.crc32(x.encode()) for x in langs], np.uint64) * np.uint64(_P | 1)
        top, part = np.repeat(seeds, sizes), np.empty_like(codes)
        for k in range(order):
            n = len(codes) - k
            np.multiply(codes[:n], np.uint64(pow(_P, k + 1, 1 << 64)), out=part[:n])
            top[k:] += part[:n]
        pads = (starts[:, None] + np.arange(order - 1)).ravel()
        top[pads] = 0
        first, self.where, self.counts = distinct(top, places)
        if len(pads):  # the least value: the marks' own group
            self.counts[0] = 0
            first[0] = pads[-1] + 1 if not top[first[0]] else first[0]
        at = first
        seed = seeds[np.searchsorted(ends, at, side="right")]
        self.order, self.bits = order, bits
        #: slots[k]: of the k-gram that ends at the position; before[k]: of the (k-1)-gram in front of it.
        self.slots = {k: self._slot(codes, at, k, seed) for k in range(1, order + 1)}
        self.before = {k: self._slot(codes, at - 1, k - 1, seed) for k in range(2, order + 1)}
        self.before[1] = seed & np.uint64((1 << bits) - 1)  # one context for each language

    def _slot(self, codes: np.ndarray, at: np.ndarray, k: int, seed: np.ndarray) -> np.ndarray:
        h = seed + np.uint64(k * 7919)
        for j in range(k):
            h = h + codes[at - j] * np.uint64(pow(_P, j + 1, 1 << 64))
        return _mix(h) >> np.uint64(64 - self.bits)


def _keyed(g: Grams, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key (order, slot), slot of the n-gram without its first character, and slot of its context."""
    suffix = g.slots[k - 1] if k > 1 else np.zeros_like(g.slots[1])
    return (np.uint64(k << g.bits) | g.slots[k]).astype(np.int64), suffix.astype(np.int64), g.before[k].astype(np.int64)


def count_ngrams(docs: DataFrame, order: int, bits: int) -> DataFrame:
    """(key, suffix, ctx, c): texts' n-grams of every order; c counts the highest order only. Tasks combine before the shuffle."""

    def combine(parts: list[tuple]) -> tuple:
        key, suffix, ctx, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.argsort(key)
        key, suffix, ctx, c = key[by], suffix[by], ctx[by], c[by]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        # of n-grams that share a hash the largest values count, in whatever order they come
        return key[starts], np.maximum.reduceat(suffix, starts), np.maximum.reduceat(ctx, starts), np.add.reduceat(c, starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for whole in batches:
            for b in pieces_of(whole, 1_000_000):
                own = [(t, x or "und") for t, x in zip(text_bytes(b), b.column(1).to_pylist(), strict=True) if is_prose(t)]
                if not own:
                    continue
                g = Grams(*map(list, zip(*own, strict=True)), order, bits, places=False)
                for k in range(1, order + 1):
                    key, suffix, ctx = _keyed(g, k)
                    real = slice(1, None) if order > 1 else slice(None)  # the first is the marks'
                    parts.append(combine([(key[real], suffix[real], ctx[real], g.counts[real] if k == order else np.zeros(len(key[real]), np.int64))]))
                if sum(len(p[0]) for p in parts) > 3_000_000:
                    parts = [combine(parts)]
                    if len(parts[0][0]) > 2_000_000:
                        yield pa.record_batch([pa.array(x) for x in parts[0]], ["key", "suffix", "ctx", "c"])
                        parts = []
        if parts:
            yield pa.record_batch([pa.array(x) for x in combine(parts)], ["key", "suffix", "ctx", "c"])

    assert bits + order.bit_length() < 64  # a key holds both
    counted = docs.select("text", "lang").mapInArrow(tidy(run), "key long, suffix long, ctx long, c long")
    return counted.groupBy("key").agg(F.max("suffix").alias("suffix"), F.max("ctx").alias("ctx"), F.sum("c").alias("c"))


class Model:
    """For each order: sorted n-gram slots with discounted probabilities, sorted context slots with back-off weights."""

    def __init__(self, grams: dict[int, tuple[np.ndarray, np.ndarray]], contexts: dict[int, tuple[np.ndarray, np.ndarray]], alphabet: int, bits: int):
        self.alphabet = alphabet
        self.grams, self.contexts = ({k: self._indexed(*t, bits) for k, t in x.items()} for x in (grams, contexts))

    @staticmethod
    def _indexed(known: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Where the slots of each value of their leading bits start: about one slot to a value, as slots are even."""
        shift = max(0, bits - max(1, len(known)).bit_length())
        ends = np.bincount(known >> shift, minlength=1 << (bits - shift)) if len(known) else np.zeros(1 << (bits - shift), np.int64)
        return known, values, np.concatenate([[0], np.cumsum(ends)]).astype(np.int32), shift

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray, np.ndarray, int], keys: np.ndarray, missing: float) -> np.ndarray:
        known, values, starts, shift = table
        out = np.full(len(keys), missing)
        if not len(known):
            return out
        lead = keys >> shift
        at, end = starts[lead], starts[lead + 1]
        todo = np.flatnonzero(at < end)
        at, end, keys = at[todo], end[todo], keys[todo]
        while len(todo):
            hit = known[at] == keys
            out[todo[hit]] = values[at[hit]]
            at = at + 1
            more = np.flatnonzero(~hit & (at < end))
            todo, at, end, keys = todo[more], at[more], end[more], keys[more]
        return out

    def log10(self, g: Grams) -> np.ndarray:
        """log10 probability of each distinct n-gram's last character after the others."""
        p = np.full(len(g.slots[1]), 1.0 / (self.alphabet + 1))
        for k in range(1, g.order + 1):
            p = self._find(self.grams[k], g.slots[k].astype(np.int64), 0.0) + self._find(self.contexts[k], g.before[k].astype(np.int64), 1.0) * p
        return np.log10(p)


def train(docs: DataFrame, order: int, bits: int) -> Model:
    counted = materialize(count_ngrams(docs, order, bits), "ngrams")
    mask = (1 << bits) - 1
    t = counted.select(
        F.shiftright("key", bits).alias("k"), F.col("key").bitwiseAND(mask).alias("slot"), "ctx", "suffix", "c",
    )
    left = t.where("k > 1").groupBy((F.col("k") - 1).alias("k"), F.col("suffix").alias("slot")).agg(F.count(F.lit(1)).alias("left"))
    t = materialize(t.join(left, ["k", "slot"], "left").select("k", "slot", "ctx", F.when(F.col("k") == order, F.col("c")).otherwise(F.coalesce("left", F.lit(1))).alias("c")), "ngram-counts")
    ones = {r.k: r for r in t.groupBy("k").agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()}
    discount = F.lit(0.0)
    for k, r in ones.items():
        y = r.n1 / (r.n1 + 2 * r.n2) if r.n1 else 0.5
        d = [min(max(i - (i + 1) * y * r[f"n{i + 1}"] / r[f"n{i}"], 0.05 * i), 0.95 * i) if r[f"n{i}"] else 0.5 * i for i in (1, 2, 3)]
        at = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        discount = F.when(F.col("k") == k, at).otherwise(discount)
    t = t.withColumn("d", discount)
    per = t.groupBy("k", "ctx").agg(F.sum("c").alias("all"), F.sum("d").alias("d_all"))
    alpha = t.join(per, ["k", "ctx"]).select("k", "slot", ((F.col("c") - F.col("d")) / F.col("all")).cast("float").alias("v"))
    weight = per.select("k", F.col("ctx").alias("slot"), (F.col("d_all") / F.col("all")).cast("float").alias("v"))

    def arrays(df: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        x = df.toArrow()
        k, slot, v = (x.column(i).to_numpy() for i in range(3))
        out = {}
        for i in range(1, order + 1):
            own = np.flatnonzero(k == i)
            own = own[np.argsort(slot[own], kind="stable")]
            out[i] = (slot[own].astype(np.int64), v[own].astype(np.float32))
        return out

    grams = arrays(alpha)
    return Model(grams, arrays(weight), len(grams[1][0]), bits)


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words that stand in a window of n words found twice or more."""
    seen: dict[tuple, int] = {}
    windows = list(zip(*[words[i:] for i in range(n)], strict=False))
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + n - max(i, upto)
            upto = i + n
    return total


def may_repeat(h: np.ndarray, counts: np.ndarray, n: int = 5) -> np.ndarray:
    """Whether two windows of n words of a text have the same hash; if not, none repeats. h: hashes of all texts' words."""
    total = len(h)
    out = np.zeros(len(counts), bool)
    if total < n:
        return out
    key = np.zeros(total - n + 1, np.uint64)
    for i in range(n):
        key += h[i : total - n + 1 + i] * np.uint64(pow(_P, i + 1, 1 << 64))
    doc = np.repeat(np.arange(len(counts)), counts)
    own = doc[: total - n + 1]
    key = _mix(key + own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[own == doc[n - 1 :]]
    own = own[own == doc[n - 1 :]]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if len(twice):
        out[own[np.isin(key, twice)]] = True
    return out


_AS_IS = bytes(range(256))


def base_rules(texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    _, _, _, h, counts = word_places(texts, _AS_IS)
    repeat = may_repeat(h, counts)
    out = []
    for t, n, again in zip(texts, counts.tolist(), repeat.tolist(), strict=True):
        lines = [x for x in t.split(b"\n") if x.strip()]
        blank = len(t) - len(t.translate(None, _WS))
        out.append((n, len(t.decode()) - blank, len(t) - len(t.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(t.split()) if again else 0))
    return out


def score_documents(docs: DataFrame, model: Model, order: int, bits: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "log_p", "log_p2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in pieces_of(whole, 1_000_000):
                texts, langs = text_bytes(b), [x or "und" for x in b.column(2).to_pylist()]
                g = Grams(texts, langs, order, bits)
                lp = m.log10(g)[g.where]
                # sums over each text, without the marks in front of the next one
                at = np.stack([g.starts, g.starts + g.lengths], 1).ravel()[:-1]
                base = list(zip(*base_rules(texts), strict=True))
                cols = [b.column(0), pa.array(langs), *[pa.array(c, pa.int64()) for c in base], pa.array(g.lengths), pa.array(np.add.reduceat(lp, at)[::2]), pa.array(np.add.reduceat(lp * lp, at)[::2])]
                yield pa.record_batch(cols, names)

    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars long, log_p double, log_p2 double"
    return docs.select("doc_id", "text", "lang").mapInArrow(tidy(run), schema)


def quality_rules(
    docs: DataFrame,
    order: int = 5,
    hash_bits: int = 60,
    width: float = 6.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    lang, perplexity, lower, upper.

    A null or empty text has no words and fails the base rules. Null lang is `und`. A language none of whose documents
    passes the base rules has no band, and rejects none. Null doc_ids and rows that repeat are judged as any other row.
    Other columns of the input play no part. An empty table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    small_batches(docs)
    model = train(rows, order, hash_bits)
    scored = score_documents(rows, model, order, hash_bits).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    scored = materialize(scored.withColumn("x", -F.col("log_p") / F.col("chars")), "perplexity")
    quartile = F.percentile_approx("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000))
    bands = scored.where(~F.col("base_failed")).groupBy("lang").agg(quartile.alias("q"), F.avg(F.col("log_p2") / F.col("chars") - F.col("x") * F.col("x")).alias("v"))
    bands = materialize(bands.select(F.col("lang").alias("band_lang"), F.col("q")[1].alias("centre"), ((F.col("q")[2] - F.col("q")[0]) / 1.349).alias("spread"), "v"), "bands")
    half = width * F.sqrt(F.col("spread") * F.col("spread") + F.col("v") / F.col("chars"))
    out = scored.join(bands, F.col("lang") == F.col("band_lang"), "left").withColumn("half", half)
    inside = F.coalesce(F.abs(F.col("x") - F.col("centre")) <= F.col("half"), F.lit(True))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"),
        "lang", F.pow(F.lit(10.0), "x").alias("perplexity"), F.pow(F.lit(10.0), F.col("centre") - F.col("half")).alias("lower"), F.pow(F.lit(10.0), F.col("centre") + F.col("half")).alias("upper"),
    )

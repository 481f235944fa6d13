"""Best-two-fit packing of token sequences.

Documents are tokenised once, next to the scan; only lengths and checksums of their pieces move on. Pieces are dealt by
a hash to groups of about `group_rows` (one group for small inputs), each packed on its own, so that a group's memory
is bounded and all groups together waste at most a few sequences each.

In a group a bin is filled greedily: the longest unpacked piece, then again and again the longest that still fits. Then
its smallest piece s is replaced by two unpacked pieces a, b when a + b fits the gap + s more tightly than s did.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artifactlink.llm.common import materialize, project, row_base, small_batches, text_bytes, tidy
from artifactlink.llm.token_counts import load_tokenizer

#: Distinct pre-tokens, and stems, whose ids a worker process keeps: about 200 MB of memory.
CACHE = 600_000
_PUNCTUATION = frozenset(b".,;:!?")


class CachedEncoder:
    """Ids of texts as little-endian uint32 bytes; each pre-token (run without ASCII white space) is tokenised once.

    The stems (letters in lower case) serve every case of a word and every mark after it. Stems are one piece of the tokenizer's own splitting, and their last id, alone, ends a word: many of
    them are tokenised in one call and told apart by these ids. If the count differs they are tokenised one by one.
    """

    def __init__(self, path: str, size: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tok, self.size = load_tokenizer(path), size
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        marks = [bytes([m]) for m in _PUNCTUATION]
        self.marks = {b"": b""} | dict(zip(marks, self._each(marks), strict=True))

    def _each(self, words: list[bytes]) -> Iterator[bytes]:
        for i in range(0, len(words), 2000):
            for e in self.tok.encode_batch_fast([w.decode() for w in words[i : i + 2000]], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def _letters(self, words: list[bytes]) -> Iterator[bytes]:
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            ids = np.array(self.tok.encode(b" ".join(some).decode(), add_special_tokens=False).ids, "<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) != len(some) or cuts[-1] != 4 * len(ids):
                yield from self._each(some)
                continue
            raw = ids.tobytes()
            yield from map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts))

    @staticmethod
    def _stem(word: bytes) -> tuple[bytes, bytes] | None:
        """The word's letters in lower case and the one mark after them, if this is all it has.

        Letters below U+0130 have one-letter lower cases and no composition, as the tokenizer's normaliser has them."""
        mark = b""
        if word[-1] in _PUNCTUATION:
            word, mark = word[:-1], word[-1:]
        if word.isalpha():
            return word.lower(), mark
        text = word.decode()
        if text.isalpha() and max(text) < "\u0130":
            return text.lower().encode(), mark
        return None

    def learn(self, texts: list[list[bytes]]) -> None:
        if len(self.known) > self.size:
            self.known = {}
        if len(self.stems) > self.size:
            self.stems = {}
        known, stems = self.known, self.stems
        new = list(set().union(*texts).difference(known))
        parts = [self._stem(w) for w in new]
        need = {p[0] for p in parts if p}.difference(stems)
        if need:
            need = list(need)
            stems.update(zip(need, self._letters(need), strict=True))
        rest = [w for w, p in zip(new, parts, strict=True) if p is None]
        known.update(zip(rest, self._each(rest), strict=True))
        known.update([(w, stems[p[0]] + self.marks[p[1]]) for w, p in zip(new, parts, strict=True) if p])

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        words = [t.split() for t in texts]
        self.learn(words)
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]


@lru_cache(maxsize=1)
def cached_encoder(path: str, size: int = CACHE) -> CachedEncoder:
    """One for all tasks that a worker process runs; what it keeps is bounded by `size`."""
    return CachedEncoder(path, size)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, limit: int, end_id: int, cache: int = CACHE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, rid): only documents longer than `limit` are cut, all pieces full but the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rid, end = cached_encoder(tokenizer_path, cache), row_base(), np.array([end_id], "<u4").tobytes()
        step = 4 * limit
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = text_bytes(b)
            rows: list[tuple] = []
            for lo in range(0, len(texts), 500):
                for j, raw in enumerate(encode(texts[lo : lo + 500]), lo):
                    raw += end
                    for p, at in enumerate(range(0, len(raw), step)):
                        part = raw[at : at + step]
                        rows.append((ids[j], p, at // 4, len(part) // 4, zlib.crc32(part), rid + j))
            rid += len(texts)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "rid"])

    return docs.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, rid long")


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length (1..capacity), and the number of bins."""
    order = np.argsort(-lengths, kind="stable")
    by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in order[::-1].tolist():
        by_size[int(lengths[i])].append(i)
    have = np.array([len(x) for x in by_size], np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    below = np.zeros(capacity + 1, np.int64)  # the largest size with pieces that is at most x; 0: none

    def refresh(lo: int = 0) -> None:
        at = np.where(have > 0, np.arange(capacity + 1), 0)
        np.maximum.accumulate(at, out=below)

    def take(size: int) -> int:
        have[size] -= 1
        if not have[size]:
            # sizes from here up to the next one that has pieces fall back to the next smaller
            top = size + 1
            nxt = np.flatnonzero(have[top:] > 0)
            top = top + int(nxt[0]) if len(nxt) else capacity + 1
            below[size:top] = below[size - 1] if size else 0
        return by_size[size].pop()

    have[0] = 0
    refresh()
    n = 0
    sizes = np.arange(capacity + 1)
    while below[capacity]:
        inside: list[int] = []
        gap = capacity
        while gap and (s := int(below[gap])):
            inside.append(take(s))
            gap -= s
        if gap and below[gap + int(lengths[inside[-1]])]:
            small = int(lengths[inside[-1]])
            room = gap + small
            # two pieces a >= b with a + b as large as fits in the room
            a = sizes[1 : min(room, capacity + 1)]
            a = a[have[a] > 0]
            b = below[room - a]
            b = np.where((b == a) & (have[b] < 2), below[np.maximum(b - 1, 0)], b)
            ok = b > 0
            if ok.any():
                sums = np.where(ok, a + b, 0)
                k = int(np.argmax(sums))
                if sums[k] > small:
                    back = inside.pop()
                    one, two = take(int(a[k])), take(int(b[k]))
                    inside += [one, two]
                    # the piece that goes back is unpacked again
                    by_size[small].append(back)
                    have[small] += 1
                    if have[small] == 1:
                        nxt = np.flatnonzero(have[small + 1 :] > 0)
                        top = small + 1 + int(nxt[0]) if len(nxt) else capacity + 1
                        below[small:top] = small
        at = 0
        for i in inside:
            bins[i], offsets[i] = n, at
            at += int(lengths[i])
        n += 1
    return bins, offsets, n


def pack_best_two_fit(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    group_rows: int = 50_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    cache: int = CACHE,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    `cache` is how many pre-tokens, and stems, each worker process keeps the ids of: memory against time.

    Every document ends with `end_id`, so a null or empty text is one piece of length 1. Rows that repeat and null
    doc_ids are packed as any other row. Other columns of the input play no part. An empty table gives no rows.
    """
    small_batches(docs)
    pieces = materialize(tokenize_pieces(project(docs, doc_id=id_col, text=text_col), tokenizer_path, capacity, end_id, cache), "pieces")
    groups = max(1, -(-pieces.count() // group_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rid", "piece"], ignore_index=True)
        bins, offsets, _ = best_two_fit(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(pdf["g"].to_numpy() << 33) + bins, offset=offsets)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("rid", "piece"), F.lit(groups)).cast("long"))
    return dealt.groupBy("g").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

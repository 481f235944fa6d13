import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from artifactlink.llm.common import read_table
from artifactlink.llm.packing import best_two_fit, pack_best_two_fit
from artifactlink.llm.queries import tokenizer_path
from artifactlink.llm.token_counts import load_tokenizer, token_counts
from tests.llm.support import frame, odd_texts


def ids_of(text):
    return load_tokenizer(tokenizer_path()).encode(text or "", add_special_tokens=False).ids


def test_counts_of_odd_texts(spark):
    rows = list(enumerate(odd_texts())) + [(None, "null id"), (5, "again"), (5, "again")]
    want = sorted(((i, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 2048) for i, t in rows), key=str)
    for head in (1, 10, 1 << 18):
        got = token_counts(frame(spark, rows), tokenizer_path(), head_size=head).select("doc_id", "n_bytes", "n_tokens", "over_limit")
        assert sorted([tuple(r) for r in got.collect()], key=str) == want


def test_counts_of_table(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, tokenizer_path(), head_size=500).collect()}
    assert got == {r.doc_id: len(ids_of(r.text)) for r in docs.collect()}


def test_empty(spark):
    assert token_counts(frame(spark, []), tokenizer_path()).count() == 0
    assert pack_best_two_fit(frame(spark, []), tokenizer_path()).count() == 0


def test_packing_round_trip(spark):
    rows = [*enumerate(odd_texts(3)), (None, "null id"), (5, "again"), (5, "again")]
    for group_rows in (50_000, 20):
        got = pack_best_two_fit(frame(spark, rows), tokenizer_path(), group_rows=group_rows).collect()
        want = []
        for i, t in rows:
            ids = np.array([*ids_of(t), 0], "<u4")
            want += [(i, p, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for p, at in enumerate(range(0, len(ids), 2048))]
        assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 2048


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_two_fit_places_each_once(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets, n = best_two_fit(lengths, 64)
    used = np.zeros(n, np.int64)
    for i in np.lexsort((offsets, bins)):
        assert offsets[i] == used[bins[i]]
        used[bins[i]] += lengths[i]
    assert (used <= 64).all() and (used > 0).all()
    assert n <= 1.25 * max(1, -(-lengths.sum() // 64)) + 1 + (lengths > 32).sum()


def test_two_pieces_replace_the_smallest():
    # 7 + 2 leaves 1 of 10; 2 is replaced by 3 only as a pair that fits better: 2 -> 1 + 2 doesn't exist, 3 fits at once
    bins, _, n = best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert n == 2 and bins[0] == bins[2] == bins[3] != bins[1]

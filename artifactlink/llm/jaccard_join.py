"""Exact n-gram Jaccard self-join with a token-group matrix.

A document is the set of its word shingles (64-bit hashes; equal sets are one set, known by a 64-bit key). Sets A, B
link when 100 * |A & B| >= percent * |A | B|, so they share at least `need(A)` = ceil(percent * |A| / 100) tokens, and,
under any one order of all tokens, one of the first |A| - need(A) + 1 tokens of A is among those of B. More: all shared
tokens up to the end of one set's first tokens are first tokens of both, so at most max(need(A), need(B)) - 1 others are
shared, and the number of shared first tokens must make up for the rest of the overlap that the lengths ask for.

1. Order: tokens found in `hot` sets or more come last, others first, each by hash. Counts are taken over all documents;
   hot tokens become bits of a bitmap of fixed size. A false bit changes the order, never the result.
2. Postings: each set's first tokens. Those in several sets are kept. Tokens that aren't hot have short lists, which
   meet in numpy; lists of hot tokens are combined by Spark's map-side aggregation, so no task holds one.
   A set's `reach` is how many of its first tokens others have, a token's `after` how many of these stand at or after it,
   rarest first. Sets that must share m first tokens share one whose `after` is at least m in both: the first of them. So
   a set most of whose first tokens are its own meets few others, however common the rest of it is.
3. Groups: every set is compared with one other, the set of most reach in the lists that it shares most often; verified
   links make groups of similar sets (connected components). Nothing inside a group needs a further comparison.
4. Token-group matrix: groups are cut into parts of about `part` sets; each part has the union of its sets' tokens.
   A set A is held against a part of another group when lengths allow it and their first tokens overlap enough. It can
   link with a member only if |A & union| >= need(A); only parts that meet this bound are opened.
5. Sets of opened parts are compared with A, exactly. These links and those of step 3 have the same components as all
   links have: a link inside a group joins nothing new, and no link between groups fails a filter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from artifactlink.llm.common import materialize, pieces_of, small_batches, text_bytes, tidy
from artifactlink.llm.components import components
from artifactlink.llm.shingles import mix, shingle_sets

BITMAP_BITS = 27
_PIECE = 500_000
#: Tokens, and first tokens, that a task holds before it hands them on.
_HELD, _HELD_FIRST = 1_000_000, 400_000


def set_key(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def need(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    for whole in batches:
        for b in pieces_of(whole, _PIECE):
            yield b.column(0).to_pylist(), list(shingle_sets(text_bytes(b), size))


def _by_bucket(ids: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Buckets (above the low 32 bits) of sorted token ids, with their places."""
    high = ids >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(high[1:] != high[:-1]) + 1).tolist(), len(ids)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi > lo:
            yield int(high[lo]), slice(lo, hi)


class Bitmap:
    """A set of 64-bit hashes folded to a fixed number of bits."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def fold(h: np.ndarray, bits: int) -> np.ndarray:
        return mix(h.astype(np.uint64)) >> np.uint64(64 - bits)

    def __contains__(self, h) -> bool:  # pragma: no cover
        return bool(self.test(np.array([h], np.uint64))[0])

    def test(self, h: np.ndarray) -> np.ndarray:
        i = self.fold(h, self.bits)
        return (self.words[i >> np.uint64(6)] >> (i & np.uint64(63))) & np.uint64(1) != 0

    @classmethod
    def collect(cls, places: DataFrame, bits: int) -> Bitmap:
        """From a column `i` of folded hashes; at most 2**bits bits reach the driver."""
        word = places.groupBy(F.shiftright("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("b")).toArrow()
        words = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
        words[word.column("w").to_numpy()] = word.column("b").to_numpy().view(np.uint64)
        return cls(words, bits)


def hot_tokens(docs: DataFrame, size: int, hot: int, bits: int, folded: int) -> Bitmap:
    """Tokens of `hot` documents or more (sets that one task reads twice count once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            ids, n = np.unique(np.concatenate(parts) >> np.uint64(32 - bits), return_counts=True)
            n = np.minimum(n, 255).astype(np.uint8)
            low = ids.astype("<u4")
            got = list(_by_bucket(ids))
            return pa.record_batch([pa.array([k for k, _ in got], pa.int32()), pa.array([low[s].tobytes() for _, s in got], pa.binary()), pa.array([n[s].tobytes() for _, s in got], pa.binary())], ["bucket", "ids", "n"])

        parts, total, seen = [], 0, set()
        for _, sets in _sets(batches, size):
            for s in sets:
                if len(s) and (key := set_key(s)) not in seen:
                    seen.add(key)
                    parts.append(s)
                    total += len(s)
            if total > _HELD:
                yield out(parts)
                parts, total = [], 0
        if parts:
            yield out(parts)

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["ids"]])
        n = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["n"]]).astype(np.int64)
        by = np.argsort(ids, kind="stable")
        ids, n = ids[by], n[by]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        often = ids[first][np.add.reduceat(n, first) >= hot].astype(np.uint64) | np.uint64(int(key[0]) << 32)
        return pd.DataFrame({"i": Bitmap.fold(often, folded).astype(np.int64)})

    counted = docs.select("doc_id", "text").mapInArrow(tidy(run), "bucket int, ids binary, n binary")
    return Bitmap.collect(counted.groupBy("bucket").applyInPandas(count, "i long"), folded)


_ENTRY = np.dtype([("id", "<u4"), ("n", "<u4"), ("key", "<i8")])


def postings(docs: DataFrame, size: int, percent: int, bits: int, hot: Bitmap) -> DataFrame:
    """(token, key, n, reach, after): first tokens of sets, for tokens that are first ones of several sets, each set once."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def first_tokens(batches: Iterator[pa.RecordBatch], want_hot: bool) -> Iterator[tuple[int, np.ndarray, int]]:
        bitmap, seen = shared.value, set()
        for _, sets in _sets(batches, size):
            for s in sets:
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                ids = s >> np.uint64(32 - bits)
                is_hot = bitmap.test(ids)
                cold = ids[~is_hot]
                n = len(s) - need(len(s), percent) + 1
                yield key, (ids[is_hot][: max(0, n - len(cold))] if want_hot else cold[:n]), len(s)

    def cold_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[tuple]) -> pa.RecordBatch:
            ids = np.concatenate([p[1] for p in parts])
            e = np.empty(len(ids), _ENTRY)
            e["id"], sizes = ids.astype("<u4"), [len(p[1]) for p in parts]
            e["key"], e["n"] = np.repeat(np.array([p[0] for p in parts], np.int64), sizes), np.repeat(np.array([p[2] for p in parts], np.uint32), sizes)
            by = np.argsort(ids)
            ids, e = ids[by], e[by]
            got = list(_by_bucket(ids))
            return pa.record_batch([pa.array([k for k, _ in got], pa.int32()), pa.array([e[s].tobytes() for _, s in got], pa.binary())], ["bucket", "entries"])

        parts, total = [], 0
        for p in first_tokens(batches, False):
            if len(p[1]):
                parts.append(p)
                total += len(p[1])
            if total > _HELD_FIRST:
                yield out(parts)
                parts, total = [], 0
        if parts:
            yield out(parts)

    def hot_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[tuple]) -> pa.RecordBatch:
            sizes = [len(p[1]) for p in parts]
            key, n = np.repeat(np.array([p[0] for p in parts], np.int64), sizes), np.repeat(np.array([p[2] for p in parts], np.int32), sizes)
            return pa.record_batch([pa.array(np.concatenate([p[1] for p in parts]).astype(np.int64)), pa.array(key), pa.array(n)], ["token", "key", "n"])

        parts: list[tuple] = []
        for p in first_tokens(batches, True):
            if len(p[1]):
                parts.append(p)
            if len(parts) >= 200:
                yield out(parts)
                parts = []
        if parts:
            yield out(parts)

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        e = np.concatenate([np.frombuffer(x, _ENTRY) for x in pdf["entries"]])
        by = np.argsort(e["id"], kind="stable")
        same = e["id"][by][1:] == e["id"][by][:-1]
        in_run = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        e = np.unique(e[by][in_run])  # a copy that another task has read too is the same entry
        _, where, many = np.unique(e["id"], return_inverse=True, return_counts=True)
        e = e[many[where] > 1] if len(e) else e
        return pd.DataFrame({"token": e["id"].astype(np.int64) | (int(key[0]) << 32), "key": e["key"], "n": e["n"].astype(np.int32)})

    texts = docs.select("doc_id", "text")
    cold = texts.mapInArrow(tidy(cold_run), "bucket int, entries binary").groupBy("bucket").applyInPandas(meet, "token long, key long, n int")
    found = texts.mapInArrow(tidy(hot_run), "token long, key long, n int").groupBy("token", "key").agg(F.first("n").alias("n"))
    both = materialize(cold.unionByName(found), "first-tokens")
    shared.destroy()
    several = both.groupBy("token").agg(F.count(F.lit(1)).alias("lists")).where("lists > 1")
    both = materialize(both.join(several, "token"), "met-tokens")
    own = Window.partitionBy("key")
    reach = F.count(F.lit(1)).over(own)
    after = reach - F.row_number().over(own.orderBy("lists", "token")) + 1
    return both.select("token", "key", "n", reach.alias("reach"), after.alias("after"))


def keyed_documents(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, key, n) for every row; key is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, size):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "key", "n"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, key long, n long")


def token_sets(docs: DataFrame, size: int, wanted: Bitmap) -> DataFrame:
    """(key, tokens binary) of the sets whose key is in the bitmap (some others too), each once; written to the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = shared.value, set()
        for _, sets in _sets(batches, size):
            keys = np.array([set_key(s) if len(s) else 0 for s in sets], np.int64)
            hit = bitmap.test(keys.view(np.uint64))
            own = []
            for k, s, h in zip(keys.tolist(), sets, hit.tolist(), strict=True):
                if h and len(s) and k not in seen:
                    seen.add(k)
                    own.append((k, s.tobytes()))
            if own:
                yield pa.record_batch([pa.array([k for k, _ in own], pa.int64()), pa.array([s for _, s in own], pa.binary())], ["key", "tokens"])

    found = docs.select("doc_id", "text").mapInArrow(tidy(run), "key long, tokens binary").groupBy("key").agg(F.first("tokens").alias("tokens"))
    written = materialize(found, "sets")
    shared.destroy()
    return written


def _tokens(column: pa.Array) -> Iterator[np.ndarray]:
    """The sets of a binary column, without a copy."""
    for x in column:
        yield np.frombuffer(x.as_buffer(), np.uint64)


def _with_sets(pairs: DataFrame, sets: DataFrame, left: str, right: str) -> DataFrame:
    a = sets.select(F.col("key").alias(left), F.col("tokens").alias("left_tokens"))
    b = sets.select(F.col("key").alias(right), F.col("tokens").alias("right_tokens"))
    return pairs.join(a, left).join(b, right)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(x, y, percent) for x, y in zip(_tokens(batch.column(2)), _tokens(batch.column(3)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return _with_sets(pairs, sets, "a", "b").select("a", "b", "left_tokens", "right_tokens").mapInArrow(tidy(run), "a long, b long")


def _lengths_allow(n: Column, low: Column, high: Column, percent: int) -> Column:
    return (100 * high >= percent * n) & (100 * n >= percent * low)


def _overlap_allows(seen: Column, n_a: Column, low: Column, high: Column, percent: int) -> Column:
    """Whether `seen` shared first tokens are enough for sets of n_a and of low to high tokens to link."""
    overlap = F.ceil(percent * (n_a + low) / (100 + percent))
    return seen >= overlap - F.ceil(percent * F.greatest(n_a, high) / 100) + 1


def star_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set with the set of most reach (then smallest key) in the lists that it shares most often."""
    centre = shared.groupBy("token").agg(F.max(F.struct("reach", F.bitwise_not("key").alias("key"), "n")).alias("m"))
    centre = centre.select("token", F.bitwise_not("m.key").alias("b"), F.col("m.n").alias("m"), F.col("m.reach").alias("reach_b"))
    votes = shared.join(centre, "token").where((F.col("key") != F.col("b")) & _lengths_allow(F.col("n"), F.col("m"), F.col("m"), percent))
    votes = votes.where(_overlap_allows(F.least("reach", "reach_b"), F.col("n"), F.col("m"), F.col("m"), percent))
    votes = votes.groupBy(F.col("key").alias("a"), "b").agg(F.count(F.lit(1)).alias("votes"), F.max("n").alias("n"), F.max("m").alias("m"))
    votes = votes.where(_overlap_allows(F.col("votes"), F.col("n"), F.col("m"), F.col("m"), percent))
    return votes.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("v")).select("a", F.col("v.b").alias("b"))


def part_queries(shared: DataFrame, groups: DataFrame, percent: int, part: int) -> tuple[DataFrame, DataFrame]:
    """Members (key, n, c, p) of the parts p of groups c, and queries (a, n_a, c, p): sets with parts of other groups."""
    rows = shared.join(groups.select(F.col("v").alias("key"), "c"), "key", "left").withColumn("c", F.coalesce("c", "key"))
    mixed = rows.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    rows = materialize(rows.join(mixed, "token"), "between-groups")
    sizes = groups.groupBy("c").agg(F.count(F.lit(1)).alias("members"))
    members = rows.select("key", "n", "c").distinct().join(sizes, "c", "left")
    members = materialize(members.select("key", "n", "c", F.pmod(F.xxhash64("key"), F.ceil(F.coalesce("members", F.lit(1)) / part)).alias("p")), "parts")
    in_parts = rows.select("token", "key", "after").join(members, "key").groupBy("token", "c", "p").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("after").alias("after"))
    queries = rows.select("token", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("c").alias("c_a"), F.col("after").alias("after_a"))
    met = queries.join(in_parts, "token").where((F.col("c_a") < F.col("c")) & _lengths_allow(F.col("n_a"), F.col("low"), F.col("high"), percent))
    met = met.where(_overlap_allows(F.least("after_a", "after"), F.col("n_a"), F.col("low"), F.col("high"), percent))
    return members, materialize(met.select("a", "n_a", "c", "p").distinct(), "queries")


def open_parts(members: DataFrame, tried: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): candidates of different groups, from the parts that meet the bound of the token-group matrix."""

    def union(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["tokens"]]))
        return pd.DataFrame({"c": [key[0]], "p": [key[1]], "union_tokens": [tokens.tobytes()]})

    matrix = members.join(tried.select("c", "p").distinct(), ["c", "p"]).join(sets, "key").select("c", "p", "tokens").groupBy("c", "p").applyInPandas(union, "c long, p long, union_tokens binary")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).to_pylist()
            keep = [len(np.intersect1d(x, y, assume_unique=True)) >= need(n, percent) for n, x, y in zip(sizes, _tokens(b.column(4)), _tokens(b.column(5)), strict=True)]
            yield b.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    held = tried.join(sets.select(F.col("key").alias("a"), "tokens"), "a").join(matrix, ["c", "p"]).select("a", "n_a", "c", "p", "tokens", "union_tokens")
    opened = held.mapInArrow(tidy(bound), "a long, n_a int, c long, p long")
    pairs = opened.join(members.select(F.col("key").alias("b"), "n", "c", "p"), ["c", "p"])
    return pairs.where(_lengths_allow(F.col("n_a"), F.col("n"), F.col("n"), percent)).select("a", "b").distinct()


def sets_of(docs: DataFrame, keys: DataFrame, size: int, bits: int) -> DataFrame:
    """The token sets of (at least) the keys."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(Bitmap.fold(b.column(0).to_numpy().view(np.uint64), bits).astype(np.int64))], ["i"])

    return token_sets(docs, size, Bitmap.collect(keys.mapInArrow(tidy(fold), "i long"), bits))


def jaccard_components(
    docs: DataFrame, size: int = 4, percent: int = 85, hot: int = 8, part: int = 64, bitmap_bits: int = BITMAP_BITS, bucket_tokens: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Null, empty and blank texts have no shingles and link with nothing: component_id is their own doc_id. Rows with the
    same set are linked, rows that repeat too. A null doc_id takes part in links; component_id is null only where all of
    a component are null. Other columns of the input play no part. An empty table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    small_batches(docs)
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a bucket's ids have 32 bits below it; more buckets than 2**31 would need a longer number
    bits = max(0, min(31, int(np.ceil(np.log2(max(1, volume / 6 / bucket_tokens))))))
    shared = materialize(postings(rows, size, percent, bits, hot_tokens(rows, size, hot, bits, bitmap_bits)), "postings")
    stars = materialize(star_pairs(shared, percent), "stars")
    sets = sets_of(rows, stars.select("a").union(stars.select("b")), size, bitmap_bits)
    links = materialize(verify(stars, sets, percent), "links")
    groups = components(links)
    members, tried = part_queries(shared, groups, percent, part)
    asked = tried.select("a").union(members.join(tried.select("c", "p").distinct(), ["c", "p"]).select("key"))
    sets = sets_of(rows, asked, size, bitmap_bits)
    more = materialize(verify(open_parts(members, tried, sets, percent), sets, percent), "links")
    label = groups if more.isEmpty() else components(links.union(more))
    keyed = keyed_documents(rows, size).join(label.select(F.col("v").alias("key"), "c"), "key", "left").withColumn("c", F.coalesce("c", "key"))
    keyed = materialize(keyed.select("doc_id", "n", "c"), "keyed")
    # a written table, as the rows are: AQE splits a component that holds many of them
    least = materialize(keyed.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id")), "least")
    return keyed.join(least, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_smallest(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, without those whose component has a smaller doc_id.

    Rows go or stay by doc_id; rows without one, and rows that repeat one, all stay where their doc_id stays. Null and
    empty texts link with nothing and stay. Further columns are carried along whatever their names; an empty table stays
    empty."""
    found = jaccard_components(docs, size, percent, id_col=id_col, text_col=text_col, **options)
    dropped = materialize(found.where("doc_id > component_id").select(F.col("doc_id").alias("dropped_id")).distinct(), "dropped")
    return docs.join(dropped, docs[id_col] == dropped["dropped_id"], "left_anti")

"""Words counted once over the corpus, and per-document sums over them, without a vocabulary on one machine.

`word_counts` counts words over all documents. `sum_over_words` joins per-document word frequencies with a table of
per-word values: the `HEAD` most frequent words (a fixed bound) are looked up in the tasks that read the texts, every
other word goes through a shuffle join on the word. No word of the joined part is hot, as the head has all hot words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artifactlink.llm.common import text_bytes, tidy

#: Words kept in memory by every task; a fixed bound of about 4 MB as sent.
HEAD = 1 << 18
#: Distinct words a task counts before it hands them on.
FLUSH = 300_000


def split_words(text: bytes) -> list[bytes]:
    return text.split()


def word_counts(docs: DataFrame, words: Callable[[bytes], list[bytes]] = split_words) -> DataFrame:
    """(word binary, n long) over the `text` column of all rows; tasks combine what they read before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

        c: Counter = Counter()
        for b in batches:
            for t in text_bytes(b):
                c.update(words(t))
                if len(c) > FLUSH:
                    yield out(c)
                    c.clear()
        if c:
            yield out(c)

    return docs.select("text").mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: Steps of a doubling of n in which `least_count` tells counts apart.
_STEPS = 16


def least_count(values: DataFrame, size: int) -> int:
    """A count n that at most `size` words reach, as low as a histogram of log counts tells: no word is sorted."""
    step = F.floor(F.log2("n") * _STEPS)
    upto, best = 0, None
    for r in sorted(values.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect(), key=lambda r: -r.step):
        upto += r.words
        if upto > size:
            return best if best is not None else (1 << 62)
        best = r.least
    return 0


def head_of(values: DataFrame, value_cols: list[str], size: int = HEAD) -> dict[bytes, tuple]:
    """The most frequent words with their values; at most `size` of them reach the driver, whole steps of counts."""
    rows = values.where(F.col("n") >= least_count(values, size)).select("word", *value_cols).toArrow().to_pydict()
    return dict(zip(rows["word"], zip(*[rows[c] for c in value_cols], strict=True), strict=True))


def frequencies(texts: list[bytes], words: Callable[[bytes], list[bytes]], head: dict[bytes, float]) -> Iterator[tuple[int, float, int, list[bytes], list[int]]]:
    """For each text: its index, sum over head words of value x frequency, words in all, other words and their frequencies."""
    for i, t in enumerate(texts):
        c = Counter(words(t))
        get = head.get
        total, rest, freq = 0, [], []
        n = 0
        for w, k in c.items():
            n += k
            v = get(w)
            if v is None:
                rest.append(w)
                freq.append(k)
            else:
                total += v * k
        yield i, total, n, rest, freq

"""Token counts: pieces counted once per distinct pre-token, joined to per-document pre-token frequencies.

A pre-token here is a run of text without ASCII white space. The tokenizer never joins pieces across white space, so a
text's count is the sum over its pre-tokens; ids of a document are never made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artifactlink.llm.common import materialize, project, row_base, small_batches, text_bytes, tidy
from artifactlink.llm.wordjoin import HEAD, frequencies, head_of, split_words, word_counts


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    """A tokenizers file, without truncation or padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def count_pieces(words: DataFrame, tokenizer_path: str) -> DataFrame:
    """(word, n) -> (word, n, pieces): each distinct pre-token is tokenised once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(tokenizer_path)
        for b in batches:
            words = [w.decode() for w in b.column(0).to_pylist()]
            counts: list[int] = []
            for i in range(0, len(words), 2000):
                counts += [len(e.ids) for e in tok.encode_batch_fast(words[i : i + 2000], add_special_tokens=False)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["word", "n", "pieces"])

    return words.mapInArrow(tidy(run), "word binary, n long, pieces long")


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", head_size: int = HEAD
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit, n_pretokens.

    Null and empty texts have 0 bytes and tokens. A null doc_id and rows that repeat are counted as any other row. Other
    columns of the input play no part. An empty table gives no rows.
    """
    small_batches(docs)
    spark = docs.sparkSession
    rows = project(docs, doc_id=id_col, text=text_col)
    table = materialize(count_pieces(word_counts(rows), tokenizer_path), "pieces")
    head = spark.sparkContext.broadcast({w: v[0] for w, v in head_of(table, ["pieces"], head_size).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rid = head.value, row_base()
        names = ["rid", "word", "freq", "doc_id", "n_bytes", "n_pretokens", "is_doc"]
        for b in batches:
            ids, texts = b.column(0).to_pylist(), text_bytes(b)
            at, word, freq, doc, size, many, is_doc = [], [], [], [], [], [], []
            for i, total, n, rest, k in frequencies(texts, split_words, known):
                m = len(rest)
                at += [rid + i] * (m + 1)
                word += [b" %d" % (rid + i), *rest]  # a document's own row: no word has a space, and no key is hot
                freq += [total, *k]
                doc += [ids[i], *[None] * m]
                size += [len(texts[i]), *[None] * m]
                many += [n, *[None] * m]
                is_doc += [True, *[None] * m]
            rid += len(texts)
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.record_batch([pa.array(x, k) for x, k in zip((at, word, freq, doc, size, many, is_doc), kinds, strict=True)], names)

    parts = rows.mapInArrow(tidy(run), "rid long, word binary, freq long, doc_id long, n_bytes long, n_pretokens long, is_doc boolean")
    joined = parts.join(table.select("word", "pieces"), "word", "left")
    tokens = F.when(F.col("is_doc"), F.col("freq")).otherwise(F.col("freq") * F.col("pieces"))
    return (
        joined.groupBy("rid")
        .agg(F.sum(tokens).alias("n_tokens"), F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.max("n_pretokens").alias("n_pretokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_pretokens")
    )

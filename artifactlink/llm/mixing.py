"""Mixing sources to target weights by hierarchical budgeting over a domain / language / source tree.

Everything on the path is a DataFrame operation. Tokens are the words `[^\\x20\\x09-\\x0D]+` of a text.

1. Each document's size and seeded keys (md5 of seed, epoch and doc_id) are computed once and written to the shared folder.
2. A leaf's capacity is its tokens times `epochs`; a node's capacity is the sum below it.
3. From the root down, a node's budget is dealt to its children by weight. A child that would get more than its capacity
   gets its capacity, and the rest goes to its siblings by weight; only what the siblings cannot take was never given to
   their parent (its own budget is held to its capacity), so it went to the parent's siblings. Shares are whole tokens,
   rounded down.
4. A leaf takes whole epochs while its budget lasts, then the longest prefix of the next epoch's seeded order that the
   budget holds. Prefix sums run over buckets of the key, then inside the one bucket where the budget ends, so that no
   task sees a whole leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from artifactlink.llm.common import WORD_PATTERN, materialize

#: (level, value) -> weight, an integer up to 1000; other values have weight 1.
WEIGHTS: dict[tuple[str, str], int] = {
    ("domain", "web"): 5, ("domain", "reference"): 3, ("domain", "forum"): 2,
    ("lang", "en"): 4, ("lang", "fr"): 2, ("lang", "de"): 2, ("lang", "es"): 1,
    ("source", "src0"): 3,
}
#: Sources have no domain of their own in `documents`: a hash of the name deals them out, where no domain column is named.
DOMAINS = ("web", "reference", "forum", "code")


def domain_of(source: Column) -> Column:
    """The domain of a source, by a hash of its name."""
    digit = F.substring(F.md5(F.coalesce(source, F.lit("unknown")).cast("binary")), 1, 1)
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.instr(F.lit("0123456789abcdef"), digit) % len(DOMAINS) + 1)


def _weight(level: str, value: Column, weights: dict[tuple[str, str], int]) -> Column:
    own = [(v, w) for (at, v), w in weights.items() if at == level]
    return reduce(lambda c, vw: F.when(value == vw[0], vw[1]).otherwise(c), own, F.lit(1)).cast("long")


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def deal(children: DataFrame, parent: list[str], tie: str) -> DataFrame:
    """Water-filling of `parent_budget` over the children of each parent: adds `budget`; wants weight w and capacity cap.

    Children are ordered by capacity per weight. With the budget and weight that the ones before have left, a child is
    full if its capacity is at most its share; from the first child that isn't, all get the same tokens per weight.
    """
    by = Window.partitionBy(*parent).orderBy(F.floor(F.col("cap").cast("decimal(28,0)") * 1_000_000 / F.col("w")), tie)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    c = children.withColumn("b_left", F.col("parent_budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    c = c.withColumn("w_left", F.sum("w").over(Window.partitionBy(*parent)) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    c = c.withColumn("open", F.col("cap") * F.col("w_left") > F.col("w") * F.col("b_left"))
    c = c.withColumn("k", F.row_number().over(by)).withColumn("level", F.min(F.when(F.col("open"), F.struct("k", "b_left", "w_left"))).over(Window.partitionBy(*parent)))
    share = F.expr("(w * level.b_left) div level.w_left")
    return c.withColumn("budget", F.when(F.col("level").isNull() | (F.col("k") < F.col("level.k")), F.col("cap")).otherwise(share)).drop("b_left", "w_left", "open", "k", "level")


def budgets(leaves: DataFrame, numer: int, denom: int, epochs: int, weights: dict[tuple[str, str], int]) -> DataFrame:
    """(domain, lang, source, tokens) -> the same with cap and budget. The whole budget is numer / denom of all tokens."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    root = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("cap"), F.lit(0)).alias("c")).select(
        F.least(F.expr(f"(t * {numer}) div {denom}"), F.col("c")).alias("parent_budget")
    )
    path = ["domain", "lang", "source"]
    above, keys = root, []
    for depth, level in enumerate(path):
        nodes = leaves.groupBy(*path[: depth + 1]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("w", _weight(level, F.col(level), weights))
        nodes = nodes.join(above, keys) if keys else nodes.crossJoin(F.broadcast(above))  # one row
        dealt = deal(nodes, keys or [F.lit(0)], level)
        keys = path[: depth + 1]
        above = dealt.select(*keys, F.col("budget").alias("parent_budget")) if depth < 2 else dealt.select(*keys, "tokens", "cap", "budget")
    return above


def _sized(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, domain_col: str | None) -> DataFrame:
    source = F.coalesce(docs[source_col], F.lit("unknown"))
    return docs.select(
        docs[id_col].alias("doc_id"),
        (F.coalesce(docs[domain_col], F.lit("unknown")) if domain_col else domain_of(docs[source_col])).alias("domain"),
        F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), source.alias("source"), count_words(docs[text_col]).alias("n_tokens"),
    )


def _key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def mix(
    docs: DataFrame,
    numer: int = 7,
    denom: int = 10,
    epochs: int = 2,
    seed: int = 20,
    weights: dict[tuple[str, str], int] = WEIGHTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    domain_col: str | None = None,
    bucket_digits: int = 3,
) -> DataFrame:
    """One row per document and epoch that is selected: doc_id, domain, lang, source, n_tokens, epoch, leaf_budget, key.

    A leaf's documents in the order of epoch and key are the prefix that its budget holds. Rows that repeat a doc_id have
    the same key and are taken in one go, or not at all; null doc_ids likewise. Null lang is `und`, null source
    `unknown`; null text has no words and is selected where its key's place in the order is reached. A budget of 0
    tokens selects nothing, not even texts without words. An empty table gives no rows.
    """
    sized = materialize(_sized(docs, id_col, text_col, lang_col, source_col, domain_col), "mix-sizes")
    cut = cuts(sized, numer, denom, epochs, seed, weights, bucket_digits)
    return _selected(sized, cut, epochs, seed)


LEAF = ["domain", "lang", "source"]


def cuts(sized: DataFrame, numer: int, denom: int, epochs: int, seed: int, weights: dict[tuple[str, str], int], bucket_digits: int) -> DataFrame:
    """A row per leaf: budget, whole epochs that it takes, and the first key of the next epoch that it doesn't."""
    leaves = materialize(budgets(sized.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), numer, denom, epochs, weights).where("budget > 0"), "mix-budgets")
    leaves = leaves.withColumn("whole", F.expr("budget div tokens").cast("int"))
    leaves = leaves.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    part = leaves.where((F.col("whole") < epochs) & (F.col("rest") > 0))
    rows = sized.join(part.select(*LEAF, "whole", "rest"), LEAF).withColumn("key", _key(seed, F.col("whole") + 1))
    rows = rows.withColumn("bucket", F.substring("key", 1, bucket_digits))
    buckets = rows.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
    run = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bucket"))
    edge = buckets.withColumn("upto", run).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")) & (F.col("n") > 0))
    edge = edge.select(*LEAF, "bucket", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))
    inside = rows.join(edge, [*LEAF, "bucket"]).groupBy(*LEAF, "bucket", "key").agg(F.sum("n_tokens").alias("n"), F.max("left").alias("left"))
    inside = inside.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEAF, "bucket").orderBy("key")))
    stop = inside.where(F.col("upto") > F.col("left")).groupBy(*LEAF).agg(F.min("key").alias("stop"))
    return materialize(leaves.join(stop, LEAF, "left").select(*LEAF, "budget", "tokens", "whole", "stop"), "mix-cuts")


def _selected(sized: DataFrame, cut: DataFrame, epochs: int, seed: int) -> DataFrame:
    rows = sized.join(cut, LEAF).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("key", _key(seed, F.col("epoch")))
    taken = rows.where((F.col("epoch") <= F.col("whole")) | ((F.col("epoch") == F.col("whole") + 1) & (F.col("key") < F.col("stop"))))
    return taken.select("doc_id", *LEAF, "n_tokens", F.col("epoch"), F.col("budget").alias("leaf_budget"), F.col("key"))


def mix_documents(
    docs: DataFrame, numer: int = 9, denom: int = 10, seed: int = 20, weights: dict[tuple[str, str], int] = WEIGHTS, bucket_digits: int = 3,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """The documents themselves, selected from one epoch, with the columns of `docs`. The texts are not shuffled: each
    row meets its leaf's cut, a table with a row per leaf that is broadcast while it is small.

    Null lang is `und`, null source `unknown`; a null or empty text has no words and stays where its key's place in the
    order is reached. Rows that repeat a doc_id, and those without one, go or stay together. Further columns are carried
    along whatever their names; an empty table stays empty."""
    sized = materialize(_sized(docs, id_col, text_col, lang_col, source_col, None), "mix-sizes")
    cut = cuts(sized, numer, denom, 1, seed, weights, bucket_digits).select(*[F.col(c).alias(f"cut_{c}") for c in [*LEAF, "whole", "stop"]])
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("1"), F.coalesce(docs[id_col].cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.join(
        cut,
        (domain_of(docs[source_col]) == cut["cut_domain"]) & (F.coalesce(docs[lang_col], F.lit("und")) == cut["cut_lang"]) & (F.coalesce(docs[source_col], F.lit("unknown")) == cut["cut_source"]),
    )
    return rows.where((cut["cut_whole"] >= 1) | (key < cut["cut_stop"])).select(*[docs[c] for c in docs.columns])

"""Applying a mapping to text, and looking classes up in it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from artifactlink.functions.predicates import is_safe
from artifactlink.functions.text import normalize_class_query

#: A maximal run of name characters: ASCII letters, digits, `_ $ / .`, and whatever isn't ASCII or white space.
NAME_RUN = r"(?:[A-Za-z0-9_$/.]|[^\x00-\x7F\s])+"
_PRIMITIVES = "BCDFIJSZ"
#: Line numbers of a block of a mapping text.
BLOCK = 50_000
#: Statuses that a JSON mapping gives, alone and with include_unsafe.
SAFE_STATUS, UNSAFE_STATUS = ("Matched",), ("Matched", "LowConfidence", "Conflict", "SemanticBreak")


def normalize_replacements(rows: DataFrame) -> DataFrame:
    """(old, new, ord) -> (old, new): identities go, and of an old name's several new ones the last, in the order of
    longer old names first, then old, then `ord`."""
    return rows.where("old <> new").groupBy("old").agg(F.max_by("new", "ord").alias("new"))


def parse_mapping_lines(lines: DataFrame, include_unsafe: bool = False) -> DataFrame:
    """(line_no, text) of a report or ProGuard mapping -> (old, new, ord) descriptors.

    `# UNSAFE` marks the next mapping line, which is left out unless asked for; lines between keep the mark. A line is
    marked if a mark stands after the mapping line before it: running maxima, taken within blocks of `BLOCK` line numbers
    and, over one row a block, carried from block to block."""
    t = F.trim("text")
    left, right = F.substring_index("text", " -> ", 1), F.expr("substring(text, instr(text, ' -> ') + 4)")
    arrow = F.instr("text", " -> ") > 0
    tokens = lambda c: F.regexp_extract_all(c, F.lit("L[^;]*;"), F.lit(0))
    pair = F.struct(F.try_element_at(tokens(left), F.lit(-1)).alias("old"), F.try_element_at(tokens(right), F.lit(1)).alias("new"))
    name = lambda i: F.regexp_extract(t, r"^([^# ][^ ]*) -> ([^ ]+):$", i)
    desc = lambda c: F.concat(F.lit("L"), F.translate(c, ".", "/"), F.lit(";"))
    pro = F.struct(F.when(name(1) != "", desc(name(1))).alias("old"), F.when(name(2) != "", desc(name(2))).alias("new"))
    x = lines.withColumn("p", F.when(arrow & pair["old"].isNotNull() & pair["new"].isNotNull(), pair).when(pro["old"].isNotNull(), pro))
    x = x.withColumns({"is_map": F.col("p").isNotNull(), "mark": F.when(t.startswith("# UNSAFE"), F.col("line_no"))})
    x = x.withColumns({"map": F.when(F.col("is_map"), F.col("line_no")), "block": F.floor(F.col("line_no") / BLOCK)})
    blocks = x.groupBy("block").agg(F.max("mark").alias("mark"), F.max("map").alias("map"))
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("block").alias("b"), F.max("mark").over(upto).alias("mark_before"), F.max("map").over(upto).alias("map_before"))
    x = x.join(blocks, F.col("block") == F.col("b"))
    before = Window.partitionBy("block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({"last_mark": F.greatest(F.max("mark").over(before), "mark_before"), "last_map": F.greatest(F.max("map").over(before), "map_before")})
    unsafe = F.col("last_mark").isNotNull() & (F.col("last_map").isNull() | (F.col("last_mark") > F.col("last_map")))
    keep = F.col("is_map") if include_unsafe else F.col("is_map") & ~unsafe
    return x.where(keep).select(F.col("p.old").alias("old"), F.col("p.new").alias("new"), F.col("line_no").alias("ord"))


def json_replacements(matches: DataFrame, old: DataFrame, new: DataFrame, include_unsafe: bool = False, safe_only: bool = False) -> DataFrame:
    """Class matches (ids) with label tables (id, descriptor) -> (old, new, ord)."""
    m = matches.where(F.col("status").isin(*(UNSAFE_STATUS if include_unsafe else SAFE_STATUS)))
    m = m.where(is_safe(F.col("status"), F.col("reasons"))) if safe_only else m
    m = m.join(old.select(F.col("id").alias("old_class_id"), F.col("descriptor").alias("old")), "old_class_id")
    m = m.join(new.select(F.col("id").alias("new_class_id"), F.col("descriptor").alias("new")), "new_class_id")
    return m.select("old", "new", F.col("old_class_id").alias("ord"))


class Rewriter:
    """Replaces class names in one pass from left to right: nothing that was replaced is read again."""

    def __init__(self, pairs: dict[str, str]):
        self.run = re.compile(NAME_RUN + r"|;")
        inner = lambda d: d[1:-1] if d.startswith("L") and d.endswith(";") else d
        self.descriptors = dict(pairs)
        self.names: dict[str, str] = {}
        for a, b in pairs.items():
            self.names[inner(a)] = inner(b)
            self.names[inner(a).replace("/", ".")] = inner(b).replace("/", ".")

    def _word(self, word: str, closed: bool) -> str:
        if closed:
            body = word.lstrip(_PRIMITIVES)
            hit = self.descriptors.get(body + ";")
            if hit is not None:
                return word[: len(word) - len(body)] + hit[:-1]
        if word in self.names:
            return self.names[word]
        end = word.rfind(".")
        while end > 0:
            if word[:end] in self.names:
                return self.names[word[:end]] + word[end:]
            end = word.rfind(".", 0, end)
        return word

    def __call__(self, text: str) -> str:
        out, at = [], 0
        for m in self.run.finditer(text):
            word = m.group()
            if word == ";":
                continue
            out += [text[at : m.start()], self._word(word, text[m.end() : m.end() + 1] == ";")]
            at = m.end()
        return "".join([*out, text[at:]])


def rewrite_texts(df: DataFrame, column: str, replacements: dict[str, str]) -> DataFrame:
    """`column` with names replaced. The mapping comes from one file, and is sent once to each executor."""
    shared = df.sparkSession.sparkContext.broadcast(replacements)
    schema = df.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite = Rewriter(shared.value)
        for b in batches:
            b[column] = b[column].map(lambda t: None if t is None else rewrite(t))
            yield b

    return df.mapInPandas(run, schema)


def replace_tokens(text: Column, old: list[str], new: list[str], pattern: str) -> Column:
    """Whole tokens of a text replaced by an equal-sized list, as a built-in expression; for small maps."""
    table = F.map_from_arrays(F.array(*[F.lit(x) for x in old]), F.array(*[F.lit(x) for x in new]))
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def query_class(matches: DataFrame, old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Rows of a class by name, on either side: side, status, score, old, new, safe, reasons, candidates (10 at most).

    Of several classes with the descriptor the one with the highest id is meant. No row: not found."""
    wanted = matches.sparkSession.range(1).select(normalize_class_query(F.lit(name)).alias("descriptor"))
    out = None
    for side, table in (("old", old), ("new", new)):
        ids = table.join(wanted, "descriptor").agg(F.max("id").alias("wanted_id"))
        rows = matches.join(ids, F.col(f"{side}_class_id") == F.col("wanted_id")).select(F.lit(side).alias("side"), *matches.columns)
        out = rows if out is None else out.unionByName(rows)
    out = out.join(old.select(F.col("id").alias("old_class_id"), F.col("descriptor").alias("old")), "old_class_id", "left")
    out = out.join(new.select(F.col("id").alias("new_class_id"), F.col("descriptor").alias("new")), "new_class_id", "left")
    return out.select("side", "status", "score", "old", "new", is_safe(F.col("status"), F.col("reasons")).alias("safe"), "reasons", F.slice("candidates", 1, 10).alias("candidates"))



"""The registered queries: operators over the driver's tables, each with the SQL of the same result where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from artifactlink.functions import predicates as P
from artifactlink.functions import similarity as S
from artifactlink.functions import text as T
from artifactlink.operators import anchors as A
from artifactlink.operators import audit as AU
from artifactlink.operators import candidates as C
from artifactlink.operators import decide as D
from artifactlink.operators import mapping as M
from artifactlink.operators import members as MB
from artifactlink.operators import scoring as SC
from artifactlink.operators.graph import ancestors
from artifactlink.operators.inspect import roll_up
from artifactlink.plans.bindings import CUT, DOC_SQL, TOKEN, cosine_sql, documents, jaccard_sql, supplier_sql, suppliers, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
STRINGS = {"string": "strings"}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(c, digits: int = 6):
    return F.round(c.cast("double"), digits)


def _document_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    old, new = documents(spark, d, 0), documents(spark, d, 1)
    return old, new, C.rare_pairs(old, new, STRINGS)


def _scored_documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    old, new, pairs = _document_pairs(spark, d)
    x = C.near_sets(pairs, old, new, "strings", 0.55).join(old.select(F.col("class_id").alias("old_id"), F.col("strings").alias("a")), "old_id").join(new.select(F.col("class_id").alias("new_id"), F.col("strings").alias("b")), "new_id")
    x = x.select("old_id", "new_id", S.jaccard(F.col("a"), F.col("b")).alias("score"))
    return old, new, x.where(F.col("score") >= S.f32(0.55)).withColumn("reasons", F.array(F.lit("token overlap")))


def _document_matches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old, new, scored = _scored_documents(spark, d)
    x = old.select(F.col("class_id").alias("old_id")).join(D.top_candidates(scored, 2), "old_id", "left")
    best = F.get("candidates", F.lit(0))
    status = D.member_status(F.col("candidates"), 0.80)
    rows = x.select(F.col("old_id").alias("old_class_id"), best["entity_id"].alias("new_class_id"), F.coalesce(best["score"], S.f32(0.0)).alias("score"), status.alias("status"), F.coalesce(best["reasons"], F.array(F.lit(D.NO_NEW))).alias("reasons"), F.coalesce("candidates", F.array().cast("array<struct<entity_id:bigint,score:float,reasons:array<string>>>")).alias("candidates"))
    return rows, new


_PAIRS = f"""{DOC_SQL},
pairs AS (SELECT a.doc_id AS old_id, b.doc_id AS new_id, count(*) AS n_shared FROM useful a JOIN rare USING (token) JOIN useful b USING (token) WHERE a.side = 0 AND b.side = 1 GROUP BY 1, 2),
scored AS (SELECT * FROM (SELECT old_id, new_id, {jaccard_sql("x.toks", "y.toks")} AS score FROM pairs JOIN doc x ON x.doc_id = old_id JOIN doc y ON y.doc_id = new_id) WHERE score >= 0.55::FLOAT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY score DESC, new_id) AS rk FROM scored),
best AS (SELECT d.doc_id AS old_id, max(new_id) FILTER (rk = 1) AS new_id, max(score) FILTER (rk = 1) AS score, max(score) FILTER (rk = 2) AS second FROM doc d LEFT JOIN ranked r ON r.old_id = d.doc_id WHERE side = 0 GROUP BY 1),
status AS (SELECT old_id, new_id, coalesce(score, 0::FLOAT) AS score, CASE WHEN new_id IS NULL THEN 'UnresolvedOld' WHEN score - second <= 0.03::FLOAT THEN 'Conflict' WHEN score >= 0.8::FLOAT THEN 'Matched' ELSE 'LowConfidence' END AS status FROM best),
claims AS (SELECT new_id FROM status WHERE status IN ('Matched', 'LowConfidence', 'Conflict') GROUP BY 1 HAVING count(*) > 1),
shared AS (SELECT old_id, s.new_id, score, CASE WHEN c.new_id IS NOT NULL AND status IN ('Matched', 'LowConfidence', 'Conflict') THEN 'Conflict' ELSE status END AS status, c.new_id IS NOT NULL AS is_shared FROM status s LEFT JOIN claims c ON c.new_id = s.new_id)"""


@query(f"WITH {_PAIRS} SELECT old_id, new_id, round(score::DOUBLE, 6) AS score, status FROM status")
def match_status(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _document_matches(spark, d)
    return rows.select(F.col("old_class_id").alias("old_id"), F.col("new_class_id").alias("new_id"), rounded(F.col("score")).alias("score"), "status")


@query(f"WITH {_PAIRS} SELECT old_id, new_id, n_shared FROM pairs")
def rare_anchor_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _document_pairs(spark, d)[2]


@query(f"WITH {DOC_SQL} SELECT token AS value, old_df, new_df FROM rare")
def rare_anchors(spark: SparkSession, d: str) -> DataFrame:
    return A.rare_anchors(documents(spark, d, 0), documents(spark, d, 1), STRINGS).select("value", "old_df", "new_df")


@query(f"WITH {DOC_SQL} SELECT token AS value, count(*) AS df FROM useful GROUP BY 1")
def anchor_frequency(spark: SparkSession, d: str) -> DataFrame:
    both = documents(spark, d, 0).unionByName(documents(spark, d, 1))
    return A.anchor_frequency(both, STRINGS).select("value", "df")


@query(f"WITH {DOC_SQL} SELECT d.doc_id, len(toks)::BIGINT AS n_tokens, (SELECT count(*) FROM useful u WHERE u.doc_id = d.doc_id) AS n_useful FROM doc d")
def useful_anchor_filter(spark: SparkSession, d: str) -> DataFrame:
    both = documents(spark, d, 0).unionByName(documents(spark, d, 1))
    return both.select(F.col("class_id").alias("doc_id"), F.size("strings").cast("long").alias("n_tokens"), F.size(F.filter("strings", P.is_useful_anchor)).cast("long").alias("n_useful"))


@query(f"WITH {_PAIRS} SELECT old_id, new_id, rk AS rank, round(score::DOUBLE, 6) AS score FROM ranked WHERE rk <= 3")
def topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    tops = D.top_candidates(_scored_documents(spark, d)[2], 3)
    x = tops.select("old_id", F.posexplode("candidates").alias("pos", "c"))
    return x.select("old_id", F.col("c.entity_id").alias("new_id"), (F.col("pos") + 1).cast("long").alias("rank"), rounded(F.col("c.score")).alias("score"))


@query(f"WITH {_PAIRS} SELECT old_id, new_id, status, is_shared FROM shared WHERE new_id IS NOT NULL")
def shared_target_conflict(spark: SparkSession, d: str) -> DataFrame:
    rows = D.mark_shared(_document_matches(spark, d)[0]).where("new_class_id is not null")
    return rows.select(F.col("old_class_id").alias("old_id"), F.col("new_class_id").alias("new_id"), "status", P.has_reason(F.col("reasons"), D.SHARED).alias("is_shared"))


@query(f"WITH {_PAIRS} SELECT doc_id AS new_id FROM doc WHERE side = 1 AND doc_id NOT IN (SELECT new_id FROM shared WHERE new_id IS NOT NULL AND status <> 'UnresolvedOld')")
def unresolved_new(spark: SparkSession, d: str) -> DataFrame:
    rows, new = _document_matches(spark, d)
    return D.unresolved_new(D.mark_shared(rows), new.select(F.col("class_id").alias("new_id")), D.NO_OLD).select(F.col("new_class_id").alias("new_id"))


@query(f"WITH {_PAIRS} SELECT old_id FROM status WHERE status = 'UnresolvedOld'")
def unresolved_old(spark: SparkSession, d: str) -> DataFrame:
    return _document_matches(spark, d)[0].where("status = 'UnresolvedOld'").select(F.col("old_class_id").alias("old_id"))


@query(f"WITH {_PAIRS} SELECT status, count(*) AS n, round(min(score)::DOUBLE, 6) AS least, round(max(score)::DOUBLE, 6) AS most FROM shared GROUP BY status")
def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = D.mark_shared(_document_matches(spark, d)[0])
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), rounded(F.min("score")).alias("least"), rounded(F.max("score")).alias("most"))


@query(f"WITH {_PAIRS} SELECT old_id, status, row_number() OVER w AS row_in_section, ((row_number() OVER w - 1) // 50)::BIGINT AS chunk FROM shared WINDOW w AS (PARTITION BY status ORDER BY old_id)")
def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = D.mark_shared(_document_matches(spark, d)[0])
    n = F.row_number().over(Window.partitionBy("status").orderBy("old_class_id"))
    return rows.select(F.col("old_class_id").alias("old_id"), "status", n.cast("long").alias("row_in_section"), F.floor((n - 1) / 50).alias("chunk"))


def _halves(spark: SparkSession, d: str) -> DataFrame:
    old, new = suppliers(spark, d, False), suppliers(spark, d, True)
    return old.select(F.col("class_id"), F.struct(*old.columns).alias("old")).join(new.select("class_id", F.struct(*new.columns).alias("new")), "class_id")


_HALVES = f"WITH {supplier_sql('o', False)},{supplier_sql('n', True)}"


@query(f"{_HALVES} SELECT class_id, round(({jaccard_sql('o.strings', 'n.strings')})::DOUBLE, 6) AS jaccard FROM o JOIN n USING (class_id)")
def jaccard_supplier_halves(spark: SparkSession, d: str) -> DataFrame:
    return _halves(spark, d).select("class_id", rounded(S.jaccard(F.col("old.strings"), F.col("new.strings"))).alias("jaccard"))


@query(f"{_HALVES} SELECT class_id, round(({jaccard_sql('o.field_ref_shapes', 'n.field_ref_shapes', 0.0)})::DOUBLE, 6) AS empty_signal, round(({jaccard_sql('o.method_shapes', 'n.method_shapes', 0.0)})::DOUBLE, 6) AS signal, CASE WHEN o.superclass IS NOT DISTINCT FROM n.superclass THEN 1.0 ELSE 0.0 END::DOUBLE AS same_superclass, CASE WHEN o.descriptor = n.descriptor THEN 1.0 ELSE 0.0 END::DOUBLE AS same_descriptor FROM o JOIN n USING (class_id)")
def signal_jaccard_supplier_halves(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("old"), F.col("new")
    return _halves(spark, d).select(
        "class_id", rounded(S.signal_jaccard(a["field_ref_shapes"], b["field_ref_shapes"])).alias("empty_signal"), rounded(S.signal_jaccard(a["method_shapes"], b["method_shapes"])).alias("signal"),
        S.exact_option(a["superclass"], b["superclass"]).cast("double").alias("same_superclass"), S.equal_score(a["descriptor"], b["descriptor"]).cast("double").alias("same_descriptor"),
    )


@query(
    f"""WITH e AS (SELECT user_id, ts >= TIMESTAMP '2024-01-16' AS late, event_type, count(*) AS n FROM events GROUP BY ALL),
h AS (SELECT user_id, list({{'op': event_type, 'n': n}} ORDER BY event_type) FILTER (NOT late) AS a, list({{'op': event_type, 'n': n}} ORDER BY event_type) FILTER (late) AS b FROM e GROUP BY 1)
SELECT user_id, round(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE ({cosine_sql('a', 'b')})::DOUBLE END, 5) AS cosine FROM h"""
)
def histogram_cosine_user_events(spark: SparkSession, d: str) -> DataFrame:
    late = (F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).alias("late")
    e = table(spark, d, "events").groupBy("user_id", late, F.col("event_type").alias("op")).agg(F.count(F.lit(1)).alias("n"))
    rows = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.struct("op", "n"))))
    h = e.groupBy("user_id").agg(rows(~F.col("late")).alias("a"), rows(F.col("late")).alias("b"))
    return h.select("user_id", F.round(S.histogram_cosine(F.col("a"), F.col("b")).cast("double"), 5).alias("cosine"))


@query("""WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01') AS a, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01') AS b FROM orders GROUP BY 1)
SELECT o_custkey, a, b, round(CASE WHEN a = 0 AND b = 0 THEN 1.0 ELSE (least(a, b)::DOUBLE / greatest(a, b))::FLOAT END::DOUBLE, 6) AS ratio FROM o""")
def bounded_ratio_orders(spark: SparkSession, d: str) -> DataFrame:
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(early).alias("a"), F.count_if(~early).alias("b"))
    return o.select("o_custkey", "a", "b", rounded(S.bounded_ratio(F.col("a"), F.col("b"))).alias("ratio"))


@query(r"""SELECT page_id, array_to_string(list_transform(string_split(regexp_extract(url, '^[a-z]+://(.*)$', 1), '/'), lambda s: CASE WHEN regexp_full_match(s, '[a-z]{0,2}') THEN '*' ELSE s END), '/') AS shape FROM pages""")
def package_shape_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.shape_of_path(F.regexp_extract("url", r"^[a-z]+://(.*)$", 1), "/").alias("shape"))


@query("""WITH p AS (SELECT p_partkey, 'L' || replace(p_type, ' ', '/') || ';' AS descriptor, replace(p_name, ' ', '.') AS asked FROM part)
SELECT p_partkey, replace(descriptor[2:-2], '/', '.') AS java_name, descriptor[2:-2] AS path,
  CASE WHEN asked LIKE 'L%;' THEN asked WHEN replace(asked, '.', '/') LIKE 'L%' THEN replace(asked, '.', '/') || ';' ELSE 'L' || replace(asked, '.', '/') || ';' END AS wanted,
  coalesce(CASE WHEN contains(replace(descriptor[2:-2], '/', '.'), '.') THEN regexp_extract(replace(descriptor[2:-2], '/', '.'), '^(.*)[.][^.]*$', 1) END, '') AS package_text FROM p""")
def class_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("L"), F.translate("p_type", " ", "/"), F.lit(";")).alias("c"), F.translate("p_name", " ", ".").alias("asked"))
    return p.select("p_partkey", T.descriptor_to_java_name(F.col("c")).alias("java_name"), T.descriptor_to_path(F.col("c")).alias("path"), T.normalize_class_query(F.col("asked")).alias("wanted"), F.coalesce(T.java_package(F.col("c")), F.lit("")).alias("package_text"))


@query("SELECT o.o_orderkey AS old_id, p.p_partkey AS new_id FROM (SELECT o_orderkey, (SELECT p_name FROM part WHERE p_partkey = 1 + o_orderkey % (SELECT count(*) FROM part)) AS descriptor FROM orders) o JOIN (SELECT p_name, max(p_partkey) AS p_partkey FROM part GROUP BY 1) p ON p.p_name = o.descriptor")
def exact_join_last_wins(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    n = part.agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders").select("o_orderkey").join(n).select(F.col("o_orderkey").alias("class_id"), (1 + F.col("o_orderkey") % F.col("n")).alias("p_partkey"))
    old = o.join(part.select("p_partkey", F.col("p_name").alias("descriptor")), "p_partkey")
    return C.exact_pairs(old, part.select(F.col("p_partkey").alias("class_id"), F.col("p_name").alias("descriptor")))


_COUNTS = """c AS (SELECT l_suppkey AS id, 'L' || l_suppkey || ';' AS descriptor, l_shipdate >= TIMESTAMP '1998-06-01' AS late, count(DISTINCT l_linenumber) AS m, count(DISTINCT l_quantity::INT % 13) AS f FROM lineitem GROUP BY ALL),
met AS (SELECT o.id AS old_id, n.id AS new_id, n.m, n.f, n.descriptor FROM c o JOIN c n ON NOT o.late AND n.late AND abs(o.m - n.m) <= greatest(o.m, 4) // 2 AND abs(o.f - n.f) <= greatest(o.f, 4) // 2)"""


def _count_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    l = table(spark, d, "lineitem").withColumn("late", F.col("l_shipdate") >= CUT)
    numbered = lambda c: F.transform(F.sort_array(F.collect_set(c.cast("string"))), lambda x: x)
    x = l.groupBy("l_suppkey", "late").agg(numbered(F.col("l_linenumber")).alias("method_shapes"), numbered(F.col("l_quantity").cast("int") % 13).alias("field_shapes"))
    x = x.select(F.col("l_suppkey").alias("class_id"), F.concat(F.lit("L"), F.col("l_suppkey").cast("string"), F.lit(";")).alias("descriptor"), "late", "method_shapes", "field_shapes")
    return x.where(~F.col("late")), x.where("late")


@query(f"WITH {DOC_SQL} SELECT DISTINCT a.doc_id AS old_id, b.doc_id AS new_id FROM useful a JOIN rare USING (token) JOIN useful b USING (token) WHERE a.side = 0 AND b.side = 1")
def rare_join(spark: SparkSession, d: str) -> DataFrame:
    """The blocking join through rare anchors, over documents that have strings only."""
    none = [F.array().cast("array<string>").alias(c) for c in ("method_ref_shapes", "field_ref_shapes", "method_proto_shapes", "field_type_shapes")]
    old, new = (documents(spark, d, side).select("*", *none) for side in (0, 1))
    return C.rare_candidates(old, new, A.rare_anchors(old, new, STRINGS)).select("old_id", "new_id").distinct()


@query("SELECT s_suppkey AS old_id, new_id FROM supplier, (SELECT p_partkey AS new_id FROM part ORDER BY p_name, p_partkey LIMIT 7) WHERE s_suppkey % 2 = 0")
def fallback_join(spark: SparkSession, d: str) -> DataFrame:
    """Entities that nothing else met, with the first ones of the other side by descriptor; the limit is the feature."""
    left = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("old_id"))
    return C.fallback_pairs(left, table(spark, d, "part").select(F.col("p_partkey").alias("class_id"), F.col("p_name").alias("descriptor")), 7)


@query("""WITH s AS (SELECT o_custkey AS old_id, o_orderkey AS new_id, (o_orderkey % 50)::FLOAT / 50::FLOAT AS score, o_orderkey % 4 AS k FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY score DESC, new_id) AS rk FROM s WHERE score >= 0.5::FLOAT),
b AS (SELECT c_custkey AS old_id, max(new_id) FILTER (rk = 1) AS new_id, max(score) FILTER (rk = 1) AS score, max(k) FILTER (rk = 1) AS k, max(score) FILTER (rk = 2) AS score2, max(k) FILTER (rk = 2) AS k2 FROM customer LEFT JOIN r ON old_id = c_custkey GROUP BY 1)
SELECT old_id, new_id, CASE WHEN new_id IS NULL THEN 'UnresolvedOld' WHEN k = 1 THEN 'SemanticBreak' WHEN k = 2 OR (score2 IS NOT NULL AND score - score2 <= 0.03::FLOAT AND NOT (k = 0 AND k2 <> 0)) THEN 'Conflict'
  WHEN k <> 0 THEN 'LowConfidence' WHEN score >= 0.8::FLOAT THEN 'Matched' ELSE 'LowConfidence' END AS status FROM b""")
def class_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Orders as candidates of their customer, scored by their number: the status chain of classes."""
    k = F.col("o_orderkey") % 4
    reason = F.when(k == 0, "verified: x").when(k == 1, P.SEMANTIC_BREAK).when(k == 2, P.WEAK_SHAPE).otherwise("same descriptor")
    score = S.f32((F.col("o_orderkey") % 50).cast("float") / F.lit(50.0).cast("float"))
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("old_id"), F.col("o_orderkey").alias("new_id"), score.alias("score"), F.array(reason).alias("reasons")).where(F.col("score") >= S.f32(0.5))
    m = D.decided(table(spark, d, "customer").select(F.col("c_custkey").alias("old_id")), D.top_candidates(s, 5), D.MatchConfig())
    return m.select(F.col("old_class_id").alias("old_id"), F.col("new_class_id").alias("new_id"), "status")


_FIELDS_SQL = """WITH m AS (SELECT DISTINCT l_suppkey AS c, l_shipdate >= TIMESTAMP '1998-06-01' AS late, 'f' || l_linenumber || CASE WHEN l_shipdate >= TIMESTAMP '1998-06-01' AND l_suppkey % 3 = 0 THEN 'x' ELSE '' END AS name, l_returnflag || l_linestatus AS type FROM lineitem),
i AS (SELECT *, row_number() OVER (PARTITION BY late ORDER BY c, name, type) AS id FROM m),
pairs AS (SELECT c FROM i GROUP BY 1 HAVING bool_or(late) AND bool_or(NOT late)),
s AS (SELECT o.c, o.id AS old_id, n.id AS new_id, CASE WHEN o.name = n.name THEN 0.4::FLOAT ELSE 0::FLOAT END + CASE WHEN o.type = n.type THEN 0.6::FLOAT ELSE 0::FLOAT END AS score
  FROM i o JOIN pairs USING (c) JOIN i n ON n.c = o.c AND n.late AND NOT o.late),
r AS (SELECT *, row_number() OVER (PARTITION BY c, old_id ORDER BY score DESC, new_id) AS rk FROM s WHERE score >= 0.55::FLOAT),
b AS (SELECT c, i.id AS old_id, max(new_id) FILTER (rk = 1) AS new_id, max(score) FILTER (rk = 1) AS score, max(score) FILTER (rk = 2) AS score2 FROM i JOIN pairs USING (c) LEFT JOIN r ON r.old_id = i.id AND r.c = i.c WHERE NOT late GROUP BY ALL),
t AS (SELECT c AS class_id, old_id, new_id, coalesce(score, 0::FLOAT) AS score, CASE WHEN new_id IS NULL THEN 'UnresolvedOld' WHEN score2 IS NOT NULL AND score - score2 <= 0.03::FLOAT THEN 'Conflict' WHEN score >= 0.8::FLOAT THEN 'Matched' ELSE 'LowConfidence' END AS status FROM b)
SELECT class_id, old_id, new_id, round(score::DOUBLE, 5) AS score, status FROM t
UNION ALL SELECT c, NULL, id, 0.0, 'UnresolvedNew' FROM i JOIN pairs USING (c) WHERE late AND id NOT IN (SELECT new_id FROM t WHERE new_id IS NOT NULL)"""


@query(_FIELDS_SQL)
def member_match_fields(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as classes, line numbers with flags as their fields, before and after the cut: the match of members."""
    late, s = F.col("l_shipdate") >= CUT, F.col("l_suppkey")
    name = F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.when(late & (s % 3 == 0), "x").otherwise(""))
    m = table(spark, d, "lineitem").select(s.alias("id"), late.alias("late"), name.alias("name"), F.concat("l_returnflag", "l_linestatus").alias("type")).distinct()
    # ids run over a side's members by class: numbers in a class, and what the classes before it have
    counts = m.groupBy("late", "id").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("late", "id", (F.sum("n").over(Window.partitionBy("late").orderBy("id")) - F.col("n")).alias("before"))
    m = m.withColumn("k", F.row_number().over(Window.partitionBy("late", "id").orderBy("name", "type"))).join(before, ["late", "id"])
    one = F.struct((F.col("before") + F.col("k")).alias("id"), F.concat(F.lit("L"), F.col("id").cast("string"), F.lit(";")).alias("owner_class"), "name", F.col("type").alias("field_type"), F.lit(1).cast("bigint").alias("access_flags"))
    side = lambda c: m.where(c).groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("fields"))
    old, new = side(~F.col("late")), side(F.col("late"))
    matches = old.select(F.col("id").alias("old_class_id")).join(new.select(F.col("id").alias("new_class_id")), F.col("old_class_id") == F.col("new_class_id")).withColumn("status", F.lit("Matched"))
    x = MB.matched_members(matches, old, new, "fields")
    return x.select(F.col("old_class_id").alias("class_id"), F.col("old_member_id").alias("old_id"), F.col("new_member_id").alias("new_id"), F.round(F.col("score").cast("double"), 5).alias("score"), "status")


@query(f"WITH {_COUNTS} SELECT old_id, new_id FROM met")
def count_band_join(spark: SparkSession, d: str) -> DataFrame:
    return C.band_pairs(*_count_sides(spark, d))


@query(f"WITH {_COUNTS} SELECT old_id, new_id FROM (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY m, f, descriptor, new_id) AS rn FROM met) WHERE rn <= 7")
def candidate_scan_cap(spark: SparkSession, d: str) -> DataFrame:
    return C.scan(C.first_band_candidates(*_count_sides(spark, d), 7), 7)


@query(f"""{_HALVES}, po AS (SELECT class_id AS new_id, descriptor, unnest(range(1, len(method_ref_shapes) + 1)) AS i, method_ref_shapes FROM n),
post AS (SELECT new_id, descriptor, method_ref_shapes[i] AS v FROM po), ok AS (SELECT v FROM post GROUP BY 1 HAVING count(*) <= 8192),
probe AS (SELECT class_id AS old_id, unnest(method_ref_shapes[1:32]) AS v FROM o)
SELECT DISTINCT old_id, new_id FROM probe JOIN ok USING (v) JOIN post USING (v)
UNION SELECT DISTINCT old_id, new_id FROM (SELECT class_id AS old_id, unnest(list_filter(strings, lambda s: strlen(s) >= 4)[1:32]) AS v FROM o) JOIN (SELECT class_id AS new_id, unnest(strings) AS v FROM n) USING (v)
UNION SELECT DISTINCT old_id, new_id FROM (SELECT class_id AS old_id, unnest(method_proto_shapes[1:16]) AS v FROM o) JOIN (SELECT class_id AS new_id, unnest(method_proto_shapes) AS v FROM n) USING (v)""")
def anchor_candidates_capped(spark: SparkSession, d: str) -> DataFrame:
    return C.anchor_candidates(suppliers(spark, d, False), suppliers(spark, d, True), C.scan_limit(10)).select("old_id", "new_id").distinct()


def _rule_sql() -> str:
    """Scores and rules of supplier pairs, as the operator's chain."""
    sims = {
        "descriptor": "CASE WHEN o.descriptor = n.descriptor THEN 1::FLOAT ELSE 0::FLOAT END", "superclass": "CASE WHEN o.superclass IS NOT DISTINCT FROM n.superclass THEN 1::FLOAT ELSE 0::FLOAT END",
        **{k: jaccard_sql(f"o.{c}", f"n.{c}") for k, c in {"interfaces": "interfaces", "method": "method_shapes", "field": "field_shapes", "proto": "method_proto_shapes", "ftype": "field_type_shapes"}.items()},
        "package": "CASE WHEN o.package_shape = n.package_shape THEN 1::FLOAT ELSE 0::FLOAT END", **{k: jaccard_sql(f"o.{c}", f"n.{c}", 0.0) for k, c in {"string": "strings", "mref": "method_ref_shapes", "fref": "field_ref_shapes"}.items()},
        "instr": "(least(o.instruction_count, n.instruction_count)::DOUBLE / greatest(o.instruction_count, n.instruction_count))::FLOAT", "opcode": cosine_sql("o.opcode_histogram", "n.opcode_histogram"),
    }
    cols = ", ".join(f"{e} AS s_{k}" for k, e in sims.items())
    total = " + ".join(f"s_{k} * {w}::FLOAT" for k, w in SC.WEIGHTS.items())
    kinds = {"string": "strings", "method_ref": "method_ref_shapes", "field_ref": "field_ref_shapes", "method_proto": "method_proto_shapes", "field_type": "field_type_shapes"}
    df = " UNION ALL ".join(f"SELECT '{side}' AS side, '{k}' AS kind, unnest({c}) AS v FROM {side}" for side in "on" for k, c in kinds.items())
    counts = ", ".join(f"count(*) FILTER (x.kind = '{k}') AS r_{k}" for k in kinds)
    every = " AND ".join(f"o.{c} IS NOT DISTINCT FROM n.{c}" for c in ("descriptor", "package_shape", "superclass", "access_flags", "interfaces", "method_shapes", "method_proto_shapes", "field_shapes", "field_type_shapes", "strings", "method_ref_shapes", "field_ref_shapes", "class_ref_shapes", "instruction_count", "opcode_histogram"))
    api = " AND ".join(f"o.{c} = n.{c}" for c in SC.API)
    same, flags, big = "o.descriptor = n.descriptor", "o.access_flags = n.access_flags", "(len(o.method_shapes) + len(o.field_shapes) >= 2 OR len(o.method_proto_shapes) + len(o.field_type_shapes) >= 3 OR o.instruction_count >= 20 OR len(o.strings) + len(o.method_ref_shapes) + len(o.field_ref_shapes) >= 2)"
    least = lambda **kw: " AND ".join(f"s_{k} >= {v}::FLOAT" for k, v in kw.items())
    sparse = "(len(o.strings) = 0 OR s_string >= 0.7::FLOAT) AND (len(o.method_ref_shapes) = 0 OR s_mref >= 0.7::FLOAT) AND (len(o.field_ref_shapes) = 0 OR s_fref >= 0.7::FLOAT)"
    own = [f"(CASE WHEN len(o.{c}) = 0 THEN 0::FLOAT ELSE s_{k} END)" for c, k in zip(SC.REFS, ("string", "mref", "fref"), strict=True)]
    strong = f"(greatest({', '.join(own)}) >= 0.8::FLOAT OR {' + '.join(own)} >= 1.35::FLOAT)"
    shape = "s_proto >= 0.7::FLOAT AND s_ftype >= 0.6::FLOAT AND s_instr >= 0.6::FLOAT AND s_opcode >= 0.7::FLOAT"
    sum_r, num_r = " + ".join(f"r_{k}" for k in kinds), " + ".join(f"(r_{k} > 0)::INT" for k in kinds)
    return f"""{_HALVES},
a AS ({df}), f AS (SELECT kind, v FROM a WHERE strlen(v) >= 4 AND NOT regexp_full_match(v, '[0-9]+') GROUP BY 1, 2 HAVING count(*) FILTER (side = 'o') BETWEEN 1 AND 3 AND count(*) FILTER (side = 'n') BETWEEN 1 AND 3),
k AS (SELECT o.class_id AS oid, unnest([o.class_id, o.class_id + 1, o.class_id + 3]) AS nid FROM o),
vals AS (SELECT side, kind, v, id FROM ({" UNION ALL ".join(f"SELECT '{side}' AS side, '{k}' AS kind, unnest({c}) AS v, class_id AS id FROM {side}" for side in "on" for k, c in kinds.items())}) JOIN f USING (kind, v)),
r AS (SELECT oid, nid, {counts} FROM k JOIN vals x ON x.side = 'o' AND x.id = oid JOIN vals y ON y.side = 'n' AND y.id = nid AND y.v = x.v AND y.kind = x.kind, (SELECT 1) GROUP BY 1, 2),
s AS (SELECT o.*, n.class_id AS nid, {every} AS r_exact, {same} AND {flags} AND o.superclass IS NOT DISTINCT FROM n.superclass AND o.interfaces = n.interfaces AND {api} AND {big} AS r_api, {same} AS same, {flags} AS same_flags, {big} AS big,
  NOT ({same}) AND {flags} AND {api} AND o.strings = n.strings AND o.method_ref_shapes = n.method_ref_shapes AND o.field_ref_shapes = n.field_ref_shapes AND o.instruction_count = n.instruction_count AND o.opcode_histogram = n.opcode_histogram AND {big} AS r_renamed, {cols}
  FROM k JOIN o ON o.class_id = oid JOIN n ON n.class_id = nid),
t AS (SELECT o.class_id AS old_id, o.nid AS new_id, same, {total} AS base, coalesce({sum_r}, 0) AS total, coalesce({num_r}, 0) AS kinds, CASE WHEN r_exact THEN 'exact' WHEN r_api THEN 'api'
  WHEN same AND same_flags AND {least(superclass=0.99, interfaces=0.95, method=0.90, field=0.90, instr=0.95, opcode=0.98)} AND {sparse} AND big THEN 'code'
  WHEN same AND same_flags AND {least(superclass=0.99, interfaces=0.95, proto=0.95, ftype=0.95, instr=0.92, opcode=0.96)} AND {strong} AND big THEN 'proto_code'
  WHEN r_renamed THEN 'renamed' WHEN NOT same AND same_flags AND {least(proto=0.98, ftype=0.98, instr=0.95, opcode=0.98)} AND {strong} AND big THEN 'renamed_anchor'
  WHEN (coalesce({num_r}, 0) >= 2 OR coalesce({sum_r}, 0) >= 3) AND {shape} THEN 'rare' END AS rule
  FROM s o LEFT JOIN r ON r.oid = o.class_id AND r.nid = o.nid),
u AS (SELECT *, greatest(base, CASE rule WHEN 'exact' THEN 1.0 WHEN 'api' THEN 0.96 WHEN 'code' THEN 0.94 WHEN 'proto_code' THEN 0.92 WHEN 'renamed' THEN 0.93 WHEN 'renamed_anchor' THEN 0.90 WHEN 'rare' THEN CASE WHEN kinds >= 3 OR total >= 4 THEN 0.95 WHEN total >= 3 THEN 0.93 ELSE 0.91 END ELSE 0.0 END::FLOAT) AS v FROM t)
SELECT old_id, new_id, round(CASE WHEN same AND rule IS NULL AND v < 0.82::FLOAT THEN 0.82::FLOAT ELSE v END::DOUBLE, 4) AS score, coalesce(rule, '') AS rule FROM u"""


@query(_rule_sql())
def verification_rules(spark: SparkSession, d: str) -> DataFrame:
    old, new = suppliers(spark, d, False), suppliers(spark, d, True)
    rare = A.rare_anchors(old, new)
    k = F.col("class_id")
    pairs = old.select(k.alias("old_id"), F.explode(F.array(k, k + 1, k + 3)).alias("new_id")).join(new.select(k.alias("new_id")), "new_id")
    scored = SC.score_pairs(pairs, A.with_rare(old, rare), A.with_rare(new, rare))
    return scored.select("old_id", "new_id", F.round(F.col("score").cast("double"), 4).alias("score"), F.coalesce("rule", F.lit("")).alias("rule"))


@query()
def class_match_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """The whole class match, graph passes included; its parts have SQL of their own."""
    m = D.match_classes(suppliers(spark, d, False), suppliers(spark, d, True), D.MatchConfig(verified_only=False))
    return m.select("old_class_id", "new_class_id", rounded(F.col("score"), 4).alias("score"), "status", F.array_join("reasons", "; ").alias("reasons"))


@query(f"""{_HALVES} SELECT o.class_id AS old_class_id, n.new_id AS new_class_id,
CASE WHEN n.new_id IS NULL THEN 'UnresolvedOld' WHEN n.access_flags <> o.access_flags THEN 'SemanticBreak' ELSE 'candidate' END AS kind
FROM o LEFT JOIN (SELECT descriptor, max(class_id) AS new_id, max(access_flags) AS access_flags FROM n GROUP BY 1) n USING (descriptor)""")
def exact_match_kinds(spark: SparkSession, d: str) -> DataFrame:
    m = D.match_exact(suppliers(spark, d, False), suppliers(spark, d, True)).where("old_class_id is not null")
    kind = F.when(F.col("status").isin("UnresolvedOld", "SemanticBreak"), F.col("status")).otherwise("candidate")
    return m.select("old_class_id", "new_class_id", kind.alias("kind"))


@query("""WITH RECURSIVE e AS (SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS src, 'c' || conv_id || '-' || (turn - 1) AS dst FROM conversations),
w AS (SELECT src AS start, src AS node, 1 AS ord FROM e UNION ALL SELECT w.start, e.dst, w.ord + 1 FROM w JOIN e ON e.src = w.node)
SELECT start, node, ord FROM w""")
def hierarchy_search_order(spark: SparkSession, d: str) -> DataFrame:
    name = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    e = table(spark, d, "conversations").select(name(F.col("turn")).alias("src"), name(F.col("turn") - 1).alias("dst"), F.lit(0).alias("ord"))
    return ancestors(e, e.select(F.col("src").alias("node")).distinct())


@query("SELECT p_partkey, (p_type LIKE 'PROMO%' OR p_type LIKE 'STANDARD%') AND NOT (p_type LIKE 'PROMO B%') AS excluded FROM part")
def prefix_policy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", P.is_excluded(F.col("p_type"), ("PROMO", "STANDARD"), ("PROMO B",)).alias("excluded"))


def _audit(spark: SparkSession, d: str, mapping: DataFrame | None = None) -> DataFrame:
    """Line items, all of them, as method references: owner is the part, name its line status, prototype its return flag.
    Definitions come from the parts up to size 40; larger parts are the owners that a reference doesn't find."""
    l, part = table(spark, d, "lineitem"), table(spark, d, "part")
    owner = lambda k: F.concat(F.lit("Lp/"), k.cast("string"), F.lit(";"))
    text = lambda v: F.lit(v)
    none = F.lit(None).cast("string")
    # equal references are one site with a number
    g = l.groupBy("l_partkey", "l_linestatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    sites = g.select(
        F.xxhash64("l_partkey", "l_linestatus", "l_returnflag").alias("site_id"), text("method").alias("kind"), owner(F.col("l_partkey")).alias("owner"), F.col("l_linestatus").alias("name"),
        F.array().cast("array<string>").alias("params"), F.col("l_returnflag").alias("ret"), text("virtual").alias("dispatch"), text("base").alias("part"), text("d1").alias("dex"),
        text("S").alias("source_class"), text("m").alias("source_method"), F.lit(0).cast("bigint").alias("offset"), F.lit(False).alias("standalone"),
    )
    p = part.where("p_size <= 40")
    where = F.when(F.col("p_size") % 2 == 0, "base").otherwise("split")
    classes = p.select(owner(F.col("p_partkey")).alias("descriptor"), F.lit(0).alias("load_ord"), where.alias("part"), text("d1").alias("dex"), none.alias("superclass"), F.array().cast("array<string>").alias("interfaces"))
    m = p.select(owner(F.col("p_partkey")).alias("owner"), F.explode(F.when(F.col("p_size") % 3 == 0, F.array(F.lit("O"))).otherwise(F.array(F.lit("O"), F.lit("F")))).alias("name"), "p_size")
    methods = m.select("owner", "name", F.array().cast("array<string>").alias("params"), F.when((F.col("p_size") % 4 == 0) & (F.col("name") == "O"), "A").otherwise(F.when(F.col("name") == "O", "N").otherwise("R")).alias("ret"), (F.col("p_size") % 5 == 0).alias("is_static"), F.lit(False).alias("is_direct"), F.lit(0).alias("load_ord"))
    fields = m.limit(0).select("owner", "name", F.col("name").alias("type"), F.lit(False).alias("is_static"), F.lit(0).alias("load_ord"))
    return AU.audit(sites, classes, methods, fields, ignore=("Lp/9",), include=("Lp/99",), mapping=mapping)


_AUDIT_SQL = """
WITH site AS (SELECT DISTINCT l_partkey AS k, 'Lp/' || l_partkey || ';' AS owner, l_linestatus AS name, l_returnflag AS ret FROM lineitem),
def AS (SELECT p_partkey AS k, p_size, CASE WHEN p_size % 2 = 0 THEN 'base' ELSE 'split' END AS part FROM part WHERE p_size <= 40),
meth AS (SELECT k, name, CASE WHEN p_size % 4 = 0 AND name = 'O' THEN 'A' WHEN name = 'O' THEN 'N' ELSE 'R' END AS ret, p_size % 5 = 0 AS is_static FROM (SELECT k, p_size, unnest(CASE WHEN p_size % 3 = 0 THEN ['O'] ELSE ['O', 'F'] END) AS name FROM def)),
x AS (SELECT s.*, d.part, d.k IS NOT NULL AS known, (owner LIKE 'Lp/9%') AND NOT (owner LIKE 'Lp/99%') AS excluded, m.ret AS m_ret, m.is_static FROM site s LEFT JOIN def d USING (k) LEFT JOIN meth m ON m.k = s.k AND m.name = s.name),
y AS (SELECT *, CASE WHEN excluded THEN 'excluded' WHEN known AND m_ret = ret AND NOT is_static THEN 'resolved' ELSE 'unresolved' END AS outcome FROM x),
z AS (SELECT owner || '->' || name || '()' || ret AS reference, outcome, CASE WHEN outcome <> 'unresolved' THEN NULL WHEN NOT known THEN 'missing_owner' WHEN m_ret = ret AND is_static THEN 'member_kind_mismatch' WHEN m_ret IS NOT NULL THEN 'changed_prototype' ELSE 'missing_method' END AS reason,
 outcome = 'resolved' AND part <> 'base' AS another_split, CASE WHEN m_ret IS NOT NULL THEN owner || '->' || name || '()' || m_ret ELSE '' END AS candidate FROM y)"""


@query(_AUDIT_SQL + " SELECT reference, outcome, coalesce(reason, '') AS reason, another_split, CASE WHEN outcome = 'unresolved' THEN candidate ELSE '' END AS candidates FROM z")
def reference_audit_sites(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).select("reference", "outcome", F.coalesce("reason", F.lit("")).alias("reason"), "another_split", F.coalesce(F.array_join("candidates", " | "), F.lit("")).alias("candidates"))


@query(_AUDIT_SQL + " SELECT reason, count(*) AS n FROM z WHERE outcome = 'unresolved' GROUP BY 1")
def reference_audit_reasons(spark: SparkSession, d: str) -> DataFrame:
    return AU.reason_counts(_audit(spark, d))


@query(_AUDIT_SQL + " SELECT count(*) AS references_scanned, count(*) FILTER (outcome = 'excluded') AS references_excluded, count(*) FILTER (outcome = 'resolved') AS references_resolved, count(*) FILTER (another_split) AS resolved_in_another_split, count(*) FILTER (outcome = 'unresolved') AS unresolved_references FROM z")
def reference_audit_pass(spark: SparkSession, d: str) -> DataFrame:
    return AU.audit_counts(_audit(spark, d))


@query("""WITH def AS (SELECT DISTINCT 'Lu/' || user_id || ';' AS owner, event_type AS name, 'T' || user_id % 3 AS type, user_id % 4 = 0 AS is_static FROM events WHERE user_id % 5 <> 0),
site AS (SELECT DISTINCT 'Lu/' || user_id || ';' AS owner, event_type AS name, 'T' || event_id % 4 AS type, event_id % 2 = 0 AS is_static FROM events),
known AS (SELECT DISTINCT owner FROM def),
f AS (SELECT 'field' AS kind, s.owner || '->' || s.name || ':' || s.type AS reference, CASE WHEN s.is_static THEN 'static' ELSE 'instance' END AS dispatch,
  CASE WHEN k.owner IS NULL THEN 'missing_owner' WHEN d.owner IS NULL THEN 'missing_field' WHEN d.type <> s.type THEN 'changed_descriptor'
       WHEN s.is_static OR NOT d.is_static THEN CASE WHEN s.is_static = d.is_static THEN '' ELSE 'member_kind_mismatch' END ELSE 'member_kind_mismatch' END AS reason
  FROM site s LEFT JOIN known k USING (owner) LEFT JOIN def d ON d.owner = s.owner AND d.name = s.name),
c AS (SELECT DISTINCT 'class' AS kind, 'Lu/' || user_id || ';' AS reference, '' AS dispatch, CASE WHEN user_id % 5 = 0 THEN 'missing_owner' ELSE '' END AS reason FROM events)
SELECT kind, reference, dispatch, reason FROM f UNION ALL SELECT * FROM c""")
def reference_audit_fields(spark: SparkSession, d: str) -> DataFrame:
    """Events as references to fields (owner: the user, name: the type of event) and to classes in array descriptors."""
    e = table(spark, d, "events")
    owner = F.concat(F.lit("Lu/"), F.col("user_id").cast("string"), F.lit(";"))
    kind = lambda c, n: F.concat(F.lit("T"), (c % n).cast("string"))
    no_list = F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    field = e.select(owner.alias("owner"), F.col("event_type").alias("name"), kind(F.col("event_id"), 4).alias("ret"), AU.field_dispatch(F.when(F.col("event_id") % 2 == 0, 0x60).otherwise(0x52)).alias("dispatch")).distinct()
    classes = e.select(F.concat(F.lit("["), owner).alias("owner"), none.alias("name"), none.alias("ret"), none.alias("dispatch")).distinct()
    sites = field.withColumn("kind", F.lit("field")).unionByName(classes.withColumn("kind", F.lit("class")))
    sites = sites.select(
        F.xxhash64("kind", "owner", "name", "ret", "dispatch").alias("site_id"), "kind", "owner", "name", no_list.alias("params"), "ret", "dispatch", F.lit("base").alias("part"), F.lit("d1").alias("dex"),
        F.lit("S").alias("source_class"), F.coalesce("dispatch", F.lit("")).alias("source_method"), F.lit(0).cast("bigint").alias("offset"), F.lit(False).alias("standalone"),
    )
    have = e.where("user_id % 5 <> 0").select(owner.alias("owner"), F.col("event_type").alias("name"), kind(F.col("user_id"), 3).alias("type"), (F.col("user_id") % 4 == 0).alias("is_static")).distinct()
    fields = have.withColumn("load_ord", F.lit(0))
    defs = have.select(F.col("owner").alias("descriptor")).distinct().select("descriptor", F.lit(0).alias("load_ord"), F.lit("base").alias("part"), F.lit("d1").alias("dex"), none.alias("superclass"), no_list.alias("interfaces"))
    methods = fields.select("owner", "name", no_list.alias("params"), F.col("type").alias("ret"), "is_static", F.lit(False).alias("is_direct"), "load_ord").where(F.lit(False))
    out = AU.audit(sites, defs, methods, fields, ignore=())
    return out.select("kind", "reference", F.col("source_method").alias("dispatch"), F.coalesce("reason", F.lit("")).alias("reason"))


@query("SELECT p_name AS descriptor, min(p_partkey) AS load_ord, arg_min(p_brand, p_partkey) AS brand FROM part GROUP BY 1")
def definition_index_first_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_name").alias("descriptor"), F.col("p_partkey").alias("load_ord"), F.col("p_brand").alias("brand"))
    return AU.first_wins(rows, ["descriptor"])


@query(_AUDIT_SQL + """, mapping AS (SELECT 'Lp/' || p_partkey || ';' AS owner, 1 + p_partkey % 50 AS nk FROM part WHERE p_size > 40),
o AS (SELECT y.owner, y.name, y.owner || '->' || y.name || '()' || y.ret AS reference, nk FROM y JOIN mapping USING (owner) WHERE outcome = 'unresolved')
SELECT reference, array_to_string(list_sort(list_concat(['mapped_owner=Lp/' || nk || ';'], coalesce(list(DISTINCT 'Lp/' || nk || ';->' || o.name || '()' || m.ret) FILTER (m.ret IS NOT NULL), []))), ' | ') AS candidates
FROM o LEFT JOIN meth m ON m.k = o.nk AND m.name = o.name GROUP BY reference, nk""")
def mapped_candidates(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "part").where("p_size > 40")
    name = lambda k: F.concat(F.lit("Lp/"), k.cast("string"), F.lit(";"))
    mapping = gone.select(name(F.col("p_partkey")).alias("old"), name(1 + F.col("p_partkey") % 50).alias("new"))
    x = _audit(spark, d, mapping).where(F.exists(F.coalesce("candidates", F.array().cast("array<string>")), lambda c: c.startswith("mapped_owner=")))
    return x.select("reference", F.array_join("candidates", " | ").alias("candidates"))


@query("SELECT source, lang, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars, (CASE WHEN GROUPING(source) = 1 THEN 0 WHEN GROUPING(lang) = 1 THEN 1 ELSE 2 END)::BIGINT AS level FROM documents GROUP BY ROLLUP (source, lang)")
def inspect_rollup(spark: SparkSession, d: str) -> DataFrame:
    return roll_up(table(spark, d, "documents"), ["source", "lang"], ["n_chars"]).withColumn("level", F.col("level").cast("long"))


_WORDS = [("the", "THE"), ("and", "the"), ("der", "die"), ("die", "der"), ("la", "le"), ("anea", "nea")]


@query("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _WORDS) + " ELSE w END), ' ') AS text FROM documents")
def remap_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", M.replace_tokens(F.col("text"), [a for a, _ in _WORDS], [b for _, b in _WORDS], "[A-Za-z]+").alias("text"))


@query()
def remap_texts(spark: SparkSession, d: str) -> DataFrame:
    """The rewriter over whole texts; tests hold it against vectors."""
    pairs = {f"L{a};": f"L{b};" for a, b in _WORDS}
    return M.rewrite_texts(table(spark, d, "documents").select("doc_id", "text"), "text", pairs)


@query("""WITH l AS (SELECT conv_id * 100 + turn AS line_no, CASE WHEN turn % 3 = 1 AND conv_id % 2 = 0 THEN '# UNSAFE: x' WHEN turn % 3 <> 1 THEN 'La/C' || conv_id || '; -> Lb/D' || turn || '; tail' ELSE 'text' END AS text FROM conversations),
m AS (SELECT *, text LIKE 'La/%' AS is_map, max(CASE WHEN text LIKE '# UNSAFE%' THEN line_no END) OVER w AS mark, max(CASE WHEN text LIKE 'La/%' THEN line_no END) OVER w AS last_map FROM l WINDOW w AS (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT regexp_extract(text, '(La/[^;]*;)', 1) AS old, regexp_extract(text, '(Lb/[^;]*;)', 1) AS new, line_no AS ord FROM m WHERE is_map AND NOT (mark IS NOT NULL AND (last_map IS NULL OR mark > last_map))""")
def unsafe_flag_scan(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    m = F.col("turn") % 3
    line = F.when((m == 1) & (F.col("conv_id") % 2 == 0), F.lit("# UNSAFE: x")).when(m != 1, F.format_string("La/C%d; -> Lb/D%d; tail", "conv_id", "turn")).otherwise("text")
    return M.parse_mapping_lines(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("line_no"), line.alias("text")))


@query(f"""WITH {_PAIRS}, r AS (SELECT old_id, new_id, status, CASE WHEN new_id IS NULL THEN ['none'] WHEN old_id % 3 = 0 THEN ['verified: x', 'same descriptor'] WHEN old_id % 3 = 1 THEN ['same descriptor'] ELSE ['semantic break: class/interface access flag changed'] END AS reasons FROM shared)
SELECT old_id, status = 'Matched' AND reasons[1] LIKE 'verified:%' AS verified, status IN ('Matched', 'LowConfidence') AND list_contains(reasons, 'same descriptor') AND NOT reasons[1] LIKE 'verified:%' AS name_only,
status IN ('Conflict', 'SemanticBreak') OR list_contains(reasons, 'semantic break: class/interface access flag changed') AS unsafe FROM r""")
def tiers(spark: SparkSession, d: str) -> DataFrame:
    m = D.mark_shared(_document_matches(spark, d)[0])
    k = F.col("old_class_id") % 3
    reasons = F.when(F.col("new_class_id").isNull(), F.array(F.lit("none"))).when(k == 0, F.array(F.lit("verified: x"), F.lit("same descriptor"))).when(k == 1, F.array(F.lit("same descriptor"))).otherwise(F.array(F.lit(P.SEMANTIC_BREAK)))
    m = m.withColumn("reasons", reasons)
    s, r = F.col("status"), F.col("reasons")
    return m.select(F.col("old_class_id").alias("old_id"), P.is_safe(s, r).alias("verified"), P.is_name_only(s, r).alias("name_only"), P.is_unsafe(s, r).alias("unsafe"))


@query("SELECT o_orderkey, CASE WHEN p_name IS NULL THEN '#' || k ELSE p_name || ' (' || p_brand || '!' || p_type || '#' || CASE WHEN p_size % 10 = 0 THEN '?' ELSE p_size::VARCHAR END || ')' END AS label FROM (SELECT o_orderkey, o_orderkey % (3 * (SELECT count(*) FROM part)) AS k FROM orders) LEFT JOIN part ON p_partkey = k")
def label_projection(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    n = part.agg((3 * F.count(F.lit(1))).alias("n"))
    o = table(spark, d, "orders").select("o_orderkey").join(n).select("o_orderkey", (F.col("o_orderkey") % F.col("n")).alias("k"))
    x = o.join(part, o.k == part.p_partkey, "left")
    origin = F.struct(F.col("p_brand").alias("apk_part"), F.col("p_type").alias("dex_file"), F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("class_def_index"))
    return x.select("o_orderkey", T.class_label(F.col("k"), F.col("p_name"), origin).alias("label"))


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_status(spark, sf_dir)


__all__ = ["QUERIES", "SQL", "TOKEN", "entry_query"]

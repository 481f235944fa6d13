import random
from collections import Counter

from pyspark.sql import functions as F

from artifactlink.operators import candidates, members
from artifactlink.schemas import FIELD

SET = "class_id long, descriptor string, strings array<string>"


def words(spark, rng, ids, vocabulary):
    return spark.createDataFrame([(i, str(i), sorted(rng.sample(vocabulary, rng.randrange(0, 40)))) for i in ids], SET)


def test_rare_pairs_are_all_pairs_through_rare_values(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(300)]
    # an id that occurs twice counts twice, as in a join
    old, new = words(spark, rng, [*range(0, 60, 2), 4, -8], vocabulary), words(spark, rng, [*range(1, 60, 2), 7, 2**62 + 1], vocabulary)
    side = lambda df: [(r.class_id, v) for r in df.collect() for v in r.strings]
    o, n = side(old), side(new)
    few = lambda rows: {v for v, k in Counter(v for _, v in rows).items() if k <= 3}
    rare = few(o) & few(n)
    want = Counter((a, b) for a, v in o for b, w in n if v == w and v in rare)
    got = {(r.old_id, r.new_id): r.n_shared for r in candidates.rare_pairs(old, new, {"string": "strings"}).collect()}
    assert len(rare) > 10 and got == dict(want)


def test_near_sets_lose_none_and_leave_few(spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(3000)]
    olds = [(i, str(i), sorted(rng.sample(vocabulary, rng.randrange(1, 400)))) for i in range(40)] + [(98, "98", []), (98, "98", ["x"]), (99, "99", None)]
    news = [(100 + i, str(i), sorted(set(rng.sample(s, int(len(s) * rng.uniform(0.4, 1.0)))) | set(rng.sample(vocabulary, rng.randrange(0, 60))))) for i, _, s in olds[:40]] + [(198, "198", []), (199, "199", ["x"])]
    old, new = spark.createDataFrame(olds, SET), spark.createDataFrame(news, SET)
    pairs = old.selectExpr("class_id old_id").distinct().crossJoin(new.selectExpr("class_id new_id"))
    got = [tuple(r) for r in candidates.near_sets(pairs, old, new, "strings", 0.55).collect()]
    alike = lambda a, b: not a and not b or len(a & b) / len(a | b) >= 0.55
    want = {(i, j) for i, _, a in olds for j, _, b in news if alike(set(a or []), set(b))}
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 15
    assert len(got) < 1.3 * len(want)


def test_band_pairs_of_one_shape_are_made_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(candidates, "BAND_BLOCK", 10)
    rng = random.Random(6)
    shape = lambda i: (rng.randrange(12), rng.randrange(9)) if i % 4 == 0 else (7, 5)
    side = lambda n: [(i, "L;", ["m"] * m, ["f"] * f) for i in range(n) for m, f in [shape(i)]]
    olds, news = side(60), side(80)
    schema = "class_id long, descriptor string, method_shapes array<string>, field_shapes array<string>"
    got = candidates.band_pairs(spark.createDataFrame(olds, schema), spark.createDataFrame(news, schema)).withColumn("task", F.spark_partition_id()).collect()
    near = lambda a, b: abs(len(a) - len(b)) <= max(len(a), 4) // 2
    assert sorted((r.old_id, r.new_id) for r in got) == sorted((i, j) for i, _, m, f in olds for j, _, n, g in news if near(m, n) and near(f, g))
    hot = Counter(r.task for r in got if r.old_id % 4 and r.new_id % 4)
    assert len(hot) > 1 and max(hot.values()) < 0.6 * sum(hot.values())


def test_members_meet_in_rows_with_cap_and_empty_sides(spark):
    rng = random.Random(8)
    field = lambda i, name, kind: (i, "L;", name, kind, 1)
    olds = [(1, [field(i, f"n{rng.randrange(6)}", f"t{rng.randrange(3)}") for i in range(30)]), (2, [field(50, "a", "t")]), (3, None), (4, [field(60, "a", "t")])]
    news = [(1, [field(100 + i, f"n{rng.randrange(6)}", f"t{rng.randrange(3)}") for i in range(400)]), (2, []), (3, [field(900, "b", "t")]), (4, [field(901, "z", "u")])]
    frame = lambda rows: spark.createDataFrame(rows, f"id bigint, fields array<{FIELD}>")
    pairs = spark.createDataFrame([(i, i, "Matched") for i in range(1, 5)], "old_class_id bigint, new_class_id bigint, status string")
    out = members.match_members(pairs, frame(olds), frame(news), "fields")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    got = {r.old_member_id: [c.entity_id for c in r.candidates] for r in out.collect() if r.old_member_id is not None}
    cap, want = members.member_cap(10), {}
    for (c, os), (_, ns) in zip(olds, news):
        for o in os or []:
            groups = [[n for n in ns if n[2] == o[2]], [n for n in ns if n[2] != o[2] and n[3] == o[3]]]
            met = groups[0][:cap] + groups[1][: max(cap - len(groups[0]), 1)] if any(groups) else ns[:cap]
            scored = sorted((-(0.4 * (n[2] == o[2]) + 0.6 * (n[3] == o[3])), n[0]) for n in met)
            want[o[0]] = [i for s, i in scored if -s >= 0.55][:10]
    assert got == want and want[50] == want[60] == []
    assert {r.new_member_id for r in out.collect() if r.status == "UnresolvedNew"} >= {900, 901}

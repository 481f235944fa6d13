import random

import pytest

from artifactlink.llm.common import ASCII_LOWER, read_table
from artifactlink.llm.jaccard_join import jaccard_components
from tests.llm.support import frame, odd_texts


def brute(rows, size=4, percent=85):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(ASCII_LOWER).split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break
            if sets[i] and root(i) != root(j) and 100 * (k := len(sets[i] & sets[j])) >= percent * (len(sets[i]) + len(sets[j]) - k):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted([(d, len(s), d if not s else least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=str)


def result(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in df.select("doc_id", "n_shingles", "component_id").collect()], key=str)


def family_rows(seed):
    """Near copies in chains and families, passages that many texts share, exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    texts = []
    for f in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 30, 120]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = word()
            if f % 3 == 0:
                w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
            texts.append(" ".join(w))
            base = w if f % 2 and f % 3 else base
    texts += texts[:20]
    texts += [" ".join(passage + [word() for _ in range(rng.randint(2, 12))]) for _ in range(30)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "hot", "part"), [(1, 8, 64), (2, 2, 3), (3, 1000, 2)])
def test_families(spark, seed, hot, part):
    rows = family_rows(seed)
    got = jaccard_components(frame(spark, rows), hot=hot, part=part, bitmap_bits=16, bucket_tokens=500)
    assert result(got) == brute(rows)
    assert len({c for *_, c in result(got)}) < len(rows)


def test_odd_rows(spark):
    rows = [*enumerate(odd_texts(5)), (None, "one two three four five"), (900, "ONE two three four five"), (901, "a"), (901, "a"), (None, None), (902, "x y z"), (903, "X Y Z")]
    assert result(jaccard_components(frame(spark, rows), bitmap_bits=16)) == brute(rows)
    assert jaccard_components(frame(spark, []), bitmap_bits=16).count() == 0


def test_other_size_and_table(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(jaccard_components(docs, size=5, percent=80, bitmap_bits=16)) == brute(rows, 5, 80)

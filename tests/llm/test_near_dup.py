import random

import numpy as np
from awardry.llm.graph import components
from awardry.llm.near_dup import M, estimate, merged, near_duplicates, registers
from awardry.llm.shingles import shingle_set

from .helpers import docs, prose


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        k = min(n, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows, n=2):
    found = near_duplicates(docs(spark, rows), words=n)
    assert {r.id: (r.n_shingles, r.component) for r in found.collect()} == brute(rows, n, 80)


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    passage = prose(rng, 60)
    rows = []
    for i in range(150):  # half share a passage that many have
        body = prose(rng, rng.randrange(20, 120))
        rows.append((i, " ".join((passage if i % 2 else []) + body)))
    base = prose(rng, 100)
    for i in range(150, 220):  # one large group of near copies, in chains
        copy = list(base)
        for _ in range(rng.randrange(0, 12)):
            copy[rng.randrange(len(copy))] = "x" + str(rng.randrange(50))
        rows.append((i, " ".join(copy)))
    rows += [(300, None), (301, ""), (302, "One"), (303, "one"), (304, " \t"), (305, "two words"), (306, rows[3][1].upper() + "\n")]
    check(spark, rows)


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "a b c d")]
    got = sorted(((r.id, r.component) for r in near_duplicates(docs(spark, rows), words=2).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (None, None)]
    assert near_duplicates(docs(spark, []), words=2).count() == 0


def test_sketches_merge_and_estimate():
    rng = random.Random(1)
    a, b = prose(rng, 3000), prose(rng, 3000)
    x, y = shingle_set(" ".join(a + b), 1), shingle_set(" ".join(a), 1)
    assert (merged(registers(shingle_set(" ".join(b), 1)), registers(y)) == registers(x)).all()
    true = len(np.intersect1d(x, y)) / len(x)
    got = estimate(registers(x)[None], registers(y)[None], np.array([len(x)]), np.array([len(y)]))[0]
    assert abs(got - true) < 5 * (true * (1 - true) / M) ** 0.5


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90)], "u long, v long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 100: 90}


def test_different_texts_of_one_id(spark):
    rng = random.Random(3)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (5, [*a, "x"]), (7, b), (9, [*b, "y"]), (9, [*a, "q"])]
    found = near_duplicates(docs(spark, [(i, " ".join(w)) for i, w in rows]), words=2)
    assert sorted((r.id, r.component) for r in found.collect()) == [(1, 1), (5, 1), (7, 7), (9, 1), (9, 7)]


def near_group(size, passages, edits):
    """Copies of one text with so many words exchanged: some are linked with some, many pairs lie below 0.8."""
    rng = random.Random(size)
    base, rows = prose(rng, passages), []
    for i in range(size):
        copy = list(base)
        for _ in range(rng.randrange(*edits)):
            copy[rng.randrange(len(copy))] = "x" + str(rng.randrange(10**6))
        rows.append((i, " ".join(copy)))
    return rows


def test_large_group_of_near_copies_and_its_recall(spark):
    """2,000 copies between 0.6 and 0.9 of one another, beside 3,000 other texts: all links of 5,000 documents are found."""
    rng = random.Random(8)
    rows = near_group(2000, 150, (2, 11)) + [(i, " ".join(prose(rng, 40))) for i in range(2000, 5000)]
    sets = [shingle_set(t, 2) for _, t in rows[:2000]]
    values, places = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.zeros((2000, len(values)), np.float32)
    member[np.repeat(np.arange(2000), [len(s) for s in sets]), places] = 1
    shared, n = member @ member.T, np.array([len(s) for s in sets])
    similar = shared / (n[:, None] + n - shared)
    pairs = similar[np.triu_indices(2000, 1)]
    assert (pairs < 0.8).mean() > 0.3 and ((pairs > 0.7) & (pairs < 0.8)).mean() > 0.2
    linked, root = 100 * shared >= 80 * (n[:, None] + n - shared), np.full(2000, -1)
    for i in range(2000):  # components by a walk over exact links
        stack = [i] if root[i] < 0 else []
        while stack:
            j = stack.pop()
            if root[j] < 0:
                root[j] = i
                stack += np.flatnonzero(linked[j] & (root < 0)).tolist()
    found = {r.id: r.component for r in near_duplicates(docs(spark, rows), words=2).collect()}
    assert [found[i] for i in range(2000)] == root.tolist()
    assert all(found[i] == i for i in range(2000, 5000))

"""Operators 11, 12 and 13 against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from awardry.llm import order_minhash, periodic, spelling
from awardry.llm.acceptor import Acceptor
from awardry.llm.wavelet import Blocks, WaveletMatrix

from .helpers import docs, prose

# order MinHash


def plain_sketch(text):
    """Tuples of least k-mers with their occurrence numbers, one permutation at a time."""
    if not text:
        return [0] * order_minhash.SKETCHES
    values = order_minhash.kmers(text).tolist()
    seen, marks = {}, []
    for v in values:
        marks.append((v + seen.get(v, 0) * int(order_minhash.FACTOR)) % 2**64)
        seen[v] = seen.get(v, 0) + 1
    x = (order_minhash.mixed(np.array(marks, np.uint64)) >> np.uint64(32)).tolist()
    out = []
    for a, b in zip(order_minhash._FACTORS[:, 0].tolist(), order_minhash._SHIFTS[:, 0].tolist()):
        least = sorted(range(len(x)), key=lambda i: ((x[i] * a + b) % 2**32, i))[: order_minhash.TUPLE]
        acc = np.array([len(least)], np.uint64)
        for i in sorted(least):
            acc = order_minhash.mixed(acc * order_minhash.FACTOR + np.uint64(values[i]))
        out.append(int(acc[0] >> np.uint64(32)))
    return out


def test_sketch_is_that_of_the_definition():
    rng = random.Random(3)
    texts = ["", "a", "abcd", "abcde", "abcdef", "ééééééé", "x" * 300, "\U0001f600" * 9, "ab " * 3000]
    texts += [" ".join(prose(rng, rng.randrange(1, 60), 30)) for _ in range(20)]
    for t in texts:
        assert order_minhash.sketch(t).tolist() == plain_sketch(t)
    assert order_minhash.sketch(None).tolist() == plain_sketch("")


def test_likeness_falls_with_the_edit_distance_and_sees_the_order():
    rng = random.Random(5)
    near, far, turned = [], [], []
    for _ in range(60):
        words = prose(rng, 200, 5000)
        a = order_minhash.sketch(" ".join(words))
        changed = words.copy()
        changed[rng.randrange(200)] = "other"
        near.append(order_minhash.likeness(a, order_minhash.sketch(" ".join(changed))))
        changed[100:] = prose(rng, 100, 5000)
        far.append(order_minhash.likeness(a, order_minhash.sketch(" ".join(changed))))
        turned.append(order_minhash.likeness(a, order_minhash.sketch(" ".join(words[100:] + words[:100]))))
    assert np.mean(near) > 0.9 > 0.7 > np.mean(turned) > np.mean(far)  # turned: the same k-mers but some, half of the pairs in another order
    assert abs(np.mean(turned) - 0.5) < 0.1


def plain_ring(rows):
    """op11's columns for rows (id, text), one after another."""
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), (xxhash.xxh64_intdigest(r[1].encode(), 42) + 2**63) % 2**64, r[1].encode()))
    out = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        h = len(t) // 2
        e = t[: len(t) - h] + u[:h]
        a, b, c = (np.array(plain_sketch(x), np.uint32) for x in (t, e, u))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), order_minhash.fingerprint(a), order_minhash.fingerprint(b), float((a == b).mean()), float((a == c).mean())))
    return sorted(out, key=repr)


COLUMNS = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize("case", ["mixed", "one id", "one row", "nulls", "copies"])
def test_next_documents(spark, case):
    rng = random.Random(7)
    text = lambda: " ".join(prose(rng, rng.randrange(0, 30), 50))
    rows = {
        "mixed": [(rng.randrange(-50, 5000), text()) for _ in range(150)] + [(None, "x"), (None, None), (3, None), (-(2**63), "least"), (2**63 - 1, "most"), (9, "é" * 5000), (9, "")],
        "one id": [(5, text()) for _ in range(80)] + [(6, "six"), (4, "four")],
        "one row": [(1, "alone and by itself")],
        "nulls": [(None, None)] * 3,
        "copies": [(8, "the same text")] * 40 + [(i, text()) for i in range(20)],
    }[case]
    got = order_minhash.with_next(docs(spark, rows)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == plain_ring(rows)


def test_no_task_holds_an_id_of_a_third_of_the_rows(spark):
    rows = [(i, f"text {i}") for i in range(2000)] + [(77, f"another {i}") for i in range(1000)]
    parts = order_minhash.ring(docs(spark, rows)).where("not guest").groupBy("part").count().collect()
    assert sum(p["count"] for p in parts) == 3000 and max(p["count"] for p in parts) < 700


def test_fingerprints_keep_columns_and_empty_tables(spark):
    df = docs(spark, [(1, "some text"), (None, None)]).selectExpr("*", "1 as Fingerprint")
    got = order_minhash.fingerprints(df)
    assert got.columns == [*df.columns[:-1], "fingerprint"]
    assert {r.doc_id: r.fingerprint for r in got.collect()} == {1: order_minhash.fingerprint(order_minhash.sketch("some text")), None: "0" * 512}
    assert order_minhash.with_next(docs(spark, []).limit(0)).count() == 0


def test_op11_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 1500").select("doc_id", "text").collect()]
    got = order_minhash.with_next(spark.createDataFrame(rows, "doc_id long, text string")).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == plain_ring(rows)
    assert order_minhash.op11_order_minhash(spark, sf).count() == 200


# spelling


def one_edit(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def test_composition_accepts_exactly_pairs_at_one_edit():
    rng = random.Random(2)
    for _ in range(300):
        words = sorted({"".join(rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(0, 7))) for _ in range(rng.randrange(1, 40))})
        acceptor = Acceptor(words)
        assert sorted(acceptor.endings(0, 0)) == words
        want = sorted(tuple(sorted((u, v))) for i, u in enumerate(words) for v in words[i + 1 :] if one_edit(u, v))
        cuts = sorted({0, 9, *(rng.randrange(9) for _ in range(2))})
        got = [tuple(sorted(p)) for a, b in zip(cuts, cuts[1:]) for p in acceptor.one_edit(a, b)]
        assert sorted(got) == want  # each pair once, whatever the zones


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("", "x", "yy") for b in ("walk", "talk", "walks", "talks"))
    rights = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    reached, todo = {0}, [0]
    acceptor = Acceptor(words)
    while todo:
        for s in acceptor.arcs[todo.pop()].values():
            if s not in reached:
                reached.add(s)
                todo.append(s)
    assert len(reached) == len(rights)


def plain_variants(counts, factor=spelling.FACTOR):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= factor * counts[w] else None
    root = lambda w: root(form[w]) if form[w] else w
    return sorted((w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items())


@pytest.mark.parametrize("most", [spelling.GROUP, 8])
def test_variants(spark, most):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))) for _ in range(120)} | {"prefix" + "".join(rng.choice("xyz") for _ in range(4)) for _ in range(60)} | {"long" * 600, "long" * 600 + "s"}
    counts = {w: rng.choice([5, 5, 6, 30, 170, 900, 5000]) for w in words}
    got = spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), most=most)
    assert sorted(map(tuple, got.collect())) == plain_variants(counts)


def test_large_groups_are_cut(spark):
    words = ["prefix" + f"{i:06d}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(3000)]
    rows = spelling.partitions(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), most=150)
    assert rows.groupBy(*spelling.KEY).count().agg({"count": "max"}).first()[0] <= 150


def test_word_counts(spark):
    rows = [(1, "Straße straße STRASSE x-y × ÷"), (None, "Ünder"), (2, None), (3, ""), (3, "one one"), (3, "one one"), (4, "a" * 70_000)]
    got = dict(map(tuple, spelling.word_counts(docs(spark, rows)).collect()))
    assert got == {"straße": 2, "strasse": 1, "a" * 70_000: 1}
    changed = {w: n for w, n in spelling.word_counts(docs(spark, [(i, "misspelling") for i in range(2000)]), change=spelling.misspelt).collect()}
    want = {}
    for i in range(2000):
        h = zlib.crc32(f"{i}:misspelling".encode())
        w = "misspelling" if h % 199 else "misspelling"[: h % 11] + "misspelling"[h % 11 + 1 :]
        want[w] = want.get(w, 0) + 1
    assert changed == want and len(want) > 3
    assert spelling.word_counts(docs(spark, []).limit(0)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


# periodic runs


def plain_runs(words, least=periodic.LEAST):
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, 3 * q):
                out.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    words = []
    while len(words) < rng.randrange(0, 250):
        k = rng.choice([1, 2, 2, 3, 20])
        part = [rng.randrange(k) for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.3:
            part = [0] * len(part) + [1]
        part = part * rng.randrange(1, 8)
        words += part[: rng.randrange(len(part)) + 1]
    return [b"w%d" % x for x in words]


def test_runs():
    rng = random.Random(1)
    for _ in range(300):
        documents = [repetitive(rng) for _ in range(rng.randrange(1, 5))]
        least = rng.choice([24, 24, 3, 5, 10])
        got = periodic.runs_of_documents(documents, least)
        assert [list(map(tuple, g.tolist())) for g in got] == [plain_runs(d, least) for d in documents]


def test_wavelet_and_blocks():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300):
        values = rng.integers(0, 3, n)
        blocks = Blocks(values)
        assert blocks.suffixes.tolist() == sorted(range(n), key=lambda i: values[i:].tolist())
        tree = WaveletMatrix(blocks.suffixes)
        left = rng.integers(0, n, 50)
        right = left + rng.integers(1, n + 1, 50).clip(max=n - left)
        x = rng.integers(0, 2 * n, 50)
        assert tree.below(left, right, x).tolist() == [(blocks.suffixes[a:b] < c).sum() for a, b, c in zip(left, right, x)]
        k = rng.integers(0, right - left)
        assert tree.smallest(left, right, k).tolist() == [np.sort(blocks.suffixes[a:b])[c] for a, b, c in zip(left, right, k)]


def test_periodic_runs(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t ", "one", "la " * 30_000, "a b " * 12, "a b " * 11 + "a"] + [" ".join(w.decode() for w in repetitive(rng)) for _ in range(60)]
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(9, texts[9])] * 3
    got = sorted((r.id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs(spark, rows)).collect())
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        runs = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        want.append((i or 0, len(words), runs, " ".join(w.decode() for j, w in enumerate(words) if j not in gone)))
    assert got == sorted(want)
    assert periodic.periodic_runs(docs(spark, []).limit(0)).count() == 0


def test_planted():
    done = 0
    for i in (None, *range(-20, 200)):
        words = [b"w%d" % k for k in range(70)]
        got = periodic.planted(i, words)
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0:
            g = h // 10
            a, p = g % 70, 1 + (70 - g % 70) // (3 + g % 8)
            assert got == [words[k] if k < a else words[a + (k - a) % p] for k in range(70)]
            done += 1
        else:
            assert got == words
    assert done > 10 and periodic.planted(0, []) == []

import random
import re

import numpy as np
import pytest

from tollbook.llm import jaccard as j


def sets_of(rows, n):
    out = []
    for key, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        out.append((key, {tuple(words[i: i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()))
    return out


def brute(rows, n, percent):
    sets = sets_of(rows, n)
    parent = {k: k for k, _ in sets if k is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(((k, len(s), None if k is None else find(k)) for k, s in sets), key=str)


def corpus(seed, copies=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(3))
    base = [[word() for _ in range(r.choice([1, 2, 4, 6, 9, 15, 40, 120]))] for _ in range(25)]
    passage = [word() for _ in range(50)]
    rows = []
    for i in range(copies):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = word()
        if r.random() < 0.3:
            words += passage
        rows.append((i * 3 + 1, r.choice([" ", "\n", "\t  "]).join(words)))
    hot = list(base[-1]) + passage + [word() for _ in range(60)]
    for i in range(copies):
        words = list(hot)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = word()
        rows.append((5000 - i, " ".join(words)))
    return rows + [(9001, None), (9002, ""), (9003, " \n"), (9004, "One"), (9005, "ONE"), (None, "one"), (9006, "\u00a0"), (9007, "a b"), (9008, "A\tB")]


@pytest.mark.parametrize("n, percent, seed", [(3, 90, 1), (5, 80, 2), (3, 50, 3)])
def test_like_all_pairs(spark, monkeypatch, n, percent, seed):
    monkeypatch.setattr(j, "GROUP_TOKENS", 300)
    monkeypatch.setattr(j, "GROUP_QUERIES", 200)
    monkeypatch.setattr(j, "KEYS_PER_TASK", 500)
    monkeypatch.setattr(j, "BLOCK_DOCS", 30)
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, node string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.jaccard_components(docs, n, percent).collect()), key=str)
    assert got == brute(rows, n, percent)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_share_a_key(percent):
    r = np.random.default_rng(percent)
    for _ in range(400):
        size = int(r.integers(2, 200))
        a = r.integers(0, 2**63, size).astype(np.uint64)
        b = a.copy()
        for _ in range(int(r.integers(0, max(2, size * (100 - percent) // percent + 1)))):
            b = np.delete(b, r.integers(len(b))) if r.random() < 0.5 and len(b) > 1 else np.append(b, r.integers(0, 2**63, 1).astype(np.uint64))
        a, b = np.unique(a), np.unique(b)
        common = np.intersect1d(a, b).size
        if 100 * common >= percent * (len(a) + len(b) - common) and not np.array_equal(a, b):
            assert np.intersect1d(j.segment_keys(a, percent), j.segment_keys(b, percent)).size


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, "a b c d"), (1, "e f g h"), (2, "a b c d"), (3, "e f g h"), (2, "a b c d")]
    got = sorted((r.doc_id, r.component_id) for r in j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 1)]
    assert j.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), 3, 90).count() == 0


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_linked_sets_share_the_keys_they_need(percent):
    r = np.random.default_rng(percent)
    tried = 0
    for _ in range(400):
        size = int(r.integers(2, 400))
        a = np.unique(r.integers(0, 1 << 62, size).astype(np.uint64))
        drop, more = r.random(len(a)) < r.choice([0.02, 0.1, 0.2]), r.integers(0, 1 << 62, int(size * r.choice([0, 0.02, 0.1]))).astype(np.uint64)
        b = np.unique(np.concatenate([a[~drop], more]))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= percent * (len(a) + len(b) - common) and not np.array_equal(a, b):
            shared = len(np.intersect1d(j.segment_keys(a, percent), j.segment_keys(b, percent)))
            assert shared >= max(j.least_shared(a, percent), j.least_shared(b, percent))
            tried += 1
    assert tried > 40

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasmill.llm import ngram_join as nj


def grams(text, n):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, percent):
    sets = [(k, grams(t, n)) for k, t in rows]
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = {}
    for k, s in sets:
        for g in s:
            at.setdefault(g, []).append(k)
    byid = dict(sets)
    for k, s in sets:
        seen = {}
        for g in s:
            for o in at[g]:
                if o < k:
                    seen[o] = seen.get(o, 0) + 1
        for o, both in seen.items():
            if 100 * both >= percent * (len(s) + len(byid[o]) - both):
                a, b = sorted((find(o), find(k)))
                root[b] = a
    return {k: (len(s), find(k)) for k, s in sets}


def check(spark, rows, n, percent):
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("fp", F.lit("y"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.classes(d, words=n, percent=percent).collect()}
    want = brute(rows, n, percent)
    assert got == want
    return want


def near_copies(r, base, many, edits):
    out = []
    for _ in range(many):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("percent, n", [(85, 4), (80, 5)])
def test_against_all_pairs(spark, percent, n):
    r = random.Random(percent)
    vocab = [f"w{i}" for i in range(3000)]
    hot = [r.choice(vocab) for _ in range(60)]
    texts = [None, "", "  \n", "a b", "A B", "a b c", "x " * 500]
    for size in (5, 8, 12, 20, 40, 80, 160, 400):
        base = [r.choice(vocab) for _ in range(size)]
        texts += near_copies(r, base, 30, max(1, size // 25))
        texts += [" ".join([*hot, *(r.choice(vocab) for _ in range(size))]) for _ in range(12)]
    texts += near_copies(r, [*hot, *(r.choice(vocab) for _ in range(30))], 60, 3)
    r.shuffle(texts)
    want = check(spark, list(enumerate(texts, 5)), n, percent)
    assert len({c for _, c in want.values()}) < len(want)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, rows, 4, 85)


def test_repeated_null_and_empty(spark):
    d = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (9, None)], "doc_id long, text string")
    got = sorted(map(tuple, nj.classes(d, 4, 85).collect()), key=str)
    assert got == sorted([(3, 3, 2), (3, 3, 2), (2, 3, 2), (None, 3, None), (9, 0, 9)], key=str)
    assert nj.classes(d.where("false")).count() == 0
    kept = nj.deduplicated(d)
    assert kept.columns == d.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 9]


def test_pigeonhole_holds():
    r = np.random.default_rng(5)
    sketch = nj.Sketcher(85)
    for _ in range(400):
        n = int(r.integers(6, 700))
        pool = r.integers(0, 2**63, 2 * n).astype(np.uint64)
        both = int(np.ceil(0.85 * 2 * n / 1.85))
        a = np.unique(pool[:n])
        b = np.unique(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
        common = len(np.intersect1d(a, b))
        assert 100 * common >= 85 * (len(a) + len(b) - common)
        bands = {j: (set(k.tolist()), g - len(k)) for j, _, g, k in sketch(a)}
        # Groups without a member have no key; both sets may be without one in the same group.
        assert any(bands[j][0] & set(k.tolist()) or min(bands[j][1], g - len(k)) for j, _, g, k in sketch(b) if j in bands)

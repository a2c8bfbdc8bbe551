import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasmill.llm import suffix_dedup as sd


def brute(rows, n=50):
    least = {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            if k < least.get(w, k + 1):
                least[w] = k
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if least[b[i : i + n]] < k:
                gone[i : i + n] = True
        gone = gone[: len(b)]
        edges = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        out.append((k, len(b), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sha", F.lit("x"))
    assert sorted(tuple(r) for r in sd.remove_repeats(d).collect()) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    text = lambda n, s="abcde fé": "".join(r.choice(s) for _ in range(n))
    shared = [text(r.randint(40, 120)) for _ in range(8)]
    rows = [(900, None), (901, ""), (902, "a" * 49), (903, "a" * 50), (904, "a" * 300), (905, "ab" * 200), (3, "ab" * 100 + "c"), (906, text(60)), (907, text(5, "ab") * 40)]
    for i in range(120):
        parts = [text(r.randint(0, 90)) if r.random() < 0.5 else r.choice(shared)[r.randint(0, 30) :] for _ in range(r.randint(1, 7))]
        rows.append((10 + i, "".join(parts)))
    rows += [(500 + i, rows[20][1]) for i in range(5)] + [(600, rows[25][1][:-1]), (601, rows[26][1] + "!"), (rows[30][0], rows[30][1])]
    r.shuffle(rows)
    check(spark, rows)


def test_whole_table(spark, sf):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_empty_table_and_null_id(spark):
    d = spark.createDataFrame([(None, "z" * 200), (1, "z" * 200)], "doc_id long, text string")
    got = {r.doc_id: r for r in sd.remove_repeats(d).collect()}
    assert got[None].n_removed == 0 and got[1].n_removed == 0 and got[1].n_bytes == 200
    assert sd.remove_repeats(d.where("false")).count() == 0


def test_suffix_order_is_sorted():
    r = np.random.default_rng(4)
    texts = [r.integers(97, 99, int(n)).astype(np.uint8).tobytes() for n in r.integers(50, 85, 60)]
    bucket = np.sort(r.integers(0, 7, 60))
    data = np.frombuffer(b"".join(texts), np.uint8)
    heads = np.cumsum([0, *map(len, texts)])[:-1]
    start = np.concatenate([h + np.arange(len(t) - 49) for h, t in zip(heads, texts)])
    filed = np.repeat(bucket, [len(t) - 49 for t in texts])
    order = sd.Suffixes(data).order(start, filed)
    assert sorted(order.tolist()) == list(range(len(start)))
    seen = [(int(filed[i]), data[start[i] : start[i] + 50].tobytes()) for i in order]
    assert seen == sorted(seen)


def test_anchors_are_the_leftmost_least_grams(monkeypatch):
    """Runs of windows with one anchor, found by sliding minima; texts whose grams repeat go the longer way. Both say the same."""
    r = random.Random(8)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(n)).encode() for n in (49, 50, 51, 84, 85, 200, 3000)]
    texts += [b"a" * 300, b"xy" * 90 + texts[5], texts[4] * 3, (texts[5][:20] + b"\n") * 9]
    calls = []
    where = np.where
    monkeypatch.setattr(sd.np, "where", lambda *a: calls.append(1) or where(*a))
    fast = [[x.tolist() for x in sd.anchors(t)] for t in texts]
    used = len(calls)
    monkeypatch.setattr(sd, "_sliding", lambda x, span, best: np.zeros(max(1, len(x) - span + 1), np.uint64))
    slow = [[x.tolist() for x in sd.anchors(t)] for t in texts]
    assert fast == slow and used < len(calls) - used


def test_runs_are_equal_beginnings_of_one_bucket():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, 50, dtype=np.uint8)
    rows = []
    for at in (None, 0, 7, 8, 39, 40, 41, 42, 47, 48, 49, 50):  # the last one differs behind the first 50 bytes
        for change in (1, 128, 255):
            row = np.concatenate([base, base[:10]])
            if at is not None:
                row[at] += np.uint8(change)
            rows += [row, row]
    data = np.concatenate(rows)
    start, bucket = np.arange(len(rows)) * 60, np.sort(np.arange(len(rows)) % 2)
    order, run = sd.Suffixes(data).runs(start, bucket)
    key = lambda i: (bucket[i], data[start[i] : start[i] + 50].tobytes())
    assert order.tolist() == sorted(range(len(rows)), key=key)
    of = {k: i for i, k in enumerate(sorted(set(map(key, range(len(rows))))))}
    assert run.tolist() == [of[key(i)] for i in order]

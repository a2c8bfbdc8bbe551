"""The pipeline, stage by stage, against plain Python."""

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from test_licenses_pii import plain as base_spans
from test_mixing_packing_media_ann import check_packing, fill
from test_ngram_join import brute

import corpus_pipeline
from atlasmill.llm import boosting, mixing, pii, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The documents of the smallest table with near copies, personal data, nulls, an empty text and a very long one."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    long = max((r for r in rows if r[1]), key=lambda r: len(r[1]))[1]
    words = long.split()
    near = " ".join(words[: len(words) // 2] + ["changed"] + words[len(words) // 2 + 1 :])
    rows += [(100_001, long, "en", "a", len(long)), (100_002, near, "en", None, len(near)), (100_003, None, "en", "a", None), (100_004, "", None, "a", 0)]
    rows += [(100_005 + i, f"{' '.join(words[40 * i : 40 * i + 40])} write to anna{i}@example.com or +49 (0)30 1234567{i}, token = {'a1B2' * 12}.", "de", "b", 1) for i in range(20)]
    rows += [(100_030, f"{long} {near} " * 6, "en", "b", 1)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    os.symlink(f"{sf}/labels.parquet", f"{path}/labels.parquet")
    return path


def plain_quality(rows, model):
    features, kept = quality.Features(), []
    for r in rows:
        x = features((r[1] or "").encode())
        score = model.prior
        if x.any():
            z = (x - model.mean).astype(float) @ model.axes.astype(float)
            z = z / max(math.sqrt((z * z).sum()), 1e-9)
            cos = sorted(((round(float(z @ p), 9), -i) for i, p in enumerate(model.points.astype(float))), reverse=True)[: quality.NEIGHBOURS]
            w = [(max(c, 0) ** 4 + 1e-6, model.y[-i]) for c, i in cos]
            score = (sum(a * y for a, y in w) + model.prior * 0.5) / (sum(a for a, _ in w) + 0.5)
        if score >= 0.3:
            kept.append(r)
    return kept


def plain_deduplicated(rows):
    root = brute([(r[0], r[1]) for r in rows], 5, 80)
    return [r for r in rows if root[r[0]][1] == r[0]]


def plain_redacted(rows):
    trees, least = pii.model()
    out = []
    for r in rows:
        if r[1] is None:
            out.append(r)
            continue
        text, spans = r[1], base_spans(r[1])
        found = []
        for kind, pattern, hint in pii.GENERATORS:
            if not regex.search(hint, text):
                continue
            for m in regex.finditer(pattern, text):
                odds = boosting.margin(trees, [float(x) for x in pii.features(kind, m[0], text[max(0, m.start() - 24) : m.start()])])
                if odds >= least[kind]:
                    found.append((kind, m.start(), m.end(), odds))
        meets = lambda a, b: a[1] < b[2] and b[1] < a[2]
        better = lambda a, b: (-a[3], a[1], a[0]) < (-b[3], b[1], b[0])
        spans = list(spans) + [s[:3] for s in found if not any(meets(s, b) for b in spans) and not any(meets(s, o) and better(o, s) for o in found)]
        new, at = "", 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
            if a >= at:
                new += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        new += text[at:]
        out.append((r[0], new, r[2], r[3], len(new)))
    return out


def plain_mixed(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    sizes = {s: sum(size(r[1]) for r in own) for s, own in by.items()}
    targets = fill(sizes, mixing.WEIGHTS, mixing.MOST_COPIES)
    out = []
    for s, own in by.items():
        rate = targets[s] / sizes[s] if sizes[s] else 0.0
        digest = hashlib.md5(f"{mixing.SEED}:{'null' if s is None else 's:' + s}".encode()).hexdigest()
        u = int(digest[:8], 16) / 2**32
        for i, r in enumerate(sorted(own, key=lambda r: (size(r[1]), r[0]))):
            out += [r] * min(math.floor((i + 1) * rate + u) - math.floor(i * rate + u), mixing.MOST_COPIES)
    return out


def test_every_stage(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "pii", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    plain = [lambda x: plain_quality(x, model), plain_deduplicated, plain_redacted, plain_mixed]
    for (name, stage), own in zip(corpus_pipeline.STAGES[:-1], plain):
        docs = corpus_pipeline.stash(stage(spark, docs, folder), f"test-{name}")
        before, rows = rows, own(rows)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = Counter(tuple(r) for r in docs.collect())
        assert got == Counter(rows), (name, list((got - Counter(rows)).items())[:2], list((Counter(rows) - got).items())[:2])
        assert before != rows, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    n, total = check_packing([(r[0], r[1]) for r in rows], packed)
    assert n <= 1.1 * total / 2048 + 1
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, whole)) == Counter(map(key, packed))


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    os.symlink(f"{folder}/labels.parquet", f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark, folder):
    """Extra columns keep their values through every stage but the last, whatever their names."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    for c in ("_score", "score", "_text", "_email", "_kept", "component_id", "fp", "copies", "size", "target", "c0"):
        docs = docs.withColumn(c, F.lit(c))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stash(stage(spark, docs, folder), f"test-{name}")
        rows = docs.collect()
        assert rows and all(r[c] == c for r in rows for c in docs.columns[5:]), name
    assert np.all([r.length > 0 for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()])


def test_texts_are_dealt_out_once(spark, folder):
    """Mixing ranks the rows, which takes one exchange of them; near duplicates leave them where they are. Small tables come to them whatever the session's limit."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage in (corpus_pipeline.mixing_stage, corpus_pipeline.near_duplicate_stage):
            plan = stage(spark, docs, folder)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set(limit, before)

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasmill.llm import ann, media, mixing, packing

DOCS = "doc_id long, text string, source string, copies string, _at string, size int"
ROWS = [
    (1, "a b c", "x", "q", "q", 1), (2, None, "x", "q", "q", 1), (3, "", None, "q", "q", 1), (4, "one", None, "q", "q", 1),
    (5, "a b c", "x", "q", "q", 1), (5, "a b c", "x", "q", "q", 1), (6, " ".join(["w"] * 9000), "y", "q", "q", 1), (7, " x y z", "y", "q", "q", 1),
]


def fill(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        t = {s: most * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if t[s] > most * sizes[s]}
        if not over:
            return t
        capped |= over


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def test_mix_targets_and_bounds(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[2]] += len(__import__("re").findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = fill(sizes, (1, 2, 3), 3)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3


def test_mix_near_targets_and_reruns(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (sorted(map(tuple, mixing.mix(x).select("doc_id", "source", "size", "target", "copies").collect())) for x in (d, d.repartition(5)))
    assert a == b
    got, target, most = Counter(), {}, Counter()
    for _, s, size, t, c in a:
        got[s] += size * c
        target[s] = t
        most[s] = max(most[s], size)
    assert all(abs(got[s] - target[s]) <= 3 * most[s] for s in target)


def test_mixed_rows_keep_columns(spark, docs):
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    copies = {r.doc_id: 0 for r in docs.collect()}
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})


def test_mix_empty(spark, docs):
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.mixed_rows(docs.where("false")).count() == 0


def check_packing(docs, rows, capacity=2048):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for k, t in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[k, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= capacity
    return len(seqs), sum(r.length for r in rows)


def test_pack_small_table(spark, docs):
    extra = [(8, "x  y\n z \n"), (9, "say <|endoftext|> twice it's"), (10, " lead"), (11, "trail "), (12, " nb sp　 x\u0085 y")]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    check_packing([(r.doc_id, r.text) for r in d.collect()], packing.pack(d).collect())
    assert packing.pack(docs.where("false")).count() == 0


def test_pack_corpus(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    n, total = check_packing([(r.doc_id, r.text) for r in d.collect()], packing.pack(d).collect())
    assert n <= 1.03 * total / 2048 + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_against_rules(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice([rng.integers(1, 101, 300), rng.integers(34, 101, 300), rng.integers(1, 20, 300)][seed % 3], 400)
    runs = packing.plan(dict(Counter(map(int, lengths))), 100)
    seen, bins = Counter(), defaultdict(list)
    for length, rank, n, bin0, at in runs.tolist():
        assert rank == seen[length]
        seen[length] += n
        for i in range(n):
            bins[bin0 + i].append((at, length))
    assert seen == Counter(map(int, lengths))
    for parts in bins.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 100 and sum(n > 33 for _, n in parts) <= 2
    assert sorted(bins) == list(range(len(bins)))


def test_media_round_trip(spark, docs):
    for r in media.media_facts(docs).collect():
        text = next(x[1] for x in ROWS if x[0] == r.doc_id) or ""
        p = media.payload_of(text.encode())
        assert len(p) % 64 == 0 and len(p) > 0 and p.rstrip(b"\0") == text.encode()
        assert (r.n_bytes, r.payload_bytes) == (len(text.encode()), len(p))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-64:])
        stored = b"P5\n64 %d\n255\n" % (len(p) // 64) + p
        assert r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest() and len(r.feature) == 16
    assert media.media_facts(docs.where("false")).count() == 0


def test_media_formats():
    rng = np.random.default_rng(1)
    rgb, g = rng.integers(0, 256, (7, 5, 3), np.uint8), rng.integers(0, 256, (6, 9), np.uint8)
    assert (media.decode(media.encode_ppm(rgb)) == rgb).all() and (media.decode(media.encode_pgm(g)) == g).all() and (media.decode(media.encode_bmp(rgb)) == rgb).all()
    assert media.decode(b"P1 # a\n3 1\n1 0 1\n").tolist() == [[0, 255, 0]]
    assert media.decode(b"P2\n2 2\n10\n0 5\n10 1\n").tolist() == [[0, 128], [255, 26]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3\n").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n9 1\n\x80\x80").tolist() == [[0] + [255] * 7 + [0]]
    for bad in (b"", b"P5\n2 2\n255\nx", b"GIF89a", b"BM", b"P9 1 1 1"):
        with pytest.raises(Exception):
            media.decode(bad)


def test_shrink_is_the_area_mean(monkeypatch):
    a = np.random.default_rng(2).integers(0, 256, (37, 23))
    fine = np.repeat(np.repeat(a, 8, 0), 9, 1).reshape(8, 37, 9, 23).mean((1, 3))
    assert np.allclose(media.shrink(a, 8, 9), fine)
    monkeypatch.setattr(media, "STRIP_ROWS", 5)
    assert np.allclose(media.shrink(a, 8, 9), fine)


def test_media_column(spark):
    rows = [(1, media.encode_pgm(np.full((40, 40), 7, np.uint8))), (2, None), (3, b"junk")]
    got = {r.k: r for r in media.decode_column(spark.createDataFrame(rows, "k int, img binary"), "img", "k").collect()}
    assert (got[1].width, got[1].channels, got[1].error) == (40, 1, None) and np.load(__import__("io").BytesIO(got[1].tile)).mean() == 7
    assert got[2].width is None and got[3].error


def brute(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, a in ok:
        if q % 50 == 0:
            s = sorted(((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i) for i, b in ok if i != q and len(a) == len(b)))
            out[q] = [i for _, i in s[:k]]
    return out


def test_ann_recall(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in t.collect()])
    got = defaultdict(list)
    for r in ann.nearest(t, t.where(F.col("vec_id") % 50 == 0)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_ann_visits_a_share():
    """Recall and the share of vectors verified, on plain and on clustered vectors."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 64))
    for vectors, most in ((rng.standard_normal((4000, 64)), 0.85), (centres[rng.integers(0, 60, 4000)] + 0.3 * rng.standard_normal((4000, 64)), 0.2)):
        ids = np.arange(len(vectors))
        asked = ids[::50]
        unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
        got, visited = ann.search_block(ids, vectors, asked, vectors[asked], 5)
        found = defaultdict(set)
        for q, i, _ in got:
            found[q].add(i)
        hits = 0
        for q in asked:
            cos = unit @ unit[q]
            cos[q] = -9
            hits += len(found[q] & set(np.argsort(-cos, kind="stable")[:5].tolist()))
        assert hits / len(asked) / 5 >= 0.9
        assert visited / len(asked) / len(ids) <= most


def test_ann_in_cells(spark, monkeypatch):
    """Many cells and blocks, a hot cell of equal vectors, and queries that must look into other cells."""
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((700, 6)))] + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(300)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "ROWS_A_BLOCK", 40)
    monkeypatch.setattr(ann, "QUERIES_A_BLOCK", 3)
    want = brute(rows)
    got = defaultdict(list)
    for r in ann.nearest(t, t.where(F.col("vec_id") % 50 == 0)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    assert all(got[q] == want[q] for q in want if q >= 1000)


def test_ann_odd_rows(spark, monkeypatch):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, [float("nan"), 1.0]), (150, None), (1, [None, 1.0]), (2, [2.0, 0.0]), (3, [4.0, 0.0]), (4, [-1.0, 0.0]), (5, [float("inf"), 0.0]), (6, [1.0, 0.0, 0.0]), (7, [0.0, 3.0]), (2, [2.0, 0.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    asked = t.where(F.col("vec_id") % 50 == 0)
    for blocks in (16384, 2):
        monkeypatch.setattr(ann, "ROWS_A_BLOCK", blocks)
        got = ann.nearest(t, asked).orderBy("rank").collect()
        assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 2, 1.0), (0, 2, 1.0), (0, 3, 1.0), (0, 7, 0.0), (0, 4, -1.0)]
    assert ann.nearest(t.where("false"), asked.where("false")).count() == 0 and ann.nearest(t.where("false"), asked).count() == 0
